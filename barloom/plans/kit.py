"""How queries and their SQL are put side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.stats import nearest

Query = Callable[[SparkSession, str], DataFrame]

#: Bars, master data, fundamentals, trades and events as SQL; the same definitions as in ``sources.bars``.
SQL = {
    "ticks": """SELECT l_suppkey AS symbol_id, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / l_quantity AS p, l_orderkey, l_linenumber, l_quantity AS q, l_returnflag <> 'R' AS kept FROM lineitem""",
    "bars": """SELECT symbol_id, trade_date, first(p ORDER BY l_orderkey, l_linenumber, p) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY l_orderkey, l_linenumber, p) AS close,
      CAST(sum(q) AS DOUBLE) AS volume, 100.0 * sum(CASE WHEN kept THEN q ELSE 0 END) / sum(q) AS delivery_pct FROM ticks GROUP BY symbol_id, trade_date""",
    "walks": """WITH d AS (SELECT l_suppkey * 8 + v AS symbol_id, CAST(l_shipdate AS DATE) AS trade_date, round(avg(((l_orderkey * (7 + v) + l_partkey * (13 + 5 * v) + l_linenumber * 29) % 101 - 50) / 50.0 + (l_orderkey * (101 + v) % 1009) / 99991.0), 6) AS step, CAST(sum(l_quantity * l_quantity) AS DOUBLE) AS volume FROM lineitem, range(8) t(v) GROUP BY 1, 2),
      e AS (SELECT *, 100 * exp(0.04 * sum(step) OVER (PARTITION BY symbol_id ORDER BY trade_date)) AS close FROM d)
      SELECT symbol_id, trade_date, coalesce(lag(close) OVER (PARTITION BY symbol_id ORDER BY trade_date), close) AS open, close * (1 + (0.01 * abs(step) + 0.002)) AS high, close * (1 - (0.01 * abs(step) + 0.002)) AS low, close, volume FROM e""",
    "master": """SELECT s_suppkey AS symbol_id, n_name AS sector, r_name AS parent, abs(s_acctbal) AS market_cap FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "bench": """SELECT trade_date, avg(close) AS bench_close FROM bars GROUP BY trade_date""",
    "fundamentals": """SELECT o_custkey AS symbol_id, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS report_date, sum(o_totalprice) AS sales, CAST(count(*) AS DOUBLE) AS orders,
      CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) + INTERVAL 30 DAY AS DATE) AS available_at FROM orders GROUP BY 1, 2, 5""",
    "trades": """SELECT l_suppkey % 7 AS account, l_partkey % 50 AS instrument, CASE WHEN l_returnflag <> 'R' THEN 'BUY' ELSE 'SELL' END AS side, l_quantity AS qty, l_extendedprice / l_quantity AS price, CAST(l_shipdate AS DATE) AS executed_on, l_orderkey, l_linenumber FROM lineitem""",
    "ev": """SELECT event_id, user_id AS symbol_id, event_type AS category, value AS importance, ts, event_id % 2 AS source FROM events""",
}
NEEDS = {"bars": ["ticks"], "bench": ["bars"]}


def with_(names: str, body: str) -> str:
    """SQL with the named definitions before it."""
    out: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in out:
            out.append(name)

    for name in names.split():
        add(name)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in out)
    body = body.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating results to a fixed number of digits, as their SQL has them."""
    return df.select(*[nearest(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, names: str = "", sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
        if sql is not None:
            self.sql[name] = with_(names, sql) if names else sql
