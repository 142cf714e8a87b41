"""Queries of sources (SRC) and streams (ST); streams run over the events there are, into a table that is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as ti
from barloom.plans.kit import Registry
from barloom.plans.technical import W, frame, r
from barloom.sources import store
from barloom.sources.bars import bars, master, table
from barloom.streaming import jobs

R = Registry()
KEY = ["symbol_id", "trade_date"]
D = lambda x: F.to_date(F.lit(x))
stream = lambda s, d: jobs.event_stream(s, f"{d}/events.parquet")


def utc(df):
    """Times as they are in the tables, without a zone."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


END = "(SELECT max(ts) - INTERVAL 1 DAY FROM ev)"
R.add("st1_bars", lambda s, d: utc(jobs.drain(jobs.bars(stream(s, d)))), "ev", f"""SELECT symbol_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS "end", round(first(importance ORDER BY ts, event_id), 6) AS open, round(max(importance), 6) AS high, round(min(importance), 6) AS low, round(last(importance ORDER BY ts, event_id), 6) AS close, count(*) AS volume FROM ev GROUP BY symbol_id, CAST(ts AS DATE) HAVING CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= {END}""")
R.add("st2_first_of_kind", lambda s, d: utc(jobs.drain(jobs.first_of_kind(stream(s, d)))).select("symbol_id", "category"), "ev", "SELECT DISTINCT symbol_id, category FROM ev")
R.add("st3_corroborated", lambda s, d: jobs.drain(jobs.corroborated(stream(s, d), stream(s, d))), "ev", "SELECT a.event_id, b.event_id AS other_id, a.symbol_id, a.category FROM ev a JOIN ev b ON a.symbol_id = b.symbol_id AND a.category = b.category AND a.source <> b.source AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000")
R.add("st4_episodes", lambda s, d: utc(jobs.drain(jobs.episodes(stream(s, d)))))
R.add("st6_appearances", lambda s, d: utc(jobs.drain(jobs.appearances(stream(s, d)))), "ev", f"""WITH x AS (SELECT symbol_id, CAST(CAST(ts AS DATE) + CAST(k AS INTEGER) AS TIMESTAMP) AS e FROM ev, range(1, 21) AS t(k)) SELECT symbol_id, e AS "end", count(*) AS n FROM x WHERE e <= {END} GROUP BY 1, 2""")


def split(s, d):
    path = store.table_path(s)
    jobs.split_batches(stream(s, d), lambda b: (F.col("importance") > 20) & F.col("category").isNotNull(), f"{path}/good", f"{path}/bad", f"{path}/state")
    good, bad = (s.read.parquet(f"{path}/{k}") for k in ("good", "bad"))
    return good.agg(F.lit("valid").alias("part"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("rejected").alias("part"), F.count("*").alias("n")))


R.add("st7_split", split, "ev", "SELECT 'valid' AS part, count(*) FILTER (WHERE importance > 20) AS n FROM ev UNION ALL SELECT 'rejected', count(*) FILTER (WHERE NOT coalesce(importance > 20, false)) FROM ev")


def refreshed(s, d):
    path = store.table_path(s)
    daily = bars(s, d)
    daily.filter("trade_date < '2001-06-01'").write.parquet(f"{path}/bars")
    jobs.refresh(path, lambda b: ti.sma(b, 20), 40)(daily.filter("trade_date >= '2001-06-01'"), 0)
    return s.read.parquet(f"{path}/features").select(*KEY, "sma_20")


R.add("st5_refresh", refreshed, "bars", f"WITH x AS (SELECT symbol_id, trade_date, {r(f'avg(close) {frame(20)}', 'sma_20')} FROM bars) SELECT * FROM x WHERE trade_date >= DATE '2001-06-01'")

R.add("src1_fallback", lambda s, d: store.with_fallback(bars(s, d).withColumn("adjusted_close", F.when(F.dayofmonth("trade_date") % 2 == 0, F.col("close") * 0.5))).select(*KEY, "open", "close"), "bars", f"SELECT symbol_id, trade_date, {r('open', 'open')}, {r('CASE WHEN day(trade_date) % 2 = 0 THEN close * 0.5 ELSE close END', 'close')} FROM bars")
R.add("src2_restrict", lambda s, d: store.restrict(bars(s, d), master(s, d).filter("market_cap > 5000"), D("1998-01-01"), D("1999-12-31")).select(*KEY, "close"), "bars master", f"SELECT symbol_id, trade_date, {r('close', 'close')} FROM bars WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND symbol_id IN (SELECT symbol_id FROM master WHERE market_cap > 5000)")
R.add("src3_latest", lambda s, d: store.latest_values(bars(s, d), D("2000-06-30"), ["open", "close", "volume"]), "bars", f"SELECT symbol_id, max(trade_date) AS trade_date, {r('arg_max(open, trade_date)', 'open')}, {r('arg_max(close, trade_date)', 'close')}, {r('arg_max(volume, trade_date)', 'volume')} FROM bars WHERE trade_date <= DATE '2000-06-30' GROUP BY 1")


def snapshots(s, d):
    path = store.table_path(s)
    rows = ti.sma(bars(s, d), 20).select(*KEY, "sma_20")
    store.write_features(rows, path, "one")
    store.write_features(rows.withColumn("sma_20", -F.col("sma_20")), path, "two")
    return store.read_features(s, path, "two", "1999-03-01", "2000-02-28").select(*KEY, "sma_20")


R.add("src7_time_travel", snapshots, "bars", f"WITH x AS (SELECT symbol_id, trade_date, {r(f'-avg(close) {frame(20)}', 'sma_20')} FROM bars) SELECT * FROM x WHERE trade_date BETWEEN DATE '1999-03-01' AND DATE '2000-02-28'")
R.add("src8_newer", lambda s, d: store.newer(bars(s, d).filter("trade_date < '2000-01-01' and symbol_id % 3 <> 0").select(*KEY, "close"), bars(s, d).select(*KEY, (F.col("close") * 2).alias("close"))), "bars", f"WITH l AS (SELECT symbol_id, max(trade_date) AS l FROM bars WHERE trade_date < DATE '2000-01-01' AND symbol_id % 3 <> 0 GROUP BY 1) SELECT symbol_id, trade_date, {r('CASE WHEN l IS NULL OR trade_date > l THEN close * 2 ELSE close END', 'close')} FROM bars LEFT JOIN l USING (symbol_id)")
R.add("src9_replace_tail", lambda s, d: store.replace_tail(bars(s, d).select(*KEY, "close"), bars(s, d).filter("trade_date >= '1999-06-01'").select(*KEY, (-F.col("close")).alias("close")), D("2000-01-01")), "bars", f"SELECT symbol_id, trade_date, {r('''CASE WHEN trade_date >= DATE '1999-06-01' THEN -close ELSE close END''', 'close')} FROM bars")
R.add("src10_attach_master", lambda s, d: store.attach_master(bars(s, d).select(*KEY), master(s, d).withColumn("sector", F.when(F.col("symbol_id") % 4 == 0, "  ").when(F.col("symbol_id") % 4 != 1, F.col("sector"))).select("symbol_id", "sector")), "bars master", "SELECT symbol_id, trade_date, CASE WHEN symbol_id % 4 IN (0, 1) THEN 'Other' ELSE coalesce(sector, 'Other') END AS sector FROM bars LEFT JOIN master USING (symbol_id)")


def raw(s, d):
    path = store.table_path(s)
    text = bars(s, d).select(F.col("symbol_id").cast("string").alias("SC_CODE"), F.date_format("trade_date", "dd-MM-yyyy").alias("TRADING_DATE"), *[F.when(F.dayofmonth("trade_date") != 13, F.format_number(c, 2)).alias(c.upper()) for c in ("open", "high", "low", "close")], F.format_number("volume", 0).alias("NO_OF_SHRS"))
    text.unionAll(text.filter("SC_CODE = '3'")).write.option("header", True).csv(path)
    names = text.columns
    return store.raw_bars(s.read.schema(", ".join(f"{c} string" for c in names)).option("header", True).csv(path)).select(*KEY, F.round("close", 1).alias("close"))


R.add("src11_raw_bars", lambda s, d: raw(s, d).groupBy("symbol_id").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_day"), F.sum("close").cast("long").alias("total")).drop("total"), "bars", "SELECT symbol_id, count(*) AS n, min(trade_date) AS first_day FROM bars WHERE day(trade_date) <> 13 GROUP BY 1")
R.add("src13_normalise", lambda s, d: store.normalise(table(s, d, "supplier").select(F.col("s_suppkey").alias(" Symbol-Id "), F.concat(F.format_number("s_acctbal", 2), F.lit("%")).alias("ROE %"), F.when(F.col("s_suppkey") % 2 == 0, "Yes").otherwise("n").alias("Listed?"), F.col("s_name").alias("Extra")), ["roe"], ["listed"]), "", "SELECT s_suppkey AS symbol_id, round(s_acctbal, 2) AS roe, s_suppkey % 2 = 0 AS listed, s_name AS extra FROM supplier")
