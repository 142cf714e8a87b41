"""How often bars are dealt, and that it does not matter where a task's batches end."""

import datetime as dt
import random

import pytest

from barloom.operators import scans, shapes
from barloom.sources.bars import walks
from tests.test_shapes import BARS, DAY

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_walks_deal_lines_once(spark):
    assert exchanges(walks(spark, SF)) == 1


@pytest.mark.parametrize("families", [(), ("flag",), ("darvas_box", "ipo_base")])
def test_a_scan_deals_bars_once(spark, families):
    assert exchanges(scans.scan(spark.createDataFrame([], BARS), *families, latest=False)) == 1


def test_ends_of_batches_do_not_matter(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for symbol in range(12):
        c = 100.0
        for i in range(rng.choice([20, 90, 130, 260])):
            c *= 1 + rng.uniform(-0.04, 0.042)
            rows.append((symbol, DAY + dt.timedelta(days=i), c, c * 1.01, c * 0.99, c, float(rng.choice([10, 11, 12, 80]))))
    made = spark.createDataFrame(rows, BARS).repartition(3)
    want = sorted(map(str, shapes.shapes(made).collect()))
    assert len(want) > 10
    monkeypatch.setattr(shapes, "ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert sorted(map(str, shapes.shapes(made).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bands_are_ranked_in_pieces(spark):
    from barloom.operators import outcomes

    rows = spark.createDataFrame([("a" if i % 9 else "b", float(i * 7 % 40), float(i * 5 % 23) if i % 11 else None) for i in range(300)], "band string, s double, y double")
    want, got = ([tuple(r) for r in outcomes.spearman(rows, "s", "y", "band", few=few).orderBy("band").collect()] for few in (False, True))
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(want, got))
    # no window takes a whole band
    plan = outcomes.spearman(rows, "s", "y", "band", few=True)._jdf.queryExecution().executedPlan().toString()
    assert "Window [rank(" not in plan
