"""Ranks taken piece by piece against ranks over all rows, and report operators on awkward rows."""

import pandas as pd

from barloom.functions.stats import spread_rank
from barloom.operators import reports


def test_ranks_by_pieces_equal_whole_ranks(spark):
    rows = [(k, float(v % m) if v % 11 else None) for k, m in (("a", 7), ("b", 500)) for v in range(1200)]
    got = spread_rank(spark.createDataFrame(rows, "k string, v double"), "v", "p", "k").toPandas()
    want = got.groupby("k")["v"].rank(pct=True)
    assert len(got) == len(rows) and got["p"].isna().eq(got["v"].isna()).all()
    assert ((got["p"] - want).abs().dropna() < 1e-12).all()


def test_ranks_of_no_rows(spark):
    empty = spark.createDataFrame([], "k string, v double, w double")
    assert spread_rank(empty, "v", "p", "k").count() == 0
    assert reports.pooled_ic(empty, "v", "w").collect()[0]["ic"] is None


def test_drawdown_starts_at_zero(spark):
    days = pd.date_range("2020-01-01", periods=4).date
    rows = spark.createDataFrame(list(zip(days, [-2.0, 5.0, -1.0, -3.0])), "trade_date date, spread double")
    assert reports.drawdown_of_sum(rows, "spread").collect()[0]["max_drawdown"] == 4.0


def test_folds_fit_the_dates(spark):
    rows = spark.createDataFrame([(d,) for d in pd.date_range("2020-01-31", "2021-12-31").date], "trade_date date")
    got = reports.folds(rows).orderBy("fold").collect()
    assert [r["fold"] for r in got] == [0, 1, 2] and str(got[0]["validation_start"]) == "2021-01-28" and str(got[1]["train_start"]) == "2020-04-28"
    assert all(r["validation_end"] <= rows.toPandas()["trade_date"].max() for r in got)
