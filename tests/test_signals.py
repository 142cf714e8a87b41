"""Confirmed patterns, controls and valuation windows on small fixtures with expected values worked out by hand or by pandas."""

import datetime as dt

import numpy as np
import pandas as pd

from barloom.operators import candidates, signals, valuation

DAY = dt.date(2020, 1, 1)
BARS = "symbol_id long, trade_date date, open double, high double, low double, close double, volume double, delivery_pct double"


def bars(spark, closes, loud=()):
    rows = [(1, DAY + dt.timedelta(days=i), c, c + 1, c - 1, c, 1000.0 if i in loud else 10.0 + i % 3, 50.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def test_tight_closes_after_an_advance(spark):
    closes = [100.0 + 2 * i for i in range(45)] + [190.0] * 16 + [195.0, 195.0]
    quiet = signals.tight_closes(bars(spark, closes)).collect()
    assert {r["state"] for r in quiet} <= {"watchlist"}
    found = signals.tight_closes(bars(spark, closes, loud={62})).filter("state = 'confirmed'").collect()
    assert found and {r["signal_date"] for r in found} == {DAY + dt.timedelta(days=62)}
    assert all(r["ceiling"] <= 191.0 and abs(r["invalidation"] - 0.97 * 190) < 1e-9 for r in found if r["trade_date"] >= DAY + dt.timedelta(days=55))
    # an advance of a tenth is not enough
    assert signals.tight_closes(bars(spark, [100 + 0.2 * i for i in range(45)] + [109.0] * 18, loud={62})).count() == 0


def test_inside_week_breaks_out(spark):
    start = dt.date(2020, 1, 6)
    shape = [(60.0, 40.0, 50.0)] * 35 + [(55.0, 45.0, 50.0)] * 5 + [(62.0, 50.0, 57.0)] * 5
    rows = [(1, start + dt.timedelta(days=7 * (i // 5) + i % 5), c, h, low, c, 900.0 if i == 41 else 10.0 + i % 3, 50.0) for i, (h, low, c) in enumerate(shape)]
    got = signals.inside_weeks(spark.createDataFrame(rows, BARS)).collect()
    assert [(str(r["week_end"]), r["ceiling"], r["invalidation"], str(r["signal_date"])) for r in got] == [("2020-02-28", 55.0, 45.0, "2020-03-03")]


def test_nothing_from_no_bars(spark):
    none = bars(spark, [1.0]).limit(0)
    for operator in (signals.contractions, signals.reclaims, signals.tight_closes, signals.inside_weeks):
        assert operator(none).count() == 0


def test_nearest_control_and_ties(spark):
    classified = spark.createDataFrame([(1, DAY, "a", 10.0), (2, DAY, "a", 8.0), (3, DAY, "a", 12.0), (4, DAY, "a", 30.0), (5, DAY, "b", 10.0), (6, DAY, "b", 50.0)], "symbol_id long, trade_date date, band string, liquidity double")
    signal = spark.createDataFrame([("s1", 1, DAY, "a"), ("s4", 4, DAY, "a"), ("s5", 5, DAY, "b")], "signal_id string, symbol_id long, trade_date date, band string")
    got = {r["signal_id"]: r["control_symbol"] for r in signals.matched_controls(signal, classified, "trade_date", "band").collect()}
    assert got == {"s1": 2, "s4": 3, "s5": 6}


def test_windows_against_pandas(spark):
    draw = np.random.default_rng(1)
    values = [None if i % 7 == 3 else float(draw.integers(1, 9)) for i in range(120)]
    rows = spark.createDataFrame([("u", DAY + dt.timedelta(days=i), v) for i, v in enumerate(values)], "k string, trade_date date, v double")
    wanted = {m: ("w", m) for m in ("avg", "median", "zscore", "percentile")}
    got = valuation.against_past(rows, "k", "v", {"w": (30, 10)}, wanted).orderBy("trade_date").toPandas()
    series = pd.Series(values, dtype=float)
    roll = series.rolling(30, min_periods=10)
    place = roll.apply(lambda w: w.dropna().rank(pct=True).iloc[-1] * 100)
    for name, want in (("avg", roll.mean()), ("median", roll.median()), ("zscore", (series - roll.mean()) / roll.std()), ("percentile", place)):
        assert np.allclose(got[name].to_numpy(float), want.to_numpy(float), atol=1e-6, equal_nan=True), name


def test_exit_of_an_entry_between_bars(spark):
    rows = [(1, DAY + dt.timedelta(days=2 * i), 1.0, 1.0, 1.0, c, 1.0, 50.0) for i, c in enumerate([10.0, 9.0, 9.5, 9.0, 11.0, 10.5])]
    gate = spark.createDataFrame([(1, DAY + dt.timedelta(days=1), 60.0, 5.0), (1, DAY + dt.timedelta(days=8), 60.0, 10.8), (1, DAY - dt.timedelta(days=1), 40.0, 1.0)], "symbol_id long, entry_date date, final_score double, invalidation_level double")
    got = [(r["followthrough"], r["exit_reason"], r["days_since_entry"]) for r in candidates.exit_monitoring(gate, spark.createDataFrame(rows, BARS)).orderBy("entry_date").collect()]
    assert got == [("UNKNOWN", "SCORE_BELOW_55", None), ("CONFIRMED", "NONE", 9), ("PENDING_3D", "INVALIDATION_BREACH", 2)]
