"""Every market query against its SQL, and those without SQL against plain versions."""

import datetime as dt

import pandas as pd
import pytest

from barloom.operators import indicators, market, patterns
from barloom.plans import registry
from tests.compare import close, compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF) is None


def test_comparison_sees_a_difference():
    assert close((1.0, "a", None), (1.0, "a", None)) and not close((1.0,), (1.001,)) and not close((None,), (0.0,))


BARS = "symbol_id long, trade_date date, open double, high double, low double, close double, volume double, delivery_pct double"


def series(closes, symbol=1):
    day = dt.date(2020, 1, 1)
    return [(symbol, day + dt.timedelta(days=i), c, None if c is None else c + 1, None if c is None else c - 1, c, 10.0 + i % 3, 50.0) for i, c in enumerate(closes)]


def test_recursive_average_by_hand(spark):
    closes = [10.0, 11.0, 9.0, 12.0, 15.0]
    got = [r["ema_3"] for r in indicators.recursive_ema(spark.createDataFrame(series(closes), BARS), 3).orderBy("trade_date").collect()]
    want = [closes[0]]
    for c in closes[1:]:
        want.append(0.5 * c + 0.5 * want[-1])
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_supertrend_flips(spark):
    closes = [100.0 + i for i in range(30)] + [130.0 - 8 * i for i in range(10)] + [50.0 + 8 * i for i in range(12)]
    trend = [r["trend"] for r in indicators.stateful_supertrend(spark.createDataFrame(series(closes), BARS), 5, 2.0).orderBy("trade_date").collect()]
    assert trend[20] == 1 and -1 in trend[30:40] and trend[-1] == 1


def test_hysteresis_needs_the_margin(spark):
    days = pd.date_range("2020-01-01", periods=5).date
    rows = spark.createDataFrame([(d, s) for d, s in zip(days, [50.0, 61.0, 63.5, 59.0, 56.0])], "trade_date date, score double")
    got = [r["held_label"] for r in market.regime_with_hysteresis(rows).orderBy("trade_date").collect()]
    assert got == ["cautious_bull", "cautious_bull", "bull", "bull", "cautious_bull"]


AWKWARD = series([5.0, None, 0.0, 0.0, 7.0]) + series([3.0], 2) + series([4.0] * 30, 3)
OPERATORS = [indicators.rsi, indicators.atr, indicators.adx, indicators.bollinger, indicators.volume_zscore, indicators.custom, indicators.volume_lines, indicators.stage2, indicators.preconditions, indicators.one_step_macd, market.weekly, market.breakouts, market.accumulation]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_awkward_frames_and_no_look_ahead(spark, operator):
    rows = spark.createDataFrame(AWKWARD, BARS)
    assert operator(rows.limit(0)).count() == 0
    out = operator(rows)
    key = "week_end" if "week_end" in out.columns else "trade_date"
    before = [tuple(r) for r in out.filter(f"{key} <= '2020-01-10'").orderBy("symbol_id", key).select(sorted(out.columns)).collect()]
    if key == "trade_date" and operator is not market.accumulation:
        past = operator(rows.filter("trade_date <= '2020-01-10'"))
        assert [tuple(r) for r in past.orderBy("symbol_id", key).select(sorted(out.columns)).collect()] == before


@pytest.mark.parametrize("inside", [0, 1, 2, 3])
def test_inside_runs_know_the_real_mother(spark, inside):
    day = dt.date(2020, 1, 1)
    ends = [(100.0 + i, 90.0 + i) for i in range(25)] + [(200.0 - 10 * i, 20.0 + 10 * i) for i in range(inside + 1)]
    bars = [(day + dt.timedelta(days=i), h, low, (h + low) / 2, 10.0 + i % 3) for i, (h, low) in enumerate(ends)]

    def found(close, volume):
        rows = bars + [(day + dt.timedelta(days=len(bars)), close + 5, 60.0, close, volume)]
        made = spark.createDataFrame([(1, d, c, h, low, c, v, 50.0) for d, h, low, c, v in rows], BARS)
        return [(r["inside_bars"], r["mother_high"], r["mother_low"]) for r in patterns.inside_run_breaks(made).collect()]

    # above the last inside bar alone is not above the mother
    assert found(199.0, 100.0) == []
    assert found(201.0, 100.0) == ([(inside, 200.0, 20.0)] if inside else [])
    assert found(201.0, 12.0) == []
