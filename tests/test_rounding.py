"""Values at the edge of rounding and of a limit, as SQL has them."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from barloom.functions.stats import nearest
from barloom.operators import indicators

DAY = dt.date(2020, 1, 1)


def test_rounding_is_that_of_sql(spark):
    edges = [262.0771875, 1067.7384375, 1401.4011115, 2070.3571875, 0.0, -262.0771875, 1e-7, -4e-7, 5e-7, 1e300, 123456789.1234565, 4503599627.370496, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(edges)], "i int, v double").orderBy("i").select(nearest(F.col("v"))).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in edges]
    assert got[0] == 262.077187


#: Twenty volumes with mean 28 and deviation 11, and one three deviations above.
FRAME = [22.0, 36.0, 24.0, 37.0, 35.0, 26.0, 47.0, 11.0, 39.0, 20.0, 22.0, 41.0, 26.0, 10.0, 30.0, 40.0, 33.0, 6.0, 36.0, 19.0, 61.0]


def test_three_deviations_are_three(spark):
    rows = [(s, DAY + dt.timedelta(days=i), v) for s, f in enumerate([FRAME, [*sorted(FRAME[:20]), 61.0], [v + 0.5 for v in FRAME]]) for i, v in enumerate(f)]
    got = [r["vol_z20"] for r in indicators.volume_zscore(spark.createDataFrame(rows, "symbol_id long, trade_date date, volume double"), 20).filter("vol_z20 is not null").orderBy("symbol_id").collect()]
    assert got[:2] == [3.0, 3.0] and abs(got[2] - 3) < 1e-12
