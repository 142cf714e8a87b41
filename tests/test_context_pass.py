"""Context at a date reads the bars once, and agrees with the structure of all bars at the last one."""

import datetime as dt
import random

from pyspark.sql import functions as F

from barloom.operators import scans
from barloom.plans import formations
from tests.test_shapes import BARS, DAY

SF = "/root/testdata/sf0.001"


def test_context_slides_no_frame_over_all_bars(spark):
    plan = formations.at_date(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -199" not in plan and "-251" not in plan


def test_context_has_the_structure_of_the_last_bar(spark):
    rng, rows = random.Random(8), []
    for symbol in range(30):
        c = 60.0
        for i in range(rng.choice([15, 60, 119, 121, 149, 170, 199, 219, 260, 300])):
            c *= 1 + rng.uniform(-0.03, 0.034)
            rows.append((symbol, DAY + dt.timedelta(days=i), c, c * 1.01, c * 0.99, c, rng.uniform(1, 9)))
    made = spark.createDataFrame(rows, BARS)
    known = scans.context(made, "2021-06-01")
    structure = scans.stage2_structure(made.join(known.select("symbol_id", "rel_strength_score"), "symbol_id").withColumns(formations_columns()))
    last = structure.withColumn("_k", F.row_number().over(formations.Window.partitionBy("symbol_id").orderBy(F.desc("trade_date")))).filter("_k = 1")
    names = ["symbol_id", "stage2_score", "stage2_label", "is_stage2_structural", *[F.round(c, 9).alias(c) for c in ("sma_50", "sma_150", "sma_200", "sma150_slope_20d_pct", "sma200_slope_20d_pct", "near_52w_high_pct")]]
    want, got = ([tuple(r) for r in d.select(*names).orderBy("symbol_id").collect()] for d in (last, known))
    assert got == want and {r[2] for r in got} > {"non_stage2"}


def formations_columns():
    from barloom.functions.stats import clip, full, ratio, trailing

    high, volume = full(F.max("high").over(trailing(252)), trailing(252), 20), full(F.avg("volume").over(trailing(20, skip=1)), trailing(20, skip=1), 10)
    return {"near_52w_high_pct": clip(100 * (1 - ratio(F.col("close"), high)), 0, 100), "volume_ratio_20": ratio(F.col("volume"), volume)}
