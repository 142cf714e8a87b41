"""Chart shapes, scans and the life of signals on planted series and against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.shared import numbered
from barloom.operators import scans, shapes

DAY = dt.date(2020, 1, 1)
BARS = "symbol_id long, trade_date date, open double, high double, low double, close double, volume double"


def ramp(*legs):
    """Straight lines: a start, then (end, bars)."""
    out = [float(legs[0])]
    for end, n in legs[1:]:
        start = out[-1]
        out += [start + (end - start) * (i + 1) / n for i in range(n)]
    return out


def bars(spark, closes, loud=(), symbol=1, width=0.5):
    rows = [(symbol, DAY + dt.timedelta(days=i), c, c + width, c - width, c, 1000.0 if i in loud else 10.0 + i % 3) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def brute_prominences(v):
    out = []
    for k in range(1, len(v) - 1):
        a = k
        while a > 0 and v[a - 1] == v[k]:
            a -= 1
        b = k
        while b < len(v) - 1 and v[b + 1] == v[k]:
            b += 1
        if a == 0 or b == len(v) - 1 or v[a - 1] > v[k] or v[b + 1] > v[k] or k != (a + b) // 2:
            continue
        left = next((i for i in range(k, -1, -1) if v[i] > v[k]), -1)
        right = next((i for i in range(k, len(v)) if v[i] > v[k]), len(v))
        out.append((k, v[k] - max(min(v[left + 1 : k + 1]), min(v[k:right]))))
    return out


def test_prominences_by_definition():
    rng = random.Random(2)
    for _ in range(300):
        v = [float(rng.randint(0, 9)) for _ in range(rng.randint(0, 40))]
        assert shapes.prominences(v) == brute_prominences(v)


CUP = ramp(100, (100, 60), (150, 40), (115, 30), (150, 30), (143, 8), (151, 4), (165, 12))


def test_cup_with_handle(spark):
    at = next(i for i, c in enumerate(CUP) if i > 168 and c > 150.5)
    got = shapes.shapes(bars(spark, CUP, loud={at}), "cup_handle").collect()
    assert [(r["family"], r["state"], r["signal_date"]) for r in got] == [("cup_handle", "confirmed", DAY + dt.timedelta(days=at))]
    one = got[0]
    assert abs(one["level"] - 150.5) < 1e-9 and 15 <= one["depth_pct"] <= 35 and 0 < one["handle_pct"] <= 12 and abs(one["symmetry"] - 1) < 0.2
    # without volume there is no breakout; a shallow cup is none; neither is one of fewer than 120 bars
    assert shapes.shapes(bars(spark, CUP), "cup_handle").count() == 0
    assert shapes.shapes(bars(spark, ramp(100, (100, 60), (150, 40), (140, 30), (150, 30), (143, 8), (151, 4), (165, 12)), loud={at}), "cup_handle").count() == 0
    assert shapes.shapes(bars(spark, CUP[90:], loud={at - 90}), "cup_handle").count() == 0


def test_watched_cup_is_near_its_rim(spark):
    series = ramp(100, (100, 60), (150, 40), (115, 30), (150, 30), (142, 5), (147.5, 6))
    got = shapes.shapes(bars(spark, series), "cup_handle", latest=True).collect()
    assert [r["state"] for r in got] == ["watchlist"]
    assert shapes.shapes(bars(spark, ramp(100, (100, 60), (150, 40), (115, 30), (150, 30), (142, 5), (145, 6))), "cup_handle", latest=True).count() == 0


def test_round_and_double_bottom(spark):
    round_ = ramp(100, (100, 70), (150, 40), (112, 20), (113, 6), (150, 30), (152, 3), (165, 10))
    at = next(i for i, c in enumerate(round_) if i > 150 and c > 150.5)
    assert {r["state"] for r in shapes.shapes(bars(spark, round_, loud={at}), "round_bottom").collect()} == {"confirmed"}
    double = ramp(100, (100, 100), (150, 15), (120, 10), (140, 12), (121, 12), (143, 12), (150, 6))
    at = next(i for i, c in enumerate(double) if i > 150 and c > 142)
    got = shapes.shapes(bars(spark, double, loud={at}), "double_bottom").collect()
    assert [r["state"] for r in got] == ["confirmed"] and got[0]["similarity_pct"] < 4
    uneven = ramp(100, (100, 100), (150, 15), (120, 10), (140, 12), (130, 12), (143, 12), (150, 6))
    assert shapes.shapes(bars(spark, uneven, loud={at}), "double_bottom").count() == 0


def test_flags(spark):
    pole = ramp(100, (100, 119), (200, 20), (195, 6), (205, 3))
    got = {r["family"] for r in shapes.shapes(bars(spark, pole, loud={148}), "flag", "high_tight_flag").collect()}
    assert got == {"flag", "high_tight_flag"}
    deep = ramp(100, (100, 119), (140, 20), (118, 6), (145, 3))
    assert shapes.shapes(bars(spark, deep, loud={148}), "high_tight_flag").count() == 0


def test_triangles_by_points_that_stand_out(spark):
    # what counts is the height over the neighbours alone
    rows = bars(spark, ramp(100, (100, 100), (150, 12), (125, 8), (136, 6), (136.2, 3), (131, 6), (150, 8), (147, 3), (155, 4)))
    counts = [[(r["at"], r["kind"]) for r in shapes.prominent_points(rows, share, beside=True).orderBy("at").collect()] for share in (0.0003, 0.001)]
    assert counts == [[(113, "peak"), (121, "trough"), (129, "peak"), (133, "trough")], [(113, "peak"), (121, "trough")]]
    lines = shapes.triangle_lines(spark.createDataFrame([(1, "symmetrical_triangle", 10, 40)], "symbol_id long, family string, start_at int, end_at int"), spark.createDataFrame([(1, 10, "peak", 50.0), (1, 40, "peak", 44.0), (1, 15, "trough", 30.0), (1, 25, "trough", 33.0), (1, 35, "trough", 33.0), (2, 20, "peak", 1.0)], "symbol_id long, at int, kind string, value double")).first()
    up, low = np.polyfit([0, 30], [50, 44], 1), np.polyfit([5, 15, 25], [30, 33, 33], 1)
    assert np.allclose([lines["upper_slope"], lines["upper_start"], lines["lower_slope"], lines["lower_start"]], [*up, *low])
    assert abs(lines["apex_at"] - (10 + (up[1] - low[1]) / (low[0] - up[0]))) < 1e-9 and (lines["upper_touches"], lines["lower_touches"]) == (2, 3)


def test_broken_top(spark):
    top = ramp(100, (130, 20), (118, 10), (145, 12), (119, 12), (131, 10), (105, 14))
    got = shapes.broken_tops(bars(spark, top)).first()
    assert got["left"] < got["t1"] < got["head"] < got["t2"] < got["right"] and 115 < got["neckline"] < 125
    assert shapes.broken_tops(bars(spark, top[:-10])).count() == 0  # not broken yet
    assert shapes.broken_tops(bars(spark, ramp(100, (130, 20), (118, 10), (131, 12), (119, 12), (131, 10), (105, 14)))).count() == 0  # no head
    assert shapes.broken_tops(bars(spark, ramp(100, (130, 20), (118, 10), (150, 12), (119, 12), (140, 10), (105, 14)))).count() == 0  # uneven shoulders
    scanned = scans.scan(bars(spark, top)).collect()
    assert [(r["family"], r["direction"]) for r in scanned] == [("head_shoulders", "bearish")]


def boxes_by_hand(rows, spans, ends, depth, touches, inside, loud):
    """(start, end, hit) as the shortest range of each end that breaks out anew."""
    n, out = len(rows), []
    for end in ends:
        for span in range(spans[0], min(spans[1], end + 1) + 1):
            part = rows[end - span + 1 : end + 1]
            top, low = max(h for h, _, _ in part), min(x for _, x, _ in part)
            if 1 - low / top > depth or (touches and (sum(h >= top * 0.98 for h, _, _ in part) < 2 or max(c for *_, c in part) > top * 1.02)):
                continue
            hit = next((i for i in range(end + 1, min(n - 1, end + 15) + 1) if rows[i][2] > top and i in loud), None)
            if hit is None or hit in {h for *_, h in out}:
                continue
            out.append((end - span + 1, end, hit))
            break
    return out


def test_boxes_against_plain_loops(spark):
    rng = random.Random(4)
    closes = [100.0]
    for _ in range(139):
        closes.append(closes[-1] * (1 + rng.uniform(-0.02, 0.021)))
    rows = [(c * 1.01, c * 0.99, c) for c in closes]
    loud = set(range(90, 140, 7)) | {118, 119, 125, 131, 138}
    made = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), c, h, x, c, 5000.0 if i in loud else 10.0 + i % 3) for i, (h, x, c) in enumerate(rows)], BARS)
    found = shapes.series(made).first()
    sure = {i for i in range(140) if found["spike"][i] and (found["volume_ratio"][i] or 0) >= 1.5}
    for family, spans, ends, depth, touches in (("darvas_box", (15, 60), range(max(15, 140 - 75 + 15), 139), 0.20, True), ("ipo_base", (15, 65), range(15, 139), 0.30, False)):
        got = sorted((r["start_at"], r["end_at"], r["signal_at"]) for r in shapes.shapes(made, family).collect())
        assert got == sorted(boxes_by_hand(rows, spans, ends, depth, touches, True, sure)) and got, family
    assert shapes.shapes(made.limit(30), "ipo_base").count() == 0


AWKWARD = [(1, DAY, None, None, None, None, None), (2, DAY, 1.0, 1.0, 1.0, 1.0, 0.0), (2, DAY, 1.0, 1.0, 1.0, 1.0, 0.0)] + [(3, DAY + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 7.0) for i in range(130)] + [(4, DAY + dt.timedelta(days=i), None, 6.0, None, None if i % 3 else 4.0 + i % 7, None) for i in range(130)]


def test_awkward_bars(spark):
    rows = spark.createDataFrame(AWKWARD, BARS).withColumn("level", F.lit("mine"))
    assert shapes.shapes(rows).count() == 0 and shapes.broken_tops(rows).count() == 0
    assert shapes.shapes(rows.limit(0)).count() == 0 and scans.signal_scores(scans.scan(rows.limit(0))).count() == 0
    known = {r["symbol_id"]: r for r in scans.lanes(scans.context(rows, "2020-06-01")).collect()}
    assert set(known) == {1, 2, 3, 4} and known[1]["lane"] == "no_lane" and known[2]["bar_count"] == 2
    assert scans.context(rows, "2019-01-01").count() == 0


def test_context_does_not_look_ahead(spark):
    rng = random.Random(1)
    rows = [(s, DAY + dt.timedelta(days=i), 50.0, 60.0, 40.0, rng.uniform(40, 60), rng.uniform(1, 9)) for s in range(4) for i in range(260) if rng.random() < 0.9]
    made, as_of = spark.createDataFrame(rows, BARS), "2020-08-01"
    whole, past = (sorted(map(str, scans.context(b, as_of).collect())) for b in (made, made.filter(F.col("trade_date") <= as_of)))
    assert whole == past
    sessions = {d for _, d, *_ in rows if str(d) <= as_of}
    for r in scans.context(made, as_of).collect():
        own = {d for s, d, *_ in rows if s == r["symbol_id"] and str(d) <= as_of}
        assert abs(r["continuity_ratio"] - len(own) / sum(d >= min(own) for d in sessions)) < 1e-12


def test_lane_ladder(spark):
    def lane(n, early, standard, two, fresh, stage, turn, base):
        if n < 35:
            return "no_lane"
        if n < 50:
            return "ipo_early_base" if early else "no_lane"
        if not standard:
            return "no_lane"
        if n < 180:
            return "young_listing_base"
        if two:
            return "stage2_continuation"
        return "stage1_base" if fresh and base and (stage == "S1" or turn == "S1_TO_S2") else "no_lane"

    rng = random.Random(3)
    rows = [(rng.choice([10, 34, 35, 49, 50, 119, 120, 179, 180, 400]), *[rng.random() < 0.6 for _ in range(3)], rng.choice([60.0, 70.0]), rng.random() < 0.7, rng.choice(["S1", "S2", None]), rng.choice(["S1_TO_S2", "NONE"]), rng.random() < 0.7) for _ in range(300)]
    made = spark.createDataFrame(rows, "bar_count long, early_gate boolean, standard_gate boolean, stage2_valid boolean, stage2_score double, weekly_fresh boolean, weekly_stage string, weekly_stage_transition string, base_structure boolean")
    for r in scans.lanes(made).collect():
        assert r["lane"] == lane(r["bar_count"], r["early_gate"], r["standard_gate"], r["stage2_valid"] and r["stage2_score"] >= 70, r["weekly_fresh"], r["weekly_stage"], r["weekly_stage_transition"], r["base_structure"])
        assert r["lane_reasons"]


def test_business_bars(spark):
    days = [DAY + dt.timedelta(days=k) for k in range(-5, 40, 3)]
    rows = spark.createDataFrame([(a, b) for a in days for b in days], "a date, b date")
    for r in rows.select("a", "b", scans.business_bars(F.col("a"), F.col("b")).alias("n")).collect():
        want = 0 if r["b"] <= r["a"] else max(0, int(np.busday_count(r["a"], r["b"] + dt.timedelta(days=1))) - 1)
        assert r["n"] == want


def fold(previous, fresh, closes, day):
    """One run, key by key."""
    out, best = {}, {}
    for r in sorted(fresh, key=lambda r: (-r["pattern_score"], -r["signal_date"].toordinal(), r["state"])):
        best.setdefault((r["symbol_id"], r["family"]), r)
    for k, r in best.items():
        out[k] = dict(state=r["state"], lifecycle=r["state"], first=previous[k]["first"] if k in previous else r["signal_date"], seen=day, dead=None, gone=None, carried=0, stop=r["invalidation"])
    bars_between = lambda a: 0 if day <= a else int(np.busday_count(a, day + dt.timedelta(days=1))) - 1
    for k, p in previous.items():
        if k in out or p["lifecycle"] == "expired":
            continue
        q = dict(p, carried=p["carried"] + 1)
        close = closes.get(k[0])
        if p["lifecycle"] != "invalidated" and close is not None and close <= p["stop"]:
            q.update(lifecycle="invalidated", dead=p["dead"] or day)
        elif bars_between(p["dead"] if p["lifecycle"] == "invalidated" else p["seen"]) >= {"watchlist": 10, "confirmed": 20, "invalidated": 5}[p["lifecycle"]]:
            q.update(lifecycle="expired", gone=day)
        out[k] = q
    return out


def test_life_of_signals_is_a_fold_and_a_day_can_be_run_again(spark):
    rng = random.Random(6)
    history = spark.createDataFrame([], "symbol_id long, family string, state string, signal_date date, level double, invalidation double, pattern_score double, lifecycle string, as_of_date date, first_seen_date date, last_seen_date date, invalidated_date date, expired_date date, carried_bars int")
    previous, seen = {}, set()
    day = DAY
    for n in (6, 0, 6, 0, 2, 0):
        day += dt.timedelta(days=rng.choice([1, 6, 15]))
        fresh = [dict(symbol_id=rng.randint(1, 8), family=rng.choice("ab"), state=rng.choice(["watchlist", "confirmed"]), signal_date=day - dt.timedelta(days=rng.randint(0, 3)), level=9.0, invalidation=5.0, pattern_score=float(rng.randint(1, 3))) for _ in range(n)]
        closes = {s: rng.choice([4.0, 5.0, 7.0, 8.0]) for s in range(1, 9) if s != 3}
        frames = (spark.createDataFrame(fresh, "symbol_id long, family string, state string, signal_date date, level double, invalidation double, pattern_score double"), spark.createDataFrame(list(closes.items()), "symbol_id long, close double"))
        history = spark.createDataFrame(scans.advance(history, *frames, str(day)).collect(), history.schema)
        previous = fold(previous, fresh, closes, day)
        now = {(r["symbol_id"], r["family"]): dict(state=r["state"], lifecycle=r["lifecycle"], first=r["first_seen_date"], seen=r["last_seen_date"], dead=r["invalidated_date"], gone=r["expired_date"], carried=r["carried_bars"], stop=r["invalidation"]) for r in history.filter(F.col("as_of_date") == str(day)).collect()}
        assert now == previous
        assert sorted(map(str, scans.advance(history, *frames, str(day)).collect())) == sorted(map(str, history.collect()))
        seen |= {v["lifecycle"] for v in now.values()}
    assert seen == {"watchlist", "confirmed", "invalidated", "expired"}


def test_scores_by_hand(spark):
    rows = spark.createDataFrame([(1, "cup_handle", "confirmed", DAY, 80.0, 2.0, True, 6.0, 2.5, 90.0, 75.0, 90.0), (2, "flag", "watchlist", DAY, 60.0, 1.0, False, None, 0.0, None, None, None), (3, "head_shoulders", "confirmed", DAY, 50.0, None, False, None, None, None, None, None)], "symbol_id long, family string, state string, signal_date date, quality double, volume_ratio double, dry boolean, handle_pct double, vol_z20 double, rel_strength_score double, sector_rs_percentile double, stage2_score double")
    got = {r["symbol_id"]: r for r in scans.signal_scores(rows).collect()}
    # 40 + 20 + 15 + 10 + 10 + 10 + 15, held at 100; 35 + 22 + 14 + 10 + 6 + 10 + 9.6 + 8, held at 100
    assert (got[1]["pattern_score"], got[1]["priority_score"], got[1]["tier"], got[1]["pattern_rank"], got[1]["priority_rank"]) == (100.0, 100.0, "tier_1", 1, 1)
    assert (got[2]["pattern_score"], round(got[2]["priority_score"], 9), got[2]["tier"]) == (20.0, 7.0 + 12 + 7.2, "tier_2")
    assert (got[3]["pattern_score"], got[3]["priority_score"], got[3]["tier"]) == (0.0, 0.0, "suppression_only")


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbers_over_ranges(spark, n):
    rows = spark.range(n).select("id", (F.col("id") % 3).alias("k"))
    got = [(r["k"], r["id"], r["no"]) for r in numbered(rows, "no", F.desc("k"), F.col("id")).orderBy("no").collect()]
    assert got == [(k, i, j + 1) for j, (k, i) in enumerate(sorted(((i % 3, i) for i in range(n)), key=lambda x: (-x[0], x[1])))]
