import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from barloom.llm import resampling
from tests.llm.texts import SCHEMA, awkward, crowd


def features(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def by_hand(docs, target, percent=5):
    bucket = lambda f: crc32(f.encode()) % 10_000
    made = [(d, *features(t)) for d, t in docs]
    raw = Counter(bucket(f) for _, _, fs in made for f in fs)
    goal = Counter(bucket(f) for t in target for f in features(t)[1])
    s_all, t_all = raw.total(), goal.total()
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10_000) / ((raw[b] + 1) * (t_all + 10_000))))
    rows = []
    for d, n, fs in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append((d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    drawn = able[: percent * len(able) // 100]
    rest = Counter(rows) - Counter(drawn)
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in rest.elements()], key=str)


@pytest.mark.parametrize("percent,piece,half", [(5, 1 << 20, 0.002), (30, 40, 0.0), (100, 1 << 20, 0.002)])
def test_against_plain_version(spark, monkeypatch, percent, piece, half):
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling, "BRACKET", half or 1e-9)  # the second case has to widen it
    rows = awkward() + crowd(200) + [(None, " ".join(["Same", "words"] * 15), "en", "a", 1)] * 2 + [(7_000 + i, "one two three " * 9, "en", "b", 1) for i in range(30)]
    target = [t for _, t, *_ in crowd(20, seed=8)] + ["one two", None, ""]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("mine"), "_row": F.lit(0), "weight": F.lit(None).cast("int")}).repartition(3)
    goal = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, item_id long")
    got = sorted((tuple(r) for r in resampling.resample(docs, goal, percent).collect()), key=str)
    assert got == by_hand([(r[0], r[1]) for r in rows], target, percent)


def test_empty_tables_and_no_target(spark):
    docs, none = spark.createDataFrame(crowd(50), SCHEMA), spark.createDataFrame([], "text string, item_id long")
    assert resampling.resample(docs.limit(0), none).count() == 0
    got = sorted((tuple(r) for r in resampling.resample(docs, none, 20).collect()), key=str)
    assert got == by_hand([(r[0], r[1]) for r in crowd(50)], [], 20)


def test_ties_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("score"), F.col("id").alias("doc_id"))
    placed = resampling.in_order(rows, [F.col("score").desc(), F.col("doc_id")], "k").collect()
    assert [(r["score"], r["doc_id"]) for r in sorted(placed, key=lambda r: r["k"])] == sorted(((i % 3, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
    assert sorted(r["k"] for r in placed) == list(range(1, 5001))


def test_bracket_counts_are_exact(spark):
    scores = spark.range(20_000).select((F.col("id") % 700).alias("score"))
    for wanted in (1, 30, 9_999, 20_000):
        low, high, above = resampling.bracket(scores, wanted, 20_000)
        assert above == scores.filter(F.col("score") > high).count() < wanted <= scores.filter(F.col("score") >= low).count()
