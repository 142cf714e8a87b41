import hashlib
import random

import pytest

from barloom.llm import suffixes
from tests.llm.texts import SCHEMA, awkward


def by_hand(rows, width=100):
    first = {}
    for doc_id, text, *_ in sorted({r[:2] for r in rows if r[0] is not None}, key=lambda r: r[0]):
        raw = (text or "").encode()
        for s in range(len(raw) - width + 1):
            first.setdefault(raw[s : s + width], (doc_id, s))
    out = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            if doc_id is not None and first[raw[s : s + width]] < (doc_id, s):
                gone[s : s + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta", "epsilon", "zêta", "eta", "theta", "iota", "kappa"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    shared = [text(rng.randint(5, 60)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 40)) for _ in range(3)]
        for p in rng.sample(shared, 2):
            a = rng.randint(0, len(p) // 2)
            parts.insert(rng.randint(0, 3), p[a : a + rng.randint(60, 60 + len(p))])
        rows.append((rng.randint(10, 10**12) if i else 5, "\n".join(parts), "en", "a", 1))
    rows += [(2000 + i, "ab" * rng.randint(40, 200), "en", "a", 1) for i in range(3)] + [(3000, rows[0][1], "en", "a", 1), (3001, "x" * 99, "en", "a", 1), (3002, "x" * 99, "en", "a", 1), (3003, "To " * 300, "en", "a", 1)]
    rows += [rows[7], rows[7], rows[20]]  # rows that come again
    return rows


@pytest.mark.parametrize("seed,segment,limit", [(1, 1 << 19, 32 << 20), (2, 150, 0)])
def test_against_all_windows(spark, monkeypatch, seed, segment, limit):
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    monkeypatch.setattr(suffixes, "BROADCAST_BYTES", limit)
    rows = passages(seed) + awkward()[:6] + awkward()[7:] + [(None, "y" * 300, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r)[:5] for r in suffixes.remove_repeats(docs).collect()), key=str)
    assert got == by_hand(rows)


def test_empty_and_long(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
    long = suffixes.remove_repeats(docs.filter("doc_id = 6")).first()
    assert long["n_removed"] > 0 and long["n_bytes"] == len(awkward()[6][1])
