import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from barloom.llm import spelling
from tests.llm.texts import SCHEMA, awkward, crowd


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def by_hand(docs):
    total = Counter()
    for d, text in docs:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    n = {w: k for w, k in total.items() if len(w) >= 6 and k >= 5}
    others = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(others[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return sorted(rows)


def texts(seed):
    rng = random.Random(seed)
    letters = "abcdeé×ÿ"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabc"]
    words = []
    for k, base in enumerate(bases):
        words += [base] * rng.choice([1, 5, 30, 200])
        for _ in range(12):
            at, how = rng.randrange(len(base)), rng.randrange(3)
            changed = base[:at] + (rng.choice(letters) if how else "") + base[at + (how != 1) :]
            words += [changed.upper() if k % 5 == 0 and changed.isascii() else changed] * rng.choice([1, 4, 5, 6, 25])
    words += ["chainaa"] * 5 + ["chainab"] * 30 + ["chainbb"] * 170
    rng.shuffle(words)
    return [(10 * i, rng.choice([" ", "-", "_", "\n"]).join(words[i : i + 40]), "en", "a", 1) for i in range(0, len(words), 40)]


@pytest.mark.parametrize("seed,held,piece", [(1, 200_000, 1 << 20), (2, 3, 50), (3, 200_000, 1 << 20)])
def test_against_all_pairs(spark, monkeypatch, seed, held, piece):
    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(spelling, "PIECE", piece)
    rows = texts(seed) + awkward() + crowd(40) + [(None, "nameless " * 7, "en", None, 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("mine"), "n": F.lit(None).cast("int"), "root": F.lit(1)}).repartition(3)
    got = sorted(tuple(r) for r in spelling.variants(docs).collect())
    expected = by_hand([(r[0], r[1]) for r in rows])
    assert got == expected
    assert any(r[1] and r[2] != r[1] for r in expected)  # a form of a form


def test_letters_are_lost_where_the_hash_says(spark):
    rows = [(i, "curious wandering", "en", "a", 1) for i in range(2500)]
    got = {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = Counter()
    for i, *_ in rows:
        for run in ("curious", "wandering"):
            h = crc32(f"{i}:{run}".encode())
            expected[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    assert len(got) > 4 and got == dict(expected)


def test_chain_and_empty(spark):
    words = [f"{'b' * k}{'a' * (40 - k)}" for k in range(9)]
    forms = spark.createDataFrame(list(zip(words, words[1:])), "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, words[-1]) for w in words[:-1]}
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame(awkward()[:3], SCHEMA)).count() == 0
