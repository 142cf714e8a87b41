import random
import re

import pytest

from barloom.llm import jaccard
from tests.llm.texts import SCHEMA, awkward

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def by_hand(rows):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows))


def near_copies(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows, k = [], 1000
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(t))
                t[p : p + rng.randint(0, 1)] = [rng.choice(vocab)]
            rows.append((k, " ".join(t).upper() if rng.random() < 0.3 else "\n".join(t), "en", "a", 1))
            k += 1
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):  # each text is near the next, the first and the last are far apart
        rows.append((k, " ".join(chain[step * 2 : step * 2 + 60]), "en", "a", 1))
        k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent", [24, 2])
def test_components_against_all_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = near_copies(frequent) + awkward()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in jaccard.join_documents(docs).collect())
    assert got == by_hand(rows)


def test_ranking_by_join_is_the_same(spark):
    docs = spark.createDataFrame(near_copies(9) + awkward(), SCHEMA).repartition(3)
    counted, shift = jaccard.frequent_shingles(docs, 6000)
    counted = counted.cache()

    def found(rank):
        rows = rank(docs, counted, shift).collect()
        return {(r["doc_id"], r["text_hash"], r["n"], r["node"]) for r in rows}, {(r["node"], tuple(r["prefix"])) for r in rows if r["prefix"]}

    assert found(jaccard._ranked_in_tasks) == found(jaccard._ranked_by_join)


def test_both_ways_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    rows = near_copies(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in jaccard.join_documents(docs).collect()) == by_hand(rows)


def spread(n, seed):
    """A large group of near copies of one text, each changed in a few places, so that many pairs fall just short."""
    rng = random.Random(seed)
    base = [f"b{rng.randint(0, 300)}" for _ in range(110)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5])):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 60)}"
        rows.append((i, " ".join(t), "en", "a", 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_one_large_group_of_near_copies(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    rows = spread(150, seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in jaccard.join_documents(docs).collect()) == by_hand(rows)


def test_extra_columns_with_clashing_names_stay(spark):
    rows = [(*r, i, "n") for i, r in enumerate(near_copies(5))]
    docs = spark.createDataFrame(rows, SCHEMA + ", node int, component_id string").withColumnsRenamed({"n_chars": "_doc", "lang": "_hash"})
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in by_hand(rows) if i == c}
    assert jaccard.join_documents(docs).columns == ["doc_id", "n_shingles", "component_id"]


def test_one_of_each_group_stays(spark):
    rows = near_copies(4) + awkward()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in jaccard.keep_first(docs).collect()}
    assert kept == {i for i, _, c in by_hand(rows) if i == c}
    assert jaccard.join_documents(docs.limit(0)).count() == 0 and jaccard.keep_first(docs).columns == docs.columns


def chain(name, start):
    return " ".join(f"{name}{i}" for i in range(start, start + 60))


def test_null_ids_and_ids_of_two_texts_keep_their_links(spark):
    rows = [
        (10, chain("a", 0)), (None, chain("a", 4)), (20, chain("a", 8)),  # 10 and 20 meet only over the null id
        (30, chain("b", 0)), (None, chain("b", 3)),  # a near copy without an id
        (40, chain("c", 0)), (40, chain("d", 0)), (41, chain("c", 3)), (42, chain("d", 3)),  # one id, two texts
        (50, chain("e", 0)), (50, chain("e", 20)), (51, chain("f", 0)),  # no links
        (None, chain("g", 0)), (None, chain("g", 2)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = sorted(key((r["doc_id"], r["component_id"])) for r in jaccard.join_documents(docs).collect())
    want = [(10, 10), (None, 10), (20, 10), (30, 30), (None, 30), (40, 40), (40, 40), (41, 40), (42, 40), (50, 50), (50, 50), (51, 51), (None, None), (None, None)]
    assert got == sorted(map(key, want))
