"""Compression classifiers, the toxicity chain, token counts, decontamination and mixing."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import decontaminate, language, mixing, quality, tokens, toxicity
from barloom.llm.common import held_out, table
from tests.llm.texts import SCHEMA, awkward, crowd

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").filter(held_out("doc_id", 5, 0)).select("quality", "score", "predicted").toPandas()
    assert scored.score.between(0, 1).all()
    assert (scored.predicted == scored.quality).mean() > 0.9
    again = quality.score(spark.createDataFrame(awkward(), SCHEMA).withColumn("score", F.lit("mine")), model)
    assert again.count() == len(awkward()) and again.filter("score is null").count() == 0
    none = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.score(docs.limit(3), none).select("score").distinct().collect()[0][0] == 0.5


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    model = language.fit(docs)
    found = language.identify(docs, model).filter(held_out("doc_id", 4, 2)).select("lang", "lang_pred", "score").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95 and found.score.between(0, 1).all()
    odd = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame([*awkward(), (50, "12 34 !!", None, None, 1)], SCHEMA), model).collect()}
    assert odd[1] == odd[2] == odd[3] == odd[50] == "und" and odd[8] in model.langs
    assert language.identify(docs.limit(2), language.fit(docs.limit(0))).filter("lang_pred = 'und'").count() == 2


def test_every_language_is_learned_from_all_of_a_text(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows, later = [], []
    for k in range(300):
        vocab = ["".join(rng.choice(letters) for _ in range(7)) for _ in range(12)]
        text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))  # noqa: B023, E731
        # all begin alike: only what follows tells languages apart
        rows += [(10 * k + j, "licence text that begins every document " * 6 + text(300), f"l{k:03}", "a", 1) for j in range(3)]
        later.append((100_000 + k, text(60), f"l{k:03}", "a", 1))
    model = language.fit(spark.createDataFrame(rows, SCHEMA), mod=10**9)
    assert len(model.langs) == 300
    found = language.identify(spark.createDataFrame(later[:40], SCHEMA).repartition(4), model).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.9


def test_labels_that_disagree_are_left_out_in_any_order(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad stuff there ") * 40 + str(i), "en", "a", 1) for i in range(80)], SCHEMA)
    rows = [(i, i % 2, 1 - i % 2) for i in range(80)] + [(i, 1 - i % 2, i % 2) for i in range(10)] + [(20, 0, 1)] * 3
    schema = "doc_id long, quality int, toxic int"
    one, two = (spark.createDataFrame(r, schema).coalesce(1) for r in (rows, rows[::-1]))
    assert quality.fit(docs, one) == quality.fit(docs, two)
    chains = [toxicity.fit(docs, x) for x in (one, two)]
    assert chains[0].names == chains[1].names and all((a == b).all() for a, b in zip(chains[0].links, chains[1].links))


def test_columns_with_clashing_names_stay(spark):
    docs = spark.createDataFrame([(*r, "mine", "row") for r in awkward()], SCHEMA + ", _found string, row string")
    model = language.LanguageModel(("a",), (b"abc",))
    for out, new in ((language.identify(docs, model), ["lang_pred", "score", "rejected"]), (toxicity.score(docs, toxicity.Chain((), (), (), 0.1)), ["toxicity", "categories", "toxic"])):
        assert out.columns == docs.columns + new and {r["_found"] for r in out.collect()} == {"mine"}
    # columns of docs that the mix and the counts do not read may have any name
    extra = spark.createDataFrame([(*r, 1) for r in awkward()], SCHEMA + ", size int").withColumnRenamed("lang", "_chance")
    assert mixing.mix(extra).count() == tokens.count_tokens(extra, BPE).count() == len(awkward())


def test_toxicity_chain(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    chain = toxicity.fit(docs, labels)
    said = toxicity.score(docs, chain).select("doc_id", F.col("toxic").alias("said")).join(labels, "doc_id").toPandas()
    assert said[said.toxic == 0].said.mean() < 0.03 and said[said.toxic == 1].said.mean() > 0.7
    assert toxicity.score(spark.createDataFrame(awkward(), SCHEMA), chain).count() == len(awkward())
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert toxicity.clean(docs.limit(5), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 5


def test_chain_learns_categories(spark):
    rng = random.Random(1)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    rows, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            t += rng.sample(["grumble", "snarl"] if i % 8 else ["hexes", "curse"], 2)
        rows.append((i, " ".join(t), "en", "a", 1))
        labels.append((i, 0, int(i % 4 == 0)))
    chain = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(chain.links) == len(chain.categories) + 1 >= 3
    p = chain.predict(["wak grumble", "curse hexes", "wak wbl", "", None])[:, -1]
    assert min(p[:2]) > 0.5 > max(p[2:])


ALPHABET = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "'ll", "'", "r", "9", "12", "é", "ß", "中", "😀", "!!", "|", "<|endoftext|>", "<|endo", " ", "　", "\x1c", "\x85", "​", " word", "Ing", "\r\n", "́", "\x00"]


def test_token_counts_of_all_prefixes():
    own, lib, rng = tokens.PrefixCounter(BPE), Tokenizer.from_file(BPE), random.Random(3)
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for _ in range(400):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        assert own.count(text) == size(text), repr(text)
        counts = own.prefix_counts(text)
        assert [int(c) for c in counts] == [size(text[:k]) for k in range(len(text) + 1)], repr(text)
        cut = own.fitting_prefix(text, 3)
        assert size(text[:cut]) <= 3 and all(size(text[:k]) > 3 for k in range(cut + 1, len(text) + 1))
    vocab = sorted(own.vocab)
    for _ in range(3000):
        a, b = rng.choice(vocab), rng.choice(vocab)
        assert own.compatible(a, b) == (own.merged(a + b) == [a, b])


def test_token_columns(spark):
    lib = Tokenizer.from_file(BPE)
    rows = awkward() + crowd(10)
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(spark.createDataFrame(rows, SCHEMA), BPE).collect()}
    want = set()
    for r in rows:
        n = len(lib.encode(r[1] or "", add_special_tokens=False).ids)
        want.add((r[0], len((r[1] or "").encode()), n, n > 1024))
    assert got == want


def test_budgets_are_answered_from_stored_counts(spark):
    lib = Tokenizer.from_file(BPE)
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rows = [r for r in awkward() + crowd(10) if r[0] != 6] + [(50, "a<|endoftext|>b naïve 😀 text", "en", "a", 1)]
    stored = tokens.with_prefix_counts(spark.createDataFrame(rows, SCHEMA).withColumn("prefix_counts", F.lit("mine")), BPE).cache()
    whole = {r["doc_id"]: r["text"] for r in stored.collect()}
    for budget in (0, 1, 4, 7, 10_000, -3):
        for r in tokens.truncate(stored, budget).select("doc_id", "text", "prefix_counts").collect():
            text = whole[r["doc_id"]]
            if text is None:
                assert r["text"] is None
                continue
            best = max((k for k in range(len(text) + 1) if len(text) < 200 and size(text[:k]) <= max(budget, 0)), default=None) if len(text) < 200 else None
            assert r["text"] == text[: len(r["text"])] and size(r["text"]) <= max(budget, 0)
            assert best is None or len(r["text"]) == best
            assert len(r["prefix_counts"]) == len(r["text"]) + 1
    twice = {r["doc_id"]: r["text"] for r in tokens.truncate(tokens.truncate(stored, 7), 4).collect()}
    assert twice == {r["doc_id"]: r["text"] for r in tokens.truncate(stored, 4).collect()}
    for r in stored.select("doc_id", tokens.tokens_before(3).alias("n")).collect():
        assert r["n"] == size((whole[r["doc_id"]] or "")[:3])
    assert tokens.truncate(stored.limit(0), 4).count() == 0


def test_toxicity_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = held_out("doc_id", 5, 0)
    chain = toxicity.fit(docs, labels.filter(~held))
    rest = docs.join(labels.filter(held & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    rows = toxicity.score(rest.select("doc_id", "text"), chain).select("doc_id", "toxic").join(rest.select("doc_id", "label"), "doc_id").collect()
    caught, spared = [r["toxic"] for r in rows if r["label"] == 1], [r["toxic"] for r in rows if r["label"] == 0]
    assert len(caught) >= 20 and len(spared) >= 200
    assert sum(caught) / len(caught) >= 0.85 and sum(spared) / len(spared) <= 0.03


def nearest(item, text):
    """Smallest edit distance between the item and any stretch of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row, last = [i], row
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def edited(rng, v, vocab, edits):
    """Words after so many random edits: replaced, left out or put in."""
    v = list(v)
    for _ in range(edits):
        p = rng.randrange(len(v))
        v[p : p + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
    return v


def test_walks_agree_at_the_limit_as_assumed():
    rng, vocab, agree, least = random.Random(4), [f"w{i}" for i in range(300)], [], decontaminate.AGREEMENT
    for size in (10, 20, 40, 80):
        for _ in range(150):
            item = [rng.choice(vocab) for _ in range(size)]
            v = (edited(rng, item, vocab, decontaminate.edit_limit(size)) + [rng.choice(vocab) for _ in range(size)])[:size]
            a, b = (decontaminate.cgk_samples(decontaminate.coded(" ".join(x))[None, :], 300, 1)[0] for x in (item, v))
            agree.append((a == b).mean())
    assert least - 0.1 <= np.mean(agree)


@pytest.mark.parametrize("cells", [50, 1 << 18])
def test_distances_of_many_pairs_against_the_plain_table(monkeypatch, cells):
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    rng, vocab, items, texts = random.Random(6), [f"w{i}" for i in range(60)], [], []
    for k in range(360):
        size = (1, 2, 7, 8, 20, 41)[k % 6]
        items.append([rng.choice(vocab) for _ in range(size)])
        ends = [[rng.choice(vocab) for _ in range(rng.randint(0, 30))] for _ in range(2)]
        texts.append([] if k < 6 else [*ends[0], *edited(rng, items[-1], vocab, rng.randint(0, min(size, decontaminate.edit_limit(size) + 2))), *ends[1]])
    code = lambda v: decontaminate.coded(" ".join(v))
    found = decontaminate.nearest_stretches([code(v) for v in items], [code(v) for v in texts], decontaminate.MAX_EDITS)
    over = set()
    for i, t, (d, at) in zip(items, texts, found.tolist(), strict=True):
        want, limit = nearest(i, t), decontaminate.edit_limit(len(i))
        assert d == min(want, limit + 1)
        # the first stretch with that distance
        assert at == (min(n for n in range(len(t) + 1) if nearest(i, t[:n]) == want) if want <= limit else 0)
        over.add(d - limit)
    assert {-1, 0, 1} <= over
    assert decontaminate.nearest_stretches([], [], decontaminate.MAX_EDITS).shape == (0, 2)


def test_many_far_pairs_cost_little():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 60, (2000, 60)).astype(np.uint64)
    texts = [*rng.integers(0, 1 << 60, (2000, 160)).astype(np.uint64)]
    texts[7][30:90] = items[7]
    start = time.process_time()
    distance, end = decontaminate.edits_within(items, texts, 9)
    assert time.process_time() - start < 0.5
    assert distance[7] == 0 and end[7] == 90 and (distance == 10).sum() == 1999


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    sizes = [1, 2, 3, 5, 6, 7, 8, 12, 20, 40]
    items = {i: [rng.choice(vocab) if n > 1 else f"single{i}" for _ in range(n)] for i, n in enumerate(sizes * 2)}
    rows = []
    for k in range(300):
        item = items[rng.choice(list(items))]
        v = edited(rng, item, vocab, rng.randint(0, decontaminate.edit_limit(len(item)) + 1)) if k % 3 else list(item)
        t = [rng.choice(vocab) for _ in range(25)]
        t[10:10] = v
        rows.append((k, " ".join(t).upper(), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(v)) for i, v in items.items()] + [(98, None), (None, "x " * 30), (99, " .!")], "item_id long, text string")
    got = {r["doc_id"]: {x["item_id"]: x["distance"] for x in r["leaks"]} for r in decontaminate.find_leaks(docs, bench).collect()}
    wanted = {(k, i): d for k, text, *_ in rows for i, v in items.items() if (d := nearest(v, text.lower().split())) <= decontaminate.edit_limit(len(v))}
    said = {(k, i): d for k, found in got.items() for i, d in found.items()}
    assert not set(said) - set(wanted) and all(wanted[k] <= d for k, d in said.items())
    exact = {k for k, d in wanted.items() if d == 0}
    assert exact <= set(said)  # a copy is found whatever its length
    at_limit = {k for k, d in wanted.items() if 0 < d == decontaminate.edit_limit(len(items[k[1]]))}
    assert len(at_limit) > 20 and len(at_limit & set(said)) >= 0.95 * len(at_limit)
    assert len(set(said)) >= 0.98 * len(wanted)


def test_leaks_in_frames(spark):
    rows = [*awkward(), (70, "before " + " ".join(f"q{i}" for i in range(20)) + " after", "en", "a", 1), (None, "q3 q4 q5", "en", "a", 1), (71, "この文章は漏れたら困る問題です。", "ja", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([(5, " ".join(f"Q{i}" for i in range(20))), (6, None), (None, "x " * 30), (7, "q4 Q5"), (8, "漏れたら困る問題")], "item_id long, text string")
    leaks = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert leaks[70] == [5, 7] and leaks[None] == [7] and leaks[71] == [8] and not any(v for k, v in leaks.items() if k not in (70, None, 71))
    assert decontaminate.clean(docs, bench).count() == len(awkward())
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.clean(docs.limit(0), bench).columns == docs.columns
    odd = docs.withColumnsRenamed({"lang": "of_id", "source": "row"}).withColumn("leaks", F.lit("mine"))
    assert decontaminate.find_leaks(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).columns == odd.columns


def water_fill(sizes, weights, ratio=1.5, cap=2.0):
    left, target, open_ = ratio * sum(sizes.values()), {}, dict(weights)
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > cap * sizes[s]]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix(spark):
    rows = awkward() + crowd(300)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mix(docs, block=20).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("source", dropna=False)["size"].sum().to_dict()
    sizes = {None if k != k or k is None else k: v for k, v in sizes.items()}
    order = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    want = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    for source in order:
        part = got[got.source.isna()] if source is None else got[got.source == source]
        assert abs(part.target.iloc[0] - want[source]) < 1e-6 * max(1, want[source])
        # documents are whole: one of nearly a source's size leaves no mix that is nearer than half of it
        assert abs(part.taken.sum() - part.target.iloc[0]) <= max(0.02 * part.target.iloc[0] + 2, part["size"].max() / 2)
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.mix(docs, block=20).toPandas()
    order_by = ["doc_id", "size", "source", "taken"]
    assert got.sort_values(order_by).taken.tolist() == again.sort_values(order_by).taken.tolist()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_misses_a_target_only_by_a_document_of_half_the_source(spark):
    docs = spark.createDataFrame(awkward() + crowd(300), SCHEMA).repartition(3)
    got = mixing.mix(docs, block=20).toPandas()
    for _, part in got.groupby("source", dropna=False):
        target, total, large = part.target.iloc[0], part["size"].sum(), part["size"].max()
        low = int(target / total + 1e-9)
        # the largest document is taken low or low + 1 times, the others keep their share as their chances say
        rest = target / total * (total - large)
        nearest = min(abs(t * large + rest - target) for t in (low, low + 1))
        nearest = nearest if large > 0.5 * total else 0
        assert abs(part.taken.sum() - target) <= nearest + 0.02 * target + 2


def test_mix_spreads_rows_of_one_id(spark):
    rows = [(None if i % 2 else 7, f"text {i} " + "word " * (i % 9), "en", "a", 1) for i in range(400)] + [(8, "the same", "en", "a", 1)] * 200 + crowd(50)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3), block=20).toPandas()
    assert len(got) == len(rows)
    for _, part in got[got.source == "a"].groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 0.02 * part.target.iloc[0] + 2


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size = np.floor(rng.lognormal(4, 1, 500)) + 1
    chance = rng.uniform(0, 1, 500)
    out = mixing.flight(size, chance, 7)
    assert abs((out * size).sum() - (chance * size).sum()) < 1e-6 * size.sum() and abs(out.sum() - chance.sum()) < 1e-6
    assert ((out > 0) & (out < 1)).sum() <= 2
