import hashlib
import random
import re
from collections import Counter

from barloom.llm import pii, rules
from barloom.llm.queries import op8_pii
from tests.llm.texts import SCHEMA, awkward, crowd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_base_rules(spark):
    rows = awkward() + crowd()
    rows += [(900, "a b c d e f g h i " * 3 + "tail", "en", "a", 1), (901, " ".join("abcdefgh") + " " + " ".join("abcdefgh"), "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(100, 1, 0), (101, 0, 0), (102, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rules.judge(docs, labels).collect()
    key = lambda r: (r[0], *r[1:7])
    assert sorted(key((r["doc_id"], *[r[c] for c in rules.BASE])) for r in got) == sorted(key((r[0], *base_by_hand(r[1]))) for r in rows)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert all(r["kept"] == (r["llr"] >= rules.THRESHOLD) for r in got if not r["base_failed"])


def test_ratio_tells_target_from_raw(spark):
    good = [(i, "alpha beta gamma delta " * 3 + f"word{i} " + "fine tidy text " * 4, "en", "a", 1) for i in range(30)]
    junk = [(100 + i, " ".join(f"x{(i * 7 + j) % 50}###" for j in range(25)), "en", "a", 1) for i in range(30)]
    docs = spark.createDataFrame(good + junk, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    llr = {r["doc_id"]: r["llr"] for r in rules.judge(docs, labels).collect()}
    assert min(llr[i] for i in range(30)) > max(llr[100 + i] for i in range(30))
    assert rules.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_without_a_target_the_base_rules_decide(spark):
    docs = spark.createDataFrame(awkward() + crowd(30), SCHEMA)
    for rows in ([], [(100, 0, 0), (9999, 1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = rules.judge(docs, labels).collect()
        assert all(r["llr"] == 0.0 and r["kept"] != r["base_failed"] for r in got) and any(r["kept"] for r in got)


def test_labels_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(crowd(40), SCHEMA).repartition(3)
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    few = sorted(map(tuple, rules.judge(docs, labels).collect()))
    monkeypatch.setattr(rules, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, rules.judge(docs, labels).collect())) == few


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def spans_by_hand(text):
    text, out = text or "", []
    pats = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for k, (kind, pat, ok) in enumerate(pats):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pat, text) if ok(m[0])]
    return sorted(out)


TEXTS = [
    "mail me: a.b+c@ex-ample.co.uk, or a@b.c_d@e.f x@y z@z.z.z",
    "a@b.c@d.e ..@a.b 😀 ünï@x.yz 1@2.3",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 001.002.003.0004 99999999999999999999.1.1.1 10.0.0.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713 x 4337166598464399 4111111111111111 4111111111111111",
    "call +1 (988) 555-2485 or +49-30-12 or +1234567890123456 or +12",
    "4" * 500 + " " + "1 " * 400,
    "@" * 50 + "a" * 5000 + "@x.y",
    "é" * 100 + " a@b.cc " + "ß" * 3 + " 8.8.8.8",
    "",
    None,
]


def test_base_spans(spark, tmp_path):
    rows = [(200 + i, t, "en", "a", 1) for i, t in enumerate(TEXTS)] + awkward()[6:]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op8_pii(spark, str(tmp_path)).collect()}
    for doc_id, text, *_ in rows:
        base = spans_by_hand(text)
        written = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        r = got[doc_id]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), (text, written, r["spans"])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b[3] == k for b in base) for k in ("email", "ip", "card", "phone")]
    assert op8_pii(spark, str(tmp_path)).count() == len(rows)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"contact: user{i}@mail.example.com today", "en", "a", 1) for i in range(6)]
    rows += [(50, "contact: QX81-77AB today", "en", "a", 1), (51, "version 1234567 of it", "en", "a", 1), (51, "version 1234567 of it", "en", "a", 1), (52, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(docs).collect()}
    assert spans[50] == ["id"] and spans[51] == [] and spans[0] == ["email"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "contact: [EMAIL] today" and clean[50] == "contact: [ID] today" and clean[52] is None
    assert pii.redact(docs).count() == len(rows)
    assert pii.find(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).columns == docs.columns


def test_planted_tokens_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(8)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    prose = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "7 days", "v1234-5", "on 2024-01-15", "chapter12"]) for _ in range(12))
    rows, planted, unseen = [], {}, {}
    for i in range(60):
        rows.append((i, f"{prose()} token = \"{(t := hexes())}\" {prose()}", "en", "a", 1))
        planted[i] = t
    for i in range(60, 70):  # no random look, only the context
        t = f"key-{rng.randint(1000, 9999)}"
        rows.append((i, f"{prose()} token = \"{t}\" {prose()}", "en", "a", 1))
        unseen[i] = t
    rows += [(i, f"{prose()} {prose()} order 12345678 page A1234567", "en", "a", 1) for i in range(100, 200)]
    found = {r["doc_id"]: [dict(rows_of)[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for rows_of in [[(r[0], r[1]) for r in rows]] for r in pii.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    caught = sum(found[i] == [t] for i, t in (planted | unseen).items())
    assert caught >= 0.9 * len(planted | unseen)
    assert sum(not found[i] for i in range(100, 200)) >= 99


def score_by_hand(graph, rounds):
    """The same scoring over plain dictionaries."""
    belief = {h: 1.0 for p, h, base, seed in graph if seed}
    for _ in range(rounds):
        mean = {}
        for p in {g[0] for g in graph}:
            own = [1.0 if seed else belief.get(h, 0.0) for q, h, base, seed in graph if q == p]
            if sum(v >= pii.MIN_CONFIDENCE for v in own) >= pii.MIN_SUPPORT and sum(own) / len(own) >= pii.MIN_CONFIDENCE:
                mean[p] = min(0.999, sum(own) / len(own))
        left = {}
        for p, h, base, seed in graph:
            if not base and p in mean:
                left[h] = left.get(h, 1.0) * (1 - mean[p])
        belief = {h: 1 - v for h, v in left.items()}
    return belief


def test_graph_scores_against_plain_ones(spark):
    rng = random.Random(3)
    graph = {(f"p{rng.randint(0, 12)}", f"h{rng.randint(0, 60)}") for _ in range(260)}
    graph = [(p, h, int(h[1:]) < 20, int(h[1:]) < 30) for p, h in sorted(graph)]
    got = {r["hit"]: r["score"] for r in pii.score_graph(spark.createDataFrame(graph, "pattern string, hit string, base boolean, seed boolean")).collect()}
    want = score_by_hand(graph, pii.ROUNDS)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-9 for h in want) and len(set(want.values())) > 5


def test_redaction_with_clashing_names_and_long_texts(spark, monkeypatch):
    digits = "7" * 1_000_000
    rows = [(1, "mail a.b@c.de now", 1, 2, 3), (1, "other x.y@z.de", 1, 2, 3), (None, "no id q@r.st", 4, 5, 6), (2, None, 0, 0, 0), (3, digits + " 1.2.3.4 " + "+" * 1000, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash int, _spans int").withColumnsRenamed({"_id": "spans", "_hash": "row"})
    for bound in (pii.BROADCAST_BYTES, 0):
        monkeypatch.setattr(pii, "BROADCAST_BYTES", bound)
        out = pii.redact(docs)
        assert out.columns == docs.columns
        got = {(r["doc_id"], r["text"]) for r in out.collect()}
        assert got == {(1, "mail [EMAIL] now"), (1, "other [EMAIL]"), (None, "no id [EMAIL]"), (2, None), (3, digits + " [IP] " + "+" * 1000)}
