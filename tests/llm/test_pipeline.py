import corpus_pipeline
from tests.llm.test_jaccard import by_hand, near_copies
from tests.llm.texts import SCHEMA

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_a_small_corpus(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(20))
    rows = near_copies(6)[:40]
    rows += [(5000 + i, f"text {i} " + " ".join(f"u{i}w{j}" for j in range(30)) + (" grumble snarl" if i % 3 == 0 else ""), "en", "b", 1) for i in range(60)]
    rows += [(6000, "before it " + item + " after it", "en", "a", 1), (6001, "write to some.one@mail.example.com please " + " ".join(f"z{j}" for j in range(20)), "en", None, 1), (6002, None, "en", "a", None), (6003, "", None, "a", 0)]
    labels = [(5000 + i, 1, int(i % 3 == 0)) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{number}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{number}"))
        seen[name] = ([tuple(r) for r in before], docs.collect())
        if name != "mixing":
            assert docs.columns == DOCS
    assert list(seen) == ["toxicity", "near_copies", "decontamination", "personal_data", "mixing"]
    kept = {r["doc_id"] for r in seen["toxicity"][1]}
    assert not kept & {5000 + i for i in range(60) if i % 3 == 0} and {5000 + i for i in range(60) if i % 3} <= kept
    before, after = seen["near_copies"]
    assert {r["doc_id"] for r in after} == {i for i, _, c in by_hand(before) if i == c}
    before, after = seen["decontamination"]
    assert {r["doc_id"] for r in after} == {r[0] for r in before} - {6000}
    before, after = seen["personal_data"]
    assert len(before) == len(after) and next(r["text"] for r in after if r["doc_id"] == 6001).startswith("write to [EMAIL] please")
    assert len(seen["mixing"][1]) == len(after) and all(r["taken"] <= 2 * r["size"] for r in seen["mixing"][1])
    assert corpus_pipeline.ORACLE_SQL is None
