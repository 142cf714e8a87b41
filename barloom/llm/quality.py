"""Quality classifier by compression.

One zstandard dictionary is trained on texts labelled good, another on texts
labelled bad. The normalised difference of a text's compressed sizes under the
two, ``(bad - good) / (bad + good)``, becomes a probability by a logistic
calibration fitted on labelled texts that neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bounded_sample, held_out, settled_labels
from barloom.llm.zstd_blocks import BlockSizer, spread, trained

#: Bound of the labelled sample: texts of each label.
SAMPLE_PER_LABEL = 1500
#: Bytes that one text lends a dictionary at most, in pieces from all over it; differences are taken on whole texts.
LENT_BYTES = 8192
PIECE = 2048
#: Share of the sample that calibrates instead of entering a dictionary.
CALIBRATION = 0.27
#: Differences beyond this are as sure as they get.
EDGE = 0.25


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def sizer(self) -> BlockSizer | None:
        if not self.good or not self.bad:
            return None
        return BlockSizer([self.good, self.bad], zstd.DICT_TYPE_AUTO)


def difference(sizer: BlockSizer | None, text: str | None) -> float:
    """Normalised size difference; 0 for an empty text or without dictionaries."""
    if sizer is None or not text:
        return 0.0
    _, (good, bad) = sizer.sizes(text)
    return float(np.clip((bad - good) / max(1, bad + good), -EDGE, EDGE))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge on the slope."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([np.sum(weight * (p - y) * x) + 1e-3 * a, np.sum(weight * (p - y))])
        h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-9]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, remainder: int = 0, per_label: int = SAMPLE_PER_LABEL) -> QualityModel:
    """Learn from a bounded sample of the labelled rows that are not held out.

    Labels other than 0 and 1, null ids and ids labelled both ways are left out;
    an id of several texts lends the least of them. Without both labels, and on
    empty tables, the model scores every text alike: with the share of good
    labels, or 0.5.
    """
    known = settled_labels(labels, "doc_id", "quality").filter(~held_out("doc_id", mod, remainder))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 0.5) / (total + 1)
    # ids of the sample are bounded by 2 x per_label, so this broadcast is too
    ids = F.broadcast(bounded_sample(known, "doc_id", "quality", per_label))

    @F.pandas_udf("array<binary>")
    def pieces(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([spread(t.encode("utf-8", "surrogatepass"), LENT_BYTES, PIECE, int(k)) for t, k in zip(texts, seeds, strict=True)], dtype=object)

    sampled = docs.select("doc_id", "text").join(ids, "doc_id").filter(F.length("text") > 0).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sampled.select("doc_id", "quality", pieces("text", F.xxhash64("doc_id")).alias("pieces")).collect()
    order = sorted(rows, key=lambda r: (hash_order(r["doc_id"]), r["doc_id"]))
    own = {q: [r for r in order if r["quality"] == q] for q in (0, 1)}
    apart = {q: len(t) - int(len(t) * CALIBRATION) for q, t in own.items()}
    good, bad = (trained([bytes(p) for r in own[q][: apart[q]] for p in r["pieces"]]) if own[q] else b"" for q in (1, 0))
    if not good or not bad:
        return QualityModel(b"", b"", 0.0, float(np.log(prior / (1 - prior))))
    model = QualityModel(good, bad, 0.0, 0.0)

    @F.pandas_udf("double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = model.sizer()
        for texts in batches:
            yield pd.Series([difference(sizer, t) for t in texts], dtype=float)

    wanted = [(r["doc_id"],) for q in (0, 1) for r in (own[q][apart[q] :] or own[q])]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = sampled.join(F.broadcast(docs.sparkSession.createDataFrame(wanted, f"doc_id {kind}")), "doc_id").select("doc_id", "quality", measured("text").alias("x")).collect()
    rest = sorted((hash_order(r["doc_id"]), r["x"], r["quality"]) for r in rest)
    x, y = np.array([r[1] for r in rest]), np.array([r[2] for r in rest], dtype=float)
    share = {q: counts[q] / total / max(1, int((y == q).sum())) * len(y) for q in (0, 1)}
    slope, intercept = _logistic(x, y, np.where(y == 1, share[1], share[0]))
    return QualityModel(good, bad, slope, intercept)


def hash_order(doc_id: int) -> int:
    """A fixed shuffle of ids."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 11


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` to every row.

    Null and empty texts have a difference of 0 and get the calibration's value
    there; a score equal to the threshold is predicted 1. Texts are compressed
    whole, block by block. Repeated rows get the same score, an empty table an
    empty result. Columns of ``docs`` named score or predicted are replaced, all
    others stay.
    """

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = model.sizer()
        for texts in batches:
            x = np.array([difference(sizer, t) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-(model.slope * x + model.intercept))), dtype=float)

    return docs.withColumn("score", probability("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
