"""Toxicity by a classifier chain.

The labels say only whether a document is toxic. Categories come from the
labelled sample: words and word beginnings that toxic documents use far more often
than others are grouped by the documents they share, and a toxic document is
positive for each group it uses. Linear models predict the categories in turn and
the label last; each sees the probabilities of the earlier ones, which for
training are out-of-fold predictions, so that no link learns from an answer its
predecessor had seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import beside, bounded_sample, settled_labels, stash
from barloom.llm.quality import hash_order

#: Bound of the labelled sample: documents of each label.
SAMPLE_PER_LABEL = 2500
#: Toxic documents that a telling term has at least.
LEAST_DOCS = 4
MAX_TERMS = 400
MAX_CATEGORIES = 6
FOLDS = 5
THRESHOLD = 0.5
LETTERS = regex.compile(r"\p{L}+")
BEGINNINGS = (4, 5)


def terms(text: str | None) -> set[str]:
    """Lower-case words of a text, and the beginnings of longer ones (with a star)."""
    words = set(LETTERS.findall((text or "").lower()))
    return words | {w[:k] + "*" for k in BEGINNINGS for w in words if len(w) > k}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 40) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    damp = np.full(len(w), ridge)
    damp[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(damp)
        step = np.linalg.solve(h, z.T @ (p - y) + damp * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]  # the terms that are columns
    categories: tuple[tuple[int, ...], ...]  # columns of each category
    links: tuple[np.ndarray, ...]  # weights: terms, earlier probabilities, intercept
    base: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        at = {t: i for i, t in enumerate(self.names)}
        out = np.zeros((len(texts), len(at)))
        for row, text in enumerate(texts):
            out[row, [at[t] for t in terms(text) if t in at]] = 1.0
        return out

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of the categories in chain order, the label last."""
        if not self.links:
            return np.full((len(texts), 1), self.base)
        x = self.features(texts)
        found = np.zeros((len(texts), 0))
        for w in self.links:
            found = np.hstack([found, _chance(np.hstack([x, found]), w)[:, None]])
        return found


def _telling_terms(counts: Iterable[tuple[str, int, int]], n1: int, n0: int) -> list[str]:
    """Of terms with their numbers of toxic and other documents, those whose toxic share is beyond chance, the most telling first."""
    scored = []
    for term, a, b in counts:
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
        if a >= LEAST_DOCS and z > 3.0 and odds > 1.5:
            scored.append((-z, term))
    return [t for _, t in sorted(scored)[:MAX_TERMS]]


def _categories(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Group the columns by the toxic documents they share: each joins the group it meets most, or starts one."""
    toxic = x[y == 1]
    together, own = toxic.T @ toxic, toxic.sum(axis=0)
    groups: list[list[int]] = []
    for k in range(x.shape[1]):
        share = [np.mean([together[k, j] / max(1.0, min(own[k], own[j])) for j in g]) for g in groups]
        if share and max(share) >= 0.1:
            groups[int(np.argmax(share))].append(k)
        elif len(groups) < MAX_CATEGORIES:
            groups.append([k])
        else:
            groups[-1].append(k)
    return groups


def base_rate(y: np.ndarray) -> float:
    return float((y.sum() + 0.05) / (len(y) + 1)) if len(y) else 0.05


def train(names: list[str], x: np.ndarray, y: np.ndarray) -> Chain:
    """Fit the chain on the telling terms that labelled documents use; without any it predicts the share of toxic ones."""
    base = base_rate(y)
    if not names:
        return Chain((), (), (), base)
    groups = _categories(x, y)
    goals = [((x[:, g].max(axis=1) > 0) & (y == 1)).astype(float) for g in groups] + [y.astype(float)]
    fold = np.arange(len(y)) % FOLDS
    earlier, links = np.zeros((len(y), 0)), []
    for goal in goals:
        z = np.hstack([x, earlier])
        links.append(_logistic(z, goal))
        apart = np.zeros(len(y))
        for k in range(FOLDS):
            apart[fold == k] = _chance(z[fold == k], _logistic(z[fold != k], goal[fold != k]))
        earlier = np.hstack([earlier, apart[:, None]])
    return Chain(tuple(names), tuple(map(tuple, groups)), tuple(links), base)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Chain:
    """Learn from a bounded sample of the labelled documents, each as a whole.

    Null ids, other labels and ids labelled both ways are left out; of repeated
    and equal texts one counts. Empty tables give a chain of no links. Terms are
    counted in Spark; the driver gets those of LEAST_DOCS toxic documents, and of
    each document which of the telling ones it uses.
    """
    # at most 2 x per_label ids
    ids = F.broadcast(bounded_sample(settled_labels(labels, "doc_id", "toxic"), "doc_id", "toxic", per_label))

    @F.pandas_udf("array<string>")
    def terms_of(texts: pd.Series) -> pd.Series:
        return pd.Series([list(terms(t)) for t in texts], dtype=object)

    sampled = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # copies of a text would make their own words look telling
    apart = stash(sampled.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("of"), "toxic").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text")))
    n = {r["toxic"]: r["n"] for r in apart.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    names: list[str] = []
    if len(n) == 2:
        used = apart.select("toxic", F.explode(terms_of("text")).alias("term"))
        counts = used.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") >= LEAST_DOCS)
        names = _telling_terms((tuple(r) for r in counts.collect()), n[1], n[0])
    at = {t: i for i, t in enumerate(names)}

    @F.pandas_udf("array<int>")
    def columns(texts: pd.Series) -> pd.Series:
        return pd.Series([[at[t] for t in terms(text) if t in at] for text in texts], dtype=object)

    rows = apart.select("doc_id", "toxic", columns("text").alias("columns")).collect()
    order = sorted(rows, key=lambda r: (hash_order(r["doc_id"]), r["doc_id"], r["toxic"]))
    x, y = np.zeros((len(order), len(names))), np.array([r["toxic"] for r in order], dtype=float)
    for k, r in enumerate(order):
        x[k, r["columns"]] = 1.0
    return train(names, x, y)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``toxicity`` (probability), ``categories`` (probability of each link before it) and ``toxic`` to every row.

    Null and empty texts use no term and get the chain's probability for that;
    a probability equal to the threshold is toxic. Texts are read whole. Repeated
    rows get the same answer, an empty table an empty result. Columns of those
    names in ``docs`` are replaced, all others stay.
    """

    @F.pandas_udf("toxicity double, categories array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = np.vstack([chain.predict(list(texts[i : i + 500])) for i in range(0, len(texts), 500)]) if len(texts) else np.zeros((0, 1))
            yield pd.DataFrame({"toxicity": found[:, -1], "categories": [list(r[:-1]) for r in found]})

    scored = beside(docs, predict("text"), ["toxicity", "categories"])
    return scored.withColumn("toxic", F.col("toxicity") >= threshold)


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows that the chain does not call toxic, with the columns they came with."""
    scored = score(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), chain)
    return scored.filter(~F.col("toxic")).select("_doc.*")
