"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words. A document of a source whose target
is f times its size enters the mix floor(f) times, and once more with
probability f - floor(f). Which ones do is settled by the cube method: the
fractional probabilities move along directions that change neither the expected
words nor the expected number of documents until each is 0 or 1. Blocks of
documents move on their own; what stays fractional (at most two documents a
block) moves again in the next round, until a source has one block. Its last
fractional documents, the landing problem, are rounded to the nearest total.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import n_words, stash

WEIGHTS = (3.0, 1.0, 2.0)
RATIO = 1.5
CAP = 2.0
#: Documents that move together.
BLOCK = 800
#: Documents of a source that the landing rounds, besides the two that a flight leaves.
WAITING = 12
TINY = 1e-9


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """Add ``target`` to one row per source with its ``source_size``.

    Sources in code-point order (null last) take the weights in turn and share
    ``ratio`` of all sizes. With level x, a source gets min(cap * size, x *
    weight); sorted by the level at which they are full, x follows from running
    sums. Sources are few, so windows over all of them are cheap.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    known = totals.withColumn("_w", weight).withColumn("_full", cap * F.col("source_size"))
    by_level = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    total = ratio * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # the first source, in this order, that its share does not fill sets the level of all after it
    leveled = known.withColumn("_level", level).withColumn("_over", F.col("_full") <= F.col("_level") * F.col("_w"))
    rest = F.min(F.when(~F.col("_over"), F.struct(F.col("_full") / F.col("_w"), F.col("_level").alias("x")))).over(Window.partitionBy())
    return leveled.withColumn("_x", rest["x"]).select(
        "source", "source_size", "n_docs", F.when(F.col("_x").isNull() | F.col("_over"), F.col("_full")).otherwise(F.col("_x") * F.col("_w")).cast("double").alias("target")
    )


def flight(size: np.ndarray, chance: np.ndarray, seed: int) -> np.ndarray:
    """Move chances to 0 or 1 until at most two stay between, keeping sum(chance * size) and sum(chance)."""
    out, rng = chance.astype(float).copy(), random.Random(seed)
    active: list[int] = []
    for k in range(len(out)):
        if not TINY < out[k] < 1 - TINY:
            continue
        active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - out[i]) / v if v > 0 else out[i] / -v for i, v in zip(active, u, strict=True) if v)
            down = min(out[i] / v if v > 0 else (1 - out[i]) / -v for i, v in zip(active, u, strict=True) if v)
            step = up if rng.random() * (up + down) < down else -down
            for i, v in zip(active, u, strict=True):
                out[i] += step * v
            active = [i for i in active if TINY < out[i] < 1 - TINY]
    out[out <= TINY] = 0.0
    out[out >= 1 - TINY] = 1.0
    return out


def landing(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Round the last fractional chances so that the words come nearest to their expectation, then the documents.

    All roundings of the few open documents are tried; those that miss the
    expected number of documents by more than one only if there are no others.
    """
    out = chance.copy()
    open_ = np.nonzero((out > 0) & (out < 1))[0]
    if len(open_):
        trial = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))[None, :] & 1).astype(float)
        words = np.abs(trial @ size[open_] - float((out * size)[open_].sum()))
        docs = np.abs(trial.sum(axis=1) - float(out[open_].sum()))
        out[open_] = trial[np.lexsort((docs, words, docs > 1))[0]]
    return out


def _round(units: DataFrame, last: Column) -> DataFrame:
    """One flight of each (source, block); a block for which ``last`` holds lands as well."""

    def move(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "doc_id", "size"], kind="stable")
        size, chance = part["size"].to_numpy(dtype=float), part["_chance"].to_numpy(dtype=float)
        seed = int(part["_order"].iloc[0])
        if part["_last"].iloc[0]:
            # a few documents of all sizes wait for the landing
            open_ = np.nonzero((chance > TINY) & (chance < 1 - TINY))[0]
            by_size = open_[np.argsort(size[open_], kind="stable")]
            wait = np.unique(by_size[np.linspace(0, len(by_size) - 1, WAITING).astype(int)]) if len(by_size) else open_
            move_ = np.setdiff1d(np.arange(len(size)), wait)
            chance[move_] = flight(size[move_], chance[move_], seed)
            chance = landing(size, chance)
        else:
            chance = flight(size, chance, seed)
        part["_chance"] = chance
        return part

    return units.withColumn("_last", last).groupBy("_none", "source", "_block").applyInPandas(move, units.withColumn("_last", last).schema).drop("_last")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = RATIO, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target and taken.

    ``taken`` counts the words the mix takes, repeats included; reruns agree.
    Null, empty and blank texts have size 0 and take 0; a source of such texts
    has target 0. Null ids and repeated rows count as documents of their own:
    rows alike in everything are numbered from their count, and a document's block
    follows from id, text and number, so that no block holds more than its share.
    An empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"))
    times = rows.groupBy("doc_id", "source", "size", "_text").agg(F.count("*").alias("_times"))
    sized = stash(times.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).drop("_times"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = targets(totals, weights, ratio, cap).withColumns({"_none": F.col("source").isNull(), "_key": F.coalesce("source", F.lit(""))})
    units = (
        sized.withColumns({"_none": F.col("source").isNull(), "_key": F.coalesce("source", F.lit(""))})
        .join(goal.drop("source"), ["_none", "_key"])
        .drop("_key")
        .withColumn("_factor", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_base", F.floor(F.col("_factor") + F.lit(TINY)))
        .withColumn("_chance", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("_factor") - F.col("_base"))))
        .withColumn("_order", F.xxhash64("doc_id", "_text", "_copy", F.lit(0)))
        .withColumn("_blocks", F.ceil(F.col("n_docs") / block).cast("long"))
        .withColumn("_block", F.pmod(F.xxhash64("doc_id", "_text", "_copy", F.lit(1)), F.col("_blocks")))
    )
    # every round leaves at most two documents of a block
    first = stash(_round(units, F.col("_blocks") == 1))
    settled, rest, level = first, first.filter((F.col("_chance") > 0) & (F.col("_chance") < 1)), 2
    parts = []
    most = rest.agg(F.max("_blocks")).first()[0]
    while most is not None:
        parts.append(settled.filter((F.col("_chance") == 0) | (F.col("_chance") == 1)))
        again = rest.withColumn("_blocks", F.ceil(F.col("_blocks") * 2 / block).cast("long")).withColumn("_block", F.pmod(F.xxhash64("doc_id", "_text", "_copy", F.lit(level)), F.col("_blocks")))
        settled = stash(_round(again, F.col("_blocks") == 1))
        rest, level = settled.filter((F.col("_chance") > 0) & (F.col("_chance") < 1)), level + 1
        most = rest.agg(F.max("_blocks")).first()[0]
    for part in parts:
        settled = settled.unionByName(part)
    return settled.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("_base") + F.round("_chance"))).cast("long").alias("taken"))
