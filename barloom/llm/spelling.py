"""Grouping of spelling variants by PartEnum signatures.

A word is the set of its letters, each with the number of its occurrence, so that
one inserted or deleted letter moves the set by one element and a replaced one by
two. Elements are hashed into five partitions: two sets at a Hamming distance of
two at most agree in at least three of them. Each choice of three is a signature;
words with an equal signature meet in an equi-join and are verified by edit
distance. One edit also leaves the first or the last three letters of a word of
six or more alone, so each signature is joined once with either end, which keeps
its lists short. A pair is verified only where it meets first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, small_batches, stash

LEAST_LETTERS = 6
LEAST_TIMES = 5
#: A form occurs at least this many times as often as the word.
FACTOR = 5
#: One in so many (document, run) pairs loses a letter.
ODD = 199
#: Partitions of the elements, and how many of them two near words may differ in.
PARTS = 5
APART = 2
#: Letters at either end that join a signature; two ends of a word of LEAST_LETTERS do not overlap.
END = 3
#: Distinct words that a task holds before it hands its counts on, and characters of a text whose words are held at once.
HELD = 200_000
PIECE = 1 << 20

KEPT = list(combinations(range(PARTS), PARTS - APART))


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """``word`` and ``n``: occurrences of each word of ``least`` letters or more over whole texts.

    Words are maximal runs of Latin letters with A-Z in lower case; where 199
    divides the crc32 of ``<doc_id>:<run>``, the run loses the letter at that
    hash modulo its length. Counts are summed in the tasks before they are
    shuffled.
    """
    small_batches(docs.sparkSession)
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    apart = re.compile("[^a-zÀ-ÿ]")

    def of_text(raw: bytes | None) -> Counter:
        text, found, at = (raw or b"").lower().decode("utf-8", "replace"), Counter(), 0  # bytes.lower changes A-Z only
        while at < len(text):
            gap = apart.search(text, at + PIECE)
            end = gap.start() if gap else len(text)
            found.update(runs.findall(text, at, end))
            at = end
        return found

    def frame(total: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(total.keys()), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = Counter()
        for batch in batches:
            for doc_id, raw in zip(batch["i"], batch["t"], strict=True):
                start = crc32(f"{doc_id}:".encode())
                for run, n in of_text(raw).items():
                    h = crc32(run.encode(), start)
                    if h % ODD == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    total[run] += n
                if len(total) > HELD:
                    yield frame(total)
                    total.clear()
        yield frame(total)

    made = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t")).mapInPandas(count, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def partitions(word: Column) -> Column:
    """The hash of a word's elements in each partition."""
    letters = F.array_sort(F.split(word, ""))
    elements = F.transform(letters, lambda x, i: F.concat(x, (i - F.array_position(letters, x)).cast("string")))
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.xxhash64(p, F.array_join(F.filter(elements, lambda e: F.pmod(F.xxhash64(e), F.lit(PARTS)) == p), ",")))


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of distinct words (columns ``word`` and ``n``, one row a word) one edit apart, once: ``a``, ``b``, ``a_n``, ``b_n``.

    Every word must have LEAST_LETTERS letters or more.
    """
    parted = words.select("word", "n", partitions(F.col("word")).alias("parts"))
    kept = lambda k: [F.col("parts")[p] for p in KEPT[k]]
    ends = [F.substring("word", 1, END), F.substring("word", -END, END)]
    made = [F.struct(F.lit(k).alias("kind"), F.lit(e).alias("end"), F.xxhash64(F.lit(k), F.lit(e), *kept(k), ends[e]).alias("sign")) for k in range(len(KEPT)) for e in (0, 1)]
    signed = stash(parted.select("word", "n", "parts", F.inline(F.array(*made))))
    a, b = (signed.select(*[F.col(c).alias(f"{x}_{c}") for c in signed.columns]) for x in "ab")
    agree = lambda k: F.forall(F.array(*[F.lit(p) for p in KEPT[k]]), lambda p: F.get("a_parts", p) == F.get("b_parts", p))
    first = F.coalesce(*[F.when(agree(k), F.lit(k)) for k in range(len(KEPT))])
    same_start = F.substring("a_word", 1, END) == F.substring("b_word", 1, END)
    once = (F.col("a_word") < F.col("b_word")) & (F.col("a_kind") == first) & (same_start == (F.col("a_end") == 0))
    near = F.levenshtein("a_word", "b_word", 1) == 1
    met = a.join(b, (F.col("a_sign") == F.col("b_sign")) & (F.col("a_kind") == F.col("b_kind")) & (F.col("a_end") == F.col("b_end")) & once & near)
    return met.select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), "a_n", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for rows of ``word`` and ``form``: forms followed to the last, twice as far in each round."""
    found = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stash(found.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        discard(found)
        found = step
        if not found.filter("_moved").limit(1).count():
            return found.select("word", "root")


def variants(docs: DataFrame, least_times: int = LEAST_TIMES, factor: int = FACTOR) -> DataFrame:
    """One row per word of whole ``docs``: word, form, root, n, n_near, form_n.

    Words are those of ``word_counts`` that occur ``least_times`` or more. A form
    is the most frequent near word (ties: the smallest in code-point order), where
    it occurs at least ``factor`` times as often; forms only grow in frequency, so
    following them ends, at the root. A null id counts as the empty text, repeated
    rows count again, null and empty texts have no words and texts of any length
    are read whole. An empty table gives an empty result; other columns are ignored.
    """
    words = stash(word_counts(docs).filter(F.col("n") >= least_times))
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("o")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("o")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("o")).alias("o"), F.col("other"))).alias("_best"))
    known = words.join(best, "word", "left")
    often = -F.col("_best.o") >= factor * F.col("n")
    known = stash(
        known.select("word", F.when(often, F.col("_best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, -F.col("_best.o")).alias("form_n"))
    )
    last = roots(known.filter("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
