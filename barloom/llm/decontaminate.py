"""Benchmark decontamination by edit distance between items and item-sized windows.

Distances count words. The CGK random walk turns edit distance into Hamming
distance, and bit-sampling hashes of the walk, repeated until the wanted recall,
are the index: items and item-sized windows of the texts are joined on them, and
the exact edit distance between item and text decides.

A window within k edits of an item of L words keeps at least L - 1 - 2k of the
item's word pairs. A bitmap of the benchmark's pairs, whose size is bounded, shows
which windows hold that many pairs of items of their length; no other window can
match, so only those are walked. The bitmap names no item and no place. Items too
short for an edit are searched word for word. Benchmark and hashes are tables and
joined as such; nothing but two bitmaps (of pairs, and of the items' hashes, to
keep others from the join) and the item lengths reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stash

#: An item leaks where a stretch of text is within this share of its words in edits.
MAX_EDITS = 0.15
SAMPLED = 4
RECALL = 0.99
#: Repetitions that sample one walk.
TABLES = 6
#: Share of equal walk positions of a pair at the edit limit, as measured in the tests.
AGREEMENT = 0.55
#: Bits of a bitmap for each hash in it, and its bounds.
BITS_PER_HASH = 64
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
#: Windows that a task walks at once.
WINDOWS = 4096
#: Cells of the edit-distance tables of the pairs that a task verifies at once, and after how many words it drops the far ones.
CELLS, STEPS = 1 << 18, 4
#: Findings, and samples of the items, up to this many bytes go to all texts; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Scripts written without blanks: each character is a word.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
LEAK = "struct<item_id:long,distance:int,start:int>"


def words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    text = text or ""
    if not text.isascii() and UNSPACED.search(text):
        text = UNSPACED.sub(r" \g<0> ", text)
    return text.lower().encode("utf-8", "surrogatepass").translate(SPACED).split()


def coded(text: str | None) -> np.ndarray:
    """The words of a text as 64-bit hashes."""
    found = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def edit_limit(size: int, max_edits: float = MAX_EDITS) -> int:
    return int(max_edits * size)


def repetitions(recall: float = RECALL, agreement: float = AGREEMENT, sampled: int = SAMPLED) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each pair of neighbouring words."""
    return _mixed(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:])


def of_size(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What pairs (or single words) are called as parts of items of so many words."""
    return _mixed(hashes + sizes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def item_marks(codes: np.ndarray) -> np.ndarray:
    """The hashes by which a bitmap knows an item: its pairs as such, and as those of an item of its length."""
    size = np.array([len(codes)])
    if len(codes) == 1:
        return of_size(codes, size)
    pairs = pair_hashes(codes)
    return np.concatenate([pairs, of_size(pairs, size)])


def walk_positions(size: int, reps: int, sampled: int = SAMPLED) -> np.ndarray:
    """Which of the 3 * size steps of a walk each repetition samples."""
    rep = np.arange(reps, dtype=np.uint64)
    draws = _mixed(rep[:, None] * np.uint64(977) + np.arange(sampled, dtype=np.uint64)[None, :] + np.uint64(1))
    return np.sort((draws % np.uint64(3 * size)).astype(np.int64), axis=1)


def cgk_samples(windows: np.ndarray, reps: int, sampled: int = SAMPLED) -> np.ndarray:
    """Hashes of sampled positions of the CGK walks of each window (rows of equal length), one column per repetition.

    A walk writes the symbol under its pointer and moves on when a random bit of
    (walk, step, symbol) says so, for three steps per symbol. TABLES repetitions
    sample one walk, each at its own positions.
    """
    n, size = windows.shape
    symbols = np.hstack([windows.astype(np.uint64) + np.uint64(1), np.zeros((n, 1), dtype=np.uint64)]).ravel()
    walks = -(-reps // TABLES)
    chosen = walk_positions(size, reps, sampled)
    by_step: dict[int, list[int]] = {}
    for k, steps in enumerate(chosen.tolist()):
        for step in set(steps):
            by_step.setdefault(step, []).append(k)
    walk = (np.arange(walks, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))[:, None]
    pointer = np.tile(np.arange(n, dtype=np.int64) * (size + 1), (walks, 1))
    last = (np.arange(n, dtype=np.int64) * (size + 1) + size)[None, :]
    out = np.tile(np.arange(reps, dtype=np.uint64)[:, None], (1, n))
    for step in range(int(chosen.max()) + 1):
        symbol = symbols[pointer]
        for k in by_step.get(step, ()):
            out[k] = _mixed(out[k] * np.uint64(0x9E3779B97F4A7C15) + symbol[k // TABLES] + np.uint64(step))
        moved = symbol * np.uint64(0xD1342543DE82EF95) + (walk + np.uint64(step * 0x81DADEF4BC2DD44D & (1 << 64) - 1))
        moved ^= moved >> np.uint64(29)
        moved *= np.uint64(0x7FB5D329728EA185)
        pointer += (moved >> np.uint64(63)).astype(np.int64)
        np.minimum(pointer, last, out=pointer)
    return out.T


def edits_within(items: np.ndarray, texts: list[np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest edit distance between each item (rows of equal length) and any stretch of its text, and where the first such stretch ends.

    Distances over the limit count as limit + 1, with 0 as the end. All pairs go
    through the table together, one word of the items at a time; every few words
    those that are beyond the limit leave it, as no later word brings them back.
    """
    many, size = items.shape
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    widest = int(lengths.max(initial=0))
    kind = np.int16 if size + widest + limit < 1 << 15 else np.int64
    # one column a pair; what lies behind the end of a text reaches nothing before it
    symbols = np.zeros((widest, many), dtype=items.dtype)
    for k, text in enumerate(texts):
        symbols[: len(text), k] = text
    distance, end = np.full(many, limit + 1, dtype=np.int64), np.zeros(many, dtype=np.int64)
    left = np.arange(many)
    ramp = np.arange(widest + 1, dtype=kind)[:, None]
    row = np.zeros((widest + 1, many), dtype=kind)
    row[ramp > lengths] = limit + 1
    for k in range(size):
        best = np.empty_like(row)
        best[0] = k + 1
        np.minimum(row[1:] + kind(1), row[:-1] + (symbols != items[left, k]), out=best[1:])
        best -= ramp
        np.minimum.accumulate(best, axis=0, out=best)  # insertions
        row = np.add(best, ramp, out=best)
        if k % STEPS == STEPS - 1 or k == size - 1:
            row[ramp > lengths[left]] = limit + 1
            near = row.min(axis=0) <= limit
            if not near.all():
                left, row, symbols = left[near], row[:, near], symbols[:, near]
            if not len(left):
                return distance, end
    end[left] = row.argmin(axis=0)
    distance[left] = row.min(axis=0)
    return distance, end


def nearest_stretches(items: list[np.ndarray], texts: list[np.ndarray], max_edits: float) -> np.ndarray:
    """Distance and end, as in ``edits_within``, of pairs of any lengths, in tables of CELLS or of one pair."""
    out = np.zeros((len(items), 2), dtype=np.int32)
    sizes, widths = (np.array([len(x) for x in v], dtype=np.int64) for v in (items, texts))
    order = np.lexsort((widths, sizes))
    for same in np.split(order, np.nonzero(np.diff(sizes[order]))[0] + 1) if len(items) else []:
        tables = -(-len(same) * (int(widths[same[-1]]) + 1) // CELLS)
        for few in np.array_split(same, min(len(same), tables)):
            found = edits_within(np.vstack([items[k] for k in few]), [texts[k] for k in few], edit_limit(int(sizes[few[0]]), max_edits))
            out[few] = np.column_stack(found)
    return out


class WindowFinder:
    """Windows of a text that hold enough pairs of items of their length."""

    def __init__(self, bitmap: np.ndarray, sizes: list[int], max_edits: float):
        self.bitmap = bitmap
        self.single = 1 in sizes
        self.sizes = np.array([n for n in sorted(sizes) if n > 1], dtype=np.int64)
        self.limits = [edit_limit(int(n), max_edits) for n in self.sizes]
        self.needs = np.array([n - 1 - 2 * k for n, k in zip(self.sizes, self.limits, strict=True)], dtype=np.int64)
        # the shortest items need the fewest pairs, and the longest windows hold the most
        self.least = int(self.needs.min()) if len(self.needs) else 1 << 40
        self.widest = max((int(n) + k - 1 for n, k in zip(self.sizes, self.limits, strict=True)), default=0)

    def search(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(length, limit, starts) wherever there are such windows."""
        if self.single and len(codes):
            starts = np.nonzero(_in(self.bitmap, of_size(codes, np.array([1]))))[0]
            if len(starts):
                yield 1, 0, starts
        if len(codes) < 2:
            return
        pairs = pair_hashes(codes)
        where = np.nonzero(_in(self.bitmap, pairs))[0]
        if len(where) < self.least or (where[self.least - 1 :] - where[: len(where) - self.least + 1]).min() >= self.widest:
            return
        own = _in(self.bitmap, of_size(pairs[where][:, None], self.sizes[None, :]))
        for k in np.nonzero(own.sum(axis=0) >= self.needs)[0]:
            size, limit, need = int(self.sizes[k]), self.limits[k], int(self.needs[k])
            at = where[own[:, k]]
            # enough of them within reach of one window
            if (at[need - 1 :] - at[: len(at) - need + 1]).min() >= size + limit - 1 or len(codes) < size - limit:
                continue
            sums = np.zeros(len(pairs) + 1, dtype=np.int64)
            sums[at + 1] = 1
            sums = np.cumsum(sums)
            enough = self._within(sums, size + limit - 1) >= need
            # of the windows that overlap by half, those with nearly the most pairs: an item's own start is within k of them
            held = np.where(enough, self._within(sums, size - 1), -1)
            around = np.lib.stride_tricks.sliding_window_view(np.pad(held, size // 2, constant_values=-1), 2 * (size // 2) + 1)
            near = np.nonzero(enough)[0]
            starts = near[held[near] >= around[near].max(axis=1) - limit]
            yield size, limit, np.unique(np.minimum(starts, max(0, len(codes) - size)))

    @staticmethod
    def _within(sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - 1
        ends = np.minimum(np.arange(n) + width, n)
        return sums[ends] - sums[:-1]


def _items(benchmark: DataFrame, max_edits: float) -> DataFrame:
    """item_id, size and codes of every item that has a word."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [coded(t) for t in batch["text"]]
            rows = pd.DataFrame({"item_id": batch["item_id"], "size": [len(c) for c in codes], "codes": [c.astype(np.int64) for c in codes]})
            yield rows[rows["size"] > 0]

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(emit, "item_id long, size int, codes array<long>")


def _index(items: DataFrame, reps: int) -> DataFrame:
    """(size, hash, item_id) of the walks of the items."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                hashes = cgk_samples(np.vstack(list(part["codes"])).astype(np.int64).view(np.uint64), reps)
                yield pd.DataFrame({"size": np.int32(size), "hash": hashes.astype(np.int64).ravel(), "item_id": np.repeat(part["item_id"].to_numpy(), reps)})

    return items.mapInPandas(emit, "size int, hash long, item_id long")


def _bitmap(hashes: DataFrame, many: int) -> np.ndarray:
    """Bitmap of a column ``hash``, MOST_BITS at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_HASH * many).bit_length()))
    at = hashes.select((F.col("hash").bitwiseAND(F.lit(bits - 1).cast("long"))).alias("at"))
    set_ = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
    out = np.zeros(bits // 64, dtype=np.uint64)
    for row in set_.toLocalIterator():
        out[row["word"]] = row["mask"] & (1 << 64) - 1
    return out.view(np.uint8)


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _stacked(found: list[tuple[int, np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of several texts under each other, with their texts' places and their starts, WINDOWS at a time or few more."""
    held, many = [], 0
    for place, codes, starts in found:
        line = np.concatenate([codes, np.zeros(size, dtype=np.uint64)])
        for few in np.array_split(starts, -(-len(starts) // WINDOWS)):
            held.append((line[few[:, None] + np.arange(size)[None, :]], np.full(len(few), place), few))
            many += len(few)
            if many >= WINDOWS:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, many = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """of_id, of_hash and ``leaks`` of the texts into which items leak."""
    items, reps = stash(_items(benchmark, max_edits)), repetitions()
    index = stash(_index(items, reps))
    sizes = [r[0] for r in items.select("size").distinct().collect()]

    @F.pandas_udf("array<long>")
    def marks(codes: pd.Series) -> pd.Series:
        return pd.Series([item_marks(np.asarray(c, dtype=np.int64).view(np.uint64)).astype(np.int64) for c in codes], dtype=object)

    pairs = items.agg(F.sum("size")).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast((_bitmap(items.select(F.explode(marks("codes")).alias("hash")), 2 * pairs), _bitmap(index, index.count())))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Regions of the texts with the index's hashes that windows in them have."""
        known, sampled = shared.value
        finder = WindowFinder(known, sizes, max_edits)
        for batch in batches:
            by_size: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}
            for place, text in enumerate(batch["text"]):
                codes = coded(text)
                for size, limit, starts in finder.search(codes):
                    by_size.setdefault((size, limit), []).append((place, codes, starts))
            for (size, limit), found in by_size.items():
                hits: dict[tuple[int, int], set[int]] = {}
                for windows, places, starts in _stacked(found, size):
                    hashes = cgk_samples(windows, reps)
                    met = _in(sampled, hashes)
                    for row in np.nonzero(met.any(axis=1))[0]:
                        # windows that begin within one stretch of the item's size share a region
                        hits.setdefault((int(places[row]), int(starts[row]) // size), set()).update(hashes[row, met[row]].tolist())
                if not hits:
                    continue
                codes_of = {place: codes for place, codes, _ in found}
                rows = [(size, max(0, k * size - limit), codes_of[place][max(0, k * size - limit) : (k + 2) * size + limit].astype(np.int64), np.array(sorted(some), dtype=np.uint64).astype(np.int64)) for (place, k), some in hits.items()]
                out = batch[["of_id", "of_hash"]].iloc[[place for place, _ in hits]].reset_index(drop=True)
                yield pd.concat([out, pd.DataFrame(rows, columns=["size", "start", "around", "hashes"]).astype({"size": np.int32, "start": np.int32})], axis=1)

    texts = docs.select(F.col("doc_id").alias("of_id"), F.xxhash64("text").alias("of_hash"), "text").filter("text is not null")
    regions = stash(texts.mapInPandas(emit, f"of_id {kind}, of_hash long, size int, start int, around array<long>, hashes array<long>"))
    if 64 * index.count() <= BROADCAST_BYTES:
        index = F.broadcast(index)
    key = ["of_id", "of_hash", "size", "start"]
    met = regions.select(*key, F.explode("hashes").alias("hash")).join(index, ["size", "hash"]).select(*key, "item_id").distinct()
    again = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key]
    proposed = regions.alias("r").join(met.alias("m"), again).select("r.of_id", "r.of_hash", "r.size", "r.start", "r.around", "m.item_id")
    proposed = proposed.join(items.select("item_id", "size", "codes"), ["item_id", "size"])

    @F.pandas_udf("distance int, at int")
    def nearest(item: pd.Series, around: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(nearest_stretches(list(item), list(around), max_edits), columns=["distance", "at"])

    near = proposed.withColumn("n", nearest("codes", "around")).filter(F.col("n.distance") <= F.floor(F.col("size") * F.lit(max_edits)))
    place = F.greatest(F.lit(0), F.col("start") + F.col("n.at") - F.col("size")).alias("start")
    best = near.groupBy("of_id", "of_hash", "item_id").agg(F.min(F.struct(F.col("n.distance").alias("distance"), place)).alias("best"))
    leak = F.struct(F.col("item_id"), F.col("best.distance").alias("distance"), F.col("best.start").alias("start"))
    return best.groupBy("of_id", "of_hash").agg(F.array_sort(F.collect_list(leak)).alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """Add ``leaks``, an array of (item_id, distance, start) in that order, to every row; empty for null and empty texts.

    The benchmark is the stated query set: all documents are searched for it, as
    whole texts. Null items and items without a word leak nowhere, and without
    items nothing leaks; items too short for an edit (6 words at most) must occur
    word for word. Of several places of an item the nearest counts, of equals the
    first; items that repeat an id count as one. Repeated rows get the same
    leaks, empty tables an empty result. A column ``leaks`` of ``docs`` is
    replaced, all others stay.
    """
    found = stash(leaks(docs, benchmark, max_edits))
    size = found.agg(F.sum(32 + 16 * F.size("leaks"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    joined = rows.join(found, F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_hash") == F.col("of_hash")), "left")
    none = F.array().cast(f"array<{LEAK}>")
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "leaks"], F.coalesce("leaks", none).alias("leaks"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows into which no item leaks, with the columns they came with."""
    wrapped = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")
    return find_leaks(wrapped, benchmark).filter(F.size("leaks") == 0).select("_doc.*")
