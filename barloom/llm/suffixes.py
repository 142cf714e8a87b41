"""Removal of repeated passages by a sampled, distributed suffix array.

A window is a string of 100 bytes. Each has an anchor, the 40-byte gram in it with
the smallest hash (the leftmost of equals), so equal windows have equal anchors at
equal places. Neighbouring windows with one anchor form a run. Runs are the
suffixes that get sorted: by their leading token (the anchor's hash), then by the
hash of all their bytes, then by place. Splitters from a sample of the documents
deal them to ranges, each range sorts on its own, neighbours are compared, and the
rows at the edges of ranges are compared across them. Equal runs repeat whole. Runs that
share an anchor but differ somewhere are compared window by window, and for that
the first run of each content is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import release, stash

WINDOW = 100
GRAM = 40
#: Window starts handled at once; places in a segment fit in 20 bits.
SEGMENT = 1 << 19
#: Small results up to this many bytes go to the texts; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Documents whose rows give the splitters.
SAMPLE_DOCS = 4000
#: Of the rows of those, one in so many reaches the driver.
SAMPLE_ROWS = 16

_M = 0x5851F42D4C957F2D
_INVERSE = pow(_M, -1, 1 << 64)
_PLACE = np.uint64((1 << 20) - 1)
#: A number for each byte, from the multiplier alone.
_NUMBERS = np.array([(pow(_M, 3 * b + 5, 1 << 64) ^ (pow(_M, 7 * b + 11, 1 << 64) >> 29)) | 1 for b in range(256)], dtype=np.uint64)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(which: str, n: int) -> np.ndarray:
    known = _powers[which]
    if len(known) < n:
        base = np.full(max(n, 1 << 16), _M if which == "up" else _INVERSE, dtype=np.uint64)
        base[0] = 1
        _powers[which] = known = np.cumprod(base, dtype=np.uint64)
    return known[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes' numbers times powers, from which follows the hash of every stretch."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_NUMBERS[data] * _power("up", len(data)), out=sums[1:])
    return sums


def stretch_hash(sums: np.ndarray, first: np.ndarray, size: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Mixed hash of the bytes from first, size of them, and a further number."""
    below = _power("down", len(sums))[first]
    return _mixed((sums[first + size] - sums[first]) * below + size.astype(np.uint64) * np.uint64(_M) + more.astype(np.uint64))


def rolling(sums: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of each stretch of ``size`` bytes."""
    return _mixed((sums[size:] - sums[:-size]) * _power("down", len(sums) - size) + np.uint64(size))


def runs(raw: bytes) -> tuple[np.ndarray, ...]:
    """Runs of a text: anchor hash, content hash, first window start, number of windows."""
    if len(raw) < WINDOW:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty
    out = []
    for base in range(0, len(raw) - WINDOW + 1, SEGMENT):
        piece = raw[base : base + SEGMENT + WINDOW - 1]
        sums = prefix_sums(np.frombuffer(piece, dtype=np.uint8))
        grams = rolling(sums, GRAM)
        lowest = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width = WINDOW - GRAM + 1
        reach = 1
        while reach * 2 <= width:
            lowest = np.minimum(lowest[:-reach], lowest[reach:])
            reach *= 2
        if reach < width:
            lowest = np.minimum(lowest[: len(lowest) - (width - reach)], lowest[width - reach :])
        anchor = (lowest & _PLACE).astype(np.int64)
        first = np.nonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))[0]
        count = np.diff(np.concatenate([first, [len(anchor)]]))
        content = stretch_hash(sums, first, count + WINDOW - 1, anchor[first] - first)
        out.append((grams[anchor[first]].astype(np.int64), content.astype(np.int64), first + base, count))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


RUN = "leading long, content long, doc_id long, start long, windows int"


def _suffix_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = batch["doc_id"].astype("Int64")
        for low in range(0, len(batch), 256):
            parts = [(i, runs(_bytes(t))) for i, t in zip(ids.iloc[low : low + 256], batch["text"].iloc[low : low + 256], strict=True)]
            sizes = [len(p[0]) for _, p in parts]
            columns = [np.concatenate([p[k] for _, p in parts]) for k in range(4)]
            yield pd.DataFrame({"leading": columns[0], "content": columns[1], "doc_id": np.repeat(np.array([i for i, _ in parts], dtype=np.int64), sizes), "start": columns[2], "windows": columns[3].astype(np.int32)})


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each first on, count of them, sorted and once each."""
    ends = np.cumsum(count)
    return np.unique(np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0))


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for low in range(0, len(batch), 256):
            part = batch.iloc[low : low + 256]
            ids, windows, places = [], [], []
            for doc_id, text, first, count in zip(part["doc_id"], part["text"], part["first"], part["count"], strict=True):
                data = np.frombuffer(_bytes(text), dtype=np.uint8)
                if len(data) < WINDOW:
                    continue
                starts = spread(np.asarray(first, dtype=np.int64), np.asarray(count, dtype=np.int64))
                starts = starts[starts <= len(data) - WINDOW]
                ids.append(np.full(len(starts), doc_id, dtype=np.int64))
                windows.append(rolling(prefix_sums(data), WINDOW)[starts].astype(np.int64))
                places.append(starts)
            if ids:  # many documents a frame: each frame is a batch of its own on its way back
                yield pd.DataFrame({"window": np.concatenate(windows), "doc_id": np.concatenate(ids), "start": np.concatenate(places)})


def dealt(rows: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The range of each row (columns in sort order): how many splitters are not greater than it."""
    at = np.searchsorted(splitters[:, 0], rows[:, 0], side="left").astype(np.int64)
    # only rows whose first column a splitter has need the other columns
    close = np.nonzero((at < len(splitters)) & (splitters[np.minimum(at, len(splitters) - 1), 0] == rows[:, 0]))[0]
    if len(close):
        both = np.vstack([splitters, rows[close]])
        order = np.lexsort((np.concatenate([np.zeros(len(splitters), dtype=np.int8), np.ones(len(close), dtype=np.int8)]), *both.T[::-1]))
        passed = np.cumsum(order < len(splitters))
        own = order >= len(splitters)
        at[close[order[own] - len(splitters)]] = passed[own]
    return at


def in_ranges(docs: DataFrame, make, schema: str, order: list[str]) -> DataFrame:
    """The rows that ``make`` gives for the documents, dealt to ranges of ``order`` and sorted in each.

    The splitters are quantiles of one in SAMPLE_ROWS rows of about SAMPLE_DOCS
    documents, chosen by hashes; so the rows themselves are made once. They only
    balance the ranges: without any, all rows are one range. They cut between
    places too, so the rows of one frequent key may spread over ranges.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, docs.count() // SAMPLE_DOCS)
    few = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(step)) == 0).mapInPandas(make, schema).select(*order)
    sample = np.array([tuple(r) for r in few.filter(F.pmod(F.xxhash64(*order), F.lit(SAMPLE_ROWS)) == 0).collect()], dtype=np.int64).reshape(-1, len(order))
    sample = sample[np.lexsort(sample.T[::-1])]
    shared = spark.sparkContext.broadcast(sample[(np.arange(1, n) * len(sample)) // n] if len(sample) else sample)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in make(batches):
            yield rows.assign(part=dealt(rows[order].to_numpy(dtype=np.int64), shared.value).astype(np.int32) if len(shared.value) else np.int32(0))

    return docs.mapInPandas(deal, f"{schema}, part int").repartitionById(n, F.col("part")).sortWithinPartitions(*order).drop("part")


def sorted_neighbours(docs: DataFrame, make, schema: str, keys: list[str], shared: bool) -> DataFrame:
    """Sort the rows that ``make`` gives by keys and place in ranges, and mark with ``again`` those whose keys an earlier row has.

    The first and last rows of all ranges (two a range) show where a key
    goes on. Only marked rows come back, without their keys, and with ``shared``
    also the first rows of keys whose first column another key has.
    """
    order = [*keys, "doc_id", "start"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, before, opened = None, None, (0, 0)  # the last row so far; the keys before it and where theirs came first

        def marked(frame: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, tuple]:
            columns = [frame[k].to_numpy() for k in keys]
            token = columns[0]
            same = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
            same = np.concatenate([[before is not None and all(b == c[0] for b, c in zip(before, columns, strict=True))], same])
            at = np.maximum.accumulate(np.where(same, -1, np.arange(len(frame))))
            # a repeated row has its likes' place and is no repeat of them
            places = [frame[c].to_numpy() for c in ("doc_id", "start")]
            first = [np.where(at >= 0, p[at], o) for p, o in zip(places, opened, strict=True)]
            again = (places[0] != first[0]) | (places[1] != first[1])
            edge = np.zeros(len(frame), dtype=bool)
            edge[0], edge[-1] = before is None, last
            alike = np.concatenate([[before is not None and before[0] == token[0]], token[1:] == token[:-1]])
            wanted = again | edge | ((alike | np.concatenate([alike[1:], [False]])) & shared)
            if not last:
                wanted[-1] = False
            out = frame.assign(again=again, edge=edge)
            for k, c in zip(keys, columns, strict=True):
                out[k] = np.where(again & ~edge, 0, c)
            return out[wanted], tuple(int(f[-2]) for f in first) if len(frame) > 1 else opened

        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(frame):
                continue
            out, opened_ = marked(frame, False)
            yield out
            held, opened = frame.iloc[[-1]], opened_
            if len(frame) > 1:
                before = tuple(frame[k].iloc[-2] for k in keys)
        if held is not None:
            yield marked(held, True)[0]

    found = stash(in_ranges(docs, make, schema, order).mapInPandas(compare, f"{schema}, again boolean, edge boolean"))
    release(docs.sparkSession)
    place = F.struct("doc_id", "start")
    # two rows a range at most
    earliest = F.broadcast(found.filter("edge").groupBy(*keys).agg(F.min(place).alias("_first")))
    joined = found.join(earliest, keys, "left")
    return joined.withColumn("again", F.col("again") | (F.col("edge") & F.coalesce(place != F.col("_first"), F.lit(False)))).drop("edge", "_first")


def _to_texts(docs: DataFrame, small: DataFrame, size: Column, how: str = "inner") -> DataFrame:
    """Join per-document results to the texts: by broadcast where their checked size allows it, else by shuffle."""
    small = stash(small)
    total = small.agg(F.sum(size + 16)).first()[0] or 0
    return docs.join(F.broadcast(small) if total <= BROADCAST_BYTES else small, "doc_id", how)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, starts and ends (arrays) of the windows that also start earlier, neighbours joined to stretches."""
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    rows = sorted_neighbours(texts, _suffix_rows, RUN, ["leading", "content"], True)
    # runs that repeat an earlier one whole
    whole = rows.filter("again").select("doc_id", "start", (F.col("start") + F.col("windows") + WINDOW - 1).alias("end"))
    firsts = rows.filter("not again")
    # different contents with one leading token: windows of the first run of each
    several = firsts.groupBy("leading").agg(F.countDistinct("content").alias("contents")).filter("contents > 1").select("leading")
    partly = firsts.join(several, "leading").groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    partly = partly.select("doc_id", F.col("runs.start").alias("first"), F.col("runs.windows").alias("count"))

    windows = _to_texts(texts, partly, F.size("first") * 16)
    single = sorted_neighbours(windows, _window_rows, "window long, doc_id long, start long", ["window"], False).filter("again").select("doc_id", "start", (F.col("start") + WINDOW).alias("end"))
    return whole.unionByName(single).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")).select("doc_id", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def _removed(n: int, starts, ends) -> np.ndarray:
    """Mask of the bytes under the stretches."""
    edge = np.zeros(n + 1, dtype=np.int32)
    if starts is not None and len(starts):
        np.add.at(edge, np.minimum(np.asarray(starts, dtype=np.int64), n), 1)
        np.add.at(edge, np.minimum(np.asarray(ends, dtype=np.int64), n), -1)
    return np.cumsum(edge[:-1]) > 0


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``starts`` and ``ends`` of the repeated stretches (null for none), in UTF-8 bytes.

    Null texts count as empty. A window repeats when it also starts earlier: in a
    smaller doc_id, or before in the same document; rows that repeat a doc_id are
    one document, and must have one text. Rows with a null id are neither
    searched nor changed.
    """
    found = repeats(docs)
    return _to_texts(docs, found, F.size("starts") * 16, "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, ends in batches:
            out = []
            for text, s, e in zip(texts, starts, ends, strict=True):
                raw = _bytes(text)
                gone = _removed(len(raw), s, e)
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                out.append((len(raw), int(gone.sum()), spans, sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return with_repeats(docs.select("doc_id", "text")).select("doc_id", cut("text", "starts", "ends").alias("c")).select("doc_id", "c.*")
