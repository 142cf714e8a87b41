"""Packing of tokenised documents into sequences by sum of squares.

A document's ids and a closing id are cut into pieces of the sequence length; only
the last piece of each can share a sequence. Only lengths matter for that: blocks
of pieces are packed on their own, each piece where the sum of the squared numbers
of open sequences per free length becomes smallest. Sequences with room left over
go on to further rounds, in blocks that mix those of many earlier blocks, and are
packed anew where that takes fewer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches, stash
from barloom.llm.tokens import byte_letters

ROOM = 2048
CLOSING = 0
#: Pieces that are packed together.
BLOCK = 4096
#: Sequences with at most this share free are settled in the round that filled them.
SPARE = 1 / 256
ROUNDS = 3
#: Chunks whose ids a worker keeps before it starts its memory anew; longer chunks are encoded each time.
REMEMBERED = 1_000_000
CHUNK = 60
#: Bytes of a text whose chunks are held at once.
PIECE = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: A Latin word (of letters only, no more than CHUNK bytes) and ASCII punctuation after it, but for what begins a contraction or a special token.
_WORD = re.compile(rb"((?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]){1,60})([!-&(-/:;=?@\[-`{}~]*)")
_BYTES = 4  # of an id
_NONE = 1 << 60


class ChunkEncoder:
    """Ids of texts from those of their chunks between blanks, for tokenizers that drop blanks and split there.

    Most chunks are one Latin word with punctuation after it. Such a word is one
    pretoken whatever follows, so the library's model gets it as it is, in lower
    case and in the letters that stand for its bytes; all else goes through the
    library's whole encoding.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.four = [k.to_bytes(_BYTES, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def encoded(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def word_ids(self, word: bytes) -> bytes:
        """The ids of a Latin word, which is one pretoken."""
        text = word.decode()
        if not text.isascii():
            text = "".join([self.letters[b] for b in text.lower().encode()])
        four = self.four
        return b"".join([four[token.id] for token in self.model.tokenize(text)])

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """The ids of new chunks."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        words, split, rest, tails = self.words, [], [], set()
        for c in chunks:
            m = _WORD.fullmatch(c)
            if m is None:
                rest.append(c)
                continue
            word, tail = m.groups()
            word = word.lower()  # A-Z only, as the tokenizer does
            found = words.get(word)
            if found is None:
                words[word] = found = self.word_ids(word)
            split.append((c, found, tail))
            tails.add(tail)
        rest += tails.difference(self.known, chunks, [b""])
        out = dict(zip(rest, self.encoded(rest), strict=True)) if rest else {}
        ends = {tail: out[tail] if tail in out else self.known.get(tail, b"") for tail in tails}
        out.update((c, found + ends[tail]) for c, found, tail in split)
        return out

    def ids(self, text: bytes | None) -> Iterator[bytes]:
        """Little-endian ids of a text, part by part."""
        raw, at, known = text or b"", 0, self.known
        if b"<|" not in raw:  # no special token, whose case would count
            raw = raw.lower()
        while at < len(raw):
            gap = _BLANK.search(raw, at + PIECE)
            end = gap.start() if gap else len(raw)
            chunks = raw[at:end].split()
            try:
                yield b"".join(map(known.__getitem__, chunks))
            except KeyError:
                new = set(chunks).difference(known)
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = set(chunks)
                known.update(self.learn(new))
                yield b"".join(map(known.__getitem__, chunks))
                for chunk in new:
                    if len(chunk) > CHUNK:
                        del known[chunk]
            at = end


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker and file, so that its memory serves all tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def cut(docs: DataFrame, path: str, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id (as text), piece, start, length, ids_crc32 and, if wanted, ids.

    A document's ids are those of the tokenizer and a closing 0, so that null and
    empty texts have one. Every piece but the last of a document is full.
    """
    small_batches(docs.sparkSession)
    width = room * _BYTES

    def parts(text: bytes | None) -> Iterator[bytes]:
        held = b""
        for more in encoder(path).ids(text):
            held += more
            full = (len(held) - 1) // width if held else 0  # whether a full rest is the last piece is not known yet
            for k in range(full):
                yield held[k * width : (k + 1) * width]
            held = held[full * width :]
        held += CLOSING.to_bytes(_BYTES, "little")
        yield held[:width]
        if len(held) > width:
            yield held[width:]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place, rows, ids = [], [], []
            for k, text in enumerate(batch["t"]):
                start = 0
                for number, part in enumerate(parts(text)):
                    place.append(k)
                    rows.append((number, start, len(part) // _BYTES, crc32(part)))
                    start += len(part) // _BYTES
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"], dtype="int64")
            out["doc_id"] = batch["i"].iloc[place].to_numpy()
            yield out.assign(ids=ids) if with_ids else out

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).mapInPandas(pieces, schema)


def sum_of_squares(sizes: np.ndarray, room: int, open_first: bool) -> np.ndarray:
    """The bin of each size, in the given order.

    ``open[g]`` counts open bins with g free. A size s moves a bin from free
    length g to g - s, or opens one, where the sum of open[g] ** 2 over free lengths
    of 1 and more becomes smallest; equals go to the fullest. With
    ``open_first`` a bin opens only where no open one has the room.
    """
    free = np.zeros(room + 1, dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(room + 1)]
    out, made = np.empty(len(sizes), dtype=np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        counts = free[s:room]
        cost = 2 * (free[: room - s] - counts + 1)
        if len(cost):
            cost[0] = 1 - 2 * counts[0]  # a full bin does not count
        cost[counts == 0] = _NONE
        best = int(cost.argmin()) if len(cost) else -1
        fresh = 2 * int(free[room - s]) + 1 if s < room else 0
        if best >= 0 and cost[best] < _NONE and (open_first or cost[best] <= fresh):
            free[best + s] -= 1
            at, rest = bins[best + s].pop(), best
        else:
            at, rest, made = made, room - s, made + 1
        if rest:
            free[rest] += 1
            bins[rest].append(at)
        out[k] = at
    return out


def packed(sizes: np.ndarray, room: int) -> np.ndarray:
    """The bin of each size: the better of longest first into open bins, and the plain rule in the given order."""
    falling = np.argsort(-sizes, kind="stable")
    first = np.empty(len(sizes), dtype=np.int64)
    first[falling] = sum_of_squares(sizes[falling], room, True)
    if first.max(initial=-1) + 1 <= -(-int(sizes.sum()) // room):
        return first
    second = sum_of_squares(sizes, room, False)
    return second if second.max(initial=-1) < first.max(initial=-1) else first


def _round(rows: DataFrame, blocks: int, salt: int, room: int) -> DataFrame:
    """Pack each block of rows anew; where that takes no fewer sequences, they stay as they are."""

    def pack_block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_item", kind="stable").reset_index(drop=True)
        order = part["_item"].to_numpy(dtype=np.int64)
        before = part["sequence_id"].to_numpy(dtype=np.int64)
        sizes = part["length"].to_numpy(dtype=np.int64)
        new = packed(sizes, room)
        if len(np.unique(before)) > new.max() + 1:
            first = np.full(new.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, new, order)
            part["sequence_id"] = first[new]
            groups = part.groupby("sequence_id")["length"]
            part["offset"] = groups.cumsum() - part["length"]
            part["_filled"] = groups.transform("sum")
        return part.drop(columns="_block")

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("sequence_id", F.lit(salt)), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(pack_block, rows.schema)


def pack(docs: DataFrame, path: str, room: int = ROOM, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` if wanted.

    Only documents of more than ``room`` ids are cut. A full piece is a sequence of
    its own; the others share sequences, gapless from offset 0. A sequence's id is
    the smallest number of its pieces, which are numbered as they are written.
    Null and empty texts have one id, the closing 0; null ids and repeated rows are
    documents of their own; texts of any length are read whole. An empty table
    gives an empty result; other columns of ``docs`` are ignored.
    """
    written = stash(cut(docs, path, room, with_ids).withColumn("_item", F.monotonically_increasing_id()))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = written.select(*columns, "_item", F.col("_item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("_filled"))
    done, rest = [alone.filter(F.col("length") == room)], alone.filter(F.col("length") < room)
    for salt in range(ROUNDS):
        blocks = max(1, -(-rest.count() // block))
        now = stash(_round(rest, blocks, salt, room))
        if blocks == 1 or salt == ROUNDS - 1:
            done.append(now)
            break
        settled = F.col("_filled") >= room * (1 - SPARE)
        done.append(now.filter(settled))
        rest = now.filter(~settled)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    if with_ids:
        out = out.join(written.select("_item", "ids"), "_item")
    return out.drop("_item", "_filled").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id`` and its ``ids``, at most as many as a sequence holds, from pieces that carry theirs."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
