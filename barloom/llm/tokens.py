"""Exact token counts by prefix dynamic programming.

For byte-pair encoding, the last token of the encoding of a prefix is the one
token that ends there and is compatible with the last token of what precedes it
(two tokens are compatible when their joined text encodes to just these two).
So one pass over a pretoken gives the token count at each of its prefixes, and
sums over pretokens give it at each prefix of a text. Truncation and budget
questions are then look-ups; nothing is encoded again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a worker keeps before it starts its memory of pieces anew.
REMEMBERED = 400_000
LIMIT = 1024


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class PrefixCounter:
    """Token counts of texts and of all their prefixes for one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = set(spec["model"]["vocab"])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.made = {c: -1 for c in byte_letters()} | {a + b: i for (a, b), i in reversed(self.ranks.items())}
        self.halves = {a + b: (a, b) for a, b in reversed(self.ranks)}
        self.endings = ahocorasick.Automaton()
        for token in self.vocab:
            self.endings.add_word(token, (len(token), token))
        self.endings.make_automaton()
        self.letters = byte_letters()
        self.pattern = regex.compile(PATTERN)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.blank = regex.compile(r"\s")
        # a gap that reaches over a blank between two pieces
        self.wide_gap = regex.compile(r"\s \s|  |\s \Z")
        self.fits: dict[str, bool] = {}  # the letters of bytes hold no blank
        self.words: dict[str, bytes | tuple[int, ...]] = {}
        self.pieces: dict[str, int] = {}

    def merged(self, piece: str) -> list[str]:
        """Byte-pair encoding of a short piece by its definition."""
        parts = list(piece)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether no merge reaches over the border of two neighbouring tokens.

        Takes the merges that built the two tokens back, latest first, and asks
        each time if the parts that then touch would have merged before.
        """
        found = self.fits.get(left + " " + right)
        if found is not None:
            return found
        if not left:
            found = self.merged(right) == [right]
        else:
            a, b, before, found = left, right, 1 << 60, None
            made, halves, ranks = self.made, self.halves, self.ranks
            while found is None:
                joined = ranks.get((a, b))
                if joined is not None and joined < before:
                    found = False
                elif made[a] > made[b]:
                    before, a = made[a], halves[a][1]
                elif len(b) > 1:
                    before, b = made[b] + 1, halves[b][0]
                else:
                    found = True
        if len(self.fits) > 2 * REMEMBERED:
            self.fits.clear()
        self.fits[left + " " + right] = found
        return found

    def letter_counts(self, piece: str) -> list[int]:
        """Token counts after 0, 1, 2 ... byte letters of one pretoken."""
        n, fits = len(piece), self.fits
        last, counts, done = [""] * (n + 1), [0] * (n + 1), -1
        for at, (size, token) in self.endings.iter(piece):  # all tokens that end at each place, the longest first
            if at == done:
                continue
            left = last[at + 1 - size]
            ok = fits.get(left + " " + token)
            if ok if ok is not None else self.compatible(left, token):
                last[at + 1] = token
                counts[at + 1] = counts[at + 1 - size] + 1
                done = at
        return counts

    def word_counts(self, word: str) -> bytes | tuple[int, ...]:
        """Token counts after 0, 1, 2 ... characters of one pretoken."""
        found = self.words.get(word)
        if found is not None:
            return found
        letters = self.letters
        if word.isascii():
            counts = self.letter_counts("".join([letters[ord(c)] for c in word]))
        else:
            coded = [c.encode("utf-8", "surrogatepass") for c in word]
            inner = self.letter_counts("".join([letters[b] for c in coded for b in c]))
            counts, at = [0], 0
            for c in coded:
                at += len(c)
                counts.append(inner[at])
        if word[0] == "'" and len(word) == 3 and word[1].isalpha():
            # cut after its first letter, a contraction falls into two pretokens
            counts[2] = counts[1] + self.letter_counts(letters[ord(word[1])])[-1]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        self.words[word] = found = bytes(counts) if counts[-1] < 256 else tuple(counts)
        return found

    def piece_total(self, piece: str) -> int:
        """Tokens of a piece that the pattern splits on its own."""
        found = self.pieces.get(piece)
        if found is None:
            found = sum([self.word_counts(w)[-1] for w in self.pattern.findall(piece)])
            if len(self.pieces) > REMEMBERED:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """Ordinary stretches of a text, each with the length of the special token that follows it."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], m.end() - m.start()
            at = m.end()
        yield text[at:], 0

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        total = 0
        for part, special in self.segments(text or ""):
            total += special > 0
            if not part:
                continue
            if self.wide_gap.search(part):
                pieces = self.pattern.findall(part)
            else:  # a blank before a word begins a pretoken, so blanks can cut the text
                first, *rest = part.split(" ")
                pieces = [first, *[" " + p for p in rest]]
            try:
                total += sum(map(self.pieces.__getitem__, pieces))
            except KeyError:
                total += sum(map(self.piece_total, pieces))
        return total

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Exact token counts of the prefixes of 0, 1, 2 ... characters of a text.

        A prefix that cuts a special token's string has the count of its ordinary reading.
        """
        out, base = [0], 0
        for part, special in self.segments(text or ""):
            counts, gap, before = [0], 0, 0  # gap: where the run of white space that reaches here began
            for word in self.pattern.findall(part):
                own, start = self.word_counts(word), len(counts) - 1
                for k in range(1, len(word) + 1):
                    blank = self.blank.match(part[start + k - 1])
                    if not blank:
                        gap = start + k
                        counts.append(before + own[k])
                    else:
                        counts.append(counts[gap] + self.word_counts(part[gap : start + k])[-1])
                before += own[-1]
            total = before
            out += [base + c for c in counts[1:]]
            base += total
            if special:
                inside = self.prefix_counts_within(part, text, len(out) - 1, special, base, total)
                out += inside
                base += 1
                out[-1] = base
        return np.array(out, dtype=np.int64)

    def prefix_counts_within(self, part: str, text: str, start: int, special: int, base: int, total: int) -> list[int]:
        """Counts of prefixes that end inside a special token's string, read as ordinary text after its segment."""
        return [base - total + self.count(part + text[start : start + k]) for k in range(1, special + 1)]

    def fitting_prefix(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        return int(np.nonzero(self.prefix_counts(text) <= budget)[0][-1]) if budget >= 0 else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker and file, so that its memory serves all tasks."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row; null texts count as empty.

    Columns of those names in ``docs`` are replaced, others stay. Repeated rows
    count each, texts of any length are counted whole, and an empty table gives an
    empty result.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    out = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("n_tokens", tokens("text"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def with_prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``prefix_counts``: the exact token counts of the first 0, 1, 2 ... characters of each text.

    Written once, the column answers every question about budgets and places
    (``fitting``, ``truncate``, ``tokens_before``) without the tokenizer. It takes
    four bytes a character before compression. A null or empty text has the count
    of no characters alone; a column of that name is replaced.
    """

    @F.pandas_udf("array<int>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(path).prefix_counts
        for texts in batches:
            yield pd.Series([of(t).astype(np.int32) for t in texts], dtype=object)

    return docs.withColumn("prefix_counts", counts("text"))


def fitting(budget: int | Column) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, from the stored counts; 0 for a negative budget."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    places = F.transform("prefix_counts", lambda n, i: F.when(n <= limit, i))
    return F.coalesce(F.array_max(places), F.lit(0))


def tokens_before(characters: int | Column) -> Column:
    """Tokens of the first so many characters, from the stored counts; of all of them where there are fewer."""
    at = F.lit(characters) if isinstance(characters, int) else characters
    return F.get("prefix_counts", F.greatest(F.least(at, F.size("prefix_counts") - 1), F.lit(0)))


def truncate(counted: DataFrame, budget: int | Column) -> DataFrame:
    """Replace each text of a table with ``prefix_counts`` by its longest prefix of at most ``budget`` tokens; nulls stay.

    The counts are cut with it, so that a smaller budget can be asked next. Nothing
    is encoded again. Empty texts stay empty, repeated rows stay, texts of any
    length are treated alike, and an empty table gives an empty result.
    """
    cut = counted.withColumn("_n", fitting(budget))
    return cut.withColumns({"text": F.substring(F.col("text"), F.lit(1), F.col("_n")), "prefix_counts": F.slice("prefix_counts", F.lit(1), F.col("_n") + 1)}).drop("_n")
