"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its labelled texts. Texts are
compressed in lower case with a space for each ASCII character that is no
letter. A text belongs to the language whose dictionary makes it smallest; when the margin
to the second is narrow the prediction is marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import beside, bounded_sample, held_out
from barloom.llm.zstd_blocks import BlockSizer, spread

#: Bounds of the labelled sample: texts of each language, and texts of all together (each language has one at least).
SAMPLE_PER_LANG = 800
SAMPLE_IN_ALL = 100_000
DICTIONARY_BYTES = 65_536
#: A dictionary takes this many bytes at least from a text, at a hashed place anywhere in it.
PIECE = 80
BLOCK = 2048
LEVEL = 6
#: A margin below this share of the smallest size is narrow.
NARROW = 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(SPACED)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def fit(docs: DataFrame, mod: int = 4, remainder: int = 2, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Build a dictionary for each language from a bounded sample of rows that are not held out.

    Rows without text, language or id are ignored. Every language that is left is
    learned, whatever their number; a dictionary has an equal share of each
    sampled text, taken from places all over the text. Rows of one id and
    language with several texts lend the least of them. An empty table gives a
    model without languages.
    """
    known = docs.filter(~held_out("doc_id", mod, remainder) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    many = known.select("lang").distinct().count()
    per_lang = max(1, min(per_lang, SAMPLE_IN_ALL // max(1, many)))
    # at most max(SAMPLE_IN_ALL, number of languages) ids
    ids = F.broadcast(bounded_sample(known, "doc_id", "lang", per_lang))
    share = max(PIECE, DICTIONARY_BYTES // per_lang)

    @F.pandas_udf("binary")
    def pieces(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([b"\n".join(spread(plain(t), share, PIECE, int(k))) for t, k in zip(texts, seeds, strict=True)], dtype=object)

    sampled = known.join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sampled.select("doc_id", "lang", pieces("text", F.xxhash64("doc_id")).alias("pieces")).collect()
    parts: dict[str, list[tuple]] = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append((r["doc_id"], bytes(r["pieces"])))
    langs = tuple(sorted(parts))
    shares = {k: max(1, DICTIONARY_BYTES // len(v)) for k, v in parts.items()}
    return LanguageModel(langs, tuple(b"\n".join(t[: max(PIECE, shares[k])] for _, t in sorted(parts[k]))[:DICTIONARY_BYTES] for k in langs))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to every row.

    ``score`` is a softmax of the compressed sizes relative to the text's bytes.
    Texts that are null or hold no letter are ``und`` with score 0, and so is
    everything when no language was learned. Ties go to the first language by
    name. Texts are compressed whole, block by block. Repeated rows get the same
    answer, an empty table an empty result. Columns of those names in ``docs``
    are replaced, all others stay.
    """
    langs, dictionaries = model.langs, model.dictionaries

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizer = BlockSizer(list(dictionaries), zstd.DICT_TYPE_RAWCONTENT, BLOCK, LEVEL) if langs else None
        for texts in batches:
            out = []
            for text in texts:
                if not text or sizer is None or not LETTER.search(text):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                n, sizes = sizer.sizes_of(plain(text))
                low = np.array(sizes, dtype=float)
                best = int(low.argmin())
                odds = np.exp(-np.clip((low - low[best]) / max(n, 1) * 40, 0, 60))
                second = np.partition(low, 1)[1] if len(low) > 1 else np.inf
                out.append((langs[best], float(odds[best] / odds.sum()), bool(second - low[best] < NARROW * low[best])))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return beside(docs, predict("text"), ["lang_pred", "score", "rejected"])
