"""Sizes of whole texts compressed block by block under fixed dictionaries."""

from __future__ import annotations

import xxhash
import zstandard as zstd

BLOCK = 1024
LEVEL = 3


class BlockSizer:
    """Compressed size of a text under each of several dictionaries.

    A text is cut into blocks, each compressed on its own, so that a long text
    is judged by the dictionaries throughout and not by its own beginning.
    """

    def __init__(self, dictionaries: list[bytes], kind: int, block: int = BLOCK, level: int = LEVEL):
        self.block = block
        self.compressors = []
        for data in dictionaries:
            known = zstd.ZstdCompressionDict(data, dict_type=kind)
            known.precompute_compress(level=level)
            self.compressors.append(zstd.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str | None) -> tuple[int, list[int]]:
        """UTF-8 bytes of the text, and its compressed bytes under each dictionary."""
        return self.sizes_of((text or "").encode("utf-8", "surrogatepass"))

    def sizes_of(self, raw: bytes) -> tuple[int, list[int]]:
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return len(raw), [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]


def spread(raw: bytes, size: int, piece: int, seed: int) -> list[bytes]:
    """Pieces from all over a text, ``size`` bytes in all: the text in equal strips and one piece of each, where a hash puts it."""
    if len(raw) <= size:
        return [raw[i : i + piece] for i in range(0, len(raw), piece)]
    many = max(1, size // piece)
    edges = [len(raw) * k // many for k in range(many + 1)]
    out = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        room = max(1, b - a - piece + 1)
        at = a + xxhash.xxh3_64_intdigest(k.to_bytes(4, "little"), seed=seed & (1 << 64) - 1) % room
        out.append(raw[at : at + piece])
    return out


def trained(samples: list[bytes], size: int = 112_640) -> bytes:
    """A zstandard dictionary trained on the samples; their raw bytes where training finds too little to work with."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(samples)[:size]
