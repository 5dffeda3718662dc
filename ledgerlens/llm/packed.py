"""Packed rows: many numbers or words of one chunk in one binary value."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import zstandard


def squeeze(*arrays: np.ndarray) -> bytes:
    """Non-negative numbers as compressed byte planes; each array takes as
    many planes as its largest number needs."""
    heads, planes = [], []
    for a in arrays:
        a = np.asarray(a, np.int64)
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        heads.append(width)
        planes += [((a >> (8 * k)) & 255).astype(np.uint8).tobytes() for k in range(width)]
    return bytes(heads) + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def unsqueeze(data: bytes, *lengths: int) -> list[np.ndarray]:
    """The arrays of ``squeeze``, given their lengths."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[len(lengths):]), np.uint8)
    out, at = [], 0
    for n, width in zip(lengths, data[: len(lengths)], strict=True):
        a = np.zeros(n, np.int64)
        for k in range(width):
            a |= raw[at : at + n].astype(np.int64) << (8 * k)
            at += n
        out.append(a)
    return out


def pack_words(words: list[bytes]) -> tuple[bytes, int]:
    """The words in one value, and a checksum over them."""
    raw = np.array([len(w) for w in words], np.uint32).tobytes() + b"".join(words)
    return zstandard.ZstdCompressor(level=3).compress(raw), zlib.crc32(raw)


def unpack_words(packed: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64) + 4 * n
    starts = np.append(4 * n, ends[:-1]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``values`` one after another."""
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(int(lengths.sum()))]


def by_hash_part(words: Iterable[bytes], parts: int) -> list[list[bytes]]:
    """The words of each hash part, sorted."""
    by_part: list[list[bytes]] = [[] for _ in range(parts)]
    for word in words:
        by_part[zlib.crc32(word) % parts].append(word)
    for own in by_part:
        own.sort()
    return by_part
