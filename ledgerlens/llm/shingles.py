"""Word shingle sets of whole texts as 64-bit numbers (numpy, in tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BATCH_BYTES = 2 << 20
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what bytes.split
    and bytes.lower do."""
    return (text or "").encode().lower().split()


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle numbers of each text: of every n words in
    a row, or of the whole sequence where there are fewer; none without words."""
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(ws) for ws in lists])
    flat = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    hashes = known[flat.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    count = max(0, len(hashes) - n + 1)
    rolled = np.full(count, n, np.uint64)
    for k in range(n):
        rolled = rolled * _STEP + hashes[k : k + count]
    rolled = _finish(rolled)
    sets, at = [], 0
    for size in sizes.tolist():
        if size >= n:
            sets.append(np.unique(rolled[at : at + size - n + 1]))
        elif size:
            whole = np.full(1, size, np.uint64)
            for k in range(size):
                whole = whole * _STEP + hashes[at + k : at + k + 1]
            sets.append(_finish(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += size
    return sets


def set_number(tokens: np.ndarray) -> int:
    """A signed 64-bit number of a sorted set."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes()))))


def text_batches(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[list[tuple], list[str | None]]]:
    """(other columns, texts) of rows with about ``BATCH_BYTES`` of text."""
    rows, texts, held = [], [], 0
    for batch in batches:
        others = [c.to_pylist() for i, c in enumerate(batch.columns) if i != text_at]
        for i, text in enumerate(batch.column(text_at)):
            rows.append(tuple(c[i] for c in others))
            texts.append(text.as_py())
            held += len(texts[-1] or "")
            if held >= BATCH_BYTES:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts
