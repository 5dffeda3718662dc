"""Packing documents into training sequences by order-preserving dynamic
programming.

Each scan task turns its documents, in order, into one stream of token ids
(a document's ids, then the end id) and cuts it into windows of at most
``capacity`` tokens.  Cuts may fall after a document (free), after a
sentence (a small penalty) or, where no sentence ends for a while, on a
grid (a larger penalty).  A window costs its padding (none where its length
is a power of two, else up to the capacity), plus the penalty of its last
cut, plus a constant for each window.  With ``best[i]`` the least cost up
to cut ``i``,

    best[i] = min over j of best[j] + capacity - (p[i] - p[j]) + penalty[i] + constant,

over cuts ``j`` at most ``capacity`` tokens back: the minimum of
``best[j] + p[j]`` over a sliding window, kept in a monotone queue.
Unpadded windows of a power of two are looked up by position.

The stream is solved in blocks that end at the first document end after
``block_tokens`` tokens, so memory is bounded by a block and the longest
document.  There is no shuffle; a sequence belongs to one task, and a lost
task repacks the same documents the same way.

Ids are those of the ``tokenizers`` file, whose added tokens (such as
``<|endoftext|>``) are one id each wherever a text spells them.

Defined cases: a null text counts as empty and is one end id; rows that
repeat or have null ids are packed like any other; a text longer than a
sequence is cut into several; an empty table gives no pieces; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import byte_bpe


@dataclass(frozen=True)
class Costs:
    capacity: int = 1024
    sentence: float = 2.0
    hard: float = 12.0
    window: float = 8.0
    grid: int = 64  # a stretch without sentence ends longer than this gets hard cuts


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, costs: Costs):
    """Positions where the stream may be cut, from 0 to its length, and
    their penalties."""
    penalty = np.full(len(ids) + 1, np.inf, np.float32)
    after = np.flatnonzero(ends_sentence[ids]) + 1
    penalty[after] = costs.sentence
    penalty[doc_ends - 1] = np.inf  # not between a text and its end id
    penalty[0] = penalty[doc_ends] = 0.0
    places = np.flatnonzero(np.isfinite(penalty))
    gaps = np.diff(places)
    extra = (gaps - 1) // costs.grid  # further places in each gap
    first = np.repeat(places[:-1], extra)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    penalty[first + nth * costs.grid] = costs.hard
    places = np.flatnonzero(np.isfinite(penalty))
    return places, penalty[places]


def best_cuts(places: np.ndarray, penalties: np.ndarray, costs: Costs) -> np.ndarray:
    """Positions of the cuts of least cost, with 0 and the end."""
    at, pen, capacity = places.tolist(), penalties.tolist(), costs.capacity
    powers = [1 << k for k in range(6, capacity.bit_length()) if 1 << k <= capacity]
    index = np.full(at[-1] + 1, -1, np.int32)
    index[places] = np.arange(len(at))
    # For each place and power of two: the place that far back, or -1.
    backs = [index[np.maximum(places - p, 0)] * (places >= p) - (places < p) for p in powers]
    backs = np.stack(backs, 1).tolist() if backs else [[]] * len(at)
    best, came, queue = [0.0] * len(at), [0] * len(at), deque()
    for i in range(1, len(at)):
        value = best[i - 1] + at[i - 1]
        while queue and best[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(i - 1)
        here = at[i]
        while here - at[queue[0]] > capacity:
            queue.popleft()
        j = queue[0]
        least = best[j] + at[j] + capacity - here
        for back in backs[i]:
            if back >= 0 and best[back] < least:
                least, j = best[back], back
        best[i], came[i] = least + pen[i] + costs.window, j
    cuts, i = [at[-1]], len(at) - 1
    while i:
        i = came[i]
        cuts.append(at[i])
    return np.array(cuts[::-1])


def pack_block(docs: list[tuple[object, np.ndarray]], first_sequence: int, ends_sentence: np.ndarray, costs: Costs):
    """Rows (doc, start, length, crc, doc tokens, sequence, offset) of one
    block of documents, and the number of sequences it makes."""
    ids = np.concatenate([d[1] for d in docs])
    doc_ends = np.cumsum([len(d[1]) for d in docs])
    doc_starts = doc_ends - [len(d[1]) for d in docs]
    cuts = best_cuts(*cut_places(ids, doc_ends, ends_sentence, costs), costs)
    starts = np.union1d(cuts[:-1], doc_starts)
    lengths = np.diff(np.append(starts, len(ids)))
    doc = np.searchsorted(doc_starts, starts, "right") - 1
    sequence = np.searchsorted(cuts, starts, "right") - 1
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    columns = {
        "doc": [docs[i][0] for i in doc.tolist()],
        "start": starts - doc_starts[doc],
        "length": lengths,
        "ids_crc32": np.array(crcs, np.int64),
        "doc_tokens": (doc_ends - doc_starts)[doc],
        "sequence_id": first_sequence + sequence,
        "offset": starts - cuts[sequence],
    }
    return columns, len(cuts) - 1


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None,
         costs: Costs = Costs(), end_id: int = 0, block_tokens: int = 1 << 18) -> DataFrame:
    """Pieces of all documents of ``df``, in the order of its partitions."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    pattern = public_tokenizers.PATTERN
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe.encoder(path, pattern)
        table = byte_bpe.token_bytes(path)
        ends_sentence = np.array([t.endswith((b".", b"!", b"?", b"\n")) for t in table])
        sequence = TaskContext.get().partitionId() << 40
        docs, held = [], 0

        def flush():
            nonlocal docs, held, sequence
            columns, made = pack_block(docs, sequence, ends_sentence, costs)
            docs, held, sequence = [], 0, sequence + made
            names = [id_col, *list(columns)[1:]]
            return pa.RecordBatch.from_arrays([pa.array(columns["doc"], ids_type), *map(pa.array, list(columns.values())[1:])], names)

        for batch in batches:
            ids_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = encode.encode_to_numpy(text.as_py() or "", allowed_special="all")
                docs.append((doc, np.append(found, end_id).astype(np.uint32)))
                held += len(docs[-1][1])
                if held >= block_tokens:
                    yield flush()
        if docs:
            yield flush()

    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
