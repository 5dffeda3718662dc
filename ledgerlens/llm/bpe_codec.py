"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding
by the token-byte table.

A pre-token (a match of the pattern, a "word") is encoded on its own, so
every distinct word needs one encoding for the whole corpus:

1. Scan tasks cut their rows into chunks of bounded size.  A chunk's
   distinct words are sorted by (hash part, word) and leave as one packed
   row per part: the positions stay behind, only words are shuffled.
2. The tasks of a part encode each distinct word once, whichever chunks
   have it, and send the ids back in the order of the words.
3. Each chunk's documents, as packed word numbers in order of position,
   meet the chunk's ids; each word number is replaced by the ids of its
   word and the documents are reassembled by position.

Steps 1 and 3 read the same chunks in two scans; a checksum over the words
travels with both and a difference ends the job.  No row or key is hot: a
frequent word is one entry per chunk, and words spread by their hash.

Words are found without matching the pattern at every position: before a
blank that is followed by a non-blank character there is always a word
border, so a text is first split there, and the pattern runs once per
distinct piece of a chunk.  Texts with other blanks around a space are
matched as a whole.

Defined cases: a null or empty text has no ids (an empty list); rows that
repeat or have null ids are encoded like any other; very long texts are
encoded whole and end their chunk; extra columns are ignored; an empty
table gives an empty result.  Special tokens are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import byte_bpe
from ledgerlens.llm.packed import by_hash_part, pack_words, ragged, squeeze, unpack_words, unsqueeze

CHUNK_BYTES = 8 << 20  # text of a chunk; a chunk ends with the row that reaches it
BUNDLE_WORDS = 1 << 16  # packed words of one row of documents
IDS, ORDER, DOCS = 0, 1, 2

_compile = lru_cache(maxsize=4)(regex.compile)
_odd_blank = regex.compile(r" (?:\s|\Z)")


# --------------------------------------------------------------- chunks


@dataclass
class Chunk:
    """Documents of one chunk as word numbers."""

    docs: list = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    held: int = 0

    def add(self, doc, text: str | None) -> bool:
        self.docs.append(doc)
        self.texts.append(text or "")
        self.held += len(self.texts[-1]) + 64
        return self.held >= CHUNK_BYTES

    def split(self, pattern: str):
        """Per document its first words and its further pieces."""
        find = _compile(pattern).findall
        for text in self.texts:
            if _odd_blank.search(text):
                yield find(text), []
            else:
                first, *pieces = text.split(" ")
                yield find(first), pieces

    def word_set(self, pattern: str) -> list[bytes]:
        firsts, pieces = [], set()
        for first, rest in self.split(pattern):
            firsts += first
            pieces.update(rest)
        words = pa.array(firsts + piece_words(list(pieces), pattern), pa.string())
        return words.unique().cast(pa.binary()).to_pylist()

    def numbered(self, pattern: str, parts: int):
        """The words by part, and every document's words as places in them."""
        firsts, n_first, flat, blocks, counts = [], [], [], [], []
        for first, rest in self.split(pattern):
            firsts += first
            n_first.append(len(first))
            flat += rest
            counts.append(len(rest))
            if len(flat) > 1 << 18:
                blocks.append(pa.array(flat, pa.string()))
                flat = []
        blocks.append(pa.array(flat, pa.string()))
        pieces = pa.concat_arrays(blocks).dictionary_encode()
        del blocks, flat
        words = pa.array(piece_words(pieces.dictionary.to_pylist(), pattern) + firsts, pa.string())
        encoded = words.dictionary_encode()
        own = encoded.dictionary.cast(pa.binary()).to_pylist()
        by_part = by_hash_part(own, parts)
        place = {w: i for i, w in enumerate(w for part in by_part for w in part)}
        places = np.array([place[w] for w in own], np.int64)[encoded.indices.to_numpy()]
        # A piece starts with the only word of it that starts with a blank.
        n_words = len(words) - len(firsts)
        starts = np.flatnonzero(pc.starts_with(words.slice(0, n_words), " ").to_numpy(zero_copy_only=False))
        lengths = np.diff(np.append(starts, n_words))
        of_pieces = pieces.indices.to_numpy()
        # Per document its first words, then the words of its pieces.
        n_first, counts = np.array(n_first), np.array(counts)
        spans = np.zeros(len(of_pieces) + len(n_first), np.int64)
        begins = np.zeros(len(spans), np.int64)
        lead = np.cumsum(counts) - counts + np.arange(len(counts))
        rest = np.ones(len(spans), bool)
        rest[lead] = False
        spans[lead], begins[lead] = n_first, n_words + np.cumsum(n_first) - n_first
        spans[rest], begins[rest] = lengths[of_pieces], starts[of_pieces]
        totals = np.add.reduceat(spans, lead)
        return by_part, ragged(places, begins, spans), totals


def piece_words(pieces: list[str], pattern: str) -> list[str]:
    """The words of pieces that each follow a blank, in order: one match run
    over all of them, since a border precedes every such blank."""
    return _compile(pattern).findall(" " + " ".join(pieces)) if pieces else []


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    """The chunks of a task.  A chunk's number comes from the scan partition
    (a column: the task's own number differs below a union)."""
    number, chunk = None, Chunk()
    for batch in batches:
        if number is None and batch.num_rows:
            number = batch.column(2)[0].as_py() << 32
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if chunk.add(doc, text.as_py()):
                yield number, chunk
                number, chunk = number + 1, Chunk()
    if chunk.docs:
        yield number, chunk


# ----------------------------------------------------------------- steps


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None,
           pattern: str | None = None, parts: int | None = None) -> DataFrame:
    """The id and ``ids`` (token ids of the whole text) of every row."""
    spark = df.sparkSession
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    parts = parts or min(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_type = df.schema[id_col].dataType.simpleString()
    texts = df.select(id_col, text_col, F.spark_partition_id().alias("__scan"))

    def word_rows(batches):
        for number, chunk in chunks(batches):
            rows = []
            for part, words in enumerate(by_hash_part(chunk.word_set(pattern), parts)):
                if words:
                    rows.append((part, number, len(words), *pack_words(words)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5,
                                                (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                ["part", "chunk", "n", "packed", "mark"])

    def id_rows(batches):
        encoder, known, at = byte_bpe.encoder(path, pattern), {}, None
        for batch in batches:
            rows = []
            for part, number, n, packed, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    known, at = {}, part
                lists = []
                for word in unpack_words(packed, n):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encoder.encode_ordinary(word.decode())
                    lists.append(ids)
                lengths = np.array([len(x) for x in lists], np.uint32)
                flat = np.array([i for x in lists for i in x], np.uint32)
                rows.append((number, IDS, part, n, len(flat), mark, None, squeeze(lengths, flat)))
            if rows:
                yield _packed_batch(rows, None)

    def doc_rows(batches):
        for batch_id_type, number, chunk in _typed_chunks(batches):
            by_part, numbers, totals = chunk.numbered(pattern, parts)
            n_words = sum(map(len, by_part))
            mark = sum(pack_words(words)[1] for words in by_part if words)
            # Frequent words get small numbers, which pack better.
            order = np.argsort(-np.bincount(numbers, minlength=n_words), kind="stable")
            small = np.empty(n_words, np.int64)
            small[order] = np.arange(n_words)
            rows = [(number, ORDER, 0, n_words, 0, mark, None, squeeze(order))]
            ends = np.cumsum(totals)
            first, at = 0, 0
            while first < len(totals):
                last = max(first + 1, int(np.searchsorted(ends, at + BUNDLE_WORDS, "right")))
                own = small[numbers[at : ends[last - 1]]]
                rows.append((number, DOCS, first, last - first, len(own), 0, chunk.docs[first:last],
                             squeeze(totals[first:last], own)))
                first, at = last, int(ends[last - 1])
            for k in range(0, len(rows), 64):
                yield _packed_batch(rows[k : k + 64], batch_id_type)

    def documents(batches):
        chunk_at = None
        for batch in batches:
            for number, kind, seq, n, m, mark, docs, packed in zip(*(batch.column(i) for i in range(8)), strict=True):
                number, kind, n, m, mark, packed = (x.as_py() for x in (number, kind, n, m, mark, packed))
                if number != chunk_at:
                    chunk_at, lengths, flat, marks = number, [], [], 0
                if kind == IDS:
                    a, b = unsqueeze(packed, n, m)
                    lengths.append(a)
                    flat.append(b)
                    marks += mark
                elif kind == ORDER:
                    (order,) = unsqueeze(packed, n)
                    if marks != mark or sum(map(len, lengths)) != n:
                        raise RuntimeError(f"chunk {number}: its two scans found different words")
                    word_lengths = np.concatenate([*lengths, np.zeros(0, np.int64)])
                    ids = np.concatenate([*flat, np.zeros(0, np.int64)]).astype(np.int32)
                    word_starts = (np.cumsum(word_lengths) - word_lengths)[order]
                    word_lengths = word_lengths[order]
                else:
                    totals, own = unsqueeze(packed, n, m)
                    sizes = word_lengths[own]
                    per_doc = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(totals))]
                    yield pa.RecordBatch.from_arrays(
                        [docs.values, pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), pa.array(ragged(ids, word_starts[own], sizes)))],
                        [id_col, "ids"])

    packed_schema = f"chunk long, kind int, seq int, n long, m long, mark long, docs array<{id_type}>, packed binary"
    words = texts.mapInArrow(word_rows, "part int, chunk long, n long, packed binary, mark long")
    found = words.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(id_rows, packed_schema)
    packed = texts.mapInArrow(doc_rows, packed_schema)
    return (
        found.unionByName(packed)
        .repartition("chunk")
        .sortWithinPartitions("chunk", "kind", "seq")
        .mapInArrow(documents, f"`{id_col}` {id_type}, ids array<int>")
    )


def _packed_batch(rows: list[tuple], id_type: pa.DataType | None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(id_type or pa.int64()), pa.binary())
    names = ["chunk", "kind", "seq", "n", "m", "mark", "docs", "packed"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _typed_chunks(batches):
    kind = None

    def noting():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    for number, chunk in chunks(noting()):
        yield kind, number, chunk


def decoded(ids: Column, vocabulary: str | None = None) -> Column:
    """The bytes of a list of token ids, from the token-byte table (a table
    of the fixed size of the vocabulary, loaded once per worker)."""
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    @F.pandas_udf("binary")
    def join_bytes(lists: pd.Series) -> pd.Series:
        table = byte_bpe.token_bytes(path)
        return lists.map(lambda a: None if a is None else b"".join([table[i] for i in a.tolist()]))

    return join_bytes(ids)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"),
    )
