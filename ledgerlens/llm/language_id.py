"""Language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy, with a calibrated
rejection.

A text is the bag of its byte 2-, 3- and 4-grams (lower case, blanks as
word borders), hashed into ``BUCKETS`` buckets.  The model averages the
bucket embeddings and applies a linear softmax.  Because averaging and the
linear layer commute, prediction uses one precomputed score row per bucket:
one pass over the whole text.

Training uses a bounded sample of the labelled rows, all languages among
them: ``per_language`` rows of each, fewer where that would be more than
``max_rows`` together, but ``LEAST_ROWS`` of any language and no more than
``sample_bytes`` of features (documented parameters; everything else covers
all rows).  Only counts, and the features of the sampled rows, are shuffled;
one task trains and the driver gets the model alone, one column of
``BUCKETS`` numbers per language.  Rows with the label ``und`` teach nothing.
One in five sample rows is kept out of training: they set the temperature of
the softmax and two rejections:

* by probability: the ``reject_share`` quantile of the calibrated probability
  of rightly labelled rows, never over ``times_even`` times that of a guess;
* by fit: how much more likely the text's n-grams are in the training rows of
  the predicted language than at random, on average, with an allowance for
  short texts and relative to the language's middle.  The threshold lies half
  way from the ``reject_share`` quantile of clean held-out rows (whole and cut
  short) to the median of negatives: the rows' letters shuffled, and rows of
  each language under a model without it.  Where the two overlap the clean
  rows decide.  A sample of fewer than ``LEAST_HELD``
  rows rejects nothing by fit.

Defined cases: a null text or one without a letter is ``und`` with score 0
and rejected; without any labelled row every text is ``und``; rows that
repeat or have null ids are predicted like any other; very long texts are
used whole, in Arrow batches of bounded bytes.  Ties between languages go to the first in sorted order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_bucket, small_batches, written_small

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
ORDERS = (2, 3, 4)
UNKNOWN = "und"
LEAST_HELD = 50  # sample rows from which some are kept out of training
SHORT_TEXTS = 2.0  # allowance for short texts, in standard deviations of one n-gram over the root of their number
PASSES = 8  # least passes over the training rows
LEAST_ROWS = 20  # sample rows of a language, however many languages there are


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    bucket_scores: np.ndarray | None = None  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0
    ratios: np.ndarray | None = None  # languages x BUCKETS: log of a bucket's share in the language times BUCKETS
    middle: np.ndarray | None = None
    spread: np.ndarray | None = None
    least_fit: float = -np.inf

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = (counts @ self.bucket_scores / max(counts.sum(), 1.0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def fit(self, counts: np.ndarray, language: int) -> float:
        total = max(float(counts.sum()), 1.0)
        return float(counts @ self.ratios[language] / total + SHORT_TEXTS * self.spread[language] / total**0.5 - self.middle[language])

    def accepts(self, counts: np.ndarray, language: int, probability: float) -> bool:
        return probability >= self.threshold and (self.ratios is None or self.fit(counts, language) >= self.least_fit)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket is hit by the byte n-grams of the text."""
    raw = f" {text.lower()} ".encode("utf-8", "replace")
    codes = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.float32)
    for n in ORDERS:
        if len(codes) < n:
            break
        gram = np.full(len(codes) - n + 1, n, np.uint32)
        for k in range(n):
            gram = gram * np.uint32(0x01000193) ^ codes[k : len(codes) - n + 1 + k]
        counts += np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    return counts


def shuffled(text: str, seed: int) -> str:
    """Noise with the letters of the text."""
    return "".join(np.random.default_rng(seed).permutation(list(text))) if text else ""


def _bag(text: str) -> tuple[bytes, bytes]:
    counts = subword_counts(text)
    found = np.flatnonzero(counts)
    return found.astype("<u2").tobytes(), counts[found].astype("<f4").tobytes()


def calibration_bags(text: str, mark: int) -> list[tuple[bytes, bytes]]:
    return [_bag(text[: 8 << mark % 6]), _bag(shuffled(text[:2000], mark % (1 << 32)))]


def labelled_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str,
                    per_language: int, max_rows: int) -> tuple[DataFrame | None, int]:
    """Sparse feature counts of sampled rows (``lang``, ``mark``, ``bucket``,
    ``hits``, ``calibration``) and the number wanted of each language.

    Each language takes the distinct rows whose hash lies in the share of the
    hash range that holds its part of the sample on average, and at most
    twice that part."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(lang_col) != UNKNOWN)).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("mark"), F.col(text_col).alias("text"))
    # One row per language: a fraction of the model's own size.
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()
    if not sizes:
        return None, 0
    each = max(LEAST_ROWS, min(per_language, max_rows // len(sizes)))
    cuts = df.sparkSession.createDataFrame([(r.lang, min(1.0, each / r.rows)) for r in sizes], "lang string, share double")
    picked = labelled.join(F.broadcast(cuts), "lang").where((F.col("mark") / 2.0**64 + 0.5) <= F.col("share"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[int]] = {}
        for batch in batches:
            rows = []
            for lang, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = seen.setdefault(lang, set())
                if mark not in own and len(own) < 2 * each:
                    own.add(mark)
                    bucket, hits = _bag(text)
                    if bucket:
                        rows.append((lang, mark, bucket, hits, [
                            {"bucket": b, "hits": h} for b, h in calibration_bags(text, mark)]))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()),
                     pa.array(columns[3], pa.binary()),
                     pa.array(columns[4], pa.list_(pa.struct([("bucket", pa.binary()), ("hits", pa.binary())])))],
                    ["lang", "mark", "bucket", "hits", "calibration"])

    shape = "lang string, mark long, bucket binary, hits binary, calibration array<struct<bucket:binary,hits:binary>>"
    return picked.select("lang", "mark", "text").mapInArrow(bags, shape), each


@dataclass(frozen=True)
class SampleRow:
    lang: str
    f: tuple[bytes, bytes]
    c: tuple[tuple[bytes, bytes], ...]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
          per_language: int = 800, max_rows: int = 4000, sample_bytes: int = 192 << 20, dim: int = 16, steps: int = 800,
          rate: float = 8.0, reject_share: float = 0.0005, times_even: float = 1.6, seed: int = 7) -> LanguageModel:
    """Train on a bounded sample of the labelled rows of ``df``, in one task."""
    sample, each = labelled_sample(df, id_col, text_col, lang_col, per_language, max_rows)
    if sample is None:
        return LanguageModel()

    def training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, SampleRow]] = {}
        held: dict[str, int] = {}
        total = 0
        for batch in batches:  # sorted by hash, so that the byte bound cuts all languages alike
            for lang, mark, bucket, hits, calibration in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = kept.setdefault(lang, {})
                enough = held.get(lang, 0) >= LEAST_ROWS and total >= sample_bytes
                if mark in own or len(own) >= 2 * each or enough:
                    continue
                own[mark] = SampleRow(lang, (bucket, hits), tuple((c["bucket"], c["hits"]) for c in calibration))
                held[lang] = held.get(lang, 0) + 1
                total += len(bucket) + len(hits) + sum(len(c["bucket"]) + len(c["hits"]) for c in calibration)
        rows = [r for mark in sorted({m for own in kept.values() for m in own}) for own in kept.values() if (r := own.get(mark))]
        model = fitted(rows, dim=dim, steps=steps, rate=rate, reject_share=reject_share, times_even=times_even, seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    with small_batches(df.sparkSession):
        made = sample.repartition(1).sortWithinPartitions("mark", "lang").mapInArrow(training, "model binary").collect()
    return pickle.loads(made[0].model) if made else LanguageModel()


def fitted(rows: list, *, dim: int, steps: int, rate: float, reject_share: float, times_even: float, seed: int) -> LanguageModel:
    """The model of the sampled rows (``SampleRow``)."""
    if not rows:
        return LanguageModel()
    languages = sorted({r.lang for r in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    bags = [(np.frombuffer(r.f[0], "<u2"), np.frombuffer(r.f[1], "<f4")) for r in rows]
    gold = np.array([number[r.lang] for r in rows])

    def dense(which) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for row, i in enumerate(which):
            x[row, bags[i][0]] = bags[i][1] / bags[i][1].sum()
        return x

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= LEAST_HELD else order
    used = order[len(rows) // 5 :] if len(rows) >= LEAST_HELD else order
    emb = rng.normal(0, 0.5, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    done = 0
    steps = max(steps, PASSES * len(used) // 32)  # many languages are many rows
    while done < steps:
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 32)):
            step = rate * max(0.02, 1 - done / steps)
            done += 1
            x = dense(batch)
            h = x @ emb
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), gold[batch]] -= 1
            p /= len(batch)
            back = p @ out.T
            out -= step * h.T @ p
            bias -= 0.1 * step * p.sum(0)
            emb -= step * 20 * (x.T @ back)
    model = LanguageModel(languages, emb @ out, bias)
    z = np.concatenate([dense(part) @ model.bucket_scores + bias for part in np.array_split(held, max(1, len(held) // 64))])

    def calibrated(temperature: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / temperature)
        return e / e.sum(1, keepdims=True)

    right = np.arange(len(held)), np.concatenate([gold[part] for part in np.array_split(held, max(1, len(held) // 64))])
    grid = np.geomspace(1, 20, 40)  # only softened: a clean sample must not make it sure of anything
    model.temperature = float(min(grid, key=lambda t: -np.log(calibrated(t)[right] + 1e-12).sum()))
    probability = calibrated(model.temperature)
    correct = probability.argmax(1) == right[1]
    if correct.any():
        model.threshold = float(min(times_even / len(languages), np.quantile(probability.max(1)[correct], reject_share)))
    if len(rows) >= LEAST_HELD:
        _calibrate_fit(model, [rows[i] for i in held], [bags[i] for i in used], gold[used], number, reject_share)
    return model


def _calibrate_fit(model: LanguageModel, held: list, bags: list, gold: np.ndarray, number: dict, reject_share: float) -> None:
    """Set the least fit from held-out rows and negatives."""
    n = len(model.languages)
    seen = np.full((n, BUCKETS), 0.0)
    for (bucket, hits), language in zip(bags, gold, strict=True):
        seen[language, bucket] += hits
    seen += 1e-6 * seen.sum(1, keepdims=True) + 0.5
    share = seen / seen.sum(1, keepdims=True)
    model.ratios = np.log(share * BUCKETS).astype(np.float32)
    model.middle = np.zeros(n)
    model.spread = np.sqrt((share * model.ratios**2).sum(1) - (share * model.ratios).sum(1) ** 2)

    def counts(bag) -> np.ndarray:
        x = np.zeros(BUCKETS, np.float32)
        x[np.frombuffer(bag[0], "<u2")] = np.frombuffer(bag[1], "<f4")
        return x

    clean, wrong, sure = [], [], []  # (language, fit) twice, probability of the clean ones
    for row in held:
        own, whole = number[row.lang], counts(row.f)
        for x in (whole, counts(row.c[0])):
            p = model.probabilities(x)
            if x.any() and p.argmax() == own:
                clean.append((own, model.fit(x, own)))
                sure.append(p[own])
        noise = counts(row.c[1])
        guess = int(model.probabilities(noise).argmax())
        wrong.append((guess, model.fit(noise, guess)))
        if n > 1:
            p = model.probabilities(whole)
            p[own] = -1.0
            wrong.append((int(p.argmax()), model.fit(whole, int(p.argmax()))))
    if not clean:
        return
    fits = np.array([f for _, f in clean])
    of = np.array([i for i, _ in clean])
    model.middle = np.array([np.median(fits[of == i]) if (of == i).any() else np.median(fits) for i in range(n)])
    low = float(np.quantile(fits - model.middle[of], reject_share))
    model.least_fit = min(low, (low + float(np.median([f - model.middle[i] for i, f in wrong]))) / 2)
    # Rows cut short are less certain: they count for the probability too.
    model.threshold = min(model.threshold, float(np.quantile(sure, reject_share)))


def predicted(text: Column, model: LanguageModel) -> Column:
    """A struct ``lang``, ``score`` (calibrated probability), ``accepted``."""

    @F.pandas_udf("lang string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        made = []
        for value in texts:
            if not model.languages or not has_letter(value):
                made.append((UNKNOWN, 0.0, False))
                continue
            counts = subword_counts(value)
            p = model.probabilities(counts)
            best = int(p.argmax())
            made.append((model.languages[best], float(p[best]), bool(model.accepts(counts, best, p[best]))))
        return pd.DataFrame(made, columns=["lang", "score", "accepted"])

    return predict(text)


def training_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that the contract lets the model learn from."""
    return df.where(id_bucket(F.col(id_col), 4) != 2)


def keep_identified(df: DataFrame, **training) -> DataFrame:
    """The rows of a documents table whose language is identified."""
    model = train(training_rows(df), **training)
    whole = df.select(F.struct("*").alias("row"), predicted(F.col("text"), model).alias("found"))
    return written_small(whole.where("found.accepted").select("row.*"), "identified")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(training_rows(documents))
    return written_small(documents.select(
        "doc_id",
        (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"),
        predicted(F.col("text"), model).alias("p"),
    ).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"),
        F.col("p.accepted").alias("accepted"),
    ), "predictions")
