"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
#: Buckets are 2^BITS at most, and languages times buckets 2^TABLE_BITS at most: 64 MB of float32.
BITS, TABLE_BITS = 16, 24
UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Odd multipliers of the n-gram hash, one for each place.
_MULTIPLIERS = (2654435769, 2246822507, 3266489909)
#: Characters handled at once.
_SLICE = 1_000_000


class Model(NamedTuple):
    langs: list[str]
    prior: np.ndarray  # log share of each language's documents
    table: np.ndarray  # buckets x languages, log probabilities
    bits: int


def letters(text: str | None) -> str:
    """Lower-case letters, each run of anything else being one blank; null is empty."""
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip()


def buckets(clean: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document numbers, buckets) of all n-grams within the texts, blanks around them included, a slice at a time."""
    for first, text, start in _slices(clean):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        doc = np.repeat(np.arange(first, first + len(start) - 1), np.diff(start))
        for order in ORDERS:
            n = len(codes) - order + 1
            if n < 1:
                continue
            h = np.full(n, order * 40503, np.uint32)
            for k in range(order):
                h += codes[k : k + n] * np.uint32(_MULTIPLIERS[k])
            h ^= h >> np.uint32(15)
            h *= np.uint32(_MULTIPLIERS[0])
            within = doc[:n] == doc[order - 1 :]
            yield doc[:n][within], (h >> np.uint32(32 - bits))[within]


def _slices(clean: list[str]) -> Iterator[tuple[int, str, np.ndarray]]:
    """Number of the first text, joined texts, starts; long texts are joined with no others."""
    first, held, size = 0, [], 0
    for i, text in enumerate(clean):
        if held and size + len(text) > _SLICE:
            yield first, "".join(held), np.cumsum([0, *map(len, held)])
            first, held, size = i, [], 0
        held.append(f" {text} " if text else "")
        size += len(held[-1])
    if held:
        yield first, "".join(held), np.cumsum([0, *map(len, held)])


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        langs, own = batch["lang"].to_pylist(), sorted(set(batch["lang"].to_pylist()))
        number = np.array([own.index(x) for x in langs])
        for doc, bucket in buckets([letters(t) for t in batch["text"].to_pylist()], bits):
            which = number[doc]
            for i in np.unique(which):
                n = np.bincount(bucket[which == i], minlength=1 << bits)
                held[own[i]] = held[own[i]] + n if own[i] in held else n
        if len(held) > 64:
            yield from flush()
    yield from flush()


def fit(docs: DataFrame) -> Model:
    """Count n-grams of all of ``docs`` (text, lang) that have a language and build the log-probability table.

    Counting is a distributed sum over (language, bucket); the driver gets at most 2^TABLE_BITS numbers.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    shares = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    langs = sorted(shares)
    if not langs:
        return Model([], np.zeros(0), np.zeros((1, 0), np.float32), 0)
    bits = max(1, min(BITS, TABLE_BITS - math.ceil(math.log2(len(langs) + 1))))
    counts = known.mapInArrow(lambda b: _count(b, bits), "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.ones((1 << bits, len(langs)))
    number = {x: i for i, x in enumerate(langs)}
    np.add.at(table, (counts["bucket"].to_numpy(), counts["lang"].map(number).to_numpy()), counts["n"].to_numpy())
    prior = np.log(np.array([shares[x] for x in langs]) / sum(shares.values()))
    return Model(langs, prior, np.log(table / table.sum(axis=0)).astype(np.float32), bits)


def classify(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its posterior; orders overlap, so each has a share of the evidence."""
    clean = [letters(t) for t in texts]
    if not model.langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    total = np.zeros((len(texts), len(model.langs)))
    for doc, bucket in buckets(clean, model.bits):
        if len(doc):
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            total[doc[starts]] += np.add.reduceat(model.table[bucket], starts, axis=0, dtype=np.float64)
    z = model.prior + total / len(ORDERS)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = z.argmax(axis=1)
    named = [model.langs[b] if c else UNKNOWN for b, c in zip(best, clean)]
    return named, [float(p[i, b]) if c else 0.0 for i, (b, c) in enumerate(zip(best, clean))]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score; ``und`` and 0 for texts that are null or without letters. Ties: first name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                named, p = classify(part["text"].to_pylist(), shared.value)
                columns = [part["doc_id"], pa.array(named, pa.string()), pa.array(p, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, lang_pred string, score double")


def is_held_out() -> Column:
    """Rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; held-out documents teach nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~is_held_out()))
    return predict(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
