"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled documents of each label that the model is fitted on, at most.
FIT_DOCS = 2048
#: Longer documents are left out of the fit (never of the scoring).
FIT_CHARS = 100_000
#: A feature counts if so many fitted documents have it, and offending ones by so many standard errors more.
LEAST_DOCS = 3
LEAST_Z = 3.5
REJECT = 0.7
CACHE_WORDS = 500_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORDS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]


def features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 7 letters."""
    return [word, *(f"{word[:n]}*" for n in range(4, min(len(word), 8)))]


def sentences(text: str | None) -> list[tuple[int, int, frozenset[str]]]:
    """Start, end and distinct words of each sentence that has a word."""
    found = ((m.start(), m.end(), frozenset(_WORDS.findall(m[0].lower()))) for m in _SENTENCE.finditer(text or ""))
    return [x for x in found if x[2]]


def _z(bad: int, have: int, n_bad: int, n_all: int) -> float:
    """By how many standard errors more often offending documents have a feature than the others."""
    share = have / n_all
    error = (share * (1 - share) * (1 / n_bad + 1 / max(1, n_all - n_bad))) ** 0.5
    return (bad / n_bad - (have - bad) / max(1, n_all - n_bad)) / error if error else 0.0


def fit(texts: list[str], toxic: list[int], rounds: int = 150, ridge: float = 1e-4, rate: float = 0.08) -> Model:
    """Weights of the sentence scores that make the noisy-or of each document agree with its label."""
    def own_features(text: str) -> set[str]:
        return {f for w in set(_WORDS.findall(text.lower())) for f in features(w)}

    n_all, n_bad, few = len(texts), sum(toxic), Counter()
    for text, y in zip(texts, toxic):
        if y:
            few.update(own_features(text))
    bad = {f: n for f, n in few.items() if n >= LEAST_DOCS}
    del few
    have = Counter(bad)
    for text, y in zip(texts, toxic):
        if not y:
            have.update(f for f in own_features(text) if f in bad)
    names = [f for f, n in bad.items() if _z(n, have[f], n_bad, n_all) >= LEAST_Z]
    at = {f: i for i, f in enumerate(names)}
    words: dict[str, int] = {}
    pairs: list[tuple[int, int]] = []
    doc_of, sent_of, word_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):  # a word without any of these features adds nothing
        for _, _, sent in sentences(text):
            for w in sent:
                if w not in words:
                    own = [at[f] for f in features(w) if f in at]
                    words[w] = len(words) if own else -1
                    if own:
                        pairs += [(words[w], f) for f in own]
                if words[w] >= 0:
                    sent_of.append(len(doc_of))
                    word_of.append(words[w])
            doc_of.append(d)
    if not pairs or len(set(toxic)) < 2:
        share = float(np.mean(toxic)) if toxic else 0.0
        return Model(float(np.log(max(share, 1e-4) / max(1 - share, 1e-4))) - 4, {})
    wi, wf = np.array(pairs).T
    doc_of, sent_of, word_of, y = map(np.array, (doc_of, sent_of, word_of, toxic))
    n = len(names)
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[n] = -6.0
    for step in range(1, rounds + 1):
        word_score = np.bincount(wi, theta[wf], len(words))
        z = theta[n] + np.bincount(sent_of, word_score[word_of], len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = -np.bincount(doc_of, np.logaddexp(0, z), len(y))
        clean = np.exp(log_clean)
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0)
        g = p * pull[doc_of]
        grad = np.empty(n + 1)
        grad[:n] = np.bincount(wf, np.bincount(word_of, g[sent_of], len(words))[wi], n) / len(y) + ridge * theta[:n]
        grad[n] = g.sum() / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(float(theta[n]), {f: float(t) for f, t in zip(names, theta) if abs(t) > 1e-3})


_cache: dict[str, float] = {}
_cached_for: list = [None]


def _word_scores(model: Model) -> dict[str, float]:
    key = (model.bias, len(model.weights), sum(model.weights.values()))
    if _cached_for[0] != key:
        _cache.clear()
        _cached_for[0] = key
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    return _cache


def sentence_scores(text: str | None, model: Model) -> list[tuple[int, int, float]]:
    """Start, end and logit of each sentence."""
    cache, weigh, out = _word_scores(model), model.weights.get, []
    for start, end, words in sentences(text):
        z = model.bias
        for w in words:
            s = cache.get(w)
            if s is None:
                s = cache[w] = sum(weigh(f, 0.0) for f in features(w))
            z += s
        out.append((start, end, z))
    return out


def noisy_or(logits: list[float]) -> float:
    """1 - prod(1 - p): the chance that some sentence offends; of none, 0."""
    return float(-np.expm1(-np.logaddexp(0, np.array(logits, dtype=float)).sum()))


def fit_on(docs: DataFrame, labels: DataFrame, train: Column | None = None, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on at most ``fit_docs`` documents of each label among the label rows where ``train`` holds.

    The sample is taken by a hash of the id, so it spreads over all rows; only sampled texts of at
    most FIT_CHARS characters reach the driver.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known if train is None else known.where(train)
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs) for y in (0, 1)]
    ids = some[0].unionByName(some[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= FIT_CHARS).join(F.broadcast(ids), "doc_id")
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``worst_start``, ``worst_end``: the noisy-or and where its strongest sentence is.

    Null and empty texts and texts without letters score 0 and have no worst sentence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, starts, ends = [], [], []
            for text in batch["text"].to_pylist():
                found = sentence_scores(text, shared.value)
                worst = max(found, key=lambda x: x[2], default=(None, None, 0.0))
                scores.append(noisy_or([x[2] for x in found]))
                starts.append(worst[0])
                ends.append(worst[1])
            columns = [batch["doc_id"], pa.array(scores, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "worst_start", "worst_end"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(of, "doc_id long, score double, worst_start long, worst_end long")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence, score of every sentence whose own score is ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, a, b, text[a:b], 1 / (1 + float(np.exp(-z))))
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())
                for a, b, z in sentence_scores(text, shared.value)
                if z >= np.log(threshold / (1 - threshold))
            ]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            names = ["doc_id", "start", "end", "sentence", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(of, "doc_id long, start long, end long, sentence string, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [noisy_or([x[2] for x in sentence_scores(t, model.value)]) for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(of, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; rows of the held-out third teach nothing, rows without an id are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit_on(docs, labels, ~held_out)
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "worst_start", "worst_end")
