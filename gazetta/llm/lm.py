"""Language-model scoring: deleted interpolation of word n-grams, weights by expectation-maximisation.

Words and bigrams are 64-bit keys.  Tasks send each key's count once for each block of texts that has it, packed in arrays;
the counts of a key meet in one task, and go back only to blocks where the corpus has more of it than the block itself.
Nothing is cut: every word, context and bigram of the training rows counts, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: Buckets of context frequency, from 1, 4, 16, ... occurrences on; 0 is for contexts never seen.
BUCKETS = 12
#: Bytes of text in a block, and keys in a bucket, about.
BLOCK_BYTES, BUCKET_KEYS = 12_000_000, 2_000_000
#: Bytes of text, keys and counted tokens that a task works on at once, and words whose keys a Python worker keeps.
_TEXT_BYTES, _FLUSH, _CHUNK, _CACHE = 2_000_000, 1_000_000, 250_000, 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "bucket int, n int, keys binary, blocks binary, counts binary"
_TOTALS = "block int, n int, keys binary, totals binary"
_TOKENS = "docs array<long>, trains array<boolean>, n int, sizes binary, word binary, both binary"


class Totals(NamedTuple):
    tokens: int
    distinct: int


def words(text: str | None) -> list[bytes]:
    """Words between [\\x20\\x09-\\x0D], A-Z in lower case; null is empty."""
    return (text or "").encode().lower().split()


_keys: dict[str, int] = {}


def _key_of(word: str) -> int:
    key = _keys.get(word)
    if key is None:
        if len(_keys) > _CACHE:
            _keys.clear()
        key = _keys[word] = xxhash.xxh64_intdigest(word.encode()) | 1
    return key


#: The end of a text, a token no word can equal; words have odd keys, bigrams even ones.
END = xxhash.xxh64_intdigest(b"\n") | 1


def token_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of the texts on end, each text's end last; and how many tokens each text has."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower misreads slices
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.ascii_split_whitespace(lower)
    coded = split.flatten().dictionary_encode()
    own = np.array([_key_of(w) if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    keys = own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(split), dtype=np.int32), split.value_lengths().to_numpy(zero_copy_only=False))
    del lower, coded
    real = keys != 0  # blanks at the ends of a text leave empty words
    keys, owner = keys[real], owner[real]
    sizes = np.bincount(owner, minlength=len(split)) + 1
    out = np.full(len(keys) + len(split), END, np.uint64)
    out[np.arange(len(keys)) + owner] = keys
    return out, sizes


def before(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each token what its context has: a text's first token follows the end, as which its own last one serves."""
    out, first = np.r_[x[:1], x[:-1]], np.cumsum(sizes) - sizes
    out[first] = x[first + sizes - 1]
    return out


def pair_keys(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The key of each token together with its context."""
    context = before(keys, sizes)
    both = ((context * _ODD) ^ (context >> np.uint64(29))) + keys
    both *= np.uint64(0xD6E8FEB86659FD93)
    return (both ^ (both >> np.uint64(32))) & ~np.uint64(1)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about _TEXT_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    number, start = np.cumsum(sizes) // _TEXT_BYTES, 0
    for end in [*(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def _sums(n: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of ``by`` in order, and the sum of ``n`` of each."""
    order = np.lexsort(by[::-1])
    by, n = [c[order] for c in by], n[order]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for c in by:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return (*[c[first] for c in by], np.add.reduceat(n, first) if len(n) else n)


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """The numbers byte by byte, all lowest bytes first, compressed; of rising ones the steps."""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def key_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, keys, blocks, counts), packed: how many training tokens of a block are a word or bigram, 0 where only other rows have it.

    ``docs``: block, text, train.  A bucket holds a range of keys.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            key, block, count = _sums(*(np.concatenate(x) for x in zip(*held)))
            bucket = (key >> np.uint64(33)).astype(np.int64) * buckets >> 31
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist()
            rows = [(int(bucket[a]), b - a, packed(key[a:b], True), packed(block[a:b]), packed(count[a:b].astype(np.int32))) for a, b in zip(at, at[1:])]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "n", "keys", "blocks", "counts"])

        for batch in batches:
            for part in _slices(batch):
                keys, sizes = token_keys(part["text"])
                taught = np.repeat(part["train"].to_numpy(zero_copy_only=False).astype(np.int32), sizes)
                of_block = np.repeat(part["block"].to_numpy(), sizes)
                for own in (keys, pair_keys(keys, sizes)):
                    key, block, count = _sums(taught, own, of_block)
                    held.append((count, key, block))
                    n += len(key)
                if n > _FLUSH:
                    pa.default_memory_pool().release_unused()
                    yield flush()
                    held.clear()
                    n = 0
        if n:
            yield flush()

    return docs.select("block", "text", "train").mapInArrow(of, _COUNTS)


def _column(rows: pa.Table, name: str, kind: type, rising: bool = False) -> np.ndarray:
    return np.concatenate([unpacked(d, n, kind, rising) for d, n in zip(rows[name].to_pylist(), rows["n"].to_pylist())])


def corpus_counts(counts: DataFrame) -> DataFrame:
    """(block, n, keys, totals), packed: to each block its keys of which the corpus has more than the block."""

    def of(rows):
        key, block, n = _sums(_column(rows, "counts", np.int32).astype(np.int64), _column(rows, "keys", np.uint64, True), _column(rows, "blocks", np.int32))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.repeat(np.add.reduceat(n, first), np.diff(np.r_[first, len(key)]))
        more = total != n
        order = np.argsort(block[more], kind="stable")
        block, key, total = block[more][order], key[more][order], total[more][order]
        at = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(block)]
        out = [(int(block[a]), b - a, packed(key[a:b], True), packed(total[a:b])) for a, b in zip(at, at[1:])]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table(dict(zip(("block", "n", "keys", "totals"), [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, kinds)])))

    return counts.groupBy("bucket").applyInArrow(of, _TOTALS)


def counted_tokens(docs: DataFrame, totals: DataFrame) -> DataFrame:
    """(docs, trains, n, sizes, word, both), packed, of some rows together: how often the corpus has each token, and it together with its context.

    A key that no other block has counts as often as the block's own training rows have it.
    """

    kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    none = pa.schema(list(zip(("docs", "trains", "n", "sizes", "word", "both"), kinds))).empty_table()

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        known, total = np.empty(0, np.uint64), np.empty(0, np.int64)
        if right.num_rows:
            known, total = _column(right, "keys", np.uint64, True), _column(right, "totals", np.int64)
            order = np.argsort(known)
            known, total = known[order], total[order]
        if not left.num_rows:
            return none
        keys, sizes = token_keys(left["text"].combine_chunks())
        taught = np.repeat(left["train"].to_numpy().astype(np.int64), sizes)

        def count(own: np.ndarray) -> np.ndarray:
            distinct, number = np.unique(own, return_inverse=True)
            n = np.bincount(number, taught, len(distinct)).astype(np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                n = np.where(known[at] == distinct, total[at], n)
            return n[number]

        word, both, end = count(keys), count(pair_keys(keys, sizes)), np.r_[0, np.cumsum(sizes)]
        docs, trains, rows = left["doc_id"].to_pylist(), left["train"].to_pylist(), []
        cuts = [0, *(np.flatnonzero(np.diff(end[1:] // _CHUNK)) + 1).tolist(), len(sizes)]
        pa.default_memory_pool().release_unused()
        for a, b in zip(cuts, cuts[1:]):
            some = slice(end[a], end[b])
            rows.append((docs[a:b], trains[a:b], int(end[b] - end[a]), packed(sizes[a:b]), packed(word[some]), packed(both[some])))
        return pa.table(dict(zip(none.column_names, [pa.array(c, k) for c, k in zip(zip(*rows), none.schema.types)])))

    return docs.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(of, _TOKENS)


def bucket_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(4 ** np.arange(BUCKETS), counts, side="right")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Docs, trains, sizes, and the word, context and pair counts of the tokens, of some texts at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs, trains, n, sizes, word, both = (batch[c][i].as_py() for c in ("docs", "trains", "n", "sizes", "word", "both"))
            sizes = unpacked(sizes, len(docs), np.int64)
            word, both = unpacked(word, n, np.int64), unpacked(both, n, np.int64)
            yield docs, np.array(trains, bool), sizes, word, before(word, sizes), both


def held_out_cells(tokens: DataFrame) -> tuple[list, Totals]:
    """(bucket, n, p1, p2) rows: training tokens by context bucket, each with itself deleted from the counts; and the totals.

    Like tokens share a cell of a grid over the logarithms of both counts, so that a few ten thousand
    cells stand for all tokens.  A word of c tokens counts 1/c for each: their sum is the number of distinct words.
    """
    width = 128

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, distinct = np.zeros((3, (BUCKETS + 1) * width * width)), 0.0
        for _, trains, sizes, *tokens in _chunks(batches):
            word, context, both = (x[np.repeat(trains, sizes)] for x in tokens)
            distinct += float((1 / word).sum())
            word, both, rest = word - 1, both - 1, np.maximum(context - 1, 1)
            p2 = both / rest
            cell = np.minimum(2 * np.log2(word + 1), width - 1).astype(np.int64)
            cell2 = np.where(both > 0, np.clip(width - 1 + 4 * np.log2(np.maximum(p2, 1e-12)), 1, width - 1), 0).astype(np.int64)
            number = (bucket_of(context) * width + cell) * width + cell2
            for i, w in enumerate((None, word, p2)):
                sums[i] += np.bincount(number, w, sums.shape[1])
        at = np.flatnonzero(sums[0])
        columns = [np.r_[at, -1], *(np.r_[s[at], x] for s, x in zip(sums, (sums[0].sum(), distinct, 0.0)))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "n", "rest", "p2"])

    cells = tokens.mapInArrow(of, "cell long, n double, rest double, p2 double")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"), F.sum("p2").alias("p2")).collect()
    whole = next((r for r in cells if r["cell"] < 0), {"n": 0, "rest": 0})
    totals = Totals(round(whole["n"]), round(whole["rest"]))
    cells = sorted(r for r in cells if r["cell"] >= 0)
    return [(r["cell"] // width**2, r["n"], r["rest"] / r["n"] / max(1, totals.tokens - 1), r["p2"] / r["n"]) for r in cells], totals


def mixture_weights(cells: list, distinct: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket x [uniform, word, bigram]) that make the held-out tokens likeliest, by EM; contexts never seen have no bigrams."""
    weights = np.tile([0.1, 0.6, 0.3], (BUCKETS + 1, 1))
    weights[0] = [0.2, 0.8, 0.0]
    for bucket in {c[0] for c in cells}:
        n, p1, p2 = np.array([c[1:] for c in cells if c[0] == bucket], float).T
        p = np.stack([np.full(len(n), 1 / (distinct + 1)), p1, p2], axis=1)
        w = weights[bucket]
        for _ in range(rounds):
            parts = p * w
            w = (n[:, None] * parts / np.maximum(parts.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0) / n.sum()
        w = np.maximum(w, [1e-9, 1e-9, 0.0 if bucket == 0 else 1e-9])
        weights[bucket] = w / w.sum()
    return weights


def counted(docs: DataFrame, train: Column) -> DataFrame:
    """The tokens of ``docs`` with their counts over the rows where ``train`` holds, staged."""
    n_bytes = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 1
    blocks, buckets = math.ceil(n_bytes / BLOCK_BYTES), math.ceil(n_bytes / 3 / BUCKET_KEYS)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(train, F.lit(False)).alias("train"), block.alias("block"))
    return staged(counted_tokens(rows, staged(corpus_counts(key_counts(rows, buckets)))))


def scored(tokens: DataFrame, totals: Totals, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of counted tokens."""
    n, v = totals

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for docs, _, sizes, word, context, both in _chunks(batches):
            owner, own = np.repeat(np.arange(len(docs)), sizes), weights[bucket_of(context)]
            p = own[:, 0] / (v + 1) + own[:, 1] * word / max(1, n) + own[:, 2] * both / np.maximum(context, 1)
            known, base, score = (np.bincount(owner, x, len(docs)) for x in (word > 0, np.log10((word + 1) / (n + v + 1)), np.log10(p)))
            columns = [docs, sizes, known.astype(np.int64), np.full(len(docs), n), base, score]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return tokens.mapInArrow(of, schema)


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``, learnt from rows where ``train`` holds.

    ``score`` is the log10 probability of the text and its end: each token has its bucket's mixture of the
    uniform share of 1/(V+1), the word's share of the training tokens and the bigram's share of its context.
    ``base_score`` is the add-one word model.  The counts of all training rows count, of every word, context and bigram.
    Null and empty texts are their end alone.  Repeated rows are scored alike, rows without an id too; with no training
    row all counts are zero.  Other columns are not read; an empty table gives no rows.
    """
    tokens = counted(docs, train)
    cells, totals = held_out_cells(tokens)
    return scored(tokens, totals, mixture_weights(cells, totals.distinct))


def is_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores; documents held out by the hash of their id teach nothing, those without an id teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, F.coalesce(~is_held_out(), F.lit(True)))
    return out.withColumn("held_out", F.coalesce(is_held_out(), F.lit(False)))
