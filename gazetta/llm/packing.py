"""Best-fit packing by minimum bin slack over the lengths that are there."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

CAPACITY = 2048
#: Chunks of text whose ids a Python worker keeps.
CACHE_CHUNKS = 800_000
#: Rows that one rank group holds on average.
RANK_ROWS = 2000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SEPARATOR = bytes(4)


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out, {}


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: its own if printable, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_BLANK = _LETTERS[32]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _encode(tokenizer, texts: list[str]) -> list[bytes]:
    return [_packed(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _learn(tokenizer, cache: dict[str, bytes], fresh: list[str]) -> None:
    """Put the ids of `` chunk`` into the cache for each chunk.

    A chunk of letters alone is one word to the tokenizer, and a closing comma or full stop the next:
    such words go to its model directly.
    """
    model, other = tokenizer.model, []
    marks = dict(zip(".,", _encode(tokenizer, [".", ","])))
    for chunk in fresh:
        mark = marks.get(chunk[-1:], b"")
        word = chunk[:-1] if mark else chunk
        if word.isalpha() and len(word) < 64:
            written = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            cache[chunk] = _packed([t.id for t in model.tokenize(_BLANK + written)]) + mark
        else:
            other.append(chunk)
    for at in range(0, len(other), 20_000):
        some = other[at : at + 20_000]
        cache.update(zip(some, _encode(tokenizer, [f" {c}" for c in some])))


def _chunks(text: str) -> list[str]:
    """The text cut before each blank that precedes a character that is no white space.

    There the tokenizer always begins a new word, which takes the blank with it, so chunks
    have ids of their own.
    """
    return re.split(r" (?=\S)", text) if re.search(r" (?!\S)", text) else text.split(" ")


def token_bytes(texts: list[str | None], path: str | None = None) -> list[bytes]:
    """Ids of each text and the closing id 0, as little-endian unsigned 32-bit numbers."""
    tokenizer, cache = _tokenizer(path)
    split = [_chunks(t or "") for t in texts]
    fresh = list({c for parts in split for c in parts[1:]} - cache.keys())
    if len(cache) + len(fresh) > CACHE_CHUNKS:
        cache.clear()
        fresh = list({c for parts in split for c in parts[1:]})
    _learn(tokenizer, cache, fresh)
    first = _encode(tokenizer, [parts[0] for parts in split])
    out = [b"".join([head, *map(cache.__getitem__, parts[1:]), _SEPARATOR]) for head, parts in zip(first, split)]
    for c in fresh:  # long chunks do not come again
        if len(c) > 64:
            del cache[c]
    return out


def _cut(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows, part = [], batch.slice(at, 500)
            for doc, data in zip(part["doc_id"].to_pylist(), token_bytes(part["text"].to_pylist(), path)):
                n, piece, start = len(data) // 4, 0, 0
                while start < n:
                    end = start + ((n - start - 1) % capacity + 1 if piece == 0 else capacity)
                    own = data[4 * start : 4 * end]
                    rows.append((doc, piece, start, end - start, zlib.crc32(own), *([own] if ids else [])))
                    piece, start = piece + 1, end
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ``ids`` (binary).

    A document's ids end with id 0.  Only documents longer than ``capacity`` are cut; all
    their pieces but the first are full.
    """
    schema = _PIECES + (", ids binary" if ids else "")
    cut = partial(_cut, path=tokenizer_path, capacity=capacity, ids=ids)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def _fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how many of each fill ``room`` the most: subset sums as the bits of one integer."""
    reach, steps, mask = 1, [], (2 << room) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << length * many) & mask
            left, many = left - many, many * 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + many
            best -= length * many
    return used


def fill_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings (length -> how many) and how often each is used, by minimum bin slack.

    Each bin begins with the longest piece left; the fullest combination for the room beside it is
    taken out, as often as the counts allow.  Works on the counts of at most ``capacity``
    lengths: each filling uses up a length, so the plan's size does not follow the number of pieces.
    """
    counts, plan = {k: n for k, n in counts.items() if n}, []
    while counts:
        longest = max(counts)
        rest = {k: n - (k == longest) for k, n in counts.items() if n > (k == longest)}
        filling = _fullest(rest, capacity - longest) if longest < capacity else {}
        filling[longest] = filling.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in filling.items())
        for k, m in filling.items():
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
        plan.append((filling, times))
    return plan


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``cut`` (from ``pieces``; staged by the caller).

    The driver sees the number of pieces of each length, at most ``capacity`` numbers, and plans
    fillings; every piece finds its place from its rank among those of its length.
    Ranks are counted in groups of about RANK_ROWS rows, so a length that many
    pieces share is spread over many groups.
    """
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    slots, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for filling, times in fill_plan(counts, capacity):
        place = 0
        for length in sorted(filling, reverse=True):
            many = filling[length]
            slots.append((length, used[length], used[length] + many * times, many, sequence, place))
            used[length] += many * times
            place += many * length
        sequence += times
    slots = spark.createDataFrame(slots, "length long, first long, past long, many long, sequence long, place long")
    salts = spark.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in counts.items()], "length long, salts long")
    placed = cut.join(F.broadcast(salts), "length").withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece), salts)")).drop("salts")
    before = placed.groupBy("length", "salt").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    rank = placed.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"])
    rank = rank.withColumn("rank", F.col("own") + F.col("before"))
    at = rank.join(F.broadcast(slots), "length").where("rank >= first AND rank < past").withColumn("k", F.col("rank") - F.col("first"))
    return at.select(
        *cut.columns,
        (F.col("sequence") + F.expr("k div many")).alias("sequence_id"),
        (F.col("place") + F.col("k") % F.col("many") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    A null or empty text is one piece with id 0 alone.  Repeated rows are packed as often as they
    come.  Other columns are not read; an empty table gives no rows.
    """
    return pack(staged(pieces(docs, tokenizer_path, capacity)), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
