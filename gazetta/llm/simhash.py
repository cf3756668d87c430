"""SimHash near-dedup: a grid range-join over segment popcounts, verified on the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, components, join_once, keep_rows, row_key, small_side, staged

DISTANCE = 2
SHINGLE = 3
#: The embedding counts bits in 32 segments of two.
SEGMENTS = 32
#: Cells with more fingerprints are cut again by a second grid.
PAIR_CELL = 32
#: Blocks of the second grid.
TURNED_BLOCKS = 8
_EVEN = 0x5555555555555555
_PART = 100_000


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the text's 3-word shingles, each as often as it comes; no words: 0.

    A-Z are lower-cased; words end at [\\x20\\x09-\\x0D]; fewer than three words are one shingle.
    A bit is set if over half of the shingles' XXH64 (seed 42) have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        some = words[at : at + _PART + SHINGLE - 1]
        shingles = map(b" ".join, zip(some, some[1:], some[2:])) if len(some) >= SHINGLE else [b" ".join(some)]
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp): fp is the fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fp = np.array([fingerprint(t) for t in part["text"].to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["row_key"], pa.array(fp)], names=["doc_id", "row_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("row_key"), "text")
    return rows.mapInArrow(of, "doc_id long, row_key long, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, two bits each, in one long."""
    low, high = fp.bitwiseAND(_EVEN), F.shiftrightunsigned(fp, 1).bitwiseAND(_EVEN)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings: never more than the Hamming distance of the fingerprints."""
    at = F.sequence(F.lit(0), F.lit(2 * SEGMENTS - 2), F.lit(2))

    def count(e: Column, i: Column) -> Column:
        return F.call_function("shiftrightunsigned", e, i).bitwiseAND(3)

    return F.aggregate(F.transform(at, lambda i: F.abs(count(a, i) - count(b, i))), F.lit(0).cast("long"), lambda s, d: s + d)


def blocks_for(n: int) -> int:
    """How many blocks the embedding is cut into, so that cells stay small: a two-bit count has 1.5 bits of information.

    Embeddings within Manhattan distance 2 agree in all but two blocks, however many there are.
    """
    for blocks in (4, 6, 8, 11, 16):
        if n / 2 ** (1.5 * SEGMENTS * (blocks - DISTANCE) / blocks) <= 2:
            break
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(fp: Column, blocks: int) -> Column:
    """An array of (cell, key): one for each choice of the blocks of the embedding that need not agree."""
    edge = [2 * (SEGMENTS * i // blocks) for i in range(blocks + 1)]
    mask = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    e = embedding(fp)
    return F.array(*[
        F.struct(F.lit(k).alias("cell"), e.bitwiseAND(_signed(sum(mask[i] for i in range(blocks) if i not in free))).alias("key"))
        for k, free in enumerate(combinations(range(blocks), DISTANCE))
    ])


def turned(fp: Column) -> Column:
    """The fingerprint turned by one bit: its segments then lie across those of the first grid."""
    return F.shiftleft(fp, 1).bitwiseOR(F.shiftrightunsigned(fp, 63))


def links(nodes: DataFrame, pair_cell: int = PAIR_CELL) -> DataFrame:
    """Edges (a, b) between ids of fingerprints whose Hamming distance is 2 or less.

    ``nodes``: distinct fp with id, staged.  Fingerprints so near share a cell of the grid over their embeddings.  A cell of more
    than ``pair_cell`` of them is cut by the grid over the turned fingerprints, of which they share a cell too: both embeddings
    together leave little of a fingerprint open, however many a cell had.  Pairs are tested by the Manhattan
    distance of their embeddings and then exactly.
    """
    cells = nodes.select("fp", "id", F.explode(_cells(F.col("fp"), blocks_for(nodes.count()))).alias("c")).select("fp", "id", "c.cell", "c.key")
    sizes = small_side(staged(cells.groupBy("cell", "key").agg(F.count("*").alias("n")).where("n > 1")))
    some = cells.join(sizes, ["cell", "key"])
    again = F.when(F.col("n") > pair_cell, _cells(turned(F.col("fp")), TURNED_BLOCKS)).otherwise(F.array(F.struct(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("key"))))
    some = some.select("fp", "id", "cell", "key", F.explode(again).alias("c")).select("fp", "id", "cell", "key", F.col("c.cell").alias("cell2"), F.col("c.key").alias("key2"))
    on = ["cell", "key", "cell2", "key2"]
    near = some.join(some.select(*on, F.col("fp").alias("fp_b"), F.col("id").alias("b")), on).where("fp < fp_b")
    near = near.where(manhattan(embedding(F.col("fp")), embedding(F.col("fp_b"))) <= DISTANCE)
    return near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= DISTANCE).select(F.col("id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, fp, component_id, keep_key of every row of ``docs``.

    Rows are documents each, also those that share a doc_id or have none.  Null, empty and blank texts share fingerprint 0.
    component_id is the smallest doc_id reachable over links between fingerprints that differ in 2 bits or fewer; it is null
    where no row reachable has an id.  ``keep_key`` is the row_key of the row with that id (the smallest key of several).
    Only distinct fingerprints are compared.  An empty table gives no rows.
    """
    fps = staged(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    nodes = staged(fps.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")).withColumn("id", F.col("fp")))
    found = staged(nodes.join(components(nodes.select("id"), links(nodes.select("fp", "id"))), "id").select("fp", "component", "first"))
    least = found.groupBy("component").agg(F.min("first").alias("least"))
    found = found.join(least, "component").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row_key").alias("keep_key"))
    return join_once(fps, staged(found), "fp", nodes.where(F.col("n") > HOT)).select("doc_id", "row_key", "fp", "component_id", "keep_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates, the row of ``docs`` with the smallest doc_id; all columns.  Rows without an id stay where no other does."""
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("keep_key")))
    return keep_rows(docs, staged(kept.select("doc_id", "row_key")))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``documents``; ``near_duplicates`` states the odd cases."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
