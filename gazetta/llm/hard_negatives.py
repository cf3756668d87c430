"""Hard-negative mining with summaries of vector segments.

A segment's mean and deviation (the length of what is left without the mean) are stored with each vector.  Two segments'
product is their means' product times their width, give or take the product of their deviations: sums of these bound a score
from both sides.  Segments are refined from 16 components to 4 and 2, and only pairs that the bounds leave open are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side, staged

#: Widths of segments, coarse to fine; the finest are stored, the others follow from them.
WIDTHS = (16, 4, 2)
#: Components of the vectors of a block, and anchors that meet them at a time.
BLOCK_CELLS, ANCHORS = 1 << 22, 64
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these parts of the positive's, in hundredths.
LOW, HIGH = 50, 95
_EXACT = float(1 << 53)
_PAIRS = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def summaries(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integers), size, means and deviations of the finest segments, of the rows that take part.

    No part take rows without vec_id, label or vector, and vectors with a null or non-finite component.  Of rows with one vec_id
    the one with the least label and vector counts.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform(x, lambda c: F.floor(256 * c).cast("long"))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    twice = staged(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1"))
    if not twice.isEmpty():
        few = small_side(twice.select("vec_id"))
        one = rows.join(few, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
        rows = rows.join(few, "vec_id", "left_anti").unionByName(one)
    return rows.withColumn("size", F.size("v")).mapInArrow(_summarise, rows.withColumn("size", F.size("v")).selectExpr("*", "array(0D) AS means", "array(0D) AS deviations").schema)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        means, deviations = [], []
        for v in batch.column("v"):
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), float)
            x = np.pad(x, (0, -len(x) % WIDTHS[0])).reshape(-1, WIDTHS[-1])
            means.append(x.mean(axis=1))
            deviations.append(np.sqrt(((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(a, pa.list_(pa.float64())) for a in (means, deviations))], [*batch.schema.names, "means", "deviations"])


class Vectors:
    """Vectors of one size with their summaries at every width: scaled so that products of rows are products of segments."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        matrix = lambda c: np.asarray(_flat(batch.column(c)), float).reshape(batch.num_rows, -1)
        self.ids = batch.column("vec_id").to_numpy()
        self.labels = batch.column("label").to_numpy()
        self.v = _flat(batch.column("v")).reshape(batch.num_rows, -1)
        self.x = self.v.astype(float)
        means, deviations = matrix("means"), matrix("deviations")
        self.levels = []
        for width in WIDTHS:
            m = means.reshape(len(means), -1, width // WIDTHS[-1])
            whole = m.mean(axis=2)
            spread = (deviations.reshape(m.shape) ** 2).sum(axis=2) + WIDTHS[-1] * ((m - whole[:, :, None]) ** 2).sum(axis=2)
            self.levels.append((whole * np.sqrt(width), np.sqrt(spread)))
        self.most = float(np.abs(self.x).max()) if self.x.size else 0.0
        self.norm = np.sqrt((self.x**2).sum(axis=1))


def _flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _products(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Inner products of the pairs in ``mask``, one by one where these are few."""
    if mask.mean() > 1 / 16:
        return a @ b.T
    out = np.zeros(mask.shape, a.dtype)
    r, c = np.nonzero(mask)
    for at in range(0, len(r), 1 << 16):
        p, q = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
        out[p, q] = np.einsum("ij,ij->i", a[p], b[q])
    return out


def open_scores(q: Vectors, c: Vectors, mask: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of the pairs in ``mask`` that ``keep(lower, upper, mask)`` leaves open at every width, and which these are."""
    slack = 1e-9 * (q.norm[:, None] * c.norm[None, :] + 1)
    for (mq, dq), (mc, dc) in zip(q.levels, c.levels):
        if not mask.any():
            break
        middle, reach = _products(mq, mc, mask), _products(dq, dc, mask) + slack
        mask = mask & keep(middle - reach, middle + reach, mask)
    whole = q.most * c.most * q.x.shape[1] >= _EXACT  # beyond what doubles hold, whole numbers are slower
    return _products(q.v if whole else q.x, c.v if whole else c.x, mask), mask


def _th_largest(values: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row's values in ``mask``; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(mask, values, -np.inf), values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _first(scores: np.ndarray, mask: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places in ``mask`` of the k highest scores, ties by smaller id."""
    at = np.nonzero(mask)[0]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _met(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[Vectors, Vectors, pa.RecordBatch]]:
    """A block's vectors with each slice of the anchors that come after them; no more than the block and a batch is held."""
    own, gathered, block = None, [], None
    for batch in batches:
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in [*key, "asks"]]) if batch.num_rows else np.empty((1, 0))
        cuts = [0, *(np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            place, asks = tuple(marks[:-1, a]), marks[-1, a]
            if place != own:
                own, gathered, block = place, [], None
            if not asks:
                gathered.append(batch.slice(a, b - a))
            elif gathered or block is not None:
                if block is None:
                    block, gathered = Vectors(pa.Table.from_batches(gathered)), []
                for at in range(a, b, ANCHORS):
                    some = batch.slice(at, min(ANCHORS, b - at))
                    yield block, Vectors(some), some


def _positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, q, _ in _met(batches, ["size", "label", "block"]):
        others = block.ids[None, :] != q.ids[:, None]
        keep = lambda lower, upper, mask: upper >= _th_largest(lower, mask, POSITIVES)[:, None]
        scores, mask = open_scores(q, block, others, keep)
        out = [(q.ids[i], block.ids[j], int(scores[i, j])) for i in range(len(q.ids)) for j in _first(scores[i], mask[i], block.ids, POSITIVES)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["anchor_id", "positive_id", "positive_score"])


def _negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, q, some in _met(batches, ["size", "block"]):
        wanted = [[(p["positive_id"], p["positive_score"]) for p in row] for row in some.column("positives").to_pylist()]
        # whole scores between LOW and HIGH hundredths of the positive's; no row has more than POSITIVES of them
        least, most = np.full((2, len(wanted), POSITIVES), np.nan)
        for i, row in enumerate(wanted):
            for w, (_, score) in enumerate(row):
                least[i, w], most[i, w] = -(-LOW * score // 100), HIGH * score // 100

        def keep(lower, upper, mask):
            out = np.zeros(mask.shape, bool)
            for w in range(POSITIVES):
                lo, hi = least[:, w, None], most[:, w, None]
                sure = mask & (lower >= lo) & (upper <= hi)
                out |= (upper >= lo) & (lower <= hi) & (upper >= _th_largest(lower, sure, NEGATIVES)[:, None])
            return out

        scores, mask = open_scores(q, block, block.labels[None, :] != q.labels[:, None], keep)
        out = []
        for i, row in enumerate(wanted):
            for w, (positive, score) in enumerate(row):
                inside = mask[i] & (100 * scores[i] >= LOW * score) & (100 * scores[i] <= HIGH * score)
                out += [(q.ids[i], positive, score, block.ids[j], int(scores[i, j])) for j in _first(scores[i], inside, block.ids, NEGATIVES)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], [c.split()[0] for c in _PAIRS.split(", ")])


def _blocks(rows: DataFrame, anchors: DataFrame, key: list[str], cells: int) -> DataFrame:
    """Vectors in blocks of bounded size, each block followed by all anchors of its ``key``."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = F.count("*")
    blocks = F.greatest(F.ceil(n * F.greatest(F.lit(1), F.max("size")) / cells), F.least(F.lit(cores), F.ceil(n / 1024)))
    sizes = small_side(staged(rows.groupBy(*key).agg(blocks.cast("long").alias("blocks"))))
    own = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).withColumn("asks", F.lit(0).cast("long"))
    asking = anchors.join(sizes, key).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("asks", F.lit(1).cast("long"))
    both = own.unionByName(asking, allowMissingColumns=True).drop("blocks")
    return both.repartition(*key, "block").sortWithinPartitions(*key, "block", "asks")


def mine(vectors: DataFrame, anchor_every: int = 50, cells: int = BLOCK_CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    ``vectors``: vec_id, embedding, label; ``summaries`` says which rows take part.  Scores are whole inner products of
    floor(256 * x) and must fit 64 bits.  Anchors are the rows whose vec_id ``anchor_every`` divides.  Vectors of another length
    have no score with an anchor and are no candidates of its.  Ties go to the smaller vec_id.  An anchor without positives, or
    a positive without negatives in range, gives no rows, as does an empty table.  Other columns are not read.
    """
    rows = staged(summaries(vectors))
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    found = _blocks(rows, anchors, ["size", "label"], cells).mapInArrow(_positives, "anchor_id long, positive_id long, positive_score long")
    turn = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = staged(found.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= POSITIVES).drop("turn"))
    of_anchor = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asking = staged(anchors.join(of_anchor, "vec_id"))
    found = _blocks(rows, asking, ["size"], cells).mapInArrow(_negatives, _PAIRS)
    turn = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= NEGATIVES)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors of ``embeddings`` among all rows; ``mine`` states the odd cases."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
