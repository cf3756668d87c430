"""Shared pieces: staged tables, distributed ranks, size-checked broadcasts, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a two- or three-column side that may be broadcast (about 16 bytes a row).
BROADCAST_ROWS = 200_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, as in tests, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: a lost executor costs its unfinished tasks, not the work before.  What the write shuffled is
    removed at its end, so that the disk holds one step's shuffles at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it has at most ``limit`` rows, else unchanged.

    ``df`` should be staged: it is counted.
    """
    return F.broadcast(df) if df.count() <= limit else df


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Append ``name``: the row's position (from 0) in the whole order; no task sees all rows.

    Rows are range-partitioned and sorted; per-partition counts (one row for each
    shuffle partition, so bounded by configuration) give each partition's first position.
    """
    placed = staged(df.sort(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    firsts, first = [], 0
    for p, n in sorted(counts.collect()):
        firsts.append((p, first))
        first += n
    firsts = df.sparkSession.createDataFrame(firsts, "__part long, __first long")
    return (
        placed.join(F.broadcast(firsts), part == F.col("__part"))
        .withColumn(name, F.col("__first") + place)
        .drop("__at", "__part", "__first")
    )


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns: rows that share doc_id and key are the same row repeated."""
    return F.xxhash64(*docs.columns)


def same(a: str, b: str, *columns: str) -> Column:
    """The columns of two aliased tables agree, nulls with nulls."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` (doc_id, row_key; staged) names, once each however often they are repeated."""
    keyed = docs.withColumn("row_key", row_key(docs))
    often = kept.groupBy("doc_id", "row_key").agg(F.count("*").alias("n"))
    out = keyed.alias("d").join(kept.alias("k"), same("d", "k", "doc_id", "row_key"), "left_semi")
    again = often.where("n > 1")
    if not again.isEmpty():
        twice = same("d", "k", "doc_id", "row_key")
        once = out.alias("d").join(again.alias("k"), twice, "left_anti")
        out = once.unionByName(out.alias("d").join(again.alias("k"), twice, "left_semi").dropDuplicates(["doc_id", "row_key"]))
    return out.select(docs.columns)


#: A key with more rows is hot; there are no more hot keys than the number of rows over this.
HOT = 100_000


def join_once(rows: DataFrame, table: DataFrame, key: str | list[str], hot: DataFrame) -> DataFrame:
    """Join on a key (one column or several) that ``table`` has once and rows may have any share of.

    The keys in ``hot`` (staged) meet their rows where these are, the others in a shuffle.
    """
    if hot.isEmpty():
        return rows.join(table, key)
    few = small_side(hot.select(key))
    often = rows.join(few, key, "left_semi").join(small_side(staged(table.join(few, key, "left_semi"))), key)
    return often.unionByName(rows.join(few, key, "left_anti").join(table, key))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60, hot: int = HOT) -> DataFrame:
    """Connected components: (id, component), component being the smallest id reachable.

    ``nodes`` has column ``id`` (long, distinct), ``edges`` columns ``a`` and ``b``.
    Alternates large-star and small-star steps, each an aggregate and a join on the node; nodes with over ``hot``
    neighbours are joined where their edges are.  Each round is staged; the rounds end when every component is a
    star about its smallest id.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = staged(edges.distinct())

    def least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        out = staged(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        return out.select("a", "m"), out.where(F.col("n") > hot)

    for _ in range(max_rounds):
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest, many = least(both)
        large = join_once(both, lowest.withColumn("m", F.least("a", "m")), "a", many)
        large = staged(large.where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        lowest, many = least(large)
        small = join_once(large, lowest, "a", many)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = staged(small.where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.select("id").join(star, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
