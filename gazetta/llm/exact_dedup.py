"""Exact dedup over an extendible-hash index kept in shared files; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, HOT, join_once, keep_rows, row_key, small_side, staged

#: Distinct keys that a bucket holds before it is split.
BUCKET_KEYS = 4096
_DEEPEST = 62


def normalised(text: Column) -> Column:
    """The text without white space of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _prefix(h: Column, depth: Column) -> Column:
    """The first ``depth`` bits of a key."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, (64 - depth).cast("int")))


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) for distinct keys ``keys(h)``, and the global depth: slots are its first bits.

    The directory doubles while a bucket is overfull.  A bucket's local depth is the first at which its keys fit, and all
    slots that begin with its bits lead to it; its number is a one before these bits.  As keys are distinct and a deep
    directory only follows their number, the slots are a small share of the keys.
    """
    held = staged(keys.select("h", F.lit(0).alias("depth")))
    while True:
        buckets = staged(held.groupBy("depth", _prefix(F.col("h"), F.col("depth")).alias("prefix")).agg(F.count("*").alias("n")))
        over = buckets.where((F.col("n") > bucket_keys) & (F.col("depth") < _DEEPEST))
        if over.isEmpty():
            break
        # A doubling at best halves a bucket: those that it surely needs go together.
        needs = F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / bucket_keys)).cast("int"))
        deeper = over.select("depth", "prefix", F.least(F.lit(_DEEPEST), F.col("depth") + needs).alias("deeper"))
        placed = held.withColumn("prefix", _prefix(F.col("h"), F.col("depth"))).join(small_side(staged(deeper)), ["depth", "prefix"], "left")
        held = staged(placed.select("h", F.coalesce("deeper", "depth").alias("depth")))
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    free = (depth - F.col("depth")).cast("int")
    slots = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), free) - 1), lambda i: F.call_function("shiftleft", F.col("prefix"), free).bitwiseOR(i)))
    number = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth")).bitwiseOR(F.col("prefix"))
    return staged(buckets.select(slots.alias("slot"), number.alias("bucket"), F.col("depth").alias("local_depth"))), depth


def build_index(entries: DataFrame, texts: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame]:
    """The index, one row for each class of equal texts, and ``entries`` with the bucket that the directory leads them to.

    ``entries``: h, doc_id, row_key, code_points, text_sha256; ``texts``: h, norm, code_points, doc_id, row_key of the same rows.
    A bucket's keys are chains of classes.  Of a key that one row has, that row is the chain; the rows of a repeated key are
    grouped by all their bytes, partly before the shuffle, so that a text with any number of copies moves once a task.
    Owner tasks, each with a range of buckets, number the classes of a chain and write their buckets to files of their own; rows
    find their class there by the bucket that the directory leads them to, and their key in it.
    """
    counts = staged(entries.groupBy("h").agg(F.count("*").alias("n")))
    slots, depth = directory(counts.select("h"), bucket_keys)
    slots = small_side(slots.select("slot", "bucket"))

    def found(rows: DataFrame) -> DataFrame:
        return rows.withColumn("slot", _prefix(F.col("h"), F.lit(depth))).join(slots, "slot").drop("slot")

    best = F.struct("code_points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("neg"), "row_key")
    repeated = found(counts.where("n > 1").drop("n"))
    repeated = small_side(staged(repeated), 5 * BROADCAST_ROWS)
    chains = texts.join(repeated, "h").groupBy("bucket", "h", "norm").agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
    single = found(entries).join(counts.where("n = 1").drop("n"), "h")
    single = single.select("bucket", "h", F.lit(None).cast("string").alias("norm"), best.alias("best"), F.lit(1).cast("long").alias("group_size"))
    place, chain = Window.partitionBy("bucket", "h").orderBy("norm"), Window.partitionBy("bucket", "h")
    index = single.unionByName(chains).repartitionByRange("bucket").withColumns({"place": F.row_number().over(place), "links": F.count("*").over(chain)})
    index = index.select("bucket", "h", "place", "links", "norm", (-F.col("best.neg")).alias("keep_id"), F.col("best.row_key").alias("keep_key"), "group_size")
    return staged(index), found(entries)


def exact_dedup(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, key_of=F.xxhash64) -> DataFrame:
    """doc_id, row_key, keep_id, keep_key, group_size, kept, text_sha256, bucket: one row for each row of ``docs``.

    Texts are equal when identical without white space.  Null and empty texts are equal.  Of equal texts the one with the
    most code points stays, then the smallest doc_id; rows without an id come after all others.  Rows of one doc_id are
    documents each; ``row_key``, a hash of all columns, tells them apart, and only the same row repeated is marked alike.
    keep_id is null where no member of a class has an id.  An empty table gives no rows.
    ``key_of`` makes the 64-bit key of a text; texts of one key are told apart by their bytes.
    """
    rows = docs.select("doc_id", "text", row_key(docs).alias("row_key"))
    rows = rows.withColumn("norm", normalised(F.col("text"))).withColumn("h", key_of("norm"))
    rows = rows.withColumn("code_points", F.char_length(F.coalesce("text", F.lit(""))))
    entries = staged(rows.select("doc_id", "row_key", "h", "code_points", F.sha2("norm", 256).alias("text_sha256")))
    index, placed = build_index(entries, rows.select("h", "norm", "code_points", "doc_id", "row_key"), bucket_keys)
    found = index.select("bucket", "h", "links", "keep_id", "keep_key", "group_size", "norm")
    hot = staged(found.where((F.col("group_size") > HOT) & (F.col("links") == 1)).select("bucket", "h"))
    out = join_once(placed, found.where("links = 1").drop("norm", "links"), ["bucket", "h"], hot)
    names = ["doc_id", "row_key", "keep_id", "keep_key", "group_size", "text_sha256", "bucket"]
    out = out.select(names)
    chained = staged(found.where("links > 1").drop("links"))
    if not chained.isEmpty():  # several texts of one key: the bytes decide
        texts = placed.join(chained.select("bucket", "h").distinct(), ["bucket", "h"], "left_semi").join(rows.select("doc_id", "row_key", "norm").distinct().withColumnsRenamed({"doc_id": "__doc", "row_key": "__key"}),
                            F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("row_key") == F.col("__key")))
        out = out.unionByName(texts.join(chained, ["bucket", "h", "norm"]).select(names))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_key") == F.col("keep_key"))
    return out.withColumn("kept", kept)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class of equal texts; a text is never lost, whatever ids its rows have."""
    return keep_rows(docs, staged(exact_dedup(docs).where("kept").select("doc_id", "row_key")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for it; ``exact_dedup`` states the odd cases."""
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
