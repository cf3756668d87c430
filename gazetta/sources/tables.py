"""Reading and writing entity tables, nested collection batches, JSON columns and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
ATTACHMENT = T.StructType(
    [T.StructField(n, _S) for n in ("file_name", "download_url", "content_type", "file_hash", "extracted_text", "archive_entries_json", "parse_status", "error_message")]
    + [T.StructField("file_size", T.LongType())]
)
DOCUMENT = T.StructType(
    [T.StructField(n, _S) for n in ("original_url", "external_document_id", "title", "content_text", "published_at")]
    + [T.StructField("attachments", T.ArrayType(ATTACHMENT))]
)
SOURCE = T.StructType(
    [T.StructField("source_id", T.LongType()), T.StructField("status", _S), T.StructField("error_message", _S), T.StructField("documents", T.ArrayType(DOCUMENT))]
)
BATCH = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("job_id", _S), T.StructField("sources", T.ArrayType(SOURCE))])


def flatten_collection(batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, documents and attachments of nested batches; sources and documents without children stay."""
    s = batch.select("run_id", "job_id", F.posexplode_outer("sources").alias("source_no", "s"))
    sources = s.select("run_id", "job_id", "source_no", "s.source_id", "s.status", "s.error_message", F.coalesce(F.size("s.documents"), F.lit(0)).alias("documents"))
    d = s.select("run_id", "s.source_id", F.posexplode("s.documents").alias("document_no", "d"))
    documents = d.select("run_id", "source_id", "document_no", *[f"d.{n}" for n in DOCUMENT.names[:-1]])
    files = d.select("run_id", "source_id", "document_no", F.posexplode("d.attachments").alias("attachment_no", "a")).select("run_id", "source_id", "document_no", "attachment_no", "a.*")
    return sources, documents, files


def read_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return flatten_collection(spark.read.schema(BATCH).json(path))


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def write_table(df: DataFrame, path: str, partitions: list[str] | None = None, mode: str = "append") -> None:
    """Write a table; rows of one partition value are brought together first, so that each gets few files."""
    if partitions:
        df.repartition(*partitions).write.mode(mode).partitionBy(*partitions).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def parse_json_column(df: DataFrame, column: str, schema: str, into: str = "parsed") -> DataFrame:
    """Parse a JSON text column; unreadable text stays and is flagged in ``<into>_ok`` (null text is neither)."""
    parsed = F.from_json(column, schema)
    readable = F.when(F.col(column).isNotNull(), F.try_parse_json(F.col(column)).isNotNull())
    return df.withColumns({into: parsed, f"{into}_ok": readable})


#: First bytes of file types (fixed values): PDF, ZIP containers, old office files, PNG, JPEG, GIF.
SIGNATURES = {"pdf": "25504446", "zip": "504B0304", "ole": "D0CF11E0A1B11AE1", "png": "89504E47", "jpg": "FFD8FF", "gif": "47494638"}


def file_inventory(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Path, size, SHA-256, declared and sniffed type, and whether the file is over ``max_bytes`` (then it is not read whole)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring("content", 1, 8))
    kind = F.lit(None).cast("string")
    for name, magic in SIGNATURES.items():
        kind = F.when(F.startswith(head, F.lit(magic)), name).otherwise(kind)
    small = F.col("length") <= max_bytes
    return files.select(
        "path", F.col("length").alias("file_size"), F.when(small, F.sha2("content", 256)).alias("file_hash"),
        F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,10})$", 1)).alias("declared_type"), kind.alias("sniffed_type"), (~small).alias("oversize"),
    )
