"""Queries on streams over the stored tables, taken in to the end; each equals its batch form."""

import uuid

from pyspark.sql import functions as F

from ..streaming import jobs as J
from .base import query, table
from .changes import _OBS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark):
    """A new folder in the shared one that the cluster names; in a session that names none, in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _with_rocks(spark, run):
    """Run a stateful stream under the state store that it needs, in a new folder."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return run(_folder(spark))
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(schema).parquet(path + "*")


@query("m1_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def m1(spark, sf):
    out = J.stream_dedupe(_stream(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", "3650 days")
    base = _folder(spark)
    return J.run_to_end(out, f"{base}/out", f"{base}/checkpoint").select("user_id", "event_type")


@query("m2_stream_versions", f"""
WITH {_OBS}, k AS (SELECT *, lag(version_hash) OVER w AS before, row_number() OVER w AS rn FROM obs WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id))
SELECT CASE WHEN rn = 1 THEN 'NEW' WHEN before = version_hash THEN 'UNCHANGED' ELSE 'UPDATED' END AS change_type, count(*) AS n FROM k GROUP BY 1""")
def m2(spark, sf):
    e = _stream(spark, sf, "events")
    text = F.concat("event_type", F.lit("\x1d"), F.coalesce("props", F.lit("")))
    obs = e.select(F.col("user_id").alias("document_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.sha2(text, 256).alias("version_hash"))
    out = _with_rocks(spark, lambda base: J.run_to_end(J.stream_versions(obs), f"{base}/out", f"{base}/checkpoint"))
    return out.groupBy("change_type").agg(F.count("*").alias("n"))


def _runs(spark, sf):
    """Each event is the acceptance of a run at its time, and the run's result ``value`` minutes later."""
    e = _stream(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("value", F.lit(0.0)).alias("value"))
    done = F.timestamp_millis(F.unix_millis("ts") + F.round(F.col("value") * 60000).cast("long"))
    both = F.array(F.struct(F.col("ts").alias("ts"), F.lit("accepted").alias("kind")), F.struct(done.alias("ts"), F.lit("result").alias("kind")))
    rows = e.select(F.col("event_id").alias("run_id"), F.explode(both).alias("x")).select("run_id", "x.ts", "x.kind")
    return _with_rocks(spark, lambda base: J.run_to_end(J.stream_runs(rows, 3600), f"{base}/out", f"{base}/checkpoint"))


@query("m3_run_expiry", "SELECT event_id AS run_id, CASE WHEN coalesce(value, 0) <= 60 THEN 'COLLECTED' ELSE 'FAILED' END AS outcome FROM events")
def m3(spark, sf):
    return _runs(spark, sf).where("outcome <> 'LATE'").select("run_id", "outcome")


@query("m4_late_results", "SELECT event_id AS run_id, CAST(1 AS BIGINT) AS late FROM events WHERE value > 60")
def m4(spark, sf):
    return _runs(spark, sf).where("outcome = 'LATE'").select("run_id", "late")


@query("m5_stream_corpus_stats", """WITH l AS (SELECT user_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
t AS (SELECT DISTINCT user_id, unnest([event_type, props]) AS term FROM l) SELECT term, count(*) AS df FROM t WHERE term IS NOT NULL GROUP BY 1""")
def m5(spark, sf):
    """A user's events are versions of one document, of two terms; only the latest counts."""
    e = _stream(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("document_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.array_compact(F.array("event_type", "props")).alias("terms"))

    def run(base):
        J.stream_corpus_stats(rows, f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return J.corpus_stats(spark, f"{base}/out")[0]

    return _with_rocks(spark, run)
