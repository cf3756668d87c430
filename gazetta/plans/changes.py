"""Queries on versions: observations are events, a document being a user and its content the event's type and properties."""

from pyspark.sql import functions as F

from ..operators import versioning as V
from .base import query, table

_OBS = """obs AS (SELECT user_id AS document_id, event_id, ts,
  sha256(concat(event_type, chr(29), coalesce(props, ''))) AS version_hash FROM events)"""


def observations(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat("event_type", F.lit("\x1d"), F.coalesce("props", F.lit("")))
    return e.select(F.col("user_id").alias("document_id"), "event_id", "ts", F.sha2(text, 256).alias("version_hash"))


def split(spark, sf):
    """Earlier and later observations, as stored state and incoming batch."""
    obs = observations(spark, sf)
    cut = F.col("event_id") % 3 > 0
    return obs.where(cut), obs.where(~cut)


_SPLIT = _OBS + """, early AS (SELECT * FROM obs WHERE event_id % 3 > 0), late AS (SELECT * FROM obs WHERE event_id % 3 = 0),
latest AS (SELECT * FROM early QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1),
batch AS (SELECT * FROM late QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1)"""
_NEWEST = [F.desc, "ts", "event_id"]


def _newest(df):
    return V.latest_per_key(df, ["document_id"], [F.desc("ts"), F.desc("event_id")])


@query("v1_version_hash", """
WITH s AS (SELECT l_orderkey AS version_id, string_agg(concat_ws(chr(31), 'f' || l_partkey, 'u' || l_suppkey, coalesce(l_returnflag, '')), chr(30)
    ORDER BY 'u' || l_suppkey, 'f' || l_partkey, concat_ws(chr(31), 'f' || l_partkey, 'u' || l_suppkey, coalesce(l_returnflag, ''))) AS signature
  FROM lineitem GROUP BY 1)
SELECT o_orderkey AS version_id, sha256(concat(coalesce(o_orderpriority, ''), chr(29), coalesce(o_orderstatus, ''), chr(29), coalesce(signature, ''))) AS version_hash
FROM orders LEFT JOIN s ON version_id = o_orderkey""")
def v1(spark, sf):
    notices = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("content_text"))
    files = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("version_id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_name"),
        F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("download_url"), F.col("l_returnflag").alias("file_hash"))
    return V.version_hash(notices, files).select("version_id", "version_hash")


@query("v2_classify_changes", f"""
WITH {_SPLIT} SELECT b.document_id, b.event_id, CASE WHEN l.document_id IS NULL THEN 'NEW' WHEN l.version_hash = b.version_hash THEN 'UNCHANGED' ELSE 'UPDATED' END AS change_type
FROM batch b LEFT JOIN latest l USING (document_id)""")
def v2(spark, sf):
    early, late = split(spark, sf)
    return V.classify_changes(_newest(late), _newest(early)).select("document_id", "event_id", "change_type")


@query("v3_append_versions", f"""
WITH {_SPLIT} SELECT document_id, version_hash, CAST(1 AS BIGINT) AS version_no FROM latest
UNION ALL SELECT b.document_id, b.version_hash, CAST(CASE WHEN l.document_id IS NULL THEN 1 ELSE 2 END AS BIGINT)
FROM batch b LEFT JOIN latest l USING (document_id) WHERE l.document_id IS NULL OR l.version_hash <> b.version_hash""")
def v3(spark, sf):
    early, late = split(spark, sf)
    stored = _newest(early).select("document_id", "version_hash", F.lit(1).cast("long").alias("version_no"))
    return V.append_versions(_newest(late).select("document_id", "version_hash"), stored)


@query("v4_build_history", f"""
WITH {_OBS}, k AS (SELECT *, lag(version_hash) OVER w AS before, row_number() OVER w AS rn FROM obs WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN rn = 1 THEN 'NEW' WHEN before = version_hash THEN 'UNCHANGED' ELSE 'UPDATED' END AS change_type FROM k)
SELECT document_id, event_id, change_type, CAST(sum(CASE WHEN change_type = 'UNCHANGED' THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS BIGINT) AS version_no FROM c""")
def v4(spark, sf):
    out = V.build_history(observations(spark, sf), "document_id", ["ts", "event_id"])
    return out.select("document_id", "event_id", "change_type", "version_no")


@query("v5_upsert_documents", """
SELECT user_id % 7 AS source_id, event_type || '/' || user_id AS original_url, min(ts) AS first_detected_at, max(ts) AS last_detected_at FROM events GROUP BY 1, 2""")
def v5(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 7).alias("source_id"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("original_url"), F.col("ts").alias("detected_at"), "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    stored = old.groupBy("source_id", "original_url").agg(F.min("detected_at").alias("first_detected_at"), F.max("detected_at").alias("last_detected_at"))
    return V.upsert_documents(new, stored)


@query("v6_dedupe_detections", """
WITH d AS (SELECT event_id, ts, user_id AS document_id, event_id % 10 AS run_source_id, event_id % 4 = 0 AS stored FROM events)
SELECT run_source_id, document_id, event_id FROM d WHERE NOT stored AND (run_source_id, document_id) NOT IN (SELECT run_source_id, document_id FROM d WHERE stored)
QUALIFY row_number() OVER (PARTITION BY run_source_id, document_id ORDER BY ts, event_id) = 1""")
def v6(spark, sf):
    d = table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("document_id"), (F.col("event_id") % 10).alias("run_source_id"))
    keys = ["run_source_id", "document_id"]
    return V.dedupe_detections(d.where("event_id % 4 <> 0"), d.where("event_id % 4 = 0"), keys, [F.asc("ts"), F.asc("event_id")]).select(*keys, "event_id")


@query("v7_refresh_attachments", """
WITH a AS (SELECT l_orderkey AS version_id, l_linenumber, 'u' || l_linenumber AS download_url, l_linestatus AS parse_status, l_shipdate FROM lineitem)
SELECT s.version_id, s.download_url, coalesce(i.parse_status, s.parse_status) AS parse_status
FROM (SELECT * FROM a WHERE l_linenumber <= 3) s LEFT JOIN (SELECT DISTINCT version_id, download_url, 'R' AS parse_status FROM a WHERE l_linenumber BETWEEN 2 AND 5) i USING (version_id, download_url)""")
def v7(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version_id"), "l_linenumber", F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("download_url"), F.col("l_linestatus").alias("parse_status"))
    new = a.where("l_linenumber BETWEEN 2 AND 5").withColumn("parse_status", F.lit("R"))
    return V.refresh_attachments(a.where("l_linenumber <= 3"), new, ["parse_status"]).select("version_id", "download_url", "parse_status")


def _members(spark, sf, odd):
    from pyspark.sql.window import Window

    li = table(spark, sf, "lineitem").where(F.col("l_linenumber") % 2 == odd)
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return li.select(F.col("l_orderkey").alias("version_id"), place.cast("long").alias("position"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("name"), F.floor("l_quantity").cast("string").alias("text"))


@query("v8_align_members")
def v8(spark, sf):
    return V.align_members(_members(spark, sf, 1), _members(spark, sf, 0))


@query("v9_line_changes")
def v9(spark, sf):
    d = table(spark, sf, "documents")
    a = d.where("doc_id % 2 = 0").select(F.expr("doc_id div 2").alias("pair_id"), F.col("text").alias("old"))
    b = d.where("doc_id % 2 = 1").select(F.expr("doc_id div 2").alias("pair_id"), F.col("text").alias("new"))
    return V.line_changes(a.join(b, "pair_id"), "pair_id", "old", "new")


@query("v10_backfill", """
SELECT o_orderkey, CASE WHEN v IS NULL OR v < 2 THEN floor(o_totalprice / 1000) ELSE -1 END AS score, CASE WHEN v IS NULL OR v < 2 THEN 2 ELSE v END AS ranking_version
FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INTEGER) END AS v FROM orders)""")
def v10(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(-1.0).alias("score"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 4).cast("int")).alias("ranking_version"))
    return V.backfill(o, 2, {"score": F.floor(F.col("o_totalprice") / 1000).cast("double")}).drop("o_totalprice")


@query("v11_merge_results", """
SELECT action, count(*) AS n FROM (SELECT CASE WHEN s.o_orderkey IS NULL OR i.rev > s.rev THEN 'stored' WHEN i.rev = s.rev THEN 'duplicate' ELSE 'ignored' END AS action
  FROM (SELECT o_orderkey, o_orderkey % 3 AS rev FROM orders) i LEFT JOIN (SELECT o_orderkey, o_custkey % 3 AS rev FROM orders WHERE o_orderstatus <> 'F') s USING (o_orderkey)) GROUP BY 1""")
def v11(spark, sf):
    o = table(spark, sf, "orders")
    stored = o.where("o_orderstatus <> 'F'").select("o_orderkey", (F.col("o_custkey") % 3).alias("revision"))
    return V.merge_results(stored, o.select("o_orderkey", (F.col("o_orderkey") % 3).alias("revision")), "o_orderkey").groupBy("action").agg(F.count("*").alias("n"))


RISK_TYPES = ["DUPLICATE_SUPPORT", "COST_DOUBLE_COUNTING", "RESULT_IP_REUSE", "CONFIDENTIALITY", "PROPOSAL_TEXT_REUSE"]


@query("v12_merge_findings", """
WITH f AS (SELECT l_orderkey AS analysis_id, l_linenumber, l_suppkey % 6 AS job_id, ['DUPLICATE_SUPPORT', 'COST_DOUBLE_COUNTING', 'RESULT_IP_REUSE', 'CONFIDENTIALITY', 'PROPOSAL_TEXT_REUSE', 'OTHER'][1 + l_partkey % 6] AS type FROM lineitem),
s AS (SELECT *, 0 AS fresh FROM f WHERE l_linenumber <= 3), i AS (SELECT *, 1 AS fresh FROM f WHERE l_linenumber > 3 AND (analysis_id, job_id) NOT IN (SELECT analysis_id, job_id FROM s))
SELECT analysis_id, type, CAST(list_position(['DUPLICATE_SUPPORT', 'COST_DOUBLE_COUNTING', 'RESULT_IP_REUSE', 'CONFIDENTIALITY', 'PROPOSAL_TEXT_REUSE'], type) AS BIGINT) AS type_order, max(fresh) * 10 + max(job_id) FILTER (fresh = m) AS winner
FROM (SELECT *, max(fresh) OVER (PARTITION BY analysis_id, type) AS m FROM (SELECT * FROM s UNION ALL SELECT * FROM i) WHERE type <> 'OTHER') GROUP BY ALL""")
def v12(spark, sf):
    kinds = F.array(*map(F.lit, [*RISK_TYPES, "OTHER"]))
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), "l_linenumber", (F.col("l_suppkey") % 6).alias("job_id"), F.element_at(kinds, (F.col("l_partkey") % 6 + 1).cast("int")).alias("type"))
    old = f.where("l_linenumber <= 3")
    out = V.merge_findings(old.withColumn("fresh", F.lit(0)), f.where("l_linenumber > 3").withColumn("fresh", F.lit(1)), RISK_TYPES)
    return out.select("analysis_id", "type", "type_order", (F.col("fresh") * 10 + F.col("job_id")).alias("winner"))
