"""Queries on lists and rollups: orders stand for versions, tasks and runs, lineitem for detections and files, customer for runs."""

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import lists as L
from ..operators.versioning import latest_per_key
from .base import query, table

NOW = datetime(1996, 1, 1)


@query("s2_read_tables", """
SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents""")
def s2(spark, sf):
    from ..sources.tables import read_tables

    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
    out = None
    for name, df in read_tables(spark, sf, names).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("s10_run_report", """
WITH b AS (SELECT o_custkey AS run_id, o_orderkey, '[' || o_orderstatus || '] ' || o_orderkey || ' ' || o_orderpriority AS block FROM orders),
s AS (SELECT *, sum(length(block) + 1) OVER (PARTITION BY run_id ORDER BY o_orderkey) <= 120 AS fits FROM b)
SELECT run_id, coalesce(string_agg(block, chr(10) ORDER BY o_orderkey) FILTER (fits), '') AS report, count(*) FILTER (NOT fits) AS remaining FROM s GROUP BY 1""")
def s10(spark, sf):
    o = table(spark, sf, "orders")
    block = F.concat(F.lit("["), "o_orderstatus", F.lit("] "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority")
    return L.run_report(o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("position"), block.alias("block")), 120)


@query("f3_filter_detections", "SELECT event_id, user_id FROM events WHERE user_id % 5 = 2 AND ts >= (SELECT min(ts) FROM events) + INTERVAL 2 DAY")
def f3(spark, sf):
    e = table(spark, sf, "events").withColumn("run_id", F.col("user_id") % 5)
    first = e.agg(F.min("ts")).first()[0]
    from datetime import timedelta

    return L.filter_detections(e, 2, first + timedelta(days=2), None, "ts").select("event_id", "user_id")


@query("f4_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def f4(spark, sf):
    return L.search(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], " Brand#1 ").select("p_partkey", "p_name")


@query("f5_priority_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND contains(lower(o_orderstatus), 'o')")
def f5(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority")
    return L.search(o, ["o_orderstatus"], "O", "1-URGENT").select("o_orderkey")


_STATES = "['PENDING', 'COLLECTED', 'COMPLETED', 'FAILED']"


@query("f6_analysis_status", f"""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'COMPLETED' WHEN {_STATES}[1 + o_orderkey % 4] IN ('PENDING', 'COLLECTED') AND (o_orderstatus = 'O' OR o_orderkey % 7 = 0) THEN 'PENDING' ELSE 'FAILED' END AS status FROM orders""")
def f6(spark, sf):
    run = F.element_at(F.array(*map(F.lit, ["PENDING", "COLLECTED", "COMPLETED", "FAILED"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    task = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string")).when(F.col("o_orderstatus") == "O", "OPEN").otherwise("ANALYZED")
    return table(spark, sf, "orders").select("o_orderkey", L.analysis_status(F.col("o_custkey") % 3 == 0, run, task).alias("status"))


@query("f7_needs_analysis", """
SELECT o_orderkey AS version_id FROM orders LEFT JOIN (SELECT l_orderkey, CAST(l_suppkey % 5 AS BIGINT) AS rev, l_partkey % 11 = 0 AS up, l_quantity > 45 AS pending FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'A') ON l_orderkey = o_orderkey
WHERE (o_orderstatus = 'O' OR l_orderkey IS NULL OR rev < 3 OR up OR pending) AND o_totalprice > 50000""")
def f7(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), F.when(F.col("o_orderstatus") == "O", "UPDATED").otherwise("UNCHANGED").alias("change_type"), F.when(F.col("o_totalprice") > 50000, 1).otherwise(0).alias("text_chars"))
    a = table(spark, sf, "lineitem").where("l_linenumber = 1 AND l_returnflag <> 'A'").select(F.col("l_orderkey").alias("version_id"), (F.col("l_suppkey") % 5).alias("settings_revision"), (F.col("l_partkey") % 11 == 0).alias("schema_upgrade"), F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("pending_types"))
    return L.needs_analysis(o, a, 3).select("version_id")


@query("f11_pending_reviews", """
WITH a AS (SELECT o_orderkey AS analysis_id, CAST(o_custkey % 3 AS BIGINT) AS v, CAST(o_orderkey % 5 AS BIGINT) AS attempts, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1995-12-31 23:45:00' ELSE TIMESTAMP '1995-12-31 12:00:00' END AS seen FROM orders),
f AS (SELECT l_orderkey AS analysis_id, ['DUPLICATE_SUPPORT', 'COST_DOUBLE_COUNTING', 'CONFIDENTIALITY'][1 + l_partkey % 3] AS type, ['CAUTION', 'NOT_FOUND', 'ERROR'][1 + l_suppkey % 3] AS status, ['', 'CONTEXT_LIMIT', 'INTERPRETATION_MISSING'][1 + l_linenumber % 3] AS reason, l_returnflag AS summary FROM lineitem),
p AS (SELECT analysis_id, type, count(*) AS n, bool_and(reason = 'CONTEXT_LIMIT' OR (status <> 'ERROR' AND summary <> '' AND reason <> 'INTERPRETATION_MISSING')) AS sound FROM f GROUP BY 1, 2)
SELECT a.analysis_id, t.type FROM a, (SELECT unnest(['DUPLICATE_SUPPORT', 'COST_DOUBLE_COUNTING', 'CONFIDENTIALITY']) AS type) t LEFT JOIN p ON p.analysis_id = a.analysis_id AND p.type = t.type
WHERE v <> 2 OR (NOT (attempts >= 3 OR seen + INTERVAL 30 MINUTE > TIMESTAMP '1996-01-01') AND (coalesce(n, 0) <> 1 OR NOT coalesce(sound, false)))""")
def f11(spark, sf):
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 3 + 1).cast("int"))
    at = F.when(F.col("o_orderkey") % 2 == 0, F.lit("1995-12-31 23:45:00")).otherwise("1995-12-31 12:00:00").cast("timestamp_ntz")
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("analysis_id"), (F.col("o_custkey") % 3).alias("review_version"), (F.col("o_orderkey") % 5).alias("attempts"), at.alias("reviewed_at"))
    names = ["DUPLICATE_SUPPORT", "COST_DOUBLE_COUNTING", "CONFIDENTIALITY"]
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), pick(names, "l_partkey").alias("type"), pick(["CAUTION", "NOT_FOUND", "ERROR"], "l_suppkey").alias("status"),
                                            pick(["", "CONTEXT_LIMIT", "INTERPRETATION_MISSING"], "l_linenumber").alias("failure_reason"), F.col("l_returnflag").alias("summary"))
    return L.pending_reviews(a, f, spark.createDataFrame([(n,) for n in names], "type string"), NOW)


@query("j1_detection_summary", """
WITH t AS (SELECT o_custkey AS run_id, o_orderstatus AS task_state FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT l_orderkey * 10 + l_linenumber AS detection_id, p_name AS title, n_name AS organization, o_totalprice AS score, task_state
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders v ON v.o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN t ON t.run_id = o_custkey""")
def j1(spark, sf):
    o = table(spark, sf, "orders")
    keys = o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("run_source_id"), F.col("o_custkey").alias("run_id"))
    d = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("detection_id"), F.col("l_partkey").alias("document_id"), F.col("l_orderkey").alias("version_id"))
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("title"))
    run_sources = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_source_id"), F.col("c_nationkey").alias("source_id"))
    sources = table(spark, sf, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("organization"))
    analyses = o.select(F.col("o_orderkey").alias("version_id"), F.col("o_totalprice").alias("score"))
    tasks = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("state"))
    return L.detection_summary(d, docs, keys, run_sources, sources, analyses, tasks).select("detection_id", "title", "organization", "score", "task_state")


@query("j2_bookmarked", "SELECT o_orderkey AS version_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)")
def j2(spark, sf):
    marks = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("version_id"))
    return L.bookmarked(table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id")), marks, 3)


@query("j3_unqueued_runs", "SELECT c_custkey AS run_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j3(spark, sf):
    o = table(spark, sf, "orders").withColumn("run_id", F.col("o_custkey"))
    return L.unqueued_runs(table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id")), o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderstatus = 'P'"))


@query("j4_with_previous", """
WITH v AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders)
SELECT v.o_orderkey AS version_id, v.prev AS previous_version_id, a.o_totalprice AS previous_score FROM v LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') a ON a.o_orderkey = v.prev""")
def j4(spark, sf):
    o = table(spark, sf, "orders")
    v = o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_no"))
    a = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("version_id"), F.col("o_totalprice").alias("previous_score"))
    return L.with_previous(v, a).select("version_id", "previous_version_id", "previous_score")


@query("j5_run_history", "SELECT a.o_orderkey AS run_id, a.o_orderdate AS requested_at, b.o_orderstatus AS report_status FROM orders a LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'O') b USING (o_orderkey)")
def j5(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "run_id")
    return L.run_history(o.select("run_id", F.col("o_orderdate").alias("requested_at")), o.where("o_orderstatus <> 'O'").select("run_id", F.col("o_orderstatus").alias("report_status")))


@query("j6_attachment_diff", """
WITH f AS (SELECT l_orderkey // 2 AS document_id, l_orderkey % 2 AS side, l_returnflag || l_linenumber % 3 AS name, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey % 4 AS VARCHAR) END AS text FROM lineitem),
p AS (SELECT document_id, name, count(*) AS n, max(text) AS t FROM f WHERE side = 0 GROUP BY 1, 2), c AS (SELECT document_id, name, count(*) AS n, max(text) AS t FROM f WHERE side = 1 GROUP BY 1, 2)
SELECT document_id, name, CASE WHEN p.n > 1 OR c.n > 1 THEN 'AMBIGUOUS_NAME' WHEN p.n IS NULL THEN 'ADDED' WHEN c.n IS NULL THEN 'REMOVED' WHEN coalesce(p.t, '') = '' OR coalesce(c.t, '') = '' THEN 'UNCOMPARABLE' WHEN p.t = c.t THEN 'TEXT_UNCHANGED' ELSE 'TEXT_CHANGED' END AS change
FROM p FULL JOIN c USING (document_id, name)""")
def j6(spark, sf):
    f = table(spark, sf, "lineitem").select(F.expr("l_orderkey div 2").alias("document_id"), (F.col("l_orderkey") % 2).alias("side"), F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("name"),
                                            F.when(F.col("l_suppkey") % 7 != 0, (F.col("l_suppkey") % 4).cast("string")).alias("text"))
    return L.attachment_diff(f.where("side = 0"), f.where("side = 1"))


@query("j7_split_valid_results", """
SELECT l_orderkey * 10 + l_linenumber AS detection_id, o_orderkey IS NOT NULL AND l_suppkey % 10 = o_custkey % 10 AS valid FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey""")
def j7(spark, sf):
    r = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"), F.col("l_orderkey").alias("detection_id"), F.col("l_orderkey").alias("version_id"), (F.col("l_suppkey") % 10).alias("document_id"))
    d = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("detection_id"), F.col("o_orderkey").alias("version_id"), (F.col("o_custkey") % 10).alias("document_id"))
    return L.split_valid_results(r, d, ["version_id", "document_id"]).select(F.col("rid").alias("detection_id"), "valid")


def _audit(spark, sf):
    lab = table(spark, sf, "labels")
    cases = lab.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 9).alias("group"))
    before = lab.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), (F.col("toxic") == 0).alias("passed"))
    after = lab.where("doc_id % 10 <> 4").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 8 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("label"), (F.col("quality") == 1).alias("passed"))
    return L.audit_compare(cases, before, after)


_AUDIT = """WITH b AS (SELECT doc_id AS id, quality AS label_before, toxic = 0 AS passed_before FROM labels WHERE doc_id % 10 <> 3),
a AS (SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN 1 - quality ELSE quality END AS label_after, quality = 1 AS passed_after FROM labels WHERE doc_id % 10 <> 4),
j AS (SELECT id, label_before IS NULL OR label_after IS NULL AS missing, label_before, label_after, passed_before, passed_after, id % 9 AS grp FROM b FULL JOIN a USING (id)) """


@query("j11_audit_compare", _AUDIT + "SELECT id, missing, NOT missing AND label_before <> label_after AS relabelled FROM j")
def j11(spark, sf):
    return _audit(spark, sf).select("id", "missing", F.coalesce("relabelled", F.lit(False)).alias("relabelled"))


@query("a10_audit_summary", _AUDIT + "SELECT count(*) AS cases, count(*) FILTER (passed_before) AS passed_before, count(*) FILTER (passed_after) AS passed_after, count(DISTINCT grp) AS groups, count(*) FILTER (passed_before <> passed_after) AS changed FROM j WHERE NOT missing")
def a10(spark, sf):
    return L.audit_summary(_audit(spark, sf))


_ROLL = """WITH s AS (SELECT o_custkey AS run_id, o_orderkey AS source_id, CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'OK' END AS status, CAST(o_orderkey % 4 AS BIGINT) AS documents FROM orders),
f AS (SELECT l_orderkey AS source_id, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1),
r AS (SELECT run_id, count(*) FILTER (status <> 'FAILED') AS success_sources, count(*) FILTER (status = 'FAILED') AS failed_sources, CAST(sum(documents) AS BIGINT) AS documents, CAST(count(*) FILTER (status = 'FAILED') + coalesce(sum(bad), 0) AS BIGINT) AS warnings, count(*) AS total_sources FROM s LEFT JOIN f USING (source_id) GROUP BY 1) """


def _rollup(spark, sf):
    o = table(spark, sf, "orders")
    s = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("OK").alias("status"), (F.col("o_orderkey") % 4).alias("documents"))
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("OK").alias("parse_status"))
    return L.run_rollup(s, files.join(s.select("source_id", "run_id"), "source_id"))


@query("a1_run_rollup", _ROLL + "SELECT run_id, success_sources, failed_sources, documents, warnings FROM r")
def a1(spark, sf):
    return _rollup(spark, sf)


@query("a2_run_state", _ROLL + "SELECT run_id, CASE WHEN failed_sources = total_sources THEN 'FAILED' ELSE 'COLLECTED' END AS state, success_sources + failed_sources <= total_sources AS consistent FROM r")
def a2(spark, sf):
    total = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("total_sources"))
    return L.run_state(_rollup(spark, sf).join(total, "run_id")).select("run_id", "state", "consistent")


@query("a3_revision", "SELECT count(*) AS n, max(o_orderkey) AS max_id, max(o_orderdate) AS max_updated FROM orders")
def a3(spark, sf):
    return L.revision(table(spark, sf, "orders"), "o_orderkey", "o_orderdate")


@query("a6_delivery_status", """
WITH d AS (SELECT l_orderkey AS report_id, bool_or(l_linestatus = 'O' AND l_returnflag = 'N') AS p, bool_or(l_returnflag = 'A') AS s, bool_or(l_returnflag = 'R') AS f FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT o_orderkey AS report_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'REPORT_FAILED' WHEN o_orderpriority LIKE '2%' THEN 'PREPARING' WHEN p THEN 'SENDING' WHEN s AND f THEN 'PARTIAL' WHEN f THEN 'FAILED' WHEN s OR o_orderkey % 3 = 0 THEN 'SENT' WHEN o_orderkey % 3 = 1 THEN 'FAILED' ELSE 'NOT_SENT' END AS delivery
FROM orders LEFT JOIN d ON report_id = o_orderkey""")
def a6(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderpriority").startswith("1"), "FAILED").when(F.col("o_orderpriority").startswith("2"), "PENDING").otherwise("READY")
    r = o.select(F.col("o_orderkey").alias("report_id"), status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("sent_at"), F.when(F.col("o_orderkey") % 3 == 1, "x").alias("error_message"))
    kind = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "PENDING").when(F.col("l_returnflag") == "A", "SENT").when(F.col("l_returnflag") == "R", "FAILED").otherwise("OTHER")
    d = table(spark, sf, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("report_id"), kind.alias("delivery_status"))
    return L.delivery_status(r, d).select("report_id", "delivery")


@query("a14_page_totals", "SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM orders WHERE o_orderpriority = '1-URGENT'")
def a14(spark, sf):
    return L.page_totals(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), 20)


@query("w1_latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w1(spark, sf):
    return latest_per_key(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("w2_latest_candidates", "SELECT o_custkey AS document_id, o_orderkey AS version_id FROM orders WHERE o_orderstatus <> 'P' AND o_custkey <> 7 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def w2(spark, sf):
    analysed = table(spark, sf, "orders").where("o_orderstatus <> 'P' AND o_custkey <> 7")
    return latest_per_key(analysed, ["o_custkey"], [F.desc("o_orderkey")]).select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"))


@query("t1_order_latest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC")
def t1(spark, sf):
    return L.order_latest(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id")


_SCORED = "(SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS score FROM orders)"


def _scored(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("score"))


@query("t2_order_score", f"SELECT o_orderkey, score FROM {_SCORED} ORDER BY score DESC NULLS LAST, o_orderdate DESC, o_orderkey DESC")
def t2(spark, sf):
    return L.order_score(_scored(spark, sf), "score", "o_orderdate", "o_orderkey").select("o_orderkey", "score")


@query("t3_order_by_mode", f"SELECT o_orderkey, score FROM {_SCORED} ORDER BY coalesce(score, -1) DESC, o_orderdate DESC, o_orderkey DESC")
def t3(spark, sf):
    return L.order_by_mode(_scored(spark, sf), True, "score", "o_orderdate", "o_orderkey").select("o_orderkey", "score")


@query("t4_page", f"SELECT o_orderkey, score FROM {_SCORED} ORDER BY score DESC NULLS LAST, o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def t4(spark, sf):
    return L.page(L.order_score(_scored(spark, sf), "score", "o_orderdate", "o_orderkey").select("o_orderkey", "score"), 2, 20)


@query("t6_due_tasks", "SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def t6(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("available_at"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("DONE").alias("state"))
    return L.due_tasks(o, NOW, 50).select("task_id")
