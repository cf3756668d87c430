"""Queries on budgets and call events: an event stands for a call, its type for the operation, k of its properties for tokens."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import windows as W
from ..sources.tables import parse_json_column
from .base import query, table


_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem)"


def order_lines(spark, sf):
    """Lines with a place of their own in the order; l_linenumber repeats."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf, "lineitem").withColumn("place", F.row_number().over(order).cast("long"))
    return li.select("l_orderkey", "place", F.col("l_quantity").cast("long").alias("size"))


@query("w6_round_robin", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS turn FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY turn, l_returnflag) AS INTEGER) AS pick FROM a WHERE turn <= 3 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY turn, l_returnflag) <= 3""")
def w6(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return W.round_robin(li, "l_orderkey", "l_returnflag", [F.asc("l_linenumber")], 3).select("l_orderkey", "l_linenumber", "pick")


@query("w7_greedy_budget")
def w7(spark, sf):
    return W.greedy_budget(order_lines(spark, sf), "l_orderkey", ["place"], "size", 80)


@query("w7_prefix_budget", f"SELECT l_orderkey, place FROM {_NUMBERED} QUALIFY sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY place) <= 80")
def w7p(spark, sf):
    return W.prefix_budget(order_lines(spark, sf), "l_orderkey", ["place"], "size", 80).select("l_orderkey", "place")


@query("w8_allocate_budget", f"""
WITH RECURSIVE b AS (SELECT l_orderkey, place, CAST(l_quantity AS BIGINT) AS size FROM {_NUMBERED}),
r AS (SELECT *, coalesce(sum(size) OVER w, 0) AS used, count(*) OVER (PARTITION BY l_orderkey) - row_number() OVER (PARTITION BY l_orderkey ORDER BY size, place) + 1 AS remain FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY size, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT l_orderkey, min(used) AS used, max(remain) AS remain FROM r WHERE size > floor((70 - used) / remain) GROUP BY 1),
j AS (SELECT r.l_orderkey, place, size, c.used, c.remain, c.remain IS NOT NULL AND r.remain <= c.remain AS high, floor((70 - c.used) / c.remain) AS lvl FROM r LEFT JOIN c USING (l_orderkey))
SELECT l_orderkey, place, CAST(CASE WHEN high THEN least(size, lvl + CASE WHEN row_number() OVER (PARTITION BY l_orderkey, high ORDER BY place) <= 70 - used - lvl * remain THEN 1 ELSE 0 END) ELSE size END AS BIGINT) AS allotted FROM j""")
def w8(spark, sf):
    return W.allocate_budget(order_lines(spark, sf), "l_orderkey", "place", "size", 70).select("l_orderkey", "place", "allotted")


@query("w9_stage_durations", "SELECT event_id, CAST(floor(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000) - floor(epoch_us(ts) / 1000) AS BIGINT) AS duration_ms FROM events")
def w9(spark, sf):
    return W.stage_durations(table(spark, sf, "events"), "user_id", "ts", ["ts", "event_id"]).select("event_id", "duration_ms")


@query("w10_peak_active", """
WITH m AS (SELECT o_orderpriority AS grp, CAST(o_orderdate AS DATE) AS d, 1 AS step FROM orders UNION ALL SELECT o_orderpriority, CAST(o_orderdate AS DATE) + CAST(1 + o_custkey % 30 AS INTEGER), -1 FROM orders),
s AS (SELECT grp, d, step, sum(step) AS c FROM m GROUP BY 1, 2, 3)
SELECT grp, CAST(max(n) AS BIGINT) AS peak FROM (SELECT grp, sum(c) OVER (PARTITION BY grp ORDER BY d, step) AS n FROM s) GROUP BY 1""")
def w10(spark, sf):
    day = F.col("o_orderdate").cast("date")
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), day.alias("a"), F.date_add(day, (F.col("o_custkey") % 30 + 1).cast("int")).alias("b"))
    return W.peak_active(o, "grp", "a", "b")


def calls(spark, sf):
    e = parse_json_column(table(spark, sf, "events"), "props", "k long")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("operation"), F.when(F.col("value") < 90, "ok").otherwise("error").alias("outcome"), F.col("parsed.k").alias("tokens"), "value", "props")


@query("s9_parse_json_column", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN props IS NULL THEN NULL ELSE json_valid(props) END AS parsed_ok FROM events")
def s9(spark, sf):
    return parse_json_column(table(spark, sf, "events"), "props", "k long").select("event_id", F.col("parsed.k").alias("k"), "parsed_ok")


@query("o1_call_rollup", """SELECT event_type AS operation, count(*) AS calls, count(*) FILTER (value < 90) AS ok, count(*) FILTER (NOT coalesce(value < 90, false)) AS failed, CAST(sum(k) AS BIGINT) AS tokens, count(k) AS responses
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def o1(spark, sf):
    return W.call_rollup(calls(spark, sf))


@query("o2_timeout_kind", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND user_id % 3 = 0 THEN 'connect' WHEN event_id % 2 = 0 THEN 'read' WHEN user_id % 3 = 0 THEN 'total' END AS kind FROM events")
def o2(spark, sf):
    a = F.when(F.col("event_id") % 2 == 0, F.when(F.col("user_id") % 3 == 0, "connect").otherwise("read")).otherwise("other")
    b = F.when(F.col("user_id") % 3 == 0, "total").otherwise("other")
    return table(spark, sf, "events").select("event_id", W.timeout_kind(F.array(b, a)).alias("kind"))


@query("o3_latency", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(avg(value), 6) AS mean, max(CASE WHEN pos = greatest(1, floor(n * 0.95)) THEN value END) AS p95 FROM r GROUP BY 1""")
def o3(spark, sf):
    return W.latency(table(spark, sf, "events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"), "p95")


@query("o4_phase_compare", "SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1")
def o4(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("config"), F.lit(1).alias("one"))
    return W.phase_compare(e, "config", "event_type", "one", ["a", "b"])


@query("o5_clean_attributes", "SELECT event_id, event_type AS operation, CAST(user_id AS VARCHAR) AS attempt, CAST(2 AS INTEGER) AS n FROM events")
def o5(spark, sf):
    m = F.create_map(F.lit("operation"), F.col("event_type"), F.lit("secret"), F.col("props"), F.lit("attempt"), F.col("user_id").cast("string"), F.lit("model"), F.lit("a b c"))
    e = table(spark, sf, "events").select("event_id", W.clean_attributes(m).alias("m"))
    return e.select("event_id", F.col("m.operation").alias("operation"), F.col("m.attempt").alias("attempt"), F.size("m").alias("n"))


@query("a15_single_value_facts", "SELECT user_id, event_type, min(value) AS value FROM (SELECT user_id, event_type, floor(value / 50) AS value, event_id % 41 = 0 AS blocked FROM events) GROUP BY 1, 2 HAVING count(DISTINCT value) = 1 AND NOT bool_or(blocked)")
def a15(spark, sf):
    from ..operators.texts import single_value_facts

    e = table(spark, sf, "events").select("user_id", "event_type", F.floor(F.col("value") / 50).cast("double").alias("value"), (F.col("event_id") % 41 == 0).alias("blocked"))
    return single_value_facts(e, ["user_id", "event_type"], "value", "blocked")
