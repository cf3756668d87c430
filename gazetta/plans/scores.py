"""Queries on scores: an order's digits stand for dimension scores, its date for a deadline."""

from datetime import date

from pyspark.sql import functions as F

from ..operators import scoring as S
from .base import query, table

_DIM = "SELECT o_orderkey, CAST(o_orderkey * 7 % 101 AS INTEGER) AS fit, CAST(o_custkey * 13 % 101 AS INTEGER) AS val, CAST(o_orderkey * 31 % 101 AS INTEGER) AS fea, CAST(o_custkey * 17 % 101 AS INTEGER) AS urg, ['FIT', 'GROWTH', 'FEASIBILITY'][1 + o_orderkey % 3] AS preset FROM orders"
_W = "CASE preset WHEN 'FIT' THEN fit * 50 / 100.0::DOUBLE + val * 20 / 100.0::DOUBLE + fea * 20 / 100.0::DOUBLE + urg * 10 / 100.0::DOUBLE WHEN 'GROWTH' THEN fit * 40 / 100.0::DOUBLE + val * 35 / 100.0::DOUBLE + fea * 20 / 100.0::DOUBLE + urg * 5 / 100.0::DOUBLE ELSE fit * 40 / 100.0::DOUBLE + val * 15 / 100.0::DOUBLE + fea * 40 / 100.0::DOUBLE + urg * 5 / 100.0::DOUBLE END"
_SCORE = f"CAST(CASE WHEN fit <= 40 THEN least(floor({_W} + 0.5), 49) ELSE floor({_W} + 0.5) END AS INTEGER)"
_PRIO = "CASE WHEN fit >= 50 AND fea >= 50 AND (total >= 75 OR (total >= 50 AND urg >= 85)) THEN 'HIGH' WHEN total >= 50 THEN 'NORMAL' ELSE 'LOW' END"


def dims(spark, sf):
    o = table(spark, sf, "orders")
    preset = F.element_at(F.array(*map(F.lit, S.PRESETS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", *[(F.col(c) * k % 101).cast("int").alias(n) for c, k, n in (("o_orderkey", 7, "fit"), ("o_custkey", 13, "val"), ("o_orderkey", 31, "fea"), ("o_custkey", 17, "urg"))], preset.alias("preset"))


def _total():
    return S.opportunity_score(*map(F.col, ("fit", "val", "fea", "urg", "preset")))


@query("k1_opportunity_score", f"SELECT o_orderkey, {_SCORE} AS total FROM ({_DIM})")
def k1(spark, sf):
    return dims(spark, sf).select("o_orderkey", _total().alias("total"))


@query("k2_opportunity_priority", f"SELECT o_orderkey, {_PRIO} AS priority FROM (SELECT *, {_SCORE} AS total FROM ({_DIM}))")
def k2(spark, sf):
    return dims(spark, sf).withColumn("total", _total()).select("o_orderkey", S.opportunity_priority(*map(F.col, ("total", "fit", "fea", "urg"))).alias("priority"))


@query("k3_ranking_from_json", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 3 THEN total ELSE -1 END AS score, CASE WHEN o_orderkey % 6 < 3 THEN {_PRIO} END AS priority, o_orderkey % 6 >= 3 AS malformed
FROM (SELECT *, {_SCORE} AS total FROM ({_DIM}))""")
def k3(spark, sf):
    one = lambda t, s: F.format_string('{"type":"' + t + '","score":%s}', F.col(s).cast("string"))
    dims_ = F.concat_ws(",", one("COMPANY_FIT", "fit"), one("BUSINESS_VALUE", "val"), one("FEASIBILITY", "fea"), one("URGENCY", "urg"), F.lit('{"type":"OTHER","score":7}'))
    whole = F.concat(F.lit('{"dimensions":['), dims_, F.lit('],"preset":"'), "preset", F.lit('"}'))
    twice = F.concat(F.lit('{"dimensions":['), dims_, F.lit(","), one("URGENCY", "urg"), F.lit("]}"))
    case = F.col("o_orderkey") % 6
    text = F.when(case < 3, whole).when(case == 3, twice).when(case == 4, F.lit('{"dimensions":[{"type":"URGENCY","score":101}]}')).otherwise(F.lit('{"dimensions":'))
    df = dims(spark, sf).withColumn("assessment", text).withColumn("old", F.lit(-1))
    return S.ranking_from_json(df, "assessment", "old").select("o_orderkey", "score", "priority", "malformed")


_DAYS = "date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE))"


def _days():
    return F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-06-17").cast("date"))


@query("k4_urgency", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 70 WHEN o_orderkey % 10 = 1 THEN 10 WHEN d < 0 THEN 0 WHEN d <= 2 THEN 100 WHEN d <= 5 THEN 90 WHEN d <= 7 THEN 80 WHEN d <= 14 THEN 65
WHEN d <= 21 THEN 50 WHEN d <= 30 THEN 35 WHEN d <= 45 THEN 20 ELSE 10 END AS score FROM (SELECT *, {_DAYS} % 60 AS d FROM orders)""")
def k4(spark, sf):
    days = F.when(F.col("o_orderkey") % 10 != 1, _days() % 60)
    return table(spark, sf, "orders").select("o_orderkey", S.urgency(days, F.col("o_orderkey") % 10 == 0).alias("score"))


@query("k5_urgency_configured", f"SELECT o_orderkey, CASE WHEN d < 0 THEN 0 WHEN d <= 10 THEN 100 WHEN d <= 20 THEN 65 WHEN d <= 40 THEN 35 ELSE 10 END AS score FROM (SELECT *, {_DAYS} % 60 AS d FROM orders)")
def k5(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.urgency_configured(_days() % 60, 10).alias("score"))


@query("k6_business_days", """SELECT o_orderkey, CAST((SELECT count(*) FROM (SELECT unnest(range(1, 1 + greatest(0, CAST(o_orderkey % 40 AS BIGINT) - 5))) AS k) WHERE isodow(CAST(o_orderdate AS DATE) + CAST(k AS INTEGER)) < 6) AS INTEGER) AS days,
  (SELECT max(x) FROM (SELECT CAST(o_orderdate AS DATE) - CAST(k AS INTEGER) AS x, row_number() OVER (ORDER BY k) AS rn FROM (SELECT unnest(range(1, 60)) AS k) WHERE isodow(CAST(o_orderdate AS DATE) - CAST(k AS INTEGER)) < 6) WHERE rn = 1 + o_orderkey % 23) AS back FROM orders""")
def k6(spark, sf):
    day = F.col("o_orderdate").cast("date")
    end = F.date_add(day, (F.col("o_orderkey") % 40 - 5).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", S.business_days(day, end).alias("days"), S.minus_business_days(day, (F.col("o_orderkey") % 23 + 1).cast("int")).alias("back"))


_KINDS, _LEVELS = list(S.WORK_DAYS), list(S.EVIDENCE)
_SQL_DAYS = "map {" + ", ".join(f"'{k}': {v}" for k, v in S.WORK_DAYS.items()) + "}"
_SQL_EVIDENCE = "map {" + ", ".join(f"'{k}': {v}" for k, v in S.EVIDENCE.items()) + "}"


@query("k7_readiness", f"""
WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS item, date_diff('day', DATE '1995-06-17', CAST(l_shipdate AS DATE)) AS n, {_SQL_DAYS}[{_KINDS}[1 + l_partkey % 12]] AS days, {_SQL_EVIDENCE}[{_LEVELS}[1 + l_suppkey % 5]] AS condition FROM lineitem),
s AS (SELECT item, condition, CASE WHEN n <= 0 THEN 0 ELSE CAST(least(100, round_even((5 * (n // 7) + greatest(0, n % 7 - 1)) / days * 100, 0)) AS INTEGER) END AS schedule FROM i)
SELECT item, schedule, CAST(round_even(condition * 0.8::DOUBLE + schedule * 0.2::DOUBLE, 0) AS INTEGER) AS readiness FROM s""")
def k7(spark, sf):
    """Every item; the day counted from is a Saturday, so that of each week's days after it the second to the sixth are business days."""
    return _readiness(table(spark, sf, "lineitem"))


def _readiness(lineitem):
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    i = lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("l_shipdate").cast("date").alias("deadline"), pick(_KINDS, "l_partkey").alias("work_type"), pick(_LEVELS, "l_suppkey").alias("evidence"), F.lit(None).cast("int").alias("condition"))
    return S.readiness(i, date(1995, 6, 17)).select("item", "schedule", "readiness")


@query("k8_parse_won", "SELECT o_orderkey, CAST((o_custkey % 90 + 1) * 100000000 + (o_orderkey % 9 + 1) * 10000000 AS DECIMAL(38, 6)) AS won FROM orders")
def k8(spark, sf):
    text = F.format_string("2026년 12명 대상 총 %,d억 %d천만 원 이내", F.col("o_custkey") % 90 + 1, F.col("o_orderkey") % 9 + 1)
    return table(spark, sf, "orders").select("o_orderkey", S.parse_won(text).alias("won"))
