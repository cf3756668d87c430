"""Queries on facts, mostly over order lines written out as the texts and tables that notices have."""

from pyspark.sql import functions as F

from ..operators import facts as C
from .base import query, table


@query("x3_facts_subset", "WITH a AS (SELECT l_orderkey, list(l_returnflag) FILTER (l_linenumber <= 3) AS a, list(l_returnflag) FILTER (l_linenumber > 3) AS b FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber <= 3) > 0 AND count(*) FILTER (l_linenumber > 3) > 0) SELECT l_orderkey, len(list_filter(['A', 'N', 'R'], lambda f: len(list_filter(a, lambda x: x = f)) > len(list_filter(b, lambda x: x = f)))) = 0 AS inside FROM a")
def x3(spark, sf):
    li = table(spark, sf, "lineitem")
    low = li.where("l_linenumber <= 3").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"))
    high = li.where("l_linenumber > 3").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("b"))
    return low.join(high, "l_orderkey").select("l_orderkey", C.facts_subset(F.col("a"), F.col("b")).alias("inside"))


@query("e8_schedule_roles", "SELECT DISTINCT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'announcement' WHEN 'O' THEN 'submission' ELSE 'other' END AS role, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || CASE o_orderstatus WHEN 'F' THEN ' 결과 발표' WHEN 'O' THEN ' 접수 마감' ELSE ' 설명회' END AS entry FROM orders")
def e8(spark, sf):
    words = F.when(F.col("o_orderstatus") == "F", " 결과 발표").when(F.col("o_orderstatus") == "O", " 접수 마감").otherwise(" 설명회")
    o = table(spark, sf, "orders").select("o_custkey", F.concat(F.col("o_orderdate").cast("date").cast("string"), words).alias("line"))
    return C.schedule_roles(o, "o_custkey")


@query("e9_schedule_issues", """WITH c AS (SELECT o_custkey, o_orderstatus, min(year(o_orderdate)) AS d FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2 HAVING min(year(o_orderdate)) = max(year(o_orderdate))), v AS (SELECT o_custkey, o_orderstatus, min(year(o_orderdate)) AS d FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2 HAVING min(year(o_orderdate)) = max(year(o_orderdate)))
SELECT o_custkey, o_orderstatus, CAST(c.d AS INTEGER) AS claimed, CAST(v.d AS INTEGER) AS verified FROM c JOIN v USING (o_custkey, o_orderstatus) WHERE c.d <> v.d""")
def e9(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.year("o_orderdate").alias("day"))
    return C.schedule_issues(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderstatus"])


@query("e10_money_values", "SELECT o_orderkey, CAST(0 AS INTEGER) AS n, CAST(o_custkey * 1000 AS DECIMAL(38, 6)) AS value FROM orders UNION ALL SELECT o_orderkey, 1, CAST(o_orderkey % 100 AS DECIMAL(38, 6)) FROM orders")
def e10(spark, sf):
    text = F.format_string("최대 %,d원 이내, 건당 %d 원 (3명)", F.col("o_custkey") * 1000, F.col("o_orderkey") % 100)
    return C.money_values(table(spark, sf, "orders").withColumn("text", text), "o_orderkey", "text", "원").select("o_orderkey", "n", "value")


@query("e11_amount_flags", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'VAT' WHEN 1 THEN 'EXCLUDED,VAT' ELSE '' END AS flags FROM orders")
def e11(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, "부가세 포함").when(F.col("o_orderkey") % 3 == 1, "VAT 제외 금액").otherwise("총액")
    return C.amount_flags(table(spark, sf, "orders").withColumn("clause", text), "clause").select("o_orderkey", F.array_join("flags", ",").alias("flags"))


@query("a16_dedupe_amounts", "SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, least(l_linenumber, l_suppkey % 7), greatest(l_linenumber, l_suppkey % 7), l_returnflag FROM lineitem) GROUP BY 1")
def a16(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("n"), F.array(F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 7).alias("q"), F.array("l_returnflag").alias("c"))
    return C.dedupe_amounts(li, "l_orderkey", "q", "c").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("e25_funding_table", "SELECT o_orderkey, CAST(o_custkey % 100 AS DOUBLE) AS subsidy, CAST(100 - o_custkey % 100 AS DOUBLE) AS own_share FROM orders WHERE o_orderkey % 4 > 0")
def e25(spark, sf):
    share = F.col("o_custkey") % 100
    last = F.when(F.col("o_orderkey") % 4 == 0, "협의").otherwise(F.concat((100 - share).cast("string"), F.lit("%")))
    text = F.concat(F.lit("[표]\n구분\t지원\t자부담\n중소기업\t"), share.cast("string"), F.lit("%\t"), last, F.lit("\n[/표]"))
    return C.funding_table(table(spark, sf, "orders").withColumn("text", text), "o_orderkey", "text").select("o_orderkey", "subsidy", "own_share")


@query("e28_reusable_facts", "WITH c AS (SELECT user_id, event_type, min(floor(value / 60)) AS value FROM events GROUP BY 1, 2 HAVING min(floor(value / 60)) = max(floor(value / 60)) AND NOT bool_or(event_id % 97 = 0)) SELECT user_id, event_type, value FROM c WHERE value = user_id % 2")
def e28(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.floor(F.col("value") / 60).cast("double").alias("value"), (F.col("event_id") % 97 == 0).alias("blocked"))
    saved = e.select("user_id", "event_type", (F.col("user_id") % 2).cast("double").alias("value")).distinct()
    return C.reusable_facts(saved, e, ["user_id", "event_type"]).select("user_id", "event_type", "value")


@query("j14_match_forms", "SELECT p_partkey AS title_id, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 1 THEN p_partkey * 10 + 1 ELSE p_partkey * 10 END AS file_id, CASE WHEN p_partkey % 3 = 2 THEN 'NOT_FOUND' ELSE 'MATCHED' END AS result FROM part")
def j14(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("title_id"), F.concat(F.lit("Form "), F.col("p_partkey").cast("string")).alias("title"))
    name = F.concat(F.lit("form_"), F.col("title_id").cast("string"))
    pdf = p.where("title_id % 3 < 2").select((F.col("title_id") * 10).alias("file_id"), F.concat(name, F.lit(".pdf")).alias("name"))
    hwp = p.where("title_id % 3 = 1").select((F.col("title_id") * 10 + 1).alias("file_id"), F.concat(name, F.lit(".hwp")).alias("name"))
    return C.match_forms(p, pdf.unionByName(hwp))


@query("j15_reconcile", """WITH i AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS item FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT o_orderkey AS requirement_id, CASE WHEN n = 1 THEN item END AS item_id, CASE WHEN n IS NULL THEN 'MISSING' WHEN n = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS state FROM orders LEFT JOIN i ON l_orderkey = o_orderkey AND l_linenumber = 1""")
def j15(spark, sf):
    items = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("stage"), F.col("l_partkey").alias("item_id"))
    req = table(spark, sf, "orders").select(F.col("o_orderkey").alias("requirement_id"), F.col("o_orderkey").alias("document"), F.lit(1).alias("stage"))
    return C.reconcile(items, req, ["document", "stage"])


@query("a8_group_conditions", """WITH s AS (SELECT p_brand, p_size, p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size % 2 END AS scope, p_retailprice FROM part), k AS (SELECT p_brand, p_size, CASE WHEN min(scope) = max(scope) THEN min(scope) END AS known FROM s GROUP BY 1, 2)
SELECT p_brand, p_size, CAST(coalesce(scope, known) AS INTEGER) AS scope, count(*) AS n, arg_min(p_partkey, (p_retailprice, p_partkey)) AS preferred FROM s JOIN k USING (p_brand, p_size) GROUP BY 1, 2, 3""")
def a8(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_size", "p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") % 2).alias("scope"), "p_retailprice")
    return C.group_conditions(p, ["p_brand", "p_size"], "scope", "p_retailprice", "p_partkey")


@query("r9_comparison_fields", r"""WITH l AS (SELECT * FROM (SELECT doc_id, unnest(range(len(p))) AS line_no, trim(regexp_replace(unnest(p), '[ \t\x0B\f\r]+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE line <> ''),
b AS (SELECT doc_id, arg_max(line, (w, -line_no)) AS line FROM (SELECT *, CASE WHEN contains(line, 'the') THEN 2 ELSE 0 END + CASE WHEN contains(line, 'ing') THEN 3 ELSE 0 END AS w FROM l) WHERE w > 0 GROUP BY 1)
SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, 'Licensed under ([^\n.]*)', 1)), ''), line) AS field FROM documents LEFT JOIN b USING (doc_id)""")
def r9(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return C.comparison_fields(d, "doc_id", "text", r"Licensed under ([^\n.]*)", {"the": 2, "ing": 3})
