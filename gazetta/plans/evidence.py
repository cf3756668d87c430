"""Queries on equal facts and excerpts: order lines as conditions of notices, and the documents."""

from pyspark.sql import functions as F

from ..operators import evidence as V
from .base import query, table


@query("e12_facts_equivalent", "SELECT l_orderkey, l_linenumber, l_linenumber % 7 NOT IN (2, 3, 5) AS equivalent FROM lineitem")
def e12(spark, sf):
    """Line by line another wording: aliases, the same branches in another order and an omitted law agree; other values, comparators and roles do not."""
    k, n = F.col("l_linenumber") % 7, F.col("l_quantity").cast("int").cast("string")
    money = F.format_number("l_extendedprice", 2)
    text = (
        F.when(k == 0, F.concat(F.lit("주관연구기관은 매출액 "), money, F.lit("억원 이상")))
        .when(k == 1, F.concat(F.lit("업력 "), n, F.lit("년 이내 혹은 근로자수 9명 미만")))
        .when(k == 2, F.concat(F.lit("매출액 "), n, F.lit("1억원 이상")))
        .when(k == 3, F.concat(F.lit("업력 "), n, F.lit("년 초과")))
        .when(k == 4, F.concat(F.lit("업력 "), n, F.lit("년인 중소기업")))
        .when(k == 5, F.concat(F.lit("공동기관 근로자수 "), n, F.lit("명")))
        .otherwise(F.concat(F.lit("신용등급 BB+ 이상, "), n, F.lit("건")))
    )
    quote = (
        F.when(k == 0, F.concat(F.lit("주관 기관 매출 "), F.regexp_replace(money, ",", ""), F.lit("억원≥")))
        .when(k == 1, F.concat(F.lit("근로자수 9명 미만 또는 업력 "), n, F.lit("년 이하")))
        .when(k == 2, F.concat(F.lit("매출액 "), n, F.lit("2억원 이상")))
        .when(k == 3, F.concat(F.lit("업력 "), n, F.lit("년 이상")))
        .when(k == 4, F.concat(F.lit("「중소기업기본법」 제2조의 업력 "), n, F.lit("년인 중소기업")))
        .when(k == 5, F.concat(F.lit("주관기관 근로자수 "), n, F.lit("명")))
        .otherwise(F.concat(F.lit("신용등급 BB+이상,"), n, F.lit("건")))
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"), quote.alias("quote"))
    return V.facts_equivalent(rows, ["l_orderkey", "l_linenumber"], "text", "quote")


@query("e21_select_evidence")
def e21(spark, sf):
    """Topics of the synthetic documents' own words; texts over 2,000 characters are cut down to it."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return V.select_evidence(docs, "doc_id", "text", 2000, [r"\d", "@", "[A-Z]{2,}", r"\?", "http"])
