"""Queries on submission lists and organisations: order lines and suppliers written out as the tables and lines of notices."""

from pyspark.sql import functions as F

from ..operators import organizations as O
from ..operators import submissions as B
from .base import query, table

_DOC = "CASE l_linenumber % 3 WHEN 0 THEN '사업계획서' WHEN 1 THEN '확인서' ELSE '동의서 (별지)' END"


@query("e22_submission_rows", f"""SELECT l_orderkey, {_DOC} AS title, CASE l_returnflag WHEN 'A' THEN 'MANDATORY' WHEN 'N' THEN 'OPTIONAL' ELSE 'CONDITIONAL' END AS level,
CASE WHEN l_orderkey % 3 = 0 THEN 'AGREEMENT' ELSE 'APPLICATION' END AS stage, count(*) AS n FROM lineitem WHERE l_orderkey % 5 > 0 AND l_orderkey % 7 > 0 GROUP BY 1, 2, 3, 4""")
def e22(spark, sf):
    """Each order is a list: tables under an example and tables with a footnote give nothing, a third is for the agreement."""
    k = F.col("l_orderkey")
    mark = F.when(F.col("l_returnflag") == "A", "필수").when(F.col("l_returnflag") == "N", "선택").otherwise("해당 시 제출")
    row = F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.expr(_DOC), mark)
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("rows"))
    before = F.concat(F.when(k % 3 == 0, "협약 체결 시 제출 서류").otherwise("신청 서류 안내"), F.when(k % 5 == 0, " 작성 예시").otherwise(""))
    after = F.when(k % 7 == 0, "\n※ 일부 면제").otherwise("\n끝")
    text = F.concat(before, F.lit("\n[표]\n번호\t제출 서류명\t구분\n"), "rows", F.lit("\n[/표]"), after)
    out = B.submission_rows(rows.select("l_orderkey", text.alias("text")), "l_orderkey", "text")
    return out.groupBy("l_orderkey", "title", "level", "stage").agg(F.count("*").alias("n"))


@query("e16_organizations", """WITH s AS (SELECT s_suppkey, '공급' || s_suppkey || '진흥원' AS own, '나라' || s_nationkey || '협회' AS other FROM supplier)
SELECT s_suppkey, '주관기관' AS role, own AS name FROM s UNION ALL SELECT s_suppkey, '주관기관', '한국재단' FROM s UNION ALL SELECT s_suppkey, '운영기관', own FROM s WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, '문의처', '창구 ' || s_suppkey || ' 센터' FROM s WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, '전담기관', other FROM s UNION ALL SELECT s_suppkey, '관리기관', other FROM s WHERE s_suppkey % 5 > 0""")
def e16(spark, sf):
    """A supplier's notice names it as operator and as contact, and its nation in tables, beside and below; attachments repeat, and hold forms and examples."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    own, other = F.concat(F.lit("공급"), key.cast("string"), F.lit("진흥원")), F.concat(F.lit("나라"), nation, F.lit("협회"))
    desk = F.when(key % 2 == 0, F.concat(F.lit("\n(문의처) 창구 "), key.cast("string"), F.lit(" 센터 02-123-4567"))).otherwise("")
    table_end = F.when(key % 5 > 0, "[/표]").otherwise("")
    body = F.concat(F.lit("■ 주관 기관: "), own, F.lit(" 및 한국재단, 연구소\n문의처\n"), own, desk, F.lit("\n지난해 주최: 다른협회\n[표]\n전담기관\t전담기관\t"), other, F.lit("\n[/표]"))
    notice = F.concat(F.lit("주관기관: "), own, F.lit("\n[표]\n관리기관\t비고\n"), other, F.lit("\t없음\n"), table_end, F.lit("\n서식 1 신청서\n주최: 양식협회"))
    bundle = F.concat(F.lit("[파일: 신청서.hwp]\n주관기관: 신청협회\n[파일: 공고문.hwp]\n"), F.when(key % 3 == 0, F.concat(F.lit("운영기관 "), own)).otherwise("운영기관: 추후 선정"), F.lit("\n작성 예시\n주최: 예제협회"))
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f).alias("file"), t.alias("text")) for n, f, t in ((0, None, body), (1, "공고.hwpx", notice), (2, "첨부.zip", bundle), (3, "참고자료.pdf", body))])
    rows = table(spark, sf, "supplier").select("s_suppkey", F.explode(rows).alias("r")).select("s_suppkey", "r.*")
    return O.organizations(rows, "s_suppkey", "text", "file", "n").select("s_suppkey", "role", "name")
