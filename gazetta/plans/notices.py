"""Queries on deadlines, amounts, condition rows and evidence sections: orders and their lines worded as notices."""

from pyspark.sql import functions as F

from ..operators import amounts as A
from ..operators import criteria as C
from ..operators import deadlines as D
from ..operators import forms as M
from ..operators import natures as N
from ..operators import sections as S
from ..operators import statements as Q
from .base import query, table

_DATES = "d AS (SELECT *, o_orderdate + INTERVAL 90 YEAR AS first, o_orderdate + INTERVAL 90 YEAR + INTERVAL 30 DAY AS last, o_orderkey % 9 AS k FROM orders)"


@query("e7_deadlines", f"WITH {_DATES} SELECT o_orderkey, CASE WHEN k IN (0, 1, 2, 3, 8) THEN CAST(last AS DATE) END AS deadline FROM d")
def e7_deadlines(spark, sf):
    """One date, ranges, dates of other roles, several deadlines, open and reversed ranges, and a range that the reason completes."""
    first = F.col("o_orderdate") + F.expr("INTERVAL 90 YEAR")
    d = table(spark, sf, "orders").select("o_orderkey", first.alias("first"), (first + F.expr("INTERVAL 30 DAY")).alias("last"))
    iso, dotted, said = (lambda c: F.date_format(c, "yyyy-MM-dd")), (lambda c: F.date_format(c, "yyyy. M. d.")), (lambda c: F.date_format(c, "yyyy년 M월 d일"))
    k = F.col("o_orderkey") % 9
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    field = (
        F.when(k == 0, t("신청 마감일: ", dotted("last")))
        .when(k == 1, t("접수기간: ", iso("first"), " (월) 09:00 ~ ", dotted("last")))
        .when(k == 2, t("분석일은 ", iso("first"), "이며 신청 마감일은 ", said("last"), "입니다."))
        .when(k == 3, t("제출 기한은 ", said("last"), "이며 발표일은 ", iso("first"), "입니다."))
        .when(k == 4, t("신청 마감일 ", iso("first"), ", 제출 마감일 ", iso("last")))
        .when(k == 5, t("접수기간: ", iso("first"), " 시작, 종료일 미정"))
        .when(k == 6, t(said("last"), "부터 ", iso("first"), "까지"))
        .when(k == 7, t("평가 마감일은 ", iso("first"), "입니다."))
        .otherwise(t(iso("first"), "부터 ", F.date_format("last", "M월 d일"), "까지"))
    )
    reason = F.when(k == 8, t("신청 마감일은 ", iso("last"), "입니다."))
    return D.deadlines(d.select("o_orderkey", field.alias("field"), reason.alias("reason")), "o_orderkey", "field", "reason")


@query("e10_money_facts", """
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS line, CAST(l_quantity AS BIGINT) AS q, (l_orderkey + l_linenumber) % 5 AS k FROM lineitem)
SELECT line, n, CAST(value AS DOUBLE) AS value, unit, comparator, scope, frequency, payer FROM (
  SELECT line, 0 AS n, q * 100000000 AS value, '원' AS unit, '<=' AS comparator, 'project' AS scope, 'annual' AS frequency, '' AS payer FROM l WHERE k = 0
  UNION ALL SELECT line, 1, 3, '년', '<=', '', '', '' FROM l WHERE k = 0
  UNION ALL SELECT line, 0, q, '%', '=', '', '', 'state' FROM l WHERE k = 1
  UNION ALL SELECT line, 1, 25, '%', '=', '', '', 'own' FROM l WHERE k = 1
  UNION ALL SELECT line, 0, q * 10000000, '원', '<=', 'company', '', '' FROM l WHERE k = 2
  UNION ALL SELECT line, 1, 20, '%', '>=', '', '', 'own' FROM l WHERE k = 2
  UNION ALL SELECT line, 0, q * 1000000, '원', '~', 'total', 'total', '' FROM l WHERE k = 3
  UNION ALL SELECT line, 0, q * 10000, '원', '<=', '', 'monthly', '' FROM l WHERE k = 4
  UNION ALL SELECT line, 1, 25, '%', '=', '', '', 'own' FROM l WHERE k = 4)""")
def e10_money(spark, sf):
    k, q = (F.col("l_orderkey") + F.col("l_linenumber")) % 5, F.col("l_quantity").cast("long").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("과제당 연 "), q, F.lit("억원 이내 (최대 3년)")))
        .when(k == 1, F.concat(F.lit("정부지원 비율 "), q, F.lit("%, 기관부담 비율 25%")))
        .when(k == 2, F.concat(F.lit("지원금: 기업당 "), q, F.lit("천만 원 이내, 자부담 20% 이상")))
        .when(k == 3, F.concat(F.lit("총 사업비 "), q, F.lit("백만원 내외")))
        .otherwise(F.concat(F.lit("매월 최대 "), q, F.lit("만원, 25%는 기관이 부담")))
    )
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), text.alias("text"))
    return A.money_facts(rows, "line", "text").withColumn("value", F.col("value").cast("double"))


_ITEMS = "i AS (SELECT l_orderkey, l_returnflag || ' 트랙' AS track, CAST(l_quantity AS INTEGER) || '만원' AS amount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"


@query("e19_prepared_rows", f"""
WITH {_ITEMS}, e AS (SELECT l_orderkey, max(n) AS n FROM i GROUP BY 1)
SELECT l_orderkey, CAST(0 AS BIGINT) AS row_no, '안내: 아래 표' AS text, '안내' AS group_label, '' AS headers, '' AS cells, 'text' AS structure FROM e
UNION ALL SELECT l_orderkey, min(n) + 2, track || ' ' || amount, track, '지원유형|지원한도 / 국비 (70%)', track || '|' || amount, 'table_row' FROM i GROUP BY l_orderkey, track, amount
UNION ALL SELECT e.l_orderkey, e.n + 4, '기업당 한도', track, '', '', 'text' FROM e JOIN i ON e.l_orderkey = i.l_orderkey AND e.n = i.n""")
def e19_rows(spark, sf):
    """Each order as one source: a note, a table with two rows of titles and its lines by track, and a line under the last track."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat("l_returnflag", F.lit(" 트랙\t"), F.col("l_quantity").cast("int").cast("string"), F.lit("만원")).alias("row"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x.row), "\n")
    text = F.concat(F.lit("안내: 아래 표\n[표]\n지원유형\t지원한도\n지원유형\t국비 (70%)\n"), body, F.lit("\n[/표]\n가. 기업당 한도 ([참고1] 참조)"))
    out = S.prepare_rows(rows.select("l_orderkey", F.lit("공통").alias("label"), text.alias("text")), ["l_orderkey"], "label", "text")
    # the row number counts lines; the two rows of titles are those before the first item
    number = F.when(F.col("row_no") > 0, F.col("row_no") - 1).otherwise(0).cast("long")
    return out.select("l_orderkey", number.alias("row_no"), "text", "group_label", F.array_join("headers", "|").alias("headers"), F.array_join("cells", "|").alias("cells"), "structure")


@query("e20_select_sections")
def e20_sections(spark, sf):
    """A customer's orders as the sources of one notice: qualifications, nested ones, preferences and other sections, of several topics and lengths."""
    k, n = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    group = F.when(k == 0, "□ 신청 자격").when(k == 1, "지원대상").when(k == 2, "사업개요").when(k == 3, "우대 사항").when(k == 4, "제출 서류").otherwise("기관 소개")
    topic = F.when(F.col("o_orderkey") % 5 < 3, "매출액 ").when(F.col("o_orderkey") % 5 < 4, "업력 ").otherwise("특허 보유 ")
    line = F.concat(topic, n, F.lit(" 이상인 기업\n"))
    text = F.when(k == 2, F.concat(F.lit("□ 사업목적\n지원\n□ 신청자격\n"), line, F.lit("□ 제출서류\n서류\n"))).otherwise(F.repeat(line, (1 + F.col("o_orderkey") % 40).cast("int")))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", group.alias("label"), text.alias("text"))
    return S.select_sections(rows, "o_custkey", "o_orderkey", "label", "text", max_bytes=4000, max_sources=8).select("o_custkey", "o_orderkey", "priority", F.sha2("excerpt", 256).alias("excerpt_sha256"))


@query("e27_statement_issues", """WITH s AS (SELECT DISTINCT l_orderkey AS doc, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, (l_orderkey + l_linenumber) % 8 AS k FROM lineitem),
r AS (SELECT doc, id, unnest(CASE k WHEN 1 THEN ['unknown_source', 'unsupported_quote'] WHEN 2 THEN ['unsupported_number'] WHEN 3 THEN ['unsupported_organization'] WHEN 4 THEN ['incomplete_sentence', 'legal_article_number', 'unsupported_number'] WHEN 5 THEN ['wrong_criterion'] WHEN 6 THEN ['unsupported_group'] WHEN 7 THEN ['unsupported_quote', 'dependent_fragment', 'incomplete_sentence'] ELSE [] END) AS rule FROM s)
SELECT doc, id, rule FROM r UNION ALL SELECT doc, id, 'duplicate' FROM (SELECT doc, id, k, count(*) OVER (PARTITION BY doc, k) AS n FROM s) WHERE n > 1""")
def e27_issues(spark, sf):
    """Each order line is a statement about its order's one source, wrong in one way of eight; two of one way in an order are duplicates."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).alias("k")).distinct()
    k = F.col("k")
    topics = F.element_at(F.array(*map(F.lit, ("상시근로자 채용 계획서", "수출 바우처 이용 경험", "매출 규모 확인 서류", "특허 출원 이력 보유", "법령상 등록 기업 여부", "품질 인증 획득 사실", "장애인 고용 우대 조건", "지역 소재지 이전 예정"))), (k + 1).cast("int"))
    text = F.concat(
        F.when(k == 2, "3억원 이상 ").when(k == 3, "한빛진흥원 추천 ").when(k == 4, "제5조에 따른 ").when(k == 7, "이는 ").otherwise(""), topics,
        F.when(k == 7, F.lit("가 필요한 사항입니다. 다만 예외가 있는 기업도 있음")).otherwise(F.lit("가 있는 기업이 신청 대상입니다.")),
    )
    quote = F.when(k == 7, "없는 구절").otherwise(topics)
    rows = li.select(
        "doc", "id", F.when(k == 5, "UNKNOWN").otherwise("IP").alias("criterion"), text.alias("text"), F.when(k == 6, "성장 유형").otherwise("").alias("group_label"),
        F.array(F.when(k == 1, "other").otherwise("s")).alias("source_ids"), F.array(quote).alias("quotes"), F.array(F.lit("창업 유형")).alias("types"), topics.alias("topic"),
    )
    sources = rows.where("text <> ''").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("topic")), "\n").alias("excerpt")).withColumn("source_id", F.lit("s"))
    return Q.statement_issues(rows.drop("topic"), sources, ["IP", "REVENUE"])


_TOPICS = {
    "상시근로자 10명 미만": ["HEADCOUNT"], "매출액 3억원 이상": ["REVENUE"], "특허 보유": ["IP"], "업력 7년 이내": ["BUSINESS_AGE"], "국세 체납 없음": ["TAX"], "부채 비율 200%": ["CREDIT"],
    "trl 6단계": ["TRL"], "ISO 9001 인증": ["QUALITY"], "협동조합과 대학": ["BUSINESS_FORM", "LEGAL_FORM"], "일반 사항": [],
}


@query("e18_eligibility_topics", "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{C.CRITERIA[c][0]}')" for i, cs in enumerate(_TOPICS.values()) for c in cs) + f""") v(k, criterion, topic_group))
SELECT l_orderkey, criterion, topic_group, count(*) AS n FROM lineitem JOIN t ON k = l_partkey % {len(_TOPICS)} GROUP BY 1, 2, 3""")
def e18_topics(spark, sf):
    """Order lines as clauses, each about one part's topic."""
    clause = F.element_at(F.array(*map(F.lit, _TOPICS)), (F.col("l_partkey") % len(_TOPICS) + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", clause.alias("clause"))
    return C.eligibility_topics(rows, "clause").groupBy("l_orderkey", "criterion", "topic_group").agg(F.count("*").alias("n"))


@query("e14_support_types", """SELECT o_orderkey, [NULL, 'COMMERCIALIZATION', 'MARKET', NULL, 'SPACE', 'FINANCE'][1 + o_orderkey % 6] AS type, CAST([NULL, 220, 100, NULL, 200, 200][1 + o_orderkey % 6] AS INTEGER) AS score,
CASE o_orderkey % 6 WHEN 0 THEN 'NO_USABLE_SOURCE' WHEN 3 THEN 'NO_SUPPORT_ACTIVITY' ELSE 'RULE_CLASSIFICATION' END AS reason FROM orders""")
def e14_types(spark, sf):
    """Orders as notices: none, a section of full rank with a title of its type, an overview before another section, support outside sections, a heading's own line, and lines that belong together."""
    k, n = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    text = (
        F.when(k == 1, F.concat(F.lit("공고 "), n, F.lit("\n□ 지원 내용\n시제품 제작 비용을 지원합니다.\n향후 융자 지원\n□ 문의\n융자 지원 안내")))
        .when(k == 2, F.lit("□ 사업개요\n수출 바우처 지원 사업\n□ 지원대상\n융자 지원을 받은 기업"))
        .when(k == 3, F.lit("융자 지원 안내\n지원대상: 기업"))
        .when(k == 4, F.lit("2. 지원내용: 사무공간 입주를 지원합니다.\n붙임 1 신청서\n□ 지원내용\n융자 지원을 제공합니다."))
        .when(k == 5, F.lit("□ 지원내용\n중소기업 정책자금으로\n필요한 비용을 지원합니다.\n□ 설비 교체 안내"))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k == 1, "제품화 사업 공고").otherwise("공고").alias("title"), text.alias("text"))
    return C.support_types(rows, "o_orderkey", "title", "text").select("o_orderkey", "type", "score", "reason")


@query("e26_writing_language", "SELECT p_partkey, ['ko', 'en', 'ko', 'en', 'en', 'ko', 'ko'][1 + p_partkey % 7] AS language FROM part")
def e26_language(spark, sf):
    """Parts as templates: Korean by default, asked for in English, taken back, by name, by letters, on another file, and by a Korean name."""
    k = F.col("p_partkey") % 7
    text = (
        F.when(k == 0, F.concat(F.lit("사업계획서\n기업명 (English)\n"), "p_name"))
        .when(k == 1, F.lit("신청서\n\n※ 본 양식은 영문으로 작성하여 주십시오\n기업명"))
        .when(k == 2, F.lit("신청서\n본 양식은 영어 작성 불필요"))
        .when(k == 3, F.lit("양식"))
        .when(k == 4, F.concat(F.lit("Applicant details and project summary: "), "p_name"))
        .when(k == 5, F.lit("신청서\n요약\n별첨 양식은 영문으로 작성"))
        .otherwise(F.lit("Please write in English this form and all sections"))
    )
    name = F.when(k == 3, "dir/요약서 (English).hwp").when(k == 6, "국문 신청서.hwp").otherwise("양식.hwp")
    return M.writing_language(table(spark, sf, "part").select("p_partkey", name.alias("file"), text.alias("text")), "p_partkey", "file", "text")


@query("e24_score_tables", """WITH r AS (SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS row_no, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS points FROM lineitem),
t AS (SELECT l_orderkey, sum(points) AS total FROM r GROUP BY 1)
SELECT l_orderkey, row_no, '기준 ' || row_no AS criterion, points, CASE WHEN l_orderkey % 3 = 0 THEN 'deduction' ELSE 'bonus' END AS effect, CASE WHEN l_orderkey % 4 = 0 THEN least(total, 50.0) ELSE total END AS total,
CASE WHEN l_orderkey % 4 = 0 THEN 50.0 END AS most FROM r JOIN t USING (l_orderkey) WHERE l_orderkey % 5 > 0""")
def e24_tables(spark, sf):
    """Each order is a table of points: a third of deductions, a fourth with a limit, and every fifth with a sign against its effect."""
    li, key = table(spark, sf, "lineitem"), F.col("l_orderkey")
    sign = F.when(key % 5 == 0, F.when(key % 3 == 0, "+").otherwise("-")).when(key % 3 == 0, "−").otherwise("")
    cells = F.array(F.lit("1"), F.concat(F.lit(" 기준 "), F.col("l_linenumber").cast("string")), F.concat(sign, F.col("l_quantity").cast("int").cast("string"), F.lit(" 점")))
    heads = F.array(F.lit("번호"), F.when(key % 3 == 0, "감점 사항").otherwise("우대 조건"), F.lit("배 점"))
    orders = li.select("l_orderkey").distinct()
    rows = li.select("l_orderkey", F.lit(0).alias("table_no"), F.col("l_linenumber").alias("row_no"), cells.alias("cells")).unionByName(orders.select("l_orderkey", F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), heads.alias("cells")))
    notes = orders.where(key % 4 == 0).select("l_orderkey", F.lit(0).alias("table_no"), F.lit("※ 합계는 최대 50점 이내").alias("note"))
    return M.score_tables(rows, "l_orderkey", notes).drop("table_no")


_NATURES = [
    ("기술개발 지원사업 모집 공고", "지원사업을 다음과 같이 모집합니다.", None), ("지원사업 평가 결과 안내", "선정 평가 결과를 다음과 같이 공고합니다.", "RESULT"), ("관리 지침 개정 고시", "관리 지침을 일부 개정하여 고시합니다.", "REGULATION"),
    ("유공자 포상 추천 안내", "포상 대상과 훈격은 다음과 같습니다.", "AWARD"), ("아이디어 공모전 개최 공고", "공모전을 다음과 같이 개최합니다. 상금을 드립니다.", "CONTEST"), ("연구시설 지정 신청 안내", "지정 신청을 받습니다.", "DESIGNATION_RECRUITMENT"),
    ("정책 설명회 개최", "설명회에 참석 바랍니다.", "GENERAL"), ("지원사업 평가 결과 안내", "전년도 결과입니다. 추가로 신청을 받습니다.", None),
]


@query("e13_natures", f"SELECT o_orderkey, [{', '.join('NULL' if n is None else chr(39) + n + chr(39) for *_, n in _NATURES)}][1 + o_orderkey % {len(_NATURES)}] AS nature FROM orders")
def e13_natures(spark, sf):
    """Orders as notices of each nature, and of none."""
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in _NATURES]), (F.col("o_orderkey") % len(_NATURES) + 1).cast("int"))
    number = F.concat(F.lit("제"), F.col("o_orderkey").cast("string"), F.lit("호 "))
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(number, pick(0)).alias("title"), F.array(F.lit(""), pick(1)).alias("sources"))
    return N.notice_nature(rows, "o_orderkey", "title", "sources")
