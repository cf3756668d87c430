"""What the clauses of a notice are about: eligibility criteria, and the type of support that its sections describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .similarity import by_text

# Criteria with their group and the words that tell them.
CRITERIA = {
    "BUSINESS_FORM": ("COMPANY", r"법인\s*사업자|개인\s*사업자|예비\s*창업자|외국\s*법인|기업\s*형태|기관\s*유형|기업(?=\s*만\s*가능)|(?<![가-힣])기업(?=\s*[,·ㆍ])|대학(?!원)|연구기관|의료기관"),
    "COMPANY_SIZE": ("COMPANY", r"중소기업(?!진흥|기본법)|중견기업|소상공인|스타트업|대기업|소기업(?!진흥)|기업\s*규모"),
    "BUSINESS_AGE": ("COMPANY", r"업력|창업\s*(?:후|한|[0-9])|설립\s*(?:후|일|[0-9])|회사성립연월일"),
    "LOCATION": ("COMPANY", r"(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충청|전라|경상|제주|국내|해외)[가-힣]*\s*(?:소재|지역|내\s)|소재지|본사|본점|사업장|이전\s*예정"),
    "LEGAL_FORM": ("COMPANY", r"주식회사|유한회사|협동조합|(?:설립|법인)\s*형태|조합(?!원)"),
    "REPRESENTATIVE": ("COMPANY", r"대표자|대표의\s*(?:연령|나이|성별|국적)|청년\s*대표|여성\s*대표|장애인\s*대표|재창업자"),
    "REVENUE": ("FINANCIAL", r"매출(?:액|실적|규모)?"),
    "CAPITAL": ("FINANCIAL", r"자본금|자기자본|자본\s*(?:전액\s*)?잠식|완전자본잠식"),
    "CREDIT": ("FINANCIAL", r"부채\s*비율|신용\s*등급|기업\s*평가\s*등급|이자보상"),
    "INVESTMENT": ("FINANCIAL", r"투자\s*유치|누적\s*투자|VC\s*투자"),
    "EXPORT": ("FINANCIAL", r"수출(?:액|비중|실적|희망|\s*\(?희망|\s*기업|\s*중소기업)?"),
    "IP": ("TECHNOLOGY", r"특허|지식재산권|산업재산권|실용신안"),
    "CERTIFICATION": ("TECHNOLOGY", r"기업\s*인증|(?<![가-힣])벤처\s*기업|이노비즈|메인비즈|기업\s*부설\s*연구소|연구\s*개발\s*전담\s*부서|여성기업|장애인기업|사회적기업|social\s*venture|소셜벤처"),
    "TRL": ("TECHNOLOGY", r"TRL|기술\s*성숙도"),
    "QUALITY": ("TECHNOLOGY", r"ISO\s*[0-9]*|GS\s*인증|KC\s*인증|ISMS|품질\s*인증|보안\s*인증"),
    "TCB": ("TECHNOLOGY", r"TCB|기술\s*평가\s*등급"),
    "SECTOR": ("INDUSTRY", r"업종|산업\s*분야|지원\s*분야|KSIC|한국표준산업분류|제조업|제조(?=\s*[’'」])|AI[·ㆍ/\s]|바이오|반도체|정보통신기업"),
    "PRODUCT": ("INDUSTRY", r"시제품|상용화\s*제품|제품\s*보유|서비스\s*보유|사업화\s*단계|CBAM\s*대상\s*품목"),
    "EXPERIENCE": ("INDUSTRY", r"사업\s*실적|납품\s*(?:이력|실적)|레퍼런스|관련\s*(?:분야|산업).*?(?:경험|실적)"),
    "BUSINESS_ITEM": ("INDUSTRY", r"사업\s*아이템|공고\s*취지|과제\s*(?:내용|분야)|과제제안요구서|과제제안요청서"),
    "HEADCOUNT": ("WORKFORCE", r"상시\s*(?:근로자|종업원)|직원\s*수|종업원\s*수"),
    "EXPERTS": ("WORKFORCE", r"전문\s*인력|전담\s*인력|연구\s*인력|석[·ㆍ]?박사|박사|석사|자격증\s*보유|연구책임자"),
    "EMPLOYMENT": ("WORKFORCE", r"고용\s*(?:실적|증가|인원)|청년\s*고용|신규\s*채용"),
    "DUPLICATE": ("RESTRICTIONS", r"중복\s*(?:수혜|지원|과제)|(?<![가-힣])기\s*수혜|(?<![가-힣])기\s*지원|기존.*?참여기업|동시(?:에)?\s*(?:참여|수행)|과거\s*지원|수혜\s*이력"),
    "COMPLETION": ("RESTRICTIONS", r"졸업|수료|프로그램\s*참여\s*이력"),
    "CLOSURE": ("RESTRICTIONS", r"휴업|폐업|휴[·ㆍ‧/・]폐업|휴[·ㆍ‧/・]?(?:업)?\s*및\s*폐업"),
    "TAX": ("RESTRICTIONS", r"국세(?!청)|지방세|세금\s*체납|조세\s*체납"),
    "DEFAULT": ("RESTRICTIONS", r"연체|신용\s*불량|채무\s*불이행|회생|파산|부도"),
    "SANCTIONS": ("RESTRICTIONS", r"참여\s*제한|제재\s*처분|부정\s*수급|환수금|제재부가금|의무사항.*?불이행"),
    "EXCLUDED_SECTOR": ("RESTRICTIONS", r"제외\s*업종|도박|유흥|금융[·ㆍ‧/・]?보험업|사행성"),
    "PLAN": ("EXECUTION", r"(?:사업|연구\s*개발)\s*계획서|발표\s*평가|수행\s*의지|수행\s*계획|사업\s*계획"),
    "MATCHING": ("EXECUTION", r"자부담|민간\s*부담금|기관\s*부담\s*연구개발비|현금\s*부담|현물\s*매칭|매칭\s*비율"),
    "CONSORTIUM": ("EXECUTION", r"컨소시[엄움]|공동\s*연구개발기관|공동기관|참여기관\s*구성|산학연|수요기업\s*확약|협약기관|임상시험\s*참여기관"),
    "LINKAGE": ("EXECUTION", r"액셀러레이터|지역\s*거점기관|상호\s*연계|기관과의\s*협업"),
    "PREF_REGION": ("PREFERENCE", r"비수도권|인구\s*소멸|인구\s*감소|지역\s*우대|소외지역"),
    "PREF_SOCIAL": ("PREFERENCE", r"ESG|사회적\s*기업|사회적\s*가치|일자리|고용"),
    "PREF_REPRESENTATIVE": ("PREFERENCE", r"청년기업|여성기업|장애인기업|(?:대표|대표자|대표이사).{0,12}(?:청년|여성|장애인)|(?:청년|여성|장애인).{0,12}대표"),
    "PREF_INVESTMENT_EXPORT": ("PREFERENCE", r"투자|수출"),
    "PREF_AWARDS": ("PREFERENCE", r"포상|수상|표창"),
    "PREF_CLUSTER": ("PREFERENCE", r"규제\s*자유\s*특구|클러스터|특구|입주"),
}
# Types of support and the words, white space aside, that tell them.
TYPES = {
    "RND": r"(?:R&D|연구개발|기술개발|공동연구(?!개발))(?!(?:\([^)]{0,12}\))?\)?(?:기업|인력|실적|기관))",
    "DEMONSTRATION": r"실증|테스트베드|PoC|시범(?:사업|운영|적용|적으로참여)|현장검증",
    "COMMERCIALIZATION": r"시제품|제품화|사업화|양산|제품고도화|제품디자인",
    "ADOPTION": r"인프라구축|시스템(?:을)?구축|시스템(?:을)?도입|솔루션도입|(?:설비|시설)(?:를|을|의)?(?:도입|구축|개선|교체|구매|설치|지원|투자비)|장비도입|장비구축|시설개선|환경개선|환경조성|스마트공장|공정개선",
    "CERTIFICATION": r"인증(?:을|의)?(?:취득|획득|비용|수수료|시험|지원)|(?<!정부)인증(?!기업|기관|업체|보유|실적)|시험평가|시험비|제3자검증|배출량검증|성능시험|규격시험",
    "MARKET": r"판로|마케팅|해외진출|수출(?:지원|마케팅|상담|바우처|판로|촉진|기회)|전시회|박람회|구매상담|시장진출",
    "FINANCE": r"융자|이차보전|이자지원|신용보증|기술보증|보증지원|직접투자|투자유치|정책자금",
    "WORKFORCE": r"채용지원|고용지원|고용장려|인건비지원|인력양성|인재양성|교육지원|직무교육|훈련지원|교육훈련|훈련과정|역량강화코칭",
    "ADVISORY": r"컨설팅|정책연구|조사용역|시장조사|기술지도|(?:기초자료|현황|실태|사례|타당성)조사|현황분석|(?:기본구상|기본계획|개선방안)(?:안)?(?:수립|검토)|전문자문|법률지원|회계지원|(?:법률|노무|회계)상담|고충상담|특허(?!보유)|지식재산|출원",
    "SPACE": r"입주|사무공간|보육공간|공간지원|공간제공|연구공간",
}
# Headings of support sections, those of full rank, what ends them, forms, and what a line of support says or must not say.
HEADING = (
    r"^[\h□■○◦●ㅇ•*※①②③④⑤⑥⑦⑧⑨⑩ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ\d.()\[\]-]*(?:[가-하]\.\h*)?(수행\h*내용|선정\h*목적|사업\h*목적|지원\h*내용|지원\h*분야|(?:주요\h*)?사업\h*내용|"
    r"(?:주요\h*)?과업\h*(?:의\h*)?(?:(?:주요|세부)\h*)?내용|과업\h*(?:의\h*)?범위|주요\h*과업|연구\h*(?:목표|내용(?:\h*및\h*범위)?|범위)|모집\h*내용|지원\h*항목|"
    r"지원\h*설비|지원\h*범위|지원\h*방식|지원\h*규모|(?:시범\h*)?사업\h*개요|(?:시범\h*)?사업\h*목적|개\h*념)\h*(?:[)\]]\h*[:：]?|[:：]|$)"
)
FULL_RANK = (
    r"^(?:수행내용|선정목적|지원규모|지원내용|지원분야|지원항목|지원설비|지원범위|지원방식|(?:주요)?사업내용|(?:주요)?과업(?:의)?(?:주요|세부)?내용|"
    r"과업(?:의)?범위|주요과업|연구(?:내용(?:및범위)?|범위)|모집내용)$"
)
BOUNDARY = (
    r"^[□■]|^\[참고 구간 제외\]|^\[파일:|^RFP\h*번호|^[\h\dⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ.()\[\]-]*(?:[가-하]\.\h*)?(?:지원대상|지원\h*자격|모집대상|참여자격|지원기간|연구\h*추진\h*방법|"
    r"연구비|연구\h*기간|신청|접수|제출|평가|선정|지원제외|유의|문의|추진일정|사업기간|과업\h*수행\h*일반사항|과업\h*지시사항|사업\h*예산|입찰\h*개요|제안서\h*작성)"
)
OTHER_BOX = r"^(?:신청|접수|제출|지원\h*대상|지원\h*자격|참여\h*자격|참고|유의|문의|평가|선정\h*기준|추진\h*절차)"
FORM = r"^[\h\[<(【]*(?:붙임|별첨|별지|서식)\h*(?:제\h*)?\d|^[\h\[<(【]*(?:작성\h*예시|사업계획서|신청서|동의서)"
NOTICE_LINE, NON_NOTICE = r"공고|모집\h*안내|사업\h*안내", r"(?i)예시|견본|FAQ|참고자료|신청서|계획서|동의서|서식|양식|협약서|작성\h*예시"
UNSUPPORTED = (
    r"전년도|지난해|타\h*사업|다른\h*사업|작성\h*예시|지원\h*(?:제외|없음|불가|하지)|미지원|후속|향후|추후|연계\h*가능|참고용|일부 원문 생략"
)
ACTION = r"지원|제공|수행|구축|도입|모집|융자|입주|개발|실증|컨설팅"
ADMINISTRATIVE = r"지원대상|신청자격|보유자격|접수마감|접수기간|제출기한|접수기한|제출마감|신청마감"
EXPLICIT = r"(?:비용|취득비|제작비|개발비|구축비)(?:를|을)?지원|지원합니다|제공합니다|수행합니다"
TYPE_ACTIONS = {
    "ADOPTION": r"설치|교체|개선|구매|(?:설비|시설)(?:의)?투자비",
    "WORKFORCE": r"코칭|교육|훈련",
    "ADVISORY": r"조사|분석|검토|수립",
    "DEMONSTRATION": r"시범.{0,80}(?:참여|적용|허용|유지)",
}
#: Lines that a heading reaches, score of its rank, and what a title of the type adds (fixed values).
REACH, HIGH, LOW, TITLE = 35, 200, 100, 20


def eligibility_topics(clauses: DataFrame, clause: str, criteria: dict[str, tuple[str, str]] = CRITERIA) -> DataFrame:
    """``clauses`` with criterion and topic_group: one row for each criterion that a clause is about; it says nothing of who is eligible.

    Equal clauses are read once.
    """
    hits = [F.when(F.col(clause).rlike(f"(?i){p}"), F.struct(F.lit(code).alias("criterion"), F.lit(group).alias("topic_group"))) for code, (group, p) in criteria.items()]
    told = lambda once: once.select("__same", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("__same", "hit.criterion", "hit.topic_group")
    return by_text(clauses, clauses.columns, [clause], told).select(*clauses.columns, "criterion", "topic_group")


def _tight(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def _supports(kind: str, text: Column) -> Column:
    """A text describes support of this kind, now and not as an administrative matter."""
    tight = _tight(text)
    acts = tight.rlike(ACTION) | (tight.rlike(TYPE_ACTIONS[kind]) if kind in TYPE_ACTIONS else F.lit(False))
    return tight.rlike(f"(?i){TYPES[kind]}") & ~text.rlike(UNSUPPORTED) & (~tight.rlike(ADMINISTRATIVE) | tight.rlike(EXPLICIT)) & acts


def support_types(df: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, type, score, evidence, reason): the type of support of each notice, by the lines of its support sections.

    A section begins with its heading and ends with another section's mark or 35 lines on; a box within a section of full rank is
    part of it while it describes support.  A line tells types by itself or with the two lines after it.  Score: the heading's rank, and
    20 more where the title tells the type as well; of equal ones the earliest counts.  ``reason``: RULE_CLASSIFICATION,
    NO_SUPPORT_ACTIVITY, or NO_USABLE_SOURCE for null and blank texts, the other columns being null then.  What follows the
    heading of a form is not read.  Equal notices are read once.
    """
    types = by_text(df, [key], [title, text], lambda once: _support_types(once, "__same", title, text))
    return types.select(key, "type", "score", "evidence", "reason")


def _support_types(df: DataFrame, key: str, title: str, text: str) -> DataFrame:
    lines = df.select(key, F.coalesce(title, F.lit("")).alias("__title"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "physical"))
    line = F.regexp_replace("physical", r"^\s+|\s+$", "")
    up = Window.partitionBy(key).orderBy("line_no")
    upto, above = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"line": line, "offset": F.coalesce(F.sum(F.length("physical") + 1).over(above), F.lit(0))})
    form = F.col("line").rlike(FORM) & ~(F.col("line").rlike(NOTICE_LINE) & ~F.col("line").rlike(NON_NOTICE))
    lines = lines.withColumns({"form": form, "past": F.max(form.cast("int")).over(upto)}).where("past = 0")
    is_heading = F.col("line").rlike(HEADING)
    name = _tight(F.regexp_extract("line", HEADING, 1))
    own_rank = F.when(is_heading, F.when(name.rlike(FULL_RANK), HIGH).otherwise(LOW))
    content = F.regexp_replace("line", r"^[□■]\h*", "")
    some = F.lit(False)
    for kind in TYPES:
        some = some | _supports(kind, content)
    goes_on = F.col("line").rlike("^[□■]") & ~content.rlike(OTHER_BOX) & ~content.rlike(UNSUPPORTED) & some
    lines = lines.withColumns({"heading": is_heading, "own_rank": own_rank, "ends": ~is_heading & F.col("line").rlike(BOUNDARY), "goes_on": goes_on})
    lines = lines.withColumns({"block": F.sum(F.col("heading").cast("int")).over(upto), "rank": F.last("own_rank", ignorenulls=True).over(upto)}).where("block > 0")
    ends = F.col("ends") & ~((F.col("rank") == HIGH) & F.col("goes_on"))
    in_block = Window.partitionBy(key, "block").orderBy("line_no")
    lines = lines.withColumn("ends", ends)
    follows = lambda n: F.lead(F.struct("line", (~F.col("ends") & ~F.col("line").rlike(UNSUPPORTED)).alias("ok")), n).over(in_block)
    lines = lines.withColumns({
        "over": F.max(F.col("ends").cast("int")).over(in_block.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(in_block), "one": follows(1), "two": follows(2),
    })
    lines = lines.where((F.col("over") == 0) & (F.col("n") < REACH) & F.length("line").between(8, 1000) & ~F.col("line").rlike(UNSUPPORTED))
    first = F.when(F.col("one.ok") & (F.length("line") + 1 + F.length("one.line") <= 700), F.concat("line", F.lit("\n"), "one.line")).otherwise(F.col("line"))
    lines = lines.withColumn("more", first)
    second = F.when((F.col("more") != F.col("line")) & F.col("two.ok") & (F.length("more") + 1 + F.length("two.line") <= 700), F.concat("more", F.lit("\n"), "two.line")).otherwise(F.col("more"))
    after = lambda c: F.when(F.col("heading"), F.regexp_replace(F.regexp_replace(c, HEADING, ""), r"^\s+|\s+$", "")).otherwise(c)
    lines = lines.withColumns({"more": second, "own": F.get(F.split(after(F.col("line")), r"[□■]\h*[가-힣]+\h*[:：]"), F.lit(0))})
    offers = []
    for kind, signal in TYPES.items():
        evidence = F.when(_supports(kind, F.col("own")), F.col("line")).otherwise(F.col("more"))
        at = F.length(F.get(F.split(_tight(evidence), f"(?i){signal}", 2), F.lit(0)))
        score = F.col("rank") + F.when(_tight(F.col("__title")).rlike(f"(?i){signal}"), TITLE).otherwise(0)
        offer = F.struct(score.alias("score"), (-(F.col("offset") + at)).alias("early"), F.lit(-len(offers)).alias("place"), F.lit(kind).alias("type"), evidence.alias("evidence"))
        offers.append(F.when(_supports(kind, after(evidence)), offer))
    best = lines.select(key, F.explode(F.array_compact(F.array(*offers))).alias("o")).groupBy(key).agg(F.max("o").alias("o"))
    blank = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")) == ""
    out = df.select(key, blank.alias("__blank")).join(best, key, "left")
    reason = F.when(F.col("o").isNotNull(), "RULE_CLASSIFICATION").when(F.col("__blank"), "NO_USABLE_SOURCE").otherwise("NO_SUPPORT_ACTIVITY")
    return out.select(key, "o.type", "o.score", "o.evidence", reason.alias("reason"))
