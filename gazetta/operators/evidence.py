"""Facts of two texts compared, and excerpts of long texts within a budget."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfkc, once

# Words read as one another, and the words of roles, applicants, metrics, units and conditions.
ALIASES = [
    ("주관연구개발기관|주관연구기관", "주관기관"),
    ("공동연구개발기관|공동연구기관", "공동기관"),
    ("중소기업자", "중소기업"),
    ("중소/중견기업", "중소기업또는중견기업"),
    ("기업인경우는?|기업일경우|기업이면", "기업조건"),
    ("인정(?:되지는|되지|하지는|하지)않(?:습니다|는다|는|음)?|인정할수없(?:습니다|는|음)?|미인정|인정불가", "불인정"),
    ("불인정대상", "불인정"),
    ("허용되지않(?:습니다|는다|는|음)?|불허", "허용금지"),
    ("없어야|없는|없어", "없음"),
    ("혹은|거나", "또는"),
    ("전부충족|동시에충족", "모두충족"),
    ("(?<!직)전년도", "직전년도"),
    ("접수마감일(?:현재|기준)", "접수마감일"),
    ("이내", "이하"),
]
METRICS = {"매출액": "매출", "직접수출액": "직접수출", "수출액": "수출", "수출실적": "수출", "설립": "업력", "창업": "업력"}
COMPARE = {"이상": "GE", "≥": "GE", ">=": "GE", "이하": "LE", "≤": "LE", "<=": "LE", "초과": "GT", ">": "GT", "미만": "LT", "<": "LT"}
NEGATIVE = ["불인정", "허용금지", "없음", "않", "제외", "불가"]
ROLE = "주관기관|공동기관|수혜기업|운영기관|수행기관|[가-힣A-Za-z]{2,12}과제"
ENTITY = (
    "기업부설연구소|연구개발전담부서|비영리법인|법인사업자|개인사업자|중소기업|중견기업|대기업|창업기업|소상공인|소공인|공공기관|민간기관|전문기관|"
    "상권활성화구역|골목형상점가|전통시장|상점가|상인연합회|상인회|협동조합|대학교|대학|연구기관|사업자단체|단체|제조업|서비스업|건설업|한국산업기술진흥협회|글로벌강소기업"
)
METRIC = (
    "직접수출액?|수출액?|수출실적|매출액?|부채비율|유동비율|상인회비납부율|상인회가입률|가맹률|가입률|계약실적|납품실적|상시근로자수|근로자수|업력|창업|설립|영업점포"
)
UNITS = "억원|만원|천원|원|만불|불|달러|년|개월|%|점|건|명|개사|개|종"
CRITICAL = (
    "불인정|허용금지|없음|않|제외|불가|예외|단서|또는|모두|하나|무관|한정|기업조건|등록|출원|실시권|주된|공고일|접수일|마감일|개최일|직전년도|최근|전일|이전|이후|"
    ">=|<=|≥|≤|>|<|이상|이하|초과|미만"
)
ANCHOR = f"{ENTITY}|특허|인증|신용등급|신용평가등급"
GRADE = "[A-D]{1,3}[+-]?(?![A-Za-z])"
# A cited law: its name, whether its order is meant, and the provision; articles, and names of laws without marks.
PROVISION = r"제\d+조(?:의\d+)?(?:제?\d+(?:항|호)(?:의\d+)?)*"
LAW = rf"[「『｢]([^」』｣\n]{{2,100}}(?:법|법률))[」』｣](시행령|시행규칙)?({PROVISION})?"
BARE_LAW = r"[가-힣]{2,}법(?:시행령|시행규칙)?(?=제\d|에|$|[.,()])"
TOPICS = [
    r"신청\s*자격|지원\s*대상|참여\s*자격|제외|불가|제한|단,|다만",
    r"접수|마감|제출|신청\s*기간|변경|정정|연장",
    r"지원\s*(?:금|규모|내용)|사업비|부담|예산|억원|백만원",
    r"목적|사업\s*개요|수행|과업|컨소시엄|주관|공동|협약",
    r"문의|담당|연락|전화|이메일",
]
HEADING = r"[ \t]*(?:[□■○]\s*|\d+[.)]\s+|[가-하][.)]\s+)"
GAP = "\n[일부 원문 생략: 누락 부분은 확인되지 않음]\n"

_SIGNS = ">=|<=|≥|≤|>|<"
_NUMBER = rf"(?:{_SIGNS})?[A-Z]?\d+(?:,\d{{3}})*(?:\.\d+)?(?:{UNITS})?(?:[은는이가]?(?:이상|이하|초과|미만|{_SIGNS}))?"
_KINDS = {"role": ROLE, "metric": METRIC, "number": _NUMBER, "entity": ENTITY, "term": CRITICAL, "anchor": ANCHOR, "grade": GRADE}


def _named(table: dict[str, str], c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(names, c), c)


def _quantity(token: Column) -> Column:
    """Prefix, plain value, unit and comparator of a number token, as one text."""
    value = F.regexp_replace(F.regexp_extract(token, r"\d+(?:,\d{3})*(?:\.\d+)?", 0), ",", "")
    value = F.regexp_replace(F.regexp_replace(value, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1")
    after = F.regexp_extract(token, f"(이상|이하|초과|미만|{_SIGNS})$", 1)
    sign = F.when(after != "", after).otherwise(F.regexp_extract(token, f"^({_SIGNS})", 1))
    unit = F.regexp_extract(token, rf"\d({UNITS})", 1)
    return F.concat_ws("|", F.regexp_extract(token, r"([A-Z])\d", 1), F.regexp_replace(value, r"\.$", ""), unit, _named(COMPARE, sign))


def _laws(c: Column) -> Column:
    """The laws that a text cites with marks: name with order, and provision."""
    group = lambda g: F.regexp_extract_all(c, F.lit(LAW), F.lit(g))
    cited = F.arrays_zip(group(1).alias("name"), group(2).alias("order"), group(3).alias("provision"))
    return F.transform(cited, lambda x: F.struct(F.concat(x["name"], x["order"]).alias("name"), x["provision"].alias("provision")))


def _without_laws(text: Column, cited: Column) -> Column:
    """A text without the laws that the other one cites: with their provision, and by name alone where no other article follows."""
    plain = F.when(F.size(cited) > 0, F.regexp_replace(text, "[「」『』｢｣]", "")).otherwise(text)

    def leave_out(left: Column, law: Column) -> Column:
        left = F.replace(left, F.concat(law["name"], law["provision"]), F.lit(""))
        alone = F.concat(F.lit(r"\Q"), law["name"], F.lit(r"\E(?!제\d)"))
        return F.when(law["provision"] != "", F.regexp_replace(left, alone, F.lit(""))).otherwise(left)

    return F.aggregate(cited, plain, leave_out)


def _compared(text: Column) -> Column:
    """Compatibility characters folded, provisos marked, no white space."""
    return F.regexp_replace(F.regexp_replace(nfkc(text), r"(^|[\s.※*;(])(?:단|다만)(?:[,，]\s*|\s+)", "$1단서"), r"\s+", "")


def facts_equivalent(pairs: DataFrame, keys: list[str], text: str, quote: str) -> DataFrame:
    """(keys, equivalent): whether a text says the same quantities, applicants, conditions and grades as a quote.

    Quantities belong to the role and metric before them; those without a metric keep their order.  The branches of "또는" are
    compared one by one, in any order.  A text may leave out laws that the quote cites, or their articles, but not name another
    law or article, with marks or without.  Full-width and other compatibility characters count as the plain ones.  Null counts
    as empty, and two empty texts are equivalent.  Equal pairs of texts are judged once, whatever their keys, and every row has its answer.
    """
    value = lambda c: F.coalesce(c, F.lit(""))
    rows = pairs.select(*keys, value(F.col(text)).alias("__text"), value(F.col(quote)).alias("__quote"))
    pair = F.sha2(F.concat(F.length("__text").cast("string"), F.lit(":"), "__text", "__quote"), 256)
    rows = rows.withColumn("__pair", pair)
    judged = _judged(rows.select(F.col("__pair").alias("pair"), "__text", "__quote").distinct())
    return rows.select(*keys, "__pair").join(judged.withColumnRenamed("pair", "__pair"), "__pair").select(*keys, "equivalent")


def _judged(pairs: DataFrame) -> DataFrame:
    """(pair, equivalent) of different pairs of texts (pair, __text, __quote), as ``facts_equivalent`` tells."""
    pairs = pairs.select("pair", _compared(F.col("__text")).alias("t"), _compared(F.col("__quote")).alias("q"))
    pairs = pairs.withColumns({"cited": _laws(F.col("q")), "named": _laws(F.col("t"))})
    names = lambda c: F.transform(c, lambda law: law["name"])
    legal = F.size(F.array_except(names(F.col("named")), names(F.col("cited")))) == 0
    pairs = pairs.select("pair", legal.alias("legal"), _without_laws(F.col("t"), F.col("cited")).alias("t"), F.regexp_replace("q", LAW, "").alias("q"))
    added = [F.array_except(F.regexp_extract_all("t", F.lit(p), F.lit(0)), F.regexp_extract_all("q", F.lit(p), F.lit(0))) for p in (BARE_LAW, PROVISION)]
    pairs = pairs.withColumn("legal", F.col("legal") & (F.size(added[0]) == 0) & (F.size(added[1]) == 0))
    sides = F.explode(F.array(F.struct(F.lit("t").alias("side"), F.col("t").alias("value")), F.struct(F.lit("q").alias("side"), F.col("q").alias("value"))))
    rows = pairs.select("pair", "legal", sides.alias("s")).select("pair", "legal", "s.side", "s.value")
    plain = F.col("value")
    for pattern, word in ALIASES:
        plain = F.regexp_replace(plain, pattern, word)
    rows = rows.withColumn("value", plain)
    signs = F.array(F.contains(F.regexp_replace("value", ">=|<=", ""), F.lit("=")), *[F.contains("value", F.lit(c)) for c in "±×"])
    id_ = ["pair", "side"]
    branches = F.split("value", "또는")
    # the whole text is branch -1; where there are several branches, each is read for itself too
    parts = F.concat(F.array("value"), F.when(F.size(branches) > 1, branches).otherwise(F.array().cast("array<string>")))
    parts = rows.select(*id_, F.posexplode(parts).alias("branch", "part"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("part", F.lit(p), F.lit(0)).alias("hits"), F.split("part", p).alias("gaps")) for k, p in _KINDS.items()])
    found = parts.select(*id_, "branch", F.explode(kinds).alias("k")).select(*id_, "branch", "k.kind", "k.gaps", "k.hits", F.posexplode("k.hits").alias("i", "token"))
    before = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    found = found.withColumn("at", before(F.col("gaps"), F.col("i") + 1) + before(F.col("hits"), F.col("i"))).drop("gaps", "hits")
    up = Window.partitionBy(*id_, "branch").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    last = lambda kind: F.coalesce(F.last(F.when(F.col("kind") == kind, F.col("token")), ignorenulls=True).over(up), F.lit(""))
    found = found.withColumns({"role": last("role"), "metric": _named(METRICS, last("metric")), "anchor": last("anchor")})
    number, loose = F.col("kind") == "number", (F.col("kind") == "number") & (F.col("metric") == "")
    turn = F.row_number().over(Window.partitionBy(*id_, "branch", F.when(loose, "loose").otherwise(F.col("kind"))).orderBy("at"))
    fact = (
        F.when(loose, F.concat_ws("|", F.lit("loose"), turn.cast("string"), "role", _quantity(F.col("token"))))
        .when(number, F.concat_ws("|", F.lit("number"), "role", "metric", _quantity(F.col("token"))))
        .when(F.col("kind") == "entity", F.concat_ws("|", "kind", "role", "token"))
        .when(F.col("kind") == "term", F.concat_ws("|", "kind", "role", F.when(F.col("token").isin(NEGATIVE), F.col("anchor")).otherwise(""), _named(COMPARE, F.col("token"))))
        .when(F.col("kind") == "grade", F.concat_ws("|", "kind", turn.cast("string"), "token"))
        .when((F.col("kind") == "role") & (F.col("branch") == 0), F.concat_ws("|", "kind", "token"))
    )
    found = found.withColumn("fact", fact).where("fact IS NOT NULL").groupBy(*id_, "branch", "kind", "fact").agg(F.count("*").alias("n"))
    times = F.when(F.col("kind").isin("entity", "role"), F.lit(1)).otherwise(F.col("n"))  # sets, the others with repeats
    said = found.groupBy(*id_, "branch").agg(F.array_sort(F.collect_list(F.struct("fact", times.alias("n")))).alias("facts"))
    whole = F.when(F.col("branch") == 0, "whole").otherwise("branch")
    said = said.groupBy(*id_).agg(F.array_sort(F.collect_list(F.struct(whole.alias("of"), "facts"))).alias("said"))
    each = rows.join(said, id_, "left")
    one = F.struct(signs.alias("signs"), F.size(branches).alias("branches"), "said")
    each = each.select(*id_, "legal", one.alias("one"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.struct(F.lit(1).alias("x"), F.to_json(c).alias("v"))))["v"]
    both = each.groupBy("pair").agg(F.min("legal").alias("legal"), of("t", F.col("one")).alias("a"), of("q", F.col("one")).alias("b"))
    return both.select("pair", ((F.col("a") == F.col("b")) & F.col("legal")).alias("equivalent"))


def evidence_units(df: DataFrame, key: str, text: str, topics: list[str] = TOPICS, most: int = 1600) -> DataFrame:
    """(key, start, end, topics, signature): a text's units in characters, end exclusive, with the numbers of the topics each shows.

    A unit begins at a heading or after a blank line; one of over ``most`` characters is cut after lines and sentences, each part as
    long as the limit allows; only a single longer line or sentence passes it.
    A unit that begins with a proviso belongs to the one before; blank units are left out.
    """
    cut = rf"(?m)(?<=\n[ \t]{{0,40}}\r?\n)(?=.)|(?=^{HEADING})"
    rows = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), cut)).alias("unit", "body"))
    # only units that are too long are read by lines and sentences; a piece that would pass the limit begins a part
    lines = F.when(F.length("body") > most, F.split("body", r"(?<=\n)|(?<=[다요][.!?]\s{1,8})(?=\S)")).otherwise(F.array("body"))
    begin = F.struct(*[F.lit(0).alias(c) for c in ("at", "start", "part")], F.array().cast("array<int>").alias("parts"))

    def add(s: Column, piece: Column) -> Column:
        right = s["at"] + F.length(piece)
        new = (right - s["start"] > most) & (s["at"] > s["start"])
        part = s["part"] + new.cast("int")
        return F.struct(right.alias("at"), F.when(new, s["at"]).otherwise(s["start"]).alias("start"), part.alias("part"), F.concat(s["parts"], F.array(part)).alias("parts"))

    pieces = once(lines, lambda x: once(F.aggregate(x, begin, add, lambda s: s["parts"]), lambda parts: F.transform(x, lambda piece, i: F.struct(piece.alias("body"), F.get(parts, i).alias("part")))))
    rows = rows.select(key, "unit", F.posexplode(pieces).alias("line", "p")).select(key, "unit", "line", "p.body", "p.part").where("body <> ''")
    up = Window.partitionBy(key).orderBy("unit", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length("body")).over(up))
    rows = rows.withColumn("start", F.col("end") - F.length("body"))
    parts = rows.groupBy(key, "unit", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "body"))).alias("b"))
    parts = parts.withColumn("body", F.array_join("b.body", "")).where(F.trim(F.regexp_replace("body", r"\s+", " ")) != "")
    first = F.row_number().over(Window.partitionBy(key).orderBy("start")) == 1
    opens = first | ~F.col("body").rlike(r"^\s*(?:단[,，]|다만|※)")
    group = F.sum(F.col("opens").cast("int")).over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("opens", opens).withColumn("group", group)
    units = parts.groupBy(key, "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "body"))).alias("b"))
    units = units.withColumn("body", F.array_join("b.body", ""))
    shown = F.array_compact(F.array(*[F.when(F.col("body").rlike(p), F.lit(i)) for i, p in enumerate(topics)]))
    return units.select(key, "start", "end", shown.alias("topics"), F.sha2(F.trim(F.regexp_replace("body", r"\s+", " ")), 256).alias("signature"))


def _choose(units: Mapping[str, np.ndarray], limit: int, gap: int, most: int) -> list[int]:
    """Positions of the units to keep: those that add topics first, then those with most topics, first, last, in order."""
    topics = [set(t) for t in units["topics"]]
    cost, same = (units["end"] - units["start"] + gap).tolist(), units["signature"].tolist()
    left, covered, seen, chosen = limit - gap, set(), set(), []

    def take(i: int) -> None:
        nonlocal left
        if cost[i] <= left and same[i] not in seen:
            chosen.append(i)
            seen.add(same[i])
            left -= cost[i]

    pending = set(range(len(topics)))
    while any(topics[i] - covered for i in pending):  # at most as often as there are topics
        i = min(pending, key=lambda j: (-len(topics[j] - covered), -len(topics[j]), j))
        pending.remove(i)
        take(i)
        covered |= topics[i]
    for i in sorted(pending, key=lambda j: (-len(topics[j]), j != 0, j != len(topics) - 1, j)):
        if len(chosen) < most:
            take(i)
    return sorted(chosen)


def select_evidence(df: DataFrame, key: str, text: str, limit: int, topics: list[str] = TOPICS, most: int = 64) -> DataFrame:
    """(key, start, end): the parts of each text that fit ``limit`` characters with a mark at each gap; a text that fits stays whole.

    Units are found by expressions; only their offsets, topics and hashes go, a batch of documents at a time, to the choice, in which each
    step depends on those before.  Empty and null texts give no row.  ``key`` is unique.
    """
    size = F.length(F.coalesce(text, F.lit("")))
    whole = df.where((size <= limit) & (size > 0)).select(key, F.lit(0).cast("long").alias("start"), size.cast("long").alias("end"))
    units = evidence_units(df.where(size > limit), key, text, topics).select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "topics", "signature")

    units = units.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "topics", "signature"))).alias("u"))
    units = units.select(key, "u.start", "u.end", "u.topics", "u.signature")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [_choose(dict(zip(batch.columns[1:], u)), limit, len(GAP), most) for u in zip(*[batch[c] for c in batch.columns[1:]])]
            ends = {c: [u[i] for u, chosen in zip(batch[c], kept) for i in chosen] for c in ("start", "end")}
            yield pd.DataFrame({key: batch[key].repeat([len(chosen) for chosen in kept]), **ends})

    return whole.unionByName(units.mapInPandas(choose, whole.schema))
