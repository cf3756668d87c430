"""Rows of submission lists, from table blocks of whole corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import once, worked_out
from ..sources.stages import staged
from .texts import compact, tokens

#: Headers of the column that names documents, of other columns, cells that mark a level, and endings of document names (fixed values).
NAME_HEADER = r"^(?:서류명|(?:제출|신청|접수|구비)(?:서류|자료)(?:목록|명)?)$"
MARK_HEADERS = ("구분", "필수여부", "제출여부", "제출구분", "필수선택")
STAGE_HEADERS = ("제출시기", "제출단계", "시기")
CONDITION_HEADERS = ("제출대상", "대상", "제출조건", "조건")
MARK_CELL = r"^(?:필수(?:\s*제출)?|해당\s*시(?:\s*제출)?|선택(?:\s*제출)?)$"
DOCUMENT_CELL = r"(?:계획서|신청서|확인서|증명서|동의서|증빙자료|발표자료|공문)(?:\s*\([^)]*\))?$"
CONDITION_CELL = r"해당|경우|한함|한하여|한해|면제|생략|미제출|대체|대신|택\s*1"
#: What a table must not stand under, and what it must stand under unless its header says so itself (fixed values).
REFERENCE_BEFORE = r"작성\s*예시|작성\s*견본|첨부\s*목록|양식\s*목록|참고\s*자료"
LIST_BEFORE = r"(?:신청|제출|구비)\s*(?:서류|자료)"
#: Levels by what the tight text of a row shows, the first that fits (fixed values); rows of the first kind are dropped.
NOT_ASKED = r"제출불필요|제출하지|미제출|제출면제|제출생략|해당없음|선택불가|예시|참고용"
OPTIONAL = r"선택"
CONDITIONAL = r"해당시|해당자|해당기업|해당기관|최초참여|변경시|한하여|한해|한함|택1|택일|중1|중하나"
PACKAGING = r"(?:\d+개이상(?:의)?(?:기업|기관)이참여하는경우|(?:기업|기관)이\d+개이상인경우|복수(?:의)?(?:기업|기관)이참여하는경우)(?:zip|압축)파일로제출"
UNCLEAR = r"경우|대상만|기관만|기업만|필요시"
#: Stages by their cues, of which the last in the context counts (fixed values).
STAGES = {
    "APPLICATION": r"(?:신청|접수)\s*서류", "AGREEMENT": r"(?:협약|계약)\s*(?:시|단계|체결|서류)",
    "POST_SELECTION": r"선정\s*(?:후|이후)", "REPORTING": r"(?:운영|사업|실습)\s*(?:종료|완료)\s*후",
}
STAGE_UNCLEAR = r"협약|선정|평가|수행|운영"
#: Characters before a table that are its context, and rows among which its header stands (fixed values).
_BEFORE, _HEADER_ROWS = 600, 5
_TABLE = r"(?s)\[표\].*?\[/표\]"


def requirement_level(quote: Column) -> Column:
    """MANDATORY, CONDITIONAL or OPTIONAL; null where the row asks for nothing or its condition is not clear."""
    return once(compact(quote), lambda tight: _requirement_level(quote, tight))


def _requirement_level(quote: Column, tight: Column) -> Column:
    long = F.length(F.trim(F.regexp_replace(quote, r"\s+", " "))) > 200
    out = F.when(tight.rlike(NOT_ASKED), F.lit(None).cast("string")).when(tight.rlike(OPTIONAL), "OPTIONAL")
    out = out.when(tight.rlike(CONDITIONAL), F.when(~long, "CONDITIONAL"))
    return out.when(F.regexp_replace(tight, PACKAGING, "").rlike(UNCLEAR), F.lit(None)).otherwise("MANDATORY")


def requirement_stage(context: Column) -> Column:
    """The stage whose cue comes last; without one the application, or null where the context is of something else."""
    found = []
    for stage, cue in STAGES.items():
        # up to the last cue, so the longer the nearer
        upto = F.length(F.regexp_extract(context, rf"(?s)^(.*)(?:{cue})", 1))
        found.append(F.when(context.rlike(cue), F.struct(upto.alias("at"), F.lit(stage).alias("stage"))))
    last = F.sort_array(F.array_compact(F.array(*found)), asc=False)
    return F.when(F.size(last) > 0, F.get(last, F.lit(0)).stage).when(context.rlike(STAGE_UNCLEAR), F.lit(None)).otherwise("APPLICATION")


def submission_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, row_no, title, quote, level, stage, marker, condition) of the rows of submission lists.

    A list is a whole table of which one of the first five rows heads, with two headers or more, a column of document names: the
    one column so headed that has the most names below it.  It must stand under words of a submission, or its header say so,
    under none of an example, and have no footnote right below.  Empty cells are never filled.  Every step keeps to one table's
    rows, found by document and table.  The whole tables are
    written down once, as several steps read them.
    """
    at = tokens(df, key, text, {"table": _TABLE}).withColumn("table_no", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1)
    at = at.join(df.select(key, F.col(text).alias("__text")), key)
    start, end = F.col("start").cast("int"), F.col("end").cast("int")
    context = F.substring("__text", F.greatest(start - _BEFORE, F.lit(0)) + 1, F.least(start, F.lit(_BEFORE)))
    after = F.substring("__text", end + 1, F.lit(40))
    inner = F.regexp_extract("token", r"(?s)^\[표\]\s*(.*?)\s*\[/표\]$", 1)
    rows = F.filter(F.transform(F.split(inner, r"\R"), lambda r: F.transform(F.split(r, "\t"), lambda c: F.trim(c))), lambda r: F.array_join(r, "") != "")
    t = worked_out(at, {"context": context, "after": after, "rows": rows}).select(key, "table_no", "context", "after", "rows")
    width = F.size(F.get("rows", F.lit(0)))
    t = t.where((F.size("rows") > 0) & (width >= 2) & F.forall("rows", lambda r: F.size(r) == width))
    t = staged(t.where(~F.col("context").rlike(REFERENCE_BEFORE) & ~F.col("after").rlike(r"^\s*[*※]")))

    on = [key, "table_no"]
    each = t.select(*on, F.posexplode("rows").alias("row_no", "cells"))
    cells = each.select(*on, "row_no", F.posexplode("cells").alias("col", "cell"))
    tight = F.regexp_replace("cell", r"\s+", "")
    heads = each.where(F.col("row_no") < _HEADER_ROWS)
    names = F.array_distinct(F.filter(F.transform("cells", lambda c: F.regexp_replace(c, r"\s+", "")), lambda c: c != ""))
    heads = heads.where(F.size(names) >= 2).select(*on, F.col("row_no").alias("head"), F.posexplode("cells").alias("col", "cell"))
    heads = heads.where(tight.rlike(NAME_HEADER)).select(*on, "head", "col")
    below = cells.where(F.col("cell").rlike(DOCUMENT_CELL)).select(*on, "row_no", "col")
    counted = heads.join(below, [*on, "col"]).where("row_no > head").groupBy(*on, "head", "col").agg(F.count("*").alias("n"))
    best = counted.groupBy(*on, "head").agg(F.max(F.struct("n", "col")).alias("best"), F.sort_array(F.collect_list("n"), asc=False).alias("all"))
    best = best.where((F.size("all") == 1) | (F.get("all", F.lit(0)) > F.get("all", F.lit(1))))  # headers are few: a table's columns
    best = best.groupBy(*on).agg(F.min(F.struct("head", F.col("best.col").alias("name_col"))).alias("b")).select(*on, "b.head", "b.name_col")
    t = t.join(best, on)
    header = F.transform(F.get("rows", F.col("head")), lambda c: F.regexp_replace(c, r"\s+", ""))
    t = t.withColumn("header", header)
    t = t.where(F.get("header", F.col("name_col")).startswith("제출") | F.col("context").rlike(LIST_BEFORE))
    above = F.array_join(F.transform(F.slice("rows", 1, F.col("head")), lambda r: F.array_join(r, "\t")), "\n")
    t = t.withColumn("context", F.concat("context", F.lit("\n"), above))
    body = t.select(*on, "context", "header", "name_col", "head", F.posexplode("rows").alias("row_no", "cells")).where("row_no > head")

    pairs = F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("c"))
    marks = lambda p: p.h.isin(*MARK_HEADERS) | (p.h.rlike(NAME_HEADER) & p.c.rlike(MARK_CELL))
    strong = F.element_at(F.filter(pairs, marks), -1).c
    weak = F.get(F.filter("cells", lambda c: c.rlike(MARK_CELL)), F.lit(0))
    when = F.element_at(F.filter(pairs, lambda p: p.h.isin(*STAGE_HEADERS) & (p.c != "")), -1).c
    own = lambda p: (p.h.isin(*CONDITION_HEADERS) & (p.c != "")) | (p.c.rlike(CONDITION_CELL) & ~marks(p) & ~(p.h.isin(*STAGE_HEADERS) & (p.c != "")))
    quote = F.array_join("cells", "\t")
    sized = body.withColumns({
        "marker": F.coalesce(F.when(F.size(F.filter(pairs, marks)) > 0, F.when(strong != "", strong)), weak, F.lit("")),
        "condition": F.array_join(F.transform(F.filter(pairs, own), lambda p: p.c), " / "),
        "quote": quote, "title": F.get("cells", F.col("name_col")), "own_context": F.when(F.size(F.filter(pairs, lambda p: p.h.isin(*STAGE_HEADERS) & (p.c != ""))) > 0, when),
    })
    level, stage = requirement_level(F.col("quote")), requirement_stage(F.coalesce("own_context", "context"))
    out = worked_out(sized.where("title <> ''"), {"level": level, "stage": stage})
    return out.where("level IS NOT NULL").select(*on, "row_no", "title", "quote", "level", "stage", "marker", "condition")
