"""Responsible organisations of notices: roles with the names beside, below or after them, in lines and in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import once

# Roles, those of contacts among them, endings and exceptions of names, and what is no notice.
ROLES = (
    "주관기관", "주최기관", "총괄기관", "총괄부처", "소관부처", "시행기관", "전담기관", "운영기관", "관리기관", "전문기관", "주관", "주최", "접수처", "문의처",
)
CONTACT_ROLES = ("문의처", "접수처")
ENDINGS = (
    "공단|재단|협회|진흥원|진흥회|연구원|연구소|센터|대학교|대학|공사|기술원|개발원|평가원|지원단|사업단|사무국|조합|상공회의소|테크노파크|위원회|청|부|원|시|도"
)
NAME = rf"^((?:\([재사]\)\h*)?[가-힣A-Za-z][가-힣A-Za-z0-9·ㆍ‧∙&.\-\h]{{1,78}}?(?:{ENDINGS}))(?=$|[\h,;/|()])"
PLACEHOLDER = r"(?i)예시|견본|가칭|미정|추후|모집|선정|기재|작성|입력|해당|각\s*기관|전문기업|중소기업$|(?:^|[가-힣])(?:OO|XX)|[○□ㅇ]{2}"
NOT_SETTLED = r"예시|견본|가칭|예정|미정|추후"
NON_NAME_PREFIX = r"^(?:및|또는|와|과)(?=$|\h)|^(?:(?:주관|공동|참여|국내|국외)\h*)?(?:연구개발기관|연구기관)(?=$|\h)"
GENERIC_NAME = (
    r"^(?:(?:참여|책임|공동|소속|담당|실습|학생|신규|선임|수석)?연구원|연구책임자|담당자|직원|"
    r"(?:국내|국외|공공|민간|영리|비영리)?(?:연구기관|연구소|기업부설연구소|대학|대학교|의료기관|사무국|기업))$"
)
DOCUMENT_AFTER_NAME = r"^\h*(?:인정서|확인서|증명서|재직증명서|등록증|신청서|동의서|서약서|계획서|보고서)(?=$|[\h,;/|()])"
NAME_SEPARATOR = r"^(?:[,/;]\h*|및\h+)"
OTHER_CONTEXT = r"전년도|지난해|타\h*사업|다른\h*사업|참고\h*사업|작성\h*예시|예\h*[:：]"
FORM_HEADING = r"^[\h\[<(【]*(?:붙임|별첨|별지|서식)\h*(?:제\h*)?\d|^[\h\[<(【]*(?:(?:사업|연구개발)계획서|신청서|공적조서|동의서)"
EXAMPLE_HEADING = r"^.{0,12}(?:작성\h*예시|작성\h*예제|작성\h*견본)"
NON_NOTICE_FILE = r"(?i)예시|견본|FAQ|참고자료|신청서|계획서|동의서|서식|양식|협약서|확인서|증명서|인정서|서약서"
NOTICE_FILE = r"공고|모집|안내"
MEMBER = r"(?m)^\[파일: ([^\r\n]+)]\h*$"
BULLETS = r"[\h|□◦○ㅇ▪▫※*·•∙⦁■▶◈-]*"
TABLE_OPEN, TABLE_CLOSE = "[표]", "[/표]"
#: Names of one role (a fixed value), and how wide a table may be.
MOST_NAMES, WIDEST = 8, 256


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def names(value: Column, roles: tuple[str, ...] = ROLES) -> Column:
    """The organisations that a value begins with, joined by commas, semicolons, slashes or an and; what follows them is no name.

    A name has one of the usual endings; placeholders, generic words, and names of documents end the list.
    """
    words = "|".join(r"\h*".join(r) for r in roles)
    stop = rf"^(?:{words})(?=$|\h|[:：|])|{NON_NAME_PREFIX}"
    value = F.when(value.startswith("(") & ~value.rlike(r"^\([재사]\)"), _strip(F.substring(value, F.lit(2), F.length(value)))).otherwise(value)
    settled = (F.length(value) <= 500) & ~value.rlike(OTHER_CONTEXT) & ~value.rlike(NOT_SETTLED)

    def step(state: Column, _: Column) -> Column:
        found = F.regexp_extract(state.rest, NAME, 1)
        tail = F.substring(state.rest, F.length(found) + 1, F.length(state.rest))
        tight = F.regexp_replace(found, r"\h", "")
        good = (found != "") & ~state.rest.rlike(stop) & ~found.rlike(PLACEHOLDER) & ~tight.rlike(GENERIC_NAME) & ~tail.rlike(DOCUMENT_AFTER_NAME)
        after = F.regexp_replace(_strip(tail), NAME_SEPARATOR, "")
        rest = F.when(good & _strip(tail).rlike(NAME_SEPARATOR), _strip(after)).otherwise("")
        name = _strip(F.regexp_replace(found, r"\h+", " "))
        return F.struct(rest.alias("rest"), F.when(good, F.concat(state.names, F.array(name))).otherwise(state.names).alias("names"))

    begin = lambda v: F.struct(v.alias("rest"), F.array().cast("array<string>").alias("names"))
    turns = F.sequence(F.lit(1), F.lit(MOST_NAMES))
    return F.when(settled, once(value, lambda v: F.aggregate(turns, begin(v), step, lambda s: s.names))).otherwise(F.array().cast("array<string>"))


def _members(df: DataFrame, keys: list[str], text: str, file: str | None) -> DataFrame:
    """(keys, member, lines): texts and members of archives that are notices, each with lines of its own."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\u00a0", " "), "\u200b", "")
    notice = lambda c: ~c.rlike(NON_NOTICE_FILE) | c.rlike(NOTICE_FILE)
    rows = df if file is None else df.where(F.col(file).isNull() | notice(F.col(file)))
    parts = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(t, F.lit(MEMBER), F.lit(1))).alias("name"), F.split(t, MEMBER).alias("text"))
    rows = rows.select(*keys, F.size(parts).alias("__parts"), F.posexplode(parts).alias("member", "p"))
    # what stands before the first member of an archive belongs to none
    rows = rows.where((F.col("__parts") == 1) | (F.col("p.name").isNotNull() & notice(F.col("p.name"))))
    return rows.select(*keys, "member", F.posexplode(F.split("p.text", r"\R+")).alias("line_no", "line"))


def organizations(df: DataFrame, key: str, text: str, file: str | None = None, order: str | None = None, roles: tuple[str, ...] = ROLES, contact: tuple[str, ...] = CONTACT_ROLES) -> DataFrame:
    """(key, role, name, line_no): role and name pairs of a notice, the first of each role and name in order of its sources.

    A notice may have several rows: its text (``file`` null) and its attachments, in ``order``.  Forms, examples and references are
    left out by file name, archives member by member; within a text, from the heading of a form on only contacts are read, from
    that of an example on nothing.  A role's names stand after it, on the next line where none follow, or in a whole table in
    the next other cell to the right, else in the same column of the row below; a table that is not closed ends its text, one with ragged
    rows is passed over.  An organisation that has another role is not listed as a contact too.  Null and empty texts give no rows.
    """
    keys = [key] if order is None else [key, order]
    lines = _members(df, keys, text, file).withColumn("bare", _strip(F.col("line")))
    own = [*keys, "member"]
    by_line = Window.partitionBy(*own).orderBy("line_no")
    upto = by_line.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("table_no", F.sum((F.col("bare") == TABLE_OPEN).cast("int")).over(upto))
    table = Window.partitionBy(*own, "table_no")
    close = F.min(F.when((F.col("bare") == TABLE_CLOSE) & (F.col("table_no") > 0), F.col("line_no"))).over(table)
    lines = lines.withColumns({"close": close, "cells": F.transform(F.split("line", "\t"), _strip)})
    lines = lines.withColumn("open", (F.col("table_no") > 0) & F.col("close").isNull())
    cut = F.min(F.when(F.col("open"), F.col("line_no"))).over(Window.partitionBy(*own))
    mark = (F.col("bare") == TABLE_OPEN) | (F.col("line_no") == F.col("close"))
    lines = lines.withColumns({"cut": cut, "inside": (F.col("table_no") > 0) & (F.col("line_no") < F.col("close")) & ~mark, "mark": F.coalesce(mark, F.lit(False))})
    lines = lines.where(F.col("cut").isNull() | (F.col("line_no") < F.col("cut"))).withColumn("inside", F.coalesce("inside", F.lit(False)))
    width = F.when(F.col("inside"), F.size("cells"))
    whole = (F.min(width).over(table) == F.max(width).over(table)) & F.min(width).over(table).between(2, WIDEST)
    lines = lines.withColumns({"whole": F.coalesce(whole, F.lit(False)), "next": F.lead("bare").over(by_line), "below": F.lead("cells").over(by_line), "next_no": F.lead("line_no").over(by_line)})
    lines = lines.where(~F.col("mark") & (~F.col("inside") | F.col("whole")))
    lines = lines.withColumn("below", F.when(F.col("next_no") < F.col("close"), F.col("below")))
    heads = lambda pattern: F.max(F.exists("cells", lambda c: c.rlike(pattern)).cast("int")).over(upto) == 1
    lines = lines.withColumns({"form": heads(FORM_HEADING), "example": heads(EXAMPLE_HEADING)}).where(~F.col("example") & ~F.col("bare").rlike(OTHER_CONTEXT))

    words = "|".join(r"\h*".join(r) for r in roles)
    label = rf"^{BULLETS}(?:\(|\[)?\h*({words})(?![가-힣A-Za-z])\h*([)\]:：|]|\(|$|\h)(.*)$"
    role = lambda c: F.regexp_replace(F.regexp_extract(c, label, 1), r"\h", "")
    value = lambda c: _strip(F.regexp_replace(F.regexp_extract(c, label, 3), r"^[\h:：|]+", ""))
    # where a role's names may stand, in order; the first that has names counts
    said = lines.where(~F.col("inside") & F.col("bare").rlike(label)).withColumn("value", value(F.col("bare")))
    said = said.select(*own, "line_no", F.lit(0).alias("col"), "form", role(F.col("bare")).alias("role"), F.array(F.when(F.col("value") != "", F.col("value")).otherwise(F.col("next"))).alias("places"))
    rows = lines.where(F.col("inside") & F.exists("cells", lambda c: c.rlike(label))).select(*own, "line_no", "form", "cells", "below", F.posexplode("cells").alias("col", "cell"))
    repeated = (F.col("col") > 0) & (F.col("cell") == F.get("cells", F.greatest(F.col("col") - 1, F.lit(0))))
    rows = rows.where(F.col("cell").rlike(label) & ~repeated).withColumn("value", value(F.col("cell")))
    right = F.get(F.filter(F.slice("cells", F.col("col") + 2, F.size("cells")), lambda c: (c != "") & (c != F.col("cell"))), F.lit(0))
    under = F.when(F.size("below") == F.size("cells"), F.get("below", F.col("col")))
    places = F.when(F.col("value") != "", F.array("value")).otherwise(F.array(right, under))
    rows = rows.select(*own, "line_no", "col", "form", role(F.col("cell")).alias("role"), places.alias("places"))
    pairs = said.unionByName(rows).where(~F.col("form") | F.col("role").isin(*contact))
    told = F.filter(F.transform(F.array_compact("places"), lambda v: names(v, roles)), lambda n: F.size(n) > 0)
    pairs = pairs.withColumn("names", F.get(told, F.lit(0)))
    pairs = pairs.select(*own, "line_no", "col", "role", F.posexplode("names").alias("i", "name"))
    pairs = pairs.withColumn("same", F.lower(F.regexp_replace("name", r"[\h·ㆍ‧∙]", "")))
    place = F.struct(*([order] if order else []), "member", "line_no", "col", "i", "name")
    first = pairs.groupBy(key, "role", "same").agg(F.min(place).alias("f"))
    is_contact = F.col("role").isin(*contact)
    operating = first.where(~is_contact).select(key, "same").distinct()
    out = first.where(~is_contact).unionByName(first.where(is_contact).join(operating, [key, "same"], "left_anti").select(first.columns))
    return out.select(key, "role", F.col("f.name").alias("name"), F.col("f.line_no").alias("line_no"))
