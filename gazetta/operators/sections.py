"""Evidence of notices cut to rows and sections: group labels carried down, table headers joined to cells, sections chosen under budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import once, worked_out
from .windows import greedy_budget

# Marks before and after a line's text, references, groups, table headers, and general words for tasks.
PREFIX = r"(?:(?:[가나다라마바사아자차카타파하]|\d+)[.)](?!\d)|\(\d+\)|[①-⑳□■○◦●※*ㆍ・•-])\s*"
SUFFIX = r"\s+(?:[가나다라마바사아자차카타파하][.)]|\d+[.)]|[①-⑳□※*])\s*$"
REFERENCE = r"\([^()]*(?:\[참고\s*\d+\]|\d+\s*p\s+[^()]*참조)[^()]*\)|\[참고\s*\d+\]|<\s*별표\s*\d+\s*>"
GROUP = r"(?:스케일업\s*)?[가-힣A-Za-z0-9,]+(?:\s+[0-9,]+억)?\s*트랙|[가-힣A-Za-z0-9]+과제|유형\s*[0-9A-Za-zⅠ-Ⅹ]+|안전환경\s*\((?:일반|고위험업종)\)"
HEADER = (
    r"구분|지원유형|지원한도|주요내용|제출서류|비고|지원규모|자부담|국비|세부지원내용|업종|업종산재보험가입코드|신청조건|기관부담비율|연구개발기관유형"
)
GROUP_LINE, GROUP_CELL = r"(?:트랙|과제|유형|프로그램)$", r"트랙|과제|유형"
PLAIN = r"^[가-힣A-Za-z0-9]++(?: [가-힣A-Za-z0-9]++)*+\z"
TABLE_MARKS = ("[표]", "[/표]")
# Headings of qualification sections and of others, and where sections begin.
QUALIFICATION = r"(?:신청|참여|지원|모집|기업)\s*(?:자격|대상|요건|조건)|선정\s*(?:대상|기준)|자격\s*요건|입찰\s*참가\s*자격"
DIRECT = r"신청\s*자격|입찰\s*참가\s*자격|자격\s*요건"
PREFERENCE = r"우대|가점|가산점|제외\s*대상|신청\s*제외"
IRRELEVANT = (
    r"(?:선정|협약)\s*후|유의\s*사항|문의|주요\s*용어|정의|향후\s*절차|평가\s*(?:절차|내용|방법)|제출\s*서류|신청\s*방법|접수\s*방법|지원\s*내용|"
    r"지원\s*규모|사업\s*목적|입찰\s*보증금|과업\s*수행\s*계획|주요\s*과업|평가\s*항목|성과\s*보고|계약\s*체결\s*후"
)
PRIVATE = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}"
SECTION_MARK = r"^(?:[□■]|[가-하][.)])"
SHORT_MARK = rf"^(?:[0-9]+(?:-[0-9]+)+[.]?|[{PRIVATE}])"
SHORT_HEADING = r"^(?:선정|신청|지원|참여)\s*(?:대상|자격|기준|방법|절차)"
SECTION, PARENT, SCOPE = "[원문 구역]", r"\[상위 구역\]([^\n]*)", r"\[적용 유형\]([^\n]*)"
OTHER_ROLE, ORGANISER, SEPARATE = "[별도 참여 역할] 구매기관", r"(?:주관|운영|수행)\s*기관.{0,30}모집", r"창업기업.{0,45}별도.{0,15}공고"
TARGET, OVERVIEW = r"지원\s*대상.*(?:기업|업력)", ("사업개요", "지원사업개요")
BETWEEN = "\n[다음 원문 구간]\n"
# What each topic's evidence names.
TOPICS = {
    "BUSINESS_FORM": (
        r"전통시장|상점가|상인회|상인연합회|협동조합|소공인|중소기업|소상공인|중견기업|사업자단체|공공기관|민간기관|전문\s*기관|법인|단체|산학연협력기술지주회사|"
        r"신기술창업전문회사|벤처투자회사|창업기획자"
    ),
    "BUSINESS_AGE": r"업력|창업|설립|개업|회사성립|사업자\s*등록|사업\s*개시",
    "REVENUE": r"(?i)매출|수출액|수출실적|수입\s*금액|revenue|sales",
    "IP": r"(?i)특허|patent|인증|지정|기술개발제품",
    "EXPERIENCE": r"계약\s*실적|납품|수행\s*(?:경험|실적|역량)|지원\s*기능|조달\s*역량|실증",
    "CREDIT": r"신용|부채\s*비율|자본\s*잠식",
}


def clean_line(c: Column) -> Column:
    """A line without marks, numbering and references, white space settled; one of plain words stays as it is."""
    return F.when(c.rlike(PLAIN), c).otherwise(_cleaned(c))


def _cleaned(c: Column) -> Column:
    c = F.regexp_replace(c, r"[\x{FFFD}\x{FEFF}]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\(\s*기\s+업\s*\)", "(기업)"), r"\(\s*제\s+품\s*\)", "(제품)")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, REFERENCE, " "), f"^(?:{PREFIX})+", ""), SUFFIX, "")
    c = F.regexp_replace(F.regexp_replace(c, r"[□■○※*①-⑳]|[ㆍ・]{2,}", " "), r"^사항\s*[:：]\s*", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _whole(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def _carry_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the group and headers above them, each text, group and headers of a source once; lines of a source follow each other."""
    source = None
    for batch in batches:
        column = {c: batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("__source", "__first", "text", "firm", "mark", "titles", "from_firm", "from_loose", "stays_firm", "gets_firm", "when_firm", "when_loose")}
        cells, places, labels, above = batch.column("cells"), [], [], []
        for i, (of, first, text, firm, mark, titles, from_firm, from_loose, stays_firm, gets_firm, when_firm, when_loose) in enumerate(zip(*column.values())):
            if of != source:
                source, label, is_firm, headers, seen = of, first, firm, (), set()
            change, row, is_firm = (from_firm, when_firm, stays_firm) if is_firm else (from_loose, when_loose, gets_firm)
            label = label if change is None else change
            if mark:
                headers = ()
            elif titles:  # those of one width below a table mark are one header, joined column by column
                new = cells[i].as_py()
                headers = tuple(c if c == old else f"{old} / {c}" for old, c in zip(headers, new)) if len(headers) == len(new) else tuple(new)
            if row and (text, label, headers) not in seen:
                seen.add((text, label, headers))
                places.append(i)
                labels.append(label)
                above.append(headers)
        rows = batch.take(pa.array(places, pa.int64()))
        kept = [c for c in batch.schema.names if c not in column or c == "text"]
        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], pa.array(labels, pa.string()), pa.array(above, pa.list_(pa.string()))], [*kept, "group_label", "headers"])


def prepare_rows(df: DataFrame, keys: list[str], group: str, text: str) -> DataFrame:
    """(keys, row_no, text, group_label, headers, cells, structure): the lines of each source as condition rows, in order.

    ``df`` has one row for each source.  A label line (a track, task, type or programme) or a table's first cell that names one
    is the group of the rows below it; weaker labels (a leading bracket, words before a colon) are so until a line or cell names
    a track or task.  Rows of column titles are headers of the table's rows below, several in a column joined.  Rows with one
    text, group and headers come once, the first.  ``structure``: text, table_row, or ambiguous_table for lines that run several
    titles together.  Blank lines, and null or empty texts, give no rows.  Each line is read by expressions; what it leaves to
    those below is carried down within its task, as the lines of a source come one after another: nothing is shuffled or sorted.
    """
    sources = df.withColumn("__source", F.monotonically_increasing_id())
    lines = sources.select(*keys, "__source", clean_line(F.coalesce(F.col(group), F.lit(""))).alias("__first"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n+|(?=[□■])")).alias("row_no", "raw"))
    lines = lines.withColumn("raw", F.regexp_replace("raw", "^[ \r]+|[ \r]+$", ""))
    lines = worked_out(lines, {"text": clean_line(F.col("raw"))}).where("text <> ''")
    cells = F.when(F.contains("raw", F.lit("\t")), F.split("raw", "\t")).otherwise(F.split(F.regexp_replace("raw", r"^\|+|\|+$", ""), r"\s*\|\s*"))
    cut = F.contains("raw", F.lit("\t")) | F.contains("raw", F.lit("|"))
    lines = worked_out(lines, {"cells": F.when(cut, F.transform(cells, clean_line)).otherwise(F.array("text"))})
    t, table, mark = F.col("text"), F.size("cells") >= 2, F.col("text").isin(*TABLE_MARKS)
    titles = ~mark & table & F.forall("cells", lambda c: _whole(F.regexp_replace(c, r"[\s()%0-9,.]", ""), HEADER))
    inline = F.when(t.startswith("(") & (F.regexp_extract(t, r"^\(([^()]{1,60})\)\s*(.+)$", 2) != ""), F.regexp_extract(t, r"^\(([^()]{1,60})\)\s*(.+)$", 1))
    before_colon = F.when(t.rlike("[:：]") & (F.regexp_extract(t, r"^([^:：]{1,40})[:：]\s*(.+)$", 2) != ""), F.regexp_extract(t, r"^([^:：]{1,40})[:：]\s*(.+)$", 1))
    weak = F.coalesce(F.when(~inline.isin("기업", "제품"), inline), before_colon)
    plain = ~mark & ~titles
    label = plain & (F.length(t) <= 60) & t.rlike(GROUP_LINE)
    cell = F.when(table & F.get("cells", F.lit(0)).rlike(GROUP_CELL), F.get("cells", F.lit(0)))
    lines = lines.withColumns({"mark": mark, "titles": titles, "plain": plain, "weak": F.when(plain, weak), "label": label, "cell": F.when(plain, cell)})
    # a group that names a track or task is firm: weak labels no longer change it
    firm = lambda c: F.coalesce(_whole(c, GROUP), F.lit(False))
    from_firm = F.when(F.col("label"), F.col("text")).otherwise(F.col("cell"))
    from_loose = F.when(F.col("weak").isNotNull(), F.coalesce("cell", "weak")).when(F.col("label"), F.col("text")).otherwise(F.col("cell"))
    lines = lines.withColumns({"from_firm": from_firm, "from_loose": from_loose})
    stays_firm = F.when(F.col("from_firm").isNull(), True).otherwise(firm(F.col("from_firm")))
    gets_firm = F.when(F.col("from_loose").isNull(), False).otherwise(firm(F.col("from_loose")))
    lone = F.col("label") & F.col("weak").isNull()  # a label line is no row itself; one with a weak label is, where the group is loose
    lines = lines.select(
        *keys, "row_no", "text", "cells", "__source", "__first", firm(F.col("__first")).alias("firm"), "mark", "titles", "from_firm", "from_loose",
        stays_firm.alias("stays_firm"), gets_firm.alias("gets_firm"), (F.col("plain") & ~F.col("label")).alias("when_firm"), (F.col("plain") & ~lone).alias("when_loose"),
    )
    kept = [f for f in lines.schema if f.name in (*keys, "row_no", "text", "cells")]
    out = StructType([*kept, StructField("group_label", StringType()), StructField("headers", ArrayType(StringType()))])
    rows = lines.mapInArrow(_carry_down, out)
    table = F.size("cells") >= 2
    run_on = F.size(F.regexp_extract_all("text", F.lit(f"({HEADER})"), F.lit(1))) >= 3
    structure = F.when(table, "table_row").when(run_on, "ambiguous_table").otherwise("text")
    return rows.select(*keys, "row_no", "text", "group_label", "headers", F.when(table, F.col("cells")).otherwise(F.array().cast("array<string>")).alias("cells"), structure.alias("structure"))


def _heading(group: Column) -> Column:
    last = F.element_at(F.split(group, r"\[원문 구역\]"), -1)
    return F.trim(F.element_at(F.split(F.regexp_replace(last, r"[\r\n]+$", ""), r"\R"), -1))


def _qualifies(line: Column) -> Column:
    """A heading that begins with a qualification and is about nothing else."""
    title = F.regexp_replace(F.regexp_replace(line, rf"^[□■{PRIVATE}]\s*", ""), r"^(?:[가-하][.)]|[0-9]+(?:[-.][0-9]+)*[.)]?)\s*", "")
    title = F.regexp_replace(F.regexp_replace(title, r"^\(?과제별\s*", ""), r"^\(+", "")
    return title.rlike(f"^(?:{QUALIFICATION})") & ~title.rlike(IRRELEVANT)


def _for_others(group: Column, text: Column) -> Column:
    """Sources that are about another party than the applicant."""
    parent = F.regexp_replace(F.regexp_extract(group, PARENT, 1), r"\s+", "")
    return F.contains(group, F.lit(OTHER_ROLE)) | (group.rlike(ORGANISER) & group.rlike(SEPARATE) & parent.isin(*OVERVIEW) & text.rlike(TARGET))


def qualification_sections(df: DataFrame, keys: list[str], group: str, text: str) -> DataFrame:
    """(keys, group_label, excerpt, priority) of sources that bear on qualification: 0 direct, 1 qualification, 2 preference or exclusion, 3 other.

    Of a source with qualification headings inside, outside its tables, only those sections are its excerpt; neighbours stay
    together.  Sources for other parties, of other topics, and blank ones are left out.
    """
    g, x = F.coalesce(F.col(group), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    df = df.select(*keys, g.alias("group_label"), x.alias("__text")).where((F.trim(F.regexp_replace("__text", r"\s+", " ")) != "") & ~_for_others(F.col("group_label"), F.col("__text")))
    # only a text that names a qualification can have a heading of one
    lines = df.where(F.col("__text").rlike(QUALIFICATION)).select(*keys, F.posexplode(F.split("__text", r"(?<=\n)")).alias("line_no", "line")).where("line <> ''")
    value = F.regexp_replace("line", r"^\s+|\s+$", "")
    order = Window.partitionBy(*keys).orderBy("line_no")
    mark = F.when(value.isin(*TABLE_MARKS), value)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)) == TABLE_MARKS[0], F.lit(False))
    starts = (value != "") & ~value.isin(*TABLE_MARKS) & (F.length(value) <= 180)
    starts = starts & (value.rlike(SECTION_MARK) | ((F.length(value) < 60) & (value.rlike(SHORT_MARK) | value.rlike(SHORT_HEADING))))
    lines = lines.withColumn("opens", (starts & ~inside).cast("int"))
    lines = lines.withColumn("section", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = lines.groupBy(*keys, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda p: p.line), "").alias("part"))
    first = F.get(F.split(F.regexp_replace("part", r"^\s+|\s+$", ""), r"\R"), F.lit(0))
    kept = parts.where(_qualifies(first)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("section", "part"))).alias("kept"))
    gap = lambda p, i: F.when((i > 0) & (F.get("kept", F.greatest(i - 1, F.lit(0))).section != p.section - 1), BETWEEN).otherwise("")
    kept = kept.select(*keys, F.array_join(F.transform("kept", lambda p, i: F.concat(gap(p, i), p.part)), "").alias("own"))
    out = df.alias("d").join(kept.alias("k"), [F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys], "left").select("d.*", "k.own")
    heading, title = _heading(F.col("group_label")), F.col("heading")
    parent = F.trim(F.regexp_extract("group_label", PARENT, 1))
    priority = F.when(F.col("own").isNotNull(), 1).when(title.rlike(IRRELEVANT), None).when(_qualifies(title) | _qualifies(parent), 1).when(title.rlike(PREFERENCE), 2).otherwise(3)
    out = worked_out(worked_out(out, {"heading": heading}), {"priority": priority}).where("priority IS NOT NULL")
    out = out.select(*keys, "group_label", F.coalesce("own", "__text").alias("excerpt"), "heading", "priority")
    direct = F.concat("heading", F.lit("\n"), F.get(F.split("excerpt", r"\R"), F.lit(0))).rlike(DIRECT)
    return out.select(*keys, "group_label", "excerpt", F.when((F.col("priority") <= 1) & direct, 0).otherwise(F.col("priority")).alias("priority"))


def select_sections(df: DataFrame, key: str, place: str, group: str, text: str, max_bytes: int = 10_000, max_sources: int = 12, topics: dict[str, str] = TOPICS) -> DataFrame:
    """(key, place, priority, excerpt): of each document's sources those that fit ``max_bytes`` of text and ``max_sources``, by place.

    The topics take turns, each naming its sources in order of ``place`` (a whole number, unique in a document); sources of a
    lower priority come after all of a higher one, and those of priority 3 only where a document has none of 0 and 1.  One that does
    not fit is passed over.  Sources that differ in white space and brackets only, within one scope, count once.  Sources of no topic
    are left out.
    """
    rows = qualification_sections(df, [key, place], group, text).withColumn("size", F.octet_length("excerpt"))
    about = F.concat(F.element_at(F.split("group_label", r"\[원문 구역\]"), -1), F.lit("\n"), F.col("excerpt"))
    named = once(about, lambda a: F.array_compact(F.array(*[F.when(a.rlike(p), F.lit(i)) for i, p in enumerate(topics.values())])))
    rows = worked_out(rows.where(F.col("size") <= max_bytes), {"named": named}).where(F.size("named") > 0)
    same = F.sha2(F.regexp_replace("excerpt", r"\s+|[｢｣「」『』]", ""), 256)
    variant = F.row_number().over(Window.partitionBy(key, same, F.trim(F.regexp_extract("group_label", SCOPE, 1))).orderBy(place))
    rows = rows.withColumn("__variant", variant).where("__variant = 1")
    best = F.min("priority").over(Window.partitionBy(key))
    rows = rows.withColumn("__best", best).where(F.when(F.col("__best") <= 1, F.col("priority") <= 2).otherwise(F.col("priority") >= 2))
    # whose turn comes first: one source may be named by several topics
    queue = rows.select(key, place, "priority", "size", F.explode("named").alias("topic"))
    queue = queue.withColumn("turn", F.row_number().over(Window.partitionBy(key, "priority", "topic").orderBy(place)))
    queue = queue.groupBy(key, place, "priority", "size").agg(F.min(F.struct("turn", "topic")).alias("t")).select(key, place, "priority", "size", "t.turn", "t.topic")
    chosen = greedy_budget(queue, key, ["priority", "turn", "topic"], "size", max_bytes, max_sources).select(key, place)
    return rows.join(chosen, [key, place]).select(key, place, "priority", "excerpt")
