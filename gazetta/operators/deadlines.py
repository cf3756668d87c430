"""Application deadlines of texts: each label reaches to the next label or date of another role, and a range counts by its end.

All of a text's tokens are found and cut in its own row, so a corpus of any size is read once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once

# How dates, parts of dates, ranges, labels, other roles and open ends are written.
DATE = r"(?<!\d)(20\d{2})\s*(?:[-./]|년)\s*(\d{1,2})\s*(?:[-./]|월)\s*(\d{1,2})(?!\d)(?:\s*일|\.)?"
PARTIAL_DATE = r"(?<!\d)(?:\d{1,2}\s*월\s*\d{1,2}\s*일|\d{1,2}[-./]\d{1,2})(?![\d%])"
SHORT_DATE = r"^(\d{1,2})\s*(?:월|[-./])\s*(\d{1,2})(?!\d)(?:\s*일|\.)?"
RANGE = r"(?i)[~∼～–—-]|부터|\bto\b"
DATE_SUFFIX = r"^\s*(?:\([^()\n]*\))?(?:[T\s]+(?:오전|오후)?\s*\d{1,2}(?::\d{2}|시(?:\s*\d{1,2}\s*분)?))?\s*"
DEADLINE_LABEL = r"(?:(?:신청(?:서)?|접수|제출)\s*(?:마감(?:일시?|시각)?|종료일|기한|기간)|마감(?:일시?|시각))\s*(?:[은는이가]\s*)?[:：]?\s*(?=[~∼～]?\s*20\d{2})"
OTHER_ROLE = (
    r"(?:(?:분석|공고|게시|작성|기준|발표|평가|심사|행사)(?:일시?|날짜|기간|시각)|(?:분석|공고|게시|작성|발표|평가|심사|행사)\s*기준|"
    r"(?:사업|신청|접수|제출)\s*(?:시작|종료|개시)(?:일시?|날짜|시각)?|사업\s*기간)"
)
OTHER_LABEL = r"(?:평가|발표|심사|행사|공고|게시|작성|사업)\s*$"
OPEN_END = r"시작|개시|이후|미정|미확정|상시|예산\s*소진|별도\s*공지"


def _hits(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, token>> of a pattern's matches, in characters from 0, end exclusive."""
    pieces = F.arrays_zip(F.split(text, pattern).alias("gap"), _hits(text, pattern).alias("hit"))
    empty = F.array().cast("array<struct<start:int,end:int,token:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def add(state: Column, piece: Column) -> Column:
        begins = state.at + F.length(piece.gap)
        ends = begins + F.length(F.coalesce(piece.hit, F.lit("")))
        one = F.struct(begins.alias("start"), ends.alias("end"), piece.hit.alias("token"))
        return F.struct(ends.alias("at"), F.when(piece.hit.isNull(), state.found).otherwise(F.concat(state.found, F.array(one))).alias("found"))

    return F.aggregate(pieces, start, add, lambda s: s.found)


def _dates(text: Column) -> Column:
    """The calendar dates written in a text, null where a day does not exist."""
    parts = F.arrays_zip(*[_hits(text, DATE, g).alias(f"g{g}") for g in (1, 2, 3)])
    return F.transform(parts, lambda p: F.try_to_date(F.concat_ws("-", p.g1, F.lpad(p.g2, 2, "0"), F.lpad(p.g3, 2, "0")), "yyyy-MM-dd"))


def has_calendar_date(text: Column) -> Column:
    """A year, or a month and a day, stands in the text."""
    return text.rlike(r"20\d{2}") | text.rlike(PARTIAL_DATE)


def end_date(text: Column) -> Column:
    """The one date of a text, or the end of its one range; null where dates are open, more, reversed or not of the calendar."""

    def read(s: Column) -> Column:
        first, second = F.get(s.dates, F.lit(0)), F.get(s.dates, F.lit(1))
        before, between, after = (F.get(s.gaps, F.lit(i)) for i in range(3))
        one = F.when(~(between.rlike(RANGE) | F.contains(before, F.lit("부터")) | s.text.rlike(OPEN_END)), first)
        bridge = F.regexp_replace(F.regexp_replace(between, DATE_SUFFIX, ""), r"^\s+|\s+$", "")
        two = F.when(bridge.rlike(f"(?i)^(?:{RANGE[4:]})$") & ~after.rlike(RANGE) & (second >= first), second)
        known = F.forall(s.dates, lambda d: d.isNotNull()) & ~has_calendar_date(F.array_join(s.gaps, ""))
        return F.when((F.size(s.dates) == 1) & known, one).when((F.size(s.dates) == 2) & known, two)

    return once(text, lambda t: once(F.struct(t.alias("text"), _dates(t).alias("dates"), F.split(t, DATE).alias("gaps")), read))


def application_deadline(text: Column, require_label: bool = False) -> Column:
    """The closing date that a text states; null where it has none, several, or one that is not complete.

    A label's date stands between it and the next label or date of another role.  All labels must agree.  Without a label the
    whole text is read as a deadline field, unless it names another role or ``require_label`` is set.  Null and empty texts have none.
    """
    roles = rf"{DATE}\s*{OTHER_ROLE}|{OTHER_ROLE}\s*(?:[은는이가]\s*)?[:：]?\s*(?={DATE})"

    def read(s: Column) -> Column:
        edges = F.concat(F.transform(s.labels, lambda x: x.start), F.transform(places(s.text, roles), lambda x: x.start))
        foreign = F.exists(s.labels, lambda x: x.token.startswith("마감") & F.substring(s.text, F.lit(1), x.start).rlike(OTHER_LABEL))

        def value(edges: Column, label: Column) -> Column:
            until = F.coalesce(F.array_min(F.filter(edges, lambda e: e >= label.end)), F.length(s.text))
            return end_date(F.substring(s.text, label.end + 1, until - label.end))

        values = once(edges, lambda e: F.transform(s.labels, lambda x: value(e, x)))
        agreed = lambda v: F.when(F.forall(v, lambda d: d.isNotNull()) & (F.size(F.array_distinct(v)) == 1), F.get(v, F.lit(0)))
        bare = F.lit(None).cast("date") if require_label else F.when(~s.text.rlike(OTHER_ROLE), end_date(s.text))
        return F.when(F.size(s.labels) == 0, bare).when(foreign, None).otherwise(once(values, agreed))

    return once(F.coalesce(text, F.lit("")), lambda t: once(F.struct(t.alias("text"), places(t, DEADLINE_LABEL).alias("labels")), read))


def resolve_deadline(field: Column, reason: Column) -> Column:
    """The deadline of a field, else the labelled one of the reason given with it.

    A reason completes a range whose end has no year, if month and day agree; it never decides between full dates of the field.
    """

    def infer(s: Column) -> Column:
        rest = F.regexp_replace(F.get(F.split(s.field, DATE), F.lit(1)), DATE_SUFFIX, "")
        short = F.regexp_replace(F.regexp_replace(rest, rf"(?i)^(?:{RANGE[4:]})", ""), r"^\s+", "")
        month, day = (F.regexp_extract(short, SHORT_DATE, g).try_cast("int") for g in (1, 2))
        completes = (
            (F.size(s.dates) == 1) & ~s.field.rlike(OTHER_ROLE) & ~s.field.rlike(OPEN_END) & (s.inferred >= F.get(s.dates, F.lit(0)))
            & rest.rlike(f"(?i)^(?:{RANGE[4:]})") & (F.month(s.inferred) == month) & (F.dayofmonth(s.inferred) == day)
            & ~has_calendar_date(F.regexp_replace(short, SHORT_DATE, ""))
        )
        return F.when(s.inferred.isNotNull() & (~has_calendar_date(s.field) | completes), s.inferred)

    def read(field: Column) -> Column:
        inferred = application_deadline(reason, require_label=True).alias("inferred")
        return F.coalesce(application_deadline(field), once(F.struct(field.alias("field"), _dates(field).alias("dates"), inferred), infer))

    return once(F.coalesce(field, F.lit("")), read)


def deadlines(df: DataFrame, key: str, field: str, reason: str | None = None) -> DataFrame:
    """(key, deadline) for every row, the deadline null where it is not certain."""
    value = application_deadline(F.col(field)) if reason is None else resolve_deadline(F.col(field), F.col(reason))
    return df.select(key, value.alias("deadline"))
