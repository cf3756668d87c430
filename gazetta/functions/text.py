"""Text columns: normalisation, file names, warnings, placeholders, topic terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the patterns taken from Python, which also take the no-break space.
SPACE = r"[\s ]"
#: Categories of warnings in order, with the words that tell them (fixed values).
WARNINGS = (
    ("TIMEOUT", "timeout|timed out|시간 초과|시간이 초과"),
    ("ENCRYPTED", "암호|encrypted|password protected"),
    ("TOO_LARGE", "크기|too large|size limit"),
    ("CORRUPT", "손상|badzip|corrupt"),
    ("NO_TEXT", "텍스트를 찾지|no text"),
    ("UNSUPPORTED", "지원하지|unsupported"),
)
#: Sentences that only say that something is not known, with where it was sought and what (fixed values).
UNKNOWN = (
    r"(?i)(?:(?:원문|본문|자료|첨부파일)(?:에서|에)?\s*)?"
    r"(?:(?:사업\s*목적|지원\s*대상|신청\s*자격|협력\s*구조|필수\s*파트너)(?:을|를|은|는|이|가)?\s*)?"
    r"(확인하지\s*못했습니다|확인되지\s*않(았습니다|습니다|음)|명시(되어)?\s*있지\s*않(았습니다|습니다|음)|미확인|확인\s*필요|정보\s*없음|미기재|n/?a|unknown)"
)
#: Words too general to be topics, beginnings of such, and endings of particles (fixed values).
GENERIC_TERMS = (
    "공고", "사업", "지원", "지원사업", "프로그램", "과제", "대상", "기업", "기관", "시행", "시행계획", "계획", "신청", "참여", "모집", "선정", "정부", "산업",
    "기술", "개발", "구축", "혁신", "사업화", "연구개발", "중소기업", "중견기업", "연도", "년도", "신규", "하반기", "상반기", "ai", "접수", "안내", "통합", "위한",
    "통한", "수행", "목적", "내용", "확인", "합니다", "용역",
)
GENERIC_PREFIXES = ("공고", "사업", "지원", "프로그램", "과제", "대상", "신청", "참여", "모집", "선정")
PARTICLES = ("에서는", "으로", "에서", "에게", "와", "과", "을", "를", "은", "는", "의")
#: Spellings that are one topic (fixed values).
SYNONYMS = (
    (r"인공\s*지능|artificial\s+intelligence", "ai"), (r"예지\s*보전|예측\s*정비", "예지보전"), (r"결함\s*탐지|불량\s*검출", "결함탐지"),
    (r"스마트\s*팩토리|스마트\s*공장|지능형\s*공장", "스마트공장"), (r"국제\s*공동\s*연구|해외\s*공동\s*연구", "국제공동연구"),
)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` worked out once a row, however often ``f`` reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def worked_out(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, worked out once a row: filters and columns that read them later do not work them out again."""
    one = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__one")
    return df.select("*", one).select(*df.columns, *[f"__one.{name}" for name in columns])


def normalize_text(c: Column) -> Column:
    """Ends cut, every run of white space one blank; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""), r"\s+", " ")


def normalize_file_name(c: Column) -> Column:
    """Up to the extension where the name has one before its end, a bracket or a comma; else without a size at the end."""
    clean = F.trim(F.regexp_replace(c, "[​﻿]", ""))
    named = F.regexp_extract(clean, r"(?i)^(.+?\.[a-z0-9]{1,10})(?=\s*([\[(,]|$))", 1)
    sized = F.regexp_replace(clean, r"(?i)\s*([\[(]\s*)?\d+([.,]\d+)?\s*(bytes?|kb|mb|gb)\s*[\])]?[\s,]*$", "")
    return F.when(named != "", F.trim(named)).otherwise(F.regexp_replace(sized, r"^[ ,]+|[ ,]+$", ""))


def file_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(normalize_file_name(c), r"\.[^.]+$", 0))


def classify_warning(c: Column, of_source: Column) -> Column:
    """A bounded category for a raw error, with the HTTP status where there is one; the raw text goes no further."""
    low = F.lower(F.coalesce(c, F.lit("")))
    status = F.regexp_extract(low, r"(?:http|status)\D{0,10}([45]\d\d)", 1)
    out = F.when(low.rlike(WARNINGS[0][1]), WARNINGS[0][0]).when(status != "", F.concat(F.lit("HTTP_"), status)).when(of_source, "SOURCE")
    for name, words in WARNINGS[1:]:
        out = out.when(low.rlike(words), name)
    return out.otherwise("ATTACHMENT")


def is_unknown(c: Column, pattern: str = UNKNOWN) -> Column:
    """The whole sentence, without closing marks, only says that something is unknown."""
    bare = F.regexp_replace(normalize_text(c), r"[.!?。]+$", "")
    return F.trim(bare).rlike(f"^(?:{pattern})$") if not pattern.startswith("(?i)") else F.trim(bare).rlike(f"(?i)^(?:{pattern[4:]})$")


def sentences(c: Column) -> Column:
    """Sentences and lines of a text that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?。])\s+|\R+"), lambda s: F.trim(s)), lambda s: s != "")


def source_role(name: Column) -> Column:
    """What a file is by its name: a form to fill in, an example, a reference, or the notice."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.rlike("양식|서식|form|template"), "form").when(low.rlike("예시|작성례|sample|example"), "example").when(low.rlike("참고|별첨|reference|appendix"), "reference").otherwise("notice")


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility composition; the one step of the text functions that Spark has no function for."""
    return F.pandas_udf(_nfkc, "string")(c)


def topic_terms(c: Column, organization: Column | None = None, generic=GENERIC_TERMS, prefixes=GENERIC_PREFIXES, particles=PARTICLES, synonyms=SYNONYMS) -> Column:
    """Distinct topic words: without the organisation's name, in one spelling, without particles, numbers and general words.

    Words that come again are left out first, so that the rules read each word of a text once.
    """
    text = F.coalesce(c, F.lit(""))
    if organization is not None:
        text = F.when(F.coalesce(organization, F.lit("")) != "", F.replace(text, organization, F.lit(" "))).otherwise(text)
    text = F.lower(text)
    for pattern, one in synonyms:
        text = F.regexp_replace(text, pattern, one)
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9a-z가-힣]{2,}"), F.lit(0)))
    if particles:
        ending = f"^(.{{2,}}?)(?:{'|'.join(particles)})$"
        words = F.transform(words, lambda w: F.regexp_replace(w, ending, "$1"))
    number = r"^[0-9]+(?:년|년도|차|회)?$"

    def special(w: Column) -> Column:
        ok = (F.length(w) >= 2) & ~w.rlike(number) & ~w.isin(*(generic or ("",)))
        for p in prefixes:
            ok = ok & ~w.startswith(p)
        return ok

    kept = F.filter(words, special)
    return F.array_distinct(kept) if particles else kept
