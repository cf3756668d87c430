"""Amounts of texts as typed quantities: value, unit, comparator, scope, frequency and payer.

What qualifies an amount stands before it, back to the last quantity or the last sum of money, or after it, up to the next
quantity.  Equal texts are read once; each is cut at its quantities in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import by_text

# How quantities, scales, comparators, scopes, payers and frequencies are written.
QUANTITY = r"(\d+(?:[.,]\d+)*)\s*(천만|백만|억|만|천)?\s*(개월|년|원|%|개|명)"
SCALES = {"": 1, "천": 1_000, "만": 10_000, "백만": 1_000_000, "천만": 10_000_000, "억": 100_000_000}
BOUNDS = {"이내": "<=", "이하": "<=", "최대": "<=", "이상": ">=", "최소": ">=", "미만": "<", "초과": ">", "내외": "~", "정도": "~", "약": "~", "대략": "~"}
SCOPES = {
    "project": r"과제(?:당|별)|각\s*과제",
    "company": r"(?:기업|업체)(?:당|별)",
    "total": r"신규\s*예산|(?:총|전체)\s*(?:신규\s*)?(?:예산|사업비|지원금)|사업\s*전체",
    "contract": r"계약\s*(?:예산|금액|규모)|추정\s*(?:가격|금액)|기초\s*금액",
}
OWN, STATE = r"자부담|(?:기관|민간)\s*부담|기관[이는]", r"정부(?:\s*(?:지원|출연)|[가는])|지원\s*비율"
OWN_AFTER = r"기관[이는].{0,12}부담|(?:기관|민간)\s*부담(?:금|액)?(?:입니다|이다|함|$)"
STATE_AFTER = r"정부[가는].{0,12}지원|정부\s*지원(?:금|액)?(?:입니다|이다|함|$)"
ANNUAL, ANNUAL_BEFORE = r"연간|매년", r"연간|매년|(?:^|\s)연(?=\s|최대|최소)"
FREQUENCIES = {"monthly": r"매월|월간|월\s*(?:최대|최소)?\s*$", "daily": r"매일|일간|일\s*(?:최대|최소)?\s*$"}
IN_TOTAL = r"총\s*(?:지원금|지원액)?\s*$"
TOTAL_SUM = r"총\s*(?:(?:정부)?(?:지원|출연)(?:연구개발비|금|비|액)?|사업비|예산|연구비|연구개발비)?\s*(?:은|는|이|가|:)?\s*(?:약|대략|최대|최소)?\s*$"


def _named(table: dict, c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def _last(text: Column, *patterns: str) -> Column:
    """The last match of any of the patterns; null where there is none."""
    hits = F.regexp_extract_all(text, F.lit("|".join(f"(?:{p})" for p in patterns)), F.lit(0))
    return F.get(hits, F.size(hits) - 1)


def _payer(before: Column, after: Column | None) -> Column:
    """own or state: who is named last before a value, else first in the clause after it."""
    last = _last(before, OWN, STATE)
    out = F.when(last.rlike(f"^(?:{OWN})$"), "own").when(last.isNotNull(), "state")
    if after is None:
        return F.coalesce(out, F.lit(""))
    clause = F.get(F.split(after, "[,.;]"), F.lit(0))
    first = F.regexp_extract(clause, f"(?:{OWN_AFTER})|(?:{STATE_AFTER})", 0)
    return F.coalesce(out, F.when(first.rlike(f"^(?:{OWN_AFTER})"), "own").when(first != "", "state"), F.lit(""))


def money_facts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, value, unit, comparator, scope, frequency, payer): one row for each quantity of a text, in order.

    Units are won, months, years, percent, pieces and persons.  Scope, frequency and payer are empty where nothing names them;
    scope and frequency are those of sums of money only.  A number with several points has no value.  Null and empty texts give no rows.
    """
    facts = by_text(df, [key], [text], lambda once: _money_facts(once, "__same", text))
    return facts.select(key, "n", "value", "unit", "comparator", "scope", "frequency", "payer")


def _money_facts(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    group = lambda g: F.regexp_extract_all(t, F.lit(QUANTITY), F.lit(g))
    pieces = F.arrays_zip(group(0).alias("hit"), group(1).alias("number"), group(2).alias("scale"), group(3).alias("unit"))
    rows = df.select(key, F.split(t, QUANTITY).alias("gaps"), pieces.alias("hits")).where(F.size("hits") > 0)
    rows = rows.select(key, "gaps", "hits", F.posexplode("hits").alias("n", "q"))
    n = F.col("n")
    # what stands since the last sum of money, other quantities included
    money = F.array_max(F.transform(F.slice("hits", F.lit(1), n), lambda h, i: F.when(h.unit == "원", i)))
    since = F.coalesce(money + 1, F.lit(0))
    between = F.transform(F.slice("hits", since + 1, n - since), lambda h, i: F.concat(F.get("gaps", since + i), h.hit))
    rows = rows.select(
        key, "n", F.col("q.number").alias("number"), F.col("q.scale").alias("scale"), F.col("q.unit").alias("unit"), F.get("gaps", n).alias("before"),
        F.get("gaps", n + 1).alias("after"), F.concat(F.array_join(between, ""), F.get("gaps", n)).alias("stretch"),
    )
    before, after, stretch, won = F.col("before"), F.col("after"), F.col("stretch"), F.col("unit") == "원"
    value = F.regexp_replace("number", ",", "").try_cast("decimal(38,6)") * _named(SCALES, F.coalesce("scale", F.lit("")))
    bound = F.regexp_extract(after, r"^\s*(이상|이하|미만|초과|이내|내외|정도)", 1)
    bound = F.when(bound != "", bound).otherwise(F.regexp_extract(before, r"(최대|최소|약|대략)\s*$", 1))
    named = _last(stretch, *SCOPES.values())
    scope = F.when(F.lit(False), "")
    for name, pattern in SCOPES.items():
        scope = scope.when(named.rlike(f"^(?:{pattern})$"), name)
    scope = F.coalesce(scope, F.when(stretch.rlike(IN_TOTAL), "total"), F.lit(""))
    frequency = F.when(stretch.rlike(ANNUAL_BEFORE) | after.rlike(ANNUAL), "annual")
    for name, pattern in FREQUENCIES.items():
        frequency = frequency.when(stretch.rlike(pattern) | after.rlike(pattern), name)
    frequency = frequency.when(stretch.rlike(TOTAL_SUM), "total").otherwise("")
    own = _payer(before, after)
    payer = F.when(won & (own == ""), _payer(stretch, None)).when(won | (F.col("unit") == "%"), own).otherwise("")
    return rows.select(
        key, "n", value.cast("decimal(38,6)").alias("value"), "unit", F.coalesce(_named(BOUNDS, bound), F.lit("=")).alias("comparator"),
        F.when(won, scope).otherwise("").alias("scope"), F.when(won, frequency).otherwise("").alias("frequency"), payer.alias("payer"),
    )


def quantity_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, quantities, numbers): the typed quantities of a text and its other numbers, each as a sorted array with repeats."""
    facts = money_facts(df, key, text)
    one = F.concat_ws("|", F.col("value").cast("string"), "unit", "comparator", "scope", "frequency", "payer")
    facts = facts.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("quantities"))
    left = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), QUANTITY, "")
    numbers = F.array_sort(F.regexp_extract_all(left, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))
    return df.select(key, numbers.alias("numbers")).join(facts, key, "left").select(key, F.coalesce("quantities", F.array().cast("array<string>")).alias("quantities"), "numbers")
