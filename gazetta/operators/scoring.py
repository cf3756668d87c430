"""Opportunity scores, priorities, urgency, business days, readiness and money amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of fit, value, feasibility and urgency in each preset; dimensions; caps (fixed values).
DIMENSIONS = ("COMPANY_FIT", "BUSINESS_VALUE", "FEASIBILITY", "URGENCY")
PRESETS = {"FIT": (50, 20, 20, 10), "GROWTH": (40, 35, 20, 5), "FEASIBILITY": (40, 15, 40, 5)}
#: Remaining days up to which an urgency score holds (fixed values).
URGENCY_BANDS = ((2, 100), (5, 90), (7, 80), (14, 65), (21, 50), (30, 35), (45, 20))
#: Working days that each kind of preparation takes, and the worth of each level of evidence (fixed values).
WORK_DAYS = {
    "INTERNAL_CONFIRMATION": 2, "EXTERNAL_CONFIRMATION": 7, "DOCUMENT_ISSUANCE": 5, "CERTIFICATION": 15, "SIGNATURE_SEAL": 3, "BUDGET_REVIEW": 7,
    "PROPOSAL_WRITING": 10, "TECHNICAL_PLANNING": 10, "DOMESTIC_PARTNER": 15, "INTERNATIONAL_PARTNER": 25, "LEGAL_CONTRACT": 7, "OTHER": 5,
}
EVIDENCE = {"OFFICIAL_DOCUMENT": 100, "USER_CONFIRMED": 90, "OFFICIAL_WEBSITE": 65, "PUBLIC_INFORMATION": 45, "UNKNOWN": 0}
REVIEW_DAYS = 5
#: Korean number scales (fixed values).
SCALES = {
    "백": 10**2, "천": 10**3, "만": 10**4, "십만": 10**5, "백만": 10**6, "천만": 10**7, "억": 10**8, "십억": 10**9, "백억": 10**10, "천억": 10**11, "조": 10**12,
}


def opportunity_score(fit: Column, value: Column, feasibility: Column, urgency: Column, preset: Column) -> Column:
    """Weighted sum, rounded half up, at most 49 where the fit is 40 or less; missing scores count 0."""
    scores = [F.coalesce(c, F.lit(0)) for c in (fit, value, feasibility, urgency)]
    out = None
    for name, weights in PRESETS.items():
        total = F.lit(0.0)
        for s, w in zip(scores, weights):
            total = total + s * F.lit(w) / F.lit(100.0)
        out = F.when(preset == name, total) if out is None else out.when(preset == name, total)
    rounded = F.floor(out + 0.5)
    return F.when(scores[0] <= 40, F.least(rounded, F.lit(49))).otherwise(rounded).cast("int")


def opportunity_priority(total: Column, fit: Column, feasibility: Column, urgency: Column) -> Column:
    sound = (fit >= 50) & (feasibility >= 50)
    high = sound & ((total >= 75) | ((total >= 50) & (urgency >= 85)))
    return F.when(high, "HIGH").when(total >= 50, "NORMAL").otherwise("LOW")


def ranking_from_json(df: DataFrame, column: str, fallback: str | None = None) -> DataFrame:
    """Score and priority from stored JSON {dimensions: [{type, score}], preset}.

    Unknown dimensions are ignored and missing ones count 0; a duplicate or a score that is no whole number of 0 to 100, or
    JSON without a dimensions array, makes the row malformed: its priority is null and its score the fallback.
    """
    parsed = F.from_json(column, "dimensions array<struct<type: string, score: string>>, preset string")
    known = F.filter(F.col("__p.dimensions"), lambda d: d.type.isin(*DIMENSIONS))
    types = F.transform(known, lambda d: d.type)
    good = F.forall(known, lambda d: F.coalesce(d.score.rlike(r"^\d{1,3}$") & (d.score.try_cast("int") <= 100), F.lit(False)))
    named = F.forall(F.col("__p.dimensions"), lambda d: d.type.isNotNull())
    ok = F.coalesce(F.col("__p.dimensions").isNotNull() & good & named & (F.size(types) == F.size(F.array_distinct(types))), F.lit(False))
    out = df.withColumn("__p", parsed).withColumn("malformed", F.col(column).isNotNull() & (F.trim(column) != "") & ~ok)

    def of(kind: str) -> Column:
        return F.coalesce(F.get(F.filter(known, lambda d: d.type == kind), F.lit(0)).score.try_cast("int"), F.lit(0))

    fit, value, feasible, urgent = map(of, DIMENSIONS)
    preset = F.coalesce("__p.preset", F.lit("FIT"))
    score = opportunity_score(fit, value, feasible, urgent, preset)
    back = F.col(fallback) if fallback else F.lit(None).cast("int")
    out = out.withColumn("score", F.when(ok, score).otherwise(back))
    return out.withColumn("priority", F.when(ok, opportunity_priority(F.col("score"), fit, feasible, urgent))).drop("__p")


def urgency(days: Column, rolling: Column | None = None) -> Column:
    """Score of the remaining days: past 0, nine bands, unknown 10; rolling calls 70."""
    out = F.when(rolling, 70) if rolling is not None else F.when(F.lit(False), 0)
    out = out.when(days.isNull(), 10).when(days < 0, 0)
    for most, score in URGENCY_BANDS:
        out = out.when(days <= most, score)
    return out.otherwise(10)


def urgency_configured(days: Column, window: int) -> Column:
    return F.when(days < 0, 0).when(days <= window, 100).when(days <= 2 * window, 65).when(days <= 4 * window, 35).when(days.isNotNull(), 10)


def business_days(start: Column, end: Column) -> Column:
    """Monday to Friday after ``start`` up to ``end``; 0 if not later."""

    def upto(day: Column) -> Column:  # working days since the Monday 1970-01-05
        n = F.datediff(day, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(4)) + F.lit(1)

    return F.when(end > start, upto(end) - upto(start)).otherwise(0).cast("int")


def minus_business_days(day: Column, n: Column) -> Column:
    """The date ``n`` working days before: whole weeks, then the rest, over the weekend where it falls."""
    weekday = F.weekday(day)
    friday = F.date_sub(day, F.greatest(F.lit(0), weekday - 4))
    rest = F.when(weekday > 4, n - 1).otherwise(n)
    at = F.least(weekday, F.lit(4))
    back = F.floor(rest / 5).cast("int") * 7 + rest % 5
    out = F.date_sub(friday, (back + F.when(at < rest % 5, 2).otherwise(0)).cast("int"))
    return F.when(n <= 0, day).otherwise(out)


def _lookup(column: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[column]


def readiness(items: DataFrame, today) -> DataFrame:
    """Add days, schedule, readiness and target_date to (work_type, evidence, condition, deadline).

    Readiness is 0.8 condition + 0.2 schedule, rounded half to even; the condition defaults to the evidence's worth.  The
    target is the deadline less preparation and review days, not before today, and null once the deadline is past.
    """
    now = F.lit(today).cast("date")
    days = _lookup(F.col("work_type"), WORK_DAYS)
    left = business_days(now, F.col("deadline"))
    schedule = F.when(F.col("deadline").isNull(), 50).when(left <= 0, 0).otherwise(F.least(F.lit(100), F.bround(left / days * 100)))
    condition = F.coalesce("condition", _lookup(F.col("evidence"), EVIDENCE))
    target = F.greatest(minus_business_days(F.col("deadline"), days + REVIEW_DAYS), now)
    out = items.withColumns({"days": days, "schedule": schedule.cast("int"), "condition": condition})
    ready = F.bround(F.col("condition") * F.lit(0.8) + F.col("schedule") * F.lit(0.2)).cast("int")
    return out.withColumns({"readiness": ready, "target_date": F.when(F.col("deadline") >= now, target)})


_SCALE = "(?:" + "|".join(sorted(SCALES, key=len, reverse=True)) + ")"
#: Digits are taken whole: a number never gives any back to reach a match.
_NUMBER = r"[0-9][0-9,]*+(?:\.[0-9]++)?"
_CHAIN = rf"(?:{_NUMBER}\s*{_SCALE}\s*)*+(?:{_NUMBER}\s*)?+"
_RANGE = rf"{_NUMBER}\s*{_SCALE}?\s*(?:[~∼–—－-]|부터)\s*"
_AMOUNT = rf"(?<![0-9.,A-Za-z+-])[+-]?(?:{_RANGE})?(?=[0-9]){_CHAIN}원"


def _chain_value(chain: Column, default: Column | None = None) -> Column:
    """Sum of the numbers times their scales; a single number without a scale takes the default."""
    pieces = F.regexp_extract_all(chain, F.lit(rf"{_NUMBER}\s*{_SCALE}?"), F.lit(0))

    def one(piece: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(piece, "^[0-9][0-9,]*(?:[.][0-9]+)?", 0), ",", "").cast("decimal(24,4)")
        own = _lookup(F.regexp_extract(piece, f"({_SCALE})$", 1), SCALES)
        return (number * F.coalesce(own, default if default is not None else F.lit(1), F.lit(1)).cast("decimal(14,0)")).cast("decimal(38,6)")

    return F.aggregate(pieces, F.lit(0).cast("decimal(38,6)"), lambda s, p: (s + one(p)).cast("decimal(38,6)"))


def won_amounts(text: Column) -> Column:
    """Every amount that ends in 원, as exact decimals in order: 1억 2천만원 is one of 120000000, 1~2억원 two.

    A range's lower end without a scale takes the upper one's; a minus makes an amount negative.  Numbers before
    anything else (years, people) are no amounts.  Null text has none.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_AMOUNT), F.lit(0))

    def of(amount: Column) -> Column:
        lower = F.regexp_extract(amount, rf"^[+-]?({_NUMBER}\s*{_SCALE}?)\s*(?:[~∼–—－-]|부터)", 1)
        upper = F.regexp_replace(amount, rf"^[+-]?(?:{_RANGE})?", "")
        sign = F.when(amount.startswith("-"), -1).otherwise(1)
        last = _lookup(F.regexp_extract(upper, rf"({_SCALE})\s*원$", 1), SCALES)
        high = (_chain_value(upper) * sign).cast("decimal(38,6)")
        return F.when(lower == "", F.array(high)).otherwise(F.array((_chain_value(lower, last) * sign).cast("decimal(38,6)"), high))

    return F.flatten(F.transform(found, of))


def parse_won(text: Column) -> Column:
    """The one amount that a text states; null if it states none or different ones."""
    amounts = F.array_distinct(won_amounts(text))
    return F.when(F.size(amounts) == 1, F.get(amounts, F.lit(0)))
