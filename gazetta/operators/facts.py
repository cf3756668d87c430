"""Facts beside each other: multisets of quantities, schedules, money, funding tables, reuse, forms and grouped conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .texts import table_rows

#: Circumstances beside an amount (fixed values), and words of schedule roles.
AMOUNT_FLAGS = {"VAT": "부가(?:가치)?세|VAT", "LOAN": "융자|대출", "EXCLUDED": "제외|불포함", "MATCHING": "자부담|매칭|민간부담"}
SCHEDULE_ROLES = {"announcement": "선정|발표|결과", "submission": "접수|신청|제출|마감|의견"}
#: Order in which editions of one form are preferred (fixed values).
FORM_FORMATS = ("hwpx", "hwp", "docx", "doc", "pdf")


def counts(items: Column) -> Column:
    """An array as a map from value to how often it comes."""
    return F.map_from_entries(F.transform(F.array_distinct(items), lambda x: F.struct(x, F.size(F.filter(items, lambda y: y == x)))))


def facts_subset(a: Column, b: Column) -> Column:
    """Every value of ``a`` comes in ``b`` at least as often."""
    return F.forall(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)) <= F.size(F.filter(b, lambda y: y == x)))


def schedule_roles(rows: DataFrame, key: str, roles: dict[str, str] = SCHEDULE_ROLES) -> DataFrame:
    """(key, role, entry): schedule lines by role, the first that fits, whole equal entries once."""
    role = F.when(F.lit(False), "")
    for name, words in roles.items():
        role = role.when(F.col("line").rlike(words), name)
    return rows.select(key, role.otherwise("other").alias("role"), F.col("line").alias("entry")).dropDuplicates([key, "role", "entry"])


def schedule_issues(claimed: DataFrame, verified: DataFrame, keys: list[str]) -> DataFrame:
    """Contexts whose one claimed end date differs from the one verified; ambiguous contexts are no issue."""

    def single(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min("day").alias(name), F.max("day").alias("__m")).where(F.col(name) == F.col("__m")).drop("__m")

    return single(claimed, "claimed").join(single(verified, "verified"), keys).where("claimed <> verified")


def amount_flags(rows: DataFrame, clause: str, flags: dict[str, str] = AMOUNT_FLAGS) -> DataFrame:
    """Clauses with the circumstances that they name, as a sorted array."""
    hits = F.array_compact(F.array(*[F.when(F.col(clause).rlike(p), k) for k, p in flags.items()]))
    return rows.withColumn("flags", F.array_sort(hits))


def money_values(df: DataFrame, key: str, text: str, unit: str) -> DataFrame:
    """(key, n, value, unit): every number before the unit, in order, as an exact decimal."""
    hit = F.posexplode(F.regexp_extract_all(text, F.lit(rf"([0-9][0-9,]*(?:\.[0-9]+)?)\s*{unit}"), F.lit(1))).alias("n", "number")
    rows = df.select(key, hit)
    return rows.select(key, "n", F.regexp_replace("number", ",", "").try_cast("decimal(38,6)").alias("value"), F.lit(unit).alias("unit"))


def dedupe_amounts(df: DataFrame, key: str, quantities: str, conditions: str) -> DataFrame:
    """One row of each (sorted quantities, conditions) of a document: the first."""
    same = [F.array_join(F.array_sort(F.col(c).cast("array<string>")), "\x1f") for c in (quantities, conditions)]
    turn = Window.partitionBy(key, *same).orderBy("n")
    return df.withColumn("__t", F.row_number().over(turn)).where("__t = 1").drop("__t")


def funding_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, type, subsidy, own_share) of three-column tables whose figures are all shares of 0 to 100; any other cell rejects it."""
    rows = table_rows(df, key, text).where("row_no > 0 AND size(cells) = 3")
    share = lambda i: F.regexp_replace(F.get("cells", F.lit(i)), "[% ]", "").try_cast("double")
    rows = rows.select(key, "table_no", F.get("cells", F.lit(0)).alias("type"), share(1).alias("subsidy"), share(2).alias("own_share"))
    ok = F.coalesce(F.col("subsidy").between(0, 100) & F.col("own_share").between(0, 100), F.lit(False))
    good = F.min(ok.cast("int")).over(Window.partitionBy(key, "table_no")) == 1
    return rows.withColumn("good", good).where("good").drop("good")


def reusable_facts(saved: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Saved values (keys, value) that are the only current value of their field, none of those blocked."""
    from .texts import single_value_facts

    return saved.join(single_value_facts(current, keys, "value", "blocked"), [*keys, "value"])


def match_forms(titles: DataFrame, files: DataFrame, formats: tuple[str, ...] = FORM_FORMATS) -> DataFrame:
    """(title_id, file_id, result): the file of a title's name; editions of one stem by format; other names in common stay unresolved.

    ``titles``: title_id, title; ``files``: file_id, name.
    """
    tight = lambda c: F.regexp_replace(F.lower(c), r"[\s_\-()\[\]]+", "")
    stem, kind = F.regexp_extract("name", r"^(.*?)(?:\.[A-Za-z0-9]{1,10})?$", 1), F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]{1,10})$", 1))
    place = F.array_position(F.array(*map(F.lit, formats)), kind)
    f = files.select("file_id", tight(stem).alias("key"), stem.alias("stem"), F.when(place > 0, place).otherwise(99).alias("place"))
    per = f.groupBy("key").agg(F.min(F.struct("place", "file_id")).alias("best"), (F.min("stem") == F.max("stem")).alias("one"))
    joined = titles.withColumn("key", tight(F.col("title"))).join(per, "key", "left")
    result = F.when(F.col("one").isNull(), "NOT_FOUND").when(F.col("one"), "MATCHED").otherwise("AMBIGUOUS")
    return joined.select("title_id", F.when(F.col("one"), F.col("best.file_id")).alias("file_id"), result.alias("result"))


def reconcile(items: DataFrame, requirements: DataFrame, keys: list[str]) -> DataFrame:
    """Required rows with the extracted item that is theirs: matched if one, ambiguous (none chosen) if several, missing if none."""
    per = items.groupBy(*keys).agg(F.count("*").alias("n"), F.min("item_id").alias("item_id"))
    state = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") == 1, "MATCHED").otherwise("AMBIGUOUS")
    return requirements.join(per, keys, "left").select("requirement_id", F.when(F.col("n") == 1, F.col("item_id")).alias("item_id"), state.alias("state"))


def group_conditions(df: DataFrame, keys: list[str], scope: str, rank: str, key: str) -> DataFrame:
    """(keys, scope, n, preferred): conditions of one section, audience and key set; a missing scope takes the one known, if it is one."""
    own = Window.partitionBy(*keys)
    known = F.when(F.min(scope).over(own) == F.max(scope).over(own), F.min(scope).over(own))
    out = df.withColumn(scope, F.coalesce(F.col(scope), known))
    return out.groupBy(*keys, scope).agg(F.count("*").alias("n"), F.min(F.struct(rank, key)).alias("best")).select(*keys, scope, "n", F.col(f"best.{key}").alias("preferred"))


def comparison_fields(df: DataFrame, key: str, text: str, first: str, weights: dict[str, int]) -> DataFrame:
    """(key, field): what the pattern finds in a text, else its line with the best score of weighted words, earliest first."""
    from .texts import lines

    score = F.lit(0)
    for word, weight in weights.items():
        score = score + F.when(F.contains("line", F.lit(word)), weight).otherwise(0)
    best = lines(df, key, text).withColumn("score", score).where("score > 0")
    best = best.groupBy(key).agg(F.max(F.struct("score", (-F.col("line_no")).alias("at"), "line")).alias("b")).select(key, F.col("b.line").alias("line"))
    found = F.trim(F.regexp_extract(text, first, 1))
    return df.join(best, key, "left").select(key, F.when(found != "", found).otherwise(F.col("line")).alias("field"))
