"""Selections under budgets, sweep lines and event metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Attributes of call events that are kept (fixed values).
ATTRIBUTES = ("operation", "model", "outcome", "attempt", "stage", "duration_ms", "input_tokens", "output_tokens")
#: Timeout causes, most specific first (fixed values).
TIMEOUTS = ("connect", "read", "write", "pool", "total")


def round_robin(df: DataFrame, key: str, pool: str, order: list[Column], cap: int) -> DataFrame:
    """Rows of each ``key`` taken from its pools in turn, at most ``cap``; adds ``pick`` (from 1)."""
    turn = F.row_number().over(Window.partitionBy(key, pool).orderBy(*order))
    out = df.withColumn("__turn", turn).where(F.col("__turn") <= cap)
    pick = F.row_number().over(Window.partitionBy(key).orderBy("__turn", pool))
    return out.withColumn("pick", pick).where(F.col("pick") <= cap).drop("__turn")


def greedy_budget(df: DataFrame, key: str, order: list[str], size: str, budget: int, most: int | None = None) -> DataFrame:
    """Rows in order that still fit the budget, skipping those that do not, and ``most`` rows of a key if given.

    Skipping depends on all choices before, so each key's rows are read once in order in a task; only the
    running total is held, however many rows a key has.
    """
    rows = df.repartition(key).sortWithinPartitions(key, *order)

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, taken = object(), 0, 0
        for part in parts:
            keep = []
            for k, n in zip(part[key], part[size]):
                if k != at:
                    at, left, taken = k, budget, 0
                keep.append(n <= left and (most is None or taken < most))
                if keep[-1]:
                    left, taken = left - n, taken + 1
            yield part[keep]

    return rows.mapInPandas(choose, df.schema)


def prefix_budget(df: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows in order until the budget is passed."""
    total = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__total", total).where(F.col("__total") <= budget).drop("__total")


def allocate_budget(df: DataFrame, key: str, order: str, size: str, total: int) -> DataFrame:
    """Equal shares of ``total`` units, what small rows leave going to the others: min(size, level) and the rest one each.

    Closed form: with rows by size, the level is the share of what the smaller ones leave; the first row that the level
    does not exceed decides.
    """
    by_size = Window.partitionBy(key).orderBy(size, order)
    before = F.coalesce(F.sum(size).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(Window.partitionBy(key)) - F.row_number().over(by_size) + 1
    out = df.withColumns({"__before": before, "__left": left})
    level = F.floor((F.lit(total) - F.col("__before")) / F.col("__left"))
    out = out.withColumn("__level", level).withColumn("__short", F.col(size) > F.col("__level"))
    first = Window.partitionBy(key)
    cut = F.min(F.when(F.col("__short"), F.struct(F.col(size).alias("s"), F.col(order).alias("o"), F.col("__level").alias("level"), F.col("__before").alias("before"), F.col("__left").alias("left")))).over(first)
    out = out.withColumn("__cut", cut)
    rest = F.lit(total) - F.col("__cut.before") - F.col("__cut.level") * F.col("__cut.left")
    high = F.col("__cut").isNotNull() & ((F.col(size) > F.col("__cut.s")) | ((F.col(size) == F.col("__cut.s")) & (F.col(order) >= F.col("__cut.o"))))
    turn = F.row_number().over(Window.partitionBy(key, high).orderBy(order))
    extra = F.when(turn <= rest, 1).otherwise(0)
    share = F.when(high, F.least(F.col(size), F.col("__cut.level") + extra)).otherwise(F.col(size))
    return out.withColumn("allotted", share.cast("long")).drop("__before", "__left", "__level", "__short", "__cut")


def stage_durations(events: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """Milliseconds from each event to the next of its call; null for the last."""
    after = F.lead(time).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("duration_ms", F.unix_millis(after.cast("timestamp")) - F.unix_millis(F.col(time).cast("timestamp")))


def peak_active(intervals: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """The most intervals of a group that are open at one time; one that ends when another starts is closed first."""
    marks = intervals.select(group, F.col(start).alias("at"), F.lit(1).alias("step")).unionByName(intervals.select(group, F.col(end).alias("at"), F.lit(-1).alias("step")))
    steps = marks.groupBy(group, "at", "step").agg(F.sum("step").alias("change"))
    running = F.sum("change").over(Window.partitionBy(group).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("open", running).groupBy(group).agg(F.max("open").alias("peak"))


def call_rollup(events: DataFrame) -> DataFrame:
    """Calls per operation: outcomes, tokens, and how many had a response."""
    return events.groupBy("operation").agg(
        F.count("*").alias("calls"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") != "ok").alias("failed"),
        F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNotNull()).alias("responses"),
    )


def timeout_kind(causes: Column) -> Column:
    """The most specific kind in an array of causes, null if none is a timeout."""
    out = F.when(F.lit(False), "")
    for kind in TIMEOUTS:
        out = out.when(F.array_contains(causes, kind), kind)
    return out


def latency(events: DataFrame, group: str, value: str, cuts: int = 256) -> DataFrame:
    """Mean and 95th percentile: the value at place int(0.95 n) (at least 1) in order.

    Values are counted, and the counts added up between ``cuts`` rough quantiles; only the part that holds the place is put in order,
    so no task sorts a whole group.  The cuts only shape the parts: the value is exact.
    """
    known = events.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    edges = F.percentile_approx("v", [i / cuts for i in range(1, cuts)], 10 * cuts)
    whole = known.groupBy("g").agg(F.avg("v").alias("mean"), F.count("*").alias("n"), edges.alias("edges")).withColumnRenamed("g", "wg")
    at = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.95)))
    counts = known.groupBy("g", "v").agg(F.count("*").alias("c")).join(whole, F.col("g").eqNullSafe(F.col("wg")))
    counts = counts.select("g", "v", "c", "mean", at.alias("at"), F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("part"))
    parts = counts.groupBy("g", "part").agg(F.sum("c").alias("m"), F.first("at").alias("at"))
    upto = F.sum("m").over(Window.partitionBy("g").orderBy("part"))
    parts = parts.withColumn("upto", upto).where("upto >= at AND upto - m < at").select(F.col("g").alias("pg"), F.col("part").alias("pp"), (F.col("upto") - F.col("m")).alias("below"))
    held = counts.join(parts, F.col("g").eqNullSafe(F.col("pg")) & (F.col("part") == F.col("pp")))
    reached = F.col("below") + F.sum("c").over(Window.partitionBy("g").orderBy("v"))
    held = held.withColumn("reached", reached).where("reached >= at")
    return held.groupBy(F.col("g").alias(group)).agg(F.first("mean").alias("mean"), F.min("v").alias("p95"))


def phase_compare(events: DataFrame, config: str, phase: str, value: str, configs: list) -> DataFrame:
    """Total of each phase under each configuration, side by side."""
    return events.groupBy(phase).pivot(config, configs).agg(F.sum(value))


def clean_attributes(column: Column, allowed: tuple[str, ...] = ATTRIBUTES) -> Column:
    """A map of strings reduced to allowed keys whose values are finite numbers or short identifiers."""
    number = r"^-?\d{1,15}(\.\d{1,9})?$"
    word = r"^[A-Za-z0-9_.:-]{1,64}$"
    return F.map_filter(column, lambda k, v: k.isin(*allowed) & v.isNotNull() & (v.rlike(number) | v.rlike(word)))
