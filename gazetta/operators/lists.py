"""List, status and rollup queries over runs, detections, versions, analyses, reports and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .versioning import latest_per_key

#: Run states in which work is still going on, and states of a task that is closed or done with analysis (fixed values).
RUNNING = ("PENDING", "COLLECTING", "COLLECTED", "ANALYZING", "ANALYZED")
CLOSED = ("DONE", "FAILED", "ANALYZED")
#: Legal review (fixed values).
REVIEW_VERSION, REVIEW_ATTEMPTS, REVIEW_PAUSE = 2, 3, "INTERVAL 30 MINUTES"
REVIEW_DONE = ("RESTRICTION_FOUND", "CAUTION", "NOT_FOUND", "DATA_INSUFFICIENT")
REVIEW_NEEDS_SOURCE = ("CONTEXT_LIMIT", "CONTEXT_REQUIRED")
REVIEW_UNSOUND = ("INTERPRETATION_MISSING", "UNSUPPORTED_INTERPRETATION")


def filter_detections(df: DataFrame, run_id=None, from_=None, to=None, time: str = "detected_at") -> DataFrame:
    """Rows of a run and of from_ <= time < to; a parameter that is None does not restrict."""
    if from_ is not None and to is not None and from_ > to:
        raise ValueError("from_ is after to")
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    if from_ is not None:
        df = df.where(F.col(time) >= F.lit(from_).cast("timestamp_ntz"))
    return df if to is None else df.where(F.col(time) < F.lit(to).cast("timestamp_ntz"))


def search(df: DataFrame, columns: list[str], text: str | None = None, priority: str | None = None) -> DataFrame:
    """Literal, case-insensitive substring over the joined columns; blank text and no priority do not restrict."""
    if text and text.strip():
        df = df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower())))
    return df if priority is None else df.where(F.col("priority") == priority)


def analysis_status(has_analysis: Column, run_status: Column, task_state: Column) -> Column:
    """COMPLETED with an analysis; PENDING while run and task are open; else FAILED."""
    task_open = task_state.isNull() | ~task_state.isin(*CLOSED)
    return F.when(has_analysis, "COMPLETED").when(run_status.isin(*RUNNING) & task_open, "PENDING").otherwise("FAILED")


def needs_analysis(detections: DataFrame, analyses: DataFrame, revision: int) -> DataFrame:
    """Detections to analyse: changed, or without an analysis, of an older revision, due for an upgrade or with pending legal types.

    ``detections``: version_id, change_type, text_chars; ``analyses``: version_id, settings_revision, schema_upgrade, pending_types.
    """
    have = analyses.select("version_id", F.lit(True).alias("__has"), "settings_revision", "schema_upgrade", "pending_types")
    joined = detections.join(have, "version_id", "left")
    due = (F.col("change_type") != "UNCHANGED") | F.col("__has").isNull() | (F.col("settings_revision") < revision)
    due = due | F.col("schema_upgrade") | (F.col("pending_types") > 0)
    return joined.where(due & (F.col("text_chars") > 0)).select(detections.columns)


def pending_reviews(analyses: DataFrame, findings: DataFrame, types: DataFrame, now) -> DataFrame:
    """(analysis_id, type) still to review.

    All types where there is no review of the current version; none after three attempts or within half an hour of the last;
    else the types without exactly one finding, or whose finding is neither complete and sound nor waiting for a source.
    ``types`` is the short fixed list; it is joined to each analysis as an array.
    """
    names = [r["type"] for r in types.select("type").collect()]
    all_types = analyses.withColumn("type", F.explode(F.array(*map(F.lit, names))))
    reason = F.coalesce("failure_reason", F.lit(""))
    sound = reason.isin(*REVIEW_NEEDS_SOURCE) | (
        F.coalesce(F.col("status").isin(*REVIEW_DONE), F.lit(False)) & (F.coalesce("summary", F.lit("")) != "") & ~reason.isin(*REVIEW_UNSOUND)
    )
    per = findings.groupBy("analysis_id", "type").agg(F.count("*").alias("n"), F.bool_and(sound).alias("sound"))
    joined = all_types.join(per, ["analysis_id", "type"], "left")
    fresh = ~F.coalesce(F.col("review_version") == REVIEW_VERSION, F.lit(False))
    resting = (F.coalesce("attempts", F.lit(0)) >= REVIEW_ATTEMPTS) | F.coalesce(F.col("reviewed_at") + F.expr(REVIEW_PAUSE) > F.lit(now).cast("timestamp_ntz"), F.lit(False))
    open_ = F.coalesce(F.col("n"), F.lit(0)) != 1
    return joined.where(fresh | (~resting & (open_ | ~F.coalesce("sound", F.lit(False))))).select("analysis_id", "type")


def detection_summary(detections, documents, versions, run_sources, sources, analyses, tasks) -> DataFrame:
    """The list row of each detection: its document, version and source, its analysis if any, and the latest task of its run.

    All that a version has is put together once a version, before the detections, which are far more, meet it and their document.
    """
    task = latest_per_key(tasks, ["run_id"], [F.desc("task_id")]).select("run_id", F.col("state").alias("task_state"))
    listed = versions.join(run_sources.join(sources, "source_id"), "run_source_id").join(task, "run_id", "left").join(analyses, "version_id", "left")
    return detections.join(listed, "version_id").join(documents, "document_id")


def bookmarked(df: DataFrame, bookmarks: DataFrame, user_id: int, key: str = "version_id") -> DataFrame:
    return df.join(bookmarks.where(F.col("user_id") == user_id).select(key), key, "left_semi")


def unqueued_runs(runs: DataFrame, tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """Runs with neither a task nor a report."""
    return runs.join(tasks.select("run_id"), "run_id", "left_anti").join(reports.select("run_id"), "run_id", "left_anti")


def with_previous(versions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each version with the one before of its document, and that one's analysis if there is one."""
    order = Window.partitionBy("document_id").orderBy("version_no")
    before = versions.withColumn("previous_version_id", F.lag("version_id").over(order))
    return before.join(analyses.withColumnRenamed("version_id", "previous_version_id"), "previous_version_id", "left")


def run_history(runs: DataFrame, reports: DataFrame) -> DataFrame:
    return runs.join(reports, "run_id", "left").orderBy(F.desc("requested_at"), F.desc("run_id"))


def split_valid_results(results: DataFrame, detections: DataFrame, ids: list[str]) -> DataFrame:
    """Results with ``valid``: their detection exists and all ``ids`` agree with it."""
    known = detections.select("detection_id", *[F.col(c).alias(f"__{c}") for c in ids])
    agree = F.lit(True)
    for c in ids:
        agree = agree & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = results.join(known.withColumn("__known", F.lit(True)), "detection_id", "left")
    return joined.withColumn("valid", F.col("__known").isNotNull() & agree).drop("__known", *[f"__{c}" for c in ids])


def attachment_diff(prev: DataFrame, curr: DataFrame, key: str = "document_id") -> DataFrame:
    """Files (key, name, text) of two versions by name, with ``change``; a name that one side has twice is AMBIGUOUS_NAME."""

    def per(df, side):
        return df.groupBy(key, "name").agg(F.count("*").alias(f"n_{side}"), F.max("text").alias(f"t_{side}"))

    both = per(prev, "a").join(per(curr, "b"), [key, "name"], "full_outer")
    blank = F.coalesce(F.col("t_a"), F.lit("")) == ""
    blank_b = F.coalesce(F.col("t_b"), F.lit("")) == ""
    change = (
        F.when((F.col("n_a") > 1) | (F.col("n_b") > 1), "AMBIGUOUS_NAME")
        .when(F.col("n_a").isNull(), "ADDED")
        .when(F.col("n_b").isNull(), "REMOVED")
        .when(blank | blank_b, "UNCOMPARABLE")
        .when(F.col("t_a") == F.col("t_b"), "TEXT_UNCHANGED")
        .otherwise("TEXT_CHANGED")
    )
    return both.select(key, "name", change.alias("change"))


def audit_compare(cases: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Audited cases with what changed; ids that only one side has and labels that differ are flagged."""
    b = before.select("id", F.col("label").alias("label_before"), F.col("passed").alias("passed_before"))
    a = after.select("id", F.col("label").alias("label_after"), F.col("passed").alias("passed_after"))
    joined = b.join(a, "id", "full_outer").join(cases.select("id", "group"), "id", "left")
    missing = F.col("label_before").isNull() | F.col("label_after").isNull()
    return joined.withColumns({"missing": missing, "relabelled": ~missing & (F.col("label_before") != F.col("label_after"))})


def audit_summary(compared: DataFrame) -> DataFrame:
    ok = compared.where("NOT missing")
    return ok.agg(
        F.count("*").alias("cases"), F.count_if("passed_before").alias("passed_before"), F.count_if("passed_after").alias("passed_after"),
        F.count_distinct("group").alias("groups"), F.count_if(F.col("passed_before") != F.col("passed_after")).alias("changed"),
    )


def run_rollup(sources: DataFrame, attachments: DataFrame) -> DataFrame:
    """Per run: sources that succeeded and failed, documents, warnings (one for each failed source and attachment)."""
    failed = attachments.groupBy("run_id", "source_id").agg(F.count_if(F.col("parse_status") == "FAILED").alias("bad_files"))
    joined = sources.join(failed, ["run_id", "source_id"], "left")
    bad = F.col("status") == "FAILED"
    return joined.groupBy("run_id").agg(
        F.count_if(~bad).alias("success_sources"), F.count_if(bad).alias("failed_sources"), F.sum("documents").alias("documents"),
        (F.count_if(bad) + F.coalesce(F.sum("bad_files"), F.lit(0))).alias("warnings"),
    )


def run_state(rollup: DataFrame) -> DataFrame:
    """Add state (FAILED if every source failed, else COLLECTED) and consistent (success + failed within total)."""
    state = F.when((F.col("total_sources") > 0) & (F.col("failed_sources") == F.col("total_sources")), "FAILED").otherwise("COLLECTED")
    return rollup.withColumns({"state": state, "consistent": F.col("success_sources") + F.col("failed_sources") <= F.col("total_sources")})


def revision(df: DataFrame, key: str, updated: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.max(key).alias("max_id"), F.max(updated).alias("max_updated"))


def delivery_status(reports: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Reports with the state of their deliveries: the first that holds of failed report, preparing, sending, partial, failed, sent."""
    state = {s: F.bool_or(F.col("delivery_status") == s).alias(f"has_{s.lower()}") for s in ("PENDING", "SENT", "FAILED")}
    joined = reports.join(deliveries.groupBy("report_id").agg(*state.values()), "report_id", "left")
    pending, sent, failed = (F.coalesce(f"has_{s}", F.lit(False)) for s in ("pending", "sent", "failed"))
    out = (
        F.when(F.col("status") == "FAILED", "REPORT_FAILED")
        .when(F.col("status") == "PENDING", "PREPARING")
        .when(pending, "SENDING")
        .when(sent & failed, "PARTIAL")
        .when(failed, "FAILED")
        .when(sent | F.col("sent_at").isNotNull(), "SENT")
        .when(F.col("error_message").isNotNull(), "FAILED")
        .otherwise("NOT_SENT")
    )
    return joined.withColumn("delivery", out).drop("has_pending", "has_sent", "has_failed")


def order_latest(df: DataFrame, time: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(key))


def order_score(df: DataFrame, score: str, time: str, key: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), F.desc(time), F.desc(key))


def order_by_mode(df: DataFrame, by_score: bool, score: str, time: str, key: str) -> DataFrame:
    """By score, a missing one counting as -1, or by time; then time and id."""
    first = [F.desc(F.coalesce(score, F.lit(-1)))] if by_score else []
    return df.orderBy(*first, F.desc(time), F.desc(key))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """One page of an ordered table: Spark keeps only the first rows of each task on the way."""
    return df.offset(number * size).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """Total rows and pages under the same filters; reads no column that the filters do not."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def due_tasks(tasks: DataFrame, now, n: int) -> DataFrame:
    open_ = ~F.col("state").isin("DONE", "FAILED") & (F.col("available_at") <= F.lit(now).cast("timestamp_ntz"))
    return tasks.where(open_).orderBy("available_at", "task_id").limit(n)


def run_report(blocks: DataFrame, limit: int, key: str = "run_id") -> DataFrame:
    """One text a run: blocks in order until ``limit`` characters, and how many were left out."""
    before = F.sum(F.char_length("block") + 1).over(Window.partitionBy(key).orderBy("position"))
    sized = blocks.withColumn("fits", before <= limit)
    parts = F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("position", "block"))))
    return sized.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda x: x.block), "\n").alias("report"), F.count_if(~F.col("fits")).alias("remaining")
    )
