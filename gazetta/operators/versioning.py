"""Versions of documents by content hash: change types, histories, upserts, merges.

A document has one row for each version; "current" is always a query, never an update.
Keys may be hot (one source or document with very many rows): per-key windows take only the
columns they need, and aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Separators of the hashed text (fixed values): fields of an attachment, attachments, parts of the notice.
FIELD, ROW, PART = "\x1f", "\x1e", "\x1d"


def version_hash(notices: DataFrame, attachments: DataFrame, key: str = "version_id") -> DataFrame:
    """SHA-256 of title, body and attachment signature; attachments by URL, then name; a missing file hash is empty."""
    line = F.concat_ws(FIELD, F.coalesce("file_name", F.lit("")), F.coalesce("download_url", F.lit("")), F.coalesce("file_hash", F.lit("")))
    entry = F.struct(F.col("download_url").alias("u"), F.col("file_name").alias("n"), line.alias("line"))
    signed = attachments.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("files"))
    signed = signed.select(key, F.array_join(F.transform("files", lambda x: x.line), ROW).alias("signature"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(PART), F.coalesce("content_text", F.lit("")), F.lit(PART), F.coalesce("signature", F.lit("")))
    return notices.join(signed, key, "left").withColumn("version_hash", F.sha2(text, 256)).drop("signature")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; Spark keeps one row a key before the shuffle."""
    turn = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn")


def classify_changes(batch: DataFrame, latest: DataFrame, key: str = "document_id") -> DataFrame:
    """Add change_type: NEW without a stored version, UNCHANGED if its hash is the latest one's, else UPDATED."""
    stored = latest.select(key, F.col("version_hash").alias("__stored"), F.lit(True).alias("__known"))
    kind = F.when(F.col("__known").isNull(), "NEW").when(F.col("__stored").eqNullSafe(F.col("version_hash")), "UNCHANGED").otherwise("UPDATED")
    return batch.join(stored, key, "left").withColumn("change_type", kind).drop("__stored", "__known")


def append_versions(batch: DataFrame, versions: DataFrame, key: str = "document_id") -> DataFrame:
    """``versions`` with a next version for each changed document of ``batch`` (one row a document)."""
    newest = latest_per_key(versions, [key], [F.desc("version_no")])
    changed = classify_changes(batch, newest, key).where("change_type <> 'UNCHANGED'")
    last = newest.select(key, F.col("version_no").alias("__last"))
    added = changed.join(last, key, "left").withColumn("version_no", F.coalesce("__last", F.lit(0)) + 1)
    return versions.unionByName(added.select(versions.columns))


def build_history(observations: DataFrame, key: str, order: list[str], content: str = "version_hash") -> DataFrame:
    """Replay ordered observations: change_type and version_no of each; only the version before counts, so a return is new."""
    seen = Window.partitionBy(key).orderBy(*order)
    before = F.lag(content).over(seen)
    kind = F.when(F.row_number().over(seen) == 1, "NEW").when(before.eqNullSafe(F.col(content)), "UNCHANGED").otherwise("UPDATED")
    out = observations.withColumn("change_type", kind)
    running = F.sum(F.when(F.col("change_type") == "UNCHANGED", 0).otherwise(1)).over(seen.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("version_no", running)


def upsert_documents(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """First and last detection of each (source_id, original_url)."""
    seen = batch.select("source_id", "original_url", F.col("detected_at").alias("first_detected_at"), F.col("detected_at").alias("last_detected_at"))
    both = documents.select(seen.columns).unionByName(seen)
    return both.groupBy("source_id", "original_url").agg(F.min("first_detected_at").alias("first_detected_at"), F.max("last_detected_at").alias("last_detected_at"))


def dedupe_detections(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One detection for each (run source, document): the first of ``incoming`` that is not stored yet."""
    return latest_per_key(incoming.join(stored.select(*keys).distinct(), keys, "left_anti"), keys, order)


def refresh_attachments(stored: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Stored attachments with ``columns`` taken from the incoming row of the same version and URL, where it has them."""
    new = incoming.select("version_id", "download_url", *[F.col(c).alias(f"__{c}") for c in columns])
    new = new.dropDuplicates(["version_id", "download_url"])
    out = stored.join(new, ["version_id", "download_url"], "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def align_members(prev: DataFrame, curr: DataFrame, key: str = "version_id") -> DataFrame:
    """Place archive members (key, position, name, text) of ``curr``: matched ones keep the old position, others follow.

    Matches by name and text, then name, then text; equal ones in order of occurrence.  Both sides meet once, by key: a pass
    numbers the rows that no pass before matched, and one of each side with the same number are a pair.  Nulls match nothing.
    """
    columns = [key, "position", "name", "text"]
    rows = prev.select(*columns, F.lit(False).alias("__new")).unionByName(curr.select(*columns, F.lit(True).alias("__new"))).repartition(key)
    rows = rows.withColumns({"aligned_position": F.lit(None).cast("long"), "matched_by": F.lit(None).cast("string")})
    for on in (["name", "text"], ["name"], ["text"]):
        free = F.col("matched_by").isNull()
        for c in (key, *on):
            free = free & F.col(c).isNotNull()
        rows = rows.withColumn("__free", free)
        turn = F.row_number().over(Window.partitionBy(key, "__free", *on, "__new").orderBy("position"))
        pair = Window.partitionBy(key, "__free", *on, "__turn")
        rows = rows.withColumn("__turn", turn).withColumns({"__n": F.count("*").over(pair), "__old": F.max(F.when(~F.col("__new"), F.col("position"))).over(pair)})
        met = F.col("__free") & (F.col("__n") == 2)
        rows = rows.select(*columns, "__new", *[F.when(met, v).otherwise(F.col(c)).alias(c) for c, v in (("aligned_position", F.col("__old")), ("matched_by", F.lit("+".join(on))))])
    last = F.when(F.col(key).isNotNull(), F.max(F.when(~F.col("__new"), F.col("position"))).over(Window.partitionBy(key)))
    rows = rows.withColumn("__last", last).where("__new")
    extra = F.row_number().over(Window.partitionBy(key, F.col("matched_by").isNull()).orderBy("position"))
    place = F.coalesce("aligned_position", F.coalesce("__last", F.lit(-1)) + F.col("__extra"))
    return rows.withColumn("__extra", extra).select(key, "position", place.cast("long").alias("aligned_position"), F.coalesce("matched_by", F.lit("appended")).alias("matched_by"))


def line_changes(pairs: DataFrame, key: str, old: str, new: str, context: int = 2, budget: int = 2000) -> DataFrame:
    """Removed and added lines of two texts: (key, side, line_no, line), ends in common cut but for ``context`` lines.

    Lines that both middles hold cancel out by occurrence; each side stops where its lines pass ``budget`` characters,
    with ``truncated`` set on all its rows.
    """
    lines = pairs.select(key, F.split(F.coalesce(old, F.lit("")), "\n").alias("a"), F.split(F.coalesce(new, F.lit("")), "\n").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    back = F.zip_with(F.reverse("a"), F.reverse("b"), lambda x, y: x.eqNullSafe(y))
    short = F.least(F.size("a"), F.size("b"))
    first = F.array_position(F.slice(same, 1, short), False)
    last = F.array_position(F.slice(back, 1, short), False)
    lines = lines.withColumn("head", F.when(first > 0, first - 1).otherwise(short).cast("int"))
    lines = lines.withColumn("tail", F.least(F.when(last > 0, last - 1).otherwise(short).cast("int"), short - F.col("head")))
    out = None
    for side, name in (("a", "removed"), ("b", "added")):
        keep = F.posexplode(side).alias("line_no", "line")
        mid = lines.select(key, "head", "tail", F.size(side).alias("n"), keep)
        mid = mid.where((F.col("line_no") >= F.greatest(F.lit(0), F.col("head") - context)) & (F.col("line_no") < F.least(F.col("n"), F.col("n") - F.col("tail") + context)))
        turn = Window.partitionBy(key, "line").orderBy("line_no")
        mid = mid.select(key, F.lit(name).alias("side"), (F.col("line_no") + 1).cast("long").alias("line_no"), "line", F.row_number().over(turn).alias("turn"))
        out = mid if out is None else out.unionByName(mid)
    both = Window.partitionBy(key, "line", "turn")
    out = out.withColumn("sides", F.count("*").over(both)).where("sides = 1")
    size = F.sum(F.char_length("line") + 1).over(Window.partitionBy(key, "side").orderBy("line_no"))
    out = out.withColumn("size", size).withColumn("truncated", F.max("size").over(Window.partitionBy(key, "side")) > budget)
    return out.where(F.col("size") <= budget).select(key, "side", "line_no", "line", "truncated")


def backfill(df: DataFrame, version: int, columns: dict[str, Column], version_column: str = "ranking_version") -> DataFrame:
    """Recompute ``columns`` where the row's version is null or older; newer rows are never overwritten."""
    old = F.col(version_column).isNull() | (F.col(version_column) < version)
    new = {c: F.when(old, e).otherwise(F.col(c)) for c, e in columns.items()}
    return df.withColumns(new | {version_column: F.when(old, version).otherwise(F.col(version_column))})


def merge_results(stored: DataFrame, incoming: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    """Incoming results with ``action``: stored (none yet or an older revision there), duplicate (equal) or ignored (newer there)."""
    there = stored.select(key, F.col(revision).alias("__there"))
    action = F.when(F.col("__there").isNull() | (F.col(revision) > F.col("__there")), "stored").when(F.col(revision) == F.col("__there"), "duplicate")
    return incoming.join(there, key, "left").withColumn("action", action.otherwise("ignored")).drop("__there")


def merge_findings(stored: DataFrame, incoming: DataFrame, types: list[str]) -> DataFrame:
    """Findings (analysis_id, type, job_id, ...) by type in fixed order; incoming ones win unless their job was stored already."""
    fresh = incoming.join(stored.select("analysis_id", "job_id").distinct(), ["analysis_id", "job_id"], "left_anti")
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    place = F.array_position(F.array(*map(F.lit, types)), F.col("type"))
    out = latest_per_key(both.withColumn("type_order", place).where("type_order > 0"), ["analysis_id", "type"], [F.desc("__new"), F.desc("job_id")])
    return out.drop("__new")
