"""Arrivals as streams: idempotent arrivals, continuous versioning, run expiry with late results, running statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VERSIONS = "document_id long, event_id long, change_type string, version_no long"
RUNS = "run_id long, outcome string, late long"
#: Pages that runs are dealt to; a stream keeps its number, as its state does.
PAGES = 2048


def stream_dedupe(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once; a key is remembered for ``delay`` of event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


class _Versions(StatefulProcessor):
    """Last hash and version number of each document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version_hash string, version_no long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, number = self.last.get() if self.last.exists() else (None, 0)
        rows, out = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable"), []
        for event, h in zip(rows["event_id"], rows["version_hash"]):
            kind = "NEW" if not number else "UNCHANGED" if h == seen else "UPDATED"
            number += kind != "UNCHANGED"
            seen = h
            out.append((key[0], event, kind, number))
        self.last.update((seen, number))
        yield pd.DataFrame(out, columns=["document_id", "event_id", "change_type", "version_no"])

    def close(self) -> None:
        pass


def stream_versions(stream: DataFrame) -> DataFrame:
    """Change type and version of each observation (document_id, event_id, ts, version_hash), in order of arrival; needs the RocksDB state store."""
    return stream.groupBy("document_id").transformWithStateInPandas(_Versions(), VERSIONS, "Append", "None")


class _Runs(StatefulProcessor):
    """A run ends with its first result or an hour after its acceptance, by the events' own times; what comes later is counted.

    A result tells by its time whether the run had failed before it, so that how rows fall into batches changes nothing;
    the timer is for runs that stay silent.
    """

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "outcome string, late long, accepted long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.state.get()
        outcome, late, accepted = before or ("", 0, 0)
        came = []
        for at, kind in sorted((row.at_ms, row.kind) for row in rows):
            if kind == "accepted" and not outcome:
                outcome, accepted = "OPEN", at
            elif kind == "result":
                if outcome == "OPEN":
                    outcome = "COLLECTED" if at <= accepted + self.wait_ms else "FAILED"
                    came.append(Row(run_id=key[0], outcome=outcome, late=late))
                    if outcome == "COLLECTED":
                        continue
                late += 1
                came.append(Row(run_id=key[0], outcome="LATE", late=late))
        was_open = before is not None and before[0] == "OPEN"
        if outcome == "OPEN" and not was_open:  # only runs that a batch leaves open wait
            self.handle.registerTimer(accepted + self.wait_ms)
        elif was_open and outcome != "OPEN":
            self.handle.deleteTimer(accepted + self.wait_ms)
        self.state.update((outcome, late, accepted))
        return iter(came)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        outcome, late, accepted = self.state.get() or ("", 0, 0)
        if outcome == "OPEN":
            self.state.update(("FAILED", late, accepted))
            yield Row(run_id=key[0], outcome="FAILED", late=late)

    def close(self) -> None:
        pass


class _RunPages(StatefulProcessor):
    """As ``_Runs`` for all runs of a page at once: a call, a state and a timer (that of the first open run) for a page, not for each run."""

    OUTCOMES = np.array(["", "OPEN", "COLLECTED", "FAILED", "LATE"], object)
    STATE = np.dtype([("run", np.int64), ("outcome", np.int8), ("late", np.int64), ("accepted", np.int64)])

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", "runs binary")

    def _runs(self) -> np.ndarray:
        return np.frombuffer(self.state.get()[0], self.STATE).copy() if self.state.exists() else np.zeros(0, self.STATE)

    def _first(self, runs: np.ndarray) -> int | None:
        """When the first open run fails."""
        waiting = runs["accepted"][runs["outcome"] == 1]
        return int(waiting.min()) + self.wait_ms if len(waiting) else None

    def _told(self, key: tuple, run: np.ndarray, outcome: np.ndarray, late: np.ndarray) -> pd.DataFrame:
        ids = pd.array([None] * len(run), "Int64") if key[0] < 0 else run  # page -1 is that of the rows without a run
        return pd.DataFrame({"run_id": ids, "outcome": self.OUTCOMES[outcome], "late": late})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat([r[["run", "at_ms", "result"]] for r in rows])
        run, at, result = (rows[c].to_numpy() for c in ("run", "at_ms", "result"))
        order = np.lexsort((result, at, run))
        run, at, result = run[order], at[order], result[order].astype(bool)
        begin = np.nonzero(np.r_[True, run[1:] != run[:-1]])[0]
        runs, of, place = self._runs(), np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(run)])), np.arange(len(run))
        before, now = self._first(runs), np.zeros(len(begin), self.STATE)
        now["run"] = run[begin]
        at_old = np.minimum(np.searchsorted(runs["run"], now["run"]), max(0, len(runs) - 1))
        old = runs["run"][at_old] == now["run"] if len(runs) else np.zeros(len(begin), bool)
        now[old] = runs[at_old[old]]
        never = len(run)
        first = np.minimum.reduceat(np.where(result, never, place), begin)  # the first acceptance
        opened = np.where(now["outcome"] == 1, -1, np.where(now["outcome"] == 0, first, never))
        taken = (now["outcome"] == 0) & (first < never)
        now["accepted"][taken] = at[first[taken]]
        ends = np.minimum.reduceat(np.where(result & (place > opened[of]), place, never), begin)  # the result that ends the run
        now["outcome"][taken] = 1
        over = ends < never
        last = ends[over]
        now["outcome"][over] = np.where(at[last] <= now["accepted"][over] + self.wait_ms, 2, 3)
        late = result.copy()
        late[last[now["outcome"][over] == 2]] = False
        count = np.cumsum(late)
        total = now["late"][of] + count - (count[begin] - late[begin])[of]
        told = [self._told(key, run[last], now["outcome"][over], total[last] - late[last]), self._told(key, run[late], np.full(late.sum(), 4), total[late])]
        now["late"] = total[np.r_[begin[1:], len(run)] - 1]
        kept = np.concatenate([np.delete(runs, at_old[old]), now])
        kept = kept[np.argsort(kept["run"], kind="stable")]
        self._keep(kept, before)
        yield pd.concat(told, ignore_index=True)

    def _keep(self, runs: np.ndarray, before: int | None) -> None:
        after = self._first(runs)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        self.state.update((runs.tobytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, passed = self._runs(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        over = (runs["outcome"] == 1) & (runs["accepted"] + self.wait_ms <= passed)
        runs["outcome"][over] = 3
        self._keep(runs, None)  # the timer before is the one that has run out
        yield self._told(key, runs["run"][over], runs["outcome"][over], runs["late"][over])

    def close(self) -> None:
        pass


def stream_runs(stream: DataFrame, wait: int = 3600, delay: str = "10 seconds", pages: int | None = PAGES) -> DataFrame:
    """Runs (run_id long, ts, kind: accepted or result) that were collected, failed after ``wait`` seconds, or got results late.

    Repeated acceptances are ignored; results of runs never accepted are late.  Runs are dealt to ``pages`` by hash, each settled at
    once and written whole where a batch touches it; with None each run has a state of its own, for batches that bring few runs of very many.
    """
    timed = stream.withWatermark("ts", delay).withColumn("at_ms", F.unix_millis("ts"))
    if pages is None:
        return timed.groupBy("run_id").transformWithState(_Runs(wait * 1000), RUNS, "Append", "EventTime")
    page = F.when(F.col("run_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("run_id"), F.lit(pages)))
    rows = timed.where(F.col("kind").isin("accepted", "result") & F.col("at_ms").isNotNull())
    rows = rows.select(page.cast("int").alias("page"), F.coalesce("run_id", F.lit(0)).cast("long").alias("run"), "ts", "at_ms", (F.col("kind") == "result").alias("result"))
    return rows.groupBy("page").transformWithStateInPandas(_RunPages(wait * 1000), RUNS, "Append", "EventTime")


class _Terms(StatefulProcessor):
    """The terms of each document's latest version; a newer one takes the old one's back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "at long, event_id long, terms array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, event, had = self.latest.get() if self.latest.exists() else (None, None, None)
        rows, before = pd.concat(list(rows)), had
        for now, number, terms in sorted(zip(rows["at_ms"].tolist(), rows["event_id"].tolist(), rows["terms"]), key=lambda r: r[:2]):
            if at is None or (now, number) > (at, event):  # an older version that comes late changes nothing
                at, event, had = now, number, list(terms)
        self.latest.update((at, event, list(had)))
        if before is None or list(had) != list(before):
            change: dict[str | None, list[int]] = {None: [int(before is None), len(had) - len(before or [])]}
            for sign, terms in ((-1, before or []), (1, had)):
                for term in set(terms):
                    change.setdefault(term, [0, 0])[0] += sign
            out = [(term, df, size) for term, (df, size) in change.items() if df or size]
            yield pd.DataFrame(out, columns=["term", "df", "size"])

    def close(self) -> None:
        pass


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stream_corpus_stats(stream: DataFrame, table: str, checkpoint: str):
    """Statistics of the latest versions (document_id, event_id, ts, terms) under ``table``; read them with ``corpus_stats``.

    A document's new version retracts the terms of the one before, and what arrives out of order counts by its time, so that after any
    order of batches the statistics are those of the latest versions.  Each batch merges its changes with the statistics before it into a
    folder of its own number, and removes the one before that: the table keeps to its terms, and a batch that is repeated after a
    failure begins from the same place.  Needs the RocksDB state store.
    """
    timed = stream.withColumn("at_ms", F.unix_millis("ts"))
    changes = timed.groupBy("document_id").transformWithStateInPandas(_Terms(), "term string, df long, size long", "Append", "None")

    def merge(batch: DataFrame, number: int) -> None:
        spark, columns = batch.sparkSession, ["term", "df", "size"]
        if number > 0:
            batch = batch.unionByName(spark.read.parquet(f"{table}/batch-{number - 1}").select(columns))
        merged = batch.groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size")).where("df <> 0 OR size <> 0")
        merged.write.mode("overwrite").parquet(f"{table}/batch-{number}")
        if number > 1:
            _remove(spark, f"{table}/batch-{number - 2}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def corpus_stats(spark: SparkSession, table: str) -> tuple[DataFrame, DataFrame]:
    """(term, df) and one row (n, total) of the last batch of ``stream_corpus_stats``: documents, and terms in all of them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(table)
    names = [f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    last = spark.read.parquet(f"{table}/batch-{max(int(n.split('-')[1]) for n in names)}")
    whole = last.where("term IS NULL").select(F.col("df").alias("n"), F.col("size").alias("total"))
    return last.where("term IS NOT NULL AND df > 0").select("term", "df"), whole


def run_to_end(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Take in all that is there, append the results to a parquet table, and read it."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(table)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)
