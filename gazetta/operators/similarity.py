"""Similar notices: unit vectors, BM25, rank windows, reciprocal rank fusion and acceptance rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import staged

#: BM25 and fusion constants, and themes by pattern (fixed values).
K1, B, TITLE_WEIGHT, RRF_K, WINDOW, MATCHES = 1.2, 0.75, 2, 60, 20, 3
THEMES = (
    "순환경제|재제조", "규제샌드박스|규제특례", "국제공동연구|국제협력|기술협력", "공연|예술|창작",
    "반도체|디스플레이|제조|설비|기계|공장|예지보전|결함탐지", "전산|유지보수|유지관리|^it$",
)
#: Rows of the query side that may be broadcast, queries that are multiplied at once, and rows of one term that meet in a task.
SMALL, BLOCK, PART = 100_000, 512, 50_000
#: Queries of a block, slices of rows at most, and documents that meet a block of texts in one task.
QUERIES, SLICES, ROWS = 262_144, 32, 8_192
#: Words that documents have in common with queries, counted for each query, that are sorted at once.
COMMON = 2_000_000
#: Not read any more; a test sets it.
SEEDS = 50


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, u): vectors of norm 1, scaled by their largest component first; null, empty, zero and non-finite ones are dropped."""
    v = F.col(vector).cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    out = df.where(finite).select(key, v.alias("v")).withColumn("m", F.array_max(F.transform("v", F.abs))).where("m > 0")
    out = out.select(key, F.transform("v", lambda x: x / F.col("m")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return out.withColumn("n", norm).select(key, F.transform("v", lambda x: x / F.col("n")).alias("u"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_pairs(queries: DataFrame, candidates: DataFrame, key: str, least: float = -1.0, best: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, id, cosine) of a stated set of queries with all other rows of the same length, clamped to 1, from ``least`` on.

    Both sides are cut by hash (``_meet``); a task multiplies a block of queries with its slice of the rows as matrices, ``BLOCK`` queries
    and a batch of rows at a time.  Only pairs that reach ``least`` leave it, and with ``best`` only those that can be among a query's
    ``best`` when cosines are rounded to ``digits`` and ties go to the smaller id; further ones may come along.  Rows without an id take no part.
    """
    q, c = (_norms(df.where(F.col(key).isNotNull()), key) for df in (queries, candidates))
    kind = dict(candidates.dtypes)[key]
    q, c = q.withColumnsRenamed({key: "query_id", "v": "q"}), c.withColumnsRenamed({key: "id", "v": "u"})

    def multiply(asked: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        q, u, names, ids = _units(asked, "q"), _units(rows, "u").T, asked["query_id"].to_numpy(), rows["id"].to_numpy()
        for at in range(0, len(q), BLOCK):
            values, some = np.clip(q[at : at + BLOCK] @ u, -1.0, 1.0), names[at : at + BLOCK]
            i, j = _best(values, (values >= least) & (some[:, None] != ids[None, :]), ids, best, digits)
            yield some[i], ids[j], values[i, j]

    return _meet(q, c, queries.count(), candidates.count(), ["d"], multiply, {"query_id": kind, "id": kind, "cosine": "double"}, best, digits)


def _norms(df: DataFrame, key: str) -> DataFrame:
    """(key, d, m, n, v) of the vectors that ``unit_vectors`` keeps: their number of components, largest component, norm after it, and themselves."""
    wide = F.col("embedding").cast("array<double>")
    finite = F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    out = df.where(finite).select(key, F.col("embedding").alias("v"), F.array_max(F.transform(wide, F.abs)).alias("m")).where("m > 0")
    norm = F.sqrt(F.aggregate(F.transform(F.col("v").cast("array<double>"), lambda x: x / F.col("m")), F.lit(0.0), lambda s, x: s + x * x))
    return out.select(key, F.size("v").alias("d"), "m", norm.alias("n"), "v")


def _units(rows: pa.Table, vector: str) -> np.ndarray:
    """Vectors of norm 1, one a row, as ``unit_vectors`` makes them."""
    values = pa.concat_arrays(rows[vector].chunks).flatten().to_numpy().astype(float).reshape(len(rows), -1)
    return values / rows["m"].to_numpy()[:, None] / rows["n"].to_numpy()[:, None]


def _meet(asked: DataFrame, rows: DataFrame, queries: int, count: int, group: list[str], work: Callable, names: dict[str, str], best: int | None, digits: int | None) -> DataFrame:
    """``names`` (query, id, value) of what ``work`` makes of blocks of queries and slices of rows, both by hash, cut to what can be among a query's ``best``.

    A block has about ``QUERIES`` queries, and there are ``SLICES`` slices at most, so that neither the copies of the queries nor the
    pairs that leave the slices grow faster than the queries.  A task holds a block and takes the rows in by batches.  ``group`` names
    columns that both sides must have in common.
    """
    blocks, slices = _cells(queries, count)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select("*", part("query_id", blocks).alias("block"), every(slices).alias("slice"), F.lit(0).alias("side"))
    d = rows.select("*", every(blocks).alias("block"), part("id", slices).alias("slice"), F.lit(1).alias("side"))
    both = q.unionByName(d, allowMissingColumns=True).withColumn("cell", F.col("block") * slices + F.col("slice")).drop("block", "slice")
    cell = ["cell", *group]
    both = both.repartitionById(blocks * slices, F.col("cell")).sortWithinPartitions(*cell, "side")
    schema = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in names.items()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, held, kept, size = None, None, [], [], 0

        def leave() -> Iterator[pa.RecordBatch]:
            if kept:
                yield from pa.table([np.concatenate(x) for x in zip(*kept)], schema=schema).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.column_stack([table[c].to_numpy() for c in (*cell, "side")])
            cuts = np.r_[0, np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, len(keys)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x == y:
                    continue
                if at != tuple(keys[x, :-1]):
                    yield from leave()
                    at, block, held, kept, size = tuple(keys[x, :-1]), None, [], [], 0
                if keys[x, -1] == 0:
                    held.append(table.slice(x, y - x))
                    continue
                if not held:
                    continue
                block = pa.concat_tables(held) if block is None else block
                for some in work(block, table.slice(x, y - x)):
                    kept.append(some)
                    size += len(some[0])
                if best is None:
                    yield from leave()
                    kept, size = [], 0
                elif size > 2 * best * len(block):
                    kept = [_first(*(np.concatenate(c) for c in zip(*kept)), best, digits)]
                    size = len(kept[0][0])
        if kept and best is not None:
            kept = [_first(*(np.concatenate(c) for c in zip(*kept)), best, digits)]
        yield from leave()

    return both.mapInArrow(meet, ", ".join(f"{n} {t}" for n, t in names.items()))


def _cells(queries: int, rows: int) -> tuple[int, int]:
    """Blocks of queries and slices of rows, of which each two meet in a task."""
    return max(1, -(-queries // QUERIES)), max(1, min(SLICES, -(-rows // (4 * BLOCK))))


def _first(query: np.ndarray, ids: np.ndarray, values: np.ndarray, best: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of any queries those that can be among their query's ``best``, as ``_best`` tells."""
    order = np.lexsort((ids, -values, query))
    query, ids, values = query[order], ids[order], values[order]
    place, begin = np.arange(len(query)), np.r_[True, query[1:] != query[:-1]]
    start = np.maximum.accumulate(np.where(begin, place, 0))
    end = np.r_[np.nonzero(begin)[0][1:], len(query)][np.cumsum(begin) - 1]
    last = np.where(end - start < best, -np.inf, values[np.minimum(start + best, len(query)) - 1])
    turn = place - np.maximum.accumulate(np.where(begin | np.r_[True, values[1:] != values[:-1]], place, 0))
    keep = (values >= last - (0.0 if digits is None else 10.0**-digits)) & (turn < best)
    return query[keep], ids[keep], values[keep]


def _best(values: np.ndarray, mask: np.ndarray, ids: np.ndarray, best: int | None, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``mask`` of the pairs that can be among the ``best`` of their row, all where it is None.

    What rounding may lift to the last of them stays; of equal values the ``best`` smallest ids do.
    """
    if best is None:
        return np.nonzero(mask)
    values = np.where(mask, values, -np.inf)
    slack = 0.0 if digits is None else 10.0**-digits
    last = np.partition(values, max(0, values.shape[1] - best), axis=1)[:, max(0, values.shape[1] - best)]
    i, j = np.nonzero(mask & (values >= last[:, None] - slack))
    order = np.lexsort((ids[j], -values[i, j], i))
    i, j = i[order], j[order]
    new = np.r_[True, (i[1:] != i[:-1]) | (values[i, j][1:] != values[i, j][:-1])] if len(i) else np.zeros(0, bool)
    turn = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
    return i[turn < best], j[turn < best]


def split_join(left: DataFrame, right: DataFrame, key: str, by: str, most: int | None = None) -> DataFrame:
    """Join on a key that any share of ``right`` may have: its rows of one key meet in parts of about ``most``, by a hash of ``by``."""
    most = PART if most is None else most
    often = right.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(key, F.ceil(F.col("__n") / most).alias("__parts"))
    often = F.broadcast(often) if often.count() <= SMALL else often
    left = left.join(often, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1).cast("long")) - 1))).drop("__parts")
    right = right.join(often, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1).cast("long")))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")


def meet_by_step(rows: DataFrame, block: list[str], reach: int, bucket: int) -> DataFrame:
    """The rows of each ``block`` in every cell that they meet others in, with ``cell`` and ``side`` (own, left or right).

    A block is cut by its rows' ``step`` and by a hash of their ``id`` into buckets of about ``bucket`` rows; two buckets meet in a cell
    if their steps are ``reach`` apart at most, and a bucket meets itself in one of its own.
    """
    parts = rows.groupBy(*block, "step").agg(F.ceil(F.count("*") / bucket).alias("parts"))
    other = parts.select(*block, F.col("step").alias("step2"), F.col("parts").alias("parts2"))
    cells = parts.join(other, block).where(F.col("step2").between(F.col("step"), F.col("step") + reach))
    cells = cells.select(*block, "step", "step2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "parts2")
    cells = cells.select(*block, "step", "part", "step2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts2") - 1)).alias("part2"))
    cells = cells.where((F.col("step") < F.col("step2")) | (F.col("part") <= F.col("part2")))
    cell, own = F.concat_ws(":", "step", "part", "step2", "part2").alias("cell"), (F.col("step") == F.col("step2")) & (F.col("part") == F.col("part2"))
    ends = cells.select(*block, "step", "part", cell, F.when(own, "own").otherwise("left").alias("side"))
    ends = ends.unionByName(cells.where(~own).select(*block, F.col("step2").alias("step"), F.col("part2").alias("part"), cell, F.lit("right").alias("side")))
    placed = rows.join(parts, [*block, "step"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    return placed.join(ends, [*block, "step", "part"])


def whole_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that come place by place, cut between places: one is held until its last row is there."""
    held = []
    for batch in batches:
        if batch.empty:
            continue
        at = batch["place"].to_numpy()
        last = len(at) - int(np.argmax(at[::-1] != at[-1])) if at[0] != at[-1] else 0
        if last or (held and held[-1]["place"].iloc[-1] != at[0]):
            done = pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = []
            yield done
        held.append(batch.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def by_text(df: DataFrame, keys: list[str], texts: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``work`` for each row's texts, with its ``keys``: what ``work`` makes of (__same, texts) depends on the texts alone.

    Equal texts, null as empty, are worked on once and then go to all their rows; a text that many rows have meets them in parts.
    """
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    same = F.sha2(F.concat(*[x for c in texts for x in (F.length(value(c)).cast("string"), F.lit(":"), value(c))]), 256).alias("__same")
    once = staged(df.select(same, *[value(c).alias(c) for c in texts]).distinct())
    done, rows = staged(work(once)), df.select(*keys, same)
    if done.count() <= SMALL:
        return rows.join(F.broadcast(done), "__same").drop("__same")
    return split_join(done, rows, "__same", keys[0]).drop("__same")


def term_table(df: DataFrame, key: str, title: str, purpose: str) -> DataFrame:
    """(key, term, tf): weighted frequency of each distinct term of two term arrays."""
    weighed = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    words = df.select(key, F.flatten(F.array_compact(F.array(weighed(F.col(title), TITLE_WEIGHT), weighed(F.col(purpose), 1)))).alias("words"))
    rows = words.repartition(key).select(key, F.explode("words").alias("t")).select(key, "t.term", "t.w")  # a document's terms meet in one place
    return rows.groupBy(key, "term").agg(F.sum("w").alias("tf"))


def corpus_stats(terms: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Document frequency of each term, and one row with the number of documents and their total weighted length."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    per = terms.groupBy(key).agg(F.sum("tf").alias("len"))
    return df, per.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))


def stats_excluding(terms: DataFrame, key: str) -> DataFrame:
    """(key, term, df, n, average): the statistics that each document's term has among all other documents.

    The terms are written down once, and the documents of a frequent one meet in parts.
    """
    placed = _placed(terms, key)
    df, whole = corpus_stats(placed, key)
    joined = split_join(df, placed, "term", key).crossJoin(F.broadcast(whole))  # one row
    average = F.greatest(F.lit(1.0), (F.col("total") - F.col("len")) / F.greatest(F.lit(1), F.col("n") - 1))
    return joined.select(key, "term", (F.col("df") - 1).alias("df"), (F.col("n") - 1).alias("n"), average.alias("average"))


def _placed(terms: DataFrame, key: str) -> DataFrame:
    """(key, term, tf, len) as a table of its own: each document's terms with its weighted length."""
    return staged(terms.withColumn("len", F.sum("tf").over(Window.partitionBy(key))))


def _asked(queries: DataFrame, placed: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """(query_id, term, df, idf, average, longest): what each query's terms weigh, its own document left out; and whether these are few.

    ``longest`` is no less than any average.
    """
    queries = staged(queries.select("query_id", "term").distinct())
    df, whole = corpus_stats(placed, key)
    own = placed.groupBy(F.col(key).alias("query_id")).agg(F.first("len").alias("own_len"))
    mine = placed.select(F.col(key).alias("query_id"), "term", F.lit(1).alias("own_df"))
    asked = queries.join(own, "query_id", "left").join(mine, ["query_id", "term"], "left").join(df, "term", "left").crossJoin(F.broadcast(whole))  # one row
    return _weighed(asked), queries.count() <= SMALL


def _weighed(asked: DataFrame) -> DataFrame:
    has = F.col("own_len").isNotNull().cast("int")
    n, f = F.col("n") - has, F.coalesce("df", F.lit(0)) - F.coalesce("own_df", F.lit(0))
    average = F.greatest(F.lit(1.0), (F.col("total") - F.coalesce("own_len", F.lit(0))) / F.greatest(F.lit(1), n))
    longest = F.greatest(F.lit(1.0), F.col("total") / F.greatest(F.lit(1), F.col("n") - 1))
    return asked.select("query_id", "term", f.alias("df"), F.log(1 + (n - f + 0.5) / (f + 0.5)).alias("idf"), average.alias("average"), longest.alias("longest"))


def _saturation(average: Column) -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("len") / average))


def _hits(asked: DataFrame, placed: DataFrame, key: str, small: bool) -> DataFrame:
    """Query terms met with the rows (key, term, tf, len) that have them: small ones where these lie, others by term, frequent terms in parts."""
    hits = placed.join(F.broadcast(asked), "term") if small else split_join(asked, placed, "term", key)
    return hits.where(F.col("query_id") != F.col(key))


def bm25(queries: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(query_id, id, lexical) for queries (query_id, term) over (key, term, tf), the query's own document left out of statistics and results.

    ``query_id`` is the id of a document of ``terms`` or of none.  Every pair with a term in common has a score, rounded to nine
    digits; for the best ones alone use ``bm25_window``.  The terms lie by document, so that the parts of a score meet where they arise.
    """
    placed = _placed(terms, key)
    asked, small = _asked(queries, placed, key)
    hits = _hits(asked.drop("df", "longest"), placed, key, small)
    return hits.groupBy("query_id", F.col(key).alias("id")).agg(F.round(F.sum(F.col("idf") * _saturation(F.col("average"))), 9).alias("lexical"))


def bm25_window(queries: DataFrame, terms: DataFrame, key: str, k: int = WINDOW) -> DataFrame:
    """(query_id, id, lexical) as ``bm25``, of every pair that can be among a query's ``k`` best when ties go to the smaller id; further ones may come along.

    A block of queries and a slice of the documents meet in a task (``_meet``), which adds up the scores of each query over a batch
    of them in memory: only what can be among a query's best leaves it, and no pair is ever written for a term alone.
    """
    docs = staged(terms.groupBy(key).agg(F.sum("tf").alias("len"), F.collect_list(F.struct("term", F.col("tf").cast("double").alias("w"))).alias("words")))
    asked = _asked_of(queries, docs, key).where("df > 0")
    asked = staged(asked.groupBy("query_id").agg(F.first("average").alias("average"), F.collect_list(F.struct("term", F.col("idf").alias("w"))).alias("words")))
    names = {"query_id": dict(asked.dtypes)["query_id"], "id": dict(docs.dtypes)[key], "lexical": "double"}
    d = docs.select(F.col(key).alias("id"), "len", "words").where("id IS NOT NULL")
    out = _meet(asked.where("query_id IS NOT NULL"), d, asked.count(), docs.count(), [], lambda a, b: _scores(a, b, k), names, k, 9)
    return out.withColumn("lexical", F.round("lexical", 9))


def _asked_of(queries: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """As ``_asked`` over documents (key, len, words): only those that are queries, and of the others the terms asked for, meet the queries."""
    queries = staged(queries.select("query_id", "term").distinct())
    names, words = (queries.select(c).distinct() for c in ("query_id", "term"))
    few = lambda df: F.broadcast(df) if df.count() <= 10 * SMALL else df
    own = staged(docs.withColumnRenamed(key, "query_id").join(few(names), "query_id", "left_semi"))
    mine = own.select("query_id", F.explode("words.term").alias("term"), F.lit(1).alias("own_df"))
    each = docs.select(F.explode("words.term").alias("term"))
    each = each.join(F.broadcast(words), "term", "left_semi") if words.count() <= SMALL else each
    df, whole = each.groupBy("term").agg(F.count("*").alias("df")), docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    own = own.select("query_id", F.col("len").alias("own_len"))
    return _weighed(queries.join(own, "query_id", "left").join(mine, ["query_id", "term"], "left").join(df, "term", "left").crossJoin(F.broadcast(whole)))  # one row


def _words(rows: pa.Table) -> tuple[pa.StructArray, np.ndarray]:
    """The words of all rows, one after another, and where those of each row begin."""
    words = pa.concat_arrays(rows["words"].chunks)
    return words.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])


def _scores(asked: pa.Table, docs: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query (query_id, average, words) the scores over some documents (id, len, words) that can be among its ``k`` best."""
    words, ends = _words(docs)
    coded = words.field("term").dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")  # a term's documents lie together
    first = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    doc = np.repeat(np.arange(len(docs)), np.diff(ends))[order]
    tf, size, ids = words.field("w").to_numpy()[order], docs["len"].to_numpy()[doc].astype(float), docs["id"].to_numpy()
    asks, starts = _words(asked)
    term = pc.fill_null(pc.index_in(asks.field("term"), coded.dictionary), -1).to_numpy()
    idf, average, query, out = asks.field("w").to_numpy(), asked["average"].to_numpy(), asked["query_id"].to_numpy(), []
    for i in range(len(asked)):
        mine = slice(starts[i], starts[i + 1])
        some = [(slice(first[t], first[t + 1]), w) for t, w in zip(term[mine], idf[mine]) if t >= 0]
        if not some:
            continue
        at, f, n = (np.concatenate([x[s] for s, _ in some]) for x in (doc, tf, size))
        weight = np.repeat([w for _, w in some], [s.stop - s.start for s, _ in some])
        values = np.bincount(at, weight * f * (K1 + 1) / (f + K1 * ((1 - B) + B * n / average[i])), len(docs))
        _, j = _best(values[None, :], ((values > 0) & (ids != query[i]))[None, :], ids, k, 9)
        out.append((np.full(len(j), query[i]), ids[j], values[j]))
    if out:
        yield tuple(np.concatenate(x) for x in zip(*out))


def rank_window(scores: DataFrame, value: str, k: int = WINDOW, rank: str = "rank") -> DataFrame:
    """The ``k`` best of each query, ties at the cut to the smaller id; equal values share a rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(value), "id")
    top = scores.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")
    return top.withColumn(rank, F.rank().over(Window.partitionBy("query_id").orderBy(F.desc(value))))


def hybrid_rank(semantic: DataFrame, lexical: DataFrame, least: float = 0.65) -> DataFrame:
    """Fuse both windows: (query_id, id, cosine, lexical, semantic_rank, lexical_rank, fused)."""
    s = rank_window(semantic.where(F.col("cosine") >= least), "cosine", rank="semantic_rank")
    x = rank_window(lexical.where("lexical > 0"), "lexical", rank="lexical_rank")
    both = s.join(x, ["query_id", "id"], "full_outer")
    share = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    return both.withColumn("fused", share("semantic_rank") + share("lexical_rank"))


def top_matches(fused: DataFrame, k: int = MATCHES) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.desc(F.coalesce("cosine", F.lit(-1.0))), "id")
    return fused.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def coverage(a: Column, b: Column) -> Column:
    return overlap(a, b) / F.greatest(F.lit(1), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def themes(terms: Column, patterns: tuple[str, ...] = THEMES) -> Column:
    """Numbers of the themes that a term shows."""
    shows = [F.exists(terms, _matcher(p)) for p in patterns]
    return F.array_compact(F.array(*[F.when(s, i) for i, s in enumerate(shows)]))


def _matcher(pattern: str):
    return lambda term: term.rlike(pattern)


def themes_conflict(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def accept(pairs: DataFrame, title_least=0.65, corroborated=0.78, semantic=0.90) -> DataFrame:
    """Accepted pairs with their basis.

    ``pairs``: cosine, in_semantic, in_lexical, shared (topics), reliable, and arrays title_q, purpose_q, title_c, purpose_c.
    """
    tq, pq, tc, pc = map(F.col, ("title_q", "purpose_q", "title_c", "purpose_c"))
    aq, ac = F.array_union(tq, pq), F.array_union(tc, pc)
    purposes = (F.size(pq) > 0) & (F.size(pc) > 0)
    common = F.array_intersect(tq, tc)
    letters = F.aggregate(common, F.lit(0), lambda s, t: s + F.length(t))
    specific = (F.size(common) >= 2) & (letters >= 10) & (coverage(tq, tc) >= 0.8) & (F.size(common) / F.greatest(F.size(tq), F.size(tc)) >= 0.6)
    close = F.coalesce(F.col("cosine") >= title_least, F.lit(False))
    title = F.col("in_lexical") & close & specific & purposes
    backed = F.coalesce(F.col("cosine") >= corroborated, F.lit(False)) & (F.col("shared") >= 2) & (overlap(pq, pc) >= 1) & (coverage(pq, pc) >= 0.3)
    lexical = F.col("in_lexical") & close & (coverage(aq, ac) >= 0.6) & (overlap(pq, pc) >= 2)
    meaning = F.col("in_semantic") & F.coalesce(F.col("cosine") >= semantic, F.lit(False)) & F.col("reliable") & purposes
    alone = F.col("cosine").isNull() & F.col("in_lexical") & (coverage(aq, ac) >= 0.8) & (coverage(pq, pc) >= 0.8) & (overlap(pq, pc) >= 3)
    basis = F.when(alone, "LEXICAL_ONLY").when(backed, "HYBRID").when(title | lexical, "LEXICAL").when(meaning, "SEMANTIC")
    conflict = themes_conflict(themes(aq), themes(ac))
    return pairs.where(~conflict).withColumn("basis", basis).where("basis IS NOT NULL")


def shared_terms(a: DataFrame, b: DataFrame, most: int = 5, gram: int = 4) -> DataFrame:
    """(query_id, id, shared): up to ``most`` common topics of documents a (query_id, terms) and b (id, terms), in order of the term.

    Terms are common if equal, or if one of at least ``gram`` characters contains the other.  ``BLOCK`` queries and a slice of the
    documents, both by hash, meet in a task, which looks each different word of its slice up once; what is common leaves it
    as a pair's first terms only, and no row is written for a term alone.
    """
    rows = b.count()
    blocks, slices = max(1, -(-a.count() // BLOCK)), max(1, -(-rows // ROWS), min(16, -(-rows // (4 * BLOCK))))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = a.where("query_id IS NOT NULL AND size(terms) > 0").select(part("query_id", blocks).alias("block"), every(slices).alias("slice"), "query_id", F.col("terms").alias("words"))
    d = b.where("id IS NOT NULL AND size(terms) > 0").select(every(blocks).alias("block"), part("id", slices).alias("slice"), "id", F.col("terms").alias("words"))
    kinds = dict(a.dtypes)["query_id"], dict(b.dtypes)["id"]
    met = q.groupBy("block", "slice").cogroup(d.groupBy("block", "slice"))
    return met.applyInArrow(lambda x, y: _shared(x, y, most, gram), f"query_id {kinds[0]}, id {kinds[1]}, shared array<string>")


def _common(asked: list[str], rows: np.ndarray, gram: int) -> Callable[[str], list[tuple[str, np.ndarray]]]:
    """Of a word, the terms that it has in common with queries' words, each with the places of these queries; ``rows`` are those of ``asked``."""
    have, starts, inside = {}, {}, {}
    for word, row in zip(asked, rows.tolist()):
        have.setdefault(word, set()).add(row)
    for word in have:
        if len(word) >= gram:
            starts.setdefault(word[:gram], []).append(word)
            for g in {word[i : i + gram] for i in range(len(word) - gram + 1)}:
                inside.setdefault(g, []).append(word)

    def common(word: str) -> list[tuple[str, np.ndarray]]:
        own, parts = set(have.get(word, ())), set()
        if len(word) >= gram:
            parts = {p for i in range(len(word) - gram + 1) for p in starts.get(word[i : i + gram], ()) if p != word and p in word}
            own = own.union(*(have[w] for w in inside.get(word[:gram], ()) if word in w))
        return [(c, np.fromiter(who, int)) for c, who in [(word, own), *((p, have[p]) for p in parts)] if who]

    return common


def _shared(asked: pa.Table, docs: pa.Table, most: int, gram: int) -> pa.Table:
    """Of queries (query_id, words) and documents (id, words) each pair's first ``most`` common terms."""
    names = pa.schema([("query_id", asked.schema.field("query_id").type), ("id", docs.schema.field("id").type), ("shared", pa.list_(pa.string()))])
    if not len(asked) or not len(docs):
        return names.empty_table()
    queries, ids = (t[c].combine_chunks().dictionary_encode() for t, c in ((asked, "query_id"), (docs, "id")))
    asks, starts = _words(asked)
    common = _common(asks.to_pylist(), np.repeat(queries.indices.to_numpy(), np.diff(starts)), gram)
    words, ends = _words(docs)
    coded = words.dictionary_encode()
    found = [common(w) for w in coded.dictionary.to_pylist()]
    terms = sorted({c for some in found for c, _ in some})
    turn = {c: n for n, c in enumerate(terms)}
    sizes = np.array([sum(len(who) for _, who in some) for some in found], int)
    first = np.concatenate([[0], np.cumsum(sizes)])
    none = [np.zeros(0, int)]
    who = np.concatenate([who for some in found for _, who in some] or none)
    what = np.repeat(np.array([turn[c] for some in found for c, _ in some], int), [len(who) for some in found for _, who in some])
    code, doc = coded.indices.to_numpy(), np.repeat(ids.indices.to_numpy().astype(int), np.diff(ends))
    order = np.argsort(doc, kind="stable")
    code, doc = code[order], doc[order]
    upto, out, at = np.cumsum(sizes[code]), [], 0
    while at < len(doc):  # whole documents, about COMMON words of theirs with queries at once
        last = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMMON, side="right"))
        last = int(np.searchsorted(doc, doc[max(at, last - 1)], side="right"))
        n = sizes[code[at:last]]
        some = np.repeat(first[code[at:last]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair = np.repeat(doc[at:last], n) * len(queries.dictionary) + who[some]
        keys = np.sort(pair * max(1, len(terms)) + what[some])
        pair, term = np.divmod(keys[np.diff(keys, prepend=-1) > 0], max(1, len(terms)))
        new = np.diff(pair, prepend=-1) > 0
        keep = np.arange(len(pair)) - np.maximum.accumulate(np.where(new, np.arange(len(pair)), 0)) < most
        heads, begins = pair[new], np.nonzero(new[keep])[0]
        shared = pa.ListArray.from_arrays(np.append(begins, keep.sum()).astype(np.int32), pa.array(terms, pa.string()).take(pa.array(term[keep])))
        i, q = np.divmod(heads, len(queries.dictionary))
        part = pa.table([queries.dictionary.take(pa.array(q)), ids.dictionary.take(pa.array(i)), shared], schema=names)
        out.append(part.filter(pc.not_equal(part["query_id"], part["id"])))
        at = last
    return pa.concat_tables(out) if out else names.empty_table()


def legal_pair(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, id, type, status): a pair's finding of each type by precedence."""
    a = findings.select(F.col("notice_id").alias("query_id"), "type", F.col("status").alias("a"))
    b = findings.select(F.col("notice_id").alias("id"), "type", F.col("status").alias("b"))
    joined = pairs.join(a, "query_id").join(b, ["id", "type"])
    either = lambda s: (F.col("a") == s) | (F.col("b") == s)
    status = F.when(either("RESTRICTION_FOUND"), "RESTRICTION_FOUND").when(either("ASSESSMENT_INCOMPLETE"), "ASSESSMENT_INCOMPLETE")
    status = status.when(either("DATA_INSUFFICIENT"), "DATA_INSUFFICIENT").when((F.col("a") == "NOT_FOUND") & (F.col("b") == "NOT_FOUND"), "NOT_FOUND")
    return joined.select("query_id", "id", "type", status.otherwise("REVIEW_REQUIRED").alias("status"))


def confusion(predicted: DataFrame, labelled: DataFrame) -> DataFrame:
    """Directed counts over labelled pairs (left, right, label); pairs to review are counted apart."""
    both = labelled.select("left", "right", "label").unionByName(labelled.select(F.col("right").alias("left"), F.col("left").alias("right"), "label"))
    hit = predicted.select(F.col("query_id").alias("left"), F.col("id").alias("right"), F.lit(True).alias("hit")).distinct()
    joined = both.join(hit, ["left", "right"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    yes, no = F.col("label") == "similar", F.col("label") == "different"
    return joined.agg(
        F.count_if(yes & F.col("hit")).alias("tp"), F.count_if(no & F.col("hit")).alias("fp"), F.count_if(yes & ~F.col("hit")).alias("fn"),
        F.count_if(no & ~F.col("hit")).alias("tn"), F.count_if(F.col("label") == "review").alias("review"),
    )
