"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over block quotas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked, row_key, same, small_side, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A source counts at most so many times over.
MOST = 3
SHARDS = 64
#: Words of one slice of a shard, which one task writes.
SLICE_WORDS = 5_000_000
BLOCK_WORDS = 100_000
#: Blocks of one source; a larger source has larger blocks.
MAX_BLOCKS = 65_536
#: Groups of sources that the driver splits; each group's sources are split in a task.
GROUPS = 1024
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, rank, source_size, target): every source's share of all words.

    ``sizes``: source, size.  Sources by code point, null last, take ``weights`` in turn; a target
    ends at ``most`` times its source's size and the excess goes to the others by weight.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    per_source = staged(ranked(per_source, [F.asc_nulls_last("source")], "rank").withColumn("w", w))
    total = per_source.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # level * weight is the target of a source that is not at its end
        at_end = F.col("w") * level > most * F.col("source_size")
        ended, rest, n = per_source.agg(
            F.sum(F.when(at_end, most * F.col("source_size"))), F.sum(F.when(~at_end, F.col("w"))), F.count_if(at_end)
        ).first()
        if n == full or not rest:
            break
        full, level = n, (total - float(ended or 0)) / rest
    target = F.least(F.col("w") * level, most * F.col("source_size").cast("double"))
    return per_source.select("source", "rank", "source_size", target.alias("target"))


def split_quotas(quota: np.ndarray, sizes: np.ndarray, seed: list[int]) -> np.ndarray:
    """Draw how many blocks of each source (columns) each shard (rows) gets, all totals kept exactly.

    A node of the tree parts its shards in two halves and draws the left half's blocks without
    replacement from the node's quotas.
    """
    if len(sizes) == 1:
        return quota[None, :]
    half, at = len(sizes) // 2, len(sizes)
    rng = np.random.default_rng([*seed, at, int(sizes.sum())])
    left = rng.multivariate_hypergeometric(quota, int(sizes[:half].sum()), method="marginals")
    return np.vstack([split_quotas(left, sizes[:half], [*seed, 0]), split_quotas(quota - left, sizes[half:], [*seed, 1])])


def _split_group(rows: pd.DataFrame, by_group: dict[int, list[int]], seed: int) -> pd.DataFrame:
    group = int(rows["group"].iloc[0])
    rows = rows.sort_values("rank")
    drawn = split_quotas(rows["quota"].to_numpy(np.int64), np.array(by_group[group], np.int64), [seed, group + 1])
    return pd.DataFrame({"rank": rows["rank"].to_numpy(), "upto": list(np.cumsum(drawn, axis=0).T)})


def _fill_boundary(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole documents in the order drawn, whenever they fit; the first that does not is cut to what is left."""
    rows = rows.sort_values(["order", "doc_id", "row_key", "size"], kind="stable")
    left, taken = int(rows["left"].iloc[0]), []
    for n in rows["size"]:
        taken.append(n if n <= left else 0)
        left -= taken[-1]
    for at, n in enumerate(rows["size"]):
        if left and not taken[at] and n:
            taken[at] = left
            break
    return rows.assign(part=np.array(taken, dtype=np.int64))[["rank", "block", "doc_id", "row_key", "size", "part"]]


def mix_plan(rows: DataFrame, shards: int, block_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Sources (source, rank, source_size, target, blocks) and their blocks (rank, block, whole, cut, left).

    ``whole``: array of (epoch, shard), once for each time that the block is taken whole; ``cut``: the same
    for the one block of a source that is taken in part, ``left`` words of it.
    """
    sources = source_targets(rows.select("source", "size"))
    per = F.greatest(F.lit(1.0), F.least(F.lit(float(MAX_BLOCKS)), F.ceil(F.col("source_size") / block_words)))
    times = F.coalesce(F.floor(F.expr("try_divide(target, source_size)")), F.lit(0))
    sources = sources.withColumns({"blocks": per.cast("long"), "times": times.cast("long")})
    sources = staged(sources.withColumn("part", F.floor(F.col("target") - F.col("times") * F.col("source_size")).cast("long")))

    placed = with_block(rows, sources.select("source", "rank", "blocks"), seed)
    blocks = placed.groupBy("rank", "block").agg(F.sum("size").alias("words")).join(small_side(sources), "rank")
    perm = Window.partitionBy("rank").orderBy(F.xxhash64("rank", "block", F.lit(seed)), "block")
    blocks = blocks.withColumns({"place": F.row_number().over(perm) - 1, "end": F.sum("words").over(perm.rowsBetween(Window.unboundedPreceding, 0))})
    blocks = blocks.withColumn("have", F.count("*").over(Window.partitionBy("rank")))
    start = F.col("end") - F.col("words")
    state = F.when(F.col("end") <= F.col("part"), "whole").when(start < F.col("part"), "cut").otherwise("none")
    blocks = staged(blocks.withColumns({"state": state, "left": F.col("part") - start}))

    once = F.when(F.col("state") != "none", 1).otherwise(0)
    quotas = blocks.groupBy("rank").agg(F.sum(F.col("times") + once).alias("quota")).withColumn("group", F.col("rank") % GROUPS)
    quotas = staged(quotas)
    by_group = dict(quotas.groupBy("group").agg(F.sum("quota")).collect())
    groups = sorted(by_group)
    total = sum(by_group.values())
    sizes = np.array([total * (i + 1) // shards - total * i // shards for i in range(shards)], np.int64)
    drawn = split_quotas(np.array([by_group[g] for g in groups], np.int64), sizes, [seed, 0]) if groups else np.zeros((shards, 0))
    drawn = {g: [int(x) for x in drawn[:, i]] for i, g in enumerate(groups)}
    upto = quotas.groupBy("group").applyInPandas(lambda rows: _split_group(rows, drawn, seed), "rank long, upto array<long>")

    def shard(epoch):  # blocks of a source in permuted order, epoch after epoch; each shard has a run of them
        return F.size(F.filter("upto", lambda x: x <= epoch * F.col("have") + F.col("place"))).alias("shard")

    epochs = F.expr("CASE WHEN times > 0 THEN sequence(0L, times - 1) ELSE array() END")
    last = F.struct(F.col("times").alias("epoch"), shard(F.col("times")))
    whole = F.transform(epochs, lambda e: F.struct(e.alias("epoch"), shard(e)))
    whole = F.when(F.col("state") == "whole", F.concat(whole, F.array(last))).otherwise(whole)
    cut = F.when(F.col("state") == "cut", last).alias("cut")
    return sources, staged(blocks.join(small_side(staged(upto)), "rank").select("rank", "block", whole.alias("whole"), cut, "left"))


def with_block(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Append each row's source's columns and its block."""
    named = small_side(sources.withColumnRenamed("source", "__source"))
    block = F.expr(f"pmod(xxhash64(doc_id, row_key, {seed}), blocks)")
    return rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).withColumn("block", block).drop("__source")


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, source, size), staged; ``row_key`` tells rows of one doc_id apart."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return staged(docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("row_key"), "source", size.alias("size")))


def mixed(rows: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, row_key, source, size; staged) to doc_id, row_key, size, source_size, target, placements.

    ``placements``: array of (epoch, shard, words), one for each time that the mix takes
    the document; words are its size but for at most one document of each source, which is cut.
    Every row is placed for itself, repeated ones too.  Sizes of zero are never taken.
    """
    sources, plan = mix_plan(rows, shards, block_words, seed)
    plan = small_side(plan)
    placed = with_block(rows, sources.select("source", "rank", "blocks"), seed).join(plan, ["rank", "block"])
    cut = placed.where("cut IS NOT NULL").withColumn("order", F.xxhash64("doc_id", F.lit(seed + 1)))
    cut = cut.select("rank", "block", "doc_id", "row_key", "size", "left", "order").groupBy("rank")
    cut = cut.applyInPandas(_fill_boundary, "rank long, block long, doc_id long, row_key long, size long, part long")
    whole = F.transform("whole", lambda x: F.struct(x.epoch.alias("epoch"), x.shard.alias("shard"), F.col("size").alias("words")))
    last = F.struct(F.col("cut.epoch").alias("epoch"), F.col("cut.shard").alias("shard"), F.col("part").alias("words"))
    names = ["rank", "doc_id", "row_key", "size", F.filter("placements", lambda x: x.words > 0).alias("placements")]
    done = placed.where("cut IS NULL").withColumn("placements", whole).select(names)
    cut = cut.join(plan, ["rank", "block"])
    cut = cut.withColumn("placements", F.when(F.col("part") > 0, F.concat(whole, F.array(last))).otherwise(whole)).select(names)
    figures = small_side(sources.select("rank", "source_size", "target"))
    return done.unionByName(cut).join(figures, "rank").drop("rank")


def mix(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken, by shards, shuffled within each slice of a shard.

    Large shards are dealt over several tasks, a slice each.  Rows are told apart by their id and a hash of all columns, so
    rows without an id and rows that share one are taken each for itself; the same row repeated is taken as often as all of
    its repeats are.  A document taken in part keeps its first words.  Texts without words are never taken.
    """
    taken = mixed(word_counts(docs), shards, block_words, seed).where(F.size("placements") > 0)
    taken = staged(taken.groupBy("doc_id", "row_key", "size").agg(F.flatten(F.collect_list("placements")).alias("__p"), F.count("*").alias("__n")))
    keyed = docs.withColumn("row_key", row_key(docs))
    names = [c for c in docs.columns]
    wanted = taken.withColumnsRenamed({"size": "__size"})
    joined = keyed.alias("d").join(wanted.alias("t"), same("d", "t", "doc_id", "row_key")).select(*[F.col(f"d.{c}") for c in names], F.col("d.row_key").alias("__key"), "__size", "__p", "__n")
    once = joined.where("__n = 1")
    again = taken.where("__n > 1")
    if not again.isEmpty():
        once = once.unionByName(joined.where("__n > 1").dropDuplicates(["doc_id", "__key"]))
    out = once.withColumn("__p", F.explode("__p"))
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("__p.words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("__p.words") < F.col("__size"), some).otherwise(F.col("text")))
    order = F.xxhash64("__key", "__p.epoch", F.lit(seed + 2))
    words = taken.agg(F.sum(F.aggregate("__p", F.lit(0).cast("long"), lambda a, x: a + x.words))).first()[0] or 0
    part = F.pmod(F.xxhash64("__key", F.lit(seed + 3)), F.lit(-(-words // (shards * SLICE_WORDS)) or 1))
    return out.repartition("__p.shard", part).sortWithinPartitions("__p.shard", part, order).select(names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, and where the splitting tree placed it; null text has size 0.

    ``placements``: array of (epoch, shard, words); rows of one doc_id come each for itself.
    """
    out = mixed(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, x: a + x.words)
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "placements")
