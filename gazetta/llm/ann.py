"""Approximate nearest neighbours: a hierarchical k-means tree that grows with the table, searched best bin first.

The top of the tree is fitted on a bounded sample; a region of it that holds more vectors gets a tree of its own, fitted
in a task on a bounded sample of that region, and so on until leaves are small.  Queries go down level by level; how many
regions they keep at each level is set by sample queries whose true neighbours among all vectors are known.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked, small_side, staged

#: Vectors that one tree is fitted on, and their bytes, at most; every vector is indexed.
FIT_VECTORS, FIT_BYTES = 20_000, 32_000_000
#: Children of a node, and fitted vectors from which a node is no longer split.
BRANCHES, LEAF = 8, 128
#: A region with SPLIT times as many vectors gets a tree of its own, at most DEPTH trees deep.
SPLIT, DEPTH = 4, 3
CALIBRATION_QUERIES = 256
RECALL = 0.94
#: Candidates and queries that meet in one task's block.
BLOCK, QUERY_BLOCK = 4096, 2048
_FAN = 1 << 16
_OUT = "query_id long, rank int, vec_id long, score double"


class Tree(NamedTuple):
    centres: np.ndarray  # of all nodes, in the lifted space
    children: list[list[int]]  # empty for a leaf
    leaf: np.ndarray  # number of the leaf, in tree order; -1 for inner nodes


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """One more component makes all norms ``most``: then the largest inner product is the least distance."""
    rest = np.sqrt(np.maximum(0.0, most**2 - (x**2).sum(axis=1)))
    return np.hstack([x, rest[:, None]])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        centres = np.array([x[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(k)])
    return own


def grow(x: np.ndarray, leaf_size: int = LEAF, seed: int = 7) -> Tree:
    """The tree over lifted vectors: nodes are split by k-means until ``leaf_size`` vectors are left."""
    rng, centres, children, leaf = np.random.default_rng(seed), [], [], []

    def node(rows: np.ndarray) -> int:
        at = len(centres)
        centres.append(x[rows].mean(axis=0) if len(rows) else np.zeros(x.shape[1]))
        children.append([])
        leaf.append(-1)
        own = _kmeans(x[rows], BRANCHES, rng) if len(rows) > max(leaf_size, BRANCHES) else np.zeros(len(rows), int)
        groups = [rows[own == g] for g in np.unique(own)]
        if len(groups) < 2:
            leaf[at] = sum(v >= 0 for v in leaf)
        else:
            for g in groups:
                children[at].append(node(g))
        return at

    node(np.arange(len(x)))
    return Tree(np.array(centres), children, np.array(leaf))


def leaves_of(x: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf that each lifted vector falls in."""
    out, todo = np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        kids = tree.children[at]
        if not kids:
            out[rows] = tree.leaf[at]
        elif len(rows):
            c = tree.centres[kids]
            own = ((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(kid, rows[own == i]) for i, kid in enumerate(kids)]
    return out


def bounds(q: np.ndarray, tree: Tree) -> np.ndarray:
    """For each query and leaf the largest distance on the way down to it: best bin first opens leaves in this order."""
    cost = (tree.centres**2).sum(axis=1) - 2 * q @ tree.centres.T
    for at, kids in enumerate(tree.children):  # parents come before their children
        for kid in kids:
            cost[:, kid] = np.maximum(cost[:, kid], cost[:, at])
    out = np.empty((len(q), int(tree.leaf.max()) + 1))
    out[:, tree.leaf[tree.leaf >= 0]] = cost[:, tree.leaf >= 0]
    return out


def best_bins(far: np.ndarray, tree: Tree, more) -> list[tuple[int, float]]:
    """Leaves best bin first: the nearest open node is opened next from a priority queue, while ``more(leaves so far, next bound)``.

    ``far``: the distance of each node.  With each leaf comes the largest distance opened until then.
    """
    queue, found, bound = [(far[0], 0)], [], -np.inf
    while queue and more(found, max(bound, queue[0][0])):
        value, at = heapq.heappop(queue)
        bound = max(bound, value)
        if tree.children[at]:
            for kid in tree.children[at]:
                heapq.heappush(queue, (far[kid], kid))
        else:
            found.append((int(tree.leaf[at]), float(bound)))
    return found


def usable(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(vec_id, v, asked) of the rows whose vector has no null or non-finite component and is not zero; v is an array of doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    asked = F.coalesce(is_query, F.lit(False)).alias("asked")
    return vectors.where(F.col("vec_id").isNotNull()).where(ok).select(F.col("vec_id").cast("long"), v.alias("v"), asked)


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sums of the rows' products in component order, so that equal vectors have equal scores wherever they are computed."""
    out = np.zeros(np.broadcast_shapes(q.shape, c.shape)[:-1])
    for d in range(q.shape[-1]):
        out += q[..., d] * c[..., d]
    return out


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def _numbers(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _least_kept(near: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """For each row the value from which entries may be among its ``k`` largest, rounding allowed for."""
    if near.shape[1] <= k:
        return np.full(len(near), -np.inf)
    kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    return np.where(np.isfinite(kth), kth - slack, -np.inf)


def best_pairs(q: np.ndarray, c: np.ndarray, ids: np.ndarray, meets: list[tuple[np.ndarray, slice]], k: int) -> tuple:
    """(query row, id, score) of the ``k`` best of each query among the candidates it ``meets``, ties to the smaller id.

    Matrix products choose, with room for their rounding; sums in component order decide.
    """
    with np.errstate(all="ignore"):
        slack = np.nan_to_num(1e-12 * np.sqrt((q**2).sum(axis=1)) * np.sqrt((c**2).sum(axis=1).max(initial=0)), posinf=np.inf)
        rows, cols, about = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
        for of, some in meets:
            near = np.nan_to_num(q[of] @ c[some].T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            r, s = np.nonzero(near >= _least_kept(near, k, slack[of])[:, None])
            rows.append(of[r])
            cols.append(s + some.start)
            about.append(near[r, s])
        rows, cols, about = map(np.concatenate, (rows, cols, about))
        order = np.lexsort((-about, rows))
        rows, cols, about = rows[order], cols[order], about[order]
        first = np.searchsorted(rows, rows)
        kth = about[np.minimum(first + k - 1, len(rows) - 1)]  # of a query with fewer than k, another's: then all are kept
        few = np.searchsorted(rows, rows, side="right") - first <= k
        keep = few | ~np.isfinite(kth) | (about >= kth - slack[rows])
        rows, cols = rows[keep], cols[keep]
        score = inner_products(q[rows], c[cols])
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    keep = (np.arange(len(rows)) - np.searchsorted(rows, rows) < k) & ~np.isnan(score)
    return rows[keep], ids[cols[keep]], score[keep]


def _table(names: list[str], *columns) -> pa.Table:
    return pa.table(dict(zip(names, columns)))


def _search_block(cand: pa.Table, asked: pa.Table, k: int, dim: int) -> pa.Table:
    region = _numbers(cand["region"])
    order = np.lexsort((_numbers(cand["vid"]), region))
    c, ids, region = _matrix(cand["v"], dim)[order], _numbers(cand["vid"])[order], region[order]
    q, mine = _matrix(asked["v"], dim), _numbers(asked["vid"])
    lists = asked["regions"].combine_chunks()
    wants, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
    by = np.argsort(wants, kind="stable")
    wants, of = wants[by], of[by]
    names, start = np.unique(region, return_index=True)
    end = np.r_[start[1:], len(region)]
    lo, hi = np.searchsorted(wants, names), np.searchsorted(wants, names, side="right")
    meets = [(of[a:b], slice(s, e)) for a, b, s, e in zip(lo, hi, start, end) if b > a]
    rows, near, score = best_pairs(q, c, ids, meets, k)
    return _table(["qvid", "cvid", "score"], mine[rows], near, score)


def _all_of_one_length(rows: pa.Table, k: int) -> pa.Table:
    """Every pair of the few vectors of a length that is not the tables' common one."""
    dim, ids = rows["d"][0].as_py(), _numbers(rows["vec_id"])
    order = np.argsort(ids, kind="stable")
    x, ids, asked = _matrix(rows["v"], dim)[order], ids[order], np.asarray(rows["asked"].to_pylist())[order]
    mine = ids[asked]
    at, near, score = best_pairs(x[asked], x, ids, [(np.arange(len(mine)), slice(0, len(x)))] if len(mine) else [], k + 1)
    other = near != mine[at]
    at, near, score = at[other], near[other], score[other]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    keep = rank < k
    return _table(["query_id", "rank", "vec_id", "score"], mine[at[keep]], (rank[keep] + 1).astype(np.int32), near[keep], score[keep])


class Index(NamedTuple):
    """Vectors (vid, v, path, region) in small regions; ``path``: the regions from the top down, the last being ``region``."""

    placed: DataFrame
    top: Tree
    below: list[DataFrame]  # (region, tree) of each further level
    scale: float
    most: float
    dim: int

    def lift(self, column, queries: bool = False) -> np.ndarray:
        x = _matrix(column, self.dim) / self.scale
        return np.hstack([x, np.zeros((len(x), 1))]) if queries else lifted(x, self.most)


def _with_trees(rows: DataFrame, trees: DataFrame, key: str, f, schema: str) -> DataFrame:
    """``f(rows, tree, split)`` for the rows of each region and its tree; a region with many rows is dealt over several tasks.

    ``trees`` has the columns ``n``, the number of rows of its region, and perhaps ``split``, the leaves that have trees themselves.
    """
    salts = F.ceil(F.col("n") / (16 * BLOCK)).cast("int")
    known = small_side(trees.select("region", salts.alias("salts")))
    left = rows.join(known, "region").withColumn("salt", F.pmod(F.xxhash64(key), F.col("salts")).cast("int")).drop("salts")
    split = F.coalesce("split", F.array().cast("array<long>")) if "split" in trees.columns else F.array().cast("array<long>")
    right = trees.select("region", "tree", split.alias("split"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    both = left.groupBy("region", "salt").cogroup(right.groupBy("region", "salt"))
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    none = pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in schema.split(", "))]).empty_table()

    def apply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return none
        return f(a, pickle.loads(b["tree"][0].as_py()), frozenset(b["split"][0].as_py()))

    return both.applyInArrow(apply, schema)


def build_index(vectors: DataFrame, dim: int, fit_vectors: int = FIT_VECTORS, leaf: int = LEAF) -> Index:
    """Index the distinct ``vectors`` (vid, v; staged), all of length ``dim``."""
    spark = vectors.sparkSession
    scale = vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    scaled = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale))
    most = vectors.agg(F.max(F.sqrt(scaled))).first()[0]
    n_fit = max(2, min(fit_vectors, FIT_BYTES // (8 * dim)))
    sample = vectors.orderBy(F.xxhash64("vid"), "vid").limit(n_fit).select("v").toArrow()
    index = Index(vectors, None, [], scale, most, dim)
    index = index._replace(top=grow(index.lift(sample["v"]), leaf))
    bare = index._replace(placed=None)  # what tasks need of it
    shared = spark.sparkContext.broadcast(bare)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = leaves_of(shared.value.lift(b["v"]), shared.value.top)
            path = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32), pa.array(own))
            yield pa.RecordBatch.from_arrays([b["vid"], b["v"], path, pa.array(own)], names=["vid", "v", "path", "region"])

    schema, below = "vid long, v array<double>, path array<long>, region long", []
    placed = staged(vectors.mapInArrow(place, schema))
    bare = bare._replace(top=None)
    for _ in range(DEPTH - 1):
        many = staged(placed.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT * leaf))
        if many.isEmpty():
            break
        some = placed.join(small_side(many), "region").where(F.pmod(F.xxhash64("vid", F.lit(1)), F.ceil(F.col("n") / n_fit)) == 0)

        def fit(key, rows):
            tree = grow(bare.lift(rows["v"]), leaf)
            return _table(["region", "tree", "n", "leaves"], [key[0].as_py()], pa.array([pickle.dumps(tree)], pa.binary()), [rows["n"][0].as_py()], [int(tree.leaf.max()) + 1])

        trees = staged(some.groupBy("region").applyInArrow(fit, "region long, tree binary, n long, leaves long").where("leaves > 1").drop("leaves"))

        def assign(rows, tree, _):
            own = leaves_of(bare.lift(rows["v"]), tree)
            child = (_numbers(rows["region"]) + 1) * _FAN + own
            path = [[*p, c] for p, c in zip(rows["path"].to_pylist(), child.tolist())]
            return _table(["vid", "v", "path", "region"], rows["vid"], rows["v"], pa.array(path, pa.list_(pa.int64())), child)

        rest = placed.join(small_side(trees.select("region")), "region", "left_anti").select("vid", "v", "path", "region")
        placed = staged(rest.unionByName(_with_trees(placed, trees, "vid", assign, schema)))
        below.append(trees)
    return index._replace(placed=placed, below=below)


def blocks_of(index: Index) -> tuple[dict[int, tuple[int, int]], np.ndarray]:
    """(first block, blocks) of each region of the top tree, and the regions' sizes; the fitted sample bounds their number.

    Neighbouring regions share a block; a large one has several, by the numbers of the regions within it.
    """
    tops = sorted(index.placed.groupBy(F.col("path")[0].alias("top")).count().collect())
    out, sizes, block, filled = {}, np.zeros(int(index.top.leaf.max()) + 1, np.int64), 0, 0
    for top, n in tops:
        if filled and filled + n > BLOCK:
            block, filled = block + 1, 0
        out[top], sizes[top] = (block, -(-n // BLOCK)), n
        filled += n
        if n > BLOCK:
            block, filled = block + out[top][1], 0
    return out, sizes


_ROUTE = "vid long, block long, regions array<long>, deeper long, stop double, least long"


def _route_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["vid", "block", "regions", "deeper", "stop", "least"])


def _shared_out(vid: int, leaves: list[int], top_of, blocks: dict, split: frozenset, stop: float, least: list[int]) -> list[tuple]:
    """Rows of one query: a block's regions together; regions that have a tree of their own each to be gone down further."""
    per: dict[int, list[int]] = {}
    rows = []
    for leaf, need in zip(leaves, least):
        if leaf in split:
            rows.append((vid, None, None, leaf, stop, need))
        else:
            first, parts = blocks[top_of(leaf)]
            per.setdefault(first + leaf % parts, []).append(leaf)
    return rows + [(vid, block, regions, None, None, None) for block, regions in per.items()]


def routes(index: Index, queries: DataFrame, visits: int, least: int, blocks: dict, sizes: np.ndarray) -> DataFrame:
    """(vid, block, regions): the regions in which each query (vid, v; staged) is searched, those of one block together.

    A query opens ``visits`` regions of the top tree, and more until they hold ``least`` vectors.  How far it had to go for
    the last of them is where it stops within regions that have trees of their own.
    """
    context = queries.sparkSession.sparkContext
    bare = index._replace(placed=None, below=[])
    # regions with trees are as many as the level above has large leaves: the level's table is joined on them below the top
    split = frozenset(r[0] for r in index.below[0].select("region").collect()) if index.below else frozenset()
    shared = context.broadcast((bare, visits, blocks, sizes, split))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, visits, blocks, sizes, split = shared.value
        for b in batches:
            q, rows = of.lift(b["v"], queries=True), []
            far = (of.top.centres**2).sum(axis=1) - 2 * q @ of.top.centres.T
            for vid, d in zip(b["vid"].to_pylist(), far):
                held, need = [0], []

                def more(found, _):
                    if len(found) > len(need):  # one more was opened
                        own = found[-1][0]
                        need.append(least if own in split and held[0] < least else 0)
                        held[0] += max(need[-1], 0 if own in split else int(sizes[own]))
                    return len(found) < visits or held[0] < least

                found = best_bins(d, of.top, more)
                need += [0] * (len(found) - len(need))
                rows += _shared_out(vid, [x[0] for x in found], lambda r: r, blocks, split, found[-1][1], need)
            yield _route_rows(rows)

    out = staged(queries.mapInArrow(start, _ROUTE))
    done = out.where("deeper IS NULL").select("vid", "block", "regions")
    bare = bare._replace(top=None)
    for level, trees in enumerate(index.below):
        asked = staged(out.where("deeper IS NOT NULL").groupBy(F.col("deeper").alias("region")).agg(F.count("*").alias("n")))
        if level + 1 < len(index.below):
            children = index.below[level + 1].select("region", F.shiftright("region", 16).alias("up"))
            children = children.groupBy((F.col("up") - 1).alias("region")).agg(F.collect_set("region").alias("split"))
            with_n = trees.drop("n").join(asked, "region").join(children, "region", "left")
        else:
            with_n = trees.drop("n").join(asked, "region").withColumn("split", F.array().cast("array<long>"))
        inner = out.where("deeper IS NOT NULL").select("vid", F.col("deeper").alias("region"), "stop", "least").join(queries, "vid")

        def down(rows, tree, split):
            of = rows["region"][0].as_py()
            top, q, out = of, bare.lift(rows["v"], queries=True), []
            while top >= _FAN:
                top = (top >> 16) - 1
            far = (tree.centres**2).sum(axis=1) - 2 * q @ tree.centres.T
            for vid, stop, least, d in zip(rows["vid"].to_pylist(), rows["stop"].to_pylist(), rows["least"].to_pylist(), far):
                found = best_bins(d, tree, lambda found, bound: bound <= stop or len(found) < least)  # noqa: B023
                need = [least if i == 0 else 0 for i in range(len(found))]
                out += _shared_out(vid, [(of + 1) * _FAN + x[0] for x in found], lambda _: top, blocks, split, stop, need)  # noqa: B023
            return pa.Table.from_batches([_route_rows(out)])

        out = staged(_with_trees(inner, staged(with_n), "vid", down, _ROUTE))
        done = done.unionByName(out.where("deeper IS NULL").select("vid", "block", "regions"))
    return done.groupBy("vid", "block").agg(F.flatten(F.collect_list("regions")).alias("regions"))


def nearest_of_all(index: Index, sample: list, k: int) -> DataFrame:
    """(qvid, cvid, path): the ``k`` nearest other vectors of the sample queries (vid, v), from products with all vectors."""
    q, own = np.array([r["v"] for r in sample], float).reshape(-1, index.dim), np.array([r["vid"] for r in sample], np.int64)
    shared, dim = index.placed.sparkSession.sparkContext.broadcast((q, own)), index.dim

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        best, rows, kept = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64), [[]]
        ids, paths, base = [], [], 0
        for b in batches:
            near = q @ _matrix(b["v"], dim).T
            new = b["vid"].to_numpy()
            near[own[:, None] == new[None, :]] = -np.inf
            both = np.hstack([best, near])
            number = np.hstack([rows, np.broadcast_to(np.arange(base, base + len(new)), near.shape)])
            at = np.argpartition(-both, min(k, both.shape[1] - 1), axis=1)[:, :k]
            best, rows = np.take_along_axis(both, at, axis=1), np.take_along_axis(number, at, axis=1)
            ids.append(new)
            paths.append(b["path"])
            base += len(new)
        if base:
            r, c = np.nonzero((best > -np.inf) & (rows >= 0))
            path = pa.concat_arrays(paths).take(pa.array(rows[r, c]))
            columns = [pa.array(own[r]), pa.array(np.concatenate(ids)[rows[r, c]]), path, pa.array(best[r, c])]
            yield pa.RecordBatch.from_arrays(columns, names=["qvid", "cvid", "path", "score"])

    found = index.placed.select("vid", "v", "path").mapInArrow(of, "qvid long, cvid long, path array<long>, score double")
    order = Window.partitionBy("qvid").orderBy(F.desc("score"), "cvid")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("qvid", "cvid", "path")


def calibrated(index: Index, queries: DataFrame, k: int, recall: float) -> int:
    """How many regions of the top tree queries open: widened until sample queries reach ``recall`` of their true neighbours."""
    sample = queries.orderBy(F.xxhash64("vid", F.lit(2)), "vid").limit(CALIBRATION_QUERIES).collect()
    truth = staged(nearest_of_all(index, sample, k))
    x = np.array([r["v"] for r in sample], float) / index.scale
    reach = bounds(np.hstack([x, np.zeros((len(x), 1))]), index.top)
    number = {r["vid"]: i for i, r in enumerate(sample)}
    found = {(r["qvid"], r["cvid"]): reach[number[r["qvid"]], r["path"][0]] for r in truth.collect()}  # at most k for each sample query
    few, bare = staged(queries.where(F.col("vid").isin([r["vid"] for r in sample]))), index._replace(placed=None, below=[], top=None)
    for level, trees in enumerate(index.below):
        inner = truth.where(F.size("path") > level + 1).join(few.withColumnRenamed("vid", "qvid"), "qvid")
        inner = inner.withColumn("region", F.col("path")[level]).withColumn("leaf", F.col("path")[level + 1].bitwiseAND(_FAN - 1))

        def reached(rows, tree, _):
            own = bounds(bare.lift(rows["v"], queries=True), tree)[np.arange(rows.num_rows), _numbers(rows["leaf"])]
            return _table(["qvid", "cvid", "bound"], _numbers(rows["qvid"]), _numbers(rows["cvid"]), own)

        for r in _with_trees(inner, trees, "qvid", reached, "qvid long, cvid long, bound double").collect():
            found[r["qvid"], r["cvid"]] = max(found[r["qvid"], r["cvid"]], r["bound"])
    if not found:
        return 1
    reach.sort(axis=1)
    need = np.sort([np.searchsorted(reach[number[q]], bound) + 1 for (q, _), bound in found.items()])
    return int(min(need[max(1, int(np.ceil(recall * len(need)))) - 1], reach.shape[1]))


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, fit_vectors: int = FIT_VECTORS, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds, its ``k`` nearest found among all other rows.

    Nearness is the inner product in double precision, ties go to the smaller vec_id.  Vectors that are null, zero, or
    hold null or non-finite components take no part.  Vectors have inner products with those of their own length: each
    length of more than BLOCK rows, and the commonest, has a tree; the few of another length are compared with each other.
    Fewer than ``k`` candidates: all of them.  Repeated rows of one vec_id and vector are one; one vec_id with several vectors
    is searched for each, and never finds its own id.  Other columns are not read.  Copies of a vector are searched once: only the ``k`` + 1 smallest ids of one can be results.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors, is_query))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    if not lengths:
        return spark.createDataFrame([], _OUT)
    common = [r["d"] for r in lengths[:1]] + [r["d"] for r in lengths[1:] if r["count"] > BLOCK]
    out = None
    for dim in common:
        one = _search_length(rows.where(F.size("v") == dim), dim, k, recall, fit_vectors, leaf)
        out = one if out is None else out.unionByName(one)
    if len(common) < len(lengths):
        rest = rows.withColumn("d", F.size("v")).where(~F.col("d").isin(common))
        out = out.unionByName(rest.groupBy("d").applyInArrow(lambda t: _all_of_one_length(t, k), _OUT))
    return out


def _search_length(rows: DataFrame, dim: int, k: int, recall: float, fit_vectors: int, leaf: int) -> DataFrame:
    spark = rows.sparkSession
    turn = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.select("vec_id", "v").withColumn("turn", turn).where(F.col("turn") <= k + 1)
    distinct = staged(few.groupBy("v").agg(F.min("vec_id").alias("vid"), F.array_sort(F.collect_set("vec_id")).alias("ids")))
    if not distinct.groupBy("vid").count().where("count > 1").isEmpty():  # one id, several vectors: number the vectors by least id
        distinct = staged(ranked(distinct.withColumnRenamed("vid", "least"), ["least", F.xxhash64("v")], "vid").drop("least"))
    vectors = distinct.select("vid", "v")
    asked = staged(rows.where("asked").join(vectors, "v").select(F.col("vec_id").alias("query_id"), "vid").distinct())
    queries = staged(vectors.join(asked.select("vid").distinct(), "vid"))
    if queries.isEmpty():
        return spark.createDataFrame([], _OUT)
    index = build_index(vectors, dim, fit_vectors, leaf)
    blocks, sizes = blocks_of(index)
    probes = staged(routes(index, queries, calibrated(index, queries, k, recall), k + 1, blocks, sizes))
    where = F.broadcast(spark.createDataFrame([(top, *b) for top, b in blocks.items()], "top long, first long, blocks long"))
    cand = index.placed.select("vid", "v", "region", F.col("path")[0].alias("top")).join(where, "top")
    cand = cand.select("vid", "v", "region", F.expr("first + region % blocks").alias("block"))
    parts = F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts")
    parts = small_side(staged(probes.groupBy("block").agg(parts)))
    cand = cand.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    probes = probes.join(parts, "block").join(queries, "vid").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")).drop("parts")

    def block_pairs(c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return _table(["qvid", "cvid", "score"], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return _search_block(c, q, k + 1, dim)

    pairs = cand.groupBy("block", "part").cogroup(probes.groupBy("block", "part")).applyInArrow(block_pairs, "qvid long, cvid long, score double")
    nearest = Window.partitionBy("qvid").orderBy(F.desc("score"), "cvid")
    pairs = pairs.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    each = pairs.join(distinct.select(F.col("vid").alias("cvid"), "ids"), "cvid").select("qvid", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("qvid").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = each.groupBy(F.col("qvid").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    own = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k)
    out = asked.join(lists, "vid").select("query_id", F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``embeddings`` whose vec_id is divisible by 20; ``search`` states the odd cases."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
