"""Removal of repeated passages: suffixes sorted deep-shallow, where any two can be equal at all.

Two equal strings of 400 bytes choose the same anchor among their 32-byte grams (the least hash, leftmost), so a
string is compared only with strings about the same anchor.  Runs of strings with one anchor are segments; segments
whose anchor comes once are done, as are those that are equal as a whole (128-bit hash).  Only the rest, mostly at
the ends of repeated passages, are sorted: multikey quicksort to 64 bytes, eight bytes at a time, then blind tries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, staged

LENGTH = 400
GRAM = 32
#: Depth of the shallow sort, in eight-byte words.
SHALLOW_WORDS = 8
#: Differing segments of one anchor that are sorted together: at most about 8 MB of text and 1.5 million suffixes.
SORT_SEGMENTS = 8192
#: Segments that a task sorts at once.
_BUFFER = 2000
#: Documents' ids that may be broadcast (16 bytes each).
_IDS = 1_000_000
_CHUNK = (1 << 20) - 4096
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 32-byte gram, built by doubling."""
    h, step = b.astype(np.uint64) + np.uint64(1), 1
    for odd in _ODD:
        h = h[:-step] * np.uint64(odd) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    h *= np.uint64(_ODD[0])
    h ^= h >> np.uint64(32)
    return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w``: the least of a block's end and the next block's beginning."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, anchor, first, last) for each run of string starts ``first``..``last`` with one anchor."""
    n = len(data) - LENGTH + 1
    b, low = np.frombuffer(data, np.uint8), np.uint64((1 << 20) - 1)
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK)
        h = gram_hashes(b[at : end + LENGTH - 1])
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        own = (_window_min(key, LENGTH - GRAM + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        last = np.r_[first[1:], len(own)] - 1
        anchor = own[first]
        yield from zip(h[anchor].view(np.int64).tolist(), (anchor + at).tolist(), (first + at).tolist(), (last + at).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_rows(docs: DataFrame) -> DataFrame:
    """(anchor, s1, s2, doc_id, mark, many, starts): a document's equal segments, of ``many`` strings each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                texts = part["text"].cast(pa.binary()).to_pylist()
                for doc, mark, data in zip(part["doc_id"].to_pylist(), part["mark"].to_pylist(), texts):
                    if data is None or len(data) < LENGTH:
                        continue
                    held: dict[tuple, list[int]] = {}
                    for anchor, _, first, last in segments(data):
                        digest = xxhash.xxh3_128_intdigest(data[first : last + LENGTH])
                        held.setdefault((anchor, digest, last - first + 1), []).append(first)
                    rows += [
                        (a, _signed(d >> 64), _signed(d & (1 << 64) - 1), doc, mark, many, starts) for (a, d, many), starts in held.items()
                    ]
                columns = list(zip(*rows)) or [[]] * 7
                kinds = [*[pa.int64()] * 5, pa.int32(), pa.list_(pa.int32())]
                names = ["anchor", "s1", "s2", "doc_id", "mark", "many", "starts"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.mapInArrow(of, "anchor long, s1 long, s2 long, doc_id long, mark long, many int, starts array<int>")


def cut_segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, s1, s2, at, data): bytes of the segments ``wanted`` (doc_id, mark, anchor, s1, s2, first, many); ``at``: place of the anchor."""
    per = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "s1", "s2", "first", "many")).alias("cuts"))
    ids = small_side(staged(wanted.select("doc_id", "mark").distinct()), _IDS)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("doc_id", "mark")]
    some = docs.alias("d").join(ids.alias("i"), same, "left_semi")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "mark")]
    some = some.alias("d").join(per.alias("p"), same).select("d.text", "p.cuts")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, cuts in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["cuts"].to_pylist()):
                for c in cuts:
                    piece = data[c["first"] : c["first"] + c["many"] - 1 + LENGTH]
                    rows.append((c["anchor"], c["s1"], c["s2"], next(segments(piece))[1], piece))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [*[pa.int64()] * 3, pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "s1", "s2", "at", "data"])

    return some.mapInArrow(of, "anchor long, s1 long, s2 long, at int, data binary")


class _Node:
    __slots__ = ("depth", "branches")

    def __init__(self, depth: int, branches: dict):
        self.depth, self.branches = depth, branches


def _mismatch(a: bytes, b: bytes) -> int:
    low, high = 0, len(a)
    while low < high:  # the first ``low`` bytes agree
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def blind_trie(strings: list[bytes]) -> list[int]:
    """For each of equally long strings, the number of its first equal; a trie that keeps only branching places.

    A string goes down by the bytes at branching places alone and is then compared once, with the leaf it reaches:
    if it differs, the first differing place tells where its own branch belongs.
    """
    root, out = 0, [0] * len(strings)
    for i in range(1, len(strings)):
        s, leaf = strings[i], root
        while isinstance(leaf, _Node):
            leaf = leaf.branches.get(s[leaf.depth], next(iter(leaf.branches.values())))
        if s == strings[leaf]:
            out[i] = leaf
            continue
        out[i], depth, up, node = i, _mismatch(s, strings[leaf]), None, root
        while isinstance(node, _Node) and node.depth < depth:
            up, node = node, node.branches[s[node.depth]]
        if isinstance(node, _Node) and node.depth == depth:
            node.branches[s[depth]] = i
            continue
        new = _Node(depth, {strings[leaf][depth]: node, s[depth]: i})
        if up is None:
            root = new
        else:
            up.branches[s[up.depth]] = new
    return out


def sort_segments(group: list, at: list[int], data: list[bytes]) -> list[np.ndarray]:
    """For each segment, of each of its strings the number of a class of equal strings of its group.

    Strings alone in their class have -1.  ``at``: the anchor's place in each segment.
    """
    starts = np.cumsum([0, *map(len, data)])
    many = np.array([len(d) - LENGTH + 1 for d in data])
    owner = np.repeat(np.arange(len(data)), many)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    place = starts[owner] + within
    seen: dict = {}
    numbers = np.array([seen.setdefault(g, len(seen)) for g in group])
    # equal strings have their anchor at one place
    key = numbers[owner] * np.int64(4096) + (within - np.array(at)[owner] + 2048)
    buffer = b"".join(data) + bytes(8)
    word = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    rows = np.arange(len(owner))
    _, cls, n = np.unique(key, return_inverse=True, return_counts=True)
    rows, cls = rows[n[cls] > 1], cls[n[cls] > 1]
    for depth in range(SHALLOW_WORDS):
        if not len(rows):
            break
        w = word[place[rows] + 8 * depth].astype(np.uint64)
        order = np.lexsort((w, cls))
        rows, cls, w = rows[order], cls[order], w[order]
        new = np.r_[True, (cls[1:] != cls[:-1]) | (w[1:] != w[:-1])]
        cls = np.cumsum(new) - 1
        alone = np.bincount(cls) == 1
        rows, cls = rows[~alone[cls]], cls[~alone[cls]]
    out = np.full(len(owner), -1, np.int64)
    if len(rows):
        bounds = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1], True])
        places, found = place[rows].tolist(), []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            equal = blind_trie([buffer[p + 8 * SHALLOW_WORDS : p + LENGTH] for p in places[a:b]])
            found += [a + e for e in equal]
        found = np.array(found)
        size = np.bincount(found, minlength=len(rows))
        out[rows] = np.where(size[found] > 1, found, -1)
    return np.split(out, np.cumsum(many)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _sorted_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come group by group; out come runs of repeated strings, and for shared-out anchors the classes left to compare."""
    held: list[tuple] = []

    def work() -> pa.RecordBatch:
        classes = sort_segments([(r[0], r[1]) for r in held], [r[5] for r in held], [r[6] for r in held])
        rows, sent = [], set()
        for (anchor, _, parts, s1, s2, _, data), cls in zip(held, classes):
            rows += [(anchor, s1, s2, a, b, None, None, False) for a, b in _runs(cls >= 0)]
            if parts > 1:
                for x, c in enumerate(cls.tolist()):
                    if c < 0 or c not in sent:
                        sent.add(c)
                        h = xxhash.xxh3_128_intdigest(data[x : x + LENGTH])
                        rows.append((anchor, s1, s2, x, x + 1, _signed(h >> 64), _signed(h & (1 << 64) - 1), c >= 0))
        columns = list(zip(*rows)) or [[]] * 8
        kinds = [*[pa.int64()] * 3, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["anchor", "s1", "s2", "from", "to", "w1", "w2", "known"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("anchor", "part", "parts", "s1", "s2", "at", "data"))):
            if len(held) >= _BUFFER and row[:2] != held[-1][:2]:
                yield work()
                held.clear()
            held.append(row)
    if held:
        yield work()


def repeated_ranges(docs: DataFrame, sort_segments: int = SORT_SEGMENTS) -> DataFrame:
    """(doc_id, mark, from, to): byte ranges that hold repeated strings; ranges of a document may overlap.

    ``docs``: doc_id, text, mark (a hash of the text, which tells rows of one doc_id apart).
    """
    rows = staged(segment_rows(docs))
    seg = F.struct("s1", "s2")
    by_anchor = rows.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n"), F.min(seg).alias("least"), F.max(seg).alias("most"))
    by_anchor = by_anchor.where("n > 1").select("anchor", (F.col("least") != F.col("most")).alias("differ"))
    again = staged(rows.join(by_anchor, "anchor"))
    ends = F.struct(F.lit(0).alias("from"), F.col("many").alias("to"))
    whole = again.where("NOT differ").select("doc_id", "mark", "starts", ends.alias("run"))

    differ = again.where("differ")
    distinct = differ.groupBy("anchor", "s1", "s2").agg(
        F.sum(F.size("starts")).alias("n"),
        F.min(F.struct("doc_id", "mark", F.col("starts")[0].alias("first"), "many")).alias("one"),
    )
    distinct = staged(distinct.select("anchor", "s1", "s2", "n", "one.*"))
    per = distinct.groupBy("anchor").agg(F.count("*").alias("m"))
    cut = cut_segments(docs, distinct.drop("n")).join(per, "anchor")
    parts = F.ceil(F.col("m") / sort_segments).cast("int")
    cut = cut.withColumn("parts", parts).withColumn("part", F.expr("cast(pmod(xxhash64(s1, s2), parts) as int)"))
    cut = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part").select("anchor", "part", "parts", "s1", "s2", "at", "data")
    schema = "anchor long, s1 long, s2 long, from int, to int, w1 long, w2 long, known boolean"
    found = staged(cut.mapInArrow(_sorted_parts, schema))
    runs = found.where("w1 IS NULL").select("anchor", "s1", "s2", "from", "to")
    left = found.where("w1 IS NOT NULL")  # of anchors that were shared out: one string for each class of each part
    twice = left.groupBy("anchor", "w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    runs = runs.unionByName(left.where("NOT known").join(twice, ["anchor", "w1", "w2"]).select("anchor", "s1", "s2", "from", "to"))
    wholes = distinct.where("n > 1").select("anchor", "s1", "s2", F.lit(0).alias("from"), F.col("many").alias("to"))
    runs = runs.unionByName(wholes)
    partly = differ.join(runs, ["anchor", "s1", "s2"]).select("doc_id", "mark", "starts", F.struct("from", "to").alias("run"))
    spread = whole.unionByName(partly).select("doc_id", "mark", "run", F.explode("starts").alias("start"))
    return spread.select(
        "doc_id", "mark", (F.col("start") + F.col("run.from")).alias("from"), (F.col("start") + F.col("run.to") + LENGTH - 1).alias("to")
    )


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, data, ranges in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["ranges"].to_pylist()):
            data = data or b""
            gone = merged([(r["from"], r["to"]) for r in ranges or []])
            sha, end = hashlib.sha256(), 0
            for a, b in gone:
                sha.update(data[end:a])
                end = b
            sha.update(data[end:])
            rows.append((doc, len(data), sum(b - a for a, b in gone), len(gone), sha.hexdigest(), [{"from": a, "to": b} for a, b in gone]))
        span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
        kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(span)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def suffix_dedup(docs: DataFrame, sort_segments: int = SORT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of from, to) of every row of ``docs``.

    Every byte that a 400-byte string covers which also starts elsewhere, in the same document or another, is removed;
    all strings are judged on the input.  Null text is empty; texts under 400 bytes lose nothing; repeated rows are
    different documents with equal text.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    ranges = repeated_ranges(docs, sort_segments).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))
    ranges = staged(ranges)
    ids = ranges.select("doc_id", "mark")
    n = ids.count()
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "mark")]
    none = F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges")
    if n <= _IDS:  # texts without repeats stay where they are
        ids = F.broadcast(ids).alias("r")
        touched = docs.alias("d").join(ids, same, "left_semi").alias("d").join(ranges.alias("r"), same).select("d.doc_id", "d.text", "r.ranges")
        both = docs.alias("d").join(ids, same, "left_anti").select("doc_id", "text", none).unionByName(touched)
    else:
        both = docs.alias("d").join(ranges.alias("r"), same, "left").select("d.doc_id", "d.text", "r.ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<from: long, to: long>>"
    return both.mapInArrow(_kept, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")
