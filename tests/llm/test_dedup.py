"""Exact, near and passage dedup against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from gazetta.llm import common, exact_dedup, simhash, suffix_dedup
from pyspark.sql import functions as F

from ..conftest import SMALL


def as_tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_exact_dedup_as_sql(spark, duck):
    out = exact_dedup.op8_exact_dedup(spark, SMALL)
    cur = duck.execute(exact_dedup.OP8_SQL)
    at = [[d[0] for d in cur.description].index(c) for c in out.columns]
    assert as_tuples(out, *out.columns) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


def test_exact_dedup_of_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd_docs).where("doc_id IS NOT NULL").collect()}
    assert {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True)} <= got  # the blank text has the most characters
    assert {(6, 7, 4, False), (7, 7, 4, True), (8, 7, 4, False)} <= got
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns and sorted((r.doc_id or 0, (r.text or "")[:7]) for r in kept.collect()) == [(0, "no id"), (3, " \t\n "), (4, "one"), (5, "word0 a"), (7, "same  t"), (9, "Ünï çöd")]


def test_rows_without_ids_and_of_one_id_lose_no_text(spark):
    """Equal texts, ids null or shared by different texts, and one row repeated."""
    rows = [(None, "a long  one"), (1, "a long one"), (2, "two"), (2, "three"), (2, "three"), (None, "four"), (None, "four"), (None, " four"), (3, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = lambda df: sorted((r.doc_id or 0, r.text) for r in df.collect())
    assert plain(exact_dedup.drop_copies(df)) == [(0, " four"), (0, "a long  one"), (2, "three"), (2, "two")]
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    assert got == {
        (None, sha("alongone")): (None, 2), (1, sha("alongone")): (None, 2), (2, sha("two")): (2, 2), (3, sha("two")): (2, 2),
        (2, sha("three")): (2, 2), (None, sha("four")): (None, 3),
    }
    far = [(None, "x y z"), (5, "x y z"), (None, "quite another text of words"), (6, "one two three"), (6, "many more words than that here"), (6, "one two three")]
    df = spark.createDataFrame(far, "doc_id long, text string").repartition(3)
    assert plain(simhash.keep_one(df)) == [(0, "quite another text of words"), (5, "x y z"), (6, "many more words than that here"), (6, "one two three")]


def test_chains_tell_texts_of_one_key_apart(spark):
    """Keys of 3 bits, so that buckets have long chains: bytes and the directory must find each class."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(6))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = lambda c: F.shiftleft(F.pmod(F.xxhash64(c), F.lit(8)), 61)
    classes, got = {}, {r.doc_id: r for r in exact_dedup.exact_dedup(df, 2, few).collect()}
    for i, t in enumerate(texts):
        classes.setdefault(t.replace(" ", ""), []).append(i)
    for ids in classes.values():
        keep = min(ids, key=lambda i: (-len(texts[i]), i))
        assert all((got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(ids), i == keep) for i in ids)
    assert len({r.bucket for r in got.values()}) > 1


def test_rows_find_their_class_by_the_directory_only(spark, monkeypatch):
    """A directory that leads some keys to another bucket when rows look theirs up, or has no slot for them, loses these rows."""
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(120)], "doc_id long, text string")
    whole, build, directory = exact_dedup.exact_dedup(df, 4), exact_dedup.build_index, exact_dedup.directory
    assert whole.count() == 120 and whole.select("bucket").distinct().count() > 4

    def holes(keys, bucket_keys):
        slots, depth = directory(keys, bucket_keys)
        return slots.where("slot % 4 > 0"), depth

    def misled(entries, texts, bucket_keys):
        index, placed = build(entries, texts, bucket_keys)
        return index, placed.withColumn("bucket", F.when(F.col("h") % 2 == 0, F.col("bucket") + 1).otherwise(F.col("bucket")))

    for name, wrong in (("directory", holes), ("build_index", misled)):
        monkeypatch.setattr(exact_dedup, name, wrong)
        assert 0 < exact_dedup.exact_dedup(df, 4).count() < 120
        monkeypatch.undo()


def test_owner_tasks_hold_ranges_of_buckets(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    rows = df.select("doc_id", F.xxhash64("text").alias("h"), F.lit(1).alias("row_key"), F.lit(1).alias("code_points"), F.lit("").alias("text_sha256"))
    index, _ = exact_dedup.build_index(rows, rows.withColumn("norm", F.lit("")), 8)
    held = index.groupBy(F.input_file_name().alias("f")).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(held, held[1:]))


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS h")
    slots, depth = exact_dedup.directory(keys, 80)
    held = keys.withColumn("slot", exact_dedup._prefix(F.col("h"), F.lit(depth))).join(slots, "slot").groupBy("bucket", "local_depth").count().collect()
    assert sum(r["count"] for r in held) == 5000 and max(r["count"] for r in held) <= 80
    assert slots.count() == 1 << depth and len({r["local_depth"] for r in held}) > 1
    one = spark.createDataFrame([(-5,)], "h long")
    assert exact_dedup.directory(one, 1)[1] == 0 and exact_dedup.directory(one, 1)[0].count() == 1


def plain_components(fps, ids):
    fps, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 2):
            parent[find(i + 1 + int(j))] = find(i)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint_by_its_words():
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for t in (None, "", " ", "A", "a B", "x y Z w", "É é\x0bb \x85c", "a a a a a", "\x1c q\x1d r"):
        assert simhash.fingerprint(t) == plain(t)


def test_simhash_query_against_all_pairs(spark):
    rows = sorted(simhash.op1_simhash(spark, SMALL).collect(), key=lambda r: r.doc_id)
    assert [r.component_id for r in rows] == plain_components([int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows])


def test_links_in_small_and_large_cells(spark):
    rng, fps = random.Random(1), set()
    for _ in range(700):
        x = (0x0123456789ABCDEF, 0xFFFF0000FFFF0000)[rng.randrange(2)]
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    nodes = common.staged(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, id long"))
    for cell in (4, 10_000):
        got = {r.id: r.component for r in common.components(nodes.select("id"), simhash.links(nodes, cell)).collect()}
        assert [got[i] for i in range(len(fps))] == plain_components(fps, list(range(len(fps))))


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(2)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)] + [(-1, 0), (-1, -1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.selectExpr("a", "b", "bit_count(a ^ b) AS hamming").withColumn("l1", simhash.manhattan(simhash.embedding(df.a), simhash.embedding(df.b)))
    for r in got.collect():
        x, y = r.a % (1 << 64), r.b % (1 << 64)
        assert r.l1 == sum(abs((x >> i & 3).bit_count() - (y >> i & 3).bit_count()) for i in range(0, 64, 2)) <= r.hamming


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (8, 6), (None, None)} <= got  # the row without an id is alone
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 9]


def plain_passages(texts, n=400):
    data = [(t or "").encode() for t in texts]
    starts = [[xxhash.xxh3_128_intdigest(d[i : i + n]) for i in range(len(d) - n + 1)] for d in data]
    seen, out = Counter(h for s in starts for h in s), []
    for d, s in zip(data, starts):
        gone = suffix_dedup.merged([(i, i + n) for i, h in enumerate(s) if seen[h] > 1])
        kept = bytearray(d)
        for a, b in reversed(gone):
            del kept[a:b]
        out.append((len(d), sum(b - a for a, b in gone), len(gone), hashlib.sha256(bytes(kept)).hexdigest()))
    return out


def check_passages(df, sort_segments=suffix_dedup.SORT_SEGMENTS):
    rows = sorted(suffix_dedup.suffix_dedup(df, sort_segments).collect(), key=lambda r: (r.doc_id, r.kept_sha256))
    texts = sorted(df.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    want = plain_passages([r.text for r in texts])
    want = sorted(zip([r.doc_id for r in texts], want), key=lambda x: (x[0], x[1][3]))
    assert [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows] == want
    return sum(r.n_removed for r in rows)


def test_passages_against_all_strings(spark):
    assert check_passages(spark.read.parquet(f"{SMALL}/documents.parquet")) > 0


def test_passages_at_edges_and_shared_by_many(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))
    shared = [words(130), words(80)]
    docs = [f"{words(rng.randint(3, 60))} {rng.choice(shared)[rng.randint(0, 20) :]} {words(rng.randint(3, 40))}" for _ in range(320)]
    docs += ["a" * 3000, "ab" * 600, None, "", shared[0], shared[0][:400], shared[0][1:401], "é" * 500, docs[0], docs[0]]
    for i in range(10):  # one byte changed
        docs.append(docs[i][:50] + "#" + docs[i][51:])
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert check_passages(df) == check_passages(df, 20) > 0  # an anchor's segments in one part, and in many


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    """Documents with nothing else in common: bytes decide, not words; ``n_bytes`` is the text's length and tells of no passage."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = {400: words(55) + "x" * 16, 399: words(55) + "x" * 15, 356: words(51), 0: ""}  # with what stands around them, no byte more in common
    docs = [(n, f"{words(70)} {c}{text}{c} {words(70)}") for n, text in shared.items() for c in "PQRS"]
    assert all(len(text) == n for n, text in shared.items())
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == {i: (len(text), 400 if n == 400 else 0, int(n == 400)) for i, (n, text) in enumerate(docs)}
    assert check_passages(df) == 4 * 400


def test_passages_of_odd_rows(odd_docs, no_docs):
    check_passages(odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    assert suffix_dedup.suffix_dedup(odd_docs).count() == odd_docs.count() and suffix_dedup.suffix_dedup(no_docs).count() == 0


def test_blind_trie_finds_equals():
    rng = random.Random(4)
    for _ in range(50):
        base = ["".join(rng.choice("ab") for _ in range(8)).encode() for _ in range(rng.randint(1, 30))]
        got = suffix_dedup.blind_trie(base)
        assert [base[g] for g in got] == base and all(base.index(s) == g for s, g in zip(base, got))


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n_edges in (0, 60, 200):
        edges, parent = [(rng.randrange(150), rng.randrange(150)) for _ in range(n_edges)], list(range(150))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        df = spark.createDataFrame(edges, "a long, b long")
        for hot in (2, 10**9):  # nodes with many neighbours joined where their edges are, or none
            assert {r.id: r.component for r in common.components(spark.range(150), df, hot=hot).collect()} == {i: find(i) for i in range(150)}
