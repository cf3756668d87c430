"""Nearest neighbours, mixing and packing against brute force, and the pipeline as a whole."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from gazetta.llm import ann, mixing, packing
from pyspark.sql import functions as F

from ..conftest import SMALL


def test_recall_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found, hits, want = ann.op5_ann(spark, SMALL).collect(), 0, 0
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    for q in np.flatnonzero(ids % 20 == 0):
        s = ann.inner_products(x[q : q + 1], x)
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        got = by[int(ids[q])]
        assert len(got) == 20 and got == sorted(got, key=lambda v: (-v[1], v[0]))
        at = {int(i): k for k, i in enumerate(ids)}
        assert all(score == s[at[v]] for v, score in got)
        hits, want = hits + len({v for v, _ in got} & {int(i) for i in ids[best]}), want + 20
    assert hits / want >= 0.9


def plain_nearest(rows, k):
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            ids, alike = zip(*[(j, w) for j, w in rows if j != i and len(w) == len(v)])
            near = ann.inner_products(np.array([v]), np.array(alike))
            out[i] = [(ids[j], float(near[j])) for j in np.lexsort((ids, -near))[:k]]
    return out


def found_by_query(df):
    by = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    return by


def test_a_tree_deeper_than_its_sample(spark):
    """More vectors than the fit takes: regions are split in tasks, twice, and recall holds against all pairs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[rng.integers(40)] + 0.4 * rng.normal(size=12)).tolist()) for i in range(3000)]
    # names that clash with the operator's own
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "vec_id long, embedding array<double>, v int, region int, path int, block int, asked int")
    want = plain_nearest(rows, 20)
    got = found_by_query(ann.search(df, F.col("vec_id") % 20 == 0, 20, fit_vectors=60, leaf=4))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_many_copies_and_equal_scores_are_exact(spark):
    rows = [(i, [1.0, 0.0, float(i % 3)]) for i in range(1, 900)] + [(1000 + i, [0.5, 0.5, 0.0]) for i in range(300)]
    rows += [(2000, [1.0, 2.0]), (2001, [1.0, 1.0]), (2002, [-1.0, 4.0])]  # of another length
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_by_query(ann.search(df, F.col("vec_id") % 20 == 0, 20)) == plain_nearest(rows, 20)
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(twice, F.col("vec_id") == 20).collect()) == [(20, 1, 3), (20, 1, 3)]


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [float("nan"), 1.0, 1.0]), (260, [float("inf"), 1.0, 0.0]), (280, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert {r.query_id for r in out} == {0, 20, 40, 100, 120}
    assert not {r.vec_id for r in out} & {200, 220, 240, 260, 280} and all(r.query_id != r.vec_id for r in out)
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in few] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert ann.search(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_mix_comes_to_its_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    rows = mixing.word_counts(docs)
    out = {r.doc_id: r for r in mixing.mixed(rows, shards=5, block_words=500).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for d, r in out.items():
        sizes[source[d]] += r["size"]
        taken[source[d]] += sum(p.words for p in r.placements)
        assert sum(p.words for p in r.placements) <= 3 * r["size"]
    want = plain_targets(sizes)
    for d, r in out.items():
        assert r.source_size == sizes[source[d]] and r.target == pytest.approx(want[source[d]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = {r.doc_id: r for r in mixing.mixed(rows, shards=5, block_words=500).collect()}
    assert again == out
    mixed = mixing.mix(docs, 5, 500)
    assert mixed.columns == docs.columns and mixing.word_counts(mixed).agg(F.sum("size")).first()[0] == sum(taken.values())


def test_quotas_are_split_exactly():
    quota, sizes = np.array([50, 20, 0, 7]), np.array([20, 19, 19, 19])
    drawn = mixing.split_quotas(quota, sizes, [1])
    assert (drawn.sum(axis=0) == quota).all() and (drawn.sum(axis=1) == sizes).all() and (drawn >= 0).all()
    mean = np.mean([mixing.split_quotas(quota, sizes, [s])[0] for s in range(300)], axis=0)
    assert np.allclose(mean, quota * 20 / 77, atol=0.5)


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mixed(mixing.word_counts(odd_docs))
    assert out.count() == odd_docs.count()
    assert all(not r.placements for r in out.collect() if r["size"] == 0)
    assert mixing.mixed(mixing.word_counts(no_docs)).count() == 0
    taken = sum(p.words for r in out.collect() for p in r.placements)
    mixed = mixing.mix(odd_docs)  # rows without an id and repeated rows are there as often as taken
    assert mixed.columns == odd_docs.columns and mixing.word_counts(mixed).agg(F.sum("size")).first()[0] == taken
    assert mixing.mix(no_docs).count() == 0 and mixing.mix(no_docs).columns == no_docs.columns


def test_query_places_blocks_as_the_tree_splits_them(spark):
    """Shards get whole blocks in equal numbers, each block once an epoch, as many of each source as its quota."""
    rows = mixing.op2_mixing(spark, SMALL).collect()
    assert all(r.taken == sum(p.words for p in r.placements) <= 3 * r["size"] for r in rows)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    _, plan = mixing.mix_plan(mixing.word_counts(docs), mixing.SHARDS, mixing.BLOCK_WORDS, mixing.SEED)
    blocks = plan.collect()
    placed = [(b["rank"], b.block, p.epoch, p.shard) for b in blocks for p in [*(b.whole or []), *([b.cut] if b.cut else [])]]
    assert len({x[:3] for x in placed}) == len(placed)
    per = Counter(x[3] for x in placed)
    assert max(per.values()) - min(per.get(s, 0) for s in range(mixing.SHARDS)) <= 1
    assert {p.shard for r in rows for p in r.placements} <= set(per)


def check_packing(out, texts, capacity=2048):
    tokenizer, _ = packing._tokenizer(None)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own, at = sorted(pieces[doc], key=lambda r: r.piece), 0
        for i, r in enumerate(own):
            assert (r.piece, r.start) == (i, at) and (i == 0 or r.length == capacity)
            part = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids) and len(own) == -(-len(ids) // capacity)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in out) // capacity)


def test_packing_round_trip(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    used, least = check_packing(packing.op9_best_fit_packing(spark, SMALL).collect(), texts)
    assert used <= least + 1


def test_packing_of_odd_texts(spark, odd_docs, no_docs):
    odd = ["", None, "  a  b \n c  d\t\t e  ", "x ", " y", "\n\n foo  'll don't", " <|endoftext|> a", "日本語 テキスト  です", "a" * 9000, "\x1c \x1d z q 　 w", "x.y, (z) ,a. é, É."]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    check_packing(packing.pack_documents(df).collect(), dict(enumerate(odd)))
    assert packing.pack_documents(no_docs).count() == 0
    assert packing.pack_documents(odd_docs).where("doc_id = 8").count() == 2


def test_fillings_use_up_the_counts_and_beat_first_fit():
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        plan, used, bins = packing.fill_plan(dict(Counter(lengths)), 100), Counter(), 0
        for filling, times in plan:
            assert sum(k * m for k, m in filling.items()) <= 100
            used.update({k: m * times for k, m in filling.items()})
            bins += times
        assert used == Counter(lengths)
        first_fit: list[int] = []
        for n in sorted(lengths, reverse=True):
            for i, b in enumerate(first_fit):
                if b + n <= 100:
                    first_fit[i] += n
                    break
            else:
                first_fit.append(n)
        assert bins <= len(first_fit)


def test_pipeline_stage_by_stage(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from gazetta.llm.common import staged

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, counts, first = docs.columns, [docs.count()], docs.select("doc_id")
    for name, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == names
        if name == "exact_dedup":
            assert docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")).distinct().count() == counts[-1]
        assert docs.join(first, "doc_id", "left_anti").isEmpty()
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0 and counts[5] >= counts[4] * 0.9
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
