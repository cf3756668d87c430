"""Toxicity, language, language model and personal data against held-out labels and plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from gazetta.llm import langid, lm, pii, toxicity
from pyspark.sql import functions as F

from ..conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


def auc(good, bad):
    good, bad = np.array(good), np.array(bad)
    return float((good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean())


def test_toxicity_on_held_out_labels(spark):
    out = {r.doc_id: r for r in toxicity.op3_toxicity(spark, MIDDLE).collect()}
    labels = [r for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if out[r.doc_id].held_out]
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in labels)
    good, bad = ([out[r.doc_id].score for r in labels if r.toxic == y] for y in (1, 0))
    assert auc(good, bad) > 0.9 and np.mean([s >= 0.7 for s in bad]) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())


def test_toxicity_finds_the_sentence_and_takes_odd_rows(spark, odd_docs, no_docs):
    model = toxicity.Model(-6.0, {"moron": 9.0})
    text = "A fine day. You moron, go. The end"
    df = spark.createDataFrame([(1, text), (2, "fine"), (3, None)], "doc_id long, text string")
    found = toxicity.offending_sentences(df, model).collect()
    assert [(r.doc_id, r.sentence, text[r.start : r.end]) for r in found] == [(1, " You moron, go", " You moron, go")]
    got = {r.doc_id: r.score for r in toxicity.score(odd_docs, model).collect()}
    assert got[1] == got[2] == got[3] == 0.0 and toxicity.score(no_docs, model).count() == 0
    assert toxicity.fit([], []).weights == {} and toxicity.fit(["a b"], [1]).weights == {}
    # noisy-or: one sure sentence decides
    assert toxicity.noisy_or([20.0, -20.0]) > 0.99 > 0.6 > toxicity.noisy_or([0.0]) == 0.5


def test_languages_on_held_out_documents(spark):
    out = langid.op4_language_id(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect())


def test_languages_by_plain_bayes(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    texts = ["same text", "one", None, "", "12 !"]
    named, score = langid.classify(texts, model)
    assert named[2:] == ["und"] * 3 and score[2:] == [0.0] * 3 and named[0] == "fr"
    counts = {x: Counter() for x in model.langs}
    for r in odd_docs.where("lang IS NOT NULL AND text IS NOT NULL").collect():
        for _, b in langid.buckets([langid.letters(r.text)], model.bits):
            counts[r.lang].update(b.tolist())
    for i, x in enumerate(model.langs):
        total = sum(counts[x].values()) + (1 << model.bits)
        for b in list(counts[x])[:20]:
            assert math.isclose(model.table[b, i], math.log((counts[x][b] + 1) / total), rel_tol=1e-4)
    assert langid.predict(odd_docs, model).count() == odd_docs.count() and langid.predict(no_docs, model).count() == 0
    assert langid.classify(["abc"], langid.fit(no_docs)) == (["und"], [0.0])


def test_lm_base_scores_and_a_better_model(spark):
    rows = sorted(lm.op6_lm_scoring(spark, SMALL).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    counts, total = Counter(), 0
    tokens = {d: lm.words(t) + [b"\n"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    for d, own in tokens.items():
        if not held[d]:
            counts.update(own)
            total += len(own)
    for r in rows:
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(own) and r.train_tokens == total
        assert r.n_known == sum(w in counts for w in own) and math.isclose(r.base_score, base, rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_of_odd_rows(spark, odd_docs, no_docs):
    rows = lm.score(odd_docs, F.lit(True)).collect()
    assert len(rows) == odd_docs.count() and all(r.score < 0 and r.n_known == r.n_tokens for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    twice = [tuple(r) for r in rows if r.doc_id == 8]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert lm.score(no_docs, F.lit(True)).count() == 0
    assert all(r.n_known == 0 for r in lm.score(odd_docs, F.lit(False)).collect())


def test_lm_tokens_as_words():
    texts = [None, "", "  ", " A b\x0bC ", "É\x85é x", "a\x1cb \x1d c", "x" * 50, "\n\t z"]
    keys, sizes = lm.token_keys(pa.array(["before", *texts, "after"], pa.string()).slice(1, len(texts)))
    want = [[lm._key_of(w.decode()) for w in lm.words(t)] + [lm.END] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and keys.tolist() == [k for w in want for k in w]


def test_lm_is_the_plain_interpolation_of_all_counts(spark, monkeypatch):
    """Small blocks and buckets, so that counts travel between many of them."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm, "BUCKET_KEYS", 5_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    one, two, n, cells = Counter(), Counter(), 0, []
    tokens = {r.doc_id: lm.words(r.text) + [b"\n"] for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    for d, own in tokens.items():
        if not held[d]:
            one.update(own)
            two.update(zip([b"\n"] + own, own))
            n += len(own)
    bucket = lambda c: sum(c >= 4**i for i in range(lm.BUCKETS))
    for (u, w), k in two.items():
        cells.append((bucket(one[u]), k, (one[w] - 1) / (n - 1), (k - 1) / max(one[u] - 1, 1)))
    found = lm.counted(docs, ~lm.is_held_out())
    grid, totals = lm.held_out_cells(found)
    assert totals == (n, len(one))
    weights = lm.mixture_weights(grid, totals.distinct)
    assert np.allclose(weights, lm.mixture_weights(cells, len(one)), atol=0.02)
    rows = lm.scored(found, totals, weights).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        own, score = tokens[r.doc_id], 0.0
        for u, w in zip([b"\n"] + own, own):
            a, b, c = weights[bucket(one[u])]
            score += math.log10(a / (len(one) + 1) + b * one[w] / n + c * two[u, w] / max(one[u], 1))
        assert math.isclose(r.score, score, rel_tol=1e-9)


def test_em_finds_the_weights_that_made_the_data():
    rng, cells = np.random.default_rng(0), []
    for p1, p2 in rng.uniform(0.001, 0.5, (400, 2)):
        cells.append((3, 1000 * (0.2 * 0.01 + 0.3 * p1 + 0.5 * p2), p1, p2))
    w = lm.mixture_weights(cells, 99)[3]
    assert abs(w.sum() - 1) < 1e-9 and w[2] > w[1]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),  # noqa: B023
                "card": lambda: 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice("a1@.. -+()b9é,0255") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(t) == plain_spans(t)
    for t in ("1" * 30_000, "a" * 30_000 + "@", "x@" * 5_000):
        pii.base_spans(t)


def test_pii_query(spark, no_docs, odd_docs):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in pii.op10_pii(spark, SMALL).collect():
        want = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in want) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest()
        assert set(pii.written(want).split(",")) <= set(r.spans.split(","))
    model = pii.fit([])
    assert pii.find(no_docs, model).count() == 0 and pii.find(odd_docs, model).where("spans <> ''").count() == 0


def test_long_texts_with_very_many_spans():
    model = pii.Model(1.0, [], [0.0] * 4)._replace(trees=[1.0])
    text = "joe [at] corp.example.org or a@b.cd and +1 974 555 3436, " * 20_000  # over 1 MB
    began = time.perf_counter()
    base, spans = pii.all_spans(text, model)
    assert len(base) == 40_000 <= len(spans) and time.perf_counter() - began < 60
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_trees_choose_disguised_spans_and_redaction(spark):
    model = pii.fit_on(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    text = "write to joe [at] corp.example.org or +1 (974) 555-3436 before 2024-11-05"
    found = {(text[a:b], k) for a, b, k in pii.all_spans(text, model)[1]}
    assert ("+1 (974) 555-3436", "phone") in found and not any("2024" in t for t, _ in found)
    df = spark.createDataFrame([(1, "call +1 (974) 555-3436 now", 5), (2, None, 6)], "doc_id long, text string, spans long")
    assert [r.text for r in pii.redact(df, model).orderBy("doc_id").collect()] == ["call [PHONE] now", None]


def test_disguised_spans_of_every_kind_are_found(spark):
    """The synthetic corpus has few base spans; made-up ones at their places teach every kind."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model, rng = pii.fit_on(docs), random.Random(77)
    texts = [r.text for r in docs.where("length(text) > 300").limit(200).collect()]
    for kind in pii.KINDS:
        found = right = added = wrong = 0
        for _ in range(150):
            text = rng.choice(texts)
            at = text.index(" ", rng.randrange(100, len(text) - 150)) + 1
            left, right_side, plain = text[at - 60 : at], " " + text[at : at + 60], pii.example(kind, rng)
            for new, good in ((pii.disguised(kind, plain, rng), True), *((x, False) for x in pii.broken(kind, plain, rng))):
                base, spans = pii.all_spans(left + new + right_side, model)
                here = [s for s in spans if s[0] < len(left) + len(new) and s[1] > len(left)]
                more = [s for s in here if s not in base]
                added += len(more)
                wrong += 0 if good else len(more)
                if good:
                    right += 1
                    found += any(a <= len(left) + 1 and b >= len(left) + len(new) - 1 for a, b, _ in here)
        assert found >= 0.9 * right, kind
        assert wrong <= 0.01 * added, kind


def test_lessons_are_bounded_and_copies_share_a_part(spark):
    text = "mail joe@corp.example.org or call +1 974 555 3436, " * 50
    assert len(pii.lessons(text)) == pii.LESSONS and pii.lessons(text) == pii.lessons(text) and len({p for _, _, p in pii.lessons(text)}) == 1
    twice = spark.createDataFrame([(i, t) for i, t in enumerate([text, text, None, "", "@ 1"])], "doc_id long, text string")
    assert pii.fit_on(twice) == pii.fit_on(twice.where("doc_id > 0")) and pii.fit_on(twice.limit(0)).trees == []


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    rows = [(i if i % 4 else None, f"das ist der text {i} und die zeile" if i % 2 else f"this is the text {i} and a line", "de" if i % 2 else "en") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for out, n in ((langid.op4_language_id(spark, str(tmp_path)), 5), (toxicity.op3_toxicity(spark, str(tmp_path)), 3)):
        found = [(r.doc_id, r.held_out) for r in out.collect()]
        assert len(found) == 40 and all(h == (d is not None and zlib.crc32(str(d).encode()) % n == (0 if n == 5 else 1)) for d, h in found)
