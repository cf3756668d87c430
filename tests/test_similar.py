"""Windows of scores found by bounds, blocks' best pairs, running statistics and organisations."""

import math
import random

import numpy as np
import pytest
from gazetta.operators import organizations as O
from gazetta.operators import similarity as S
from gazetta.operators import texts as T
from pyspark.sql import functions as F


def plain_bm25(queries, docs):
    """Scores in a loop: (query, document) of every pair with a term in common."""
    out, n, total = {}, len(docs), sum(sum(d.values()) for d in docs.values())
    for q, words in queries.items():
        own = docs.get(q)
        m, size = n - (own is not None), total - sum((own or {}).values())
        average = max(1.0, size / max(1, m))
        for i, d in docs.items():
            common = set(words) & set(d)
            if i != q and common:
                score = 0.0
                for w in common:
                    df = sum(w in x for x in docs.values()) - (own is not None and w in own)
                    score += math.log(1 + (m - df + 0.5) / (df + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * sum(d.values()) / average))
                out[q, i] = round(score, 9)
    return out


@pytest.mark.parametrize("small", [True, False])
def test_bm25_window_has_what_all_scores_have(spark, monkeypatch, small):
    rng = random.Random(8)
    if not small:  # joined by term, frequent terms in parts
        monkeypatch.setattr(S, "SMALL", 0)
        monkeypatch.setattr(S, "PART", 7)
    monkeypatch.setattr(S, "SEEDS", 2)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]  # a few words are everywhere
    docs = {i: {w: rng.randint(1, 3) for w in rng.choices(vocabulary, weights, k=rng.randint(1, 25))} for i in range(120)}
    docs |= {200 + i: docs[0] for i in range(9)}  # ties
    queries = {i: list(docs[i]) for i in range(0, 120, 6)} | {-1: ["w0", "w1", "w59", "no"], -2: ["none"]}
    terms = spark.createDataFrame([(i, w, n) for i, d in docs.items() for w, n in d.items()], "doc long, term string, tf long")
    asked = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in ws], "query_id long, term string")
    want = plain_bm25(queries, docs)
    assert {(r.query_id, r.id): r.lexical for r in S.bm25(asked, terms, "doc").collect()} == pytest.approx(want)
    top = lambda df: {tuple(r) for r in S.rank_window(df.withColumn("lexical", F.round("lexical", 6)), "lexical", 5).select("query_id", "id", "rank").collect()}
    some = S.bm25_window(asked, terms, "doc", 5)
    assert top(some) == top(S.bm25(asked, terms, "doc"))
    scores = {(r.query_id, r.id): r.lexical for r in some.collect()}
    assert scores == pytest.approx({k: want[k] for k in scores}) and len(scores) < len(want) / 2
    if small:
        assert S.bm25_window(asked.limit(0), terms, "doc").isEmpty() and S.bm25_window(asked, terms.limit(0), "doc").isEmpty()


def test_bm25_window_cuts_ties_where_they_arise(spark):
    """Equal documents: only a query's first ones leave a slice, not all of them."""
    terms = spark.createDataFrame([(i, w, 1) for i in range(400) for w in ("a", "b")], "doc long, term string, tf long")
    asked = spark.createDataFrame([(q, w) for q in (0, 7, -1) for w in ("a", "b")], "query_id long, term string")
    got = {}
    for r in S.bm25_window(asked, terms, "doc", 4).collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert {q: sorted(ids) for q, ids in got.items()} == {0: [1, 2, 3, 4], 7: [0, 1, 2, 3], -1: [0, 1, 2, 3]}


def test_best_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(90)]
    rows += [(100 + i, rows[i % 2][1]) for i in range(60)]  # many copies
    e = spark.createDataFrame(rows, "id long, embedding array<double>")
    for digits, k in ((2, 5), (None, 3)):
        rounded = lambda df: df if digits is None else df.withColumn("cosine", F.round("cosine", digits))  # noqa: B023, E731
        all_pairs = S.cosine_pairs(e.where("id % 9 = 0"), e, "id")
        few = S.cosine_pairs(e.where("id % 9 = 0"), e, "id", best=k, digits=digits)
        pick = lambda df: {tuple(r) for r in S.rank_window(rounded(df), "cosine", k).select("query_id", "id", "rank").collect()}  # noqa: B023, E731
        assert pick(few) == pick(all_pairs) and few.count() < all_pairs.count() / 2


def test_frequent_topics_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 10)
    a = spark.createDataFrame([(i, ["common", f"own{i}", "commonplace"]) for i in range(30)], "query_id long, terms array<string>")
    b = spark.createDataFrame([(100 + i, ["common", f"own{i % 30}"]) for i in range(60)], "id long, terms array<string>")
    parted = {(r.query_id, r.id): r.shared for r in S.shared_terms(a, b).collect()}
    assert len(parted) == 1800 and parted[3, 103] == ["common", "own3"] and parted[3, 104] == ["common"]
    left = a.select(F.explode("terms").alias("t"), "query_id")
    plan = S.split_join(left, b.select(F.explode("terms").alias("t"), "id"), "t", "id")
    assert plan.groupBy("t").count().where("t = 'common'").first()["count"] == 1800


@pytest.mark.parametrize(("n", "threshold", "lengths", "least"), [(3, 0.72, 0.0, 1), (5, 0.88, 0.8, 12)])
def test_near_duplicates_by_both_rules(spark, n, threshold, lengths, least):
    rng = random.Random(n)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(4, 90))) + str(rng.randrange(3)) for _ in range(60)]
    texts += [t[:10] + "x" + t[11:] for t in texts] + [t + "dab" for t in texts[:30]] + [t + " " for t in texts[:5]] + ["", " "]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)], "id long, kind string, t string")
    first = {}
    for i, t in enumerate(texts):
        if len(t.replace(" ", "")) >= least:
            first.setdefault((tuple(c for c in t if c.isdigit()), t.replace(" ", "")), i)
    grams = {i: {t[k : k + n] for k in range(len(t) - n + 1)} if len(t) > n else {t} for (_, t), i in first.items()}
    rows = [(i, d, t) for (d, t), i in first.items()]
    want = {
        tuple(sorted((i, j))) for i, d, t in rows for j, e, u in rows
        if i != j and d == e and min(len(t), len(u)) >= lengths * max(len(t), len(u)) and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= threshold
    }
    assert {tuple(r) for r in T.near_duplicates(df, "id", "kind", "t", n, threshold, lengths, least).collect()} == want and want


def test_statistics_follow_the_latest_versions(spark, tmp_path):
    from gazetta.plans.streams import _with_rocks
    from gazetta.streaming import jobs as J

    rng = random.Random(6)
    rows = [(rng.randrange(8), n, rng.randrange(1000), [rng.choice("abcdef") for _ in range(rng.randint(0, 4))]) for n in range(60)]
    schema = "document_id long, event_id long, at long, terms array<string>"
    for n in range(6):  # out of order of time
        spark.createDataFrame(rows[n::6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    latest = {}
    for doc, event, at, terms in rows:
        if doc not in latest or (at, event) > latest[doc][0]:
            latest[doc] = ((at, event), terms)
    want = {w: sum(w in t for _, t in latest.values()) for w in "abcdef"}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.select("document_id", "event_id", F.timestamp_millis("at").alias("ts"), "terms")

    def run(_):
        J.stream_corpus_stats(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return J.corpus_stats(spark, str(tmp_path / "out"))

    df, whole = _with_rocks(spark, run)
    assert {r.term: r.df for r in df.collect()} == {w: n for w, n in want.items() if n}
    assert tuple(whole.first()) == (len(latest), sum(len(t) for _, t in latest.values()))
    assert len(list((tmp_path / "out").iterdir())) == 2  # the last batch and the one before it


def found(spark, *sources):
    df = spark.createDataFrame([(1, n, f, t) for n, (f, t) in enumerate(sources)], "id int, n int, file string, text string")
    return {(r.role, r.name) for r in O.organizations(df, "id", "text", "file", "n").collect()}


def test_names_beside_below_and_after_a_role(spark):
    assert found(spark, (None, "총괄기관\n(산업기술부)\n시행기관\n(한빛산업공단)\n수행기관\n(전문기업)\n□ (문의처) 한빛산업공단 지원센터 02-111-2222")) == {("총괄기관", "산업기술부"), ("시행기관", "한빛산업공단")}
    for text in ("주관기관(한빛진흥원)", "[주관기관] 한빛진흥원", "| 주 관 기 관 | 한빛진흥원 | 담당팀", "주관기관 한빛진흥원", "주관기관 : 한빛진흥원 및 기타"):
        assert found(spark, (None, text)) == {("주관기관", "한빛진흥원")}, text
    assert found(spark, (None, "주관기관: 한빛연구원 및 새솔기술재단, (재)가온협회 / 나래대학교")) == {("주관기관", n) for n in ("한빛연구원", "새솔기술재단", "(재)가온협회", "나래대학교")}
    table = "[표]\n주관기관\t주관기관\t한빛진흥원\t한빛진흥원\t운영기관\t새솔재단\n문의처\t문의처\t한빛진흥원\t한빛진흥원\t전담기관\t가온연구원\n[/표]"
    assert found(spark, (None, table)) == {("주관기관", "한빛진흥원"), ("운영기관", "새솔재단"), ("전담기관", "가온연구원")}
    assert found(spark, (None, "[표]\n주관기관\t운영기관\n한빛진흥원\t새솔재단\n[/표]")) == {("주관기관", "한빛진흥원"), ("운영기관", "새솔재단")}
    assert found(spark, (None, "[표]\n주관기관\t설명\n\t새솔재단\n[/표]")) == set()


def test_what_names_no_organisation(spark):
    texts = [
        "산업기술부 공고", "주관연구개발기관 : 한빛연구원", "주관기관 모집공고", "전년도 사업 주관기관 : 한빛진흥원", "주관기관 : 지난해 한빛진흥원", "주관기관 : OO진흥원", "주관기관 : 추후 선정", "주관기관 : 한빛진흥원(예시)",
        "운영기관 : 한빛연구원(선정 예정)", "문의처 : 02-000-0000", "주관기관 : 국내 연구기관", "주관기관 : 한빛연구원 재직증명서", "주관 및 한빛연구원", "주관기관: 및 한빛연구원", "주관 및 공동연구개발기관 기업부설연구소 인정서",
        "주관기관 주관기관 한빛진흥원", "[표]\n주관기관\t한빛진흥원\n운영기관\t새솔재단", "[표]\n주관기관\t한빛진흥원\n운영기관\n[/표]", "작성 예시\n운영기관: 한빛진흥원", "서식1 신청서\n주관기관: 한빛진흥원", "[표]\n주관기관\t\n[/표]\n한빛진흥원", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert O.organizations(df, "id", "text").collect() == []


def test_sources_of_a_notice_and_members_of_archives(spark):
    bundle = "버려짐\n주관기관: 앞협회\n[파일: 참여확인서.hwp]\n주관기관 : 신청연구원\n[파일: 공고문.hwp]\n전담기관 : 한빛진흥원\n주관기관\n[파일: 사업계획서.hwp]\n새솔협회\n[파일: 추가 공고문.hwp]\n(접수처) 나래 사무국 https://example.org"
    assert found(spark, ("일체.zip", bundle)) == {("전담기관", "한빛진흥원"), ("접수처", "나래 사무국")}
    assert found(spark, (None, "주관기관 : 한빛진흥원"), ("공고.pdf", "주관기관 : 한빛 진흥원\n문의처 : 한빛진흥원 담당팀"), ("참고자료.pdf", "전담기관: 다른진흥원"), ("모집 신청서.hwp", "운영기관: 한빛진흥원")) == {("주관기관", "한빛진흥원"), ("운영기관", "한빛진흥원")}
    assert found(spark, (None, "서식 1 신청서\n주관기관: 신청진흥원\n문의처: 나래재단")) == {("문의처", "나래재단")}
    broken = "주관기관: 한빛진흥원\n[표]\n운영기관\t새솔재단\n[표]\n전담기관\t가온연구원\n[/표]\n관리기관: 나래협회"
    assert found(spark, (None, broken)) == {("주관기관", "한빛진흥원")}


def test_term_rows_of_repeated_ids_and_nulls(spark):
    """Rows of one document add up wherever they lie; a document without terms has no row."""
    rows = [(1, ["a", "b"], ["b", "c"]), (1, ["a"], None), (2, None, ["c"]), (3, [], [])]
    df = spark.createDataFrame(rows, "doc long, title array<string>, purpose array<string>")
    got = {tuple(r) for r in S.term_table(df, "doc", "title", "purpose").collect()}
    assert got == {(1, "a", 4), (1, "b", 3), (1, "c", 1), (2, "c", 1)}


def test_statistics_excluding_in_parts(spark, monkeypatch):
    """A term that every document has meets its documents in parts; the plan has no join of all terms by term alone."""
    monkeypatch.setattr(S, "PART", 3)
    rows = [(i, t, 1 + i % 2) for i in range(20) for t in ("all", f"own{i}")]
    got = {(r.doc, r.term): (r.df, r.n, round(r.average, 6)) for r in S.stats_excluding(spark.createDataFrame(rows, "doc long, term string, tf long"), "doc").collect()}
    want = {(i, t): (19 if t == "all" else 0, 19, round((60 - 2 * (1 + i % 2)) / 19, 6)) for i, t, _ in rows}
    assert got == want
    plan = S.stats_excluding(spark.createDataFrame(rows, "doc long, term string, tf long"), "doc")._jdf.queryExecution().toString()
    assert "__part" in plan


def test_r5_gives_every_pair(spark):
    """r5_bm25 is the whole job: as many rows as r5_bm25_whole, more than 20 for some passage."""
    from gazetta import catalog

    from .conftest import SMALL

    some, whole = ({tuple(r) for r in catalog.QUERIES[q](spark, SMALL).collect()} for q in ("r5_bm25", "r5_bm25_whole"))
    per = {}
    for q, *_ in some:
        per[q] = per.get(q, 0) + 1
    assert some == whole and max(per.values()) > 20


def test_topic_terms_read_each_word_once(spark):
    """Words are cut down to different ones before the rules; one- and two-letter runs, numbers and Korean words as before."""
    from gazetta.functions.text import topic_terms

    df = spark.createDataFrame([("The cat, the CAT a 12 12년 x1 사업을 사업을 나무를 나무는 é ab é",), (None,)], "t string")
    plain = topic_terms(F.col("t"), generic=("the", "and"), prefixes=(), particles=(), synonyms=())
    assert [r[0] for r in df.select(plain).collect()] == [["cat", "x1", "사업을", "나무를", "나무는", "ab"], []]
    assert df.select(topic_terms(F.col("t"))).first()[0] == ["the", "cat", "x1", "나무", "ab"]
    assert df.select(topic_terms(F.col("t"), generic=()).alias("x"))._jdf.queryExecution().toString().count("regexp_extract_all") > 0


def test_candidates_take_texts_along_not_grams(spark):
    """Pairs are met by texts, which become grams again after the joins: no row of theirs holds an array of grams."""
    df = spark.createDataFrame([(1, "k", "one text of some words"), (2, "k", "one text of some word")], "id long, kind string, t string")
    out = T.near_duplicates(df, "id", "kind", "t")
    plan = out._jdf.queryExecution().analyzed().toString()
    joins = plan[plan.index("Join Inner") :]
    assert "t_a" in joins and "grams_a" not in joins and [tuple(r) for r in out.collect()] == [(1, 2)]


def plain_shared(a, b, most=5, gram=4):
    out = {}
    for q, s in a:
        for i, t in b:
            x = {min(u, w, key=len) for u in s for w in t if u == w or (min(len(u), len(w)) >= gram and (u in w or w in u))}
            if q != i and x:
                out.setdefault((q, i), set()).update(x)
    return {k: sorted(v)[:most] for k, v in out.items()}


@pytest.mark.parametrize(("block", "common"), [(512, 2_000_000), (3, 40)])
def test_shared_terms_against_all_pairs(spark, monkeypatch, block, common):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "COMMON", common)
    rng = random.Random(6)
    words = lambda n: list({"".join(rng.choice("abé") for _ in range(rng.randint(2, 7))) for _ in range(n)})
    a, b = [(i, words(rng.randint(0, 9))) for i in range(20)], [(i, words(rng.randint(0, 12))) for i in range(10, 50)]
    b += [(10, words(4)), (60, []), (61, None)]
    got = S.shared_terms(spark.createDataFrame(a, "query_id long, terms array<string>"), spark.createDataFrame(b, "id long, terms array<string>")).collect()
    assert {(r.query_id, r.id): r.shared for r in got} == plain_shared(a, [(i, t or []) for i, t in b]) and len(got) == len({(r.query_id, r.id) for r in got})


def test_shared_terms_read_whole_texts(spark, tmp_path):
    from gazetta.catalog import QUERIES

    spark.createDataFrame([(7, "solar panels in harbours")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "title\nof no use\nharbour and panels, far down"), (2, "title alone")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in QUERIES["j8_shared_terms"](spark, str(tmp_path)).collect()] == [(7, 1, "harbour panels")]


@pytest.mark.parametrize(("few", "bucket"), [(1000, 50), (3, 50), (3, 7)])
def test_near_duplicates_meet_in_cells(spark, monkeypatch, few, bucket):
    """Blocks as a whole and in buckets, in bands of a few texts, over several batches: the pairs of all texts compared with all."""
    monkeypatch.setattr(T, "BAND_CELLS", 1)
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 20, 60, 90]))) for _ in range(160)]
    texts += [t[: len(t) // 2] + "é" + t[len(t) // 2 + 1 :] for t in texts[:80]] + [t + "ab" for t in texts[:80]] + texts[:9]
    df = spark.createDataFrame([(i, "k" if i % 3 else None, t) for i, t in enumerate(texts)], "id long, kind string, t string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault((i % 3 > 0, t), i)
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} or {t} for (_, t), i in first.items()}
    want = {(a, b) for (k, _), a in first.items() for (m, _), b in first.items() if k == m and a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.72}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = [tuple(r) for r in T.near_duplicates(df, "id", "kind", "t", few=few, bucket=bucket).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == want and len(got) == len(want) > 50


def test_clauses_of_one_document_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, "k", "one text of some words"), (2, "k", "one text of some word")], "id long, kind string, t string")
    out = T.near_duplicates(df, "id", "kind", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    small = plan[plan.rindex("MapInPandas") :]
    assert small.count("Exchange hashpartitioning") == 1 and "Generate" not in small and "Window" not in small


@pytest.mark.parametrize("queries", [1000, 4])
def test_copies_and_pairs_of_slices_keep_to_their_number(spark, monkeypatch, queries):
    """However many rows there are, queries are copied to SLICES slices at most, and each lets a query's best pairs out once."""
    monkeypatch.setattr(S, "QUERIES", queries)
    monkeypatch.setattr(S, "SLICES", 3)
    monkeypatch.setattr(S, "BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(400)]
    e = spark.createDataFrame(rows, "id long, embedding array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        few = S.cosine_pairs(e.where("id % 40 = 0"), e, "id", best=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(few) == 10 * 3 * 5
    unit = np.array([v for _, v in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for q in range(0, 400, 40):
        value = unit @ unit[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(value[i], 12), i))[:5]
        mine = sorted(((r.cosine, r.id) for r in few if r.query_id == q), key=lambda r: (-round(r[0], 12), r[1]))[:5]
        assert [i for _, i in mine] == want


def test_first_pairs_are_those_of_all(monkeypatch):
    rng = np.random.default_rng(4)
    query, ids, values = rng.integers(0, 9, 500), np.arange(500), rng.integers(0, 12, 500) / 8
    kept = {tuple(r) for r in zip(*(x.tolist() for x in S._first(query, ids, values, 6, None)))}
    for q in range(9):
        mine = sorted(((-v, i) for k, i, v in zip(query, ids, values) if k == q))
        assert {(q, i, -v) for v, i in mine[:6]} <= kept
        assert len([1 for k in kept if k[0] == q]) <= 12
