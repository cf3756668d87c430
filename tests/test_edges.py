"""Edge cases of single operators on small literal tables."""

import datetime
import random

import pytest
from gazetta.functions import text as X
from gazetta.operators import lists as L
from gazetta.operators import scoring as S
from gazetta.operators import similarity as R
from gazetta.operators import texts as T
from gazetta.operators import versioning as V
from gazetta.operators import windows as W
from pyspark.sql import functions as F


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_return_to_an_old_content_is_a_new_version(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "a"), (2, 1, None), (2, 2, None)], "d long, t long, version_hash string")
    out = V.build_history(df, "d", ["t"]).select("d", "t", "change_type", "version_no")
    assert rows(out) == [(1, 1, "NEW", 1), (1, 2, "UPDATED", 2), (1, 3, "UPDATED", 3), (1, 4, "UNCHANGED", 3), (2, 1, "NEW", 1), (2, 2, "UNCHANGED", 1)]


def test_missing_hash_and_no_attachments(spark):
    notices = spark.createDataFrame([(1, "t", None), (2, "t", None)], "version_id long, title string, content_text string")
    files = spark.createDataFrame([(1, "f", "u", None)], "version_id long, file_name string, download_url string, file_hash string")
    import hashlib

    got = dict(V.version_hash(notices, files).select("version_id", "version_hash").collect())
    assert got[1] == hashlib.sha256("t\x1d\x1df\x1fu\x1f".encode()).hexdigest()
    assert got[2] == hashlib.sha256("t\x1d\x1d".encode()).hexdigest()


def test_search_takes_wildcards_as_they_are(spark):
    df = spark.createDataFrame([(1, "100% of_a!b"), (2, "100 of a b")], "id long, t string")
    for q, ids in (("%", [1]), ("_", [1]), ("!", [1]), ("  ", [1, 2]), ("OF A", [2])):
        assert [r.id for r in L.search(df, ["t"], q).orderBy("id").collect()] == ids


def test_reversed_range_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "run_id long")
    with pytest.raises(ValueError):
        L.filter_detections(df, None, datetime.datetime(2024, 2, 1), datetime.datetime(2024, 1, 1))


@pytest.mark.parametrize(
    "days, score",
    [(-1, 0), (0, 100), (2, 100), (3, 90), (5, 90), (6, 80), (7, 80), (8, 65), (14, 65), (15, 50), (21, 50), (22, 35), (30, 35), (31, 20), (45, 20), (46, 10), (None, 10)],
)
def test_urgency_bands(spark, days, score):
    assert spark.range(1).select(S.urgency(F.lit(days).cast("int"))).first()[0] == score


def test_score_is_capped_when_the_fit_is_low(spark):
    df = spark.createDataFrame([(40, 100, 100, 100), (41, 100, 100, 100)], "a int, b int, c int, d int")
    got = df.select(S.opportunity_score(*map(F.col, "abcd"), F.lit("FIT")).alias("s")).collect()
    assert [r.s for r in got] == [49, 71]


def test_malformed_assessments(spark):
    texts = ['{"dimensions":[{"type":"URGENCY","score":5},{"type":"URGENCY","score":5}]}', '{"dimensions":1}', "no json", "", None, '{"dimensions":[{"type":"NEW","score":500}]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.malformed, r.priority) for r in S.ranking_from_json(df, "t").collect()}
    assert [got[i][0] for i in range(6)] == [True, True, True, False, False, False]
    assert got[4][1] is None and got[5][1] == "LOW"


def test_business_days_by_counting(spark):
    rng, cases = random.Random(1), []
    for _ in range(300):
        a = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(60))
        cases.append((a, a + datetime.timedelta(days=rng.randrange(-5, 40)), rng.randrange(0, 30)))
    df = spark.createDataFrame(cases, "a date, b date, n int")
    for r in df.select("*", S.business_days(F.col("a"), F.col("b")).alias("d"), S.minus_business_days(F.col("a"), F.col("n")).alias("m")).collect():
        assert r.d == sum((r.a + datetime.timedelta(days=k)).weekday() < 5 for k in range(1, (r.b - r.a).days + 1))
        day, left = r.a, r.n
        while left:
            day -= datetime.timedelta(days=1)
            left -= day.weekday() < 5
        assert r.m == day


def test_won_amounts(spark):
    cases = [("총 1억 2천만원", 120_000_000), ("3,500만 원", 35_000_000), ("1.5억원", 150_000_000), ("12명", None), (None, None)]
    cases += [("12명 대상 5억원", 500_000_000), ("2026년 3,500만 원", 35_000_000), ("총 5억원, 건당 1억원", None), ("20억 5,000만원과 20억 5천만 원", 2_050_000_000)]
    cases += [("3백억원", 30_000_000_000), ("2십만원", 200_000), ("5천억 원", 500_000_000_000), ("-30만원", -300_000), ("A4 용지 10장", None), ("1,234원", 1234)]
    many = spark.createDataFrame([("1~2억원, 최대 3천만 원",), ("1천만원~5천만원",), (None,)], "t string").select(S.won_amounts(F.col("t")).alias("w")).collect()
    assert [[int(x) for x in r.w] for r in many] == [[100_000_000, 200_000_000, 30_000_000], [10_000_000, 50_000_000], []]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").select(S.parse_won(F.col("t")).alias("w"))
    assert [None if r.w is None else int(r.w) for r in df.collect()] == [c[1] for c in cases]


def test_equal_shares_by_the_rule(spark):
    rng, cases, want = random.Random(2), [], {}
    for k in range(60):
        sizes, total = [rng.randrange(0, 30) for _ in range(rng.randrange(1, 7))], 40
        share, left = [0] * len(sizes), total
        while left and any(s < n for s, n in zip(share, sizes)):
            open_ = [i for i, n in enumerate(sizes) if share[i] < n]
            each = left // len(open_)
            if each == 0:
                for i in open_[:left]:
                    share[i] += 1
                break
            for i in open_:
                more = min(each, sizes[i] - share[i])
                share[i] += more
                left -= more
        want[k] = sum(share)
        cases += [(k, i, n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(cases, "k long, i long, n long")
    out = W.allocate_budget(df, "k", "i", "n", 40)
    assert out.where("allotted > n OR allotted < 0").count() == 0
    assert dict(out.groupBy("k").agg(F.sum("allotted")).collect()) == want


def test_greedy_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4), (2, 1, 11)], "k long, i long, n long")
    assert rows(W.greedy_budget(df, "k", ["i"], "n", 10)) == [(1, 1, 5), (1, 3, 4)]


def test_bad_vectors_take_no_part(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [3.0, 4.0]), (5, [1e300, 1e300]), (6, [None, 1.0])], "id long, embedding array<double>")
    got = {r.id: r.u for r in R.unit_vectors(df, "id", "embedding").collect()}
    assert set(got) == {4, 5} and got[4] == pytest.approx([0.6, 0.8]) and got[5] == pytest.approx([0.5**0.5] * 2)


def test_ties_at_the_cut_go_to_the_smaller_id_and_share_a_rank(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(25)], "query_id long, id long, v double")
    out = R.rank_window(df, "v").orderBy("id").collect()
    assert [r.id for r in out] == list(range(20)) and {r.rank for r in out} == {1}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(30)) + str(rng.randrange(3)) for _ in range(40)]
    texts += [t[:10] + "x" + t[11:] for t in texts[:20]] + texts[:5]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)], "id long, kind string, t string")
    got = {tuple(r) for r in T.near_duplicates(df, "id", "kind", "t").collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t.replace(" ", ""), i)
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for t, i in first.items()}
    digits = {i: [c for c in t if c.isdigit()] for t, i in first.items()}
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and digits[a] == digits[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.72}
    assert got == want and want


def test_unknown_sentences_and_file_names(spark):
    df = spark.createDataFrame([("미확인.",), ("N/A",), ("지원 대상 미확인입니다 아님",), (None,), ("원문에서 확인하지 못했습니다.",), ("첨부파일에 지원 대상이 명시되어 있지 않습니다",), ("본문 참고",)], "t string")
    assert [r[0] for r in df.select(X.is_unknown(F.col("t"))).collect()] == [True, True, False, False, True, True, False]
    names = spark.createDataFrame([(" a.b.PDF (12 KB)",), ("plain 3 MB",), ("x.hwp",)], "t string")
    got = [tuple(r) for r in names.select(X.normalize_file_name(F.col("t")), X.file_extension(F.col("t"))).collect()]
    assert got == [("a.b.PDF", ".pdf"), ("plain", ""), ("x.hwp", ".hwp")]


def test_filters_reach_the_scan_and_no_pair_product(spark):
    from gazetta.catalog import QUERIES

    from .conftest import SMALL

    plan = QUERIES["a14_page_totals"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority)" in plan
    plan = QUERIES["j12_near_duplicates"](spark, SMALL)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("layout", ["one file", "three files"])
def test_run_expiry_and_late_results(spark, tmp_path, layout):
    from gazetta.plans.streams import ROCKS
    from gazetta.streaming import jobs

    at = lambda h: f"2024-01-01 {h}"
    first = [(1, at("00:00:00"), "accepted"), (2, at("00:00:00"), "accepted"), (1, at("00:10:00"), "result"), (4, at("00:00:00"), "accepted")]
    later = [(3, at("05:00:00"), "accepted"), (1, at("05:00:00"), "result")]
    last = [(2, at("05:00:01"), "result"), (3, at("06:00:00"), "result"), (5, at("05:00:01"), "result"), (2, at("05:30:00"), "result")]
    schema = "run_id long, ts string, kind string"
    for n, part in enumerate([first + later + last] if layout == "one file" else [first, later, last]):
        spark.createDataFrame(part, schema).coalesce(1).selectExpr("run_id", "cast(ts as timestamp) ts", "kind").write.parquet(str(tmp_path / "in" / f"p{n}"))
    name, zone = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set(name, ROCKS)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
    try:
        stream = spark.readStream.schema("run_id long, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        out = jobs.run_to_end(jobs.stream_runs(stream, delay="6 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
        got = {(r.run_id, r.outcome, r.late) for r in out.collect()}
    finally:
        spark.conf.unset(name)
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = {(1, "COLLECTED", 0), (1, "LATE", 1), (2, "FAILED", 0), (2, "LATE", 1), (2, "LATE", 2), (3, "COLLECTED", 0), (5, "LATE", 1)}
    assert want <= got and got - want <= {(4, "FAILED", 0)}  # the silent run fails when the watermark has passed


def test_sentences_and_cells_keep_their_digits(spark):
    df = spark.createDataFrame([("0 a. 1 b. 2 c.", "[표]\na\tb\n12\t21\n[/표]")], "t string, x string").selectExpr("1 AS id", "*")
    assert df.select(X.sentences(F.col("t"))).first()[0] == ["0 a.", "1 b.", "2 c."]
    assert [r.cells for r in T.table_rows(df, "id", "x").orderBy("row_no").collect()] == [["a", "b"], ["12", "21"]]


def test_similar_notices_cover_all_languages(spark):
    from gazetta.catalog import QUERIES
    from gazetta.plans import similar

    from .conftest import SMALL

    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    seen = {r.doc_id for r in similar.term_rows(spark, SMALL).select("doc_id").distinct().collect()}
    assert {langs[d] for d in seen} == set(langs.values())
    lexical = QUERIES["r6_hybrid_rank"](spark, SMALL).where("lexical_rank IS NOT NULL").select("query_id", "id").collect()
    assert {langs[r.id] for r in lexical} - {"en"} and {langs[r.query_id] for r in lexical} - {"en"}
    left = {r.doc_id for r in QUERIES["a5_stats_excluding"](spark, SMALL).select("doc_id").distinct().collect()}
    assert {d % 10 for d in left} == set(range(10)) and {langs[d] for d in left} - {"en"}


def test_clauses_without_digits_and_copies_are_found(spark, tmp_path):
    from gazetta.catalog import QUERIES

    one, two = "the goods are delivered to the town hall by noon", "the goods are delivered to the town hall by moon"
    texts = [(1, one, "en"), (2, two, "en"), (3, one, "en"), (4, "something else altogether, far from that", "en"), (5, one, None), (6, one, None)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {tuple(r)[:2] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("j12_near_duplicates") == {(100000, 200000)} == run("j13_statement_pairs")
    assert run("j12_members") == {(100000, 100000), (200000, 200000), (300000, 100000), (400000, 400000), (500000, 500000), (600000, 500000)}
    assert run("j13_members") == {(100000, 100000), (200000, 200000), (300000, 100000), (400000, 400000), (500000, 100000), (600000, 100000)}


def test_whole_scores_warnings_and_quotes(spark, tmp_path):
    from gazetta.catalog import QUERIES

    days = [datetime.datetime(1994, 1, 1) + datetime.timedelta(days=37 * i) for i in range(60)]
    items = [(i, 1 + i % 3, i, i, d) for i, d in enumerate(days)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.item: (r.schedule, r.readiness) for r in QUERIES["k7_readiness"](spark, str(tmp_path)).collect()}
    now, want = datetime.date(1995, 6, 17), {}
    for key, number, part, supplier, ship in items:
        left = sum((now + datetime.timedelta(days=k)).weekday() < 5 for k in range(1, (ship.date() - now).days + 1))
        schedule = min(100, round(left / list(S.WORK_DAYS.values())[part % 12] * 100)) if left > 0 else 0
        want[key * 10 + number] = (schedule, round(list(S.EVIDENCE.values())[supplier % 5] * 0.8 + schedule * 0.2))
    assert got == want
    texts = [(1, "fine line\nHTTP status 503 here\ntimed out", "en"), (7, "All is well and good here. N/A.", "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    warnings = {(r.doc_id, r.line_no): r.category for r in QUERIES["f8_classify_warning"](spark, str(tmp_path)).collect()}
    assert warnings == {(1, 0): "TIMEOUT", (1, 1): "HTTP_503", (1, 2): "TIMEOUT", (7, 0): "TIMEOUT"}
    assert rows(QUERIES["f9_is_unknown"](spark, str(tmp_path)).where("doc_id = 7"), "sentence_no") == [(7, 0, False), (7, 1, True)]
    assert rows(QUERIES["j10_ground_quotes"](spark, str(tmp_path))) == [(5100001, "OK"), (5700000, "OK")]


def test_orders_without_a_score_come_last(spark):
    from gazetta.catalog import QUERIES

    from .conftest import SMALL

    n = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    for name in ("t2_order_score", "t3_order_by_mode"):
        scores = [r.score for r in QUERIES[name](spark, SMALL).collect()]
        known = [s for s in scores if s is not None]
        assert len(scores) == n > 500 and None in scores and scores[: len(known)] == sorted(known, reverse=True)


def test_submission_rows_of_literal_tables(spark):
    from gazetta.operators import submissions as B

    def table(*rows):
        return "[표]\n" + "\n".join("\t".join(r) for r in rows) + "\n[/표]"

    good = table(("연번", "서류명", "제출시기", "비고"), ("1", "사업계획서", "", ""), ("2", "확인서", "선정 후", "해당 시"), ("3", "동의서", "", "제출 면제"), ("4", "통장 사본", "", "2개 이상의 기업이 참여하는 경우 zip 파일로 제출"))
    texts = [
        (1, "제출 서류는 다음과 같다.\n" + good), (2, good), (3, "구비 서류 작성 예시\n" + good), (4, "신청 서류\n" + good + "\n* 면제 가능"),
        (5, "신청 서류\n" + table(("서류명", "구분"), ("신청서", "선택"), ("추천서",))), (6, None), (7, "신청 서류\n" + table(("서류명", "서류명"), ("신청서", "동의서"))),
    ]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {(r.id, r.title, r.level, r.stage) for r in B.submission_rows(df, "id", "text").collect()}
    assert got == {(1, "사업계획서", "MANDATORY", "APPLICATION"), (1, "확인서", "CONDITIONAL", "POST_SELECTION"), (1, "통장 사본", "MANDATORY", "APPLICATION")}


def test_cosines_of_blocks_against_each_pair(spark, monkeypatch):
    import numpy as np
    from gazetta.operators import similarity as R

    monkeypatch.setattr(R, "BLOCK", 3)
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=4 if i % 5 else 3).tolist()) for i in range(40)] + [(40, None), (41, [0.0] * 4), (42, [float("nan"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for least in (-1.0, 0.3):
        got = {(r.query_id, r.id): round(r.cosine, 9) for r in R.cosine_pairs(df.where("vec_id % 4 = 0"), df, "vec_id", least).collect()}
        want = {}
        for i, a in data[:40:4]:
            for j, b in data[:40]:
                if i != j and len(a) == len(b):
                    value = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
                    if value >= least:
                        want[i, j] = round(float(value), 9)
        assert got == want and want
    assert R.cosine_pairs(df.limit(0), df, "vec_id").count() == 0


def test_latency_of_skewed_repeated_and_missing_values(spark):
    from gazetta.operators import windows as W

    data = [("a", float(i % 7)) for i in range(300)] + [("a", 1e9)] + [("b", 5.0)] + [(None, float(i * i)) for i in range(41)] + [("c", None)] + [("d", 2.0)] * 50
    df = spark.createDataFrame(data, "kind string, ms double")
    want = {}
    for kind in ("a", "b", "d", None):
        values = sorted(v for k, v in data if k == kind and v is not None)
        want[kind] = (round(sum(values) / len(values), 6), values[max(1, int(len(values) * 0.95)) - 1])
    for cuts in (2, 256):
        assert {r.kind: (round(r.mean, 6), r.p95) for r in W.latency(df, "kind", "ms", cuts).collect()} == want
    assert W.latency(df.limit(0), "kind", "ms").count() == 0


def test_only_open_runs_wait(monkeypatch):
    """A run that its batch closes sets no timer, one that stays open does, and a later batch that closes it takes it back."""
    from types import SimpleNamespace

    from gazetta.streaming import jobs

    timers, states = set(), {}
    handle = SimpleNamespace(registerTimer=timers.add, deleteTimer=timers.remove)
    rows = lambda *r: iter([SimpleNamespace(at_ms=at, kind=kind) for at, kind in r])

    def feed(run, *r):
        job = jobs._Runs(1000)
        job.handle, job.state = handle, SimpleNamespace(get=lambda: states.get(run), exists=lambda: run in states, update=lambda v: states.update({run: v}))
        return [(x["outcome"], x["late"]) for x in job.handleInputRows((run,), rows(*r), None)]

    assert feed(1, (5, "accepted"), (900, "result"), (950, "result")) == [("COLLECTED", 0), ("LATE", 1)] and not timers
    assert feed(2, (7, "accepted")) == [] and timers == {1007}
    assert feed(2, (8, "accepted")) == [] and timers == {1007}
    assert feed(2, (5000, "result"), (6000, "result")) == [("FAILED", 0), ("LATE", 1), ("LATE", 2)] and not timers


@pytest.mark.parametrize("key", [3, -1])
def test_pages_of_runs_end_as_single_runs_do(key):
    """Batches in any order, runs that stay silent until their time has passed, and rows without a run: one state and timer a page."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd
    from gazetta.streaming import jobs

    rng, timers, pages, states = random.Random(9), {}, {}, {}

    def fake(job, name, held, k):
        mine = timers.setdefault((name, k), set())
        job.handle = SimpleNamespace(registerTimer=mine.add, deleteTimer=mine.remove)
        job.state = SimpleNamespace(get=lambda: held.get(k), exists=lambda: k in held, update=lambda v: held.update({k: v}))
        return job

    plain = lambda k: k if key > 0 else None
    for batch in range(12):
        rows = [(rng.randrange(40) if key > 0 else 0, 1000 * batch + rng.randrange(1500), rng.random() < 0.5) for _ in range(rng.randint(1, 60))]
        job = fake(jobs._RunPages(700), "page", pages, key)
        frame = pd.DataFrame(rows, columns=["run", "at_ms", "result"])
        got = [tuple(r) for f in job.handleInputRows((key,), iter([frame[:7], frame[7:]]), None) for r in f.itertuples(index=False)]
        want = []
        for run in {r[0] for r in rows}:
            one = fake(jobs._Runs(700), "run", states, run)
            mine = [SimpleNamespace(at_ms=at, kind="result" if done else "accepted") for k, at, done in rows if k == run]
            want += [(plain(r["run_id"]), r["outcome"], r["late"]) for r in one.handleInputRows((run,), iter(mine), None)]
        assert sorted(map(str, [(plain(0) if r[0] is pd.NA else int(r[0]), r[1], int(r[2])) for r in got])) == sorted(map(str, want))
        passed = 1000 * batch + 300
        clock, got, want = SimpleNamespace(getCurrentWatermarkInMs=lambda: passed), [], []  # noqa: B023
        for (name, k), due in list(timers.items()):
            for at in sorted(t for t in due if t < passed):
                if at in due:
                    due.remove(at)
                    info = SimpleNamespace(getExpiryTimeInMs=lambda: at)  # noqa: B023
                    if name == "run":
                        want += [(plain(r["run_id"]), r["outcome"], r["late"]) for r in fake(jobs._Runs(700), name, states, k).handleExpiredTimer((k,), clock, info)]
                    else:
                        got += [(plain(0) if r.run_id is pd.NA else int(r.run_id), r.outcome, int(r.late)) for f in fake(jobs._RunPages(700), name, pages, k).handleExpiredTimer((k,), clock, info) for r in f.itertuples()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(timers["page", key]) <= 1
    assert np.frombuffer(pages[key][0], jobs._RunPages.STATE)["run"].tolist() == sorted(states)


def test_runs_are_called_by_pages(spark):
    """A batch calls Python once for each page that it touches, not once for each run, unless each run is to have a state."""
    from gazetta.streaming import jobs

    stream = spark.readStream.format("rate").load().selectExpr("value run_id", "timestamp ts", "'accepted' kind")
    tree = lambda **k: jobs.stream_runs(stream, **k)._jdf.queryExecution().analyzed().toString()
    assert "transformWithStateUDF(page#" in tree() and "transformWithStateUDF(page#" not in tree(pages=None)
