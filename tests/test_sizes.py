"""Steps that meet their rows once, and what they leave out of shuffles and sorts."""

import random
import re

import numpy as np
import pytest
from gazetta.catalog import QUERIES
from gazetta.operators import evidence as V2
from gazetta.operators import sections as S
from gazetta.operators import statements as Q
from gazetta.operators import versioning as V
from pyspark.sql import functions as F

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detections_meet_versions_and_documents_only(spark):
    text = QUERIES["j1_detection_summary"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = [x for x in text[: next(i for i, x in enumerate(text) if "l_orderkey" in x and "Relation" in x)] if "Join" in x]
    assert len(above) == 2  # versions, with their sources, tasks and analyses, and documents


def plain_members(prev, curr):
    out, left, right = [], sorted(prev), sorted(curr)
    for name in ("name+text", "name", "text"):
        pick = lambda r: tuple({"name": r[1], "text": r[2]}[c] for c in name.split("+"))  # noqa: B023, E731
        for new in list(right):
            old = next((o for o in left if None not in pick(o) and pick(o) == pick(new)), None)
            if old:
                left.remove(old)
                right.remove(new)
                out.append((new[0], old[0], name))
    last = max([r[0] for r in prev], default=-1)
    return sorted(out + [(new[0], last + i + 1, "appended") for i, new in enumerate(right)])


def test_members_meet_once(spark):
    rng = random.Random(2)
    sides = [[(d, p, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", None])) for d in range(30) for p in range(rng.randint(0, 7))] for _ in range(2)]
    prev, curr = (spark.createDataFrame(s + [(None, 0, "a", "x")], "version_id long, position long, name string, text string") for s in sides)
    out = V.align_members(prev, curr)
    got = sorted(tuple(r) for r in out.where("version_id IS NOT NULL").collect())
    assert got == [(d, *r) for d in range(30) for r in plain_members(*[[x[1:] for x in s if x[0] == d] for s in sides])]
    assert [tuple(r)[1:] for r in out.where("version_id IS NULL").collect()] == [(0, 0, "appended")]
    assert "Join" not in plan(out) and plan(out).count("Exchange hashpartitioning") == 1


def test_lines_are_carried_down_without_shuffle(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        body = "[표]\n지원유형\t지원한도\n지원유형\t국비\nA 트랙\t1억원\nA 트랙\t1억원\n[/표]\n한도 없음\nB 트랙\n(기타) 한도\n한도 없음"
        df = spark.createDataFrame([(i, "공통", body) for i in range(7)] + [(9, None, None)], "id long, label string, body string").coalesce(1)
        out = S.prepare_rows(df, ["id"], "label", "body")
        got = {(r.id, r.row_no, r.text, r.group_label, tuple(r.headers), len(r.cells)) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    head = ("지원유형", "지원한도 / 국비")
    want = {(3, "A 트랙 1억원", "A 트랙", head, 2), (6, "한도 없음", "A 트랙", (), 0), (8, "(기타) 한도", "B 트랙", (), 0), (9, "한도 없음", "B 트랙", (), 0)}
    assert got == {(i, *w) for i in range(7) for w in want}
    assert "Exchange" not in plan(out) and "Sort" not in plan(out)


@pytest.mark.parametrize("line", ["A 트랙", "사항 10", "1 2", "ㆍ가", "가. 나", " 가", "가  나", "나 ①", "", "가\n", None])
def test_plain_lines_are_clean(spark, line):
    df = spark.createDataFrame([(line,)], "c string").select(S.clean_line(F.col("c")).alias("a"), S._cleaned(F.col("c")).alias("b"))
    assert df.first().a == df.first().b


def test_small_places_are_settled_together(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc기") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    for masks in (Q.MASKS, 50):
        monkeypatch.setattr(Q, "MASKS", masks)
        assert {(i[k], j[k]) for k in Q.may_be_alike(texts, i, j, 0.68)} == {tuple(sorted(p)) for p in Q.similar(texts, None, 0.68)}
    df = spark.createDataFrame([(n, n % 20, t) for n, t in enumerate(texts)], "id long, doc long, t string")
    tree = plan(Q.statement_pairs(df, "id", "t", within="doc")).split("Union")[1]
    few = tree[: [m.start() for m in re.finditer("MapInPandas", tree)][1]]
    assert few.count("Exchange") == 1 and "Join" not in few


def test_evidence_is_chosen_by_batches(spark):
    df = spark.createDataFrame([(i, "".join(f"{n}. 접수 {n * i}\n\n" for n in range(40))) for i in range(1, 6)] + [(9, None)], "id long, body string")
    out = V2.select_evidence(df, "id", "body", 120, [r"\d"])
    assert "FlatMapGroupsInPandas" not in plan(out)
    sizes = {r.id: r.n for r in out.groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    assert set(sizes) == set(range(1, 6)) and all(0 < n <= 120 for n in sizes.values())


def test_statements_are_made_once_for_their_duplicates(spark):
    out = QUERIES["e27_statement_issues"](spark, SMALL)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey") < 30  # equal and near texts read a table of them
    assert plan(out).count("Scan parquet") > plan(out).count("lineitem.parquet") > 0
