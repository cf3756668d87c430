"""Equal texts read once, and columns worked out once."""

import pytest
from gazetta.catalog import QUERIES
from gazetta.functions import text as X
from gazetta.operators import amounts as A
from gazetta.operators import criteria as C
from gazetta.operators import similarity as S
from pyspark.sql import functions as F

from .conftest import SMALL


@pytest.mark.parametrize("small", [True, False])
def test_equal_texts_are_worked_on_once(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(S, "SMALL", 0)
        monkeypatch.setattr(S, "PART", 5)
    rows = [(i, "a" if i % 2 else None, "b" if i % 3 else "") for i in range(40)] + [(100, "ab", "")]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    seen = []
    work = lambda once: (seen.append(once.count()), once.select("__same", F.explode(F.array("x", "y")).alias("v")))[1]
    got = sorted((r.id, r.v) for r in S.by_text(df, ["id"], ["x", "y"], work).collect())
    assert seen == [5] and got == sorted((i, v or "") for i, x, y in rows for v in (x, y))


def test_amounts_and_topics_of_copies(spark):
    rows = [(i, "기업당 3천만원 이내" if i % 2 else None) for i in range(30)] + [(30, "특허 보유")]
    df = spark.createDataFrame(rows, "id long, clause string")
    assert A.money_facts(df, "id", "clause").count() == 15
    assert {(r.id, r.criterion) for r in C.eligibility_topics(df, "clause").where("criterion = 'IP'").collect()} == {(30, "IP")}
    plan = A.money_facts(df, "id", "clause")._jdf.queryExecution().optimizedPlan().toString()
    assert "개월" not in plan  # quantities were read in the staged table of different texts


@pytest.mark.parametrize("name, marks", [("e6_requirements", 1), ("j10_ground_quotes", 1), ("j13_members", 2)])
def test_clauses_are_cleaned_once(spark, name, marks):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("○●■") == marks


def test_columns_worked_out_once(spark):
    df = X.worked_out(spark.range(5), {"x": F.sha2(F.col("id").cast("string"), 256)}).where("x > '5' AND x < 'f'")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha2") == 1 and df.columns == ["id", "x"]
