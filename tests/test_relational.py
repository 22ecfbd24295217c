"""Relational operators, recursion, changes and sources on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import dml, recursive, relational as R
from tessera.sources import readers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Alice"), (2, "Bob"), (None, "Nobody")], "id long, name string"), spark.createDataFrame([(1, 90), (3, 80), (None, 5)], "user_id long, score long")


@pytest.mark.parametrize(("how", "n"), [("inner", 1), ("left", 3), ("right", 3), ("full", 5), ("semi", 1), ("anti", 2)])
def test_null_keys_never_join(people, how, n):
    assert R.equi_join(*people, [("id", "user_id")], how).count() == n
    assert R.equi_join(*people, [("id", "user_id")], how, strategy="merge").count() == n


def test_grouping_and_having(spark):
    df = spark.createDataFrame([("e1", "Eng", 100), ("e2", "Eng", 200), ("e3", "HR", 50)], "id string, dept string, salary long")
    assert rows(R.aggregate(df, ["dept"], {"s": F.sum("salary")}, F.col("s") > 100)) == [("Eng", 300)]
    assert R.grouping_sets(df, [["dept"], []], {"n": F.count(F.lit(1))}).count() == 3
    assert rows(R.aggregate(df.limit(0), [], {"n": F.count(F.lit(1))})) == [(0,)]


def test_lateral_caps_and_ranks(spark):
    outer = spark.createDataFrame([(1, "west"), (2, "east")], "cust long, region string")
    inner = spark.createDataFrame([(1, 1, 100), (2, 1, 200), (3, 1, 150), (4, 2, 300)], "o long, c long, amount long")
    assert R.lateral_all(outer, inner, [("cust", "c")]).count() == 4
    assert [r.amount for r in R.lateral_top_k(outer, inner, [("cust", "c")], [("amount", "desc")], 1).orderBy("cust").collect()] == [200, 300]
    with pytest.raises(ValueError, match="outer rows"):
        R.lateral_all(outer, inner, [("cust", "c")], outer_row_cap=1)


def test_recursion(spark):
    tree = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 2)], "id long, parent_id long")
    assert recursive.recursive_scan(tree, F.col("id") == 1, ("parent_id", "id")).count() == 4
    assert [r.n for r in recursive.recursive_value(spark, "n", "1", "n + 1", "n < 10").collect()] == list(range(1, 11))
    assert recursive.recursive_value(spark, "n", "1", "n % 3 + 1", "n > 0", distinct=True).count() == 3
    with pytest.raises(RuntimeError, match="deeper"):
        recursive.recursive_value(spark, "n", "1", "n + 1", "n > 0")


def test_updates_see_the_row_as_it_was(spark):
    df = spark.createDataFrame([("r1", 1, 2, "Alice"), ("r2", 5, 0, "BOB")], "id string, n long, d long, name string")
    assert rows(dml.update(df, {"n": F.col("d"), "d": F.col("n"), "name": F.lower("name")}, F.col("id") == "r1")) == [("r1", 2, 1, "alice"), ("r2", 5, 0, "BOB")]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        dml.update(df, {"n": F.expr("10 div d")}).collect()


def test_merge_arms_and_duplicate_source_keys(spark):
    stock = spark.createDataFrame([("p1", 3), ("p2", 1)], "id string, qty long")
    new = spark.createDataFrame([("p1", 4, 1), ("p1", 9, 2), ("p3", 5, 1)], "id string, qty long, at long")
    out = dml.merge(stock, new, ["id"], {"qty": F.col("qty") + F.col("excluded_qty")}, {"qty": F.col("excluded_qty")}, "delete", last_by="at")
    assert rows(out) == [("p1", 12), ("p3", 5)]
    with pytest.raises(ValueError, match="duplicate"):
        dml.insert(stock, stock, ["id"])


def test_documents(spark):
    df = spark.createDataFrame([("e1", '{"user":{"name":"ada","email":"a@x"},"tags":["important","ops"]}'), ("e2", '{"user":{"name":"bob"},"tags":["ops"]}')], "id string, payload string")
    p = F.col("payload")
    assert rows(df.select("id", X.doc_get(p, "$.user.email", F.lit("-")), X.doc_exists(p, "$.user.email"), X.doc_array_contains(p, "$.tags", "important"))) == [("e1", "a@x", True, True), ("e2", "-", False, False)]
    with pytest.raises(ValueError, match="malformed"):
        X.doc_get(p, "user[")


def test_vectors_of_other_sizes_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="different dimensions"):
        df.select(X.vector_distance(F.col("v"), X.vector([1.0, 0.0]))).collect()


def test_imports(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"id":"x","v":1}\n\n# no\n{"v":2}\n')
    got = readers.ndjson(spark, str(tmp_path / "a.ndjson")).collect()
    assert len(got) == 2 and "x" in {r.id for r in got}
    (tmp_path / "a.csv").write_text("id,n,f,b\n1,2,1.5,true\n2,3,2,false\n")
    assert [f.dataType.simpleString() for f in readers.csv(spark, str(tmp_path / "a.csv")).schema] == ["int", "int", "double", "boolean"]
