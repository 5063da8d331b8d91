from pyspark.sql import functions as F

from corvane.plans import analytics, scripts


def test_statements():
    assert list(scripts.statements("SELECT ';' AS a; -- one; two\n/* three; */ SELECT `x;y`, 4/2 - 1;;")) == ["SELECT ';' AS a", "SELECT `x;y`, 4/2 - 1"]


def test_script(spark):
    assert scripts.run_script(spark, "CREATE OR REPLACE TEMP VIEW v AS SELECT 1 AS a UNION ALL SELECT 2; SELECT sum(a) AS s FROM v WHERE a < :most", most=2).first().s == 1
    assert scripts.run_script(spark, " ; ") is None


def test_requests():
    assert analytics.given({"a": ["x", "y"], "b": "z"}, "a") == "x" and analytics.given({"b": "z"}, "b") == "z" and analytics.given({}, "b") == ""
    assert [analytics.page_given(x) for x in ("3", " 4x", "0", "-2", "", "x")] == [3, 4, 1, 1, 1, 1]
    assert analytics.link("/companies") == "/companies" and analytics.link("/companies", 2, "a b&c", "") == "/companies?search=a+b%26c&page=2"


def test_empty_groups_and_labels(spark):
    rows = spark.createDataFrame([(None, None), ("", 1), ("a", 2)], "c string, v int")
    assert [tuple(r) for r in analytics.top_groups(rows, "c", "none", "n").collect()] == [("none", 2), ("a", 1)]
    assert [tuple(r) for r in analytics.share_by(rows, "c", "none", F.col("v") > 1, "n", "m", "p", as_text=True).collect()] == [("a", 1, 1, "100.00"), ("none", 2, 0, "0.00")]
    assert analytics.share_by(rows.where("false"), "c", "none", F.col("v") > 1, "n", "m", "p").collect() == []


def test_text_order_differs(spark):
    rows = spark.createDataFrame([("a", i) for i in range(1)] + [("b", i) for i in range(9)], "c string, v int")
    share = lambda text: [r.c for r in analytics.share_by(rows, "c", "none", F.col("v") < 8, "n", "m", "p", as_text=text).collect()]
    assert share(False) == ["a", "b"] and share(True) == ["b", "a"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id AS string) AS name", "id % 3 AS city", "id AS unused").write.parquet(str(tmp_path / "t"))
    plan = analytics.searched(spark.read.parquet(str(tmp_path / "t")), "name", "1", "city", "2").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "PushedFilters: [IsNotNull(city)" in plan or "EqualTo(city" in plan
