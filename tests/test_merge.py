import random

from pyspark.sql import functions as F

from corvane.operators import merge

FIELDS = ("external_id", "name", "category", "reviews_count", "rating")


def folded(history):
    """Upserts one after the other."""
    now = None
    for row in history:
        if now is None:
            now = dict(row)
            continue
        count, old = row["reviews_count"], now["reviews_count"]
        if row["rating"] is not None and (-1 if count is None else count) >= (-1 if old is None else old):
            now["rating"] = row["rating"]
        now["reviews_count"] = max((x for x in (count, old) if x is not None), default=None)
        now["external_id"] = now["external_id"] if now["external_id"] is not None else row["external_id"]
        if len(row["name"]) >= len(now["name"]):
            now["name"] = row["name"]
        now["category"] = row["category"] if row["category"] is not None else now["category"]
        now["raw_data"] = now["raw_data"] | row["raw_data"]
    return now


def test_merge_equals_the_fold(spark):
    rng = random.Random(7)
    histories, rows = {}, []
    for key in range(400):
        histories[key] = []
        for order in range(rng.randint(1, 7)):
            row = {"external_id": rng.choice([None, "a", "b"]), "name": "n" * rng.randint(1, 4) + str(order), "category": rng.choice([None, "x", "y"]), "reviews_count": rng.choice([None, 0, 1, 5]), "rating": rng.choice([None, 1, 2, 3]), "raw_data": {rng.choice("pqr"): str(order)}}
            histories[key].append(row)
            rows.append((key, order, *[row[f] for f in FIELDS], row["raw_data"]))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "dedupe_key int, ord int, external_id string, name string, category string, reviews_count int, rating int, raw_data map<string,string>")
    for r in merge.merged(frame, newest=["category"]).collect():
        want = folded(histories[r.dedupe_key])
        assert {f: r[f] for f in (*FIELDS, "raw_data")} == want


def test_merge_shuffles_once(spark):
    frame = spark.range(100).select((F.col("id") % 7).alias("dedupe_key"), F.col("id").alias("ord"), F.lit(1).alias("reviews_count"), F.lit(1).alias("rating"), F.lit("c").alias("category"))
    plan = merge.merged(frame, newest=["category"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_keep_last_keeps_the_first_place(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, merge.keep_last(frame, ["k"], "o").collect())) == [("a", 1, None), ("b", 2, "y")]


def test_first_seen(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, o int")
    found = merge.first_seen(frame, "k", ["o"], ["o"]).orderBy("o").collect()
    assert [(r.first.o if r.first else None, r.repeated) for r in found] == [(1, False), (1, True), (None, False), (None, False)]
