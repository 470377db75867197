"""Boosting and isolation forests on small frames; the registered queries hold them against SQL."""

import math

from pyspark.sql import functions as F

from tarnsift.operators import boosting as B
from tarnsift.operators.model import isolation_forest, isolation_scores, score, score_multiclass, train_detector, train_multiclass

FAST = B.Settings(rounds=2, depth=2, min_child_weight=1.0, subsample=1.0, columns=1.0, bins=8)


def frame(spark, n=400):
    x = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("nan")).otherwise(F.col("id") % 40).cast("double")
    return spark.range(n).select("id", x.alias("x"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") % 40 >= 25).cast("int").alias("y"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("shard"))


def test_first_cut_is_the_best_one_by_hand(spark):
    rows = [(i, float(i), 0.0, int(i >= 6)) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, x double, z double, y int")
    s = B.Settings(rounds=1, depth=1, rate=1.0, min_child_weight=0.0, subsample=1.0, columns=1.0, l1=0.0, l2=0.0, max_step=0.0, bins=64)
    fitted = B.fit(df, ["x", "z"], "y", ["id"], s, weigh=False)
    nodes = {r["node"]: r for r in B.trees_table(df, fitted).collect()}
    assert nodes[0]["feature"] == "x" and 5 <= nodes[0]["cut"] < 6 and set(nodes) == {0, 1, 2}
    p = 0.4  # the base rate; a leaf's step is minus the sum of p - y over the sum of p * (1 - p)
    assert math.isclose(nodes[1]["value"], -6 * p / (6 * p * (1 - p))) and math.isclose(nodes[2]["value"], 4 * (1 - p) / (4 * p * (1 - p)))
    got = [r["score"] for r in score(df, fitted).orderBy("id").collect()]
    low = 1 / (1 + math.exp(-(math.log(4 / 6) + nodes[1]["value"])))
    assert math.isclose(got[0], low) and got[9] > 0.5 > got[0]


def test_shards_train_together_and_stop_when_validation_does(spark):
    df = frame(spark)
    both = B.fit(df, ["x", "z"], "y", ["id"], FAST, model="shard")
    alone = B.fit(df.where("shard = 'b'"), ["x", "z"], "y", ["id"], FAST)
    assert both.models == ["a", "b"] and both.base[1] == alone.base[0]
    wrong = df.withColumn("y", 1 - F.col("y"))
    stopped = train_detector(df, ["x", "z"], "y", ["id"], B.Settings(rounds=9, depth=2, min_child_weight=1.0, subsample=1.0, patience=1, bins=8), wrong)
    assert len(stopped.trees[0]) == 1  # the first round is the best one there


def test_families_and_frames_without_rows(spark):
    df = frame(spark).withColumn("family", F.when(F.col("id") % 40 < 10, "low").when(F.col("id") % 40 < 25, "mid").otherwise("top"))
    fitted = train_multiclass(df, ["x", "z"], "family", ["id"], FAST)
    made = score_multiclass(df.where("x is not null and not isnan(x)"), fitted)
    assert fitted.classes == ["low", "mid", "top"]
    r = made.agg(F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1)), F.avg(((F.greatest("p0", "p1", "p2") == F.col("p2")) == (F.col("family") == "top")).cast("int"))).first()
    assert r[0] < 1e-12 and r[1] > 0.95
    none = train_detector(df.limit(0), ["x"], "y", ["id"], FAST)
    assert score(df, none).where("score = 0.5").count() == 400
    assert isolation_scores(df, df.limit(0), ["x", "z"], ["id"], trees=3, sample=16).agg(F.min("anomaly"), F.max("anomaly")).first()[0:2] == (0.5, 0.5)


def test_isolation_finds_what_stands_apart(spark):
    df = frame(spark).unionByName(frame(spark, 1).withColumn("id", F.lit(999).cast("long")).withColumn("x", F.lit(5000.0)))
    forest = isolation_forest(df.where("id < 999"), ["x", "z"], ["id"], trees=10, sample=64)
    leaves = forest.where("feature is null")
    assert leaves.where("rest is null").count() == 0 and forest.where("feature is not null and cut is null").count() == 0 and forest.agg(F.max("node")).first()[0] < 2**7
    scored = isolation_scores(df, df.where("id < 999"), ["x", "z"], ["id"], trees=10, sample=64)
    r = scored.agg(F.max_by("id", "anomaly"), F.min("anomaly"), F.max("anomaly")).first()
    assert r[0] == 999 and 0 < r[1] < r[2] < 1


def test_equal_rows_go_on_as_one_cell(spark):
    df = frame(spark, 4000)
    fitted = B.fit(df, ["x", "z"], "y", ["id"], FAST)
    rows = B._prepared(df, fitted, "y", ["id"], None, {})
    cells = B._cells(rows, fitted, [F.lit(True)], "cells")
    assert cells.count() <= 9 * 8 * 2 and cells.agg(F.sum("n0")).first()[0] == 4000
    one = cells.withColumn("p", 1 / (1 + F.exp(-F.get("m", F.lit(0))))).agg(F.sum(F.col("p") * F.col("n0"))).first()[0]
    assert math.isclose(one, score(df, fitted).agg(F.sum("score")).first()[0])


def test_isolation_paths_are_walked_in_batches(spark):
    df = frame(spark)
    nodes = {(r["tree"], r["node"]): r for r in isolation_forest(df, ["x", "z"], ["id"], trees=3, sample=64).collect()}
    scored = isolation_scores(df, df, ["x", "z"], ["id"], trees=3, sample=64)
    assert "aggregate(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    norm = 2 * (math.log(63) + 0.5772156649) - 2 * 63 / 64
    for r in scored.limit(80).collect():
        x, total = [0.0 if v is None or math.isnan(v) else v for v in (r["x"], r["z"])], 0.0
        for t in range(3):
            n, depth = 0, 0
            while (t, n) in nodes and nodes[t, n]["feature"] is not None:
                n, depth = 2 * n + 1 + (x[nodes[t, n]["feature"]] >= nodes[t, n]["cut"]), depth + 1
            total += depth + (nodes[t, n]["rest"] if (t, n) in nodes else 0.0)
        assert math.isclose(r["anomaly"], 2 ** (-total / 3 / norm))


def test_rounds_are_the_same_in_one_block_and_in_many(spark, monkeypatch):
    df = frame(spark, 2000).withColumn("family", F.when(F.col("id") % 40 < 10, "low").when(F.col("id") % 40 < 25, "mid").otherwise("top"))
    s = B.Settings(rounds=B.AT_ONCE + 2, depth=3, min_child_weight=1.0, subsample=0.7, columns=1.0, bins=8, patience=99)
    one = B.fit(df, ["x", "z"], "family", ["id"], s, classes=["low", "mid", "top"])
    monkeypatch.setattr(B, "CELLS", 80)
    many = B.fit(df, ["x", "z"], "family", ["id"], s, classes=["low", "mid", "top"], val=df.where("id < 300"))
    flat = lambda fitted: [[(t["feature"], t["bin"], [round(v, 6) for v in t["value"]]) for t in per] for per in fitted.trees[0]]
    assert len(one.trees[0]) == s.rounds and flat(many) == flat(one)[: len(many.trees[0])] and len(many.trees[0]) > 1


def test_best_cut_is_the_first_of_the_greatest_gain():
    import numpy as np

    s = B.Settings(min_child_weight=1.0, l1=0.0, l2=0.0, max_step=0.0)
    g, h = np.array([[0.0, -4.0, 0.0, 4.0], [0.0, 4.0, -4.0, 0.0]]), np.array([[0.0, 2.0, 0.0, 2.0], [0.0, 2.0, 2.0, 0.0]])
    assert B.best_cut(np.stack([g, h]), [0, 1], s) == (0, 0, 0.0, 4.0, -4.0, 2.0)  # bins count from -1, those of nulls
    assert B.best_cut(np.stack([g, h]), [1], s) == (1, 0, 0.0, 4.0, 4.0, 2.0)
    assert B.best_cut(np.stack([g, h]), [0, 1], B.Settings(min_child_weight=3.0)) == (None, None, 0.0, 4.0, None, None)
