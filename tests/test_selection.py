"""Ranks, bounds, quantiles and exact distributions at the sizes and shapes where shortcuts fail."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsift.functions import clean as C
from tarnsift.operators import fusion as U
from tarnsift.operators import metrics as X
from tarnsift.operators import stats as Z
from tarnsift.operators.model import open_set_report
from tarnsift.operators.primitives import bounds_at, bucketed_rank, placed, prefix_sums, upto_bounds
from tarnsift.operators.quantiles import exact_quantiles


def frame(spark, kind):
    draw = random.Random(2)
    if kind == "hot":  # 15 000 of 20 000 rows share the first key
        rows = [(5 if i % 4 else draw.randint(0, 10), f"k{draw.randint(0, 10**9)}", i % 3) for i in range(20_000)]
        return spark.createDataFrame(rows, "a int, b string, g int").repartition(6)
    rows = [(f"https://example/{draw.randint(0, 10**9)}", str(i), 1 if i % 10 else None) for i in range(20_000)]
    return spark.createDataFrame(rows, "a string, b string, g int").repartition(6)


@pytest.mark.parametrize("kind", ["hot", "prefix"])
def test_buckets_are_even_and_ranks_exact(spark, kind):
    df = frame(spark, kind)
    sizes = [r["count"] for r in placed(df, ["a", "b"], 20_000, 1000).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 18 and max(sizes) <= 2 * 20_000 / len(sizes)
    rows = sorted((r["a"], r["b"]) for r in df.collect())
    got = sorted((r["rank"], r["a"], r["b"]) for r in bucketed_rank(df, ["a", "b"], bucket_rows=1000).collect())
    assert [x[0] for x in got] == list(range(1, 20_001)) and [x[1:] for x in got] == rows
    inside = bucketed_rank(df, ["a", "b"], ("g",), bucket_rows=1000).groupBy("g").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.count_distinct("rank").alias("d")).collect()
    assert all(r["n"] == r["m"] == r["d"] for r in inside)


def test_bounds_cut_hot_keys(spark):
    df = frame(spark, "hot").withColumn("a", F.when(F.col("a") != 7, F.col("a")))
    wanted = spark.createDataFrame([(0, 1), (1, 9_000), (2, 20_000)], "at int, rank long")
    met = upto_bounds(df, ["a", "b"], bounds_at(df, ["a", "b"], wanted, bucket_rows=1000), [0, 1, 2])
    assert tuple(met.agg(*[F.count_if(f"_b{i}") for i in range(3)]).first()) == (1, 9_000, 20_000)


def test_prefix_sums_of_many_keys(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 5000).alias("k"), F.lit(1).alias("c")).unionByName(spark.createDataFrame([(0, None, 1)], "g long, k long, c int"))
    got = prefix_sums(df, "k", ["c"], ("g",), bucket_rows=400).collect()
    keys = {g: sorted(r["k"] for r in got if r["g"] == g and r["k"] is not None) for g in range(3)}
    assert len(got) == 5001 and all(r["cum_c"] == (len(keys[0]) + 1 if r["k"] is None else keys[r["g"]].index(r["k"]) + 1) for r in got[::50] + [r for r in got if r["k"] is None])


def test_radix_selection_of_a_million_values(spark):
    n, qs = 1_000_000, [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    df = spark.range(n).select((F.col("id") % 2).alias("g"), (F.tan(F.col("id") + 0.5) * F.when(F.col("id") % 5 == 0, 1e-300).otherwise(1e6)).alias("v"), F.when(F.col("id") % 100 == 0, float("nan")).when(F.col("id") % 100 == 1, None).otherwise(-(F.col("id") % 7)).cast("double").alias("w"))
    values = df.toPandas()
    for r in exact_quantiles(df, ["v", "w"], qs, ("g",), small=1000).collect():
        x = values.loc[values["g"] == r["g"], r["column"]]
        assert np.allclose(r["values"], np.quantile(x[np.isfinite(x)], qs), rtol=1e-12, atol=0)
    (r,) = exact_quantiles(df, ["v"], qs, nearest=True, small=1000).collect()
    assert r["values"] == np.quantile(values["v"], qs, method="inverted_cdf").tolist()
    assert exact_quantiles(df.limit(0), ["v"], qs).count() == 0


def test_scores_that_are_none(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.1)] + [(0, None)] * 3 + [(0, float("nan"))] * 3
    df = spark.createDataFrame(rows, "y int, s double")
    assert X.best_f1_grid(df, "y", "s").first()["f1"] == X.best_f1_exact(df, "y", "s").first()["f1"] == 1.0
    assert X.roc_auc(df, "y", "s").first()["auc"] == 1.0
    assert X.best_f1_grid(spark.createDataFrame([(1, None), (1, 0.9)], "y int, s double"), "y", "s").first()["f1"] == round(2 / 3, 12)
    flagged = X.fpr_sensitivity(spark.createDataFrame([(0, i / 10) for i in range(10)], "y int, s double"), df, "y", "s", [0.1]).first()
    assert (flagged["tp"], flagged["fp"], flagged["fn"], flagged["tn"]) == (1, 0, 1, 1)


def test_names_that_clash_with_counts(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), ("b", 0, 0.5)], "pos string, y int, n double")
    assert {r["pos"]: r["auc"] for r in X.roc_auc(df, "y", "n", ("pos",)).collect()} == {"a": 1.0, "b": None}
    assert {r["pos"]: r["exceed"] for r in X.fpr_statistic(df.where("y = 0"), "n", [0.01], ("pos",)).collect()} == {"a": 0.1, "b": 0.5}
    assert {r["pos"]: r["threshold"] for r in X.best_f1_exact(df, "y", "n", ("pos",)).collect()} == {"a": 0.9, "b": 0.5}
    cal = df.withColumnsRenamed({"n": "c"}).withColumn("n", F.col("c"))
    assert open_set_report(cal, cal, "y", "c", "n", "pos").count() == 6


def test_held_out_families_are_judged_alone(spark):
    """Each family's novelty stands on a scale of its own; together they would hide the first one's attack."""
    rows = [("a", 0, 0.2, i / 1000) for i in range(200)] + [("b", 0, 0.2, 5 + i / 1000) for i in range(200)]
    cal = spark.createDataFrame(rows, "f string, y int, s double, nov double")
    test = spark.createDataFrame([("a", 1, 0.1, 1.0), ("a", 0, 0.1, 0.1), ("b", 1, 0.1, 9.0), ("b", 0, 0.1, 5.1)], "f string, y int, s double, nov double")
    got = {(r["f"], r["rule"]): r for r in open_set_report(cal, test, "y", "s", "nov", "f").collect()}
    for f in "ab":
        r = got[f, "hybrid_or"]
        assert (r["tp"], r["fn"], r["fp"]) == (1, 0, 0) and r["auc"] == r["novelty_auc"] == 1.0 and got[f, "fpr_1pct"]["auc"] == 0.5
    pct = X.percentile_vs_reference(test, cal, "nov", by=("f",)).where("y = 0").collect()
    assert {r["f"]: r["pct"] for r in pct} == {"a": 101 / 200, "b": 101 / 200}


def test_decimals_keep_all_digits(spark):
    cases = {"0.00000000000000000012": "0.00000000000000000012", "1234567890123456789012": "1234567890123456789012", "123456789012345678901234567890": "123456789012345678901234567890", "1.50e3": "1500", ".5": "0.5", "5.": "5", "+007.10": "7.1", "12e-4": "0.0012", "0.0e9": "0", "": "0", "  ": "0", "1e": None, "-1": None, "nan": None, "1e3e4": None}
    df = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", C.canonical_decimal(F.col("t")))
    assert df.where("not got <=> want").collect() == []


def exact_p(diffs):
    sums = Counter({0: 1})
    for d in diffs:
        sums = sum((Counter({s + k * d: n for s, n in sums.items()}) for k in (1, -1)), Counter())
    return sum(n for s, n in sums.items() if abs(s) >= abs(sum(diffs))) / 2 ** len(diffs)


def test_sign_flips_of_forty_and_of_one(spark):
    draw = random.Random(4)
    groups = {"forty": [draw.randint(-900, 1500) for _ in range(40)], "odd": [draw.randint(-9, 30) for _ in range(23)], "one": [3], "zero": [1, -1], "ties": [2, 2, 2, -1]}
    df = spark.createDataFrame([(g, x / 1000) for g, xs in groups.items() for x in xs] + [("one", None)], "g string, diff double")
    got = {r["g"]: r for r in Z.sign_flip_test(df, ["g"]).collect()}
    for g, xs in groups.items():
        assert got[g]["n"] == len(xs) and abs(got[g]["p_value"] - exact_p(xs)) < 1e-12 and abs(got[g]["mean_diff"] - sum(xs) / len(xs) / 1000) < 1e-12


def test_bootstrap_of_twenty_values_of_few_decimals(spark):
    values = [random.Random(i).randint(0, 60) for i in range(20)]
    sums = Counter({0: 1})
    for _ in values:
        sums = sum((Counter({s + v: n for s, n in sums.items()}) for v in values), Counter())
    whole, at, low, high = sum(sums.values()), 0, None, None
    for s in sorted(sums):
        at += sums[s]
        low = s if low is None and at >= 0.025 * whole else low
        high = s if high is None and at >= 0.975 * whole else high
    df = spark.createDataFrame([("g", v / 100) for v in values], "g string, x double")
    r = Z.bootstrap_exact(df, ["g"], "x", digits=2).first()
    assert (round(r["low"] * 2000), round(r["high"] * 2000)) == (low, high)
    with pytest.raises(ValueError):
        Z.bootstrap_exact(df, ["g"], "x", digits=12)


def test_scores_stay_in_their_tasks_at_a_gate(spark):
    scores = spark.range(3000).select((F.col("id") % 3).cast("int").alias("model_id"), "id")
    gate = spark.createDataFrame([(0, True, False), (1, False, True), (2, None, True)], "model_id int, passed boolean, rsu_passed boolean")
    met = U.gate_models(scores, gate)
    assert {r["model_id"]: r["count"] for r in met.groupBy("model_id").count().collect()} == {0: 1000}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_buckets_grow_before_they_are_many_and_ranks_join_without_a_shuffle(spark):
    df = frame(spark, "hot")
    for rows_of_one, most in ((50, 200), (2, 20_000 / 2 / 16 + 1)):
        sizes = [r["count"] for r in placed(df, ["a", "b"], 20_000, rows_of_one).groupBy("_bucket").count().collect()]
        assert sum(sizes) == 20_000 and 150 < len(sizes) <= most
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = bucketed_rank(df, ["a", "b"], ("g",), bucket_rows=50)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan
    rows = sorted((r["g"], r["a"], r["b"]) for r in df.collect())
    begins = {g: next(i for i, r in enumerate(rows) if r[0] == g) for g in range(3)}
    assert sorted((r["g"], r["a"], r["b"], r["rank"]) for r in ranked.collect()) == [(*r, i - begins[r[0]] + 1) for i, r in enumerate(rows)]
