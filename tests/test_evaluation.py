import math

from pyspark.sql import functions as F

from tarnsift.operators import metrics as X
from tarnsift.operators import stats as Z
from tarnsift.operators import temporal as T


def test_false_positive_rate_holds(spark):
    df = spark.range(1000).select((F.col("id") / 999).alias("s"))
    cut = X.fpr_statistic(df, "s", [0.01, 0.0001]).collect()
    by = {r["target"]: r["exceed"] for r in cut}
    assert df.where(F.col("s") > by[0.01]).count() <= 10
    assert df.where(F.col("s") > by[0.0001]).count() == 0


def test_pooled_recall(spark):
    folds = X.binary_metrics(spark.createDataFrame([(1, 90, 10, 2, 8, True), (2, 95, 5, 1, 9, True), (3, 5, 5, 5, 5, False)], "fold int, tn long, fp long, fn long, tp long, eligible boolean"))
    assert abs(T.pooled_folds(folds).first()["recall"] - 0.85) < 1e-12


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert X.roc_auc(df, "y", "s").first()["auc"] == 0.625
    assert X.roc_auc(df.where("y = 1"), "y", "s").first()["auc"] is None
    assert X.roc_auc(df.where("y = 1"), "y", "s", one_class=0.0).first()["auc"] == 0.0


def test_zero_denominators(spark):
    r = X.binary_metrics(spark.createDataFrame([(5, 0, 0, 0), (0, 0, 0, 0)], "tn long, fp long, fn long, tp long")).collect()
    assert r[0]["precision"] == r[0]["recall"] == 0.0 and r[0]["balanced_accuracy"] is None and r[1]["accuracy"] is None


def test_score_one_is_in_no_calibration_bin(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (0, 0.2), (1, 0.9)], "y int, s double")
    assert abs(X.ece(df, "y", "s").first()["ece"] - (0.2 + 0.1) / 4) < 1e-9


def test_exact_threshold_prefers_the_lowest(spark):
    df = spark.createDataFrame([(1, 0.8), (1, 0.6), (0, 0.2)], "y int, s double")
    assert tuple(X.best_f1_exact(df, "y", "s").first()) == (0.6, 1.0)
    assert tuple(X.best_f1_exact(df.where("y = 1"), "y", "s").first()) == (0.5, 0.0)


def test_nearest_rank(spark):
    r = X.describe_nearest_rank(spark.range(1, 21).select(F.col("id").cast("double").alias("v")), "v").first()
    assert r["p95"] == 19.0 and r["median"] == 10.5
    assert X.describe_nearest_rank(spark.createDataFrame([], "v double"), "v").first()["p95"] == 0.0


def test_wilson(spark):
    r = X.wilson_interval(spark.createDataFrame([(0, 10), (10, 10), (0, 0)], "k long, n long"), "k", "n").collect()
    assert r[0]["wilson_low"] == 0.0 and abs(r[0]["wilson_high"] - 0.277533) < 1e-5 and r[1]["wilson_high"] > 1 - 1e-12 and r[2]["wilson_low"] is None


def test_holm_and_sign_flips(spark):
    p = spark.createDataFrame([("d", "a", 0.01), ("d", "b", 0.04), ("d", "c", 0.03), ("d", "e", 0.5)], "dataset string, k string, p double")
    got = {r["k"]: round(r["p_holm"], 9) for r in Z.holm(p, ["dataset"], "p", ["k"]).collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "e": 0.5}
    d = spark.createDataFrame([("g", float(i)) for i in (1, 2, 3, 4, 5)], "g string, diff double")
    r = Z.sign_flip_test(d, ["g"]).first()
    assert r["p_value"] == 2 / 32 and r["mean_diff"] == 3.0


def test_sign_flips_of_many_pairs(spark):
    d = spark.createDataFrame([(g, float(x)) for g, sign in (("one", 1), ("both", -1)) for i in range(24) for x in [(i + 1) * (sign if i % 2 else 1)]], "g string, diff double")
    got = {r["g"]: r for r in Z.sign_flip_test(d, ["g"]).collect()}
    assert got["one"]["n"] == 24 and got["one"]["mean_diff"] == 12.5 and got["one"]["p_value"] < 0.001 and 0.5 < got["both"]["p_value"] <= 1


def test_rows_without_a_score(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1), (1, None), (0, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    curve = {r["s"]: r[1:] for r in X.score_counts(df, "y", "s").collect()}
    assert curve == {0.1: (0, 1, 0, 1), 0.8: (1, 1, 1, 2), 0.9: (1, 0, 2, 2), None: (1, 1, 3, 3)}
    best = X.best_f1_exact(df, "y", "s").first()
    assert best["threshold"] == 0.8 and best["f1"] == round(4 / 6, 12) and X.roc_auc(df, "y", "s").first()["auc"] == 3.5 / 4


def test_exact_bootstrap_against_all_resamples(spark):
    import itertools

    v = [1.0, 2.0, 4.0]
    means = sorted(sum(c) / 3 for c in itertools.product(v, repeat=3))
    r = Z.bootstrap_exact(spark.createDataFrame([("g", x) for x in v], "g string, x double"), ["g"], "x").first()
    assert math.isclose(r["low"], means[math.ceil(27 * 0.025) - 1]) and math.isclose(r["high"], means[math.ceil(27 * 0.975) - 1])


def test_scores_are_clamped_before_they_are_compared_and_nans_take_no_rank(spark):
    df = spark.createDataFrame([(1, 1.5), (1, 1.0), (0, 0.2), (0, float("nan"))], "y int, s double")
    assert tuple(X.best_f1_exact(df, "y", "s").first()) == (1.0, 1.0)
    assert tuple(X.best_f1_exact(spark.createDataFrame([(1, None), (0, 0.3)], "y int, s double"), "y", "s").first()) == (0.5, 0.0)
    odd = spark.createDataFrame([(i / 100,) for i in range(100)] + [(float("nan"),)] * 3 + [(float("inf"),), (None,)], "s double")
    assert X.fpr_statistic(odd, "s", [0.01]).first()["exceed"] == 0.98


def test_sensitivity_equals_counting_by_target(spark):
    import random

    r = random.Random(1)
    rows = [(r.randint(0, 1), r.choice([None, r.random(), r.random()]), r.random() < 0.5) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double, cal boolean")
    got = {x["target"]: x for x in X.fpr_sensitivity(df.where("cal"), df.where("not cal"), "y", "s", [0.01, 0.1, 0.5]).collect()}
    assert len(got) == 3
    for t in got.values():
        test = [(y, s) for y, s, cal in rows if not cal and s is not None]
        assert (t["tp"], t["fp"]) == tuple(sum(y == k and s > t["exceed"] for y, s in test) for k in (1, 0)) and t["tp"] + t["fn"] + t["fp"] + t["tn"] == len(test)


def test_fitting_equals_imputing_and_scaling_and_survives_saving(spark, tmp_path):
    from tarnsift.operators import prep as M

    df = spark.createDataFrame([(None if i % 3 == 0 else float(i * i), 5.0, None if i % 5 == 0 else "ab"[i % 2]) for i in range(50)], "x double, c double, k string")
    model = M.fit(df, ["x", "c"], ["k"])
    got = {(r["column"], r["kind"]): float(r["value"]) for r in model.where("kind in ('median', 'mean', 'std')").collect()}
    filled = M.impute(df, M.fit_imputer(df, ["x", "c"]))
    want = {(r["column"], r["kind"]): float(r["value"]) for r in M.fit_scaler(filled, ["x", "c"]).collect()}
    assert all(math.isclose(got[k], v, rel_tol=1e-12) for k, v in want.items()) and got["c", "std"] == 1.0
    M.save_model(model, f"{tmp_path}/m")
    again = M.transform(df, M.load_model(spark, f"{tmp_path}/m"))
    assert sorted(again.columns) == ["c", "k=a", "k=b", "x"] and sorted(map(tuple, again.collect())) == sorted(map(tuple, M.transform(df, model).collect()))
