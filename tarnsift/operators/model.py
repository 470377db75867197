"""Detectors on Spark: boosted trees, ensembles over shards, isolation scores, open-set reports."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsift.operators import boosting as B
from tarnsift.operators.fusion import clipped_mean, gate_models
from tarnsift.operators.metrics import best_f1_exact, best_f1_grid, binary_metrics, confusion, fpr_statistic, percentile_vs_reference, roc_auc
from tarnsift.operators.primitives import hash_unit, join_keys
from tarnsift.sources.shared import stored


def train_detector(train: DataFrame, cols: list[str], label: str, key: list[str], settings: B.Settings = B.Settings(), val: DataFrame | None = None) -> B.Boosted:
    """Boosted trees with positives weighted by negatives / positives; with val, rounds stop when its log loss stops falling."""
    return B.fit(train, cols, label, key, settings, val=val)


def score(df: DataFrame, detector: B.Boosted, out: str = "score", which: int = 0) -> DataFrame:
    """df with the probability of label 1."""
    return B.margins(df, detector, which).withColumn(out, 1 / (1 + F.exp(-F.get("_m", F.lit(0))))).drop("_m")


def train_multiclass(train: DataFrame, cols: list[str], family: str, key: list[str], settings: B.Settings = B.Settings(), val: DataFrame | None = None) -> B.Boosted:
    """Boosted trees by softmax over the families of train, in the order of their names."""
    names = [r[0] for r in train.select(family).where(F.col(family).isNotNull()).distinct().orderBy(family).collect()]
    return B.fit(train, cols, family, key, settings, classes=names, val=val)


def score_multiclass(df: DataFrame, fitted: B.Boosted) -> DataFrame:
    """df with p0, p1, ...: a probability for each class of fitted.classes."""
    made = B.margins(df, fitted).withColumn("_m", F.transform("_m", lambda x: F.exp(x - F.array_max("_m"))))
    total = F.aggregate("_m", F.lit(0.0), lambda s, x: s + x)
    return made.withColumn("_t", total).withColumns({f"p{i}": F.get("_m", F.lit(i)) / F.col("_t") for i in range(len(fitted.classes))}).drop("_m", "_t")


def ensemble(train: DataFrame, val: DataFrame, test: DataFrame, shard: str, key: str, cols: list[str], label: str, least_f1: float = 0.0, settings: B.Settings = B.Settings()) -> DataFrame:
    """A detector for each of the few shards, all trained in the same jobs, gated by its validation F1, fused by mean score,
    threshold from validation: one row of metrics on test, the threshold, and the same of the single model that is best
    on validation (best_model, best_threshold, best_f1, best_auc) beside the fused scores' auc."""
    fitted = B.fit(train, cols, label, [key], settings, model=shard)

    def scored(part: DataFrame) -> DataFrame:
        rows = part.select(F.col(key).alias("row_id"), F.col(label).alias("y"), *[F.col(c) for c in cols if c not in ("row_id", "y")])
        for i in range(len(fitted.models)):
            rows = score(rows, fitted, f"_s{i}", i)
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("model_id"), F.col(f"_s{i}").alias("score")) for i in range(len(fitted.models))]))
        return stored(rows.select("row_id", "y", each.alias("_e")).select("row_id", "y", "_e.*"), "scores")

    scores = {"val": scored(val), "test": scored(test)}
    single = stored(best_f1_grid(scores["val"], "y", "score", by=("model_id",)), "gates")
    gate = single.select("model_id", (F.col("f1") >= least_f1).alias("passed"), (F.col("f1") >= least_f1).alias("rsu_passed"))
    fused = {n: clipped_mean(gate_models(s.drop("y"), gate)).join(s.where("model_id = 0").select("row_id", "y"), "row_id") for n, s in scores.items()}
    cut = best_f1_exact(fused["val"], "y", "fused")
    flagged = fused["test"].crossJoin(F.broadcast(cut.select("threshold"))).withColumn("pred", (F.col("fused") >= F.col("threshold")).cast("int"))
    best = single.agg(F.max_by(F.struct("model_id", "threshold"), F.struct("f1", -F.col("model_id"))).alias("b")).select(F.col("b.model_id").alias("best_model"), F.col("b.threshold").alias("best_threshold"))
    own = scores["test"].join(F.broadcast(best), F.col("model_id") == F.col("best_model")).withColumn("pred", (F.col("score") >= F.col("best_threshold")).cast("int"))
    beside = binary_metrics(confusion(own, "y", "pred")).select(F.col("f1").alias("best_f1")).crossJoin(roc_auc(own, "y", "score").select(F.col("auc").alias("best_auc"))).crossJoin(best)
    return binary_metrics(confusion(flagged, "y", "pred")).crossJoin(cut.select("threshold")).crossJoin(roc_auc(fused["test"], "y", "fused")).crossJoin(beside)


def _path_rest(n: Column) -> Column:
    """The mean path below a leaf of n rows."""
    return F.when(n > 2, 2 * (F.log(n - 1.0) + 0.5772156649) - 2 * (n - 1.0) / n).when(n == 2, 1.0).otherwise(0.0)


def _deepest(sample: int) -> int:
    return math.ceil(math.log2(max(sample, 2)))


def isolation_forest(benign: DataFrame, cols: list[str], key: list[str], trees: int = 200, sample: int = 4096, cap: int = 150_000, seed: int = 42) -> DataFrame:
    """tree, node, feature (its number; null for a leaf), cut, rest: every tree in a table, grown level by level. Each tree takes
    about `sample` of at most about `cap` benign rows by hash; a level is one grouped minimum and maximum of all features,
    and a node's feature (among those that vary) and cut follow from a hash of its number. Smaller values go to 2n + 1, the
    others to 2n + 2; a node without rows has no row in the table. Nulls and NaN count as 0."""
    n = benign.count()
    value = lambda c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0))
    pool = benign.where(hash_unit(*key, seed=seed) < cap / max(n, 1)).select(F.array(*[value(c) for c in cols]).alias("x"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in key]).alias("key"))
    rate = sample / max(min(n, cap), 1)
    dealt = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(hash_unit("key", "tree", seed=seed + 1) < rate)
    rows = stored(dealt.select("tree", F.lit(0).alias("node"), "x"), "isolation")
    levels, deepest = [], _deepest(sample)
    for level in range(deepest + 1):
        ends = [f(F.get("x", F.lit(i))).alias(f"{k}{i}") for i in range(len(cols)) for k, f in (("lo", F.min), ("hi", F.max))]
        stats = rows.groupBy("tree", "node").agg(F.count("*").alias("n"), *ends)
        spans = F.filter(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i in range(len(cols))]), lambda s: s["hi"] > s["lo"])
        drawn = stats.withColumn("spans", spans).withColumn("own", F.get("spans", F.floor(hash_unit("tree", "node", F.lit("feature"), seed=seed) * F.size("spans")).cast("int")))
        inner = F.lit(level < deepest) & (F.col("n") > 1) & F.col("own").isNotNull()
        cut = F.col("own.lo") + hash_unit("tree", "node", F.lit("cut"), seed=seed) * (F.col("own.hi") - F.col("own.lo"))
        nodes = stored(drawn.select("tree", "node", F.when(inner, F.col("own.f")).alias("feature"), F.when(inner, cut).alias("cut"), F.when(~inner, _path_rest(F.col("n"))).alias("rest")), "nodes")
        levels.append(nodes)
        if not nodes.where("feature is not null").limit(1).count():
            break
        met = rows.join(nodes.where("feature is not null").select("tree", "node", "feature", "cut"), ["tree", "node"])
        rows = stored(met.select("tree", (2 * F.col("node") + 1 + (F.get("x", F.col("feature")) >= F.col("cut")).cast("int")).alias("node"), "x"), "isolation", rows)
    out = levels[0]
    for nodes in levels[1:]:
        out = out.unionByName(nodes)
    return out


def isolation_scores(df: DataFrame, benign: DataFrame, cols: list[str], key: list[str], trees: int = 200, sample: int = 4096, cap: int = 150_000, seed: int = 42, out: str = "anomaly") -> DataFrame:
    """df with an isolation-forest score: 2 to the power of minus the mean path over the expected one. The trees (bounded by trees x
    sample leaves) come to the driver once and go to the tasks as arrays, through which each batch of rows walks at once."""
    forest: dict[int, dict[int, tuple]] = {}
    for r in isolation_forest(benign, cols, key, trees, sample, cap, seed).collect():
        forest.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["cut"], r["rest"])
    norm = 2 * (math.log(max(sample - 1, 1)) + 0.5772156649) - 2 * (sample - 1) / sample
    if not forest:
        return df.withColumn(out, F.pow(F.lit(2.0), F.lit(-1.0)))
    roots, feature, cut, child, path = _packed([forest[t] for t in sorted(forest)])
    deepest = _deepest(sample)

    @F.arrow_udf("double")
    def paths(*values: pa.Array) -> pa.Array:
        x = np.stack([v.to_numpy(zero_copy_only=False).astype(float) for v in values], axis=1)
        x = np.where(np.isnan(x), 0.0, x).ravel()  # nulls have become NaN
        rows, total = np.arange(len(values[0])) * len(values), np.zeros(len(values[0]))
        for root in roots:
            node = np.full(len(rows), root)
            for _ in range(deepest):
                node = child[2 * node + (x[rows + feature[node]] >= cut[node])]
            total += path[node]
        return pa.array(total)

    mean = paths(*[F.col(c).cast("double") for c in cols]) / len(forest)
    return df.withColumn(out, F.pow(F.lit(2.0), -mean / norm))


def _packed(trees: list[dict[int, tuple]]) -> list[np.ndarray]:
    """The place of each tree's root, and of all nodes the feature, cut, places of both children and, for leaves, the path that
    ends there. A leaf's children are the leaf itself; a child without rows is a leaf at the end of its tree."""
    roots, feature, cut, child, path = [], [], [], [], []
    for tree in trees:
        start, numbers = len(feature), sorted(tree)
        place = {n: start + i for i, n in enumerate(numbers)}
        missing = []
        roots.append(start)
        for n in numbers:
            f, c, rest = tree[n]
            depth = (n + 1).bit_length() - 1
            feature.append(0 if f is None else f)
            cut.append(0.0 if f is None else c)
            path.append(depth + rest if f is None else 0.0)
            for m in (2 * n + 1, 2 * n + 2):
                if f is None:
                    child.append(place[n])
                elif m in place:
                    child.append(place[m])
                else:
                    child.append(start + len(numbers) + len(missing))
                    missing.append(float(depth + 1))
        for i, at in enumerate(missing):
            feature.append(0)
            cut.append(0.0)
            path.append(at)
            child += [start + len(numbers) + i] * 2
    return [np.array(x) for x in (roots, feature, cut, child, path)]


def open_set_report(cal: DataFrame, test: DataFrame, label: str, supervised: str, novelty: str, by: str) -> DataFrame:
    """by, rule, threshold, novelty_threshold, counts, metrics, auc, novelty_auc; cal and test carry `by`, the held-out family, and
    everything is decided inside it. Rules: the best F1 threshold of an even grid and the 1 % false-positive threshold, both
    with the AUC of the supervised score, and either score above its 0.5 % threshold, with the AUC of the greater of the two
    scores' percentiles among the family's own benign calibration rows. novelty_auc is that of the novelty score alone."""
    own = lambda x: x.select(F.col(by).alias("_f"), F.col(label).alias("_y"), F.col(supervised).alias("_s"), F.col(novelty).alias("_n"))
    cal, test = own(cal), own(test)
    benign = cal.where("_y = 0")
    family = ("_f",)
    at = lambda score, target, name: fpr_statistic(benign, score, [target], family).select("_f", F.col("exceed").alias(name))
    cuts = best_f1_grid(cal, "_y", "_s", 0.01, 0.99, 199, family, 0.01).select("_f", F.col("threshold").alias("_t_f1"))
    for c in (at("_s", 0.01, "_t_fpr"), at("_s", 0.005, "_t_s"), at("_n", 0.005, "_t_n")):
        cuts = join_keys(cuts, c, ["_f"], "left")
    ranked = percentile_vs_reference(percentile_vs_reference(test, benign, "_s", "_ps", family), benign, "_n", "_pn", family)
    flagged = stored(join_keys(ranked, F.broadcast(cuts), ["_f"]).withColumn("_hybrid", F.greatest("_ps", "_pn")), "open_set")
    over = lambda s, t: F.coalesce(F.col(s) > F.col(t), F.lit(False))
    none = F.lit(None).cast("double")
    rules = {
        "f1_threshold": (F.coalesce(F.col("_s") >= F.col("_t_f1"), F.lit(False)), F.col("_t_f1"), none),
        "fpr_1pct": (over("_s", "_t_fpr"), F.col("_t_fpr"), none),
        "hybrid_or": (over("_s", "_t_s") | over("_n", "_t_n"), F.col("_t_s"), F.col("_t_n")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("int").alias("pred"), t.alias("t"), u.alias("u")) for n, (c, t, u) in rules.items()]))
    long = flagged.select("_f", "_y", each.alias("_r")).select("_f", "_y", "_r.*")
    found = binary_metrics(confusion(long, "_y", "pred", ("_f", "rule", "t", "u")))
    scores = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("s")) for k, c in (("supervised", "_s"), ("hybrid", "_hybrid"), ("novelty", "_n"))]))
    auc = roc_auc(flagged.select("_f", "_y", scores.alias("_r")).select("_f", "_y", "_r.*"), "_y", "s", ("_f", "k"))
    wide = auc.groupBy("_f").agg(*[F.max(F.when(F.col("k") == k, F.col("auc"))).alias(f"_a_{k}") for k in ("supervised", "hybrid", "novelty")])
    out = join_keys(found, wide, ["_f"]).withColumn("auc", F.when(F.col("rule") == "hybrid_or", F.col("_a_hybrid")).otherwise(F.col("_a_supervised")))
    return out.withColumnsRenamed({"_f": by, "t": "threshold", "u": "novelty_threshold", "_a_novelty": "novelty_auc"}).drop("_a_supervised", "_a_hybrid")
