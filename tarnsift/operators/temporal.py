"""Evaluation over time blocks and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsift.operators.metrics import binary_metrics, confusion, finite_stats, ratio, roc_auc, score_categories, score_quantiles
from tarnsift.operators.primitives import join_keys
from tarnsift.operators.quantiles import with_quantiles


def block_profile(df: DataFrame, block: str, ts: str, label: str, family: str) -> DataFrame:
    """A row for each block: rows, benign, attacks, attack types and their list, first and last time, distinct times."""
    attack = F.when(F.col(label) == 1, F.col(family))
    return df.groupBy(block).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("attacks"), F.count_distinct(attack).alias("attack_types"),
        F.array_join(F.array_sort(F.collect_set(attack)), ",").alias("attack_list"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_distinct(ts).alias("distinct_ts"),
    )


def attack_coverage(df: DataFrame, block: str, ts: str, label: str, family: str, n: int) -> DataFrame:
    """A row for each attack: rows, first and last time and block, blocks present, and B1..Bn counts."""
    attacks = df.where(F.col(label) == 1)
    wide = [F.count_if(F.col(block) == i).alias(f"b{i}") for i in range(1, n + 1)]
    return attacks.groupBy(family).agg(F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min(block).alias("first_block"), F.max(block).alias("last_block"), F.count_distinct(block).alias("blocks_present"), *wide)


def fold_cube(df: DataFrame, pos: str, label: str, family: str, key: str, score: str, pred: str) -> DataFrame:
    """pos, label, family, score, pred, first, n: rows counted by their position in time (fold_positions), what they are, how they are
    judged, and the first position at which their pattern `key` stands. What a fold has seen is what first stands at or before
    the end of its training, so all folds are read off these counts; a null key is a pattern too."""
    cells = df.groupBy(F.col(pos).alias("pos"), F.col(label).alias("label"), F.col(family).alias("family"), F.col(score).cast("double").alias("score"), F.col(pred).alias("pred"), F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    first = cells.groupBy("_key").agg(F.min("pos").alias("first"))
    return join_keys(cells, first, ["_key"]).groupBy("pos", "label", "family", "score", "pred", "first").agg(F.sum("n").alias("n"))


def fold_rows(cube: DataFrame, spec: DataFrame) -> DataFrame:
    """fold, role, endpoint, seen_pattern and the cube's columns: the counts of each fold's calibration and test parts, by fold_spec.
    endpoint of test rows: benign, seen (an attack of the family stands in the fold's training) or novel."""
    known = cube.where("label = 1").groupBy("family").agg(F.min("pos").alias("_known"))
    met = join_keys(cube, known, ["family"], "left").join(F.broadcast(spec), "pos")
    endpoint = F.when(F.col("label") == 0, "benign").when(F.col("_known") <= F.col("train_to"), "seen").otherwise("novel")
    return met.withColumn("endpoint", F.when(F.col("role") == "test", endpoint)).withColumn("seen_pattern", F.col("first") <= F.col("train_to")).drop("_known", "train_to")


def seen_novel_metrics(rows: DataFrame, min_rows: int = 10) -> DataFrame:
    """A row for each (fold, endpoint): the endpoint's attacks with all benign test rows: counts, metrics, AUC, eligible, reason."""
    each = F.explode(F.when(F.col("endpoint") == "benign", F.array(F.lit("seen"), F.lit("novel"))).otherwise(F.array("endpoint")))
    both = rows.where("role = 'test'").withColumn("endpoint", each).groupBy("fold", "endpoint", "label", "score", "pred").agg(F.sum("n").alias("n"))
    by = ("fold", "endpoint")
    out = binary_metrics(confusion(both, "label", "pred", by, "n")).join(roc_auc(both, "label", "score", by, weight="n"), list(by))
    attacks, benign = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    reason = F.when(attacks == 0, "no_attacks").when(attacks < min_rows, "too_few_attacks").when(benign == 0, "no_benign").otherwise("ok")
    return out.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "ok")


def per_attack_recall(rows: DataFrame) -> DataFrame:
    """A row for each (fold, family): rows, recall, endpoint, rows and recall of patterns seen and not seen in training, score q10/q50/q90."""
    attacks = rows.where("role = 'test' and label = 1")
    hit = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    seen, caught = F.col("seen_pattern"), F.col("pred") == 1
    by = ("fold", "family", "endpoint")
    out = attacks.groupBy(*by).agg(F.sum("n").alias("n_rows"), hit(caught).alias("_all"), hit(seen).alias("seen_rows"), hit(seen & caught).alias("_s"), hit(~seen & caught).alias("_u"))
    out = with_quantiles(out, attacks, "score", {"q10": 0.1, "q50": 0.5, "q90": 0.9}, by, weight="n")
    unseen = F.col("n_rows") - F.col("seen_rows")
    return out.withColumns({"recall": ratio(F.col("_all"), F.col("n_rows")), "unseen_rows": unseen, "seen_recall": ratio(F.col("_s"), F.col("seen_rows")), "unseen_recall": ratio(F.col("_u"), unseen)}).drop("_all", "_s", "_u")


def fold_score_quantiles(rows: DataFrame, qs: list[float]) -> DataFrame:
    """fold, category, n, q<percent>: quantiles of the scores of each fold's five categories (metrics.CATEGORIES)."""
    return score_quantiles(score_categories(rows, "role", "label", F.col("endpoint") == "seen"), "score", ("fold", "category"), qs, "n")


#: How pooling ends: some fold counts, none does.
POOLED = ("ok", "no_eligible_seen_attack_temporal_evaluations")


def pooled_folds(folds: DataFrame) -> DataFrame:
    """One row: status, summed counts of eligible folds with seen attacks, their metrics, and the mean, deviation, median and ends of
    fold recall, f1, fpr and auc (null where folds carry none)."""
    good = folds.where(F.col("eligible") & (F.col("tp") + F.col("fn") > 0))
    spread = ("recall", "f1", "fpr", "auc")
    good = good if "auc" in good.columns else good.withColumn("auc", F.lit(None).cast("double"))
    sums = binary_metrics(good.agg(F.count("*").alias("folds"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")]))
    out = sums.withColumn("status", F.when(F.col("folds") > 0, POOLED[0]).otherwise(POOLED[1]))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in spread]))
    stats = finite_stats(good.select(each.alias("e")).select("e.*"), "v", ("c",))
    named = {"mean": "mean", "sd": "sd", "median": "median", "lo": "min", "hi": "max"}
    return out.crossJoin(stats.agg(*[F.max(F.when(F.col("c") == c, F.col(s))).alias(f"{c}_{n}") for c in spread for s, n in named.items()]))


def pooled_attack_recall(per_attack: DataFrame, family: str) -> DataFrame:
    """family, folds, n_rows, recall (weighted by rows), mean, least and greatest fold recall."""
    return per_attack.groupBy(family).agg(F.count_distinct("fold").alias("folds"), F.sum("n_rows").alias("n_rows"), (F.sum(F.col("recall") * F.col("n_rows")) / F.sum("n_rows")).alias("recall"), F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"), F.max("recall").alias("max_recall"))
