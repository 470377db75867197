"""Model scores brought together, gates, client updates rolled up, privacy ledgers, shard statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnsift.functions.clean import clean_score, quantize
from tarnsift.operators.metrics import ratio


def align_scores(scores: DataFrame, n_models: int) -> DataFrame:
    """row_id, models, scores (in the order of model_id), complete: one row for each scored row."""
    packed = scores.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("model_id", "score"))).alias("p"))
    return packed.select("row_id", F.size("p").alias("models"), F.transform("p", lambda x: x["score"]).alias("scores"), (F.size("p") == n_models).alias("complete"))


def gate_models(scores: DataFrame, gate: DataFrame, global_pass: bool = True) -> DataFrame:
    """Scores of models that passed (gate: model_id, passed, rsu_passed): by the global gate, or the RSUs' own if that is off. The
    gate, a row for each model, goes to the scores; a shuffle by model would bring all scores into as many tasks as there are models."""
    ok = gate.where(F.col("passed") if global_pass else F.col("rsu_passed")).select("model_id")
    return scores.join(F.broadcast(ok), "model_id", "left_semi")


def clipped_mean(scores: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """row_id, fused: mean of the models' scores, each clipped."""
    return scores.groupBy("row_id").agg(F.avg(F.greatest(F.lit(low), F.least(F.lit(high), clean_score(F.col("score"))))).alias("fused"))


def best_single(metrics: DataFrame, value: str = "f1") -> DataFrame:
    """One row: the model best by the metric (least id on ties)."""
    return metrics.agg(F.max_by(F.struct("model_id", value), F.struct(F.col(value), -F.col("model_id"))).alias("b")).select("b.*")


def weighted_average(updates: DataFrame, by: tuple[str, ...], metrics: list[str], weight: str) -> DataFrame:
    """Example-weighted mean of each metric; null metrics leave the weights too."""
    mean = lambda m: F.sum(F.col(m) * F.col(weight)) / F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))
    return updates.groupBy(*by).agg(*[mean(m).alias(m) for m in metrics])


def round_rollup(updates: DataFrame) -> DataFrame:
    """A row for each (rsu, round): clients, examples, bytes and seconds, per client and per example."""
    out = updates.groupBy("rsu_id", "round").agg(F.count_distinct("vehicle_id").alias("clients"), F.sum("num_examples").alias("examples"), F.sum("upload_bytes").alias("upload"), F.sum("download_bytes").alias("download"), F.sum("train_seconds").alias("train_seconds"))
    total = F.col("upload") + F.col("download")
    return out.withColumn("bytes_per_client", ratio(total.cast("double"), F.col("clients"))).withColumn("bytes_per_example", ratio(total.cast("double"), F.col("examples")))


def run_overhead(rounds: DataFrame) -> DataFrame:
    """A row for each rsu: rounds, bytes and seconds of all rounds."""
    return rounds.groupBy("rsu_id").agg(F.count("*").alias("rounds"), F.sum("upload").alias("upload"), F.sum("download").alias("download"), F.sum("train_seconds").alias("train_seconds"))


# The layer that each measured component of a run belongs to.
LAYERS = {
    "local_train": "learning_core", "rsu_model_aggregation": "learning_core", "global_aggregation": "learning_core", "dp_record": "dp_evidence",
    "ssi_vehicle_report": "ssi_admission", "rsu_preselect": "ssi_admission", "rsu_ssi_verification": "ssi_admission", "rsu_merkle_build": "commitment",
    "rsu_zkp": "proof", "global_zkp": "proof", "global_artifact_export": "artifact_export", "export_index_write": "artifact_export",
}


def overhead_layers(measured: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, layer, seconds, share: measured (by, component, seconds) summed by layer, and its share of all layers. Null seconds are 0;
    components of no layer make one of their own, null."""
    layer = F.element_at(F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair]), F.col("component"))
    sums = measured.groupBy(*by, layer.alias("layer")).agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    return sums.withColumn("share", ratio(F.col("seconds"), F.sum("seconds").over(W.partitionBy(*by))))


def dp_round_stats(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("rsu_id", "round").agg(*[f(c).alias(f"{c}_{n}") for c in ("epsilon_u", "cumulative_u") for f, n in ((F.min, "min"), (F.avg, "mean"), (F.max, "max"))])


def dp_ledger(updates: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """updates (rsu_id, vehicle_id, round, epsilon_u: micro-units) with cumulative_u; start: stored cumulative_u of each vehicle."""
    over = W.partitionBy("rsu_id", "vehicle_id").orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    summed = updates.withColumn("cumulative_u", F.sum("epsilon_u").over(over))
    if start is None:
        return summed
    had = start.select("rsu_id", "vehicle_id", F.col("cumulative_u").alias("_had"))
    return summed.join(had, ["rsu_id", "vehicle_id"], "left").withColumn("cumulative_u", F.col("cumulative_u") + F.coalesce("_had", F.lit(0))).drop("_had")


def admit_top(updates: DataFrame, n: int) -> DataFrame:
    """Eligible updates with place and admitted: the first n of each (rsu, round) by vehicle, DID, client."""
    order = W.partitionBy("rsu_id", "round").orderBy("vehicle_id", "did", "client_id")
    return updates.where("eligible").withColumn("place", F.row_number().over(order)).withColumn("admitted", F.col("place") <= n)


def model_growth(rounds: DataFrame) -> DataFrame:
    """rounds (rsu_id, round, trees) with added: trees more than the round before."""
    return rounds.withColumn("added", F.col("trees") - F.coalesce(F.lag("trees").over(W.partitionBy("rsu_id").orderBy("round")), F.lit(0)))


def append_deltas(deltas: DataFrame) -> DataFrame:
    """deltas (model_id, seq, n_trees) to one row for each tree: tree_id counts on over the model's earlier deltas."""
    over = W.partitionBy("model_id").orderBy("seq")
    base = deltas.withColumn("first_tree", F.sum("n_trees").over(over) - F.col("n_trees"))
    return base.where("n_trees > 0").select("model_id", "seq", "first_tree", F.explode(F.sequence(F.lit(0), F.col("n_trees").cast("int") - 1)).alias("at")).select("model_id", "seq", F.col("at").alias("offset"), (F.col("first_tree") + F.col("at")).alias("tree_id"))


def anchor_sum(updates: DataFrame, by: tuple[str, ...], vector: str, length: int) -> DataFrame:
    """by, vectors, total: element-wise sum of vectors of the right length; others are left out."""
    parts = updates.where(F.size(vector) == length).select(*by, F.posexplode(vector).alias("pos", "v"))
    sums = parts.groupBy(*by, "pos").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    return sums.groupBy(*by).agg(F.max("n").alias("vectors"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("total"))


def quantized_anchors(df: DataFrame, vector: str, scale: int = 100_000) -> DataFrame:
    return df.withColumn(vector, F.transform(vector, lambda x: quantize(x.cast("double"), scale)))


def shard_stats(df: DataFrame, rsu: str, vehicle: str, label: str) -> DataFrame:
    """A row for each shard: rows, positives, negatives, share of positives, whether one class only."""
    out = df.groupBy(rsu, vehicle).agg(F.count("*").alias("n_rows"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return out.withColumn("share", F.col("pos") / F.col("n_rows")).withColumn("one_class", (F.col("pos") == 0) | (F.col("neg") == 0))


def shard_summary(shards: DataFrame) -> DataFrame:
    return shards.agg(F.count("*").alias("shards"), F.min("n_rows").alias("min_rows"), F.max("n_rows").alias("max_rows"), F.min("share").alias("min_share"), F.max("share").alias("max_share"), F.avg("share").alias("mean_share"), F.count_if("one_class").alias("one_class_shards"))


def shard_shift(df: DataFrame, shard: list[str], feature: str) -> DataFrame:
    """A row for each shard: mean, population sd, min, max of the feature and its standardised shift from the whole."""
    per = df.groupBy(*shard).agg(F.count("*").alias("n_rows"), F.avg(feature).alias("mean"), F.stddev_pop(feature).alias("sd"), F.min(feature).alias("lo"), F.max(feature).alias("hi"))
    whole = df.agg(F.avg(feature).alias("_m"), F.stddev_pop(feature).alias("_s"))
    return per.crossJoin(F.broadcast(whole)).withColumn("shift", F.when(F.col("_s") > 0, (F.col("mean") - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def participation(client_rounds: DataFrame) -> DataFrame:
    """A row for each (rsu, round), for each rsu and for all: expected, successful, failed, share, admitted, excluded (nulls mark totals)."""
    out = client_rounds.rollup("rsu_id", "round").agg(F.count("*").alias("expected"), F.count_if("ok").alias("successful"), F.count_if("admitted").alias("admitted"))
    return out.withColumn("failed", F.col("expected") - F.col("successful")).withColumn("share", F.col("successful") / F.col("expected")).withColumn("excluded", F.col("successful") - F.col("admitted"))
