"""Leakage audits: duplicates, overlap between parts, ambiguous patterns. Keys are counted before anything is joined, so a
pattern that repeats a million times is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnsift.operators.primitives import membership_flag


def class_distribution(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def overlap_rows(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """label, n_rows, overlapping, share: rows of a whose key occurs in b."""
    flagged = membership_flag(a, b, key, "_seen")
    return flagged.groupBy(label).agg(F.count("*").alias("n_rows"), F.count_if("_seen").alias("overlapping")).withColumn("share", F.col("overlapping") / F.col("n_rows"))


def remove_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def key_intersections(df: DataFrame, key: str, split: str, parts: list[str]) -> DataFrame:
    """One row: distinct keys that each pair of parts, and all of them, share. One shuffle, no join."""
    has = df.groupBy(key).agg(*[F.bool_or(F.col(split) == p).alias(p) for p in parts])
    pairs = [(a, b) for i, a in enumerate(parts) for b in parts[i + 1 :]]
    everyone: Column = F.lit(True)
    for p in parts:
        everyone = everyone & F.col(p)
    return has.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs], F.count_if(everyone).alias("all_parts"))


def duplicate_stats(df: DataFrame, key: list[str], split: str) -> DataFrame:
    """split, n_rows, n_keys, duplicate_rows (beyond a key's first), duplicate_share."""
    per_key = df.groupBy(split, *key).agg(F.count("*").alias("n"))
    out = per_key.groupBy(split).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))
    dup = F.col("n_rows") - F.col("n_keys")
    return out.withColumn("duplicate_rows", dup).withColumn("duplicate_share", dup / F.col("n_rows"))


def split_audit(df: DataFrame, key: list[str], split: str = "split", label: str = "label") -> DataFrame:
    """A row for each part: duplicate statistics, positives, rows whose key also stands in another part, and whether it is disjoint."""
    per_key = df.groupBy(split, *key).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    parts = per_key.groupBy(*key).agg(F.collect_list(F.struct(split, "n", "pos")).alias("_l"))  # as many as the key has parts
    each = parts.select(F.size("_l").alias("_parts"), F.explode("_l").alias("_e")).select("_parts", "_e.*")
    out = each.groupBy(split).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum("pos").cast("long").alias("positives"), F.sum(F.when(F.col("_parts") > 1, F.col("n")).otherwise(0)).alias("overlap_rows"))
    return out.withColumn("duplicate_rows", F.col("n_rows") - F.col("n_keys")).withColumn("is_disjoint", F.col("overlap_rows") == 0)


def ambiguous_keys(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """One row: n_keys, ambiguous_keys (more than one label), ambiguous_rows, ambiguous_share."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"))
    out = per.agg(F.count("*").alias("n_keys"), F.count_if(F.col("labels") > 1).alias("ambiguous_keys"), F.sum(F.when(F.col("labels") > 1, F.col("n")).otherwise(0)).alias("ambiguous_rows"), F.sum("n").alias("_n"))
    return out.withColumn("ambiguous_share", F.col("ambiguous_rows") / F.col("_n")).drop("_n")


def keys_per_family(df: DataFrame, key: list[str], family: str) -> DataFrame:
    return df.select(family, *key).distinct().groupBy(family).agg(F.count("*").alias("n_keys"))


def collapse_patterns(df: DataFrame, key: list[str], label: str, score: str) -> DataFrame:
    """key, label, score (mean), n: one row for each unambiguous key."""
    per = df.groupBy(*key).agg(F.count_distinct(label).alias("_labels"), F.min(label).alias(label), F.avg(score).alias(score), F.count("*").alias("n"))
    return per.where("_labels = 1").drop("_labels")


def collapse_status(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """One row: n_rows, patterns, unambiguous, collapse_ratio, status."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"), F.min(label).alias("y"))
    one = F.col("labels") == 1
    out = per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("patterns"), F.count_if(one).alias("unambiguous"), F.count_distinct(F.when(one, F.col("y"))).alias("_classes"))
    status = F.when(F.col("unambiguous") == 0, "not_evaluable").when(F.col("_classes") < 2, "class_incomplete").otherwise("evaluated")
    return out.withColumn("collapse_ratio", F.col("unambiguous") / F.col("n_rows")).withColumn("status", status).drop("_classes")


def collapse_probabilities(df: DataFrame, key: list[str], label: str, classes: list[str]) -> DataFrame:
    """The multiclass form: mean of every class column for each unambiguous key."""
    per = df.groupBy(*key).agg(F.count_distinct(label).alias("_labels"), F.min(label).alias(label), *[F.avg(c).alias(c) for c in classes])
    return per.where("_labels = 1").drop("_labels")
