"""Tables in and out. Readers take explicit schemas where they can; a header row costs no inference pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_flows(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Flow CSV: header names trimmed, whole numbers widened to double. Without a schema, types are inferred."""
    df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    return df.select(*[(F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, (T.IntegerType, T.LongType)) else F.col(f"`{f.name}`")).alias(f.name.strip()) for f in df.schema.fields])


def read_class_files(spark: SparkSession, folder: str, expected_files: list[str], schema: str | T.StructType) -> DataFrame:
    """The union of a fixed set of CSV files with a column file; missing or extra files raise."""
    df = spark.read.csv(folder, header=True, schema=schema, pathGlobFilter="*.csv").withColumn("file", F.col("_metadata.file_name"))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    found = {r["file"] for r in listed.distinct().collect()}
    if found != set(expected_files):
        raise ValueError(f"missing {sorted(set(expected_files) - found)}, extra {sorted(found - set(expected_files))}")
    return df


def validate_schema(df: DataFrame, expected: list[str]) -> DataFrame:
    """df in the expected order; another set of columns raises."""
    if set(df.columns) != set(expected) or len(df.columns) != len(expected):
        raise ValueError(f"missing {sorted(set(expected) - set(df.columns))}, extra {sorted(set(df.columns) - set(expected))}")
    return df.select(*expected)


def write_splits(df: DataFrame, path: str, label: str, split: str = "split") -> None:
    """Parquet, one folder for each split, label first."""
    df.select(label, *[c for c in df.columns if c not in (label, split)], split).write.mode("overwrite").partitionBy(split).parquet(path)


def read_splits(spark: SparkSession, path: str, label: str, split: str = "split", parts: tuple[str, ...] = ("train", "val", "test")) -> dict[str, DataFrame]:
    """A frame for each split; partition pruning reads only its folder. A missing label or split raises."""
    df = spark.read.parquet(path)
    if label not in df.columns or split not in df.columns:
        raise ValueError(f"no column {label} or {split}")
    there = {r[0] for r in df.select(split).distinct().collect()}
    if not set(parts) <= there:
        raise ValueError(f"missing splits {sorted(set(parts) - there)}")
    return {p: df.where(F.col(split) == p).drop(split) for p in parts}


def role_by_prefix(path: Column, roles: dict[str, str], other: str = "other") -> Column:
    role = F.lit(other)
    for prefix in sorted(roles, key=len):  # the longest prefix decides
        role = F.when(path.startswith(prefix), roles[prefix]).otherwise(role)
    return role


def file_inventory(spark: SparkSession, root: str, roles: dict[str, str], ignore: str | None = None) -> DataFrame:
    """path (below root), size_bytes, sha256, role of every file, by path. Files are hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://", 1)[-1]
    path = F.element_at(F.split(F.col("path"), F.lit("\\Q" + base + "/\\E")), -1)
    out = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    out = out.where(~F.col("path").rlike(ignore)) if ignore else out
    return out.withColumn("role", role_by_prefix(F.col("path"), roles)).orderBy("path")


RUN_SCHEMA = "accuracy double, precision double, recall double, f1 double, auc double, threshold double, gate_passed boolean"


def read_run_results(spark: SparkSession, glob: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """One row for each result file with dataset, seed and method taken from .../<dataset>/seed_<n>/<method>/<file>.json."""
    at = r"([^/]+)/seed_(\d+)/([^/]+)/[^/]+$"
    df = spark.read.json(glob, schema=schema, multiLine=True).withColumn("_p", F.input_file_name())
    return df.select(F.regexp_extract("_p", at, 1).alias("dataset"), F.regexp_extract("_p", at, 2).cast("int").alias("seed"), F.regexp_extract("_p", at, 3).alias("method"), *[c for c in df.columns if c != "_p"])


def prep_manifest(df: DataFrame, label: str, split: str = "split", features: int | None = None, sampling: dict[str, object] | None = None) -> DataFrame:
    """A row for each split: rows, positives, negatives, features; sampling: how the rows were drawn (source rows, cap, fraction,
    seed), stated beside as columns of these names."""
    stated = {k: F.lit(v) for k, v in (sampling or {}).items()}
    n = features if features is not None else len([c for c in df.columns if c not in (label, split)])
    return df.groupBy(split).agg(F.count("*").alias("n_rows"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.lit(n).alias("n_features")).withColumns(stated)


def saved_problems(df: DataFrame, label: str, features: list[str], split: str = "split", balanced: str | None = None, splits: tuple[str, ...] = ()) -> DataFrame:
    """A row for each split, and for each of `splits` that is missing (no rows): n_rows, non_finite values, bad_labels, unbalanced."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")))
    total = sum((bad(c) for c in features[1:]), bad(features[0]))
    out = df.groupBy(split).agg(F.count("*").alias("n_rows"), total.alias("non_finite"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("bad_labels"), F.count_if(F.col(label) == 1).alias("_p"))
    if splits:
        named = df.sparkSession.createDataFrame([(s,) for s in splits], f"`{split}` string")
        out = named.join(out, split, "full_outer").na.fill(0, ["n_rows", "non_finite", "bad_labels", "_p"])
    return out.withColumn("unbalanced", (F.col(split) == balanced) & (2 * F.col("_p") != F.col("n_rows")) if balanced else F.lit(False)).drop("_p")


def verify_saved(df: DataFrame, label: str, features: list[str], split: str = "split", balanced: str | None = None, splits: tuple[str, ...] = ()) -> DataFrame:
    """Raises if the feature columns don't stand in the order of `features`, a split of `splits` is missing or empty, or a split has
    non-finite values, labels but 0 and 1, or (where asked) is not half and half."""
    if [c for c in df.columns if c in features] != list(features):
        raise ValueError("saved columns stand in another order")
    found = saved_problems(df, label, features, split, balanced, splits)
    if found.where("n_rows = 0 or non_finite > 0 or bad_labels > 0 or unbalanced").limit(1).count():
        raise ValueError("saved splits are faulty")
    return found
