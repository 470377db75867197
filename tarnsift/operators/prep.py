"""Preprocessing fitted on training rows only; the fitted state is a small table (column, kind, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsift.functions.clean import finite_or_null
from tarnsift.operators.quantiles import exact_quantiles


def _stacked(row: DataFrame, parts: list[tuple[str, str, str]]) -> DataFrame:
    """column, kind, value from one row with a column for each of parts (column, kind, name)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(n).cast("string").alias("value")) for c, k, n in parts])).alias("s")).select("s.*")


def fit_imputer(train: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Interpolated medians of finite values, by radix selection for all columns at once; null for a column without any.
    approximate: by rank, in one pass."""
    if approximate:
        row = train.agg(*[F.percentile_approx(finite_or_null(F.col(c).cast("double")), 0.5).alias(f"m{i}") for i, c in enumerate(cols)])
        return _stacked(row, [(c, "median", f"m{i}") for i, c in enumerate(cols)])
    found = exact_quantiles(train, cols, [0.5]).select(F.col("column").alias("_c"), F.get("values", F.lit(0)).cast("string").alias("value"))
    names = train.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(F.broadcast(found), F.col("column") == F.col("_c"), "left").select("column", F.lit("median").alias("kind"), "value")


def impute(df: DataFrame, model: DataFrame) -> DataFrame:
    return df.withColumns({r["column"]: F.coalesce(finite_or_null(F.col(r["column"]).cast("double")), F.lit(float(r["value"]))) for r in model.where("kind = 'median' and value is not null").collect()})


def fit_scaler(train: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population standard deviation (0 becomes 1) of columns without nulls."""
    row = train.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
    row = row.withColumns({f"std{i}": F.when(F.col(f"std{i}") > 0, F.col(f"std{i}")).otherwise(1.0) for i in range(len(cols))})
    return _stacked(row, [(c, k, f"{k}{i}") for i, c in enumerate(cols) for k in ("mean", "std")])


def scale(df: DataFrame, model: DataFrame) -> DataFrame:
    fitted: dict[str, dict[str, float]] = {}
    for r in model.where("kind in ('mean', 'std')").collect():
        fitted.setdefault(r["column"], {})[r["kind"]] = float(r["value"])
    return df.withColumns({c: (F.col(c) - v["mean"]) / v["std"] for c, v in fitted.items()})


def fit_categories(train: DataFrame, cols: list[str]) -> DataFrame:
    """Each column's categories, and its most frequent one (the least of several)."""
    long = train.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "column", "value").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    most = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return counts.select("column", F.lit("category").alias("kind"), "value").unionByName(most.select("column", F.lit("most_frequent").alias("kind"), "value"))


def one_hot(df: DataFrame, model: DataFrame) -> DataFrame:
    """A 0/1 column for each category, nulls as the most frequent; an unseen category is zero everywhere."""
    rows = model.where("kind in ('category', 'most_frequent')").collect()
    most = {r["column"]: r["value"] for r in rows if r["kind"] == "most_frequent"}
    made = {f"{r['column']}={r['value']}": (F.coalesce(F.col(r["column"]).cast("string"), F.lit(most.get(r["column"]))) == r["value"]).cast("int") for r in sorted(rows, key=lambda r: (r["column"], r["value"])) if r["kind"] == "category"}
    return df.withColumns(made).drop(*most)


def fit(train: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """The whole model: medians, then means and deviations of imputed columns, and categories. The medians come to the driver once
    and are not computed again with the rest."""
    medians = train.sparkSession.createDataFrame(fit_imputer(train, numeric).collect(), "column string, kind string, value string")
    model = medians.unionByName(fit_scaler(impute(train, medians), numeric))
    return model.unionByName(fit_categories(train, categorical)) if categorical else model


def transform(df: DataFrame, model: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Imputed and scaled numbers, one-hot categories and the columns to keep; others go. The model comes to the driver once."""
    rows = model.collect()
    known = df.sparkSession.createDataFrame(rows, "column string, kind string, value string")
    numbers = sorted({r["column"] for r in rows if r["kind"] == "mean"})
    texts = sorted({r["column"] for r in rows if r["kind"] == "most_frequent"})
    done = scale(impute(df.select(*keep, *numbers, *texts), known), known)
    return one_hot(done, known) if texts else done


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> DataFrame:
    return spark.read.schema("column string, kind string, value string").parquet(path)


def class_weight(train: DataFrame, label: str) -> DataFrame:
    """One row: pos, neg, weight (neg / pos), base_rate."""
    out = train.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return out.withColumn("weight", F.when(F.col("pos") > 0, F.col("neg") / F.col("pos")).otherwise(1.0)).withColumn("base_rate", F.col("pos") / (F.col("pos") + F.col("neg")))
