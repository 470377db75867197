"""How the given tables stand for flows, scores, updates and receipts; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["q", "d", "t"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flows: row_id, q, d, t, price, ts, supp, family, label, score."""
    days, cents = F.unix_date(F.col("l_shipdate").cast("date")), F.round(F.col("l_extendedprice") * 100).cast("long")
    family = F.when(F.col("l_returnflag") == "N", "BENIGN").otherwise(F.concat_ws("-", "l_returnflag", "l_linestatus"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", days, cents).alias("row_id"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
        F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("okey"), family.alias("family"), (family != "BENIGN").cast("int").alias("label"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("l_quantity") / 100 + F.col("l_discount") * 5)).alias("score"),
    )


FLOWS = """flows AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_shipdate::DATE - DATE '1970-01-01'), CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
         l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice AS price, l_shipdate AS ts, l_suppkey AS supp, l_orderkey AS okey,
         CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE l_returnflag || '-' || l_linestatus END AS family,
         CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS label,
         least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_quantity / 100 + l_discount * 5)) AS score
  FROM lineitem)"""


def unit(text: str, seed: int = 42) -> str:
    """SQL of hash_unit."""
    return f"(('0x' || substr(md5({text} || '|{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


#: Sum of a hash of the ids: says which rows stand in a group, as one number.
ID_SUM = "CAST(sum(('0x' || substr(md5(row_id), 1, 7))::BIGINT) AS BIGINT)"


def id_sum(column: str = "row_id"):
    return F.sum(F.conv(F.substring(F.md5(column), 1, 7), 16, 10).cast("long"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by supplier and year as client updates: rsu_id (supplier's nation mod 5), vehicle_id, round, num_examples, ..."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5).alias("rsu_id")), "l_suppkey")
    return li.groupBy("rsu_id", F.col("l_suppkey").alias("vehicle_id"), F.year("l_shipdate").alias("round")).agg(
        F.count("*").alias("num_examples"), F.sum(F.col("l_quantity").cast("long")).alias("upload_bytes"), F.sum(F.round(F.col("l_extendedprice")).cast("long")).alias("download_bytes"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("train_seconds"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("epsilon_u"),
        F.max("l_quantity").alias("best"), F.count_distinct("l_linenumber").alias("trees"),
    )


UPDATES = """updates AS (
  SELECT s_nationkey % 5 AS rsu_id, l_suppkey AS vehicle_id, CAST(year(l_shipdate) AS INTEGER) AS round, count(*) AS num_examples,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS upload_bytes, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS download_bytes,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS train_seconds, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS epsilon_u,
         max(l_quantity) AS best, count(DISTINCT l_linenumber) AS trees
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def scores(spark: SparkSession, sf_dir: str, models: int = 3) -> DataFrame:
    """row_id, model_id, score, label: the score under different weights as several models' scores."""
    each = F.explode(F.sequence(F.lit(1), F.lit(models)))
    s = lambda m: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("q") / (F.lit(80) + F.lit(20) * m) + F.col("d") * m))
    return flows(spark, sf_dir).select("row_id", "label", "q", "d", each.alias("model_id")).select("row_id", "model_id", s(F.col("model_id")).alias("score"), "label")


SCORES = """scores AS (
  SELECT row_id, CAST(m AS INTEGER) AS model_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, q / (80 + 20 * m) + d * m)) AS score, label FROM flows, range(1, 4) r(m))"""
