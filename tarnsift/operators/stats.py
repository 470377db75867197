"""Paired statistics over seeds: groups are a handful of runs, permutations and resamples are rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnsift.operators.metrics import is_finite
from tarnsift.operators.primitives import hash_unit, join_keys, prefix_sums
from tarnsift.operators.quantiles import exact_quantiles
from tarnsift.sources.shared import stored


def method_summary(results: DataFrame) -> DataFrame:
    """dataset, method, metric, seeds, mean, sd (sample)."""
    return results.groupBy("dataset", "method", "metric").agg(F.count("*").alias("seeds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def pair_methods(results: DataFrame) -> DataFrame:
    """dataset, seed, metric, method_a, method_b, diff: same-seed differences of every two methods."""
    a, b = results.alias("a"), results.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("dataset", "seed", "metric")]
    return a.join(b, [*same, F.col("a.method") < F.col("b.method")]).select("a.dataset", "a.seed", "a.metric", F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b"), (F.col("a.value") - F.col("b.value")).alias("diff"))


def bootstrap_mean_ci(results: DataFrame, by: list[str], value: str, resamples: int, seed: int = 42) -> DataFrame:
    """by, low, high: 2.5 and 97.5 per cent of the means of resamples drawn by hash."""
    listed = results.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"))
    draws = listed.crossJoin(results.sparkSession.range(resamples).withColumnRenamed("id", "b"))
    index = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.floor(hash_unit(*by, F.col("b").cast("string"), i.cast("string"), seed=seed) * F.size("v")).cast("int"))
    mean = F.aggregate(index, F.lit(0.0), lambda s, i: s + F.get("v", i)) / F.size("v")
    found = exact_quantiles(draws.select(*by, mean.alias("m")), ["m"], [0.025, 0.975], tuple(by))
    return found.select(*by, F.get("values", F.lit(0)).alias("low"), F.get("values", F.lit(1)).alias("high"))


#: Rows that an exact distribution may have for one group.
MOST_SUMS = 50_000_000


def _decimals(results: DataFrame, by: list[str], value: str, digits: int) -> DataFrame:
    """by, _v (the finite values with `digits` decimals, so that equal sums are equal), _i (1-based), _n."""
    unit = f"decimal(38,{digits})"
    rows = results.where(is_finite(F.col(value))).select(*by, F.col(value).cast(unit).alias("_v"))
    return rows.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("_v"))).withColumn("_n", F.count("*").over(W.partitionBy(*by)))


def bootstrap_exact(results: DataFrame, by: list[str], value: str, digits: int = 12) -> DataFrame:
    """by, low, high over all resamples of a small group: the distribution of their sums, value by value. A state is how many draws
    are left and the sum so far, with the number of orders that lead there; states that are equal become one row, so on values of
    few decimals the rows grow with the range of the sums and not with the C(2n - 1, n) multisets. Values are taken to `digits`
    decimals. Raises where a group's sums may be more than MOST_SUMS."""
    unit = f"decimal(38,{digits})"
    lists = _decimals(results, by, value, digits).groupBy(*by).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list("_v")).alias("v"))
    sizes = lists.groupBy("n").agg(F.max(F.array_max("v") - F.array_min("v")).cast("double").alias("spread")).collect()
    for r in sizes:
        if min(math.comb(2 * r["n"] - 1, r["n"]), r["n"] ** 2 * (r["spread"] * 10**digits + 1)) > MOST_SUMS:
            raise ValueError(f"{r['n']} values have too many sums at {digits} decimals")
    most = max((r["n"] for r in sizes), default=0)
    state = lists.select(*by, "n", "v", F.col("n").alias("left"), F.lit(0).cast(unit).alias("total"), F.lit(1.0).alias("orders"))
    for i in range(most):
        last = F.col("n") == i + 1
        counts = F.when(F.col("n") < i + 1, F.array(F.lit(0).cast("long"))).when(last, F.array(F.col("left"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("left")))
        added = (F.col("total") + F.col("k") * F.coalesce(F.get("v", F.lit(i)), F.lit(0).cast(unit))).cast(unit)
        # k of the draws left take this value in C(left, k) ways
        ways = F.exp(_log_factorial("left") - _log_factorial("k") - _log_factorial(F.col("left") - F.col("k")))
        state = state.withColumn("k", F.explode(counts)).select(*by, "n", "v", (F.col("left") - F.col("k")).alias("left"), added.alias("total"), (F.col("orders") * F.when(F.col("left") <= 20, F.round(ways)).otherwise(ways)).alias("orders"))
        state = state.groupBy(*by, "n", "v", "left", "total").agg(F.sum("orders").alias("orders"))
    means = state.groupBy(*by, F.round(F.col("total").cast("double") / F.col("n"), 12).alias("m")).agg(F.sum("orders").alias("w"))
    upto = means.withColumn("cum", F.sum("w").over(W.partitionBy(*by).orderBy("m"))).withColumn("all", F.sum("w").over(W.partitionBy(*by)))
    return upto.groupBy(*by).agg(F.min(F.when(F.col("cum") >= 0.025 * F.col("all"), F.col("m"))).alias("low"), F.min(F.when(F.col("cum") >= 0.975 * F.col("all"), F.col("m"))).alias("high"))


def _log_factorial(c) -> F.Column:
    """ln(n!) of a whole number, by adding up."""
    c = F.col(c) if isinstance(c, str) else c
    return F.aggregate(F.sequence(F.lit(1), F.greatest(c, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i))


#: Differences whose signs one row's list of sums runs through.
FLIPPED_AT_ONCE = 8


def sign_flip_test(pairs: DataFrame, by: list[str], diff: str = "diff", digits: int = 12) -> DataFrame:
    """by, n, mean_diff, p_value: the exact two-sided test over all 2^n sign patterns, for any n. The differences are dealt to two
    halves; the distribution of each half's signed sums is made by convolution, a few differences at a time, equal sums as one
    row with its probability. How often two sums, one of each half, reach the observed one is a merge of the two in one
    order, so 2^(n / 2) rows, or as many as there are different sums, stand for 2^n patterns. Differences are taken to `digits`
    decimals; null and non-finite ones take no part."""
    unit = f"decimal(38,{digits})"
    rows = _decimals(pairs, by, diff, digits).withColumn("_half", F.col("_i") % 2).withColumn("_part", F.floor((F.col("_i") - 1) / 2 / FLIPPED_AT_ONCE).cast("int"))
    groups = rows.groupBy(*by).agg(F.max("_n").alias("n"), F.sum("_v").cast(unit).alias("_sum"))
    lists = rows.groupBy(*by, "_half", "_part").agg(F.collect_list("_v").alias("_l"))
    both = F.aggregate("_l", F.array(F.lit(0).cast(unit)), lambda sums, x: F.concat(F.transform(sums, lambda s: (s + x).cast(unit)), F.transform(sums, lambda s: (s - x).cast(unit))))
    spread = lists.select(*by, "_half", "_part", F.pow(F.lit(0.5), F.size("_l")).alias("_w"), F.explode(both).alias("_s")).groupBy(*by, "_half", "_part", "_s").agg(F.sum("_w").alias("_w"))
    spread = stored(spread, "flips")
    halves = spread.where("_part = 0").drop("_part")
    for part in range(1, 1 + (spread.agg(F.max("_part")).first()[0] or 0)):
        more = spread.where(F.col("_part") == part).select(*by, "_half", F.col("_s").alias("_t"), F.col("_w").alias("_u"))
        sums = (F.col("_s") + F.coalesce("_t", F.lit(0).cast(unit))).cast(unit)
        halves = join_keys(halves, more, [*by, "_half"], "left").groupBy(*by, "_half", sums.alias("_s")).agg(F.sum(F.col("_w") * F.coalesce("_u", F.lit(1.0))).alias("_w"))
    reach = (F.abs("_sum") - F.lit(1e-12)).cast(unit)
    one = join_keys(halves.where("_half = 1"), groups, by) if by else halves.where("_half = 1").crossJoin(groups)
    asked = one.select(*by, (reach - F.col("_s")).cast(unit).alias("_s"), F.lit(0.0).alias("_w"), F.col("_w").alias("_a"))
    alone = groups.where("n = 1").select(*by, F.lit(0).cast(unit).alias("_s"), F.lit(1.0).alias("_w"), F.lit(0.0).alias("_a"))
    other = halves.where("_half = 0").select(*by, "_s", "_w", F.lit(0.0).alias("_a")).unionByName(alone)
    merged = prefix_sums(asked.unionByName(other).groupBy(*by, "_s").agg(F.sum("_w").alias("_w"), F.sum("_a").alias("_a")), "_s", ["_w"], tuple(by))
    # of the other half's probability, 1, what does not lie below the sum asked for; both signs of the whole are alike
    tail = merged.groupBy(*by).agg(F.sum(F.col("_a") * (1.0 - F.col("cum__w") + F.col("_w"))).alias("_p"))
    met = join_keys(groups, tail, by) if by else groups.crossJoin(tail)
    p = F.when(reach <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("_p")))
    return met.select(*by, F.col("n").cast("int").alias("n"), p.alias("p_value"), (F.col("_sum").cast("double") / F.col("n")).alias("mean_diff"))


def holm(pvalues: DataFrame, by: list[str], p: str, key: list[str]) -> DataFrame:
    """pvalues with p_holm: step-down adjustment inside `by`, monotone, at most 1."""
    inside = W.partitionBy(*by).orderBy(p, *key)
    stepped = pvalues.withColumn("_a", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(W.partitionBy(*by)) - F.row_number().over(inside) + 1)))
    return stepped.withColumn("p_holm", F.max("_a").over(inside.rowsBetween(W.unboundedPreceding, 0))).drop("_a")
