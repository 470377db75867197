"""Exact quantiles by radix selection: counts by digits of the numbers' bits, never a list of values.

A double's 64 bits, with those of negative numbers turned, are an integer that orders as the doubles do. A pass counts the
values of every group and column by the next 16 bits, among those whose upper bits are still wanted, and finds in
which of the at most 65536 counts each wanted rank falls. After four passes the bits of the wanted values are known. Only
counts are shuffled, combined before, and no buffer grows with the number of values or of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnsift.operators.primitives import BUCKET_ROWS, join_keys
from tarnsift.sources.shared import stored

#: Flips all bits but the sign.
_TURN = (1 << 63) - 1


def ordered_bits(c: Column) -> Column:
    """A long that orders as the double does; both zeros have one."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_TURN))).otherwise(bits)


def from_bits(c: Column) -> Column:
    bits = F.when(c < 0, c.bitwiseXOR(F.lit(_TURN))).otherwise(c)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _picked(counts: DataFrame, wanted: DataFrame, within: list[str], value: str) -> DataFrame:
    """wanted, each row with the value of the count that its rank falls in and the rank inside it."""
    upto = counts.withColumn("_upto", F.sum("_k").over(W.partitionBy(*within).orderBy(value)))
    met = join_keys(wanted, upto, within)
    return met.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_k"))).withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_k")).drop("_upto", "_k")


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], by: tuple[str, ...] = (), nearest: bool = False, small: int = BUCKET_ROWS, weight: str | None = None) -> DataFrame:
    """by, column, values: for each column the quantiles `qs` of its finite values, in their order: interpolated, or, if nearest, the least
    value that so large a share of all doesn't exceed. Groups and columns without finite values have no row. All columns,
    groups and quantiles take the same four passes; `small` rows or fewer are counted by value at once. A value counts `weight`
    (a whole number) times."""
    keys = [f"_by{i}" for i in range(len(by))]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)]))
    long = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"), each.alias("_e")).select(*keys, "_w", "_e._c", "_e._v")
    long = stored(long.where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf"))).select(*keys, "_w", "_c", ordered_bits(F.col("_v")).alias("_i")), "bits")
    within = [*keys, "_c"]
    totals = long.groupBy(*within).agg(F.sum("_w").alias("_n")).where("_n > 0")
    q, at = F.col("_q"), F.col("_q") * (F.col("_n") - 1)
    ranks = (F.greatest(F.lit(1.0), F.ceil(q * F.col("_n") - 1e-9)),) * 2 if nearest else (F.floor(at) + 1, F.ceil(at) + 1)
    each = totals.select("*", F.posexplode(F.split(F.lit(",".join(repr(float(x)) for x in qs)), ",").cast("array<double>")).alias("_q_no", "_q"))
    ends = F.explode(F.array(*[F.struct(F.lit(j).alias("end"), r.cast("long").alias("rank")) for j, r in enumerate(ranks)]))
    wanted = stored(each.select(*within, "_q_no", (at - F.floor(at)).alias("_part"), ends.alias("_e")).select(*within, "_q_no", "_part", F.col("_e.end").alias("_end"), F.col("_e.rank").alias("_rank")), "ranks")
    if long.count() <= small:
        found = _picked(long.groupBy(*within, "_i").agg(F.sum("_w").alias("_k")), wanted, within, "_i")
    else:
        found = wanted.withColumn("_i", F.lit(0).cast("long"))
        for shift in (48, 32, 16, 0):
            # the first digit keeps the sign, so that it orders as the number does
            digit = F.shiftright("_i", 48) if shift == 48 else F.shiftright("_i", shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
            upper = F.lit(0).cast("long") if shift == 48 else F.shiftright("_i", shift + 16)
            rows = long.select(*within, "_w", upper.alias("_p"), digit.alias("_d"))
            if shift < 48:
                rows = join_keys(rows, found.select(*within, F.col("_i").alias("_p")).distinct(), [*within, "_p"], "left_semi")
            counts = rows.groupBy(*within, "_p", "_d").agg(F.sum("_w").alias("_k"))
            met = _picked(counts, found.withColumnRenamed("_i", "_p"), [*within, "_p"], "_d")
            found = stored(met.withColumn("_i", F.shiftleft("_p", 16) + F.col("_d")).drop("_p", "_d"), "digits")
    pair = found.groupBy(*within, "_q_no").agg(from_bits(F.min("_i")).alias("lo"), from_bits(F.max("_i")).alias("hi"), F.max("_part").alias("part"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (1 - F.col("part")) + F.col("hi") * F.col("part"))
    listed = pair.groupBy(*within).agg(F.sort_array(F.collect_list(F.struct("_q_no", value.alias("v")))).alias("l"))  # a row for each of qs
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_c") + 1)
    return listed.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], names.alias("column"), F.transform("l", lambda x: x["v"]).alias("values"))


def with_quantiles(aggregated: DataFrame, df: DataFrame, col: str, named: dict[str, float], by: tuple[str, ...] = (), nearest: bool = False, weight: str | None = None) -> DataFrame:
    """aggregated, a table of one row for each group, with the group's quantiles under their names; null where it has no finite values."""
    found = exact_quantiles(df, [col], list(named.values()), by, nearest, weight=weight).select(*by, F.col("values").alias("_q"))
    met = join_keys(aggregated, found, list(by), "left") if by else aggregated.join(F.broadcast(found), how="left")
    return met.withColumns({n: F.get("_q", F.lit(i)) for i, n in enumerate(named)}).drop("_q")
