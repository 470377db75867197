"""Building blocks: exact global ranks and prefix sums without a single-task window, reproducible hashes, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsift.sources.shared import stored

#: Rows of a bucket, about: what one task sorts at once. Beyond MOST buckets they grow, and Spark's sort spills.
BUCKET_ROWS, MOST = 1 << 17, 20_000
#: Into so many buckets a map task deals its rows straight to files; for more, it holds those of its whole split in memory first.
#: So buckets take up to GROWN times the rows before there are more than DIRECT of them.
DIRECT, GROWN = 200, 16
#: Rows of a table of bounds, starts or the like that is broadcast to the rows; with more of them the rows are joined by a shuffle.
FEW = 10_000
#: Least and most buckets that hashes are cut into by arithmetic, to find places in their order.
FINE, FINEST = 4096, 1 << 20


def hash_unit(*key: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) from a key's text and a seed, the same on any engine that has MD5. A null part counts as a text of its own."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("\u0000")) for k in key]
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


#: For keys spread evenly over [0, 1), as hashes are: buckets by arithmetic, no look at the data.
UNIT = "unit"


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by equal keys in which null equals null; the keys stand once, from the left side."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(renamed, met, how).drop(*[f"_same_{k}" for k in keys])


def ascending(order: list) -> list[Column]:
    """The keys of an order, names as ascending keys whose nulls stand last."""
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def placed(df: DataFrame, order: list, rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df, stored, with _bucket and _place: a sample sort. Splitters are drawn from a sample of whole order keys, as many as the
    rows need, so a first key that most rows share, or texts that begin alike, are cut by what follows in the order; only rows
    that are equal in all keys must share a bucket. _place rises with the order, by one from row to row inside a bucket."""
    buckets = max(1, -(-rows // bucket_rows))
    buckets = min(MOST, max(min(buckets, DIRECT), -(-buckets // GROWN)))
    keys = ascending(order)
    spread = df.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    return stored(spread, "order").withColumn("_bucket", F.shiftright("_place", 33))  # the id's upper bits are the partition


def bucketed_rank(df: DataFrame, order: list, by: tuple[str, ...] = (), out: str = "rank", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """1-based exact rank by `order` within `by`; null groups are groups, null keys stand last. Rows are sample-sorted by group
    and order together, so a group of any size is spread over as many tasks as it needs; where each group begins in each
    bucket and how many of its rows stand in earlier ones is a table of buckets + groups rows, broadcast unless groups are many.
    The rows are shuffled with all their columns: select those that are needed. A table of no more rows than one bucket has is
    ranked as one."""
    rows = df.count()
    if rows <= bucket_rows:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*ascending(order))).cast("long"))
    there = placed(df, [*by, *order], rows, bucket_rows)
    starts = stored(there.groupBy(*by, "_bucket").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")), "starts")
    ahead = starts.withColumn("_ahead", F.sum("_n").over(W.partitionBy(*by).orderBy("_bucket")) - F.col("_n")).drop("_n")
    ahead = F.broadcast(ahead) if starts.count() <= FEW else ahead
    return join_keys(there, ahead, [*by, "_bucket"]).withColumn(out, F.col("_place") - F.col("_first") + F.col("_ahead") + 1).drop("_place", "_bucket", "_first", "_ahead")


def bounds_at(df: DataFrame, order: list[str], wanted: DataFrame, by: tuple[str, ...] = (), cuts=None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """by, at, bound: for each row (by, at, rank) of wanted the place in `order` of the row of that rank within `by`. A split by
    position is one comparison with a bound, and no whole row of df is shuffled for it: only its keys are ranked. cuts=UNIT says
    that the first key is spread evenly over [0, 1), as a hash is: rows are counted in buckets by arithmetic, and only the keys of the
    buckets that hold a wanted rank are sorted."""
    keys = df.select(*by, *order)
    if cuts != UNIT:
        few = F.broadcast(wanted) if wanted.count() <= FEW else wanted
        return join_keys(bucketed_rank(keys, order, by, "rank", bucket_rows), few, [*by, "rank"]).select(*by, "at", standing(order).alias("bound"))
    buckets = min(FINEST, max(FINE, df.count() // (bucket_rows // 4)))
    dealt = keys.withColumn("_bucket", F.least(F.floor(F.col(order[0]) * buckets), F.when(F.col(order[0]).isNotNull(), buckets - 1)).cast("int"))
    counts = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy(*by).orderBy(F.col("_bucket").asc_nulls_last())))
    there = join_keys(upto, wanted, list(by)) if by else upto.crossJoin(wanted)
    there = there.where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
    there = stored(there.select(*by, "_bucket", "at", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("_r")), "wanted")
    holding = there.select(*by, "_bucket").distinct()
    here = join_keys(dealt, F.broadcast(holding) if there.count() <= FEW else holding, [*by, "_bucket"], "left_semi")
    ranked = here.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*ascending(order)))).select(*by, "_bucket", "_r", standing(order).alias("bound"))
    return join_keys(ranked, there, [*by, "_bucket", "_r"]).select(*by, "at", "bound")


def standing(order: list[str]) -> Column:
    """A row's keys in an order, as one value."""
    return F.struct(*[F.col(o).alias(f"k{i}") for i, o in enumerate(order)])


def upto(order: list[str], bound: Column) -> Column:
    """Whether a row stands at or before a bound, nulls last. Spelled out key by key, so that codegen runs it and later keys are
    looked at only where the earlier ones are equal."""
    out = F.lit(True)
    for i, o in reversed(list(enumerate(order))):
        own, end = F.col(o), bound[f"k{i}"]
        before = F.coalesce(own < end, own.isNotNull() & end.isNull())
        out = before | (own.eqNullSafe(end) & out)
    return out


def met_with(df: DataFrame, small: DataFrame, by: tuple[str, ...], groups: int) -> DataFrame:
    """df with the columns of small, a table of one row for each of `groups` groups."""
    return join_keys(df, F.broadcast(small) if groups <= FEW else small, list(by), "left") if by else df.crossJoin(F.broadcast(small))


def upto_bounds(df: DataFrame, order: list[str], bounds: DataFrame, places: list[int], by: tuple[str, ...] = (), groups: int = 1) -> DataFrame:
    """df with _b<at> for each of places: whether the row stands at or before the bound; false where there is none."""
    wide = bounds.groupBy(*by).agg(*[F.first(F.when(F.col("at") == i, F.col("bound")), ignorenulls=True).alias(f"_b{i}") for i in places])
    return met_with(df, wide, by, groups).withColumns({f"_b{i}": F.col(f"_b{i}").isNotNull() & upto(order, F.col(f"_b{i}")) for i in places})


def prefix_sums(df: DataFrame, key: str, sums: list[str], by: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df, whose rows have distinct keys within `by`, with cum_<c>: the sum of c over all rows up to the key. A null key stands
    last. Rows are sample-sorted by group and key; a table of no more rows than one bucket has is summed as one."""
    kept = stored(df, "sums")
    rows = kept.count()
    if rows <= bucket_rows:
        return kept.withColumns({f"cum_{c}": F.sum(c).over(W.partitionBy(*by).orderBy(F.col(key).asc_nulls_last())) for c in sums})
    there = placed(kept, [*by, key], rows, bucket_rows)
    totals = there.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    over = W.partitionBy(*by).orderBy("_bucket")
    ahead = totals.select(*by, "_bucket", *[(F.sum(f"_t_{c}").over(over) - F.col(f"_t_{c}")).alias(f"_a_{c}") for c in sums])
    inside = there.withColumns({f"_s_{c}": F.sum(c).over(W.partitionBy(*by, "_bucket").orderBy("_place")) for c in sums})
    summed = join_keys(inside, ahead, [*by, "_bucket"])
    return summed.withColumns({f"cum_{c}": F.col(f"_s_{c}") + F.col(f"_a_{c}") for c in sums}).drop("_bucket", "_place", *[f"_{p}_{c}" for p in "sa" for c in sums])


def membership_flag(df: DataFrame, reference: DataFrame, key: str, out: str = "seen") -> DataFrame:
    """Whether the key occurs in reference; Catalyst picks the join by size."""
    marked = reference.select(key).where(F.col(key).isNotNull()).distinct().withColumn(out, F.lit(True))
    return df.join(marked, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def score_counts(df: DataFrame, label: str, score: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """by, score, pos, neg, cum_pos, cum_neg: the exact curve over distinct scores, ascending. Rows without a score (null, NaN) are
    one row of score null after all others. A row counts `weight` times. by and score must not be named as one of the counts."""
    own = F.col(score)
    known = F.when(~F.isnan(own), own) if isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType)) else own
    rows = df.select(*by, known.alias(score), F.col(label).alias("_label"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_weight"))
    counts = rows.groupBy(*by, score).agg(*[F.coalesce(F.sum(F.when(F.col("_label") == y, F.col("_weight"))), F.lit(0)).alias(name) for y, name in ((1, "pos"), (0, "neg"))])
    return prefix_sums(counts, score, ["pos", "neg"], by)
