"""Samples and leak-free splits. Every choice follows a hash of the row's key, so it can be repeated anywhere; which rows a
seed picks is this library's own, only counts, fractions and disjointness follow the protocol."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsift.operators.primitives import UNIT, bounds_at, bucketed_rank, hash_unit, join_keys, met_with, prefix_sums, upto, upto_bounds
from tarnsift.sources.shared import stored


def _ranks(df: DataFrame, fields: str, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, fields)


def _ends(fracs: tuple[float, ...]) -> list[Decimal]:
    """Where train and val end, as decimals: 45 * 0.7 is 31.5 and rounds to 32, as in SQL; the doubles' product lies below."""
    return [Decimal(str(fracs[0])), Decimal(str(fracs[0])) + Decimal(str(fracs[1]))]


def sample_toward(df: DataFrame, key: list[str], max_rows: int, seed: int = 42, exact: bool = False) -> DataFrame:
    """All rows if there are no more than max_rows, else the fraction max_rows / n of them by hash; exact: exactly max_rows, if
    keys are unique (rows of one key stay together)."""
    n = df.count()
    if n <= max_rows:
        return df
    if exact:
        hashed = df.withColumn("_h", hash_unit(*key, seed=seed))
        bounds = bounds_at(hashed, ["_h", *key], _ranks(df, "at int, rank long", [(0, max_rows)]), cuts=UNIT)
        return upto_bounds(hashed, ["_h", *key], bounds, [0]).where("_b0").drop("_h", "_b0")
    return df.where(hash_unit(*key, seed=seed) < max_rows / n)


def stratified_split(df: DataFrame, label: str, key: list[str], fracs: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """df with split train/val/test: exact rounded counts inside every class, if keys are unique (rows of one key stay together).
    Null is a class; no rows give no rows. Raises if a class has fewer than 4 rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    least, classes = counts.agg(F.min("_n"), F.count("*")).first()
    if classes and least < 4:
        raise ValueError("a class has fewer than 4 rows")
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.round(F.col("_n") * f).cast("long").alias("rank")) for i, f in enumerate(_ends(fracs))]))
    hashed, order = df.withColumn("_h", hash_unit(*key, seed=seed)), ["_h", *key]
    bounds = bounds_at(hashed, order, counts.select(label, ends.alias("e")).select(label, "e.at", "e.rank"), (label,), UNIT)
    met = upto_bounds(hashed, order, bounds, [0, 1], (label,), classes)
    return met.withColumn("split", F.when(F.col("_b0"), "train").when(F.col("_b1"), "val").otherwise("test")).drop("_h", "_b0", "_b1")


def hash_split(df: DataFrame, key: list[str], fracs: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """The fast form: fractions hold approximately, no shuffle."""
    h = hash_unit(*key, seed=seed)
    return df.withColumn("split", F.when(h < fracs[0], "train").when(h < fracs[0] + fracs[1], "val").otherwise("test"))


def group_split(df: DataFrame, group: str, fracs: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """No group in two parts; the fractions are of groups, not of rows. Two bounds in the order of the groups' hashes decide: rows are
    compared with them, not joined with their groups."""
    hashed, order = df.withColumn("_h", hash_unit(group, seed=seed)), ["_h", group]
    groups = hashed.select(*order).distinct()
    n = groups.count()
    ends = [(i, int((n * f).to_integral_value(ROUND_HALF_UP))) for i, f in enumerate(_ends(fracs))]
    met = upto_bounds(hashed, order, bounds_at(groups, order, _ranks(df, "at int, rank long", ends), cuts=UNIT), [0, 1])
    return met.withColumn("split", F.when(F.col("_b0"), "train").when(F.col("_b1"), "val").otherwise("test")).drop("_h", "_b0", "_b1")


def overlap_counts(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """train_val, train_test, val_test: groups that occur in both parts."""
    has = df.groupBy(group).agg(*[F.bool_or(F.col(split) == s).alias(s) for s in ("train", "val", "test")])
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    return has.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs])


def assert_disjoint(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    counts = overlap_counts(df, group, split)
    found = counts.first().asDict()
    if any(found.values()):
        raise ValueError(f"groups in several parts: {found}")
    return counts


def class_complete_group_split(df: DataFrame, group: str, label: str, fractions: list[float], seeds: list[int]) -> DataFrame:
    """fraction, seed, test_rows, size_error, class_error, complete, score for every candidate, best first: sides by a hash of
    the group; complete if every class stands on both sides. Scored on counts of (group, class) in one grouped pass."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"), F.count_distinct(F.struct(label)).alias("classes"))
    spec = df.sparkSession.createDataFrame([(float(f), int(s)) for f in fractions for s in seeds], "fraction double, seed int")
    side = _group_unit(group, F.col("seed")) < F.col("fraction")
    by_class = counts.crossJoin(F.broadcast(spec)).groupBy("fraction", "seed", label).agg(F.sum(F.when(side, F.col("n")).otherwise(0)).alias("test"), F.sum("n").alias("n"))
    scored = by_class.groupBy("fraction", "seed").agg(
        F.sum("test").alias("test_rows"), F.avg(F.abs(F.col("test") / F.col("n") - F.col("fraction"))).alias("class_error"),
        F.count_if((F.col("test") > 0) & (F.col("test") < F.col("n"))).alias("both"),
    ).crossJoin(total)
    size_error = F.abs(F.col("test_rows") / F.col("total") - F.col("fraction"))
    return scored.select("fraction", "seed", "test_rows", size_error.alias("size_error"), "class_error", (F.col("both") == F.col("classes")).alias("complete"), (size_error + F.col("class_error")).alias("score")).orderBy(F.col("complete").desc(), "score", "fraction", "seed")


def _group_unit(group: str, seed: Column) -> Column:
    text = F.md5(F.concat_ws("|", F.coalesce(F.col(group).cast("string"), F.lit("\u0000")), seed.cast("string")))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def best_group_split(df: DataFrame, group: str, label: str, fractions: list[float], seeds: list[int]) -> DataFrame:
    """df with split train/test by the best complete candidate of class_complete_group_split. Raises if none is complete."""
    best = class_complete_group_split(df, group, label, fractions, seeds).first()
    if best is None or not best["complete"]:
        raise ValueError("no candidate has every class on both sides")
    return df.withColumn("split", F.when(_group_unit(group, F.lit(best["seed"])) < best["fraction"], "test").otherwise("train"))


#: What a search for a three-way split may end with.
THREE_WAY = ("evaluable", "no_complete_split_found", "too_few_groups")


def three_way_search(df: DataFrame, group: str, label: str, seeds: list[int], fracs: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """One row: status, seed (the first, in the given order, that puts every class into train, val and test; null if none does),
    least_groups (of any class). Groups are dealt by a hash, all seeds are tried on (group, class) in one grouped pass; with
    fewer than 3 groups in a class none can be complete."""
    pairs = df.select(group, label).distinct()
    per = pairs.groupBy(label).agg(F.count("*").alias("groups")).agg(F.min("groups").alias("least_groups"), F.count("*").alias("classes"))
    spec = df.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(seeds)], "turn int, seed int")
    h = _group_unit(group, F.col("seed"))
    part = F.when(h < fracs[0], 0).when(h < fracs[0] + fracs[1], 1).otherwise(2)
    held = pairs.crossJoin(F.broadcast(spec)).groupBy("turn", "seed", label).agg(F.count_distinct(part).alias("parts"))
    tried = held.groupBy("turn", "seed").agg(F.count_if(F.col("parts") == 3).alias("complete"))
    found = tried.crossJoin(per).where(F.col("complete") == F.col("classes")).agg(F.min_by("seed", "turn").alias("seed"))
    status = F.when(F.coalesce("least_groups", F.lit(0)) < 3, THREE_WAY[2]).when(F.col("seed").isNull(), THREE_WAY[1]).otherwise(THREE_WAY[0])
    return per.crossJoin(found).select(status.alias("status"), F.when(F.col("least_groups") >= 3, F.col("seed")).alias("seed"), "least_groups")


def three_way_split(df: DataFrame, group: str, label: str, seeds: list[int], fracs: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """df with split train/val/test, no group in two parts and every class in all three, by the first seed that gives it. Raises
    with the search's status if there is none."""
    found = three_way_search(df, group, label, seeds, fracs).first()
    if found["status"] != THREE_WAY[0]:
        raise ValueError(found["status"])
    h = _group_unit(group, F.lit(found["seed"]))
    return df.withColumn("split", F.when(h < fracs[0], "train").when(h < fracs[0] + fracs[1], "val").otherwise("test"))


def split_status(df: DataFrame, group: str, label: str, least_groups: int = 3) -> DataFrame:
    """label, groups, status: whether every class has enough groups for a class-complete split."""
    per = df.groupBy(label).agg(F.count_distinct(group).alias("groups"))
    return per.withColumn("status", F.when(F.col("groups") >= least_groups, "possible").otherwise("impossible"))


def qualified_families(df: DataFrame, family: str, min_rows: int, benign: str = "BENIGN", most: int | None = None) -> DataFrame:
    found = df.where(F.col(family) != benign).groupBy(family).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_rows).orderBy(F.col("n_rows").desc(), family)
    return found.limit(most) if most else found


def leave_one_class_out(df: DataFrame, family: str, group: str, families: list[str], fracs=(0.7, 0.15, 0.15), seed: int = 42, benign: str = "BENIGN") -> DataFrame:
    """df, once for every held-out family (column held_out), with role train/cal/test; test rows whose group is in training
    or calibration are marked removed. All families in one job."""
    part = group_split(df, group, fracs, seed).withColumnRenamed("split", "_part")
    spec = df.sparkSession.createDataFrame([(f,) for f in families], "held_out string")
    # a group of the first two parts is in training or calibration beside a held-out family if it holds another one: decided once a row
    learnt = F.col("_part") != "test"
    mixed = part.where(learnt).groupBy(group).agg(F.min(F.struct(family)).alias("_least"), F.max(F.struct(family)).alias("_most")).where("_least <> _most").select(group, F.lit(True).alias("_mixed"))
    each = join_keys(part, mixed, [group], "left").crossJoin(F.broadcast(spec))
    own = F.coalesce(F.col(family) == F.col("held_out"), F.lit(False))
    role = F.when(own, "test").when(F.col("_part") == "train", "train").when(F.col("_part") == "val", "cal").when(F.col(family) == benign, "test")
    each = each.withColumn("role", role).where("role is not null")
    return each.withColumn("removed", own & learnt & F.coalesce("_mixed", F.lit(False))).drop("_part", "_mixed")


def oversample_minority(df: DataFrame, label: str, key: list[str], seed: int = 42, max_rows: int | None = None) -> DataFrame:
    """Both classes (0 and 1) equal: each minority row stands floor(M/m) times and the M mod m with the least hashes once more, if
    keys are unique. Unchanged if one class is missing, both are equal, or the result would exceed max_rows; rows with another
    label, or none, are kept as they are. Adds copy (0 the row itself)."""
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n")).collect()}
    plain = df.withColumn("copy", F.lit(0))
    if len(counts) < 2 or counts[0] == counts[1] or (max_rows and 2 * max(counts.values()) > max_rows):
        return plain
    minor = min(counts, key=counts.get)
    most, least = max(counts.values()), min(counts.values())
    small, order = df.where(F.col(label) == minor).withColumn("_h", hash_unit(*key, seed=seed)), ["_h", *key]
    bounds = bounds_at(small, order, _ranks(df, "at int, rank long", [(0, most % least)]), cuts=UNIT)
    small = upto_bounds(small, order, bounds, [0])
    times = F.lit(most // least) + F.col("_b0").cast("int")
    more = small.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1))).drop("_h", "_b0")
    return plain.where(~F.col(label).eqNullSafe(minor)).unionByName(more)


def cap_per_class(df: DataFrame, label: str, key: list[str], max_rows: int, min_rows: int = 0, seed: int = 42) -> DataFrame:
    """Classes under min_rows go; of larger ones the max_rows rows with the least hashes stay (rows of one key together). Null is a class."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    hashed, order = df.withColumn("_h", hash_unit(*key, seed=seed)), ["_h", *key]
    bounds = bounds_at(hashed, order, counts.select(label, F.lit(0).alias("at"), F.least("_n", F.lit(max_rows)).alias("rank")), (label,), UNIT)
    return upto_bounds(hashed, order, bounds, [0], (label,), counts.count()).where("_b0").drop("_h", "_b0")


def anchor_sample(df: DataFrame, key: list[str], m: int, seed: int = 42) -> DataFrame:
    """Exactly m rows without replacement (all, if fewer): the least hashes, a top-k without a full sort."""
    return df.withColumn("_h", hash_unit(*key, seed=seed)).orderBy("_h", *key).limit(m).drop("_h")


def shard_balanced(df: DataFrame, label: str, key: list[str], n_rsu: int, n_veh: int, seed: int = 42) -> DataFrame:
    """df with rsu and vehicle: every class dealt evenly over all n_rsu * n_veh clients, if keys are unique (rows of one key stay
    together). Null is a class. Raises with more clients than rows."""
    clients = n_rsu * n_veh
    if df.limit(clients).count() < clients:
        raise ValueError("more shards than rows")
    hashed, order = df.withColumn("_h", hash_unit(*key, seed=seed)), ["_h", *key]
    counts = stored(df.groupBy(label).agg(F.count("*").alias("_n")), "classes")
    # the last rank of client i is the greatest k with floor((k - 1) * clients / n) <= i
    ends = F.transform(F.sequence(F.lit(0), F.lit(clients - 2)), lambda i: F.struct(i.alias("at"), F.ceil((i + 1) * F.col("_n") / clients).alias("rank"))) if clients > 1 else F.array().cast("array<struct<at:int,rank:bigint>>")
    bounds = bounds_at(hashed, order, counts.select(label, F.explode(ends).alias("e")).select(label, "e.at", "e.rank"), (label,), UNIT)
    listed = bounds.groupBy(label).agg(F.collect_list("bound").alias("_ends")).withColumn("_hashes", F.transform("_ends", lambda b: b["k0"]))
    met = met_with(hashed, listed, (label,), counts.count())
    # a row's client is the number of ends before it: by the hash alone, but for rows that have the hash of an end
    before, exactly = F.filter("_hashes", lambda h: h < F.col("_h")), F.filter("_ends", lambda b: ~upto(order, b))
    client = F.when(F.array_contains("_hashes", F.col("_h")), F.array_size(exactly)).otherwise(F.array_size(before))
    met = met.withColumn("_client", F.coalesce(client, F.lit(0))).drop("_ends", "_hashes")
    return met.withColumn("rsu", F.floor(F.col("_client") / n_veh).cast("int")).withColumn("vehicle", (F.col("_client") % n_veh).cast("int")).drop("_h", "_client")


def allocate(total: int, weights: list[float], low: int | list[int] = 0, high: int | list[int] | None = None) -> list[int]:
    """Whole numbers that add up to total, proportional to the weights by largest remainder, each within its own low and high."""
    n = len(weights)
    lows = [low] * n if isinstance(low, int) else list(low)
    highs = [total] * n if high is None else [high] * n if isinstance(high, int) else list(high)
    if not sum(lows) <= total <= sum(highs):
        raise ValueError("bounds cannot hold the total")
    out = list(lows)
    while (left := total - sum(out)) > 0:
        open_ = [i for i in range(n) if out[i] < highs[i]]
        some = any(weights[i] > 0 for i in open_)
        whole = sum(weights[i] if some else 1 for i in open_)
        share = {i: left * (weights[i] if some else 1) / whole for i in open_}
        step = {i: min(int(share[i]), highs[i] - out[i]) for i in open_}
        for i in open_:
            out[i] += step[i]
        if not any(step.values()):
            for i in sorted(open_, key=lambda i: (int(share[i]) - share[i], i))[:left]:
                out[i] += 1
    return out


def skew_plan(positives: int, negatives: int, n_rsu: int, n_veh: int, alpha: float = 0.3, sigma: float = 0.9, ratio: float = 10.0, seed: int = 42) -> list[tuple[int, int]]:
    """(positives, negatives) of each client. Log-normal sizes, clipped to between their tenth percentile and `ratio` times it, add
    up to all rows; Beta(alpha, alpha) shares of positives, within 0.01 and 0.99, spread the positives in proportion to size and
    share, at least one row of each class for every client. Draws are this library's own."""
    import random
    import statistics

    clients = n_rsu * n_veh
    if min(positives, negatives) < clients:
        raise ValueError("a class has fewer rows than there are clients")
    draw = random.Random(seed)
    raw = [draw.lognormvariate(0, sigma) for _ in range(clients)]
    least = statistics.quantiles(raw, n=10, method="inclusive")[0] if clients > 1 else raw[0]
    sizes = [2 + k for k in allocate(positives + negatives - 2 * clients, [min(max(x, least), least * ratio) for x in raw])]
    share = [min(max(draw.betavariate(alpha, alpha), 0.01), 0.99) for _ in range(clients)]
    pos = allocate(positives, [n * p for n, p in zip(sizes, share)], low=1, high=[n - 1 for n in sizes])
    return [(p, n - p) for p, n in zip(pos, sizes)]


def shard_skewed(df: DataFrame, label: str, feature: str, key: list[str], n_rsu: int, n_veh: int, alpha: float = 0.3, sigma: float = 0.9, ratio: float = 10.0, seed: int = 42) -> DataFrame:
    """df with rsu and vehicle: skewed sizes, label shares and features. Clients take contiguous bands of the feature inside each
    class, one vehicle of every rsu after the other, so that each rsu spans the feature's range. Every row exactly once. Totals
    are decided per client on the driver. Labels are 0 and 1; raises if there are others or none."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not set(counts) <= {0, 1}:
        raise ValueError("labels other than 0 and 1")
    plan = skew_plan(counts.get(1, 0), counts.get(0, 0), n_rsu, n_veh, alpha, sigma, ratio, seed)
    bands, at = [], [0, 0]
    for vehicle in range(n_veh):
        for rsu in range(n_rsu):
            for value, k in zip((1, 0), plan[rsu * n_veh + vehicle]):
                bands.append((value, rsu, vehicle, at[value], at[value] + k))
                at[value] += k
    spec = df.sparkSession.createDataFrame(bands, f"{label} {df.schema[label].dataType.simpleString()}, rsu int, vehicle int, _lo long, _hi long")
    ranked = bucketed_rank(df, [feature, *key], by=(label,), out="_rank")
    placed = ranked.join(F.broadcast(spec), label).where((F.col("_rank") > F.col("_lo")) & (F.col("_rank") <= F.col("_hi")))
    return placed.drop("_rank", "_lo", "_hi")


def skew_feature(train: DataFrame, cols: list[str]) -> str:
    """The numeric column of greatest variance."""
    v = train.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in cols]).first().asDict()
    return max(cols, key=lambda c: (v[c] if v[c] is not None else -1.0, -cols.index(c)))


# ---- chronological protocols -------------------------------------------------------------------------------------------


def boundaries(df: DataFrame, ts: str) -> DataFrame:
    """ts, n, before: rows at each distinct time and rows earlier; a cut at `before` splits no timestamp. Rows without a time come last."""
    counts = df.groupBy(ts).agg(F.count("*").alias("n"))
    return prefix_sums(counts, ts, ["n"]).select(ts, "n", (F.col("cum_n") - F.col("n")).alias("before"))


def _nearest(target: Column, before: Column) -> Column:
    return F.struct(F.abs(before - target), before)


def safe_cut(bounds: DataFrame, target: float, low: int, high: int) -> int | None:
    """The row position in (low, high) nearest to target at which the time changes; the earlier of two as near."""
    near = bounds.where((F.col("before") > low) & (F.col("before") < high))
    return near.agg(F.min_by("before", _nearest(F.lit(float(target)), F.col("before"))).alias("p")).first()[0]


def _moment(df: DataFrame, ts: str):
    """(column -> text, text -> column) by which a time goes to the driver and back without loss."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampType):
        return lambda c: F.unix_micros(c).cast("string"), lambda x: F.timestamp_micros(F.lit(int(x)))
    return lambda c: c.cast("string"), lambda x: F.lit(x).cast(kind)


def _from(ts: str, moment: Column | None) -> Column:
    """Whether a row's time is the moment or later; rows without a time come after all, and are all that a null moment starts."""
    return F.col(ts).isNull() if moment is None else F.coalesce(F.col(ts) >= moment, F.lit(True))


def time_cuts(df: DataFrame, ts: str, fractions: list[float]) -> tuple[list[int], list[Column], int]:
    """(positions, conditions, rows): time-safe cuts near the fractions of all rows, each after the one before, and for each whether
    a row stands after it, as a comparison of its time with a literal: the rows themselves are neither joined nor shuffled.
    One aggregate over the table of distinct times finds all cuts; only one that isn't after its predecessor is sought again."""
    bounds = boundaries(df, ts).persist()
    try:
        total = bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not total:
            return [], [], 0
        text, back = _moment(df, ts)
        inner = bounds.where((F.col("before") > 0) & (F.col("before") < total))
        found = inner.agg(*[F.min_by("before", _nearest(F.lit(float(total * f)), F.col("before"))).alias(f"c{i}") for i, f in enumerate(fractions)]).first()
        cuts: list[int] = []
        for c, f in zip(found, fractions):
            if c is not None and cuts and c <= cuts[-1]:
                c = safe_cut(bounds, total * f, cuts[-1], total)
            if c is None:
                raise ValueError(f"too few distinct times for {len(fractions)} cuts")
            cuts.append(c)
        moments = {r["before"]: r["t"] for r in bounds.where(F.col("before").isin(cuts)).select("before", text(F.col(ts)).alias("t")).collect()}
        return cuts, [_from(ts, None if moments[c] is None else back(moments[c])) for c in cuts], total
    finally:
        bounds.unpersist()


def _part(after: list[Column]) -> Column:
    """1-based part of a row among ascending cuts."""
    return reduce(lambda a, c: a + c.cast("int"), after, F.lit(1)).cast("int")


def time_blocks(df: DataFrame, ts: str, n: int) -> DataFrame:
    """df with block 1..n: near-equal runs of time, none of which splits a timestamp; rows without a time stand last. No rows
    give no rows. Raises with too few distinct times."""
    return df.withColumn("block", _part(time_cuts(df, ts, [i / n for i in range(1, n)])[1]))


def split_block(df: DataFrame, ts: str, frac: float = 0.7) -> DataFrame:
    """df with part 1/2: time-safe cut near frac; asked and realised fractions stand beside."""
    cuts, after, total = time_cuts(df, ts, [frac])
    return df.withColumn("part", _part(after)).withColumn("requested", F.lit(frac)).withColumn("realised", F.lit(cuts[0] / total if cuts else None).cast("double"))


def terminal_split(df: DataFrame, ts: str, fracs=(0.7, 0.15, 0.15)) -> DataFrame:
    """df with split: the past trains, what follows validates, the end tests; cuts are time-safe."""
    _, after, _ = time_cuts(df, ts, [fracs[0], fracs[0] + fracs[1]])
    return df.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), _part(after)))


def chronological_split(df: DataFrame, ts: str, key: list[str], label: str, fracs=(0.7, 0.15, 0.15), widen=(0.0, 0.05, 0.10, 0.15, 0.20)) -> DataFrame:
    """df with split by exact position in time order, if (time, key) is unique; rows without a time stand last. If validation
    would hold one class only it is extended backwards by the first of `widen` that gives it two."""
    total = df.count()
    first, second = [int(total * f) for f in _ends(fracs)]
    starts = [max(1, first - int(total * w)) for w in widen]
    order = [ts, *key]
    places = list(range(len(starts) + 1))
    met = upto_bounds(df, order, bounds_at(df, order, _ranks(df, "at int, rank long", list(enumerate([*starts, second])))), places)
    end = F.col(f"_b{len(starts)}")
    classes = met.where(end).agg(*[F.count_distinct(F.when(~F.col(f"_b{i}"), F.col(label))).alias(f"w{i}") for i in range(len(starts))]).first()
    start = F.col(f"_b{next((i for i in range(len(starts)) if classes[f'w{i}'] > 1), 0)}")
    return met.withColumn("split", F.when(start, "train").when(end, "val").otherwise("test")).drop(*[f"_b{i}" for i in places])


def rolling_folds(df: DataFrame, block: str, mode: str, n: int, ts: str | None = None, frac: float = 0.7) -> DataFrame:
    """df once for every fold and role. strict: train B1..Bk-2, cal Bk-1, test Bk (k from 6). adaptive: train all before Bk-1
    and its first part, cal its rest, test Bk (k from 2); the first part ends time-safely near frac (a block of one time is
    all first part). A row's folds follow from its block and part alone, by a broadcast equality join."""
    first = 6 if mode == "strict" else 2
    rules = []
    for k in range(first, n + 1):
        if mode == "strict":
            rules += [(k, "train", 1, k - 2, (0,)), (k, "cal", k - 1, k - 1, (0,)), (k, "test", k, k, (0,))]
        else:
            rules += [(k, "train", 1, k - 2, (1, 2)), (k, "train", k - 1, k - 1, (1,)), (k, "cal", k - 1, k - 1, (2,)), (k, "test", k, k, (1, 2))]
    rows = [(b, own, k, role) for k, role, lo, hi, parts in rules for b in range(lo, hi + 1) for own in parts]
    spec = df.sparkSession.createDataFrame(rows, "_block int, _part int, fold int, role string")
    joined = df.withColumn("_own", _own_part(df, block, mode, n, ts, frac)).join(F.broadcast(spec), (F.col(block) == F.col("_block")) & (F.col("_own") == F.col("_part")))
    return joined.drop("_own", "_block", "_part")


def _own_part(df: DataFrame, block: str, mode: str, n: int, ts: str | None, frac: float) -> Column:
    """A row's part of its block: 0 if blocks aren't cut (strict), else 1 or 2, by a comparison of its time with a literal."""
    own = F.lit(0)
    if mode == "strict":
        return own
    counts = df.groupBy(block, ts).agg(F.count("*").alias("n"))
    places = prefix_sums(counts, ts, ["n"], by=(block,)).withColumn("_before", F.col("cum_n") - F.col("n"))
    sizes = counts.groupBy(block).agg(F.sum("n").alias("_size"))
    text, back = _moment(df, ts)
    at = F.struct("_before", text(F.col(ts)).alias("t"))
    cut = join_keys(places, sizes, [block]).where("_before > 0").groupBy(block).agg(F.min_by(at, _nearest(F.col("_size") * frac, F.col("_before"))).alias("_cut"))
    for r in cut.where(F.col(block).between(1, n)).collect():  # a row for each block
        t = r["_cut"]["t"]
        own = F.when(F.col(block) == r[block], 1 + _from(ts, None if t is None else back(t)).cast("int")).otherwise(own)
    return F.when(own == 0, 1).otherwise(own)


def fold_positions(df: DataFrame, block: str, mode: str, n: int, ts: str | None = None, frac: float = 0.7, out: str = "pos") -> DataFrame:
    """df with its rows' position in time: 2b for block b, 2b + 1 for the second part of a block that is cut. What a fold of
    rolling_folds trains on is every position up to its `train_to`, so no row has to stand once for every fold."""
    return df.withColumn(out, (2 * F.col(block) + F.greatest(_own_part(df, block, mode, n, ts, frac) - 1, F.lit(0))).cast("int"))


def fold_spec(spark, mode: str, n: int) -> DataFrame:
    """pos, fold, role (cal, test), train_to: for each position the folds that calibrate or test there, at most three, and the last
    position that the fold trains on."""
    rows = []
    for k in range(6 if mode == "strict" else 2, n + 1):
        train_to = 2 * (k - 2) + 1 if mode == "strict" else 2 * (k - 1)
        rows += [(2 * k + i, k, "test", train_to) for i in (0, 1)] + [(2 * (k - 1) + i, k, "cal", train_to) for i in (0, 1) if 2 * (k - 1) + i > train_to]
    return spark.createDataFrame(rows, "pos int, fold int, role string, train_to int")


def fold_chronology(folds: DataFrame, ts: str) -> DataFrame:
    """fold, ordered: max(train) < min(cal) <= max(cal) < min(test)."""
    at = lambda role: F.when(F.col("role") == role, F.col(ts))
    ends = folds.groupBy("fold").agg(F.max(at("train")).alias("a"), F.min(at("cal")).alias("b"), F.max(at("cal")).alias("c"), F.min(at("test")).alias("d"))
    return ends.select("fold", F.coalesce((F.col("a") < F.col("b")) & (F.col("b") <= F.col("c")) & (F.col("c") < F.col("d")), F.lit(False)).alias("ordered"))


def assert_chronology(folds: DataFrame, ts: str) -> DataFrame:
    found = fold_chronology(folds, ts)
    if found.where("not ordered").limit(1).count():
        raise ValueError("a fold's parts overlap in time")
    return found


def order_by_time(df: DataFrame, ts: str, key: list[str]) -> DataFrame:
    """df in time order, ties by key, rows without a time last; only where the order of the output itself matters."""
    return df.orderBy(F.col(ts).asc_nulls_last(), *key)


#: Children of a node in the tree over interval ends.
FANOUT = 16


def _on_level(run: Column, level: int) -> Column:
    return F.transform(run, lambda i: F.struct(F.lit(level).alias("l"), i.alias("i")))


def attach_block(df: DataFrame, blocks: DataFrame, position: str) -> DataFrame:
    """Interval join: df with `block` of every row of blocks (block, start, stop: half-open) that holds its position. Blocks may be
    many and may overlap; a row stands once for each that holds it, and goes if none does. Null positions, blocks without
    an end and empty ones meet nothing.

    Positions and ends are merged into one order, so a position becomes the number of ends at or before it and a block a
    range of such numbers. A range is cut into nodes of a tree of FANOUT children, at most 2 * FANOUT a level; a row names
    its node on every level. Rows meet blocks on equal nodes, each pair once: no nested loop, and no pair that doesn't hold."""
    ends = blocks.where(F.col("start") < F.col("stop")).select("block", "start", "stop")
    cuts = ends.select(F.explode(F.array("start", "stop")).alias("_x")).distinct().withColumn("_cut", F.lit(1))
    asked = df.select(F.col(position).alias("_x")).where("_x is not null").distinct().withColumn("_cut", F.lit(0))
    merged = prefix_sums(cuts.unionByName(asked).groupBy("_x").agg(F.sum("_cut").alias("_cut")), "_x", ["_cut"]).select("_x", F.col("cum__cut").alias("_at"))
    number = lambda x, c, out: x.join(merged.select(F.col("_x").alias(f"_{out}"), F.col("_at").alias(out)), F.col(c) == F.col(f"_{out}")).drop(f"_{out}")
    levels, most = 1, cuts.count()
    while FANOUT**levels <= most:
        levels += 1
    spread = number(number(ends, "start", "_lo"), "stop", "_hi").select("block", "_lo", "_hi")
    nodes, lo, hi = [], F.col("_lo"), F.col("_hi")
    for level in range(levels):
        last = level == levels - 1
        inner_lo = hi if last else F.least(F.ceil(lo / FANOUT) * FANOUT, hi)
        inner_hi = hi if last else F.greatest(F.floor(hi / FANOUT) * FANOUT, inner_lo)
        for x, y in ((lo, inner_lo), (inner_hi, hi)):
            run = F.when(x < y, F.sequence(x.cast("long"), y.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
            nodes.append(_on_level(run, level))
        spread = spread.withColumn(f"_lo{level}", F.floor(inner_lo / FANOUT)).withColumn(f"_hi{level}", F.floor(inner_hi / FANOUT))
        lo, hi = F.col(f"_lo{level}"), F.col(f"_hi{level}")
    held = spread.select("block", F.explode(F.concat(*nodes)).alias("_n")).select("block", F.col("_n.l").alias("_l"), F.col("_n.i").alias("_i"))
    own = F.explode(F.array(*[F.struct(F.lit(level).alias("l"), F.floor(F.col("_at") / FANOUT**level).alias("i")) for level in range(levels)]))
    named = number(df, position, "_at").withColumn("_n", own)
    return named.join(held, (F.col("_n.l") == F.col("_l")) & (F.col("_n.i") == F.col("_i"))).drop("_n", "_at", "_l", "_i")


def block_counts(df: DataFrame, blocks: DataFrame, position: str, by: list[str]) -> DataFrame:
    """by, block, n: how many rows of each of the few groups `by` stand in each block (block, start, stop: half-open), where any do;
    what counting attach_block gives, without its pairs. A block's count is the group's rows before its stop less those before
    its start, so the work grows with rows and with groups times ends, however many rows a block holds."""
    ends = blocks.where(F.col("start") < F.col("stop")).select("block", "start", "stop")
    counts = df.where(F.col(position).isNotNull()).groupBy(*by, F.col(position).alias("_x")).agg(F.count("*").alias("_n")).withColumn("_cut", F.lit(0))
    cuts = ends.select(F.explode(F.array("start", "stop")).alias("_x")).distinct()
    asked = df.select(*by).distinct().crossJoin(cuts).withColumn("_n", F.lit(0).cast("long")).withColumn("_cut", F.lit(1))
    merged = counts.unionByName(asked).groupBy(*by, "_x").agg(F.sum("_n").alias("_n"), F.max("_cut").alias("_cut"))
    before = prefix_sums(merged, "_x", ["_n"], tuple(by)).where("_cut = 1").select(*by, "_x", (F.col("cum__n") - F.col("_n")).alias("_before"))
    before = stored(before, "before")
    lo = ends.join(before.withColumnRenamed("_before", "_lo"), F.col("start") == F.col("_x")).drop("_x")
    met = join_keys(lo, before.select(*by, F.col("_x").alias("stop"), F.col("_before").alias("_hi")), [*by, "stop"])
    return met.groupBy(*by, "block").agg(F.sum(F.col("_hi") - F.col("_lo")).alias("n")).where("n > 0")
