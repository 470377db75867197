import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnsift.operators import split as P
from tarnsift.operators.primitives import bucketed_rank, hash_unit, prefix_sums


@pytest.fixture(scope="module")
def frame(spark):
    """10 000 rows, 7 in a second, every 11th an attack."""
    start = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, start + dt.timedelta(seconds=i // 7), "ATTACK-X" if i % 11 == 0 else "BENIGN", int(i % 11 == 0)) for i in range(10_000)], "id int, ts timestamp_ntz, family string, label int").cache()


def test_blocks_share_no_second(frame):
    b = P.time_blocks(frame, "ts", 10)
    assert b.groupBy("ts").agg(F.count_distinct("block").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in b.groupBy("block").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 14


def test_block_cut_is_near_and_ordered(frame):
    b = P.split_block(frame, "ts", 0.7)
    r = b.groupBy("part").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.first("realised").alias("f")).orderBy("part").collect()
    assert 0.6 <= r[0]["f"] <= 0.8 and r[0]["hi"] < r[1]["lo"]


def test_folds_keep_time_order(frame):
    blocks = P.time_blocks(frame, "ts", 10)
    assert P.assert_chronology(P.rolling_folds(blocks, "block", "strict", 10), "ts").count() == 5
    assert P.fold_chronology(P.rolling_folds(blocks, "block", "adaptive", 10, "ts"), "ts").where("ordered").count() == 9


def test_stratified_counts_and_groups(frame):
    s = P.stratified_split(frame, "family", ["id"])
    got = {(r["family"], r["split"]): r["count"] for r in s.groupBy("family", "split").count().collect()}
    assert got[("ATTACK-X", "train")] == round(910 * 0.7) and sum(got.values()) == 10_000
    g = P.group_split(frame.withColumn("g", F.col("id") % 100), "g")
    assert P.assert_disjoint(g, "g").first()["train_test"] == 0
    with pytest.raises(ValueError):
        P.assert_disjoint(s.withColumn("g", F.lit(1)), "g")
    with pytest.raises(ValueError):
        P.stratified_split(frame.limit(3), "family", ["id"])


def test_oversampling_equals_classes(frame):
    got = {r["label"]: r["count"] for r in P.oversample_minority(frame, "label", ["id"]).groupBy("label").count().collect()}
    assert got[0] == got[1] == 9090
    assert P.oversample_minority(frame.where("label = 0"), "label", ["id"]).count() == 9090


def test_shards_hold_every_row_once(frame):
    s = P.shard_balanced(frame, "label", ["id"], 2, 5)
    assert s.count() == 10_000 and s.select("id").distinct().count() == 10_000
    k = P.shard_skewed(frame, "label", "id", ["id"], 2, 5)
    assert k.select("id").distinct().count() == 10_000 == k.count()
    assert k.groupBy("rsu", "vehicle").agg(F.count_distinct("label").alias("n")).where("n = 2").count() == 10


def test_allocation_is_exact():
    assert sum(P.allocate(100, [1, 2, 3.5, 0])) == 100
    assert sorted(P.allocate(10, [1, 1, 100], low=1, high=6)) == [2, 2, 6]
    with pytest.raises(ValueError):
        P.allocate(3, [1, 1, 1, 1], low=1)


def test_rank_and_prefix_with_ties(spark, frame):
    ranked = bucketed_rank(frame, ["ts", "id"])
    assert ranked.where(F.col("rank") != F.col("id") + 1).count() == 0
    sums = prefix_sums(spark.createDataFrame([(i, 1) for i in range(500)], "k int, n int"), "k", ["n"])
    assert sums.where(F.col("cum_n") != F.col("k") + 1).count() == 0


def test_held_out_family_never_trains(frame):
    got = P.leave_one_class_out(frame.withColumn("g", F.col("id") % 50), "family", "g", ["ATTACK-X"])
    assert got.where("role <> 'test' and family = held_out").count() == 0
    clean = got.where("role = 'test' and not removed").select("g").distinct()
    assert clean.join(got.where("role <> 'test'"), "g", "left_semi").count() == 0


def test_null_groups_and_null_keys_stay(spark):
    rows = [(i, None if i % 4 == 0 else "ab"[i % 2], None if i % 10 == 0 else float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    last = lambda r: (r[2] is None, r[2] or 0, r[0])
    want = {r[0]: k + 1 for g in ("a", "b", None) for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=last))}
    assert {r["id"]: r["rank"] for r in bucketed_rank(df, ["x", "id"], ("g",)).collect()} == want
    sums = {(r["g"], r["x"]): r["cum_n"] for r in prefix_sums(df.groupBy("g", "x").agg(F.count("*").alias("n")), "x", ["n"], ("g",)).collect()}
    assert all(sums[g, None] == sum(r[1] == g for r in rows) for g in {r[1] for r in rows if r[2] is None}) and len(sums) == len({r[1:] for r in rows})
    assert P.stratified_split(df, "g", ["id"]).count() == P.cap_per_class(df, "g", ["id"], 500).count() == P.group_split(df, "g").count() == 200


@pytest.fixture(scope="module")
def holed(spark):
    """300 rows with null classes, groups, times and texts as keys."""
    start = dt.datetime(2026, 1, 1)
    rows = [(i, None if i % 5 == 0 else i % 2, None if i % 4 == 0 else f"g{i % 30}", None if i % 7 == 0 else start + dt.timedelta(seconds=i // 3)) for i in range(300)]
    return spark.createDataFrame(rows, "id int, y int, g string, ts timestamp_ntz").cache()


def test_no_split_loses_rows_without_class_group_or_time(holed):
    n = holed.count()
    assert P.stratified_split(holed, "y", ["id"]).count() == P.cap_per_class(holed, "y", ["id"], 10**6).count() == P.shard_balanced(holed, "y", ["id"], 2, 3).count() == P.group_split(holed, "g").count() == n
    assert P.time_blocks(holed, "ts", 5).count() == P.terminal_split(holed, "ts").count() == P.split_block(holed, "ts").count() == P.chronological_split(holed, "ts", ["id"], "y").count() == n
    late = P.time_blocks(holed, "ts", 5).where("ts is null").select("block").distinct().collect()
    assert [r["block"] for r in late] == [5] and {r["split"] for r in P.chronological_split(holed, "ts", ["id"], "y").where("ts is null").select("split").collect()} <= {"val", "test"}
    folds = P.rolling_folds(P.time_blocks(holed, "ts", 5), "block", "adaptive", 5, "ts")
    assert folds.where("fold = 5").count() == n and folds.where("role = 'test'").select("id").distinct().count() > 0
    over = P.oversample_minority(holed, "y", ["id"])
    counts = {r["y"]: r["count"] for r in over.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 120 and counts[None] == 60
    with pytest.raises(ValueError):
        P.shard_skewed(holed, "y", "id", ["id"], 2, 2)


def test_positions_are_exact_with_null_groups(holed):
    rows = [(r["y"], r["split"]) for r in P.stratified_split(holed, "y", ["id"]).collect()]
    for y, n in ((0, 120), (1, 120), (None, 60)):
        assert [rows.count((y, s)) for s in ("train", "val", "test")] == [round(n * 0.7), round(n * 0.85) - round(n * 0.7), n - round(n * 0.85)]
    shards = P.shard_balanced(holed, "y", ["id"], 2, 3).groupBy("y", "rsu", "vehicle").count().collect()
    assert {(r["y"], r["count"]) for r in shards} == {(0, 20), (1, 20), (None, 10)} and len(shards) == 18
    times = P.chronological_split(holed, "ts", ["id"], "y")
    ends = {r["split"]: (r["lo"], r["hi"]) for r in times.groupBy("split").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()}
    assert ends["train"][1] <= ends["val"][0] and {r["split"]: r["count"] for r in times.groupBy("split").count().collect()} == {"train": 210, "val": 45, "test": 45}


def test_empty_tables_give_empty_splits(holed):
    none = holed.limit(0)
    for out in (P.time_blocks(none, "ts", 4), P.terminal_split(none, "ts"), P.split_block(none, "ts"), P.stratified_split(none, "y", ["id"]), P.group_split(none, "g"), P.cap_per_class(none, "y", ["id"], 5), P.oversample_minority(none, "y", ["id"]), P.chronological_split(none, "ts", ["id"], "y")):
        assert out.count() == 0
    with pytest.raises(ValueError):
        P.time_blocks(holed.withColumn("ts", F.lit(1)), "ts", 3)


def test_cuts_that_fall_together_are_sought_again(spark):
    """Nearly all rows share one time, so that the nearest cut of several fractions is the same."""
    df = spark.createDataFrame([(i, 5 if 3 <= i < 97 else i) for i in range(100)], "id int, ts int")
    sizes = {r["block"]: r["count"] for r in P.time_blocks(df, "ts", 4).groupBy("block").count().collect()}
    assert len(sizes) == 4 and sum(sizes.values()) == 100
    b = P.time_blocks(df, "ts", 4)
    assert b.groupBy("ts").agg(F.count_distinct("block").alias("n")).where("n > 1").count() == 0


def test_text_keys_rank_in_their_order(spark):
    words = sorted(f"{a}{b}é{c}" for a in "azÅ" for b in ("", "prefix prefix") for c in range(30))
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").repartition(5)
    got = {r["w"]: r["rank"] for r in bucketed_rank(df, ["w"]).collect()}
    assert [got[w] for w in sorted(words, key=lambda w: w.encode())] == list(range(1, len(words) + 1)) and got[None] == len(words) + 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_and_splits_shuffle_no_rows(frame, tmp_path):
    """No exchange stands between the table's rows and the block or part they get."""
    frame.withColumn("wide", F.lit("x")).write.parquet(f"{tmp_path}/t")
    t = frame.sparkSession.read.parquet(f"{tmp_path}/t")
    for out in (P.time_blocks(t, "ts", 10), P.terminal_split(t, "ts"), P.split_block(t, "ts")):
        assert "Exchange" not in _plan(out)
    folds = _plan(P.rolling_folds(P.time_blocks(t, "ts", 10), "block", "adaptive", 10, "ts"))
    assert folds.count("Exchange") == folds.count("BroadcastExchange") and "BroadcastHashJoin" in folds
    for out in (P.stratified_split(t, "family", ["id"]), P.cap_per_class(t, "family", ["id"], 100), P.shard_balanced(t, "family", ["id"], 2, 5)):
        exchanges = [line for line in _plan(out).split("\n") if "Exchange" in line]
        plan = _plan(out)
        assert "SortMergeJoin" not in plan.split("BroadcastHashJoin")[0] and not any("wide" in line for line in exchanges)


def test_three_way_search(spark):
    df = spark.createDataFrame([(g, c) for g in range(40) for c in "ab"] + [(0, "rare"), (1, "rare")], "g int, c string")
    assert P.three_way_search(df, "g", "c", [1, 2]).first()["status"] == "too_few_groups"
    good = P.three_way_split(df.where("c <> 'rare'"), "g", "c", list(range(20)))
    assert good.groupBy("split").agg(F.count_distinct("c").alias("n")).where("n = 2").count() == 3 and P.assert_disjoint(good, "g").count() == 1
    with pytest.raises(ValueError, match="too_few_groups"):
        P.three_way_split(df, "g", "c", [1])
    assert P.best_group_split(df.where("c <> 'rare'"), "g", "c", [0.3], [1, 2, 3]).groupBy("split").count().count() == 2


def test_skewed_plan_keeps_its_bounds():
    plan = P.skew_plan(4000, 16000, 4, 5)
    sizes = [p + n for p, n in plan]
    assert sum(p for p, _ in plan) == 4000 and sum(sizes) == 20000 and min(min(x) for x in plan) >= 1 and max(sizes) <= 10 * min(sizes) + 10 and max(sizes) > 3 * min(sizes)
    assert P.allocate(10, [1, 1, 1], low=[0, 5, 0], high=[2, 9, 3]) == [2, 7, 1] and P.allocate(9, [9, 1, 0], low=[0, 0, 2], high=[3, 9, 9]) == [3, 4, 2]


def test_many_overlapping_intervals(spark):
    """100 000 intervals, each met as often as counting says, without a nested loop."""
    import numpy as np

    draw = np.random.default_rng(3)
    start, width = draw.integers(0, 50_000, 100_000), draw.choice([0, 1, 2, 7, 300], 100_000, p=[0.1, 0.3, 0.3, 0.29, 0.01])
    blocks = spark.createDataFrame([(i, int(a), int(a + w)) for i, (a, w) in enumerate(zip(start, width))] + [(-1, None, 5), (-2, 9, 3)], "block int, start int, stop int")
    rows = spark.createDataFrame([(int(x),) for x in range(0, 50_000, 50)] + [(None,), (-5,), (10**9,)] + [(777,)] * 50, "x int")
    met = P.attach_block(rows, blocks, "x")
    got = {r["x"]: r["n"] for r in met.groupBy("x").agg(F.count("*").alias("n")).collect()}
    of = lambda x: int(((start <= x) & (x < start + width)).sum())
    assert got == {x: of(x) * (50 if x == 777 else 1) for x in [*range(0, 50_000, 50), 777] if of(x)}
    assert "NestedLoop" not in met._jdf.queryExecution().toString()
    same = {(r["x"], r["block"]) for r in met.where("x < 100").collect()}
    assert same == {(x, i) for x in (0, 50) for i in np.flatnonzero((start <= x) & (x < start + width)).tolist()}


def test_positions_read_off_what_folds_hold(frame):
    blocks = P.time_blocks(frame, "ts", 10)
    for mode in ("strict", "adaptive"):
        folds = P.rolling_folds(blocks, "block", mode, 10, "ts").groupBy("fold", "role").count()
        at = P.fold_positions(blocks, "block", mode, 10, "ts")
        spec = P.fold_spec(frame.sparkSession, mode, 10)
        read = at.join(spec, "pos").groupBy("fold", "role").count()
        train = at.crossJoin(spec.select("fold", "train_to").distinct()).where("pos <= train_to").groupBy("fold").count().withColumn("role", F.lit("train"))
        rows = lambda df: sorted((r["fold"], r["role"], r["count"]) for r in df.collect())
        assert rows(read.select("fold", "role", "count").unionByName(train.select("fold", "role", "count"))) == rows(folds)



def test_shares_of_rows_round_as_decimals(spark):
    """45 * 0.7 is 31.5 and 90 * 0.7 is 63, while the doubles' products lie below."""
    sizes = lambda df: {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    df = spark.range(45).withColumn("family", F.lit(None).cast("string"))
    assert sizes(P.stratified_split(df, "family", ["id"])) == {"train": 32, "val": 6, "test": 7}
    assert sizes(P.group_split(df, "id")) == {"train": 32, "val": 6, "test": 7}
    rows = spark.range(90).withColumn("label", (F.col("id") % 2).cast("int"))
    assert sizes(P.chronological_split(rows, "id", ["id"], "label")) == {"train": 63, "val": 13, "test": 14}


def test_counts_of_blocks_equal_those_of_pairs(spark):
    rows = spark.range(300).select((F.col("id") % 40 - 5).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g")).unionByName(spark.createDataFrame([(None, 1)], "x double, g long"))
    blocks = spark.createDataFrame([(1, 0.0, 10.0), (2, 3.0, 3.0), (3, -9.0, 99.0), (4, 9.5, 9.75), (5, 30.0, None), (1, 12.0, 14.0), (6, 34.0, 35.0)], "block int, start double, stop double")
    got = {(r["g"], r["block"]): r["n"] for r in P.block_counts(rows, blocks, "x", ["g"]).collect()}
    pairs = P.attach_block(rows, blocks, "x").groupBy("g", "block").count().collect()
    assert got == {(r["g"], r["block"]): r["count"] for r in pairs} and len(got) == 9


def test_balanced_shards_by_rank_also_where_hashes_tie(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, y int")
    for coarse in (1 << 32, 16):
        monkeypatch.setattr(P, "hash_unit", lambda *key, seed=42, of=hash_unit, n=coarse: F.floor(of(*key, seed=seed) * n) / F.lit(float(n)))
        h = {r["id"]: r["h"] for r in df.select("id", P.hash_unit("id").alias("h")).collect()}
        want = {}
        for y in (0, 1, None):
            own = sorted((h[i], i) for i, label in rows if label == y)
            want |= {i: r * 20 // len(own) for r, (_, i) in enumerate(own)}
        assert {r["id"]: r["rsu"] * 10 + r["vehicle"] for r in P.shard_balanced(df, "y", ["id"], 2, 10).collect()} == want
    assert {(r["rsu"], r["vehicle"]) for r in P.shard_balanced(df, "y", ["id"], 1, 1).collect()} == {(0, 0)}
    # one search in the ends, not a comparison for each client, which makes a method too long to be compiled
    size = [len(P.shard_balanced(df, "y", ["id"], 2, n)._jdf.queryExecution().optimizedPlan().toString()) for n in (5, 30)]
    assert size[1] < 1.1 * size[0]
