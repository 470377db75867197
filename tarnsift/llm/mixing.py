"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates whose words add up to each source's target (and that stay under the cap) the balanced ones
are closest to "every document once" in relative entropy. The convex dual has one multiplier for each source; the
rates are exponential tilts of the document's size, r = min(cap, exp(lambda * size / mean size)). Newton iterations
solve it on the table of (source, size) counts, each a grouped sum on the executors. Rates become copies by size
class, from large to small, with the words still owed carried on, so a source misses its target by about its smallest
document. Sizes go in runs of PART: each carries inside, then what the runs are left with is carried along the runs. Inside
a class the documents with the least hashes get the odd copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnsift.llm.common import repeats, table, unit_hash, unused
from tarnsift.sources.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one class that a task ranks.
RANKED = 512
#: Sizes of one source that are carried through in one go.
PART = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """skey, source_size, n_docs, target: `share` of all words dealt by weight, none above cap times its source's size.

    Sources run by code point, null last, and the weights repeat along them. Where the excess over the caps goes is the
    level L with sum(min(cap * size, L * weight)) = share of all. The windows run over one row for each source.
    """
    by = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = W.orderBy((F.col("skey") == "0").cast("int"), "skey")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.get(listed, (F.row_number().over(order) - 1) % len(weights))).withColumn("most", F.col("source_size") * cap)
    filling = W.orderBy(F.col("most") / F.col("weight"), "skey")
    everything = W.partitionBy()
    by = by.withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(share)))
    by = by.withColumn("before", F.coalesce(F.sum("most").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("level", (F.col("whole") - F.col("before")) / F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("open_level", F.when(F.col("level") < F.col("most") / F.col("weight"), F.col("level")))
    level = F.max("open_level").over(everything)  # of the sources not yet full the levels fall, so the first is the greatest
    return by.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most")))).select("skey", "source_size", "n_docs", "target")


def balance(classes: DataFrame, cap: float, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """skey, lam: multipliers that make the rates' words meet the targets. Newton steps on the logarithm of the sum,
    halving the bracket where a step leaves it; raises if they do not settle. Sources that are to be taken whole `cap` times have no multiplier."""
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    open_ = classes.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * (cap * (1 - 1e-9))))
    state = open_.select("skey").distinct().select("skey", F.lit(0.0).alias("lam"), F.lit(-1e7).alias("lo"), F.lit(1e7).alias("hi"), F.lit(1.0).alias("gap"))
    worst = None
    for at in range(rounds):
        rate = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        words = F.col("n") * F.col("size") * F.least(F.lit(cap), rate)
        slope = F.when(rate < cap, F.col("n") * F.col("size") * x * rate).otherwise(0.0)
        step = open_.join(state, "skey").groupBy("skey").agg(F.first("lam").alias("lam"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("target").alias("target"), F.sum(words).alias("f"), F.sum(slope).alias("df"))
        step = step.withColumn("gap", F.abs(F.col("f") / F.col("target") - 1)).withColumn("lo", F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("f") >= F.col("target"), F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.log(F.col("f") / F.col("target")) * F.col("f") / F.col("df")
        middle = F.when((F.col("lo") <= -1e7) | (F.col("hi") >= 1e7), F.col("lam") + F.when(F.col("f") < F.col("target"), 1.0).otherwise(-1.0) * (1 + F.abs("lam"))).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = (F.col("f") > 0) & (F.col("df") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        new = step.select("skey", F.when(F.col("gap") <= tolerance, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"), "lo", "hi", "gap")
        state = stored(new, "multipliers", instead_of=state if at else None)
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= tolerance:
            break
    if worst is not None and worst > 1e-6:
        raise RuntimeError(f"a source's rates miss its target by {worst} of it after {rounds} rounds")
    return state.select("skey", F.round("lam", 9).alias("lam"))


def copies_by_class(classes: DataFrame, multipliers: DataFrame, cap: float) -> DataFrame:
    """skey, size, n, k: copies that the n documents of a size share. From large sizes to small, what is owed is carried."""
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    full = F.col("target") >= F.col("source_size") * (cap * (1 - 1e-9))
    rate = F.when(full, F.lit(cap)).when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("lam") * x, F.lit(700.0)))))
    rated = classes.join(multipliers, "skey", "left").withColumn("rate", rate)
    run = F.floor((F.row_number().over(W.partitionBy("skey").orderBy(F.col("size").desc())) - 1) / PART)
    lists = rated.withColumn("part", run).groupBy("skey", "part").agg(
        F.first("target").alias("target"), F.reverse(F.sort_array(F.collect_list(F.struct("size", "n", (F.col("rate") * F.col("n")).alias("want"))))).alias("c")
    ).withColumn("planned", F.aggregate("c", F.lit(0.0), lambda a, c: a + c["want"] * c["size"]))
    whole = W.partitionBy("skey")
    lists = lists.withColumn("last", F.max("part").over(whole)).withColumn("owed", F.col("target") - F.sum("planned").over(whole))

    def take(state, c):
        most = c["n"] * F.lit(int(cap))
        k = F.greatest(F.lit(0), F.least(most, F.round((c["want"] * c["size"] + state["owed"]) / c["size"]).cast("long")))
        return F.struct((state["owed"] + (c["want"] - k) * c["size"]).alias("owed"), F.concat(state["k"], F.array(k)).alias("k"))

    def dealt(rows: DataFrame, owed: Column) -> DataFrame:
        return rows.withColumn("dealt", F.aggregate("c", F.struct(owed.alias("owed"), F.array().cast("array<bigint>").alias("k")), take))

    # the runs but the last, each for itself; then what they owe goes along them, settled by the least size of each
    upper = dealt(lists.where("part < last"), F.lit(0.0))
    end = F.struct("part", F.col("dealt.owed").alias("owed"), F.element_at("c", -1)["size"].alias("size"), F.element_at("c", -1)["n"].alias("n"), F.element_at("dealt.k", -1).alias("k"))

    def settle(state, e):
        owed = state["owed"] + e["owed"]
        more = F.greatest(-e["k"], F.least(e["n"] * F.lit(int(cap)) - e["k"], F.round(owed / e["size"]).cast("long")))
        return F.struct((owed - more * e["size"]).alias("owed"), F.concat(state["more"], F.array(F.struct(e["part"].alias("part"), more.alias("more")))).alias("more"))

    nothing = F.struct(F.col("owed"), F.array().cast("array<struct<part:bigint,more:bigint>>").alias("more"))
    settled = upper.groupBy("skey").agg(F.first("owed").alias("owed"), F.sort_array(F.collect_list(end)).alias("ends")).select("skey", F.aggregate("ends", nothing, settle).alias("s"))
    more = settled.select("skey", F.explode("s.more").alias("m")).select("skey", F.col("m.part").alias("part"), F.col("m.more").alias("more"))
    rest = F.slice("dealt.k", 1, F.size("dealt.k") - 1)
    upper = upper.join(more, ["skey", "part"]).select("skey", "c", F.concat(rest, F.array(F.element_at("dealt.k", -1) + F.col("more"))).alias("k"))
    lower = lists.where("part = last").join(settled.select("skey", F.col("s.owed").alias("carried")), "skey", "left")
    lower = dealt(lower, F.coalesce("carried", "owed")).select("skey", "c", F.col("dealt.k").alias("k"))
    return upper.unionByName(lower).select("skey", F.explode(F.arrays_zip("c", "k")).alias("z")).select("skey", F.col("z.c.size").alias("size"), F.col("z.c.n").alias("n"), F.col("z.k").alias("k"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The columns of docs with skey, size, source_size, target, copies and taken (= copies * size) for every row; columns of
    docs that have these names are replaced.

    Null or empty texts have size 0 and are never taken. Sources of size 0 have target 0. Null sources are one source.
    Repeated rows are documents of their own. Needs doc_id, source and size columns beside what is to be carried along.
    """
    added = ["skey", "size", "source_size", "target", "copies", "taken"]
    carried = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    skey = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source")))
    keyed = docs.select(F.struct(*carried).alias("row"), skey.alias("skey"), F.col("size").cast("long").alias("size"))
    aims = stored(targets(keyed, list(weights), share, cap), "targets")
    classes = stored(keyed.where("size > 0").groupBy("skey", "size").agg(F.count("*").alias("n")).join(aims, "skey"), "classes")
    dealt = stored(copies_by_class(classes, balance(classes, cap), cap), "copies")

    # two-level rank by hash, so that a class with a great share of all rows is many tasks' work
    sure = keyed.where("size > 0").withColumn("spot", unit_hash("row", F.lit("mix"))).join(dealt, ["skey", "size"])
    placed = sure.withColumn("cell", F.floor(F.col("spot") * F.ceil(F.col("n") / RANKED)))
    cells = placed.groupBy("skey", "size", "cell").agg(F.count("*").alias("in_cell"))
    before = cells.withColumn("ahead", F.sum("in_cell").over(W.partitionBy("skey", "size").orderBy("cell")) - F.col("in_cell")).drop("in_cell")
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("skey", "size", "cell").orderBy("spot", "row.doc_id"))).join(before, ["skey", "size", "cell"])
    copies = F.floor(F.col("k") / F.col("n")) + (F.col("rank") + F.col("ahead") <= F.col("k") % F.col("n")).cast("int")
    out = ranked.select("row", "skey", "size", copies.cast("long").alias("copies")).unionByName(keyed.where("size = 0 or size is null").select("row", "skey", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("copies")))
    out = out.join(aims.drop("n_docs"), "skey")
    return out.select("row.*", "skey", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows and columns of docs, each document as often as the mix takes it. Copies are decided on ids, sources and
    sizes alone; the texts are shuffled once, when the copies are made."""
    copies = unused(docs, "copies")
    if repeats(docs, "doc_id"):
        inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
        return mix(inner, **parameters).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
    chosen = mix(stored(sized(docs), "sizes"), **parameters).where("copies > 0").select(F.col("doc_id").alias(copies + "_id"), F.col("copies").alias(copies))
    taken = docs.join(chosen, F.col("doc_id").cast("long") == F.col(copies + "_id"))
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(stored(sized(table(spark, sf_dir, "documents")), "sizes")).select("doc_id", "size", "source_size", "target", "taken")
