"""Exact evaluation: counts, thresholds, curves, calibration, intervals. Curves come from counts of distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnsift.operators.primitives import join_keys, prefix_sums, score_counts
from tarnsift.operators.quantiles import with_quantiles

Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(df: DataFrame, label: str, pred: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """by, tn, fp, fn, tp; a row counts `weight` times."""
    own = (F.col(weight) if weight else F.lit(1)).cast("long")
    hit = lambda y, p: F.coalesce(F.sum(F.when((F.col(label) == y) & (F.col(pred) == p), own)), F.lit(0))
    return df.groupBy(*by).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1, balanced_accuracy, mcc, fpr to tn, fp, fn, tp. A zero denominator gives 0;
    balanced accuracy and mcc are null with one class only, everything without rows."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    both = (tp + fn > 0) & (tn + fp > 0)
    some = lambda c: F.when(n > 0, c)
    mcc = ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return counts.withColumns({
        "accuracy": some(ratio(tp + tn, n)), "precision": some(ratio(tp, tp + fp)), "recall": some(ratio(tp, tp + fn)), "f1": some(ratio(2 * tp, 2 * tp + fp + fn)),
        "balanced_accuracy": F.when(both, (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2), "mcc": F.when(both, mcc), "fpr": some(ratio(fp, fp + tn)),
    })


def wilson_interval(df: DataFrame, k: str, n: str, z: float = Z95) -> DataFrame:
    """Adds wilson_low and wilson_high; null without trials."""
    p, m = F.col(k) / F.col(n), F.col(n).cast("double")
    middle, half = (p + z * z / (2 * m)) / (1 + z * z / m), z / (1 + z * z / m) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    some = F.col(n) > 0
    return df.withColumn("wilson_low", F.when(some, F.greatest(F.lit(0.0), middle - half))).withColumn("wilson_high", F.when(some, F.least(F.lit(1.0), middle + half)))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _plain(df: DataFrame, by: tuple[str, ...], **cols: str | Column) -> tuple[DataFrame, tuple[str, ...]]:
    """Groups and columns under names of this module's own, so that no name of the caller's meets one of a count."""
    keys = tuple(f"_by{i}" for i in range(len(by)))
    return df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *[(F.col(c) if isinstance(c, str) else c).alias(f"_{n}") for n, c in cols.items()]), keys


def _named(by: tuple[str, ...]) -> list[Column]:
    return [F.col(f"_by{i}").alias(b) for i, b in enumerate(by)]


def roc_auc(df: DataFrame, label: str, score: str, by: tuple[str, ...] = (), one_class: float | None = None, weight: str | None = None) -> DataFrame:
    """by, auc: exact with ties (Mann-Whitney); one_class where a class is missing; a row counts `weight` times. Rows without a finite
    score have no place in the order and are left out; a group that has no other rows stands with one_class."""
    rows, keys = _plain(df, by, y=label, s=score, w=weight or F.lit(1))
    s = F.col("_s").cast("double")
    curve = score_counts(rows.withColumn("_s", F.when(is_finite(s), s)), "_y", "_s", keys, "_w")
    scored = lambda c: F.sum(F.when(F.col("_s").isNotNull(), c))
    sums = curve.groupBy(*keys).agg(scored(F.col("pos")).alias("_p"), scored(F.col("neg")).alias("_n"), scored(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("_u"))
    return sums.select(*_named(by), F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / F.col("_p") / F.col("_n")).otherwise(F.lit(one_class).cast("double")).alias("auc"))


def log_loss(df: DataFrame, label: str, score: str, by: tuple[str, ...] = (), eps: float = 1e-7) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(score)))
    return df.groupBy(*by).agg(F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def brier(df: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))


def ece(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins with single-precision edges. The last edge is exclusive: a score of
    1.0 is in no bin, yet counts among the rows. 0 with one class only."""
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    s = F.col(score).cast("float").cast("double")
    edges = [single(i / bins) for i in range(bins + 1)]
    which = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        which = F.when((s >= edges[i]) & (s < edges[i + 1]), i).otherwise(which)
    per = df.select(which.alias("bin"), F.col(score).alias("s"), F.col(label).cast("double").alias("y")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("y").alias("y"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("s") - F.col("y"))).otherwise(0.0)
    out = per.agg(F.sum(gap).alias("gap"), F.sum("n").alias("n"), F.sum("y").alias("y"))
    return out.select(F.when((F.col("y") == 0) | (F.col("y") == F.col("n")), 0.0).otherwise(F.col("gap") / F.col("n")).alias("ece"))


def best_f1_grid(df: DataFrame, label: str, score: str, low: float = 0.05, high: float = 0.95, points: int = 181, by: tuple[str, ...] = (), without: float = 0.5) -> DataFrame:
    """by, threshold, f1: the first best of an even grid; `without` positives that threshold and 0. A score is mapped to its last
    threshold once. Rows without a score (null, NaN) reach no threshold: their positives count as missed."""
    step = (high - low) / (points - 1)
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("_g"), F.round(F.lit(low) + F.col("id") * F.lit(step), 10).alias("_t"))
    rows, keys = _plain(df, by, y=label, s=score)
    s = F.col("_s").cast("double")
    g = F.when(s.isNotNull() & ~F.isnan(s), F.greatest(F.lit(-1.0), F.least(F.lit(float(points - 1)), F.floor((F.greatest(F.lit(-1e9), F.least(F.lit(1e9), s)) - low) / step + 1e-9)))).otherwise(-1.0)
    at = rows.select(*keys, g.cast("int").alias("_g"), "_y").groupBy(*keys, "_g").agg(F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") == 0).alias("_neg"))
    total = at.groupBy(*keys).agg(F.coalesce(F.sum("_pos"), F.lit(0)).alias("_p"))
    onwards = W.partitionBy(*keys).orderBy(F.col("_g").desc())
    curve = join_keys(total.crossJoin(F.broadcast(grid)), at, [*keys, "_g"], "left").na.fill(0, ["_pos", "_neg"])
    curve = curve.withColumn("_tp", F.sum("_pos").over(onwards)).withColumn("_fp", F.sum("_neg").over(onwards))
    f1 = F.round(ratio(2.0 * F.col("_tp"), F.col("_tp") + F.col("_fp") + F.col("_p")), 12)
    best = curve.withColumn("_f1", f1).groupBy(*keys).agg(F.min_by(F.struct("_t", "_f1"), F.struct(-F.col("_f1"), F.col("_g"))).alias("_b"), F.max("_p").alias("_p"))
    return best.select(*_named(by), F.when(F.col("_p") > 0, F.col("_b._t")).otherwise(without).alias("threshold"), F.when(F.col("_p") > 0, F.col("_b._f1")).otherwise(0.0).alias("f1"))


def best_f1_exact(df: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, threshold, f1: best over all distinct scores, clamped to [0, 1] before they are compared, lowest threshold on ties; 0.5
    without two classes or where no threshold gives an f1 above 0. Rows without a score (null, NaN) reach no threshold: their
    positives count as missed."""
    rows, keys = _plain(df, by, y=label, s=score)
    s = F.col("_s").cast("double")
    clamped = F.when(s.isNotNull() & ~F.isnan(s), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
    curve = score_counts(rows.withColumn("_s", clamped), "_y", "_s", keys)
    has = F.col("_s").isNotNull()
    scored = lambda c: F.coalesce(F.sum(F.when(has, F.col(c))), F.lit(0))
    totals = curve.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), scored("pos").alias("_sp"), scored("neg").alias("_sn"))
    both = join_keys(curve, totals, list(keys)) if keys else curve.crossJoin(totals)
    tp, fp = F.col("_sp") - F.col("cum_pos") + F.col("pos"), F.col("_sn") - F.col("cum_neg") + F.col("neg")
    f1 = F.round(ratio(2.0 * tp, tp + fp + F.col("_p")), 12)
    best = both.withColumn("_f1", f1).groupBy(*keys).agg(F.max_by(F.struct(F.col("_s").alias("t"), F.col("_f1").alias("f")), F.when(has, F.struct(F.col("_f1"), -F.col("_s")))).alias("_b"), F.max("_p").alias("_p"), F.max("_n").alias("_n"))
    good = (F.col("_p") > 0) & (F.col("_n") > 0) & (F.col("_b.f") > 0)
    return best.select(*_named(by), F.when(good, F.col("_b.t")).otherwise(0.5).alias("threshold"), F.when(good, F.col("_b.f")).otherwise(0.0).alias("f1"))


def fpr_statistic(df: DataFrame, score: str, targets: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, target, exceed: of benign scores the (floor(t * n) + 1)-th largest; a row is flagged if its score is above it.
    With t * n < 1 that is the maximum, so nothing benign is flagged. One curve serves all targets.
    Rows without a finite score are left out, of n too."""
    rows, keys = _plain(df.where(is_finite(F.col(score))), by, s=score)
    counts = prefix_sums(rows.groupBy(*keys, "_s").agg(F.count("*").alias("_c")), "_s", ["_c"], keys)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = join_keys(counts, totals, list(keys)) if keys else counts.crossJoin(totals)
    at_least = F.col("_n") - F.col("cum__c") + F.col("_c")  # benign scores not below this one
    spec = df.sparkSession.createDataFrame([(float(t),) for t in targets], "_target double")
    rank = F.floor(F.col("_target") * F.col("_n") + 1e-9) + 1
    best = joined.crossJoin(F.broadcast(spec)).where(at_least >= rank).groupBy(*keys, "_target").agg(F.max("_s").alias("_exceed"))
    return best.select(*_named(by), F.col("_target").alias("target"), F.col("_exceed").alias("exceed"))


def fpr_sensitivity(cal: DataFrame, test: DataFrame, label: str, score: str, targets: list[float]) -> DataFrame:
    """target, exceed and the binary metrics on test for each target; thresholds come from benign calibration rows. Each test row
    is put between two thresholds once and counted there; a target sums up the counts above its own. Test rows without a
    finite score are left out."""
    cuts = fpr_statistic(cal.where(F.col(label) == 0), score, targets).orderBy("exceed").collect()  # a row for each target
    above = sum(((F.col(score) > F.lit(r["exceed"])).cast("int") for r in cuts), F.lit(0))  # cuts ascend: it is above the first so many
    hit = lambda y: F.count_if(F.col(label) == y)
    counts = test.where(is_finite(F.col(score))).groupBy(above.alias("_above")).agg(hit(1).alias("_pos"), hit(0).alias("_neg"))
    spec = test.sparkSession.createDataFrame([(r["target"], r["exceed"], i) for i, r in enumerate(cuts)], "target double, exceed double, _i int")
    flagged = F.col("_above") > F.col("_i")
    part = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias
    per = counts.crossJoin(F.broadcast(spec)).groupBy("target", "exceed").agg(part(~flagged, "_neg")("tn"), part(flagged, "_neg")("fp"), part(~flagged, "_pos")("fn"), part(flagged, "_pos")("tp"))
    return binary_metrics(per)


def score_quantiles(df: DataFrame, score: str, by: tuple[str, ...], qs: list[float], weight: str | None = None) -> DataFrame:
    """by, n, q<percent>: interpolated quantiles of finite scores; a row counts `weight` times."""
    ok = df.where(is_finite(F.col(score)))
    n = F.sum(F.col(weight).cast("long")) if weight else F.count("*")
    return with_quantiles(ok.groupBy(*by).agg(n.alias("n")), ok, score, {f"q{round(q * 100):02d}": q for q in qs}, by, weight=weight)


#: What scores are told apart by when a model is judged: part and endpoint.
CATEGORIES = ("calibration_benign", "calibration_attack", "test_benign", "test_seen_attack", "test_novel_attack")


def score_categories(df: DataFrame, part: str, label: str, seen: Column) -> DataFrame:
    """df with category: benign and attack rows of `cal`, benign rows of `test`, and its attacks by whether their class was seen in
    training; rows of other parts, and without a label, go."""
    at = lambda p, y: (F.col(part) == p) & (F.col(label) == y)
    name = F.when(at("cal", 0), CATEGORIES[0]).when(at("cal", 1), CATEGORIES[1]).when(at("test", 0), CATEGORIES[2]).when(at("test", 1) & seen, CATEGORIES[3]).when(at("test", 1), CATEGORIES[4])
    return df.withColumn("category", name).where(F.col("category").isNotNull())


def finite_stats(df: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, sample sd (0 for one value), median, min, max of finite values."""
    v = F.col(col)
    ok = df.where(is_finite(v))
    stats = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.when(F.count("*") > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return with_quantiles(stats, ok, col, {"median": 0.5}, by).select(*by, "n", "mean", "sd", "median", "lo", "hi")


def describe_nearest_rank(df: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, median, population sd, min, max, nearest-rank p95; zeros without values."""
    v = F.col(col)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = df.groupBy(*by).agg(F.count(v).alias("n"), zero(F.avg(v)).alias("mean"), zero(F.stddev_pop(v)).alias("sd"), zero(F.min(v)).alias("lo"), zero(F.max(v)).alias("hi"))
    out = with_quantiles(with_quantiles(stats, df, col, {"median": 0.5}, by), df, col, {"p95": 0.95}, by, nearest=True)
    return out.select(*by, "n", "mean", zero(F.col("median")).alias("median"), "sd", "lo", "hi", zero(F.col("p95")).alias("p95"))


def percentile_vs_reference(df: DataFrame, reference: DataFrame, score: str, out: str = "pct", by: tuple[str, ...] = ()) -> DataFrame:
    """df with the share of the reference scores of its own group `by` that are not above its score; null without a finite score,
    0 where the group has no reference. Rows of both sides are counted by distinct score, no row is joined with rows."""
    finite = lambda x: x.where(is_finite(F.col(score)))
    tagged = lambda x, r: _plain(finite(x), by, s=F.col(score).cast("double"), r=F.lit(r))[0]
    keys = tuple(f"_by{i}" for i in range(len(by)))
    counts = tagged(df, 0).unionByName(tagged(reference, 1)).groupBy(*keys, "_s").agg(F.sum("_r").alias("_r"))
    curve = prefix_sums(counts, "_s", ["_r"], keys)
    total = curve.groupBy(*keys).agg(F.sum("_r").alias("_n"))
    shares = (join_keys(curve, total, list(keys)) if keys else curve.crossJoin(F.broadcast(total))).select(*_named(by), F.col("_s").alias("_reached"), ratio(F.col("cum__r"), F.col("_n")).alias(out))
    return join_keys(df.withColumn("_reached", F.col(score).cast("double")), shares, [*by, "_reached"], "left").drop("_reached")


def multiclass_confusion(df: DataFrame, label: str, probs: list[str], classes: list[str]) -> DataFrame:
    """label, pred, n: argmax of row-normalised probabilities, the first on ties."""
    p = F.array(*probs)
    pred = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(p, F.array_max(p)).cast("int"))
    return df.select(F.col(label), pred.alias("pred")).groupBy(label, "pred").agg(F.count("*").alias("n"))


def per_class_metrics(counts: DataFrame, label: str) -> DataFrame:
    """class, support, precision, recall, f1 from label, pred, n."""
    rows = counts.select(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col(label) == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    cols = counts.select(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"))
    per = rows.withColumn("predicted", F.lit(0).cast("long")).unionByName(cols).groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    return per.select("class", "support", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def multiclass_summary(df: DataFrame, label: str, probs: list[str], classes: list[str], eps: float = 1e-7) -> DataFrame:
    """One row: accuracy, macro and weighted f1, balanced accuracy, log loss, macro one-vs-rest AUC, largest row-sum deviation."""
    counts = multiclass_confusion(df, label, probs, classes)
    per = per_class_metrics(counts, label)
    head = per.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    acc = counts.agg((F.sum(F.when(F.col(label) == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    total = sum((F.col(p) for p in probs[1:]), F.col(probs[0]))
    own = F.coalesce(*[F.when(F.col(label) == c, F.col(p)) for c, p in zip(classes, probs)]) / total
    loss = df.agg(F.avg(-F.log(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), own)))).alias("log_loss"), F.max(F.abs(total - 1)).alias("row_sum_deviation"))
    each = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (F.col(p) / total).alias("s")) for c, p in zip(classes, probs)])).alias("x")).select((F.col(label) == F.col("x.class")).cast("int").alias("y"), F.col("x.class").alias("class"), F.col("x.s").alias("s"))
    auc = roc_auc(each, "y", "s", ("class",)).agg(F.avg("auc").alias("macro_auc"))
    return acc.crossJoin(head).crossJoin(loss).crossJoin(auc)
