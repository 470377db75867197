"""Cleaning, labelling and score rules: expressions inside whole-stage codegen, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")


def finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == INFINITY), None).otherwise(c)


def inf_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Infinite values and NaN become null, so that averages and quantiles pass them over."""
    return df.withColumns({c: finite_or_null(F.col(c).cast("double")) for c in cols})


def binarize_label(df: DataFrame, col: str, benign: str = "BENIGN", out: str = "label") -> DataFrame:
    """0 for the benign name (trimmed, any case), 1 for everything else and for null."""
    return df.withColumn(out, F.coalesce(F.when(F.upper(F.trim(col)) == benign.upper(), 0), F.lit(1)))


def normalize_text(df: DataFrame, cols: list[str], upper: bool = False) -> DataFrame:
    """Trimmed, runs of white space as one space."""
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return df.withColumns({c: F.upper(one(F.col(c))) if upper else one(F.col(c)) for c in cols})


def drop_identifiers(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def select_numeric_features(train: DataFrame, val: DataFrame, test: DataFrame, label: str) -> list[str]:
    """Columns numeric in all three parts, in the order of train. Raises if none is left or labels aren't 0/1."""
    shared = [c for c, kind in train.dtypes if c != label and is_numeric(kind) and all(is_numeric(dict(p.dtypes).get(c, "")) for p in (val, test))]
    if not shared:
        raise ValueError("no shared numeric feature")
    for part in (train, val, test):
        if part.where(F.col(label).isNull() | ~F.col(label).isin(0, 1)).limit(1).count():
            raise ValueError(f"{label} has values other than 0 and 1")
    return shared


def domain_check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n_rows, violations: rows for which a rule is false or null, all rules in one pass."""
    counted = df.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counted.unpivot("n_rows", list(rules), "rule", "violations").select("rule", "n_rows", "violations")


def parse_event_time(df: DataFrame, col: str, formats: list[str], out: str = "ts") -> DataFrame:
    """Day-first parse by the first format that fits; null where none does."""
    return df.withColumn(out, F.coalesce(*[F.try_to_timestamp(F.trim(F.col(col)), F.lit(f)) for f in formats]))


def fit_bounds(train: DataFrame, cols: list[str]) -> DataFrame:
    """column, lo, hi over the training rows."""
    ends = train.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__lo").alias("lo"), F.col(f"{c}__hi").alias("hi")) for c in cols])).alias("b")).select("b.*")


def clip_to_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Clamps the columns that bounds (a row for each column) names; null stays null."""
    rows = bounds.collect()
    return df.withColumns({r["column"]: F.when(F.col(r["column"]).isNotNull(), F.greatest(F.lit(r["lo"]), F.least(F.lit(r["hi"]), F.col(r["column"]).cast("double")))) for r in rows})


def fingerprint(df: DataFrame, cols: list[str], out: str = "feature_hash") -> DataFrame:
    """64-bit hash of a tuple in which nulls count by place: (null, 1) and (1, null) differ."""
    return df.withColumn(out, F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))]))


def clean_score(c: Column) -> Column:
    """NaN and null 0, infinities at the ends, clamped to [0, 1]. NaN is tested first: least(1, NaN) is 1."""
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def clean_scores(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, clean_score(F.col(col).cast("double")))


def quantize(c: Column, scale: int = 100_000) -> Column:
    """Clamped, scaled, rounded half to even."""
    return F.rint(clean_score(c) * scale).cast("long")


def quantize_scores(df: DataFrame, col: str, scale: int = 100_000, out: str = "q") -> DataFrame:
    return df.withColumn(out, quantize(F.col(col).cast("double"), scale))


def predict_at(df: DataFrame, score: str, threshold, out: str = "pred") -> DataFrame:
    """threshold: a number, or a column's name for thresholds that vary by row."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    return df.withColumn(out, (F.col(score) >= t).cast("int"))


def hybrid_flag(df: DataFrame, supervised: str, novelty: str, thr_s: float, thr_n: float, out: str = "pred") -> DataFrame:
    return df.withColumn(out, ((F.col(supervised) >= thr_s) | (F.col(novelty) >= thr_n)).cast("int"))


def metrics_to_micros(df: DataFrame, cols: list[str], scale: int = 1_000_000) -> DataFrame:
    """Scaled and truncated towards zero; NaN, infinite and null give 0."""
    exact = lambda c: (finite_or_null(F.col(c).cast("double")).cast("decimal(30,12)") * F.lit(scale).cast("decimal(8,0)")).cast("decimal(38,12)")
    return df.withColumns({c: F.coalesce(F.when(exact(c) < 0, F.ceil(exact(c))).otherwise(F.floor(exact(c))).cast("long"), F.lit(0).cast("long")) for c in cols})


def canonical_decimal(c: Column) -> Column:
    """Non-negative decimal text without exponent, leading or trailing zeros, of any number of digits: the point is moved in the
    text. Blank text gives 0; null, and what isn't such a number or has an exponent of more than nine digits, null."""
    text = F.trim(c)
    number = r"^\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,9})?$"
    # one match decides; the parts of what matches are cut out without a pattern, and each is named once, as a lambda's variable
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    text_e = F.translate(text, "E", "e")
    mantissa, power = F.ltrim(F.substring_index(text_e, "e", 1), F.lit("+")), F.when(F.contains(text_e, F.lit("e")), F.substring_index(text_e, "e", -1))
    point = F.length(F.substring_index(mantissa, ".", 1)) + F.coalesce(power.try_cast("int"), F.lit(0))
    parts = F.struct(F.replace(mantissa, F.lit("."), F.lit("")).alias("digits"), point.alias("point"))

    def moved(p: Column) -> Column:
        digits, point, size = p["digits"], p["point"], F.length(p["digits"])
        left = F.when(point <= 0, "").when(point >= size, F.rpad(digits, point, "0")).otherwise(F.substring(digits, F.lit(1), point))
        right = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).when(point >= size, "").otherwise(F.substring(digits, point + 1, size))
        return F.struct(F.ltrim(left, F.lit("0")).alias("left"), F.rtrim(right, F.lit("0")).alias("right"))

    plain = lambda s: F.concat(F.when(s["left"] == "", "0").otherwise(s["left"]), F.when(s["right"] == "", "").otherwise(F.concat(F.lit("."), s["right"])))
    zero = lambda p: F.ltrim(p["digits"], F.lit("0")) == ""  # noqa: E731  # whatever its exponent
    return F.when(text == "", "0").when(text.rlike(number), let(parts, lambda p: F.when(zero(p), "0").otherwise(let(moved(p), plain))))


def is_sha256_hex(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def dp_epsilon_used(n_trees: Column, epsilon: Column, gamma: Column) -> Column:
    """n * ln(1 + gamma * (e^epsilon - 1)); 0 when any of them isn't positive."""
    positive = (n_trees > 0) & (epsilon > 0) & (gamma > 0)
    return F.when(positive, n_trees * F.log1p(gamma * F.expm1(epsilon))).otherwise(0.0)


def availability_flag(client_rounds: DataFrame, schedule: DataFrame) -> DataFrame:
    """client, round, state: persistent dropout, burst, isolated outage in this order, else available.

    schedule: client, kind ('persistent', 'burst', 'isolated'), first_round, last_round.
    """
    named = {"persistent": "persistent_dropout", "burst": "burst_outage", "isolated": "isolated_outage"}
    s = schedule.select(F.col("client").alias("s_client"), "kind", "first_round", "last_round")
    hit = client_rounds.join(s, (F.col("client") == F.col("s_client")) & F.col("round").between(F.col("first_round"), F.col("last_round")), "left")
    flags = hit.groupBy("client", "round").agg(*[F.bool_or(F.coalesce(F.col("kind") == k, F.lit(False))).alias(k) for k in named])
    state = F.when(F.col("persistent"), named["persistent"]).when(F.col("burst"), named["burst"]).when(F.col("isolated"), named["isolated"]).otherwise("available")
    return flags.select("client", "round", state.alias("state"))
