"""Cleaning, splits, shards, preprocessing and audits over the flow table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnsift.functions import clean as C
from tarnsift.operators import audit as A
from tarnsift.operators import fusion
from tarnsift.operators import prep as M
from tarnsift.operators import split as P
from tarnsift.operators.primitives import bucketed_rank, membership_flag, score_counts
from tarnsift.plans.inputs import FEATURES, FLOWS, ID_SUM, flows, id_sum, table, unit
from tarnsift.plans.registry import Registry
from tarnsift.sources import tables as S
from tarnsift.sources.shared import stored

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

H = unit("row_id")
SPLIT = f"""{FLOWS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY {H}, row_id) AS k, count(*) OVER (PARTITION BY family) AS n FROM flows
), s AS (SELECT *, CASE WHEN k <= round(n * 0.7) THEN 'train' WHEN k <= round(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


def split_flows(spark, d):
    return P.stratified_split(flows(spark, d), "family", ["row_id"])


def r6(c):
    return F.round(c, 6)


@query("split_audit", f"""WITH {SPLIT}, per AS (SELECT split, q, d, t, count(*) AS n, sum(label) AS pos FROM s GROUP BY ALL),
 sh AS (SELECT *, count(*) OVER (PARTITION BY q, d, t) AS parts FROM per)
SELECT split, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(CASE WHEN parts > 1 THEN n ELSE 0 END) AS BIGINT) AS overlap_rows,
 CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, sum(CASE WHEN parts > 1 THEN n ELSE 0 END) = 0 AS is_disjoint FROM sh GROUP BY split""")
def split_audit(spark, d):
    return A.split_audit(split_flows(spark, d), FEATURES)


@query("stratified_split", f"WITH {SPLIT} SELECT family, split, count(*) AS n, {ID_SUM} AS ids FROM s GROUP BY ALL")
def stratified_split(spark, d):
    return split_flows(spark, d).groupBy("family", "split").agg(F.count("*").alias("n"), id_sum().alias("ids"))


@query("hash_split", f"WITH {FLOWS}, s AS (SELECT *, {H} AS h FROM flows) SELECT CASE WHEN h < 0.7 THEN 'train' WHEN h < 0.85 THEN 'val' ELSE 'test' END AS split, count(*) AS n, {ID_SUM} AS ids FROM s GROUP BY 1")
def hash_split(spark, d):
    return P.hash_split(flows(spark, d), ["row_id"]).groupBy("split").agg(F.count("*").alias("n"), id_sum().alias("ids"))


@query("sample_toward", f"WITH {FLOWS}, n AS (SELECT count(*) AS n FROM flows) SELECT family, count(*) AS n, {ID_SUM} AS ids FROM flows WHERE {H} < 3000.0::DOUBLE / (SELECT n FROM n) GROUP BY 1")
def sample_toward(spark, d):
    return P.sample_toward(flows(spark, d), ["row_id"], 3000).groupBy("family").agg(F.count("*").alias("n"), id_sum().alias("ids"))


@query("sample_exact", f"WITH {FLOWS}, s AS (SELECT * FROM flows ORDER BY {H}, row_id LIMIT 3000) SELECT family, count(*) AS n, {ID_SUM} AS ids FROM s GROUP BY 1")
def sample_exact(spark, d):
    return P.sample_toward(flows(spark, d), ["row_id"], 3000, exact=True).groupBy("family").agg(F.count("*").alias("n"), id_sum().alias("ids"))


@query("anchor_sample", f"WITH {FLOWS} SELECT row_id, q, d, t FROM flows ORDER BY {H}, row_id LIMIT 64")
def anchor_sample(spark, d):
    return P.anchor_sample(flows(spark, d), ["row_id"], 64).select("row_id", *FEATURES)


GROUPS = f"""g AS (SELECT DISTINCT user_id FROM events), gr AS (SELECT user_id, row_number() OVER (ORDER BY {unit('user_id::VARCHAR')}, user_id) AS k, (SELECT count(*) FROM g) AS n FROM g),
 gs AS (SELECT e.*, CASE WHEN k <= round(n * 0.7) THEN 'train' WHEN k <= round(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM events e JOIN gr USING (user_id))"""


def group_events(spark, d):
    return P.group_split(table(spark, d, "events"), "user_id")


@query("group_split", f"WITH {GROUPS} SELECT split, count(*) AS n, count(DISTINCT user_id) AS groups, CAST(sum(user_id) AS BIGINT) AS ids FROM gs GROUP BY 1")
def group_split(spark, d):
    return group_events(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("groups"), F.sum("user_id").cast("long").alias("ids"))


@query("assert_disjoint", "SELECT CAST(0 AS BIGINT) AS train_val, CAST(0 AS BIGINT) AS train_test, CAST(0 AS BIGINT) AS val_test FROM (SELECT count(*) FROM events)")
def assert_disjoint(spark, d):
    return P.assert_disjoint(group_events(spark, d), "user_id")


CANDIDATES = [0.15, 0.2, 0.3, 0.5]


@query("class_complete_group_split", f"""WITH spec AS (SELECT f.f::DOUBLE AS fraction, CAST(s.s AS INTEGER) AS seed FROM (VALUES (0.15), (0.2), (0.3), (0.5)) f(f), range(1, 6) s(s)),
 c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
 bc AS (SELECT fraction, seed, event_type, sum(CASE WHEN ('0x' || substr(md5(user_id || '|' || seed), 1, 8))::BIGINT / 4294967296.0::DOUBLE < fraction THEN n ELSE 0 END) AS test, sum(n) AS n FROM c, spec GROUP BY ALL),
 sc AS (SELECT fraction, seed, CAST(sum(test) AS BIGINT) AS test_rows, avg(abs(test / n - fraction)) AS class_error, count(*) FILTER (test > 0 AND test < n) AS both_sides FROM bc GROUP BY ALL)
SELECT fraction, seed, test_rows, round(abs(test_rows / (SELECT count(*) FROM events) - fraction), 6) AS size_error, round(class_error, 6) AS class_error, both_sides = (SELECT count(DISTINCT event_type) FROM events) AS complete FROM sc""")
def class_complete_group_split(spark, d):
    found = P.class_complete_group_split(table(spark, d, "events"), "user_id", "event_type", CANDIDATES, [1, 2, 3, 4, 5])
    return found.select("fraction", "seed", "test_rows", r6("size_error").alias("size_error"), r6("class_error").alias("class_error"), "complete")


@query("split_status", "SELECT event_type, count(DISTINCT user_id) AS groups, CASE WHEN count(DISTINCT user_id) >= 3 THEN 'possible' ELSE 'impossible' END AS status FROM events GROUP BY 1")
def split_status(spark, d):
    return P.split_status(table(spark, d, "events"), "user_id", "event_type")


@query("qualified_families", f"WITH {FLOWS} SELECT family, count(*) AS n_rows FROM flows WHERE family <> 'BENIGN' GROUP BY 1 HAVING count(*) >= 100")
def qualified_families(spark, d):
    return P.qualified_families(flows(spark, d), "family", 100)


LOCO = f"""WITH g AS (SELECT DISTINCT user_id FROM events), gr AS (SELECT user_id, row_number() OVER (ORDER BY {unit('user_id::VARCHAR')}, user_id) AS k, (SELECT count(*) FROM g) AS n FROM g),
 p AS (SELECT e.*, CASE WHEN k <= round(n * 0.7) THEN 'train' WHEN k <= round(n * 0.85) THEN 'val' ELSE 'test' END AS part FROM events e JOIN gr USING (user_id)),
 f AS (SELECT DISTINCT event_type AS held_out FROM events WHERE event_type <> 'view'),
 r AS (SELECT held_out, user_id, event_type, CASE WHEN event_type = held_out THEN 'test' WHEN part = 'train' THEN 'train' WHEN part = 'val' THEN 'cal' WHEN event_type = 'view' THEN 'test' END AS role FROM p, f),
 k AS (SELECT * FROM r WHERE role IS NOT NULL)
SELECT held_out, role, role = 'test' AND EXISTS (SELECT 1 FROM k o WHERE o.held_out = k.held_out AND o.user_id = k.user_id AND o.role <> 'test') AS removed, count(*) AS n FROM k GROUP BY ALL"""


@query("leave_one_class_out", LOCO)
def leave_one_class_out(spark, d):
    e = table(spark, d, "events")
    families = [r[0] for r in P.qualified_families(e, "event_type", 1, benign="view").collect()]
    return P.leave_one_class_out(e, "event_type", "user_id", families, benign="view").groupBy("held_out", "role", "removed").agg(F.count("*").alias("n"))


@query("oversample_minority", f"""WITH {FLOWS}, b AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS g FROM flows), m AS (SELECT CASE WHEN p < g THEN 1 ELSE 0 END AS minor, greatest(p, g) AS most, least(p, g) AS least FROM b),
 k AS (SELECT f.*, row_number() OVER (PARTITION BY label ORDER BY {H}, row_id) AS r FROM flows f), c AS (SELECT k.*, CASE WHEN label = minor THEN most // least + CASE WHEN r <= most % least THEN 1 ELSE 0 END ELSE 1 END AS times FROM k, m)
SELECT label, CAST(sum(times) AS BIGINT) AS n, CAST(sum(('0x' || substr(md5(row_id), 1, 7))::BIGINT * times) AS BIGINT) AS ids FROM c GROUP BY 1""")
def oversample_minority(spark, d):
    return P.oversample_minority(flows(spark, d), "label", ["row_id"]).groupBy("label").agg(F.count("*").alias("n"), id_sum().alias("ids"))


@query("cap_per_class", f"WITH {FLOWS}, k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {H}, row_id) AS r FROM flows) SELECT family, count(*) AS n, {ID_SUM} AS ids FROM k WHERE r <= 2000 GROUP BY 1")
def cap_per_class(spark, d):
    return P.cap_per_class(flows(spark, d), "family", ["row_id"], 2000, 10).groupBy("family").agg(F.count("*").alias("n"), id_sum().alias("ids"))


@query("shard_balanced", f"""WITH {FLOWS}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}, row_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM flows), c AS (SELECT *, CAST(floor((r - 1) * 20 / n) AS INTEGER) AS client FROM k)
SELECT CAST(client // 10 AS INTEGER) AS rsu, CAST(client % 10 AS INTEGER) AS vehicle, count(*) AS n_rows, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg, {ID_SUM} AS ids FROM c GROUP BY ALL""")
def shard_balanced(spark, d):
    shards = P.shard_balanced(flows(spark, d), "label", ["row_id"], 2, 10)
    return shards.groupBy("rsu", "vehicle").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), id_sum().alias("ids"))


@query("shard_skewed")
def shard_skewed(spark, d):
    f = flows(spark, d)
    feature = P.skew_feature(f, FEATURES)
    return fusion.shard_stats(P.shard_skewed(f.select("row_id", "label", feature), "label", feature, ["row_id"], 2, 5), "rsu", "vehicle", "label")


@query("shard_stats", f"WITH {FLOWS} SELECT s_nationkey % 5 AS rsu, supp AS vehicle, count(*) AS n_rows, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg, round(count(*) FILTER (label = 1) / count(*), 6) AS share, count(*) FILTER (label = 1) = 0 OR count(*) FILTER (label = 0) = 0 AS one_class FROM flows JOIN supplier ON supp = s_suppkey GROUP BY ALL")
def shard_stats(spark, d):
    f = flows(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), (F.col("s_nationkey") % 5).alias("rsu")), "supp").withColumnRenamed("supp", "vehicle")
    return fusion.shard_stats(f, "rsu", "vehicle", "label").withColumn("share", r6("share"))


@query("shard_summary", f"WITH {FLOWS}, s AS (SELECT supp, count(*) AS n, count(*) FILTER (label = 1) / count(*) AS share FROM flows GROUP BY 1) SELECT count(*) AS shards, min(n) AS min_rows, max(n) AS max_rows, round(min(share), 6) AS min_share, round(max(share), 6) AS max_share, round(avg(share), 6) AS mean_share, count(*) FILTER (share IN (0, 1)) AS one_class_shards FROM s")
def shard_summary(spark, d):
    s = fusion.shard_summary(fusion.shard_stats(flows(spark, d).withColumn("rsu", F.lit(0)), "rsu", "supp", "label"))
    return s.withColumns({c: r6(c) for c in ("min_share", "max_share", "mean_share")})


@query("shard_shift", f"WITH {FLOWS}, w AS (SELECT avg(q) AS m, stddev_pop(q) AS s FROM flows) SELECT supp, count(*) AS n_rows, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS sd, min(q) AS lo, max(q) AS hi, round((avg(q) - any_value(m)) / any_value(s), 6) AS shift FROM flows, w GROUP BY 1")
def shard_shift(spark, d):
    return fusion.shard_shift(flows(spark, d), ["supp"], "q").withColumns({c: r6(c) for c in ("mean", "sd", "shift")})


# ---- scalar rules ------------------------------------------------------------------------------------------------------


@query("inf_to_null", f"WITH {FLOWS}, x AS (SELECT family, CASE WHEN t = 0 THEN NULL ELSE q / t END AS v FROM flows) SELECT family, count(*) AS n, count(v) AS finite, round(avg(v), 6) AS mean FROM x GROUP BY 1")
def inf_to_null(spark, d):
    v = F.when(F.col("t") == 0, F.when(F.col("q") > 25, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(F.col("q") / F.col("t"))
    return C.inf_to_null(flows(spark, d).withColumn("v", v), ["v"]).groupBy("family").agg(F.count("*").alias("n"), F.count("v").alias("finite"), r6(F.avg("v")).alias("mean"))


@query("binarize_label", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label FROM events) GROUP BY 1")
def binarize_label(spark, d):
    e = table(spark, d, "events").withColumn("name", F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" ")))
    return C.binarize_label(e, "name", "VIEW").groupBy("label").agg(F.count("*").alias("n"))


@query("normalize_text", "SELECT p_type AS raw, upper(trim(regexp_replace(' ' || p_type || '  x', '\\s+', ' ', 'g'))) AS clean, count(*) AS n FROM part GROUP BY ALL")
def normalize_text(spark, d):
    p = table(spark, d, "part").withColumn("clean", F.concat(F.lit(" "), F.col("p_type"), F.lit("  x")))
    return C.normalize_text(p, ["clean"], upper=True).groupBy(F.col("p_type").alias("raw"), "clean").agg(F.count("*").alias("n"))


@query("domain_check", f"WITH {FLOWS} SELECT * FROM (SELECT 'quantity' AS rule, count(*) AS n_rows, count(*) FILTER (NOT coalesce(q BETWEEN 1 AND 40, FALSE)) AS violations FROM flows UNION ALL SELECT 'discount', count(*), count(*) FILTER (NOT coalesce(d < 0.1, FALSE)) FROM flows UNION ALL SELECT 'family', count(*), count(*) FILTER (family NOT IN ('BENIGN', 'A-F')) FROM flows)")
def domain_check(spark, d):
    return C.domain_check(flows(spark, d), {"quantity": F.col("q").between(1, 40), "discount": F.col("d") < 0.1, "family": F.col("family").isin("BENIGN", "A-F")})


@query("parse_event_time", "SELECT count(*) AS n, count(*) FILTER (event_id % 10 <> 0) AS parsed, CAST(sum(CASE WHEN event_id % 10 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END) AS BIGINT) AS seconds FROM events")
def parse_event_time(spark, d):
    text = F.when(F.col("event_id") % 10 == 0, "not a time").when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = C.parse_event_time(table(spark, d, "events").withColumn("text", text), "text", ["dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"], "parsed")
    return parsed.agg(F.count("*").alias("n"), F.count("parsed").alias("parsed"), F.sum(F.unix_timestamp("parsed")).alias("seconds"))


@query("clip_to_bounds", f"WITH {SPLIT}, b AS (SELECT min(price) AS lo, max(price) AS hi FROM s WHERE split = 'train') SELECT split, count(*) AS n, count(*) FILTER (price < lo OR price > hi) AS clipped, round(min(greatest(lo, least(hi, price))), 6) AS lo, round(max(greatest(lo, least(hi, price))), 6) AS hi FROM s, b GROUP BY 1")
def clip_to_bounds(spark, d):
    s = split_flows(spark, d).withColumn("raw", F.col("price"))
    bounds = C.fit_bounds(s.where("split = 'train'"), ["price"])
    return C.clip_to_bounds(s, bounds).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("raw") != F.col("price")).alias("clipped"), r6(F.min("price")).alias("lo"), r6(F.max("price")).alias("hi"))


@query("fingerprint", f"WITH {FLOWS}, k AS (SELECT count(*) AS n FROM (SELECT CASE WHEN okey % 7 = 0 THEN NULL ELSE q END AS q, d, t FROM flows) GROUP BY q, d, t) SELECT n AS copies, count(*) AS patterns FROM k GROUP BY 1")
def fingerprint(spark, d):
    holes = flows(spark, d).withColumn("q", F.when(F.col("okey") % 7 != 0, F.col("q")))
    per = C.fingerprint(holes, FEATURES).groupBy("feature_hash").agg(F.count("*").alias("copies"))
    return per.groupBy("copies").agg(F.count("*").alias("patterns"))


@query("score_rules", f"WITH {FLOWS}, x AS (SELECT score, label, CASE WHEN okey % 11 = 0 THEN 0.0 WHEN okey % 11 = 1 THEN 1.0 ELSE score END AS c FROM flows) SELECT count(*) AS n, round(sum(c), 4) AS total, CAST(sum(CAST(round_even(c * 1000, 0) AS BIGINT)) AS BIGINT) AS quantized, CAST(sum(CASE WHEN c >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS at_half, CAST(sum(CASE WHEN c >= 0.9 OR score >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS hybrid FROM x")
def score_rules(spark, d):
    raw = F.when(F.col("okey") % 11 == 0, F.lit(float("nan"))).when(F.col("okey") % 11 == 1, F.lit(float("inf"))).otherwise(F.col("score"))
    x = C.quantize_scores(C.clean_scores(flows(spark, d).withColumn("c", raw), "c"), "c", 1000)
    x = C.hybrid_flag(C.predict_at(x, "c", 0.5, "p"), "c", "score", 0.9, 0.8, "h")
    return x.agg(F.count("*").alias("n"), F.round(F.sum("c"), 4).alias("total"), F.sum("q").alias("quantized"), F.sum("p").alias("at_half"), F.sum("h").alias("hybrid"))


@query("metrics_to_micros", "SELECT l_linenumber, CAST(sum(trunc(CAST(l_tax AS DECIMAL(30,12)) * 1000000)) AS BIGINT) AS tax, CAST(sum(trunc(CAST(-l_discount AS DECIMAL(30,12)) * 1000000)) AS BIGINT) AS less FROM lineitem GROUP BY 1")
def metrics_to_micros(spark, d):
    x = C.metrics_to_micros(table(spark, d, "lineitem").select("l_linenumber", F.col("l_tax").alias("tax"), (-F.col("l_discount")).alias("less")), ["tax", "less"])
    return x.groupBy("l_linenumber").agg(F.sum("tax").alias("tax"), F.sum("less").alias("less"))


@query("canonical_decimal", f"""SELECT DISTINCT CAST(l_tax AS VARCHAR) AS raw, CASE WHEN l_tax = 0 THEN '0' ELSE CAST(l_tax AS VARCHAR) END AS plain FROM lineitem
 UNION SELECT '00' || l_orderkey || '.' || repeat('0', 20) || l_linenumber || '000', l_orderkey || '.' || repeat('0', 20) || l_linenumber FROM lineitem
 UNION SELECT l_orderkey || 'e-25', CASE WHEN l_orderkey = 0 THEN '0' ELSE '0.' || rtrim(lpad(l_orderkey::VARCHAR, 25, '0'), '0') END FROM lineitem UNION SELECT l_orderkey || '.5E+30', CASE WHEN l_orderkey = 0 THEN '' ELSE l_orderkey::VARCHAR END || '5' || repeat('0', 29) FROM lineitem""")
def canonical_decimal(spark, d):
    """Numbers of few and of many digits; the taxes are given two more zeros."""
    x = table(spark, d, "lineitem")
    key, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    tax = x.select(F.col("l_tax").cast("string").alias("raw")).distinct().select("raw", C.canonical_decimal(F.concat("raw", F.lit("00"))).alias("plain"))
    # texts differ as their keys do, so the keys are made distinct, not the texts
    lines = x.select("l_orderkey", "l_linenumber").distinct().select(F.concat(F.lit("00"), key, F.lit("." + "0" * 20), line, F.lit("000")).alias("raw"))
    powers = x.select("l_orderkey").distinct().select(F.explode(F.array(F.concat(key, F.lit("e-25")), F.concat(key, F.lit(".5E+30")))).alias("raw"))
    long = lines.unionByName(powers).select("raw", C.canonical_decimal(F.col("raw")).alias("plain"))
    none = x.where("l_orderkey is null or l_linenumber is null or l_tax is null").limit(1).select(F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("plain"))
    return tax.unionByName(long).where("raw is not null").unionByName(none)


@query("sha256_shape", "SELECT count(*) AS n, count(*) FILTER (doc_id % 3 <> 0) AS good FROM documents")
def sha256_shape(spark, d):
    x = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.md5("text")).otherwise(F.concat(F.lit(" "), F.upper(F.sha2("text", 256)))).alias("h"))
    return x.agg(F.count("*").alias("n"), F.count_if(C.is_sha256_hex(F.col("h"))).alias("good"))


@query("dp_epsilon_used", "SELECT l_linenumber, round(sum(CASE WHEN l_tax > 0 AND l_discount > 0 THEN l_linenumber * ln(1 + l_discount * (exp(l_tax) - 1)) ELSE 0 END), 5) AS epsilon FROM lineitem GROUP BY 1")
def dp_epsilon_used(spark, d):
    x = table(spark, d, "lineitem")
    return x.groupBy("l_linenumber").agg(F.round(F.sum(C.dp_epsilon_used(F.col("l_linenumber"), F.col("l_tax"), F.col("l_discount"))), 5).alias("epsilon"))


@query("availability_flag", """WITH c AS (SELECT DISTINCT s_suppkey AS client, CAST(r AS INTEGER) AS round FROM supplier, range(1, 9) t(r))
SELECT CASE WHEN client % 17 = 0 AND round >= 3 THEN 'persistent_dropout' WHEN client % 5 = 0 AND round BETWEEN 4 AND 6 THEN 'burst_outage' WHEN client % 7 = 0 AND round = 2 THEN 'isolated_outage' ELSE 'available' END AS state, round, count(*) AS n FROM c GROUP BY ALL""")
def availability_flag(spark, d):
    clients = table(spark, d, "supplier").select(F.col("s_suppkey").alias("client"))
    kinds = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("kind"), F.lit(a).alias("first_round"), F.lit(b).alias("last_round")) for m, k, a, b in ((17, "persistent", 3, 99), (5, "burst", 4, 6), (7, "isolated", 2, 2))])
    schedule = clients.select("client", F.explode(kinds).alias("k")).where(F.col("client") % F.col("k.m") == 0).select("client", "k.kind", "k.first_round", "k.last_round")
    rounds = clients.select("client", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("round"))
    return C.availability_flag(rounds, schedule).groupBy("state", "round").agg(F.count("*").alias("n"))


# ---- preprocessing -----------------------------------------------------------------------------------------------------

HOLES = f"""{SPLIT}, x AS (SELECT split, label, family, row_id, CASE WHEN okey % 7 <> 0 THEN q END AS q, CASE WHEN okey % 7 <> 0 THEN price END AS price FROM s)"""


def holes(spark, d):
    return split_flows(spark, d).withColumns({c: F.when(F.col("okey") % 7 != 0, F.col(c)) for c in ("q", "price")})


@query("fit_imputer", f"WITH {HOLES} SELECT 'q' AS \"column\", round(quantile_cont(q, 0.5), 6) AS median FROM x WHERE split = 'train' UNION ALL SELECT 'price', round(quantile_cont(price, 0.5), 6) FROM x WHERE split = 'train'")
def fit_imputer(spark, d):
    return M.fit_imputer(holes(spark, d).where("split = 'train'"), ["q", "price"]).select("column", r6(F.col("value").cast("double")).alias("median"))


@query("transform", f"""WITH {HOLES}, m AS (SELECT quantile_cont(q, 0.5) AS mq, quantile_cont(price, 0.5) AS mp FROM x WHERE split = 'train'), i AS (SELECT split, family, coalesce(q, mq) AS q, coalesce(price, mp) AS price FROM x, m),
 f AS (SELECT avg(q) AS aq, stddev_pop(q) AS sq, avg(price) AS ap, stddev_pop(price) AS sp FROM i WHERE split = 'train')
SELECT split, count(*) AS n, round(sum((q - aq) / sq), 2) AS q, round(sum((price - ap) / sp), 2) AS price, CAST(sum(CASE WHEN family = 'A-F' THEN 1 ELSE 0 END) AS BIGINT) AS af, CAST(sum(CASE WHEN family = 'BENIGN' THEN 1 ELSE 0 END) AS BIGINT) AS benign FROM i, f GROUP BY 1""")
def transform(spark, d):
    x = stored(holes(spark, d).select("split", "family", "q", "price"), "split")
    model = M.fit(x.where("split = 'train'"), ["q", "price"], ["family"])
    out = M.transform(x, model, ["split"]).withColumnRenamed("family=A-F", "af").withColumnRenamed("family=BENIGN", "benign")
    return out.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("q"), 2).alias("q"), F.round(F.sum("price"), 2).alias("price"), F.sum("af").alias("af"), F.sum("benign").alias("benign"))


@query("fit_categories", "WITH c AS (SELECT 'p_brand' AS \"column\", p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2) SELECT \"column\", 'category' AS kind, value FROM c UNION ALL SELECT \"column\", 'most_frequent', arg_min(value, (-n, value)) FROM c GROUP BY 1")
def fit_categories(spark, d):
    return M.fit_categories(table(spark, d, "part"), ["p_brand", "p_type"])


@query("class_weight", f"WITH {SPLIT} SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg, round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 6) AS weight, round(count(*) FILTER (label = 1) / count(*), 6) AS base_rate FROM s WHERE split = 'train'")
def class_weight(spark, d):
    return M.class_weight(split_flows(spark, d).where("split = 'train'"), "label").withColumn("weight", r6("weight")).withColumn("base_rate", r6("base_rate"))


@query("prep_manifest", f"WITH {SPLIT} SELECT split, count(*) AS n_rows, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, 3 AS n_features, (SELECT count(*) FROM lineitem) AS source_rows, 42 AS seed FROM s GROUP BY 1")
def prep_manifest(spark, d):
    return S.prep_manifest(split_flows(spark, d), "label", features=3, sampling={"source_rows": flows(spark, d).count(), "seed": 42})


@query("verify_saved", f"WITH {SPLIT} SELECT split, count(*) AS n_rows, CAST(0 AS BIGINT) AS non_finite, CAST(0 AS BIGINT) AS bad_labels, FALSE AS unbalanced FROM s GROUP BY 1")
def verify_saved(spark, d):
    return S.verify_saved(split_flows(spark, d), "label", FEATURES, splits=("train", "val", "test"))


# ---- audits and joins --------------------------------------------------------------------------------------------------


@query("class_distribution", f"WITH {FLOWS} SELECT family, count(*) AS n, round(count(*) / (SELECT count(*) FROM flows), 6) AS share FROM flows GROUP BY 1")
def class_distribution(spark, d):
    return A.class_distribution(flows(spark, d), "family").withColumn("share", r6("share"))


@query("duplicate_stats", f"WITH {SPLIT}, k AS (SELECT split, count(*) AS n FROM s GROUP BY split, q, d, t) SELECT split, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, round((sum(n) - count(*)) / sum(n), 6) AS duplicate_share FROM k GROUP BY 1")
def duplicate_stats(spark, d):
    return A.duplicate_stats(split_flows(spark, d), FEATURES, "split").withColumn("duplicate_share", r6("duplicate_share"))


KEYED = f"{SPLIT}, k AS (SELECT *, concat_ws('|', CAST(round(q) AS BIGINT), CAST(round(d * 100) AS BIGINT), CAST(round(t * 100) AS BIGINT)) AS key FROM s)"


def keyed(spark, d):
    return split_flows(spark, d).withColumn("key", F.concat_ws("|", F.round("q").cast("long"), F.round(F.col("d") * 100).cast("long"), F.round(F.col("t") * 100).cast("long")))


@query("overlap_rows", f"WITH {KEYED}, tr AS (SELECT DISTINCT key FROM k WHERE split = 'train') SELECT label, count(*) AS n_rows, count(*) FILTER (key IN (SELECT key FROM tr)) AS overlapping, round(count(*) FILTER (key IN (SELECT key FROM tr)) / count(*), 6) AS share FROM k WHERE split = 'test' GROUP BY 1")
def overlap_rows(spark, d):
    k = keyed(spark, d)
    return A.overlap_rows(k.where("split = 'test'"), k.where("split = 'train'"), "key", "label").withColumn("share", r6("share"))


@query("remove_overlap", f"WITH {KEYED} SELECT family, count(*) AS n, {ID_SUM} AS ids FROM k WHERE split = 'test' AND key NOT IN (SELECT key FROM k WHERE split = 'train') GROUP BY 1")
def remove_overlap(spark, d):
    k = keyed(spark, d)
    return A.remove_overlap(k.where("split = 'test'"), k.where("split = 'train'"), "key").groupBy("family").agg(F.count("*").alias("n"), id_sum().alias("ids"))


@query("key_intersections", f"WITH {KEYED}, h AS (SELECT key, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM k GROUP BY 1) SELECT count(*) FILTER (a AND b) AS train_val, count(*) FILTER (a AND c) AS train_test, count(*) FILTER (b AND c) AS val_test, count(*) FILTER (a AND b AND c) AS all_parts FROM h")
def key_intersections(spark, d):
    return A.key_intersections(keyed(spark, d), "key", "split", ["train", "val", "test"])


@query("membership_flag", "SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS seen, count(*) AS n FROM customer GROUP BY ALL")
def membership(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return membership_flag(table(spark, d, "customer"), o, "c_custkey").groupBy("c_mktsegment", "seen").agg(F.count("*").alias("n"))


@query("ambiguous_keys", f"WITH {FLOWS}, k AS (SELECT count(*) AS n, count(DISTINCT label) AS l FROM flows GROUP BY q, d, t) SELECT count(*) AS n_keys, count(*) FILTER (l > 1) AS ambiguous_keys, CAST(sum(CASE WHEN l > 1 THEN n ELSE 0 END) AS BIGINT) AS ambiguous_rows, round(sum(CASE WHEN l > 1 THEN n ELSE 0 END) / sum(n), 6) AS ambiguous_share FROM k")
def ambiguous_keys(spark, d):
    return A.ambiguous_keys(flows(spark, d), FEATURES, "label").withColumn("ambiguous_share", r6("ambiguous_share"))


@query("keys_per_family", f"WITH {FLOWS} SELECT family, count(*) AS n_keys FROM (SELECT DISTINCT family, q, d, t FROM flows) GROUP BY 1")
def keys_per_family(spark, d):
    return A.keys_per_family(flows(spark, d), FEATURES, "family")


@query("collapse_patterns", f"WITH {FLOWS} SELECT q, d, t, min(label) AS label, round(avg(score), 6) AS score, count(*) AS n FROM flows GROUP BY 1, 2, 3 HAVING count(DISTINCT label) = 1")
def collapse_patterns(spark, d):
    return A.collapse_patterns(flows(spark, d), FEATURES, "label", "score").withColumn("score", r6("score"))


@query("collapse_status", f"WITH {FLOWS}, k AS (SELECT count(*) AS n, count(DISTINCT label) AS l, min(label) AS y FROM flows GROUP BY q, d, t) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS patterns, count(*) FILTER (l = 1) AS unambiguous, round(count(*) FILTER (l = 1) / sum(n), 6) AS collapse_ratio, CASE WHEN count(*) FILTER (l = 1) = 0 THEN 'not_evaluable' WHEN count(DISTINCT y) FILTER (l = 1) < 2 THEN 'class_incomplete' ELSE 'evaluated' END AS status FROM k")
def collapse_status(spark, d):
    return A.collapse_status(flows(spark, d), FEATURES, "label").withColumn("collapse_ratio", r6("collapse_ratio"))


@query("bucketed_rank", f"WITH {FLOWS}, r AS (SELECT supp, row_number() OVER (ORDER BY ts, row_id) AS rank FROM flows) SELECT supp, CAST(sum(rank) AS BIGINT) AS ranks, min(rank) AS first_rank FROM r GROUP BY 1")
def rank_by_time(spark, d):
    return bucketed_rank(flows(spark, d).select("supp", "ts", "row_id"), ["ts", "row_id"]).groupBy("supp").agg(F.sum("rank").alias("ranks"), F.min("rank").alias("first_rank"))


@query("score_counts", f"WITH {FLOWS}, c AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM flows GROUP BY 1) SELECT round(score, 9) AS score, pos, neg, CAST(sum(pos) OVER (ORDER BY c.score) AS BIGINT) AS cum_pos, CAST(sum(neg) OVER (ORDER BY c.score) AS BIGINT) AS cum_neg FROM c")
def curve(spark, d):
    return score_counts(flows(spark, d), "label", "score").select(F.round("score", 9).alias("score"), "pos", "neg", "cum_pos", "cum_neg")


@query("union_all", "SELECT kind, count(*) AS n FROM (SELECT 'N' AS kind FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_returnflag FROM lineitem WHERE l_returnflag <> 'N') GROUP BY 1")
def union_all(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"))
    return li.where("kind = 'N'").unionByName(li.where("kind <> 'N'")).groupBy("kind").agg(F.count("*").alias("n"))


@query("except_keys", "SELECT count(*) AS n FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05)")
def except_keys(spark, d):
    used = table(spark, d, "lineitem").where("l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").distinct().join(used, "p_partkey", "left_anti").agg(F.count("*").alias("n"))
