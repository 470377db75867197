"""Score fusion, client updates, ledgers, participation and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnsift.operators import fusion as U
from tarnsift.operators import stats as Z
from tarnsift.operators.metrics import best_f1_exact, binary_metrics, confusion
from tarnsift.plans.data_queries import r6
from tarnsift.plans.evaluation_queries import CONF, METRICS, rounded
from tarnsift.plans.inputs import FLOWS, SCORES, UPDATES, flows, scores, table, updates
from tarnsift.plans.registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("align_scores", f"WITH {FLOWS}, {SCORES} SELECT models, complete, count(*) AS n, round(sum(s), 4) AS total FROM (SELECT row_id, CAST(count(*) AS INTEGER) AS models, count(*) = 3 AS complete, arg_min(score, model_id) AS s FROM scores GROUP BY 1) GROUP BY ALL")
def align_scores(spark, d):
    return U.align_scores(scores(spark, d), 3).groupBy("models", "complete").agg(F.count("*").alias("n"), F.round(F.sum(F.col("scores")[0]), 4).alias("total"))


def gate(spark):
    return spark.createDataFrame([(1, True, True), (2, False, True), (3, True, False)], "model_id int, passed boolean, rsu_passed boolean")


@query("clipped_mean", f"WITH {FLOWS}, {SCORES} SELECT label, count(*) AS n, round(sum(f), 4) AS total FROM (SELECT row_id, label, avg(least(0.9::DOUBLE, greatest(0.1::DOUBLE, score))) AS f FROM scores GROUP BY ALL) GROUP BY 1")
def clipped_mean(spark, d):
    f = U.clipped_mean(scores(spark, d), 0.1, 0.9).join(flows(spark, d).select("row_id", "label"), "row_id")
    return f.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("fused"), 4).alias("total"))


@query("gate_models", f"WITH {FLOWS}, {SCORES} SELECT model_id, count(*) AS n FROM scores WHERE model_id IN (1, 3) GROUP BY 1")
def gate_models(spark, d):
    return U.gate_models(scores(spark, d), gate(spark)).groupBy("model_id").agg(F.count("*").alias("n"))


@query("gated_ensemble", f"WITH {FLOWS}, {SCORES}, f AS (SELECT row_id, label, avg(score) AS fused FROM scores WHERE model_id IN (1, 2) GROUP BY ALL), c AS (SELECT {CONF} FROM (SELECT label, CASE WHEN fused >= 0.5 THEN 1 ELSE 0 END AS pred FROM f)) SELECT *, {METRICS} FROM c")
def gated_ensemble(spark, d):
    s = scores(spark, d)
    fused = U.clipped_mean(U.gate_models(s, gate(spark), global_pass=False)).join(s.where("model_id = 1").select("row_id", "label"), "row_id")
    return rounded(binary_metrics(confusion(fused.withColumn("pred", (F.col("fused") >= 0.5).cast("int")), "label", "pred")))


@query("best_single", f"WITH {FLOWS}, {SCORES}, c AS (SELECT model_id, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scores GROUP BY ALL), w AS (SELECT model_id, sum(p) OVER x AS tp, sum(n) OVER x AS fp, sum(p) OVER (PARTITION BY model_id) AS pp FROM c WINDOW x AS (PARTITION BY model_id ORDER BY score DESC)) SELECT model_id, round(max(round(2.0::DOUBLE * tp / (tp + fp + pp), 12)), 6) AS f1 FROM w GROUP BY 1 ORDER BY max(round(2.0::DOUBLE * tp / (tp + fp + pp), 12)) DESC, model_id LIMIT 1")
def best_single(spark, d):
    return U.best_single(best_f1_exact(scores(spark, d), "label", "score", ("model_id",))).withColumn("f1", r6("f1"))


@query("weighted_average", f"WITH {UPDATES} SELECT rsu_id, round, round(sum(best * num_examples) / sum(num_examples), 6) AS best, round(sum(trees * num_examples) / sum(num_examples), 6) AS trees FROM updates GROUP BY ALL")
def weighted_average(spark, d):
    return rounded(U.weighted_average(updates(spark, d), ("rsu_id", "round"), ["best", "trees"], "num_examples"), ("best", "trees"))


ROLLUP = f"""{UPDATES}, r AS (SELECT rsu_id, round, count(DISTINCT vehicle_id) AS clients, CAST(sum(num_examples) AS BIGINT) AS examples, CAST(sum(upload_bytes) AS BIGINT) AS upload, CAST(sum(download_bytes) AS BIGINT) AS download, CAST(sum(train_seconds) AS BIGINT) AS train_seconds FROM updates GROUP BY ALL)"""


@query("round_rollup", f"WITH {ROLLUP} SELECT *, round((upload + download) / clients, 6) AS bytes_per_client, round((upload + download) / examples, 6) AS bytes_per_example FROM r")
def round_rollup(spark, d):
    return rounded(U.round_rollup(updates(spark, d)), ("bytes_per_client", "bytes_per_example"))


@query("run_overhead", f"WITH {ROLLUP} SELECT rsu_id, count(*) AS rounds, CAST(sum(upload) AS BIGINT) AS upload, CAST(sum(download) AS BIGINT) AS download, CAST(sum(train_seconds) AS BIGINT) AS train_seconds FROM r GROUP BY 1")
def run_overhead(spark, d):
    return U.run_overhead(U.round_rollup(updates(spark, d)))


_MEASURED = {"local_train": "train_seconds", "rsu_model_aggregation": "trees", "dp_record": "epsilon_u", "rsu_preselect": "num_examples", "rsu_ssi_verification": "trees", "rsu_merkle_build": "num_examples", "rsu_zkp": "best", "export_index_write": "trees"}


@query("overhead_layers", f"""WITH {UPDATES}, m AS (SELECT rsu_id, unnest({list(_MEASURED)}) AS component, unnest([{', '.join(f'{c}::DOUBLE' for c in _MEASURED.values())}]) AS seconds FROM updates),
 l AS (SELECT rsu_id, CASE {' '.join(f"WHEN component = '{c}' THEN '{U.LAYERS[c]}'" for c in _MEASURED)} END AS layer, sum(seconds) AS seconds FROM m GROUP BY ALL) SELECT rsu_id, layer, round(seconds, 6) AS seconds, round(seconds / sum(seconds) OVER (PARTITION BY rsu_id), 6) AS share FROM l""")
def overhead_layers(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(x).cast("double").alias("seconds")) for c, x in _MEASURED.items()]))
    measured = updates(spark, d).select("rsu_id", each.alias("e")).select("rsu_id", "e.*")
    return rounded(U.overhead_layers(measured, ("rsu_id",)), ("seconds", "share"))


LEDGER = f"{UPDATES}, l AS (SELECT *, CAST(sum(epsilon_u) OVER (PARTITION BY rsu_id, vehicle_id ORDER BY round) AS BIGINT) AS cumulative_u FROM updates)"


@query("dp_ledger", f"WITH {LEDGER} SELECT rsu_id, vehicle_id, round, epsilon_u, cumulative_u + vehicle_id AS cumulative_u FROM l")
def dp_ledger(spark, d):
    u = updates(spark, d).select("rsu_id", "vehicle_id", "round", "epsilon_u")
    return U.dp_ledger(u, u.select("rsu_id", "vehicle_id", F.col("vehicle_id").alias("cumulative_u")).distinct())


@query("dp_round_stats", f"WITH {LEDGER} SELECT rsu_id, round, min(epsilon_u) AS epsilon_u_min, round(avg(epsilon_u), 6) AS epsilon_u_mean, max(epsilon_u) AS epsilon_u_max, min(cumulative_u) AS cumulative_u_min, round(avg(cumulative_u), 6) AS cumulative_u_mean, max(cumulative_u) AS cumulative_u_max FROM l GROUP BY ALL")
def dp_round_stats(spark, d):
    return rounded(U.dp_round_stats(U.dp_ledger(updates(spark, d))), ("epsilon_u_mean", "cumulative_u_mean"))


@query("admit_top", f"WITH {UPDATES}, e AS (SELECT rsu_id, round, vehicle_id, CAST(row_number() OVER (PARTITION BY rsu_id, round ORDER BY vehicle_id) AS INTEGER) AS place FROM updates WHERE num_examples > 3) SELECT rsu_id, round, vehicle_id, place, place <= 8 AS admitted FROM e")
def admit_top(spark, d):
    u = updates(spark, d).withColumn("did", F.sha2(F.col("vehicle_id").cast("string"), 256)).withColumn("client_id", F.col("vehicle_id").cast("string")).withColumn("eligible", F.col("num_examples") > 3)
    return U.admit_top(u, 8).select("rsu_id", "round", "vehicle_id", "place", "admitted")


@query("model_growth", f"WITH {UPDATES}, r AS (SELECT rsu_id, round, CAST(sum(trees) AS BIGINT) AS trees FROM updates GROUP BY ALL) SELECT *, trees - coalesce(lag(trees) OVER (PARTITION BY rsu_id ORDER BY round), 0) AS added FROM r")
def model_growth(spark, d):
    return U.model_growth(updates(spark, d).groupBy("rsu_id", "round").agg(F.sum("trees").alias("trees")))


@query("append_deltas", f"WITH {UPDATES}, b AS (SELECT vehicle_id AS model_id, round AS seq, trees, sum(trees) OVER (PARTITION BY vehicle_id ORDER BY round) - trees AS base FROM updates) SELECT model_id, seq, CAST(i AS INTEGER) AS \"offset\", CAST(base + i AS BIGINT) AS tree_id FROM b, LATERAL (SELECT unnest(range(trees)) AS i)")
def append_deltas(spark, d):
    return U.append_deltas(updates(spark, d).select(F.col("vehicle_id").alias("model_id"), F.col("round").alias("seq"), F.col("trees").alias("n_trees")))


@query("anchor_sum", "WITH q AS (SELECT label AS rsu, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), s AS (SELECT rsu, i, sum(CAST(round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, x::DOUBLE)) * 100000, 0) AS BIGINT)) AS v, count(*) AS n FROM q GROUP BY ALL) SELECT rsu, max(n) AS vectors, CAST(sum(v * i) AS BIGINT) AS weighted, CAST(max(v) AS BIGINT) AS greatest_sum FROM s GROUP BY 1")
def anchor_sum(spark, d):
    e = U.quantized_anchors(table(spark, d, "embeddings").withColumnRenamed("label", "rsu"), "embedding")
    total = U.anchor_sum(e, ("rsu",), "embedding", 64)
    return total.select("rsu", "vectors", F.aggregate(F.transform("total", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("weighted"), F.array_max("total").alias("greatest_sum"))


@query("participation", f"WITH {UPDATES} SELECT CAST(coalesce(rsu_id, -1) AS INTEGER) AS rsu_id, coalesce(round, -1) AS round, count(*) AS expected, count(*) FILTER (num_examples > 2) AS successful, count(*) FILTER (num_examples > 4) AS admitted, count(*) FILTER (num_examples <= 2) AS failed, round(count(*) FILTER (num_examples > 2) / count(*), 6) AS share, count(*) FILTER (num_examples > 2) - count(*) FILTER (num_examples > 4) AS excluded FROM updates GROUP BY ROLLUP (rsu_id, round)")
def participation(spark, d):
    u = updates(spark, d).withColumn("ok", F.col("num_examples") > 2).withColumn("admitted", F.col("num_examples") > 4)
    return U.participation(u).withColumn("share", r6("share")).na.fill(-1, ["rsu_id", "round"])


# ---- paired statistics -------------------------------------------------------------------------------------------------


def results(spark, d):
    """Yearly means of orders as seeds: dataset = order status, method = priority, metric = price."""
    o = table(spark, d, "orders")
    per = o.groupBy(F.col("o_orderstatus").alias("dataset"), F.year("o_orderdate").alias("seed"), F.col("o_orderpriority").alias("method"))
    return per.agg(F.round(F.avg("o_totalprice") / 1000, 3).alias("value")).withColumn("metric", F.lit("price"))


RESULTS = "results AS (SELECT o_orderstatus AS dataset, CAST(year(o_orderdate) AS INTEGER) AS seed, o_orderpriority AS method, round(avg(o_totalprice) / 1000, 3) AS value FROM orders GROUP BY ALL)"


@query("method_summary", f"WITH {RESULTS} SELECT dataset, method, 'price' AS metric, count(*) AS seeds, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM results GROUP BY ALL")
def method_summary(spark, d):
    return rounded(Z.method_summary(results(spark, d)), ("mean", "sd"))


PAIRS = f"{RESULTS}, pairs AS (SELECT a.dataset, a.seed, 'price' AS metric, a.method AS method_a, b.method AS method_b, a.value - b.value AS diff FROM results a JOIN results b ON a.dataset = b.dataset AND a.seed = b.seed AND a.method < b.method)"


@query("pair_methods", f"WITH {PAIRS} SELECT dataset, seed, metric, method_a, method_b, round(diff, 6) AS diff FROM pairs")
def pair_methods(spark, d):
    return Z.pair_methods(results(spark, d)).withColumn("diff", r6("diff"))


FLIPS = f"""{PAIRS}, l AS (SELECT dataset, method_a, method_b, list(diff ORDER BY diff) AS d, count(*) AS n, abs(sum(diff)) AS obs, avg(diff) AS mean_diff FROM pairs GROUP BY ALL),
 t AS (SELECT dataset, method_a, method_b, n, obs, mean_diff, abs(list_sum([CASE WHEN (p >> (i - 1)) & 1 = 1 THEN -d[i] ELSE d[i] END FOR i IN range(1, n + 1)])) AS s FROM l, LATERAL (SELECT unnest(range(1 << n::INTEGER)) AS p)),
 tests AS (SELECT dataset, method_a, method_b, CAST(n AS INTEGER) AS n, count(*) FILTER (s >= obs - 1e-9) / count(*) AS p_value, any_value(mean_diff) AS mean_diff FROM t GROUP BY ALL)"""


def tests(spark, d):
    return Z.sign_flip_test(Z.pair_methods(results(spark, d)), ["dataset", "method_a", "method_b"])


@query("sign_flip_test", f"WITH {FLIPS} SELECT dataset, method_a, method_b, n, round(p_value, 6) AS p_value, round(mean_diff, 6) AS mean_diff FROM tests")
def sign_flip_test(spark, d):
    return rounded(tests(spark, d), ("p_value", "mean_diff"))


@query("holm", f"WITH {FLIPS}, a AS (SELECT *, least(1, p_value * (count(*) OVER (PARTITION BY dataset) - row_number() OVER (PARTITION BY dataset ORDER BY p_value, method_a, method_b) + 1)) AS a FROM tests) SELECT dataset, method_a, method_b, round(p_value, 6) AS p_value, round(max(a) OVER (PARTITION BY dataset ORDER BY a.p_value, method_a, method_b), 6) AS p_holm FROM a")
def holm(spark, d):
    adjusted = Z.holm(tests(spark, d), ["dataset"], "p_value", ["method_a", "method_b"])
    return rounded(adjusted.select("dataset", "method_a", "method_b", "p_value", "p_holm"), ("p_value", "p_holm"))


@query("bootstrap_mean_ci", f"""WITH {RESULTS}, l AS (SELECT dataset, method, list(value ORDER BY value) AS v FROM results GROUP BY ALL),
 m AS (SELECT dataset, method, list_sum([v[CAST(floor(('0x' || substr(md5(dataset || '|' || method || '|' || b || '|' || i || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * len(v)) AS INTEGER) + 1] FOR i IN range(1, len(v) + 1)]) / len(v) AS m FROM l, range(200) r(b))
SELECT dataset, method, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY ALL""")
def bootstrap(spark, d):
    return rounded(Z.bootstrap_mean_ci(results(spark, d), ["dataset", "method"], "value", 200), ("low", "high"))


@query("bootstrap_exact", f"""WITH RECURSIVE {RESULTS}, l AS (SELECT dataset, method, list(value ORDER BY value) AS v, count(*) AS n FROM results GROUP BY ALL),
 st AS (SELECT dataset, method, v, n, 0::BIGINT AS i, n AS rest, 0.0::DOUBLE AS total, factorial(n::INTEGER)::DOUBLE AS orders FROM l
  UNION ALL SELECT dataset, method, v, n, i + 1, rest - k, total + k * v[i + 1], orders / factorial(k::INTEGER)::DOUBLE FROM (SELECT *, unnest(range(rest + 1)) AS k FROM st WHERE i < n) WHERE i + 1 < n OR k = rest),
 m AS (SELECT dataset, method, round(total / n, 12) AS m, sum(orders) AS w FROM st WHERE i = n GROUP BY ALL), c AS (SELECT dataset, method, m, sum(w) OVER (PARTITION BY dataset, method ORDER BY m) AS cum, sum(w) OVER (PARTITION BY dataset, method) AS whole FROM m)
SELECT dataset, method, round(min(m) FILTER (cum >= 0.025::DOUBLE * whole), 6) AS low, round(min(m) FILTER (cum >= 0.975::DOUBLE * whole), 6) AS high FROM c GROUP BY ALL""")
def bootstrap_exact(spark, d):
    return rounded(Z.bootstrap_exact(results(spark, d), ["dataset", "method"], "value"), ("low", "high"))
