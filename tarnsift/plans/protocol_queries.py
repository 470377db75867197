"""Sources and sinks read back, whole protocols, and checks that hold for every draw."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tarnsift.functions import clean as C
from tarnsift.operators import audit as A
from tarnsift.operators import evidence as E
from tarnsift.operators import prep as M
from tarnsift.operators import split as P
from tarnsift.operators.model import open_set_report
from tarnsift.operators.primitives import hash_unit, join_keys
from tarnsift.plans.data_queries import CANDIDATES, SPLIT, holes, r6, split_flows
from tarnsift.plans.evaluation_queries import CONF, METRICS, NAMES, rounded
from tarnsift.plans.evidence_queries import CANON, FIELDS, receipts, records
from tarnsift.plans.inputs import FEATURES, FLOWS, ID_SUM, flows, id_sum, table, unit
from tarnsift.plans.registry import Registry
from tarnsift.sources import tables as S
from tarnsift.sources.shared import new_path, stored

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

# ---- sources and sinks -------------------------------------------------------------------------------------------------


@query("read_flows", "SELECT l_linenumber::DOUBLE AS \"Line\", count(*) AS n, round(sum(l_quantity), 2) AS quantity, CAST(sum(l_suppkey) AS DOUBLE) AS supp FROM lineitem GROUP BY 1")
def read_flows(spark, d):
    path = new_path(spark, "flows")
    table(spark, d, "lineitem").select(F.col("l_linenumber").alias(" Line "), F.col("l_quantity").alias("Quantity "), F.col("l_suppkey").alias(" Supp")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = S.read_flows(spark, path, "` Line ` int, `Quantity ` double, ` Supp` long")
    return back.groupBy("Line").agg(F.count("*").alias("n"), F.round(F.sum("Quantity"), 2).alias("quantity"), F.sum("Supp").alias("supp"))


#: Rows of a class file, about.
FILE_ROWS = 1_000_000


@query("read_class_files", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, TRUE AS one_class_a_file FROM events GROUP BY 1")
def read_class_files(spark, d):
    """A partition and so a file holds rows of one class; a class of more than FILE_ROWS rows has several files."""
    path, schema = new_path(spark, "classes"), "event_id long, event_type string"
    e = table(spark, d, "events").select("event_id", "event_type")
    rows, files = [], 0
    for name, n in e.groupBy("event_type").count().orderBy("event_type").collect():  # a row for each class
        rows.append((name, files, -(-n // FILE_ROWS)))
        files += rows[-1][2]
    numbered = join_keys(e, F.broadcast(spark.createDataFrame(rows, "event_type string, _first int, _files int")), ["event_type"])
    place = (F.col("_first") + F.pmod(F.hash("event_id"), F.col("_files"))).cast("int")
    numbered.repartitionById(max(files, 1), place).select("event_id", "event_type").write.csv(path, header=True)
    names = [f.rsplit("/", 1)[1] for f in spark.read.csv(path, header=True, schema=schema).inputFiles()]
    back = S.read_class_files(spark, path, names, schema)
    per_file = back.groupBy("event_type", "file").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    mixed = per_file.groupBy("file").agg(F.count("*").alias("classes"))
    return per_file.join(mixed, "file").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), (F.max("classes") == 1).alias("one_class_a_file"))


@query("validate_schema", "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1")
def validate_schema(spark, d):
    p = table(spark, d, "part").select("p_size", "p_brand", "p_partkey")
    return S.validate_schema(p, ["p_partkey", "p_brand", "p_size"]).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("size"))


@query("read_splits", f"WITH {SPLIT} SELECT split, label, count(*) AS n, {ID_SUM} AS ids, round(sum(price), 2) AS price FROM s GROUP BY ALL")
def read_splits(spark, d):
    path = new_path(spark, "splits")
    S.write_splits(split_flows(spark, d).select("row_id", "label", "price", "split"), path, "label")
    parts = [x.withColumn("split", F.lit(name)) for name, x in S.read_splits(spark, path, "label").items()]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("split", "label").agg(F.count("*").alias("n"), id_sum().alias("ids"), F.round(F.sum("price"), 2).alias("price"))


@query("file_inventory", "SELECT CAST(n_nationkey AS VARCHAR) AS nation, length(n_name) + 1 AS size_bytes, sha256(n_name || chr(10)) AS sha256, CASE WHEN n_nationkey < 10 THEN 'code' ELSE 'other' END AS role FROM nation")
def file_inventory(spark, d):
    path = new_path(spark, "files")
    n = table(spark, d, "nation")
    n.select(F.when(F.col("n_nationkey") < 10, "code").otherwise("docs").alias("place"), F.col("n_nationkey").alias("nation"), "n_name").write.partitionBy("place", "nation").text(path)
    found = S.file_inventory(spark, path, {"place=code/": "code"}, ignore=r"(^|/)[_.]")
    return found.select(F.regexp_extract("path", r"nation=(\d+)/", 1).alias("nation"), "size_bytes", "sha256", "role")


@query("read_run_results", "SELECT o_orderstatus AS dataset, CAST(o_custkey % 2 AS INTEGER) AS seed, o_orderpriority AS method, round(avg(o_totalprice) / 1e6, 9) AS f1, count(*) > 0 AS gate_passed, NULL::DOUBLE AS auc FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL")
def read_run_results(spark, d):
    path = new_path(spark, "runs")
    o = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    runs = stored(o.groupBy("o_orderstatus", (F.col("o_custkey") % 2).alias("seed"), "o_orderpriority").agg(F.round(F.avg("o_totalprice") / 1e6, 9).alias("f1"), (F.count("*") > 0).alias("gate_passed")), "results")
    for r in runs.collect():  # a few runs, a folder for each
        one = runs.where((F.col("o_orderstatus") == r[0]) & (F.col("seed") == r[1]) & (F.col("o_orderpriority") == r[2]))
        one.select("f1", "gate_passed").coalesce(1).write.json(f"{path}/{r[0]}/seed_{r[1]}/{r[2]}")
    return S.read_run_results(spark, f"{path}/*/*/*").select("dataset", "seed", "method", "f1", "gate_passed", "auc")


@query("saved_model", "SELECT \"column\", kind, round(value, 6) AS value FROM (WITH m AS (SELECT median(l_tax) AS a, avg(l_tax) AS b, stddev_pop(l_tax) AS c FROM lineitem) SELECT 'l_tax' AS \"column\", 'median' AS kind, a AS value FROM m UNION ALL SELECT 'l_tax', 'mean', b FROM m UNION ALL SELECT 'l_tax', 'std', c FROM m)")
def saved_model(spark, d):
    path = new_path(spark, "model")
    M.save_model(M.fit(table(spark, d, "lineitem"), ["l_tax"], []), path)
    return M.load_model(spark, path).select("column", "kind", r6(F.col("value").cast("double")).alias("value"))


@query("saved_problems", "SELECT split, count(*) AS n_rows, count(*) FILTER (k % 5 = 0) + count(*) FILTER (k % 7 = 0) AS non_finite, count(*) FILTER (k % 4 >= 2) AS bad_labels, split = 'a' AND 2 * count(*) FILTER (k % 4 = 1) <> count(*) AS unbalanced FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS split FROM orders) GROUP BY split")
def saved_problems(spark, d):
    k = F.col("o_orderkey")
    bad = table(spark, d, "orders").select(
        F.when(k % 3 == 0, "a").otherwise("b").alias("split"), F.when(k % 4 < 2, k % 4).when(k % 4 == 2, 7).alias("label"),
        F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("x"), F.when(k % 7 == 0, None).otherwise(F.lit(1.0)).alias("y"),
    )
    return S.saved_problems(bad, "label", ["x", "y"], balanced="a")


# ---- columns -----------------------------------------------------------------------------------------------------------


@query("feature_columns", f"WITH {FLOWS} SELECT 'q,d,t,price,supp' AS names, count(*) AS n, round(sum(q), 2) AS total FROM flows")
def feature_columns(spark, d):
    x = C.drop_identifiers(flows(spark, d), ["row_id", "okey", "Flow ID"]).withColumn("score", F.col("score").cast("string"))
    parts = [x.where(F.col("supp") % 3 == i) for i in range(3)]
    names = C.select_numeric_features(*parts, "label")
    return x.select(*names).agg(F.lit(",".join(names)).alias("names"), F.count("*").alias("n"), F.round(F.sum("q"), 2).alias("total"))


@query("order_by_time", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def order_by_time(spark, d):
    return P.order_by_time(table(spark, d, "orders"), "o_orderdate", ["o_orderkey"]).limit(100).select("o_orderkey", "o_orderdate")


@query("collapse_probabilities", f"WITH {FLOWS} SELECT q, d, t, min(family) AS family, round(avg(score), 6) AS a, round(avg(1 - score), 6) AS b FROM flows GROUP BY 1, 2, 3 HAVING count(DISTINCT family) = 1")
def collapse_probabilities(spark, d):
    f = flows(spark, d).withColumn("a", F.col("score")).withColumn("b", 1 - F.col("score"))
    return A.collapse_probabilities(f, FEATURES, "family", ["a", "b"]).withColumns({"a": r6("a"), "b": r6("b")})


# ---- splits ------------------------------------------------------------------------------------------------------------

_UNIT = "('0x' || substr(md5({g} || '|' || {s}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_SEEDS = list(range(1, 101))


@query("best_group_split", f"""WITH spec AS (SELECT f.f::DOUBLE AS fraction, CAST(s.s AS INTEGER) AS seed FROM (VALUES (0.15), (0.2), (0.3), (0.5)) f(f), range(1, 6) s(s)),
 c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), bc AS (SELECT fraction, seed, event_type, sum(CASE WHEN {_UNIT.format(g='user_id', s='seed')} < fraction THEN n ELSE 0 END) AS test, sum(n) AS n FROM c, spec GROUP BY ALL),
 sc AS (SELECT fraction, seed, abs(sum(test) / (SELECT count(*) FROM events) - fraction) + avg(abs(test / n - fraction)) AS score, count(*) FILTER (test > 0 AND test < n) = (SELECT count(DISTINCT event_type) FROM events) AS complete FROM bc GROUP BY fraction, seed),
 best AS (SELECT * FROM sc ORDER BY complete DESC, score, fraction, seed LIMIT 1)
SELECT CASE WHEN {_UNIT.format(g='user_id', s='seed')} < fraction THEN 'test' ELSE 'train' END AS split, event_type, count(*) AS n, count(DISTINCT user_id) AS groups FROM events, best GROUP BY ALL""")
def best_group_split(spark, d):
    s = P.best_group_split(table(spark, d, "events"), "user_id", "event_type", CANDIDATES, [1, 2, 3, 4, 5])
    return s.groupBy("split", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("groups"))


@query("three_way_search", f"""WITH p AS (SELECT DISTINCT user_id, event_type FROM events), s AS (SELECT CAST(i AS INTEGER) AS seed FROM range(1, 101) r(i)),
 h AS (SELECT seed, event_type, count(DISTINCT CASE WHEN u < 0.7::DOUBLE THEN 0 WHEN u < 0.85::DOUBLE THEN 1 ELSE 2 END) AS parts FROM (SELECT seed, event_type, {_UNIT.format(g='user_id', s='seed')} AS u FROM p, s) GROUP BY ALL),
 g AS (SELECT min(k) AS least_groups FROM (SELECT count(DISTINCT user_id) AS k FROM events GROUP BY event_type)), f AS (SELECT min(seed) AS seed FROM (SELECT seed FROM h GROUP BY 1 HAVING min(parts) = 3))
SELECT CASE WHEN least_groups < 3 THEN 'too_few_groups' WHEN seed IS NULL THEN 'no_complete_split_found' ELSE 'evaluable' END AS status, CASE WHEN least_groups >= 3 THEN seed END AS seed, least_groups FROM g, f""")
def three_way_search(spark, d):
    return P.three_way_search(table(spark, d, "events"), "user_id", "event_type", _SEEDS)


@query("overlap_counts", f"""WITH s AS (SELECT user_id, {unit('event_id::VARCHAR')} AS h FROM events), g AS (SELECT user_id, bool_or(h < 0.7) AS a, bool_or(h >= 0.7 AND h < 0.85) AS b, bool_or(h >= 0.85) AS c FROM s GROUP BY 1)
SELECT count(*) FILTER (a AND b) AS train_val, count(*) FILTER (a AND c) AS train_test, count(*) FILTER (b AND c) AS val_test FROM g""")
def overlap_counts(spark, d):
    """A split of rows that divides groups, as the audit has to find."""
    return P.overlap_counts(P.hash_split(table(spark, d, "events"), ["event_id"]), "user_id")


_STRICT = ", ".join(f"({k}, 'train', 1, {k - 2}), ({k}, 'cal', {k - 1}, {k - 1}), ({k}, 'test', {k}, {k})" for k in range(6, 11))


@query("folds_out_of_order", f"""WITH {FLOWS}, k AS (SELECT ts, CAST(CASE WHEN okey % 97 = 0 THEN 1 + floor({unit('row_id')} * 10) ELSE 1 + (year(ts) - 1992) END AS INTEGER) AS block FROM flows),
 f AS (SELECT v.fold, v.role, ts FROM k JOIN (VALUES {_STRICT}) v(fold, role, f, t) ON block BETWEEN v.f AND v.t), e AS (SELECT fold, max(ts) FILTER (role = 'train') AS a, min(ts) FILTER (role = 'cal') AS b, max(ts) FILTER (role = 'cal') AS c, min(ts) FILTER (role = 'test') AS d FROM f GROUP BY 1)
SELECT CAST(fold AS INTEGER) AS fold, coalesce(a < b AND b <= c AND c < d, FALSE) AS ordered FROM e""")
def folds_out_of_order(spark, d):
    """Blocks of years into which some rows are put at random: the check has to see it."""
    block = F.when(F.col("okey") % 97 == 0, 1 + F.floor(hash_unit("row_id") * 10)).otherwise(1 + F.year("ts") - 1992).cast("int")
    return P.fold_chronology(P.rolling_folds(flows(spark, d).withColumn("block", block), "block", "strict", 10), "ts")


@query("splits_with_nulls", f"""WITH {FLOWS}, x AS (SELECT row_id, CASE WHEN okey % 9 <> 0 THEN family END AS family, CASE WHEN okey % 8 <> 0 THEN supp END AS supp FROM flows),
 r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {unit('row_id')}, row_id) AS k, count(*) OVER (PARTITION BY family) AS n FROM x),
 g AS (SELECT supp, row_number() OVER (ORDER BY {unit("coalesce(supp::VARCHAR, chr(0))")}, supp NULLS LAST) AS gk, count(*) OVER () AS gn FROM (SELECT DISTINCT supp FROM x))
SELECT family, CASE WHEN k <= round(n * 0.7) THEN 'train' WHEN k <= round(n * 0.85) THEN 'val' ELSE 'test' END AS by_class, CASE WHEN gk <= floor(gn * 0.7 + 0.5) THEN 'train' WHEN gk <= floor(gn * 0.85 + 0.5) THEN 'val' ELSE 'test' END AS by_group, k <= 500 AS capped, count(*) AS n, {ID_SUM} AS ids
FROM r JOIN g ON r.supp IS NOT DISTINCT FROM g.supp GROUP BY ALL""")
def splits_with_nulls(spark, d):
    x = flows(spark, d).select("row_id", F.when(F.col("okey") % 9 != 0, F.col("family")).alias("family"), F.when(F.col("okey") % 8 != 0, F.col("supp")).alias("supp"))
    both = P.group_split(P.stratified_split(x, "family", ["row_id"]).withColumnRenamed("split", "by_class"), "supp").withColumnRenamed("split", "by_group")
    capped = P.cap_per_class(x, "family", ["row_id"], 500).select("row_id", F.lit(True).alias("capped"))
    both = both.join(capped, "row_id", "left").withColumn("capped", F.coalesce("capped", F.lit(False)))
    return both.groupBy("family", "by_class", "by_group", "capped").agg(F.count("*").alias("n"), id_sum().alias("ids"))


@query("shard_skewed_checks", f"WITH {FLOWS} SELECT count(*) AS n_rows, count(DISTINCT row_id) AS ids, count(*) FILTER (label = 1) AS positives, CAST(10 AS BIGINT) AS clients, CAST(10 AS BIGINT) AS with_both_classes, TRUE AS sizes_bounded, TRUE AS bands_in_order FROM flows")
def shard_skewed_checks(spark, d):
    """What holds whatever is drawn: every row once, both classes everywhere, sizes within the ratio, and bands of the feature that
    follow one another, one vehicle of each rsu after the other."""
    k = P.shard_skewed(flows(spark, d), "label", "price", ["row_id"], 2, 5)
    per = k.groupBy("rsu", "vehicle").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("ids"), F.count_if(F.col("label") == 1).alias("pos"), *[f(F.when(F.col("label") == y, F.col("price"))).alias(f"{n}{y}") for y in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = per.withColumn("after", F.struct("vehicle", "rsu"))
    a, b = rows.alias("a"), rows.alias("b")
    crossed = a.join(b, F.col("a.after") < F.col("b.after")).where((F.col("a.hi0") > F.col("b.lo0")) | (F.col("a.hi1") > F.col("b.lo1"))).agg(F.count("*").alias("crossed"))
    out = per.agg(F.sum("n").alias("n_rows"), F.sum("ids").alias("ids"), F.sum("pos").alias("positives"), F.count("*").alias("clients"), F.count_if((F.col("pos") > 0) & (F.col("pos") < F.col("n"))).alias("with_both_classes"), (F.max("n") <= 10 * F.min("n") + 10).alias("sizes_bounded"))
    return out.crossJoin(crossed).withColumn("bands_in_order", F.col("crossed") == 0).drop("crossed")


# ---- evidence ----------------------------------------------------------------------------------------------------------


@query("canonical_round_trip", "SELECT CASE WHEN c_custkey % 5 = 1 THEN 'blank' WHEN c_custkey % 5 = 2 THEN 'order' WHEN c_custkey % 5 = 3 THEN 'broken' WHEN c_custkey % 5 = 4 THEN 'extra key' ELSE 'none' END AS change, CASE WHEN c_custkey % 5 = 0 THEN 'ok' ELSE 'canonical' END AS reason, count(*) AS n FROM customer GROUP BY ALL")
def canonical_round_trip(spark, d):
    text, k = F.col("canonical"), F.col("n") % 5
    r = E.canonical_json(records(spark, d), FIELDS).withColumn("change", F.when(k == 1, "blank").when(k == 2, "order").when(k == 3, "broken").when(k == 4, "extra key").otherwise("none"))
    moved = F.concat(F.regexp_extract(text, r'^(\{"did":"[^"]*",)("n":\d+,)(.*)$', 2).alias("x"), F.lit(""))
    changed = (
        F.when(k == 1, F.replace(text, F.lit('","n"'), F.lit('", "n"')))
        .when(k == 2, F.concat(F.lit("{"), moved, F.regexp_replace(F.regexp_replace(text, r'"n":\d+,', ""), r"^\{", "")))
        .when(k == 3, F.substring(text, 1, 20)).when(k == 4, F.regexp_replace(text, r"^\{", '{"a":1,')).otherwise(text)
    )
    r = r.withColumn("canonical", changed)
    return E.validate_records(r, "S1", [], [], ["n"], fields="did string, n long, rec struct<z: boolean, a: array<long>>, schema string").groupBy("change", "reason").agg(F.count("*").alias("n"))


@query("verify_records", """SELECT CASE WHEN k % 17 = 0 THEN 'dp_record:missing_payload' WHEN k % 13 = 0 THEN 'dp_record:mismatch' WHEN k % 11 = 0 THEN 'dp_record:not_in_ledger' WHEN k % 7 = 0 THEN 'dp_record:ledger_mismatch' WHEN k % 5 = 0 THEN 'anchor:malformed_claim' WHEN k % 3 = 0 THEN 'report:missing_claim' ELSE 'ok' END AS reason, count(*) AS n FROM (SELECT c_custkey AS k FROM customer) GROUP BY 1""")
def verify_records(spark, d):
    k = F.col("k")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(*[F.lit(x) for x in E.RECORD_KINDS])).alias("kind")).withColumn("content", F.concat_ws("|", "kind", "k"))
    dp, digest = F.col("kind") == "dp_record", F.sha2("content", 256)
    claimed = F.when(dp & (k % 13 == 0), F.sha2(digest, 256)).when((F.col("kind") == "anchor") & (k % 5 == 0), "no digest").otherwise(digest)
    claims = c.where(~((F.col("kind") == "report") & (k % 3 == 0))).select("k", "kind", claimed.alias("claimed"))
    ledger = c.where(dp & (k % 11 != 0)).select("k", F.when(k % 7 == 0, F.sha2(digest, 256)).when(k % 13 == 0, F.sha2(digest, 256)).otherwise(digest).alias("dp_record_sha256"))
    return E.verify_records(c.where(~(dp & (k % 17 == 0))).select("k", "kind", "content"), claims, ledger, ["k"]).groupBy("reason").agg(F.count("*").alias("n"))


def _empty_root() -> str:
    h = bytes(32)
    for _ in range(32):
        h = hashlib.sha256(h + bytes(32)).digest()
    return h.hex()


@query("merkle_root_of_none", f"SELECT lang, '{_empty_root()}' AS root, CAST(0 AS BIGINT) AS leaves FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def merkle_root_of_none(spark, d):
    docs = table(spark, d, "documents")
    return E.merkle_root(docs.where("doc_id is null"), ("lang",), ["doc_id"], "text", groups=docs.where("lang is not null").select("lang")).select("lang", "root", "leaves")


@query("receipt_latency", """WITH h AS (SELECT s_suppkey * 11 AS b, TIMESTAMP '1998-01-01' + INTERVAL 1 HOUR * (s_suppkey % 40) AS seen_at FROM supplier), r AS (SELECT o_orderpriority AS kind, o_orderdate AS "at", o_orderkey % 1000 AS b FROM orders),
 g AS (SELECT kind, "at", (SELECT min(seen_at) FROM h WHERE h.b >= r.b) AS final_at FROM r), f AS (SELECT kind, CASE WHEN final_at IS NOT NULL THEN greatest(0, epoch(final_at) - epoch("at")) END AS s FROM g)
SELECT kind, count(s) AS n, round(avg(s), 3) AS mean, round(quantile_cont(s, 0.5), 3) AS median, round(min(s), 3) AS lo, round(max(s), 3) AS hi, quantile_disc(s, 0.95)::DOUBLE AS p95, count(*) FILTER (s IS NULL) AS timed_out FROM f GROUP BY 1""")
def receipt_latency(spark, d):
    heads = table(spark, d, "supplier").select((F.col("s_suppkey") * 11).alias("block"), (F.lit("1998-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("s_suppkey") % 40).cast("int"))).alias("seen_at"))
    got = E.receipt_latency(receipts(spark, d), heads, ("kind",)).where("span = 'start_to_final'")
    return got.select("kind", "n", *[F.round(x, 3).alias(x) for x in ("mean", "median", "lo", "hi")], "p95", "timed_out")


# ---- open set ----------------------------------------------------------------------------------------------------------

_HELD = ["A-F", "R-F"]


_RULE_SCORES = """CASE held_out WHEN 'A-F' THEN score ELSE score / 4 + 0.5 END AS sup, CASE held_out WHEN 'A-F' THEN least(1.0::DOUBLE, t / 0.08::DOUBLE) ELSE t + d END AS nov"""
_AUC = "round(sum(p * (cn - n / 2)) / nullif(sum(p), 0) / nullif(sum(n), 0), 6)"


@query("open_set_rules", f"""WITH {SPLIT}, h AS (SELECT unnest(['A-F', 'R-F']) AS held_out), x AS (SELECT held_out, split, family, label, {_RULE_SCORES} FROM s, h),
 cal AS (SELECT * FROM x WHERE split = 'val' AND family <> held_out), te AS (SELECT * FROM x WHERE split = 'test' AND (family = held_out OR label = 0)),
 g AS (SELECT i, round(0.01 + i * ((0.99 - 0.01) / 198), 10)::DOUBLE AS threshold FROM range(199) r(i)), cg AS (SELECT *, least(198, greatest(-1, floor((sup - 0.01::DOUBLE) / ((0.99::DOUBLE - 0.01::DOUBLE) / 198) + 1e-9))) AS g FROM cal),
 gc AS (SELECT held_out, g, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM cg GROUP BY ALL), pt AS (SELECT held_out, sum(p) AS pp FROM gc GROUP BY 1),
 f0 AS (SELECT pt.held_out, i, threshold, round(2.0::DOUBLE * coalesce(sum(p) FILTER (gc.g >= i), 0) / (coalesce(sum(p + n) FILTER (gc.g >= i), 0) + any_value(pp)), 12) AS f1 FROM pt, g, gc WHERE gc.held_out = pt.held_out GROUP BY ALL),
 f AS (SELECT held_out, arg_min(threshold, (-f1, i)) AS t_f1 FROM f0 GROUP BY 1),
 b AS (SELECT held_out, sup, nov, row_number() OVER (PARTITION BY held_out ORDER BY sup DESC) AS rs, row_number() OVER (PARTITION BY held_out ORDER BY nov DESC) AS rn, count(*) OVER (PARTITION BY held_out) AS n FROM cal WHERE label = 0),
 th AS (SELECT held_out, max(sup) FILTER (rs = floor(0.01::DOUBLE * n + 1e-9) + 1) AS t_fpr, max(sup) FILTER (rs = floor(0.005::DOUBLE * n + 1e-9) + 1) AS t_s, max(nov) FILTER (rn = floor(0.005::DOUBLE * n + 1e-9) + 1) AS t_n FROM b GROUP BY 1),
 ps AS (SELECT held_out, sup, (SELECT count(*) FROM b WHERE b.sup <= q.sup AND b.held_out = q.held_out) / (SELECT count(*) FROM b WHERE b.held_out = q.held_out) AS ps FROM (SELECT DISTINCT held_out, sup FROM te) q),
 pn AS (SELECT held_out, nov, (SELECT count(*) FROM b WHERE b.nov <= q.nov AND b.held_out = q.held_out) / (SELECT count(*) FROM b WHERE b.held_out = q.held_out) AS pn FROM (SELECT DISTINCT held_out, nov FROM te) q),
 z AS (SELECT te.*, greatest(ps, pn) AS hy, t_f1, t_fpr, t_s, t_n FROM te JOIN ps USING (held_out, sup) JOIN pn USING (held_out, nov) JOIN f USING (held_out) JOIN th USING (held_out)),
 r AS (SELECT held_out, label, 'f1_threshold' AS rule, t_f1 AS threshold, NULL::DOUBLE AS novelty_threshold, (sup >= t_f1)::INTEGER AS pred FROM z UNION ALL SELECT held_out, label, 'fpr_1pct', t_fpr, NULL, (sup > t_fpr)::INTEGER FROM z UNION ALL SELECT held_out, label, 'hybrid_or', t_s, t_n, (sup > t_s OR nov > t_n)::INTEGER FROM z),
 sc AS (SELECT held_out, k, v, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM (SELECT held_out, label, unnest(['s', 'h', 'n']) AS k, unnest([sup, hy, nov]) AS v FROM z) GROUP BY ALL),
 au AS (SELECT held_out, k, {_AUC} AS auc FROM (SELECT *, sum(n) OVER (PARTITION BY held_out, k ORDER BY v) AS cn FROM sc) GROUP BY ALL),
 c AS (SELECT held_out, rule, round(threshold, 9) AS threshold, round(novelty_threshold, 9) AS novelty_threshold, {CONF} FROM r GROUP BY ALL)
 SELECT c.*, {METRICS}, (SELECT auc FROM au WHERE au.held_out = c.held_out AND k = CASE WHEN rule = 'hybrid_or' THEN 'h' ELSE 's' END) AS auc, (SELECT auc FROM au WHERE au.held_out = c.held_out AND k = 'n') AS novelty_auc FROM c""")
def open_set_rules(spark, d):
    """The two families' scores are on scales of their own."""
    own = F.col("held_out") == "A-F"
    each = split_flows(spark, d).select("split", "family", "label", "score", "t", "d", F.explode(F.array(*[F.lit(x) for x in _HELD])).alias("held_out"))
    each = each.withColumn("sup", F.when(own, F.col("score")).otherwise(F.col("score") / 4 + 0.5)).withColumn("nov", F.when(own, F.least(F.lit(1.0), F.col("t") / 0.08)).otherwise(F.col("t") + F.col("d")))
    each = stored(each.select("split", "family", "label", "held_out", "sup", "nov"), "open_set")
    cal = each.where("split = 'val' and family <> held_out")
    test = each.where("split = 'test' and (family = held_out or label = 0)")
    got = rounded(open_set_report(cal, test, "label", "sup", "nov", "held_out"), (*NAMES, "auc", "novelty_auc"))
    return got.withColumns({c: F.round(c, 9) for c in ("threshold", "novelty_threshold")})
