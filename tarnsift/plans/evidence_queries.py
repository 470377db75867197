"""Digests, Merkle roots, gates, inventories and receipts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnsift.operators import evidence as E
from tarnsift.plans.data_queries import r6
from tarnsift.plans.inputs import UPDATES, table, updates
from tarnsift.plans.registry import Registry
from tarnsift.sources.tables import role_by_prefix

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

CANON = """'{"did":"' || c_mktsegment || '","n":' || c_custkey || ',"rec":{"a":[' || c_nationkey || ',1],"z":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'null' END || '},"schema":"S1"}'"""


def records(spark, d):
    rec = F.struct(F.when(F.col("c_custkey") % 2 == 0, True).alias("z"), F.array(F.col("c_nationkey"), F.lit(1)).alias("a")).alias("rec")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_mktsegment").alias("did"), rec, F.lit("S1").alias("schema"))


FIELDS = ["n", "did", "rec", "schema"]


@query("canonical_json", f"SELECT c_custkey AS n, {CANON} AS canonical FROM customer")
def canonical_json(spark, d):
    return E.canonical_json(records(spark, d), FIELDS).select("n", "canonical")


@query("record_digest", f"SELECT c_custkey AS n, sha256({CANON}) AS digest FROM customer")
def record_digest(spark, d):
    return E.record_digest(records(spark, d), FIELDS).select("n", "digest")


@query("validate_records", "SELECT CASE WHEN c_custkey % 11 = 0 THEN 'schema' WHEN c_custkey % 7 = 0 THEN 'payload_sha256' WHEN c_custkey % 5 = 0 THEN 'auth_sha256' ELSE 'ok' END AS reason, count(*) AS n FROM customer GROUP BY 1")
def validate_records(spark, d):
    r = records(spark, d).withColumn("schema", F.when(F.col("n") % 11 == 0, "S0").otherwise("S1"))
    r = E.canonical_json(r, FIELDS).withColumn("payload_sha256", F.when(F.col("n") % 7 == 0, "zz").otherwise(F.sha2("canonical", 256))).withColumn("auth_sha256", F.when(F.col("n") % 5 == 0, "a").otherwise(""))
    return E.validate_records(r, "S1", ["payload_sha256"], ["auth_sha256"], ["n"]).groupBy("reason").agg(F.count("*").alias("n"))


@query("verify_digests", "SELECT CASE WHEN doc_id % 13 = 0 THEN 'missing_claim' WHEN doc_id % 5 = 0 THEN 'malformed_claim' WHEN doc_id % 3 = 0 AND text <> text || 'x' THEN 'mismatch' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def verify_digests(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    i = F.col("doc_id")
    claim = F.when(i % 5 == 0, "not a digest").when(i % 3 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.sha2("content", 256))
    return E.verify_digests(docs, docs.where(i % 13 != 0).select("doc_id", claim.alias("claimed")), "doc_id").groupBy("reason").agg(F.count("*").alias("n"))


@query("admission_gate", f"""WITH {UPDATES} SELECT rsu_id, round, CASE WHEN num_examples % 11 = 0 THEN 'bad_vector' WHEN num_examples % 7 = 0 THEN 'bad_digest' WHEN upload_bytes % 5 = 0 THEN 'bad_signature' WHEN upload_bytes % 7 = 0 THEN 'cross_rsu' WHEN upload_bytes % 3 = 0 THEN 'stale_round' ELSE 'ok' END AS reason, count(*) AS n FROM updates GROUP BY ALL""")
def admission_gate(spark, d):
    n, b = F.col("num_examples"), F.col("upload_bytes")
    u = updates(spark, d).withColumns({
        "q_anchor": F.when(n % 11 == 0, F.array_repeat(F.lit(0), 3)).otherwise(F.array_repeat(F.lit(0), 4)), "delta_sha256": F.when(n % 7 == 0, "x").otherwise(F.sha2(n.cast("string"), 256)), "delta_bytes": b + 1,
        "has_key": F.lit(True), "has_signature": F.lit(True), "signature_ok": b % 5 != 0, "signed_rsu": F.when(b % 7 == 0, F.col("rsu_id") + 1).otherwise(F.col("rsu_id")), "signed_round": F.when(b % 3 == 0, F.col("round") - 1).otherwise(F.col("round")),
    })
    return E.admission_gate(u, 4).groupBy("rsu_id", "round", "reason").agg(F.count("*").alias("n"))


def _sql_level(source: str) -> str:
    z = f"'{E.ZERO_LEAF}'"
    return f"SELECT g, p // 2 AS p, sha256(unhex(coalesce(max(h) FILTER (p % 2 = 0), {z})) || unhex(coalesce(max(h) FILTER (p % 2 = 1), {z}))) AS h FROM {source} GROUP BY g, p // 2"


MERKLE = "l0 AS (SELECT lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, sha256(text) AS h FROM documents), " + ", ".join(f"l{i} AS ({_sql_level(f'l{i - 1}')})" for i in range(1, 33))


@query("merkle_root", f"WITH {MERKLE} SELECT g AS lang, h AS root, (SELECT count(*) FROM documents WHERE lang = g) AS leaves FROM l32")
def merkle_root(spark, d):
    return E.merkle_root(table(spark, d, "documents"), ("lang",), ["doc_id"], "text")


@query("audit_roots", f"SELECT lang, CASE WHEN lang = 'en' THEN 'root_mismatch' WHEN lang = 'de' THEN 'body_mismatch' ELSE 'ok' END AS reason FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def audit_roots(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    made = E.merkle_root(docs, ("lang",), ["doc_id"], "text")
    body = F.concat(F.lit("leaves "), F.col("leaves"))
    manifests = made.select("lang", F.when(F.col("lang") == "en", E.ZERO_LEAF).otherwise(F.col("root")).alias("root"), body.alias("body"), F.when(F.col("lang") == "de", "x").otherwise(F.sha2(body, 256)).alias("body_sha256"))
    return E.audit_roots(manifests, docs, ("lang",), ["doc_id"], "text")


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SECRETS = f"len(list_filter(regexp_extract_all(text, {_sql_text(E.SECRET_ASSIGNMENT)}, 2), lambda v: NOT regexp_matches(v, {_sql_text(E.MASKED)})))"
_PATHS = f"len(regexp_extract_all(text, {_sql_text(E.ABSOLUTE_PATH)}, 1))"


@query("scan_text", f"SELECT doc_id, 'secret_assignment' AS rule, CAST({_SECRETS} AS INTEGER) AS n FROM documents WHERE {_SECRETS} > 0 UNION ALL SELECT doc_id, 'absolute_path', CAST({_PATHS} AS INTEGER) FROM documents WHERE {_PATHS} > 0 UNION ALL SELECT * FROM (SELECT doc_id, 'stale_phrase', {' + '.join(f'contains(text, {p!r})::INTEGER' for p in E.STALE_PHRASES)} AS n FROM documents) WHERE n > 0")
def scan_text(spark, d):
    return E.scan_text(table(spark, d, "documents"), "doc_id", "text")


@query("scan_json", """SELECT path, count(*) AS n FROM (SELECT unnest(['$.a[0].api_key', '$.a[1].deep[0].in.password']) AS path FROM events WHERE event_id % 4 = 0 UNION ALL SELECT '$.a[1].deep[0].in.token.private_key' FROM events WHERE event_id % 3 = 0) GROUP BY 1""")
def scan_json(spark, d):
    """The events' properties beside names that are secret at several depths, with masked and unmasked values."""
    quarter, third = F.col("event_id") % 4 == 0, F.col("event_id") % 3 == 0
    deep = F.concat(F.lit('{"deep": [{"in": {"password": '), F.when(quarter, "12").otherwise('"redacted"'), F.lit(', "token": {"private_key": '), F.when(third, '"0xab"').otherwise("null"), F.lit("}}}]}"))
    doc = F.concat(F.lit('{"a": [{"api_key": "'), F.when(quarter, "k-123").otherwise("****"), F.lit('"}, '), deep, F.lit('], "props": '), F.coalesce("props", F.lit("null")), F.lit("}"))
    return E.scan_json(table(spark, d, "events").select("event_id", doc.alias("doc")), "event_id", "doc").groupBy("path").agg(F.count("*").alias("n"))


@query("canonical_text", """SELECT event_id, sha256('{"a":{"kind":"' || event_type || '","user":' || coalesce(user_id::VARCHAR, 'null') || '},"z":[' || event_id || ',true,"\\u001f é \\""]}') AS digest, event_id % 3 = 0 AS canonical FROM events""")
def canonical_text(spark, d):
    """Records whose keys stand in another order, with blanks; every third one is canonical as it is."""
    e = table(spark, d, "events")
    kind, user, z = F.concat(F.lit('"kind":"'), "event_type", F.lit('"')), F.concat(F.lit('"user":'), F.coalesce(F.col("user_id").cast("string"), F.lit("null"))), F.concat(F.lit('"z":['), F.col("event_id").cast("string"), F.lit(',true,"\\u001f é \\""]'))
    right = F.concat(F.lit('{"a":{'), kind, F.lit(","), user, F.lit("},"), z, F.lit("}"))
    other = F.concat(F.lit("{ "), z, F.lit(' , "a" : {'), user, F.lit(" ,\t"), kind, F.lit("}}"))
    text = F.when(F.col("event_id") % 3 == 0, right).otherwise(other)
    return e.select("event_id", E.text_digest(text).alias("digest"), E.is_canonical(text).alias("canonical"))


@query("checksum_lines", "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'malformed' WHEN p_partkey % 10 = 1 THEN 'self_reference' WHEN p_partkey % 10 = 2 THEN 'unsafe_path' ELSE 'none' END AS problem, count(*) AS n FROM part GROUP BY 1")
def checksum_lines(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 10 == 1, "sub/checksums.sha256").when(k % 10 == 2, F.concat(F.lit("../x"), k.cast("string"))).otherwise(F.concat(F.lit("data/"), k.cast("string")))
    line = F.when(k % 10 == 0, "oops").otherwise(F.concat(F.sha2(k.cast("string"), 256), F.lit("  "), path))
    lines = table(spark, d, "part").select(F.when(k % 10 == 1, k.cast("string")).otherwise("list").alias("source"), k.alias("line_no"), line.alias("line"))
    return E.checksum_lines(lines).groupBy("problem").agg(F.count("*").alias("n"))


def _inventory(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(F.concat(F.when(i % 2 == 0, "code/").otherwise("docs/"), i.cast("string"), F.lit(".txt")).alias("path"), F.length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"), i)


@query("compare_inventories", "SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'unlisted' WHEN doc_id % 3 = 0 THEN 'mismatch' ELSE 'match' END AS status, count(*) AS n FROM documents GROUP BY 1")
def compare_inventories(spark, d):
    inv = _inventory(spark, d)
    i = F.col("doc_id")
    actual = inv.where(i % 7 != 0).withColumn("sha256", F.when(i % 3 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return E.compare_inventories(inv.where((i % 5 != 0) | (i % 7 == 0)), actual).groupBy("status").agg(F.count("*").alias("n"))


@query("file_rules", "SELECT CASE WHEN doc_id % 2 = 1 AND doc_id % 10 = 9 THEN 'forbidden' WHEN length(text) > 8000 THEN 'too_large' ELSE 'large' END AS problem, count(*) AS n FROM documents WHERE (doc_id % 2 = 1 AND doc_id % 10 = 9) OR length(text) > 4000 GROUP BY 1 UNION ALL SELECT 'missing', 1 FROM (SELECT count(*) FROM documents)")
def file_rules(spark, d):
    return E.file_rules(_inventory(spark, d), ["code/0.txt", "README.md"], [r"^docs/\d*9\.txt$"], 4000, 8000).groupBy("problem").agg(F.count("*").alias("n"))


@query("inventory_roles", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE 'text' END AS role, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def inventory_roles(spark, d):
    inv = _inventory(spark, d).withColumn("role", role_by_prefix(F.col("path"), {"code/": "source", "docs/": "text"}))
    return inv.groupBy("role").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("field_agreement", "SELECT * FROM (SELECT 'o_orderstatus' AS field, CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus <> 'X' THEN 'different' ELSE 'equal' END AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_custkey', CASE WHEN o_orderkey % 3 = 0 THEN 'unresolved' ELSE 'equal' END, count(*) FROM orders GROUP BY 2)")
def field_agreement(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    other = o.select(k, F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("state"), F.when(k % 3 != 0, F.col("o_custkey")).alias("who"))
    return E.field_agreement(o, other, ["o_orderkey"], {"o_orderstatus": "state", "o_custkey": "who"}).groupBy("field", "status").agg(F.count("*").alias("n"))


@query("vector_agreement", "SELECT CAST(i - 1 AS INTEGER) AS index, count(*) AS n FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) WHERE (vec_id + i - 1) % 50 = 0 OR (i = 64 AND vec_id % 7 = 0) GROUP BY 1")
def vector_agreement(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("string")).alias("a"))
    changed = F.transform("a", lambda x, i: F.when((F.col("vec_id") + i) % 50 == 0, "no").otherwise(x))
    b = F.when(F.col("vec_id") % 7 == 0, F.slice(changed, 1, 63)).otherwise(changed)
    return E.vector_agreement(e.withColumn("b", b), ["vec_id"], "a", "b").groupBy("index").agg(F.count("*").alias("n"))


@query("run_contract", "SELECT * FROM (SELECT 'seed' AS \"check\", c_custkey % 4 <> 0 AS ok, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'f1', c_nationkey <= 20, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'gate', c_custkey % 3 <> 0, count(*) FROM customer GROUP BY 2)")
def run_contract(spark, d):
    k = F.col("c_custkey")
    runs = table(spark, d, "customer").select(k.alias("run"), F.col("c_mktsegment").alias("dataset"), F.when(k % 4 == 0, 1).otherwise(42).alias("seed"), (F.col("c_nationkey") / 20).alias("f1"), (k % 3 != 0).alias("gate_passed"))
    expected = runs.select("dataset").distinct().withColumn("seed", F.lit(42))
    return E.run_contract(runs, expected, ["dataset", "seed"], ["f1"]).groupBy("check", "ok").agg(F.count("*").alias("n"))


@query("paired_inputs", "SELECT o_orderstatus AS dataset, CAST(year(o_orderdate) AS INTEGER) AS seed, count(DISTINCT o_orderpriority) AS methods, count(DISTINCT CASE WHEN year(o_orderdate) % 2 = 0 THEN 'd' ELSE o_orderpriority END) = 1 AS same_inputs FROM orders GROUP BY ALL")
def paired_inputs(spark, d):
    y = F.year("o_orderdate")
    m = table(spark, d, "orders").select(F.col("o_orderstatus").alias("dataset"), y.alias("seed"), F.col("o_orderpriority").alias("method"), F.when(y % 2 == 0, "d").otherwise(F.col("o_orderpriority")).alias("digest"))
    return E.paired_inputs(m)


def receipts(spark, d):
    """Orders as receipts of transactions."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("tx_id"), F.col("o_orderpriority").alias("kind"), F.concat(F.lit("0x"), F.sha2(k.cast("string"), 256)).alias("tx_hash"), (k % 1000).alias("block"), F.when(k % 9 == 0, 0).otherwise(1).alias("status"), (k % 8 != 0).alias("verified"),
        (k % 500 + 21000).alias("gas_used"), F.when(k % 4 == 0, None).otherwise(k % 90 + 10).alias("effective_gas_price"), F.lit(20).alias("gas_price"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.make_dt_interval(secs=F.lit(5))).alias("receipt_at"),
    )


FEES = "fees AS (SELECT o_orderpriority AS kind, o_orderkey % 9 = 0 AS bad, (o_orderkey % 500 + 21000) * CASE WHEN o_orderkey % 4 = 0 THEN 20 ELSE o_orderkey % 90 + 10 END AS fee FROM orders)"


@query("receipt_costs", f"WITH {FEES} SELECT kind, count(*) AS n, round(avg(fee), 4) AS mean, round(quantile_cont(fee, 0.5), 4) AS median, round(stddev_pop(fee), 4) AS sd, min(fee)::DOUBLE AS lo, max(fee)::DOUBLE AS hi, quantile_disc(fee, 0.95)::DOUBLE AS p95, count(*) AS sent, count(*) FILTER (bad) AS failed FROM fees GROUP BY 1")
def receipt_costs(spark, d):
    c = E.receipt_costs(receipts(spark, d), ("kind",)).drop("wilson_low", "wilson_high")
    return c.withColumns({x: F.round(x, 4) for x in ("mean", "median", "sd")})


@query("finality_latency", "WITH h AS (SELECT s_suppkey * 11 AS b, TIMESTAMP '1998-01-01' + INTERVAL 1 HOUR * (s_suppkey % 40) AS seen_at FROM supplier), r AS (SELECT o_orderkey, o_orderdate, o_orderkey % 1000 AS b FROM orders), f AS (SELECT o_orderkey, o_orderdate, (SELECT min(seen_at) FROM h WHERE h.b >= r.b) AS final_at FROM r) SELECT count(*) AS n, count(*) FILTER (final_at IS NULL) AS timed_out, CAST(sum(greatest(0, epoch(final_at) - epoch(o_orderdate) - 5)) AS BIGINT) AS receipt_seconds, CAST(sum(greatest(0, epoch(final_at) - epoch(o_orderdate))) AS BIGINT) AS start_seconds FROM f")
def finality_latency(spark, d):
    heads = table(spark, d, "supplier").select((F.col("s_suppkey") * 11).alias("block"), (F.lit("1998-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("s_suppkey") % 40).cast("int"))).alias("seen_at"))
    found = E.finality_latency(receipts(spark, d), heads)
    return found.agg(F.count("*").alias("n"), F.count_if("timed_out").alias("timed_out"), F.sum(F.when(~F.col("timed_out"), F.col("receipt_to_final"))).alias("receipt_seconds"), F.sum(F.when(~F.col("timed_out"), F.col("start_to_final"))).alias("start_seconds"))


@query("submission_checks", "SELECT 'submitted' AS \"check\", count(*) AS passed, CAST(0 AS BIGINT) AS failed FROM orders UNION ALL SELECT 'mined', count(*), 0 FROM orders UNION ALL SELECT 'hash_shape', count(*), 0 FROM orders UNION ALL SELECT 'status', count(*) FILTER (o_orderkey % 9 <> 0), count(*) FILTER (o_orderkey % 9 = 0) FROM orders UNION ALL SELECT 'verified', count(*) FILTER (o_orderkey % 8 <> 0), count(*) FILTER (o_orderkey % 8 = 0) FROM orders UNION ALL SELECT 'count', count(*), abs(count(*) - 160) FROM orders")
def submission_checks(spark, d):
    return E.submission_checks(receipts(spark, d), 160)
