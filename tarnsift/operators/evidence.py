"""Bulk integrity of records and files: canonical JSON, digests, Merkle roots, gates, inventories, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsift.functions.clean import is_sha256_hex
from tarnsift.operators.metrics import describe_nearest_rank, wilson_interval
from tarnsift.operators.primitives import bucketed_rank, join_keys, placed
from tarnsift.sources.shared import stored

ZERO_LEAF = "00" * 32


def _refuse(kind: T.DataType, path: str) -> None:
    if isinstance(kind, (T.FloatType, T.DoubleType, T.BinaryType, T.DecimalType, T.TimestampType, T.DateType)):
        raise ValueError(f"{path}: {kind.simpleString()} has no canonical form")
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            _refuse(f.dataType, f"{path}.{f.name}")
    if isinstance(kind, T.ArrayType):
        _refuse(kind.elementType, f"{path}[]")


def _sorted(c: Column, kind: T.DataType) -> Column:
    """Struct fields in name order at any depth."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    return c


def canonical_json(df: DataFrame, cols: list[str], out: str = "canonical") -> DataFrame:
    """Keys sorted, no blanks, nulls kept, control characters as lower-case escapes; text, whole numbers, booleans, lists
    and structs only, anything else raises."""
    for c in cols:
        _refuse(df.schema[c].dataType, c)
    whole = F.struct(*[_sorted(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(cols)])
    return df.withColumn(out, _escaped(F.to_json(whole, {"ignoreNullFields": "false"})))


def _escaped(text: Column) -> Column:
    """Control characters as lower-case escapes."""
    for upper in [f"{h:X}" for h in range(0x10, 0x20)] + [f"0{h:X}" for h in range(16)]:
        if any(x in "ABCDEF" for x in upper):
            text = F.replace(text, F.lit(f"\\u00{upper}"), F.lit(f"\\u00{upper.lower()}"))
    return text


def record_digest(df: DataFrame, cols: list[str], out: str = "digest") -> DataFrame:
    return canonical_json(df, cols, "_canonical").withColumn(out, F.sha2("_canonical", 256)).drop("_canonical")


def canonical_text(text: Column) -> Column:
    """The canonical form of any JSON text, whatever its keys: keys sorted at every depth, no blanks, control characters as lower-case
    escapes. Null for text that isn't JSON, holds a number with a point or an exponent, or a name twice in one object."""
    bare = F.regexp_replace(text, r'"(\\.|[^"\\])*"', '""')
    return F.when(~bare.rlike("[0-9][.eE]"), _escaped(F.to_json(F.try_parse_json(text))))


def text_digest(text: Column) -> Column:
    """sha256 of the canonical form, lower-case hex."""
    return F.sha2(canonical_text(text), 256)


def is_canonical(text: Column, schema: str | None = None) -> Column:
    """Whether the bytes are the canonical form of what they say: parsed, as an object of this schema if one is given, and written
    again, they are the same. Text that isn't JSON, has other keys than the schema, another order of keys, blanks or other
    spellings is not."""
    if schema is None:
        return F.coalesce(canonical_text(text) == text, F.lit(False))
    kind = T.StructType.fromDDL(schema)
    for f in kind.fields:
        _refuse(f.dataType, f.name)
    return F.coalesce(_escaped(F.to_json(_sorted(F.from_json(text, kind), kind), {"ignoreNullFields": "false"})) == text, F.lit(False))


def validate_records(df: DataFrame, schema_name: str, digests: list[str], optional_digests: list[str], whole_numbers: list[str], fields: str | None = None) -> DataFrame:
    """df (canonical text, fields) with reason: the first failing check, or 'ok'. fields: the schema of the record, whose text has
    to come out the same when parsed and written again."""
    checks = [(is_canonical(F.col("canonical"), fields), "canonical")] if fields else []
    checks += [(F.get_json_object("canonical", "$.schema") == schema_name, "schema"), (F.length(F.coalesce("did", F.lit(""))) > 0, "did")]
    checks += [(is_sha256_hex(F.col(d)), d) for d in digests]
    checks += [((F.coalesce(d, F.lit("")) == "") | is_sha256_hex(F.col(d)), d) for d in optional_digests]
    checks += [(F.col(n).cast("string").rlike("^-?[0-9]+$"), n) for n in whole_numbers]
    return df.withColumn("reason", first_failing(checks))


def first_failing(checks: list[tuple[Column, str]], ok: str = "ok") -> Column:
    """The name of the first check that is false or null."""
    return F.coalesce(*[F.when(~F.coalesce(good, F.lit(False)), name) for good, name in checks], F.lit(ok))


def verify_digests(payloads: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """key, reason: missing_payload, missing_claim, malformed_claim, mismatch or ok. payloads: key, content; claims: key, claimed."""
    both = payloads.select(key, "content").join(claims.select(key, "claimed"), key, "full_outer")
    checks = [(F.col("content").isNotNull(), "missing_payload"), (F.col("claimed").isNotNull(), "missing_claim"), (is_sha256_hex(F.col("claimed")), "malformed_claim"), (F.sha2("content", 256) == F.lower(F.trim("claimed")), "mismatch")]
    return both.select(key, first_failing(checks).alias("reason"))


#: Kinds of records in the order in which their failures are reported.
RECORD_KINDS = ("dp_record", "anchor", "model_delta", "report")


def verify_records(payloads: DataFrame, claims: DataFrame, ledger: DataFrame, keys: list[str], kinds: tuple[str, ...] = RECORD_KINDS) -> DataFrame:
    """keys, reason: for each client's round the first failing check over its records, kinds in their order, or 'ok'; the privacy
    record's digest is held against the ledger too. payloads: keys, kind, content; claims: keys, kind, claimed; ledger: keys,
    dp_record_sha256. A reason is kind:missing_payload, :missing_claim, :malformed_claim, :mismatch or dp_record:not_in_ledger,
    dp_record:ledger_mismatch. One grouped pass over both sides; a client with nothing claimed is reported as well."""
    last = F.struct(F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("claimed"))
    rows = payloads.select(*keys, "kind", F.col("content").cast("string").alias("content"), last["claimed"].alias("claimed")).unionByName(claims.select(*keys, "kind", last["content"].alias("content"), "claimed"))
    rows = rows.unionByName(ledger.select(*keys, F.lit("ledger").alias("kind"), last["content"].alias("content"), F.col("dp_record_sha256").alias("claimed")))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = rows.groupBy(*keys).agg(*[of(k, "content").alias(f"{k}_content") for k in kinds], *[of(k, "claimed").alias(f"{k}_claimed") for k in (*kinds, "ledger")])
    checks = []
    for k in kinds:
        content, claimed = F.col(f"{k}_content"), F.col(f"{k}_claimed")
        checks += [(content.isNotNull(), f"{k}:missing_payload"), (claimed.isNotNull(), f"{k}:missing_claim"), (is_sha256_hex(claimed), f"{k}:malformed_claim"), (F.sha2(content, 256) == F.lower(F.trim(claimed)), f"{k}:mismatch")]
        if k == "dp_record":
            checks += [(F.col("ledger_claimed").isNotNull(), f"{k}:not_in_ledger"), (F.lower(F.trim("ledger_claimed")) == F.lower(F.trim(claimed)), f"{k}:ledger_mismatch")]
    return wide.select(*keys, first_failing(checks).alias("reason"))


def admission_gate(updates: DataFrame, length: int) -> DataFrame:
    """updates with reason and eligible. The signed RSU and round are held against the receiving ones."""
    checks = [
        (F.size("q_anchor") == length, "bad_vector"), (is_sha256_hex(F.col("delta_sha256")), "bad_digest"), (F.col("delta_bytes") > 0, "missing_material"),
        (F.col("has_key") & F.col("has_signature"), "missing_material"), (F.col("signature_ok"), "bad_signature"),
        (F.col("signed_rsu") == F.col("rsu_id"), "cross_rsu"), (F.col("signed_round") == F.col("round"), "stale_round"),
    ]
    return updates.withColumn("reason", first_failing(checks)).withColumn("eligible", F.col("reason") == "ok")


def _upwards(h: Column, levels: int) -> Column:
    """The node above, `levels` times, with 32 zero bytes on the right."""
    if levels < 1:
        return h
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), h, lambda h, _: F.sha2(F.concat(F.unhex(h), F.unhex(F.lit(ZERO_LEAF))), 256))


def _parent(x: Column) -> Column:
    """The node above places 2x and 2x + 1 of the level l."""
    return F.sha2(F.concat(F.unhex(F.get("l", x * 2)), F.unhex(F.coalesce(F.get("l", x * 2 + 1), F.lit(ZERO_LEAF)))), 256)


#: Levels of the tree that one task computes from leaves that are neighbours.
CHUNK_LEVELS = 10


def merkle_root(records: DataFrame, by: tuple[str, ...], order: list[str], content: str, depth: int = 32, groups: DataFrame | None = None) -> DataFrame:
    """by, leaves, root: leaf = sha256(content), pairs by order, a missing right side is 32 zero bytes, `depth` levels. Each round
    collects the up to 2^CHUNK_LEVELS leaves of a subtree into one row and folds them there, so a few rounds reach the root;
    the rest is a chain of expressions. No leaves are one zero leaf: with groups (by), or without `by`, such a root stands too."""
    leaves = records.select(*by, *order, F.sha2(F.col(content), 256).alias("h"))
    nodes = bucketed_rank(leaves, order, by, out="i").select(*by, "h", (F.col("i") - 1).alias("i"))
    sizes = nodes.groupBy(*by).agg(F.count("*").alias("leaves"))
    most = sizes.agg(F.max("leaves")).first()[0] or 0
    levels = min(depth, max(most - 1, 0).bit_length())
    done = 0
    while done < levels:
        step = min(CHUNK_LEVELS, levels - done)
        size = 1 << step
        listed = nodes.groupBy(*by, F.floor(F.col("i") / size).alias("p")).agg(F.sort_array(F.collect_list(F.struct((F.col("i") % size).alias("k"), "h"))).alias("l"))
        # leaves of a subtree are neighbours from its left end, so only its right end can be empty
        level = listed.select(*by, "p", F.transform("l", lambda x: x["h"]).alias("l"))
        for _ in range(step):
            level = level.withColumn("l", F.transform(F.sequence(F.lit(0), F.ceil(F.size("l") / 2).cast("int") - 1), _parent))
        nodes = level.select(*by, F.col("p").alias("i"), F.get("l", F.lit(0)).alias("h"))
        done += step
    roots = nodes.where("i = 0").select(*by, _upwards(F.col("h"), depth - levels).alias("root"))
    none = _upwards(F.lit(ZERO_LEAF), depth)
    if not by:
        return sizes.join(roots, how="left").select(F.coalesce("root", none).alias("root"), "leaves")
    out = join_keys(roots, sizes, list(by))
    if groups is None:
        return out
    return join_keys(groups.select(*by).distinct(), out, list(by), "left").select(*by, F.coalesce("root", none).alias("root"), F.coalesce("leaves", F.lit(0)).alias("leaves"))


def audit_roots(manifests: DataFrame, records: DataFrame, by: tuple[str, ...], order: list[str], content: str, depth: int = 32) -> DataFrame:
    """by, reason: manifests (by, root, body, body_sha256) against roots made anew and the body's own digest."""
    made = merkle_root(records, by, order, content, depth).withColumnRenamed("root", "_made")
    both = join_keys(manifests, made, list(by), "left")
    return both.select(*by, first_failing([(F.col("_made").isNotNull(), "no_records"), (F.col("_made") == F.col("root"), "root_mismatch"), (F.sha2("body", 256) == F.col("body_sha256"), "body_mismatch")]).alias("reason"))


SECRET_KEYS = r"(?i)(password|passwd|secret|api[_-]?key|private[_-]?key|access[_-]?token|mnemonic)"
MASKED = r"(?i)^(\*+|x+|<.*>|redacted|masked|none|null|)$"
SECRET_ASSIGNMENT = r"(?i)\b(password|passwd|secret|api[_-]?key|private[_-]?key|access[_-]?token|token)\b\s*[:=]\s*[\"']?([^\s\"',;]{4,})"
ABSOLUTE_PATH = r"(?:^|[\s\"'=(])((?:/(?:home|Users|root|mnt|var|tmp)/|[A-Za-z]:\\\\)[^\s\"',;)]+)"


# Phrases that an unfinished text still holds, and annotations that a chat tool leaves behind.
STALE_PHRASES = ["PRIVATE STAGING PACKAGE", "DO NOT PUBLISH YET", "Add exact quick/full reproduction commands"]
CONTENT_REFERENCE = r":contentReference\[[^\]\r\n]*\]\s*\{"


def scan_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, rule, n: secret-like assignments with unmasked values, absolute paths, stale phrases and content references in free text."""
    values = F.filter(F.regexp_extract_all(text, F.lit(SECRET_ASSIGNMENT), 2), lambda v: ~v.rlike(MASKED))
    paths = F.regexp_extract_all(text, F.lit(ABSOLUTE_PATH), 1)
    stale = sum((F.coalesce(F.contains(F.col(text), F.lit(p)), F.lit(False)).cast("int") for p in STALE_PHRASES), F.lit(0))
    rules = {"secret_assignment": F.size(values), "absolute_path": F.size(paths), "stale_phrase": stale, "content_reference": F.regexp_count(text, F.lit(CONTENT_REFERENCE))}
    found = df.where(F.col(text).isNotNull()).select(key, *[c.cast("int").alias(n) for n, c in rules.items()]).unpivot(key, list(rules), "rule", "n")
    return found.where("n > 0")


#: Depths of JSON that one job opens.
OPENED = 8


def scan_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, path: JSON keys of any depth with a secret-like name and an unmasked value. Texts are parsed once into variants and dealt
    to as many tasks as a shuffle has, as a small file may hold many; each step opens all objects and lists of one depth, and
    what it finds goes through the others. A job takes OPENED steps, until none has anything left to open. Text that isn't
    JSON, or has a name twice in one object, has none."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t is not null").repartition(tasks)
    level = texts.select("_k", F.lit("$").alias("_path"), F.try_parse_json("_t").alias("_v")).where("_v is not null")
    found = []
    while True:
        level = level.withColumn("_hit", F.lit(False))
        for _ in range(OPENED):
            # a value that is found is null from then on, and a null, like a scalar, opens into one row without a place
            opened = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer())).where("_hit or pos is not null")
            name, value = F.col("key"), F.try_variant_get("value", "$", "string")
            path = F.when(F.col("_hit"), F.col("_path")).when(name.isNull(), F.concat("_path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("_path", F.lit("."), "key"))
            scalar = ~F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<")
            hit = F.col("_hit") | F.coalesce(name.isNotNull() & name.rlike(SECRET_KEYS) & scalar & value.isNotNull() & ~value.rlike(MASKED), F.lit(False))
            level = opened.select("_k", path.alias("_path"), F.col("value").alias("_v"), hit.alias("_hit")).withColumn("_v", F.when(~F.col("_hit"), F.col("_v")))
        kept = stored(level, "opened")
        found.append(kept.where("_hit").select(F.col("_k").alias(key), F.col("_path").alias("path")))
        level = kept.where("not _hit").drop("_hit")
        if not level.limit(1).count():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def checksum_lines(lines: DataFrame, own_name: str = "checksums.sha256") -> DataFrame:
    """source, line_no, sha256, path, problem: malformed, self_reference, unsafe_path, duplicate or none. lines: source, line_no, line."""
    sha, path = F.regexp_extract("line", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", 1), F.regexp_extract("line", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", 2)
    parsed = lines.select("source", "line_no", F.lower(sha).alias("sha256"), path.alias("path"))
    again = F.row_number().over(W.partitionBy("source", "path").orderBy("line_no")) > 1
    problem = F.when(F.col("path") == "", "malformed").when(F.substring_index("path", "/", -1) == own_name, "self_reference").when(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:"), "unsafe_path").when(again, "duplicate").otherwise("none")
    return parsed.withColumn("problem", problem)


def compare_inventories(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status: duplicate, missing, unlisted, mismatch, match. Both sides: path, sha256."""
    e = expected.groupBy("path").agg(F.min("sha256").alias("want"), F.count("*").alias("_n"))
    a = actual.groupBy("path").agg(F.min("sha256").alias("have"))
    status = F.when(F.col("_n") > 1, "duplicate").when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") != F.col("have"), "mismatch").otherwise("match")
    return e.join(a, "path", "full_outer").select("path", status.alias("status"))


MIB = 1 << 20


def file_rules(inventory: DataFrame, required: list[str], forbidden: list[str], warn: int = 50 * MIB, fail: int = 100 * MIB, longest: int = 240) -> DataFrame:
    """path, problem: required files that are missing, forbidden patterns, files too large, paths too long."""
    spark = inventory.sparkSession
    bad = F.lit(False)
    for pattern in forbidden:
        bad = bad | F.col("path").rlike(pattern)
    problem = F.when(bad, "forbidden").when(F.col("size_bytes") > fail, "too_large").when(F.col("size_bytes") > warn, "large").when(F.length("path") > longest, "long_path")
    found = inventory.select("path", problem.alias("problem")).where("problem is not null")
    want = spark.createDataFrame([(p,) for p in required], "path string")
    return found.unionByName(want.join(inventory, "path", "left_anti").select("path", F.lit("missing").alias("problem")))


def field_agreement(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """keys, field, status: equal, different, unresolved (a side has none), for each named pair of fields, compared as text."""
    l, r = left.alias("l"), right.alias("r")
    both = l.join(r, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys], "full_outer")
    pairs = F.array(*[F.struct(F.lit(a).alias("field"), F.col(f"l.{a}").cast("string").alias("x"), F.col(f"r.{b}").cast("string").alias("y")) for a, b in fields.items()])
    long = both.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], F.explode(pairs).alias("p"))
    return long.select(*keys, "p.field", F.when(F.col("p.x").isNull() | F.col("p.y").isNull(), "unresolved").when(F.col("p.x") == F.col("p.y"), "equal").otherwise("different").alias("status"))


def vector_agreement(df: DataFrame, keys: list[str], expected: str, actual: str, names: list[str] | None = None) -> DataFrame:
    """keys, index, name, expected, actual: every place where two ordered vectors differ, lengths included."""
    at = F.posexplode(F.arrays_zip(F.col(expected).alias("e"), F.col(actual).alias("a")))
    out = df.select(*keys, at.alias("index", "z")).where(~F.col("z.e").eqNullSafe(F.col("z.a")))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("index")) if names else F.lit(None).cast("string")
    return out.select(*keys, "index", name.alias("name"), F.col("z.e").alias("expected"), F.col("z.a").alias("actual"))


def run_contract(configs: DataFrame, expected: DataFrame, fields: list[str], metrics: list[str]) -> DataFrame:
    """run, check, ok: fields equal to the contract's row of the run's dataset, metrics there and in [0, 1], gate passed."""
    e = expected.select("dataset", *[F.col(f).alias(f"_e_{f}") for f in fields if f != "dataset"])
    both = configs.join(e, "dataset", "left")
    checks = [(f, F.col(f).eqNullSafe(F.col(f"_e_{f}"))) for f in fields if f != "dataset"]
    checks += [(m, F.coalesce(F.col(m).between(0, 1), F.lit(False))) for m in metrics] + [("gate", F.coalesce("gate_passed", F.lit(False)))]
    return both.select("run", F.explode(F.array(*[F.struct(F.lit(n).alias("check"), c.alias("ok")) for n, c in checks])).alias("c")).select("run", "c.check", "c.ok")


def paired_inputs(manifests: DataFrame) -> DataFrame:
    """dataset, seed, methods, same_inputs: whether all methods of a seed used the same split digests."""
    return manifests.groupBy("dataset", "seed").agg(F.count_distinct("method").alias("methods"), (F.count_distinct("digest") == 1).alias("same_inputs"))


def receipt_fees(receipts: DataFrame) -> DataFrame:
    """receipts with fee = gas used x effective price (the legacy price where that is missing), exact."""
    price = F.coalesce("effective_gas_price", "gas_price").cast("decimal(38,0)")
    return receipts.withColumn("fee", (F.col("gas_used").cast("decimal(18,0)") * price.cast("decimal(19,0)")).cast("decimal(38,0)"))


def receipt_costs(receipts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, statistics of fees, failures with a Wilson interval."""
    priced = receipt_fees(receipts).withColumn("fee", F.col("fee").cast("double"))
    failures = priced.groupBy(*by).agg(F.count("*").alias("sent"), F.count_if(F.col("status") != 1).alias("failed"))
    return describe_nearest_rank(priced, "fee", by).join(wilson_interval(failures, "failed", "sent"), list(by))


def finality_latency(receipts: DataFrame, heads: DataFrame) -> DataFrame:
    """tx_id, final_at, receipt_to_final, start_to_final (seconds, not negative), timed_out. heads: block,
    seen_at. The earliest sight of a head at or above each block is a minimum over what follows it, inside a bucket of blocks
    and over the later buckets; no receipt is joined with more than one row."""
    seen = heads.groupBy("block").agg(F.min("seen_at").alias("seen_at"))
    blocks = seen.unionByName(receipts.select("block").where("block is not null").distinct().withColumn("seen_at", F.lit(None).cast(seen.schema["seen_at"].dataType)))
    each = stored(blocks.groupBy("block").agg(F.min("seen_at").alias("seen_at")), "blocks")
    dealt = placed(each, ["block"], each.count())
    later = dealt.groupBy("_bucket").agg(F.min("seen_at").alias("s")).select("_bucket", F.min("s").over(W.orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
    inside = F.min("seen_at").over(W.partitionBy("_bucket").orderBy(F.col("block").desc()))
    first = dealt.withColumn("_here", inside).join(later, "_bucket").select("block", F.least("_here", "_later").alias("final_at"))
    met = receipts.select("tx_id", "started_at", "receipt_at", "block").join(first, "block", "left")
    gap = lambda a: F.greatest(F.lit(0).cast("long"), F.unix_timestamp("final_at") - F.unix_timestamp(a))
    return met.select("tx_id", "final_at", gap("receipt_at").alias("receipt_to_final"), gap("started_at").alias("start_to_final"), F.col("final_at").isNull().alias("timed_out"))


def receipt_latency(receipts: DataFrame, heads: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, span (start_to_receipt, receipt_to_final, start_to_final), the statistics of its seconds over receipts that have it, and
    timed_out: receipts that never became final."""
    met = receipts.select("tx_id", *by).join(finality_latency(receipts, heads), "tx_id").join(receipts.select("tx_id", (F.unix_timestamp("receipt_at") - F.unix_timestamp("started_at")).alias("start_to_receipt")), "tx_id")
    seconds = lambda c: F.when(~F.col("timed_out"), F.col(c)) if c.endswith("final") else F.col(c)
    spans = F.array(*[F.struct(F.lit(c).alias("span"), seconds(c).cast("double").alias("seconds")) for c in ("start_to_receipt", "receipt_to_final", "start_to_final")])
    long = met.select(*by, "timed_out", F.explode(spans).alias("s")).select(*by, "timed_out", "s.span", "s.seconds")
    out = describe_nearest_rank(long, "seconds", (*by, "span"))
    return join_keys(out, long.groupBy(*by, "span").agg(F.count_if("timed_out").alias("timed_out")), [*by, "span"])


def submission_checks(receipts: DataFrame, expected: int) -> DataFrame:
    """check, passed, failed over all receipts, and whether their number is as expected."""
    checks = {"submitted": F.col("tx_hash").isNotNull(), "mined": F.col("block").isNotNull(), "status": F.col("status") == 1, "verified": F.col("verified"), "hash_shape": F.col("tx_hash").rlike("^0x[0-9a-f]{64}$")}
    rows = receipts.agg(F.count("*").alias("_n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    long = rows.unpivot("_n", list(checks), "check", "passed").select("check", "passed", (F.col("_n") - F.col("passed")).alias("failed"))
    total = rows.select(F.lit("count").alias("check"), F.col("_n").alias("passed"), F.abs(F.col("_n") - expected).alias("failed"))
    return long.unionByName(total)
