"""Merkle manifest of a dataset: a root over all rows, and for each row the proof that it is in.

Rows are leaves of one tree for each group; the groups' roots are leaves of one more tree. Leaves are ranked inside their
group and cut into partitions of fanout^b neighbours. A partition hashes its own subtree. Then partitions exchange roots
as in a butterfly: in round r the aligned group of `fanout` partitions that differ in the r-th digit of their number swap
what they hold, and each of them hashes their common ancestor itself. What a partition receives are the siblings on its
way up, so after the last round it has the upper part of all its leaves' proofs, and nothing has to be passed down. A
group's partitions are filled up to a power of the fanout by some without leaves, which take part in the exchange, so that
at a ragged end, too, every partition has a partner that knows the sibling. A round is one shuffle of the small table of
partitions; rows of text are read once.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.llm.common import table
from tarnsift.operators.primitives import bucketed_rank, join_keys
from tarnsift.sources.shared import stored

#: Leaves of a partition, at most: what one task hashes at once.
PARTITION_LEAVES = 4096
#: Rows that one task ranks, about, and rounds after which the table of partitions is written.
BUCKET_ROWS, ROUNDS = 1 << 14, 8
_PATH = "array<struct<l:string,r:string>>"


def leaf_hash(fields: list[Column]) -> Column:
    """Lower-case hex sha256 of the values: - for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(leaves: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """The nodes of each level from the leaves up: `levels` more of them, or until one node remains. A run of fewer than fanout
    nodes at the end, even of one, becomes a node as the others do."""
    out = [leaves]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        last = out[-1]
        out.append([_h("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return out


def _height(fanout: int, partition_leaves: int) -> int:
    b = 1
    while fanout ** (b + 1) <= partition_leaves:
        b += 1
    return b


def _subtrees(ranked: DataFrame, fanout: int, height: int) -> DataFrame:
    """g, part, h: the root of each partition's own subtree. A group of one partition stops where one node remains."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = pdf.sort_values("i")["leaf"].tolist()
        return pd.DataFrame({"g": [key[0]], "part": [key[1]], "h": [levels_of(leaves, fanout, height if key[1] else None)[-1][0]]})

    return ranked.select("g", "part", "i", "leaf").groupBy("g", "part").applyInPandas(fold, "g string, part long, h string")


def _butterfly(subtrees: DataFrame, fanout: int) -> DataFrame:
    """g, part, path, root: for each partition with leaves the siblings (left and right of its own ancestor) from its subtree's root up
    to the group's root, and that root."""
    sizes = stored(subtrees.groupBy("g").agg(F.count("*").alias("parts")), "sizes")
    most = sizes.agg(F.max("parts")).first()[0] or 0
    rounds = 0
    while fanout**rounds < most:
        rounds += 1
    full = F.lit(1).cast("long")
    for _ in range(rounds):
        full = F.when(full < F.col("parts"), full * fanout).otherwise(full)
    real = join_keys(subtrees, sizes.withColumn("full", full), ["g"])
    empty = sizes.withColumn("full", full).where("full > parts").select("g", F.explode(F.sequence(F.col("parts"), F.col("full") - 1)).alias("part"), F.lit(None).cast("string").alias("h"), "parts", "full")
    state = real.select("g", "part", "h", "parts", "full").unionByName(empty).withColumn("path", F.array().cast(_PATH))
    for r in range(rounds):
        step = fanout**r
        digit = F.floor(F.col("part") / step) % fanout
        partners = F.when(F.col("full") > step, F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda d: F.col("part") + (d - digit) * step)).otherwise(F.array("part"))
        sent = state.withColumn("digit", digit).withColumn("to", F.explode(partners))
        own = F.when(F.col("to") == F.col("part"), F.struct("path", "digit", "h", "parts", "full"))
        got = sent.groupBy("g", "to").agg(F.first(own, ignorenulls=True).alias("own"), F.sort_array(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("digit", "h")))).alias("run"))
        text = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["h"]), "")
        beside = F.struct(text(lambda x: x["digit"] < F.col("own.digit")).alias("l"), text(lambda x: x["digit"] > F.col("own.digit")).alias("r"))
        still = F.col("own.full") > step
        state = got.select(
            "g", F.col("to").alias("part"), F.when(~still, F.col("own.h")).when(F.size("run") > 0, F.sha2(text(lambda x: F.lit(True)), 256)).alias("h"), "own.parts", "own.full",
            F.when(still, F.concat("own.path", F.array(beside))).otherwise(F.col("own.path")).alias("path"),
        )
        if r % ROUNDS == ROUNDS - 1:
            state = stored(state, "rounds")
    return state.where("part < parts").select("g", "part", "path", F.col("h").alias("root"))


def _in_partitions(leaves: DataFrame, by: list[str], order: list, fanout: int, height: int) -> DataFrame:
    ranked = bucketed_rank(leaves, order, tuple(by), "i", BUCKET_ROWS)
    return stored(ranked.withColumn("i", F.col("i") - 1).withColumn("part", F.floor(F.col("i") / fanout**height)), "ranked")


def proofs(leaves: DataFrame, fanout: int = 2, partition_leaves: int = PARTITION_LEAVES) -> DataFrame:
    """doc_id, g, leaf, changed, subroot, root, proof_sha256, folded_root, verified for rows doc_id, g, leaf, changed (a leaf to try
    against the proof instead, or null). See `verified`."""
    height = _height(fanout, partition_leaves)
    ranked = _in_partitions(leaves, ["g"], ["doc_id", "leaf"], fanout, height)
    parts = stored(_butterfly(_subtrees(ranked, fanout, height), fanout), "proofs")
    # the groups' roots are the leaves of one more tree, in one group of their own
    roots = parts.where("part = 0").select(F.col("g").alias("doc_id"), F.lit(None).cast("string").alias("g"), F.col("root").alias("leaf"))
    tops = _in_partitions(roots, ["g"], [F.col("doc_id").asc_nulls_first()], fanout, height)
    top_parts = _butterfly(_subtrees(tops, fanout, height), fanout)

    def upper(key, own: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        tree = levels_of(own["leaf"].tolist(), fanout, height if key[1] else None)
        above = [(x["l"], x["r"]) for x in part["path"].iloc[0]]
        return pd.DataFrame({"g": own["doc_id"], "top": [_beside(tree, i, fanout) + above for i in range(len(own))], "top_root": part["root"].iloc[0]})

    top = tops.groupBy("g", "part").cogroup(top_parts.groupBy("g", "part")).applyInPandas(upper, f"g string, top {_PATH}, top_root string")
    ways = join_keys(parts, top, ["g"])

    def fold(key, own: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        own, way = own.sort_values("i"), part.iloc[0]
        tree = levels_of(own["leaf"].tolist(), fanout, height if key[1] else None)
        above = [(x["l"], x["r"]) for x in [*way["path"], *way["top"]]]
        digests, folded = [], []
        for i, (leaf, changed) in enumerate(zip(own["leaf"], own["changed"])):
            path = _beside(tree, i, fanout) + above
            digests.append(_h("".join(left + right for left, right in path)))
            node = changed if isinstance(changed, str) else leaf
            for left, right in path:
                node = _h(left + node + right)
            folded.append(node)
        out = own[["doc_id", "g", "leaf", "changed"]].assign(subroot=way["root"], root=way["top_root"], proof_sha256=digests, folded_root=folded)
        return out.assign(verified=out["folded_root"] == out["root"])

    fields = "doc_id long, g string, leaf string, changed string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return ranked.groupBy("g", "part").cogroup(ways.groupBy("g", "part")).applyInPandas(fold, fields)


def _beside(tree: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    """Siblings left and right of leaf i's ancestor on each level below the top one."""
    out = []
    for level in tree[:-1]:
        run = i // fanout * fanout
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
        i //= fanout
    return out


def verified(docs: DataFrame, fields: list[str], by: str, fanout: int = 2, change: Column | None = None, changed_fields: list[Column] | None = None, partition_leaves: int = PARTITION_LEAVES) -> DataFrame:
    """doc_id, g, leaf, changed, subroot, root, proof_sha256, folded_root, verified: every row of docs in the manifest of all.

    A leaf is `leaf_hash` of the fields. Inside each value of `by` leaves ascend by doc_id (null last; rows of one doc_id by
    their hash); every `fanout` nodes become one until one remains, the subroot (a lone leaf itself). Subroots, by the
    value of `by` in UTF-8 order, null first, give the root likewise. proof_sha256 is the hash of all siblings, level by
    level up to the root, left to right. Where `change` holds, the leaf is made of changed_fields instead and folded with the
    original siblings; verified: whether that gives the root. Repeated rows are leaves of their own, null fields are
    hashed as such, and no rows give no rows; other columns of docs take no part.
    """
    changed = F.when(change, leaf_hash(changed_fields)) if change is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(by).cast("string").alias("g"), leaf_hash([F.col(f) for f in fields]).alias("leaf"), changed.alias("changed"))
    return proofs(stored(leaves, "leaves"), fanout, partition_leaves)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = [(F.col(f).cast("decimal(20,0)") + 1).cast("decimal(20,0)") if f == "n_chars" else F.col(f) for f in fields]
    tried = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return verified(docs, fields, "lang", change=tried, changed_fields=more).drop("g", "changed")


def _nibble(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


#: CRC32 of the decimal doc_id in SQL, four bits at a time.
_CRC = f"""xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [(ord(c) & 15)::BIGINT, (ord(c) >> 4)::BIGINT])),
  lambda a, x: xor({[_nibble(i) for i in range(16)]}[(xor(a, x) & 15) + 1]::BIGINT, a >> 4), 4294967295::BIGINT), 4294967295)"""

ORACLE_SQL = """
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('x' || lang, '') AS g, crc AS tried, sha256(a || n || b) AS leaf, sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || b) AS other
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
               coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen(text) || ':' || text, '-') AS b, {crc} % 7 = 0 AS crc FROM documents)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i FROM leaf
), tree AS (
  SELECT g, 0 AS lv, i, leaf AS h FROM ranked
  UNION ALL
  SELECT g, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM tree) WHERE c > 1 GROUP BY g, lv, i // 2
), sub AS (
  SELECT g, max(lv) AS depth, arg_max(h, lv) AS h FROM tree GROUP BY g
), top AS (
  SELECT 0 AS lv, row_number() OVER (ORDER BY g) - 1 AS i, h FROM sub
  UNION ALL
  SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM top) WHERE c > 1 GROUP BY lv, i // 2
), fold AS (
  SELECT doc_id, g, 0 AS lv, i, CASE WHEN tried THEN other ELSE leaf END AS h, leaf, '' AS proof FROM ranked
  UNION ALL
  SELECT f.doc_id, f.g, f.lv + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END), f.leaf, f.proof || coalesce(s.h, '')
  FROM fold f JOIN sub ON sub.g = f.g AND f.lv < sub.depth LEFT JOIN tree s ON s.g = f.g AND s.lv = f.lv AND s.i = xor(f.i, 1)
), up AS (
  SELECT f.doc_id, f.g, 0 AS lv, t.i, f.h, f.leaf, f.proof FROM fold f JOIN sub ON sub.g = f.g AND f.lv = sub.depth JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM sub) t ON t.g = f.g
  UNION ALL
  SELECT f.doc_id, f.g, f.lv + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END), f.leaf, f.proof || coalesce(s.h, '')
  FROM up f LEFT JOIN top s ON s.lv = f.lv AND s.i = xor(f.i, 1) WHERE f.lv < (SELECT max(lv) FROM top)
), ends AS (SELECT max(lv) AS lv, arg_max(h, lv) AS root FROM top)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, up.h AS folded_root, up.h = root AS verified
FROM up JOIN ends ON up.lv = ends.lv JOIN sub USING (g)
""".replace("{crc}", _CRC)
