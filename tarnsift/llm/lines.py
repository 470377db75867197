"""Line dedup: lines that stand in many documents go, but for the last document that holds them.

Every document is exploded into its normalised lines, a line's key is hashed to 128 bits, and the documents of each hash
are counted. A hash of enough documents drops its lines by their position, and the text is put together again from the
positions that are left. Hashes and positions are shuffled, a text only once, to meet its dropped positions.

A hash may hold a large share of all lines. Its count is combined before the shuffle (by hash and document, then by
hash). The few hashes that hold more than a thousandth of all repeated lines each, at most a thousand, are broadcast;
their lines are dealt by their own place in the join that serves the others.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.llm.common import table
from tarnsift.sources.shared import stored

WHITE = " \t\n\x0b\x0c\r"
#: A hash of more than this share of all repeated lines is met by broadcast: fewer than 1 / HOT of them.
HOT = 0.001


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """d, t, pos, h1, h2: document, hash of its text, place and hash of each line whose key is long enough to be judged."""
    text = F.coalesce("text", F.lit(""))
    # hashed and split before the explosion, so that no line carries its text
    whole = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("t"), F.split(text, "\n").alias("lines"))
    each = whole.select("d", "t", F.posexplode("lines").alias("pos", "line"))
    keyed = each.select("d", "t", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"))


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """h1, h2, n_docs, n_lines, last: hashes of keys found in at least min_docs documents, and the greatest doc_id among them."""
    counts = _lines(docs, min_chars).groupBy("h1", "h2").agg(F.count_distinct(F.struct("d")).alias("n_docs"), F.count("*").alias("n_lines"), F.max("d").alias("last"))
    return counts.where(F.col("n_docs") >= min_docs)


def _dropped(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """d, t, gone: positions of the lines that a document loses."""
    repeated = stored(repeated_lines(docs, min_chars, max(min_docs, 2)), "lines")
    total = repeated.agg(F.sum("n_lines")).first()[0] or 0
    is_hot = F.col("n_lines") > total * HOT
    hot = repeated.where(is_hot).select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("last").alias("hot_last"))
    cold = repeated.where(~is_hot).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(False).alias("hot"), "last")
    met = _lines(docs, min_chars).join(F.broadcast(hot), (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")), "left").withColumn("hot", F.col("hot_last").isNotNull())
    dealt = met.select("d", "t", "pos", "hot", "hot_last", F.when(F.col("hot"), F.xxhash64("t", "pos")).otherwise(F.col("h1")).alias("k1"), F.col("h2").alias("k2"))
    last = F.coalesce("hot_last", "last")
    joined = dealt.join(cold, ["k1", "k2", "hot"], "left").where(last.isNotNull() & ~F.col("d").eqNullSafe(last))
    return joined.groupBy("d", "t").agg(F.collect_list("pos").alias("gone"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with text without the lines whose key has at least min_chars code points and stands in at least min_docs (two or more)
    documents, except in the document of the greatest doc_id that holds it; with n_lines (before) and n_dropped.

    Lines end at \\n only; lines that stay are joined by \\n as they are. Null or empty text is one empty line, and the
    text of a document that loses all lines is empty. Rows of one doc_id are one document, also those of null, which comes
    before all others; each row keeps its own text. A line that stands several times in one document counts as one and goes
    or stays as a whole. Columns of docs named n_lines and n_dropped are replaced, all others kept; no rows give no rows.
    """
    text = F.coalesce("row.text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).withColumn("t", F.xxhash64(text))
    met = rows.join(_dropped(docs, min_chars, min_docs).withColumnRenamed("t", "t_"), F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("t_")), "left")
    split = met.select("row", F.split(text, "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # array_except looks positions up in a hash set and keeps their order: linear in the lines, whatever is gone
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    made = split.select("row", "lines", left.alias("left"))
    kept = F.when(F.size("left") == F.size("lines"), F.col("row.text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    return made.select(*others, F.coalesce(kept, F.lit("")).alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, u.i, string_split(coalesce(text, ''), chr(10))[u.i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) u(i)
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, i, line, coalesce(r.last <> k.doc_id, false) AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
