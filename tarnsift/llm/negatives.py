"""Hard-negative mining with segment summaries.

For every vector the mean and the deviation of each of its segments are kept. Over a segment of w components the inner
product of two vectors is w times the product of the means plus a rest, which by Cauchy and Schwarz is at most the product
of the deviations (here: lengths of what is left when the mean is taken away) and at least minus that. Summed over the
segments this bounds a score from both sides. Bounds are taken for few wide segments first; pairs that may still matter are
looked at again with segments of half the width, down to width 2, and what is left is scored exactly.

A negative must lie in a band under its positive's score, so mining takes two passes: the positives of every anchor, then
the negatives under each positive. The anchors are a stated part of the rows and meet all rows in blocks; a task holds one
block of anchors and one of candidates, and returns a few rows for an anchor. Only candidates that could displace what
an anchor has found so far survive the bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnsift.llm.common import table
from tarnsift.llm.topk import whole_vectors
from tarnsift.sources.shared import stored

CANDIDATES, ANCHORS, QUERIES, STEP = 8192, 16384, 128, 2048
_FOUND = "key long, cut long, vec_id long, score long, pairs long, scored long"


def widths(dim: int) -> list[int]:
    """Segment widths from wide to narrow: about a quarter of the vector, halved down to 2."""
    out, w = [], max(2, dim // 4)
    while w >= 2:
        out.append(w)
        w //= 2
    return out


def summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each width the scaled means and deviations of all segments: with a = sqrt(w) * mean and s = |rest|, the inner product of
    two vectors lies within a.a' - s.s' and a.a' + s.s'."""
    out = []
    for w in widths(x.shape[1]):
        starts = np.arange(0, x.shape[1], w)
        n = np.diff(np.append(starts, x.shape[1]))
        sums = np.add.reduceat(x, starts, axis=1)
        squares = np.add.reduceat(x * x, starts, axis=1)
        out.append((sums / np.sqrt(n), np.sqrt(np.maximum(squares - sums * sums / n, 0))))
    return out


def scored_pairs(q, q_sums, v, v_sums, low, high, wanted, slack: float):
    """(i, j, score, evaluated): pairs of rows of q and v that are wanted and whose score may be within low and high of their q."""
    cols = np.flatnonzero(wanted.any(axis=0))
    alive = wanted[:, cols]
    for (qa, qs), (va, vs) in zip(q_sums, v_sums):
        if not len(cols):
            break
        middle, rest = qa @ va[cols].T, qs @ vs[cols].T + slack
        alive &= (middle + rest >= low[:, None]) & (middle - rest <= high[:, None])
        some = alive.any(axis=0)
        cols, alive = cols[some], alive[:, some]
    i, j = np.nonzero(alive)
    score = np.asarray(q @ v[cols].T)[i, j] if len(i) else np.empty(0, np.int64)
    return i, cols[j], score, len(i)


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first rows of each group: higher scores first, ties to the smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, int)
    return order[np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g)))) < k]


def search_block(own: pd.DataFrame, others: pd.DataFrame, k: int, same: bool, share: tuple[int, int]) -> pd.DataFrame:
    """key, cut, vec_id, score of the k first candidates for each anchor (same label, cut null) or for each of an anchor's cuts
    (other labels, scores between share[0] / share[1] of the cut and the cut); with pairs met and scored, once for each anchor."""
    q, v = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (own, others))
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    exact = most < 2**53  # then double arithmetic on whole numbers has no rounding
    qq, vv = (q, v) if exact else (q.astype(object), v.astype(object))
    if not exact:
        qq, vv = (np.vectorize(int, otypes=[object])(x) for x in (qq, vv))
    q_sums, v_sums = summaries(q), summaries(v)
    slack = 1e-9 * (1 + most)
    q_id, v_id = own["vec_id"].to_numpy(np.int64), others["vec_id"].to_numpy(np.int64)
    q_label, v_label = own["label"].to_numpy(np.int64), others["label"].to_numpy(np.int64)
    cuts = None if same else [np.array(sorted(set(c), reverse=True), np.int64) for c in own["cuts"]]
    found = []
    for s in range(0, len(q), QUERIES):
        e = min(s + QUERIES, len(q))
        # one row for each anchor, or for each anchor and cut
        row = np.arange(s, e) if same else np.repeat(np.arange(s, e), [len(c) for c in cuts[s:e]])
        top = np.full(len(row), np.inf) if same else np.concatenate([*cuts[s:e], np.empty(0)])
        floor = np.full(len(row), -np.inf) if same else top * share[0] / share[1]
        best = (np.empty(0, int), np.empty(0, int), np.empty(0))
        pairs = scored = 0
        for c in range(0, len(v), STEP):
            part = slice(c, min(c + STEP, len(v)))
            wanted = (q_label[s:e, None] == v_label[None, part]) == same
            if same:
                wanted &= q_id[s:e, None] != v_id[None, part]
            pairs += int(wanted.sum())
            low = np.full(e - s, np.inf)
            np.minimum.at(low, row - s, floor)
            high = np.full(e - s, -np.inf)
            np.maximum.at(high, row - s, top)
            i, j, score, n = scored_pairs(qq[s:e], [(a[s:e], b[s:e]) for a, b in q_sums], vv[part], [(a[part], b[part]) for a, b in v_sums], low, high, wanted, slack)
            scored += n
            if not len(i):
                continue
            # every pair meets all rows of its anchor
            first, times = np.searchsorted(row, i + s), np.bincount(row - s, minlength=e - s)[i]
            at = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            score, j = np.repeat(score, times), np.repeat(j + c, times)
            ok = np.ones(len(at), bool)
            if not same:
                cut = np.concatenate([*cuts[s:e], np.empty(0, np.int64)]).astype(object if not exact else np.int64)[at]
                whole = score if not exact else score.astype(np.int64)
                ok = np.asarray((whole <= cut) & (share[1] * whole >= share[0] * cut), bool)
            merged = [np.concatenate([a, b[ok]]) for a, b in zip(best, (at, j, score))]
            keep = first_of_each(merged[0], merged[2], v_id[merged[1].astype(int)], k)
            best = tuple(a[keep] for a in merged)
            full = np.bincount(best[0].astype(int), minlength=len(row)) >= k
            worst = np.full(len(row), np.inf)
            np.minimum.at(worst, best[0].astype(int), best[2].astype(float))
            floor = np.where(full, np.maximum(floor, worst), floor)
        at, j, score = best[0].astype(int), best[1].astype(int), best[2]
        anchors = row[at]
        out = pd.DataFrame({"key": own["key"].to_numpy()[anchors], "cut": pd.array([None] * len(at), "Int64") if same else pd.array(np.concatenate([*cuts[s:e], np.empty(0, np.int64)]).astype(np.int64)[at], "Int64"), "vec_id": v_id[j], "score": np.array([int(x) for x in score], np.int64)})
        out["pairs"], out["scored"] = 0, 0
        if len(out):
            out.loc[out.index[0], ["pairs", "scored"]] = [pairs, scored]
        found.append(out)
    return pd.concat(found)


def _grid(anchors: DataFrame, rows: DataFrame, k: int, same: bool, share: tuple[int, int], sizes: tuple[int, int]) -> DataFrame:
    """What search_block finds, every block of anchors with every block of rows of their dimension."""
    v_blocks, q_blocks = max(1, -(-rows.count() // sizes[0])), max(1, -(-anchors.count() // sizes[1]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    left = anchors.select("vec_id", "label", "v", "key", "cuts", F.lit(True).alias("anchor"), mine(q_blocks).alias("qb"), every(v_blocks).alias("vb"))
    right = rows.select("vec_id", "label", "v", "key", F.lit(None).cast("array<long>").alias("cuts"), F.lit(False).alias("anchor"), every(q_blocks).alias("qb"), mine(v_blocks).alias("vb"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        is_anchor = pdf["anchor"].to_numpy(bool)
        own, others = pdf[is_anchor], pdf[~is_anchor].sort_values("vec_id", kind="stable")
        if not len(own) or not len(others):
            return pd.DataFrame({c.split()[0]: pd.array([], "Int64") for c in _FOUND.split(", ")})
        return search_block(own, others, k, same, share)

    return left.unionByName(right).withColumn("dim", F.size("v")).groupBy("dim", "qb", "vb").applyInPandas(search, _FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), candidates: int = CANDIDATES, anchor_rows: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both frames: vec_id long, label long, v array<double> of whole numbers, without nulls; other columns take no part.
    An anchor's positives are the first rows of its label; the negatives of a positive the first rows of other labels
    whose score is at most the positive's and at least share[0] / share[1] of it. Higher inner products come first, ties
    by smaller vec_id. Vectors meet those of their own length only. Repeated rows (equal id, label and vector) are one row;
    a row of the anchor's own id is never its positive; different rows of one id are anchors of their own. Positives without
    such a negative (so all under 0) and anchors without positives give no rows, as do empty tables.
    """
    key = F.xxhash64("vec_id", "label", "v")
    rows = stored(rows.select("vec_id", "label", "v").distinct().withColumn("key", key), "rows")
    own = anchors.select("vec_id", "label", "v").distinct().withColumn("key", key).withColumn("cuts", F.lit(None).cast("array<long>"))
    near = stored(_first(_grid(own, rows, positives, True, share, (candidates, anchor_rows)), ["key"], positives).select("key", F.col("vec_id").alias("positive_id"), F.col("score").alias("cut")), "positives")
    cuts = near.where("cut >= 0").groupBy("key").agg(F.collect_set("cut").alias("cuts"))
    banded = stored(own.drop("cuts").join(cuts, "key"), "anchors")
    under = _first(_grid(banded, rows, negatives, False, share, (candidates, anchor_rows)), ["key", "cut"], negatives)
    named = near.join(banded.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return named.join(under, ["key", "cut"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("cut").alias("positive_score"), F.col("score").alias("negative_score"))


def share_scored(rows: DataFrame, anchors: DataFrame, k: int = 5, **sizes) -> float:
    """Of the pairs of an anchor and a row of its label, the share that the bounds did not decide."""
    key = F.xxhash64("vec_id", "label", "v")
    rows, own = rows.withColumn("key", key), anchors.withColumn("key", key).withColumn("cuts", F.lit(None).cast("array<long>"))
    seen = _grid(own, rows, k, True, (80, 100), (sizes.get("candidates", CANDIDATES), sizes.get("anchor_rows", ANCHORS))).agg(F.sum("pairs").alias("p"), F.sum("scored").alias("s")).first()
    return (seen["s"] or 0) / max(1, seen["p"] or 0)


def labelled_vectors(embeddings: DataFrame, scale: int = 256, every: int = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, v: whole vectors of rows with a label; where vec_id is divisible by `every` the label is the next one."""
    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % every == 0, (label + 1) % classes).otherwise(label)
    kept = embeddings.where(F.col("label").isNotNull()).select("vec_id", "embedding", noisy.alias("label"))
    return whole_vectors(kept, scale, ["label"])


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_vectors(table(spark, sf_dir, "embeddings"))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.x, a.label, v.vec_id, a.label = v.label AS same, CAST(list_sum(list_transform(list_zip(a.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND (a.vec_id <> v.vec_id OR a.label <> v.label)
), p AS (
  SELECT anchor_id, x, label, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id, x, label ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.x, p.label, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.x = s.x AND p.label = s.label AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
