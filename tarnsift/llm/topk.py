"""Exact top-k search by inner product with pivot-table elimination.

Pivots are vectors of the table: of a bounded sample, one after the other the one farthest from the span of those
taken, so that none is near a mixture of others. The distances of every vector to all pivots are computed once and
stored beside it. For a query q and a vector v each point p that is a mixture of pivots gives |q - v| >= | |q - p| -
|v - p| |. The table fixes the distances to all such p, so the greatest of these bounds is known: with y the place of
a vector in the pivots' span and r its distance from it (both follow from the table and the vector's length), it is
sqrt(|y_q - y_v|^2 + (r_q - r_v)^2), never under the bound of any single pivot. As q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2,
the score is at most y_q.y_v + r_q * r_v.

A first pass gives every query the k-th score it reaches in the sample; no candidate whose bound lies under it is
looked at in any block. A task holds one block of candidates and one of queries, evaluates candidates in the order of
their bounds and stops when no bound reaches the query's k-th best score. Every block of queries meets every block of
candidates once; a task returns at most k rows for a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnsift.llm.common import table
from tarnsift.sources.shared import stored

CANDIDATES, QUERIES, STEP = 8192, 4096, 512
#: Rows of the sample that pivots come from and that the first pass looks at; share of the dimensions that pivots span.
SAMPLE, SPAN = 4096, 0.875
_FOUND = "query_id long, query_key long, vec_id long, score long, n long, evaluated long"


def pivot_vectors(sample: np.ndarray, pivots: int) -> np.ndarray:
    """At most `pivots` rows of the sample, each the one farthest from the span of those before it; fewer if the rest is in the span."""
    rest = sample.astype(np.float64).copy()
    length = np.linalg.norm(sample, axis=1).max(initial=0)
    taken = []
    while len(taken) < min(pivots, sample.shape[1]) and len(rest):
        far = np.linalg.norm(rest, axis=1)
        i = int(far.argmax())
        if far[i] <= 1e-3 * length:
            break
        taken.append(i)
        unit = rest[i] / far[i]
        rest -= np.outer(rest @ unit, unit)
    return sample[taken].astype(np.float64)


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * v @ pivots.T, 0))


def places(table_rows: np.ndarray, squares: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(y, r) of each vector: its place in the span of the pivots and its distance from the span, from its distances to them."""
    if not len(pivots):
        return np.sqrt(squares)[:, None]
    inner = (squares[:, None] + (pivots * pivots).sum(1) - table_rows * table_rows) / 2
    y = np.linalg.solve(np.linalg.cholesky(pivots @ pivots.T), inner.T).T
    return np.hstack([y, np.sqrt(np.maximum(squares - (y * y).sum(1), 0))[:, None]])


def best_of_block(q_id, q, q_place, floor, v_id, v, v_place, k: int, step: int = STEP):
    """(query position, vector position, score) of each query's k best in this block among scores of at least its floor, ties
    to the smaller id; and how many candidates each query was evaluated against."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    exact = most < 2**53  # then double arithmetic on integers has no rounding
    qq, vv = (q, v) if exact else (q.astype(np.int64).astype(object), v.astype(np.int64).astype(object))
    order = np.argsort(v_id, kind="stable")
    v_id, vv, v_place = v_id[order], vv[order], v_place[order]
    slack = 1e-6 * (1 + (q * q).sum(1).max(initial=0) + (v * v).sum(1).max(initial=0))
    out, evaluated = [], np.zeros(len(q), np.int64)
    for s in range(0, len(q), 64):
        e = min(s + 64, len(q))
        bound = q_place[s:e] @ v_place.T + slack
        bound[v_id[None, :] == q_id[s:e, None]] = -np.inf  # never a row of the query's own id
        bound[bound < floor[s:e, None]] = -np.inf
        top = bound.max(axis=0)  # of the candidate for any query of these
        by_bound = np.argsort(-top, kind="stable")
        by_bound = by_bound[: np.count_nonzero(top > -np.inf)]
        best_s = np.full((e - s, 0), -np.inf)
        best_v = np.zeros((e - s, 0), np.int64)
        for c in range(0, len(by_bound), step):
            part = by_bound[c : c + step]
            wanted = bound[:, part] > -np.inf
            if best_s.shape[1] >= k:
                worst = best_s.min(axis=1)
                if not (bound[:, by_bound[c:]] >= worst[:, None]).any():
                    break
                wanted &= bound[:, part] >= worst[:, None].astype(float)
            some = wanted.any(axis=0)
            if not some.any():
                continue
            part, wanted = part[some], wanted[:, some]
            evaluated[s:e] += wanted.sum(axis=1)
            score = (qq[s:e] @ vv[part].T)
            score[~wanted] = -np.inf
            best_s = np.concatenate([best_s, score], axis=1)
            best_v = np.concatenate([best_v, np.broadcast_to(part, score.shape)], axis=1)
            keep = np.empty((e - s, min(k, best_s.shape[1])), np.int64)
            for i in range(e - s):
                row = best_s[i]
                if len(row) > 4 * k and exact:
                    cut = np.partition(row, len(row) - k)[len(row) - k]
                    near = np.flatnonzero(row >= cut)
                else:
                    near = np.arange(len(row))
                keep[i] = near[np.lexsort((best_v[i][near], -row[near]))[: keep.shape[1]]]
            best_s, best_v = np.take_along_axis(best_s, keep, 1), np.take_along_axis(best_v, keep, 1)
        i, j = np.nonzero(best_s > -np.inf)
        out.append((i + s, order[best_v[i, j]], best_s[i, j]))
    return *(np.concatenate(x) for x in zip(*out)), evaluated


def _sampled(vectors: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (ids, rows) of vectors: SAMPLE rows in all or about as many, by a hash."""
    some = vectors.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))).select("vec_id", "v").limit(2 * SAMPLE)
    by: dict[int, list] = {}
    for row in sorted((r["vec_id"], r["v"]) for r in some.collect()):
        by.setdefault(len(row[1]), []).append(row)
    return {d: (np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.float64).reshape(len(rows), d)) for d, rows in by.items()}


def _searched(queries: DataFrame, vectors: DataFrame, k: int, candidates: int, query_rows: int, pivots: int | None) -> DataFrame:
    n = vectors.count()
    queries = queries.select("vec_id", "v").distinct().withColumn("n", F.lit(1).cast("long"))
    vectors = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    sample = _sampled(vectors, n)
    chosen = {d: pivot_vectors(rows, round(SPAN * d) if pivots is None else pivots) for d, (_, rows) in sample.items()}

    def measured(batches, first_pass: bool):
        """Adds the distances to the pivots and, for queries, the k-th score in the sample, rows of the query's id left out."""
        for pdf in batches:
            lengths = pdf["v"].map(len).to_numpy()
            for dim in np.unique(lengths):
                part = pdf[lengths == dim]
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                floor = np.full(len(part), -np.inf)
                if first_pass and dim in sample and len(sample[dim][0]) >= k:
                    for i, (own, v) in enumerate(zip(part["vec_id"], x)):
                        reached = np.where(sample[dim][0] == own, -np.inf, sample[dim][1] @ v)
                        floor[i] = np.partition(reached, len(reached) - k)[len(reached) - k]
                yield part.assign(d=list(distances(x, chosen.get(dim, np.empty((0, dim))))), floor=floor)

    fields = "vec_id long, v array<double>, n long, d array<double>, floor double"
    queries = stored(queries.mapInPandas(lambda it: measured(it, True), fields), "queries")
    vectors = stored(vectors.mapInPandas(lambda it: measured(it, False), fields), "vectors")
    v_blocks, q_blocks = max(1, -(-vectors.count() // candidates)), max(1, -(-queries.count() // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    left = queries.select("*", F.lit(True).alias("is_query"), mine(q_blocks).alias("qb"), every(v_blocks).alias("vb"))
    right = vectors.select("*", F.lit(False).alias("is_query"), every(q_blocks).alias("qb"), mine(v_blocks).alias("vb"))
    both = left.unionByName(right).withColumn("dim", F.size("v")).withColumn("query_key", F.xxhash64("v"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["is_query"].to_numpy()
        ids, keys, times = (pdf[c].to_numpy(dtype=np.int64) for c in ("vec_id", "query_key", "n"))
        x, d = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("v", "d"))
        q, v = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(q) or not len(v):
            return pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")}).astype(np.int64)
        place = places(d, (x * x).sum(1), chosen.get(x.shape[1], np.empty((0, x.shape[1]))))
        i, j, s, seen = best_of_block(ids[q], x[q], place[q], pdf["floor"].to_numpy()[q], ids[v], x[v], place[v], k)
        first = np.append(True, i[1:] != i[:-1])[: len(i)]
        return pd.DataFrame({"query_id": ids[q][i], "query_key": keys[q][i], "vec_id": ids[v][j], "score": s.astype(np.int64), "n": times[v][j], "evaluated": np.where(first, seen[i], 0)})

    return both.groupBy("dim", "qb", "vb").applyInPandas(search, _FOUND)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, candidates: int = CANDIDATES, query_rows: int = QUERIES, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. Both frames: vec_id long, v array<double> of whole numbers without nulls.

    A vector is compared with those of its own length only and never with a row of its own id. Repeated rows are
    candidates of their own, searched once and counted, so that they fill no block. Repeated queries are one query;
    different vectors of one id are queries of their own with k rows each. An empty side gives no rows.
    pivots: how many (default: SPAN of the dimensions).
    """
    found = _searched(queries, vectors, k, candidates, query_rows, pivots).drop("evaluated")
    order = W.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    best = best.withColumn("last", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("first", F.col("last") - F.col("n") + 1).where(F.col("first") <= k)
    ranks = F.explode(F.sequence(F.col("first").cast("int"), F.least("last", F.lit(k)).cast("int")))
    return best.select("query_id", ranks.alias("rank"), "vec_id", "score")


def share_evaluated(queries: DataFrame, vectors: DataFrame, k: int, **sizes) -> float:
    """Of all pairs of a query and a different vector, the share whose score was computed beyond the first pass."""
    sizes = {"candidates": CANDIDATES, "query_rows": QUERIES, "pivots": None} | sizes
    seen = _searched(queries, vectors, k, **sizes).agg(F.sum("evaluated")).first()[0] or 0
    return seen / max(1, queries.distinct().count() * vectors.distinct().count())


def whole_vectors(embeddings: DataFrame, scale: int = 64, more: list[str] | None = None) -> DataFrame:
    """vec_id, the columns `more` and floor(scale * x) of each component; rows with null vectors or null or non-finite components are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)).select(F.col("vec_id").cast("long"), *(more or []), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 20 = 0
), s AS (
  SELECT q.vec_id AS query_id, q.x, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
