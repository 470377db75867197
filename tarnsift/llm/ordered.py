"""Rows next to their neighbours in a global order, with one shuffle of the rows and no single-task sort."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsift.llm.common import shuffle_partitions


#: Bytes of text in a bucket, about, and the most buckets: beyond, buckets grow, which are streamed and never held whole.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 50_000


def in_order(df: DataFrame, keys: list[str], buckets: int | None = None, wrap: bool = False, text: str | None = None) -> DataFrame:
    """df with columns bucket and place, each bucket a contiguous range of the keys' order in one partition, sorted. Their
    number follows from the bytes of the column `text`, unless given.

    place 0: the bucket's own rows; 1: a copy of the row after the bucket's last; -1: of the row before its first.
    wrap: the first row follows the last one. Only the buckets' least and greatest keys reach the driver, two for
    each bucket. Keys must not be null.
    """
    spark = df.sparkSession
    n = buckets or shuffle_partitions(spark)
    if text and not buckets:
        size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
        n = min(max(n, -(-size // BUCKET_BYTES)), MOST_BUCKETS)
    key = F.struct(*keys)
    edges = df.select(*keys).repartitionByRange(n, *keys).groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    edges = sorted((tuple(r["lo"]), tuple(r["hi"])) for r in edges)
    lows, highs = [e[0] for e in edges], [e[1] for e in edges]
    last = len(lows) - 1

    @F.pandas_udf("array<int>")
    def places(*cols: pd.Series) -> pd.Series:
        """bucket * 3 + place + 1 of the row and of its copies."""
        out = []
        for k in zip(*cols):
            b = max(0, bisect_right(lows, k) - 1)
            own = [b * 3 + 1]
            if k == lows[b]:
                if b > 0:
                    own.append((b - 1) * 3 + 2)
                elif wrap:
                    own.append(last * 3 + 2)
            if k == highs[b]:
                if b < last:
                    own.append((b + 1) * 3)
                elif wrap:
                    own.append(0)
            out.append(own)
        return pd.Series(out)

    spread = df.withColumn("at", F.explode(places(*[F.col(k) for k in keys])))
    spread = spread.withColumn("bucket", F.floor(F.col("at") / 3).cast("int")).withColumn("place", F.col("at") % 3 - 1).drop("at")
    return spread.repartition(n, "bucket").sortWithinPartitions("bucket", "place", *keys)


def triples(batches, make):
    """(previous, current, next) of make(row) for every own row, in order; None where there is no neighbour."""
    prev = cur = None
    bucket = None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.bucket != bucket:
                if cur is not None and cur[0].place == 0:
                    yield prev, cur, None
                prev = cur = None
                bucket = row.bucket
            if cur is not None and cur[0].place == 1:
                continue  # one row ahead is enough
            nxt = (row, make(row))
            if cur is not None and cur[0].place == 0:
                yield prev, cur, nxt
            prev, cur = cur, nxt
    if cur is not None and cur[0].place == 0:
        yield prev, cur, None
