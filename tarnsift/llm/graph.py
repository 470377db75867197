"""Connected components by alternating large-star and small-star rounds, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsift.sources.shared import stored

#: Parts that the neighbours of a hub are dealt into; rows from which a node is a hub, and most hubs: nodes with more than
#: 1 / HUBS of all rows are hubs in any case, so there are never more.
SALTS, HUB, HUBS = 64, 1024, 100_000


def _beside_least(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """rows (u, v) with m of their u in least (u, m, n). The rows of a u with n > hub meet m in SALTS parts."""
    hubs = least.where(F.col("n") > hub).select("u", F.lit(True).alias("hub"))
    dealt = rows.join(F.broadcast(hubs), "u", "left").select("u", "v", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    parts = F.sequence(F.lit(0), F.when(F.col("n") > hub, SALTS - 1).otherwise(0))
    return dealt.join(least.select("u", "m", F.explode(parts).alias("salt")), ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _beside_least(both.where("v > u"), least, hub).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    """A node and its neighbours below are tied to the least of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = _beside_least(edges, least, hub).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of links (a, b: long) that isn't its component's least node itself."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state = (edges.count(), None)
    for _ in range(most_rounds):
        hub = max(HUB, 2 * state[0] // HUBS)
        stars = stored(_large_star(edges, hub), "stars", instead_of=edges)
        edges = stored(_small_star(stars, hub), "edges", instead_of=stars)
        new = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
