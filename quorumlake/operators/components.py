"""Connected components of an undirected edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quorumlake.operators.joins import counted_join
from quorumlake.session import discard, staged


def _stars(edges: DataFrame, total: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """One round: every node's larger neighbours move to its smallest one, then the reverse. A hub
    of very many neighbours is no hot key: see counted_join. Returns the tables it is made from too."""
    both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
    least = staged(both.groupBy("hi").agg(F.least("hi", F.min("lo")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    met = counted_join(both.where("lo > hi"), least, "hi", 2 * total)
    large = staged(met.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
    small = staged(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n")), "small")
    moved = counted_join(large, small, "hi", 2 * total).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(small.select("hi", F.col("m").alias("lo"))).distinct(), (edges, least, large, small)


def _marked(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, staged, with a fingerprint of all of them that the same job gathers."""
    seen = Observation()
    marks = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")
    return staged(edges.observe(seen, *marks), "components"), seen.get


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another; component is its smallest node.

    Each round is aggregations with map-side combine and equi joins on a staged table; no node's
    neighbours are gathered in one row. Rounds grow with the logarithm of the longest path. Nodes
    that no edge touches are absent; self edges and null ends are ignored.
    """
    first = edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where(f"`{left}` <> `{right}`")
    now, mark = _marked(first.distinct())
    for _ in range(max_rounds):
        if mark["n"] == 0:
            break
        last, (grown, used) = mark, _stars(now, mark["n"])
        now, mark = _marked(grown)
        discard(*used)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
