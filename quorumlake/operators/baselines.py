"""What simpler rules make of the same evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.components import connected_components
from quorumlake.operators.joins import counted_join
from quorumlake.schema import PAIR, SAME
from quorumlake.session import staged


def _labels(handles: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges, *PAIR).toDF("handle", "label")
    return handles.select("handle").distinct().join(found, "handle", "full").select("handle", F.coalesce("label", "handle").alias("label"))


def union_find(cells: DataFrame, handles: DataFrame) -> DataFrame:
    """Components of every pair that any source ever called SAME."""
    return _labels(handles, cells.where(F.col("vote") == SAME).select(PAIR).distinct())


def last_arrival(cells: DataFrame, step: str = "step") -> DataFrame:
    """The vote of each relation's last cell to arrive; epochs count for nothing."""
    return cells.groupBy(PAIR).agg(F.max_by("vote", step).alias("vote"))


def local_only(cells: DataFrame, source: str, step: str = "step") -> DataFrame:
    """One source's vote of the greatest epoch, the later arrival on ties."""
    return cells.where(F.col("source") == source).groupBy(PAIR).agg(F.max_by("vote", F.struct("epoch", step)).alias("vote"))


def partition_of(votes: DataFrame, handles: DataFrame) -> DataFrame:
    return _labels(handles, votes.where(F.col("vote") == SAME))


def name_only(names: DataFrame) -> DataFrame:
    """(handle, label): handles of one token together, under the smallest. The smallest is found by an
    aggregation, so a token of very many handles is no hot key. Handles without a token are their own."""
    least = staged(names.where("token is not null").groupBy("token").agg(F.min("handle").alias("label"), F.count("*").alias("n")), "tokens")
    total = least.agg(F.sum("n")).first()[0] or 0
    alone = names.where("token is null").select("handle", F.col("handle").alias("label"))
    return counted_join(names.where("token is not null"), least, "token", total).select("handle", "label").unionByName(alone)


def chain_edges(groups: DataFrame, group: str, order: str) -> DataFrame:
    """(h_left, h_right): each handle and the next of its group."""
    following = F.lead("handle").over(Window.partitionBy(group).orderBy(order))
    return groups.select(F.col("handle").alias("h_left"), following.alias("h_right")).where("h_right is not null")
