"""Epoch selection and the three-valued decision of each relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.schema import DIFFERENT, PAIR, SAME, UNKNOWN, Evidence


def epochs(cells: DataFrame, n_sources: int) -> DataFrame:
    """Counts of each (relation, epoch), sealed if every registered source has a cell in it."""
    is_ = lambda v: F.count_if(F.col("vote") == v)
    return cells.groupBy(*PAIR, "epoch").agg(
        is_(SAME).alias("same_count"),
        is_(DIFFERENT).alias("different_count"),
        F.count_distinct("source").alias("n_sources"),
        (F.count_distinct("source") == n_sources).alias("sealed"),
    )


def highest_sealed(cells: DataFrame, n_sources: int) -> DataFrame:
    """(relation, epoch): the greatest sealed epoch, null where none is."""
    found = epochs(cells, n_sources)
    return found.groupBy(PAIR).agg(F.max(F.when(F.col("sealed"), F.col("epoch"))).alias("epoch"))


def verdict(threshold: int, relation_veto: bool = True) -> Column:
    """The vote of a chosen epoch. Without the veto, negatives count as unknown."""
    voted = F.when(F.col("same_count") >= threshold, SAME).otherwise(UNKNOWN)
    if relation_veto:
        voted = F.when(F.col("different_count") > 0, DIFFERENT).otherwise(voted)
    return F.when(F.col("sealed"), voted).otherwise(UNKNOWN)


def decisions(store: Evidence, relation_veto: bool = True) -> DataFrame:
    """relation, epoch, sealed, same_count, different_count, vote.

    The greatest sealed epoch speaks, even behind a newer open one; without one, the greatest epoch
    is reported and the vote is unknown. Cells are dealt by relation once: the count per epoch and
    the choice of the epoch share that exchange.
    """
    dealt = store.cells.select(*PAIR, "epoch", "source", "vote").repartition(*PAIR)
    found = epochs(dealt, len(store.sources))
    best = found.groupBy(PAIR).agg(F.max(F.struct("sealed", "epoch", "same_count", "different_count")).alias("b")).select(*PAIR, "b.*")
    return best.select(*PAIR, "epoch", "sealed", "same_count", "different_count", verdict(store.threshold, relation_veto).alias("vote"))


def source_slots(store: Evidence, decided: DataFrame) -> DataFrame:
    """decided with the sorted source lists same_sources, different_sources, unknown_sources and
    missing_sources of the chosen epoch."""
    of = lambda v: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("vote") == v, F.col("source")))))
    slots = store.cells.groupBy(*PAIR, "epoch").agg(of(SAME).alias("same_sources"), of(DIFFERENT).alias("different_sources"), of(UNKNOWN).alias("unknown_sources"))
    every = F.array(*[F.lit(s) for s in sorted(store.sources)])
    present = F.concat("same_sources", "different_sources", "unknown_sources")
    return decided.join(slots, [*PAIR, "epoch"]).withColumn("missing_sources", F.array_except(every, present))


def authorization_gap(slots: DataFrame, threshold: int) -> DataFrame:
    """slots with gap_sources and gap: the fewest source positions that a future sealed epoch must
    supply or revise to make the relation SAME. Missing first, then different, then the first
    unknown ones that the threshold still needs."""
    have = F.size("same_sources") + F.size("missing_sources") + F.size("different_sources")
    extra = F.greatest(F.lit(0), F.lit(threshold) - have)
    gap = F.concat("missing_sources", "different_sources", F.slice("unknown_sources", F.lit(1), extra))
    return slots.withColumn("gap_sources", gap).withColumn("gap", F.size("gap_sources"))


def negative_mask(cells: DataFrame) -> DataFrame:
    """DIFFERENT votes become UNKNOWN: what the engine would say without negative evidence."""
    return cells.withColumn("vote", F.when(F.col("vote") == DIFFERENT, UNKNOWN).otherwise(F.col("vote")))
