"""Validation and idempotent ingest of evidence cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.schema import DIFFERENT, KEY, PAIR, SAME, UNKNOWN, Evidence


def canonical(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with h_left < h_right. A pair of equal handles is an error when it is read."""
    equal = F.raise_error(F.concat(F.lit("a relation needs two handles: "), F.col(a)))
    left = F.when(F.col(a) == F.col(b), equal).otherwise(F.least(a, b))
    return pairs.withColumn("h_left", left).withColumn("h_right", F.greatest(a, b)).drop(*({a, b} - set(PAIR)))


def equivocations(cells: DataFrame) -> DataFrame:
    """Keys whose cells differ in vote or reason: an error of the source, never the last one wins."""
    body = F.struct(F.coalesce("vote", F.lit("")), F.coalesce("reason", F.lit("")))
    return cells.groupBy(KEY).agg(F.count_distinct(body).alias("bodies")).where("bodies > 1")


def domain_violations(cells: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """One row per broken rule and cell: (h_left, h_right, epoch, source, rule)."""
    rules = {
        "handles must be non-empty": "coalesce(h_left, '') = '' or coalesce(h_right, '') = ''",
        "left must precede right": "h_left >= h_right",
        "epoch must not be negative": "epoch is null or epoch < 0",
        "vote must be same, different or unknown": f"vote is null or vote not in ('{SAME}', '{DIFFERENT}', '{UNKNOWN}')",
    }
    broken = [F.when(F.expr(e), F.lit(name)) for name, e in rules.items()]
    broken.append(F.when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), F.lit("source must be registered")))
    return cells.select(*KEY, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def assert_clean(cells: DataFrame, sources: tuple[str, ...]) -> None:
    """Raise with examples if a cell breaks a rule or a key equivocates."""
    bad = domain_violations(cells, sources).select("rule", *KEY).unionByName(equivocations(cells).select(F.lit("equivocation").alias("rule"), *KEY))
    if found := bad.limit(5).collect():
        raise ValueError("; ".join(f"{r.rule}: {r.h_left}, {r.h_right}, {r.epoch}, {r.source}" for r in found))


def above_floor(cells: DataFrame, floors: DataFrame | None) -> DataFrame:
    """Cells at or above their relation's floor; relations without one keep all."""
    if floors is None:
        return cells
    held = floors.groupBy(PAIR).agg(F.max("epoch").alias("floor"))
    return cells.join(held, PAIR, "left").where(F.col("epoch") >= F.coalesce("floor", F.lit(-1))).drop("floor")


def handles_of(cells: DataFrame) -> DataFrame:
    """Handles that cells name. A cell below the floor still registers its handles."""
    return cells.select(F.explode(F.array(*PAIR)).alias("handle")).distinct()


def add(store: Evidence, new: DataFrame) -> Evidence:
    """The store with new cells: checked, handles registered, below-floor cells dropped, repeats
    once. Adding cells again changes nothing, whatever the order."""
    every = store.cells.unionByName(new)
    assert_clean(every, store.sources)
    handles = store.handles.unionByName(handles_of(new)).distinct()
    cells = above_floor(every, store.floors).dropDuplicates(KEY)
    return Evidence(cells, handles, store.sources, store.threshold, store.floors)
