"""Joins of replicas, deltas between them, common floors and acknowledged compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.decisions import epochs
from quorumlake.operators.ingest import above_floor, assert_clean
from quorumlake.schema import KEY, PAIR, Evidence


def join_floors(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pointwise greatest floor."""
    return a.select(*PAIR, "epoch").unionByName(b.select(*PAIR, "epoch")).groupBy(PAIR).agg(F.max("epoch").alias("epoch"))


def state_join(a: Evidence, b: Evidence) -> Evidence:
    """The least state above both: commutative, associative, idempotent. Registries must agree;
    equivocation between the two is an error and joins nothing."""
    if sorted(a.sources) != sorted(b.sources) or a.threshold != b.threshold:
        raise ValueError("replicas must have equal sources and thresholds")
    every = a.cells.unionByName(b.cells)
    assert_clean(every, a.sources)
    floors = a.floors or b.floors
    if a.floors is not None and b.floors is not None:
        floors = join_floors(a.floors, b.floors)
    return Evidence(above_floor(every, floors).dropDuplicates(KEY), a.handles.unionByName(b.handles).distinct(), a.sources, a.threshold, floors)


def inventory_delta(own: DataFrame, other: DataFrame) -> DataFrame:
    """Cells of other whose keys are missing from own: what a pull fetches."""
    return other.join(own.select(KEY), KEY, "left_anti")


def fetch(cells: DataFrame, keys: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Cells with the asked keys, and those at a floor's own epoch."""
    asked = cells.join(keys.select(KEY).distinct(), KEY, "left_semi")
    if floors is None:
        return asked
    return asked.unionByName(cells.join(floors, [*PAIR, "epoch"], "left_semi")).dropDuplicates(KEY)


def common_floor(replicas: DataFrame, n_replicas: int, n_sources: int) -> DataFrame:
    """The greatest epoch of each relation that is sealed in every replica: the greatest member of
    the intersection of sealed sets, not the least of their greatest."""
    slots = replicas.groupBy("replica", *PAIR, "epoch").agg(F.count_distinct("source").alias("n")).where(F.col("n") == n_sources)
    shared = slots.groupBy(*PAIR, "epoch").agg(F.count_distinct("replica").alias("n")).where(F.col("n") == n_replicas)
    return shared.groupBy(PAIR).agg(F.max("epoch").alias("epoch"))


def acknowledgements(replicas: DataFrame, floors: DataFrame, n_sources: int) -> DataFrame:
    """(replica, h_left, h_right, epoch, vector): each replica's cells at the proposed floors. A
    replica that lacks a sealed vector there has a null vector: it can't acknowledge it."""
    cell = F.struct("source", "vote", "reason")
    held = replicas.join(floors, [*PAIR, "epoch"]).groupBy("replica", *PAIR, "epoch").agg(F.array_sort(F.collect_list(cell)).alias("v"), F.count_distinct("source").alias("n"))
    every = floors.crossJoin(F.broadcast(replicas.select("replica").distinct()))  # one row a member
    found = every.join(held, ["replica", *PAIR, "epoch"], "left")
    return found.select("replica", *PAIR, "epoch", F.when(F.col("n") == n_sources, F.col("v")).alias("vector"))


def agreed_floors(acks: DataFrame, n_replicas: int) -> DataFrame:
    """(h_left, h_right, epoch, agreed): whether all members acknowledged a floor, each once, with one
    and the same vector. Only agreed floors may be compacted."""
    seen = acks.groupBy(*PAIR, "epoch").agg(
        F.count("vector").alias("n"), F.count_distinct("replica").alias("members"), F.count_distinct(F.xxhash64("vector")).alias("vectors"), F.count("*").alias("rows")
    )
    whole = (F.col("n") == n_replicas) & (F.col("members") == n_replicas) & (F.col("rows") == n_replicas)
    return seen.select(*PAIR, "epoch", (whole & (F.col("vectors") == 1)).alias("agreed"))


def compaction_violations(store: Evidence, proposed: DataFrame, retain_pending: int = 2) -> DataFrame:
    """(h_left, h_right, rule) for proposed floors(h_left, h_right, epoch) that may not be taken: a
    floor below the old one, of a relation without cells, at an epoch that is not sealed, or below
    more than retain_pending newer epochs. The last holds for old floors as well; -1 means none."""
    old = store.floors.select(*PAIR, F.col("epoch").alias("old")) if store.floors is not None else proposed.select(*PAIR, F.lit(None).cast("bigint").alias("old")).limit(0)
    both = old.join(proposed.select(*PAIR, F.col("epoch").alias("new")), PAIR, "full").withColumn("floor", F.coalesce("new", "old"))
    found = epochs(store.cells, len(store.sources))
    seen = found.join(both.select(*PAIR, "floor"), PAIR).groupBy(PAIR).agg(
        F.count("*").alias("n"),
        F.bool_or((F.col("epoch") == F.col("floor")) & F.col("sealed")).alias("sealed"),
        F.count_if(F.col("epoch") > F.col("floor")).alias("newer"),
    )
    rows = both.join(seen, PAIR, "left").withColumn("is_new", F.col("new").isNotNull() & (F.col("new") >= 0))
    rules = {
        "regression": F.col("new") < F.col("old"),
        "absent relation": F.col("is_new") & F.col("n").isNull(),
        "epoch not sealed": F.col("is_new") & F.col("n").isNotNull() & ~F.col("sealed"),
        "too many pending epochs": (F.col("floor") >= 0) & (F.coalesce("newer", F.lit(0)) > retain_pending),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return rows.select(*PAIR, F.explode(broken).alias("rule"))


def compact(store: Evidence, proposed: DataFrame, retain_pending: int = 2) -> Evidence:
    """The store with the floors taken and the cells below them gone; all or nothing."""
    if bad := compaction_violations(store, proposed, retain_pending).limit(5).collect():
        raise ValueError("; ".join(f"{r.rule}: {r.h_left}, {r.h_right}" for r in bad))
    floors = proposed.select(*PAIR, "epoch").where("epoch >= 0")
    floors = floors if store.floors is None else join_floors(store.floors, floors)
    return Evidence(above_floor(store.cells, floors), store.handles, store.sources, store.threshold, floors)


def divergence(replicas: DataFrame, a: int, b: int) -> DataFrame:
    """Rows that one of two replicas has and the other has not, with side."""
    of = lambda i: replicas.where(F.col("replica") == i).drop("replica")
    return of(a).exceptAll(of(b)).withColumn("side", F.lit(a)).unionByName(of(b).exceptAll(of(a)).withColumn("side", F.lit(b)))
