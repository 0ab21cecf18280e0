"""Synthetic evidence, as Spark jobs: workloads, stress graphs, set partitions and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.schema import PAIR


def workload(spark: SparkSession, services: int, sources: tuple[str, ...], per_service: int = 3, epochs: int = 2, sparse_percent: int = 8, collision_percent: int = 20, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(truth(handle, service, token), cells): chains of handles inside services that two sources
    call SAME, and name collisions between services that one source calls DIFFERENT. Slots go
    missing by a seeded hash, never in the first epoch. Rows come from spark.range, so any size is
    made in parallel and alike again."""
    rows = spark.range(services).crossJoin(F.broadcast(spark.range(per_service).withColumnRenamed("id", "j")))
    shared = F.col("id") * 100 < F.lit(services * collision_percent)
    token = F.when(shared & (F.col("j") == 0), F.concat(F.lit("name"), (F.col("id") / 2).cast("bigint"))).otherwise(F.format_string("name%d-%d", "id", "j"))
    name = lambda i, j: F.format_string("h%07d-%d", i, j)
    truth = rows.select(name(F.col("id"), F.col("j")).alias("handle"), F.col("id").alias("service"), token.alias("token"))
    chain = rows.where(F.col("j") + 1 < per_service).select(name(F.col("id"), F.col("j")).alias("h_left"), name(F.col("id"), F.col("j") + 1).alias("h_right"), F.lit(True).alias("inside"))
    other = (F.col("id") * 17 + 3) % services
    clash = spark.range(services).where(shared & (other != F.col("id"))).select(F.least(name(F.col("id"), F.lit(0)), name(other, F.lit(0))).alias("h_left"), F.greatest(name(F.col("id"), F.lit(0)), name(other, F.lit(0))).alias("h_right"), F.lit(False).alias("inside")).distinct()
    slots = F.posexplode(F.array(*[F.lit(s) for s in sources])).alias("s", "source")
    every = chain.unionByName(clash).select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).select("*", slots)
    lost = (F.col("epoch") > 0) & (F.pmod(F.xxhash64(F.lit(seed), *PAIR, "epoch", "source"), F.lit(100)) < sparse_percent)
    vote = F.when(F.col("inside") & (F.col("s") < 2), "same").when(~F.col("inside") & (F.col("s") == 2), "different").otherwise("unknown")
    cells = every.where(~lost).select(*PAIR, F.col("epoch").cast("bigint").alias("epoch"), "source", vote.alias("vote"), F.concat(F.lit("generated "), vote).alias("reason"))
    return truth, cells


def services_within(cap: int, per_service: int = 3, n_sources: int = 5, epochs: int = 2, collision_percent: int = 20) -> int:
    """The most services whose cells, all slots filled, stay within cap."""
    each = lambda n: ((per_service - 1) * n + n * collision_percent // 100) * n_sources * epochs
    low, high = 0, cap + 1
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if each(middle) <= cap else (low, middle)
    return low


def stress(spark: SparkSession, family: str, handles: int, seed: int = 7) -> DataFrame:
    """Decisions (h_left, h_right, vote) of one large component: a SAME path with chords, and
    negatives that are few (sparse_cut), many (dense_cut) or short-ranged (low_conflict)."""
    share, reach = {"sparse_cut": (2, 2), "dense_cut": (30, 2), "low_conflict": (1, 8)}[family]
    name = lambda c: F.format_string("n%09d", c)
    path = spark.range(handles - 1).select(name(F.col("id")).alias("h_left"), name(F.col("id") + 1).alias("h_right"), F.lit("same").alias("vote"))
    far = F.col("id") + 2 + F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, handles // reach)))
    extra = spark.range(handles).select("id", far.alias("to"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(100)).alias("p")).where(F.col("to") < handles)
    return path.unionByName(extra.select(name(F.col("id")), name(F.col("to")), F.when(F.col("p") < share, "different").otherwise("same")).toDF("h_left", "h_right", "vote"))


def set_partitions(spark: SparkSession, n: int) -> DataFrame:
    """(rgs): all partitions of n things as restricted growth strings, one longer each step."""
    rows = spark.createDataFrame([([0],)], "rgs array<int>")
    for _ in range(n - 1):
        rows = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.array_max("rgs") + 1), lambda k: F.concat("rgs", F.array(k.cast("int"))))).alias("rgs"))
    return rows


def deliveries(cells: DataFrame, nodes: list[str], seed: int, loss_percent: int = 10, duplicate_percent: int = 5, withheld: DataFrame | None = None, repair: bool = True) -> DataFrame:
    """(step, node, cell columns, duplicate, repair): cells sent to every node in a seeded order,
    some lost, some twice; withheld(source, node) names what a partition keeps back, which is no
    loss. Repair sends what a node has not got. Draws are hashes, so a rerun sends alike."""
    key = [*PAIR, "epoch", "source"]
    sent = cells.select("*", F.explode(F.array(*[F.lit(n) for n in nodes])).alias("node"))
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *key, "node"), F.lit(100))
    open_ = sent.join(withheld, ["source", "node"], "left_anti") if withheld is not None else sent
    kept = open_.where(draw(1) >= loss_percent)
    copies = kept.where(draw(2) < duplicate_percent).withColumn("duplicate", F.lit(True))
    first = kept.withColumn("duplicate", F.lit(False)).unionByName(copies).withColumn("repair", F.lit(False))
    out = first
    if repair:
        lost = sent.join(kept.select(*key, "node"), [*key, "node"], "left_anti")
        out = first.unionByName(lost.withColumn("duplicate", F.lit(False)).withColumn("repair", F.lit(True)))
    return out.withColumn("step", F.col("repair").cast("bigint") * (1 << 40) + F.pmod(F.xxhash64(F.lit(seed), F.lit(3), *key, "node", "duplicate"), F.lit(1 << 40)))
