"""Digests of cells that don't depend on their order: a tree of them over ranges of keys, by which two
replicas find what they lack of each other, and the version of a whole state.

A key's place is the first hex digits of its MD5, so ranges are about equal whatever the keys are. A
digest of a range is the count of its cells and two sums over hashes of whole cells. Digests of ranges
add up to that of the range above, so a tree costs one pass over the cells, and two trees are compared
from the root: only below unlike nodes is there anything to look at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.schema import KEY, PAIR
from quorumlake.session import staged

#: Levels of the tree below its root; a node has 16 children, a hex digit of the place each.
LEVELS = 3

BODY = [*KEY, "vote", "reason"]
DIGEST = ["n", "low", "high"]


def _md5(*columns: str) -> Column:
    """MD5 of columns with their lengths, so that no two rows run together; null is unlike empty."""
    text = [F.col(c).cast("string") for c in columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text]))


def _word(hash_: Column, at: int) -> Column:
    return F.conv(F.substring(hash_, at, 8), 16, 10).cast("bigint")


def place(levels: int = LEVELS) -> Column:
    """The range of a cell's key at the tree's lowest level."""
    return F.substring(_md5(*KEY), 1, levels)


def sums(hash_: str = "h") -> list[Column]:
    """A digest's aggregates over rows with a hash column."""
    return [F.count("*").alias("n"), F.coalesce(F.sum(_word(F.col(hash_), 1)), F.lit(0)).alias("low"), F.coalesce(F.sum(_word(F.col(hash_), 9)), F.lit(0)).alias("high")]


def tree(cells: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level, node, n, low, high): digests of all ranges that hold cells, the root at level 0. Equal
    cells give equal trees, however they are ordered, dealt or repeated in time; a cell that stands
    twice counts twice."""
    leaves = cells.select(place(levels).alias("leaf"), _md5(*BODY).alias("h")).groupBy("leaf").agg(*sums())
    each = leaves.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda i: F.substring(F.col("leaf"), F.lit(1), i))).alias("level", "node"), *DIGEST)
    return each.groupBy("level", "node").agg(*[F.sum(c).alias(c) for c in DIGEST])


def descend(own: DataFrame, other: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level, node, n_own, n_other, unlike) of the nodes that two trees compare: the root, then the
    children of unlike nodes. Each step joins one level, so equal replicas end at their roots."""
    side = lambda df, name: df.select("level", "node", F.struct(*DIGEST).alias(name))
    out, below = None, None
    for level in range(levels + 1):
        both = side(own.where(F.col("level") == level), "a").join(side(other.where(F.col("level") == level), "b"), ["level", "node"], "full")
        if below is not None:
            up = F.substring(F.col("node"), F.lit(1), F.lit(level - 1)).alias("up")
            both = both.withColumn("up", up).join(below.select(F.col("node").alias("up")), "up", "left_semi").drop("up")
        seen = both.select("level", "node", F.coalesce("a.n", F.lit(0)).alias("n_own"), F.coalesce("b.n", F.lit(0)).alias("n_other"), (~F.col("a").eqNullSafe(F.col("b"))).alias("unlike"))
        seen = staged(seen, "level")
        out, below = seen if out is None else out.unionByName(seen), seen.where("unlike")
        if below.isEmpty():
            break
    return out


@dataclass(frozen=True)
class Ranged:
    """A replica's cells on disk, dealt by the first digit of their place and sorted by it, with its
    tree. A read of some ranges opens their folders and, of those, the row groups that can match."""

    path: str
    tree: DataFrame
    schema: str

    def ranges(self, spark, leaves: list[str]) -> DataFrame:  # noqa: ANN001
        rows = spark.read.schema(f"{self.schema}, leaf string, head string").parquet(self.path)
        return rows.where(F.col("head").isin(sorted({x[0] for x in leaves})) & F.col("leaf").isin(leaves)).drop("leaf", "head")


def ranged(cells: DataFrame, levels: int = LEVELS) -> Ranged:
    """Cells written by range, and their tree."""
    dealt = cells.select(*BODY).withColumn("leaf", place(levels)).withColumn("head", F.substring("leaf", 1, 1))
    table = staged(cells.select(*BODY).limit(0), "ranged")
    dealt.repartitionByRange("leaf").sortWithinPartitions("leaf").write.mode("overwrite").partitionBy("head").parquet(table.staged_path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*BODY).schema)
    return Ranged(table.staged_path, staged(tree(cells, levels), "tree"), schema)


def digest_delta(own: Ranged, other: Ranged, spark, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(cells of `other` whose keys `own` lacks, the nodes compared). Cells move only for leaves whose
    digests differ; there are at most 16 ** levels of them."""
    seen = descend(own.tree, other.tree, levels)
    leaves = [r[0] for r in seen.where((F.col("level") == levels) & F.col("unlike")).select("node").collect()]
    return other.ranges(spark, leaves).join(own.ranges(spark, leaves).select(KEY), KEY, "left_anti"), seen


def version(cells: DataFrame, floors: DataFrame, by: str | None = None) -> DataFrame:
    """(version) of a state, or (by, version) of each: a text of the digests of its cells and floors.
    Equal states have equal versions whatever the order of their rows; floors are (h_left, h_right,
    epoch). A state without cells or floors has zeros, but a group of `by` without any row has none."""
    keys = [by] if by else []
    parts = cells.select(*keys, F.lit(True).alias("cell"), _md5(*BODY).alias("h")).unionByName(floors.select(*keys, F.lit(False).alias("cell"), _md5(*PAIR, "epoch").alias("h")))
    count = lambda cell: F.count_if(F.col("cell") == cell)
    total = lambda cell, at: F.coalesce(F.sum(F.when(F.col("cell") == cell, _word(F.col("h"), at))), F.lit(0))
    text = F.concat_ws(":", *[x.cast("string") for cell in (True, False) for x in (count(cell), total(cell, 1), total(cell, 9))])
    return parts.groupBy(*keys).agg(text.alias("version"))


def acknowledge(acks: DataFrame, versions: DataFrame) -> DataFrame:
    """acks(replica, ...) with the version of the state that each member spoke from."""
    return acks.join(versions, "replica")


def accepted(rows: DataFrame, versions: DataFrame, by: str = "replica") -> DataFrame:
    """rows(by, version, ...) with `accepted`: whether the state of `by` still is the one they speak of.
    Rows of unknown members are not accepted."""
    now = versions.select(by, F.col("version").alias("now"))
    return rows.join(now, by, "left").withColumn("accepted", F.coalesce(F.col("version") == F.col("now"), F.lit(False))).drop("now")


def floor_round(replicas: DataFrame, floors: DataFrame, acks: DataFrame, n_replicas: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round's end: (replica, h_left, h_right, epoch, rule) of refused acks, the floors taken and the
    replicas compacted.

    replicas are cells with `replica`; floors(replica, h_left, h_right, epoch) those taken before; acks
    (replica, version, h_left, h_right, epoch, vector) name proposed floors. An ack is stale if its
    member's state is another now, and incomplete if the member has no sealed vector there. A floor is
    taken by all members or by none: all acks must be in, fresh and of one vector, and no floor falls.
    """
    told = accepted(acks, version(replicas, floors, "replica"))
    old = floors.groupBy(PAIR).agg(F.max("epoch").alias("old"))
    told = staged(told.join(old, PAIR, "left"), "acks")
    rule = F.when(~F.col("accepted"), "stale").when(F.col("vector").isNull(), "incomplete").when(F.col("epoch") < F.col("old"), "regression")
    ruled = told.withColumn("rule", rule)
    whole = ruled.groupBy(*PAIR, "epoch").agg(
        F.count("*").alias("rows"), F.count_distinct("replica").alias("members"), F.count("rule").alias("broken"), F.count_distinct(F.md5(F.to_json("vector"))).alias("vectors")
    )
    taken = staged(whole.where((F.col("rows") == n_replicas) & (F.col("members") == n_replicas) & (F.col("broken") == 0) & (F.col("vectors") == 1)).select(*PAIR, "epoch"), "taken")
    held = taken.groupBy(PAIR).agg(F.max("epoch").alias("floor"))
    left = replicas.join(held, PAIR, "left").where(F.col("floor").isNull() | (F.col("epoch") >= F.col("floor"))).drop("floor")
    return ruled.where("rule is not null").select("replica", *PAIR, "epoch", "rule"), taken, left
