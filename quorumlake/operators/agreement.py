"""Whether several tables agree: on their keys, and on values within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def origins(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """(key, held): a row for each key that any of up to 63 tables holds, and a bitmap of the tables that
    hold it. One exchange for all tables, in place of differences of every two."""
    if not 1 <= len(tables) <= 63:
        raise ValueError("between 1 and 63 tables")
    marked = [t.select(*key, F.lit(1 << i).cast("bigint").alias("bit")) for i, t in enumerate(tables)]
    every = marked[0]
    for m in marked[1:]:
        every = every.unionByName(m)
    return every.groupBy(*key).agg(F.bit_or("bit").alias("held"))


def disagreements(tables: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """(key, lacks): keys that some of the named tables hold and others lack, a row for each that lacks
    it. Repeated rows of a table are one key; null parts of keys are equal to each other."""
    names = list(tables)
    found = origins([tables[n] for n in names], key)
    lacking = F.array_compact(F.array(*[F.when(F.col("held").bitwiseAND(F.lit(1 << i)) == 0, F.lit(n)) for i, n in enumerate(names)]))
    return found.where(F.col("held") != (1 << len(names)) - 1).select(*key, F.explode(lacking).alias("lacks"))


def within_tolerance(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """(key, a_value, b_value): pairs of rows of equal key whose values differ by at most `tolerance`.

    Values are dealt in bins as wide as the tolerance; a row of b stands in its own bin and both
    neighbours, so an equi join on key and bin meets all pairs and the exact test decides. Null and
    non-finite values match nothing. `tolerance` is positive.
    """
    if not tolerance > 0:
        raise ValueError("the tolerance is positive")
    sound = lambda df: df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    bin_ = F.floor(F.col(value) / tolerance)
    left = sound(a).select(*key, bin_.alias("bin"), F.col(value).alias("a_value"))
    right = sound(b).select(*key, F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"), F.col(value).alias("b_value"))
    return left.join(right, [*key, "bin"]).where(F.abs(F.col("a_value") - F.col("b_value")) <= tolerance).drop("bin")


def metric_differences(recomputed: DataFrame, stated: DataFrame, key: list[str], metrics: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(key, metric, recomputed, stated, rule) of what two rollups of one key don't agree on.

    Values agree if they differ by at most `tolerance` times the larger of 1 and both sizes, if both
    are NaN or if both are null. rule: `unlike`, `one is null`, or `only recomputed`, `only stated`
    for keys that one rollup lacks, a row a metric. Null parts of keys are equal to each other. A key
    that a rollup has twice is compared with each of the other's rows.
    """
    side = lambda df, name: df.select(*[F.col(c).alias(f"{name}_{c}") for c in key], F.lit(True).alias(f"{name}_there"), *[F.col(m).cast("double").alias(f"{name}__{m}") for m in metrics])
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    both = side(recomputed, "a").join(side(stated, "b"), same, "full")
    named = [F.when(F.col("a_there").isNotNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in key]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a__{m}").alias("recomputed"), F.col(f"b__{m}").alias("stated")) for m in metrics])).alias("x")
    rows = both.select(*named, "a_there", "b_there", each).select(*key, "a_there", "b_there", "x.*")
    a, b = F.col("recomputed"), F.col("stated")
    # equality comes first: infinities have no difference, and NaN is equal to NaN
    near = (a == b) | (F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))) & ~F.isnan(a - b)
    rule = (
        F.when(F.col("b_there").isNull(), "only recomputed").when(F.col("a_there").isNull(), "only stated")
        .when(a.isNull() & b.isNull(), None).when(a.isNull() | b.isNull(), "one is null").when(~near | (F.abs(a) == float("inf")) & (a != b), "unlike")
    )
    return rows.withColumn("rule", rule).where("rule is not null").select(*key, "metric", "recomputed", "stated", "rule")
