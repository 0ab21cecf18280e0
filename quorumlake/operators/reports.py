"""Transport forms of certificates and comparisons of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.evaluation import medians
from quorumlake.schema import PAIR, SAME, Evidence
from quorumlake.session import staged


def supported_paths(paths: DataFrame, decided: DataFrame, store: Evidence, keys_only: bool = False) -> DataFrame:
    """(q_left, q_right, i, h_left, h_right, epoch, cells): the support of each step of same paths:
    the cells of the epoch that speaks, or with keys_only their keys, in the order of sources."""
    step = F.posexplode(F.expr("transform(sequence(1, size(path) - 1), k -> struct(path[k - 1] as u, path[k] as v))")).alias("i", "s")
    steps = paths.select("q_left", "q_right", step).select("q_left", "q_right", "i", F.least("s.u", "s.v").alias("h_left"), F.greatest("s.u", "s.v").alias("h_right"))
    body = ["source"] if keys_only else ["source", "vote", "reason"]
    cells = store.cells.groupBy(*PAIR, "epoch").agg(F.array_sort(F.collect_list(F.struct(*body))).alias("cells"))
    same = decided.where(F.col("vote") == SAME).select(*PAIR, "epoch")
    return steps.join(same, PAIR).join(cells, [*PAIR, "epoch"]).select("q_left", "q_right", "i", *PAIR, "epoch", "cells")


def serialized_bytes(row: Column) -> Column:
    """Bytes of a row as compact JSON."""
    return F.octet_length(F.to_json(row)).cast("bigint")


def within(df: DataFrame, limit: int) -> DataFrame:
    """df with `bytes` and `fits`: whether a row's JSON stays within a transport limit."""
    size = serialized_bytes(F.struct(*df.columns))
    return df.withColumn("bytes", size).withColumn("fits", F.col("bytes") <= limit)


def parse_floors(raw: DataFrame) -> DataFrame:
    """Floors from raw(left, right, epoch) text: canonical pairs, whole non-negative epochs, each
    relation once; a row that breaks this is an error when it is read."""
    epoch = F.when(F.col("epoch").rlike(r"^\d{1,18}$"), F.col("epoch").cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not an epoch: "), F.coalesce("epoch", F.lit("null")))).cast("bigint"))
    wrong = F.coalesce(F.col("left") >= F.col("right"), F.lit(True)) | (F.col("left") == "")
    left = F.when(wrong, F.raise_error(F.lit("left must precede right"))).otherwise(F.col("left"))
    rows = raw.select(left.alias("h_left"), F.col("right").alias("h_right"), epoch.alias("epoch")).groupBy(PAIR).agg(F.max("epoch").alias("epoch"), F.count("*").alias("n"))
    return rows.withColumn("epoch", F.when(F.col("n") == 1, F.col("epoch")).otherwise(F.raise_error(F.lit("a relation has two floors")).cast("bigint"))).drop("n")


def compare(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one table that the other has not, with side, without the ignored columns (timings)."""
    a, b = a.drop(*ignore), b.drop(*ignore)
    return a.exceptAll(b.select(a.columns)).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a.select(b.columns)).withColumn("side", F.lit("second")))


def ranges(df: DataFrame, *columns: str) -> DataFrame:
    """The least and the greatest of each column."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def answer_kinds(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One count for each kind of answer, and the rest, null ones too, as unavailable."""
    known = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    return df.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count_if(~known).alias("unavailable"))


def bounded_response(df: DataFrame, compact: DataFrame, key: list[str], limit: int) -> DataFrame:
    """df's rows by key with form and bytes: `full` where the JSON of a row stays within the limit,
    else `compact` where that of compact's row of the same key does, else `rejected`, without body."""
    body = lambda x, name: x.select(*key, F.to_json(F.struct(*[c for c in x.columns if c not in key])).alias(name))
    both = body(df, "full").join(body(compact, "compact"), key, "left")
    fits = lambda name: F.octet_length(name) <= limit
    form = F.when(fits("full"), "full").when(F.coalesce(fits("compact"), F.lit(False)), "compact").otherwise("rejected")
    answer = F.when(fits("full"), F.col("full")).when(fits("compact"), F.col("compact"))
    return both.select(*key, form.alias("form"), answer.alias("body"), F.coalesce(F.octet_length(answer), F.lit(0)).cast("bigint").alias("bytes"))


def payload_bytes(deliveries: DataFrame, *by: str) -> DataFrame:
    """Deliveries and the bytes of their cells as compact JSON with keys in order."""
    size = serialized_bytes(F.struct("epoch", F.col("h_left").alias("left"), "reason", F.col("h_right").alias("right"), "source", "vote"))
    return deliveries.groupBy(*by).agg(F.count("*").alias("n"), F.sum(size).alias("payload_bytes"))


def action_counts(events: DataFrame, actions: tuple[str, ...], *by: str) -> DataFrame:
    """How many events have each action."""
    return events.groupBy(*by).agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions])


def phase_totals(events: DataFrame, *by: str) -> DataFrame:
    """The time of each phase: calls and checks, missing checks as none."""
    return events.groupBy(*by, "phase").agg(F.sum(F.col("rpc_ns") + F.coalesce("checker_ns", F.lit(0))).alias("total_ns"))


def canonical(cells: DataFrame) -> DataFrame:
    """Cells in the order in which states are written."""
    return cells.orderBy("h_left", "h_right", "epoch", "source", "vote", "reason")


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows of a query list."""
    return df.orderBy(order).limit(n)


def ordered_distinct(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Distinct rows with the place at which each was first seen."""
    return df.groupBy(*columns).agg(F.min(order).alias(order))


def median_ranges(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Of each column the median, least and greatest value of a group. Groups are null-safe."""
    ends = df.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    middle = medians(df, columns, by).toDF(*[f"__{c}" for c in by], *[f"{c}_median" for c in columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return ends.join(middle, same, "left").select(*by, *[f"{c}_{n}" for c in columns for n in ("median", "min", "max")])


def equal_work(df: DataFrame, group: str, layout: str, mean: str, totals: list[str], measured: list[str], always: dict[str, Column]) -> DataFrame:
    """One row a group: cases, the mean of `mean` over all and by layout (an array in the order of
    layouts), totals, medians with ranges of the measured columns, and what holds for every case."""
    of_layout = df.groupBy(group, layout).agg(F.avg(mean).alias("m")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(layout).alias("layout"), F.col("m").alias("mean")))).alias("by_layout"))
    whole = df.groupBy(group).agg(F.count("*").alias("cases"), F.avg(mean).alias(f"{mean}_mean"), *[F.sum(c).alias(f"{c}_total") for c in totals], *[F.bool_and(x).alias(k) for k, x in always.items()])
    return whole.join(of_layout, group).join(median_ranges(df, [group], measured), group)


def implementation_medians(df: DataFrame, case: list[str], family: str, kind: str, kinds: list[str], value: str, base: str) -> DataFrame:
    """Nested medians of several implementations: of each case, then of each family, with the median,
    least and greatest ratio to `base` of the cases."""
    cases = medians(df, [value], [family, *case, kind]).groupBy(family, *case).pivot(kind, kinds).agg(F.first(f"{value}_median"))
    others = [k for k in kinds if k != base]
    rates = staged(cases.withColumns({f"{k}_over_{base}": F.col(k) / F.col(base) for k in others}), "cases")
    ranges = median_ranges(rates, [family], [*kinds, *[f"{k}_over_{base}" for k in others]])
    ratio = [f"{k}_over_{base}_{n}" for k in others for n in ("median", "min", "max")]
    whole = rates.groupBy(family).agg(F.count("*").alias("cases")).join(ranges.withColumnRenamed(family, "__f"), F.col(family).eqNullSafe(F.col("__f")))
    return whole.select(family, "cases", *[f"{k}_median" for k in kinds], *ratio)


def write_plans(df: DataFrame, path: str) -> None:
    """Rows as gzip JSON lines; spark.read.json reads them back."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)
