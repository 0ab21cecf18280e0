"""Pairwise predicates over observations, partition metrics and reporting rollups."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.scalars import fraction, jaccard, pairs_of, ratio
from quorumlake.schema import DIFFERENT, SAME, UNKNOWN
from quorumlake.session import staged

#: A predicate maps two observation structs to a (vote, reason) struct of columns.
Predicate = Callable[[Column, Column], Column]


# The reasons that votes carry.
SIGNATURE_REASON = "successful-endpoint-and-http-signature"
CONFLICTS_REASON = "disjoint-endpoints-and-two-http-conflicts"
INSUFFICIENT_REASON = "insufficient-independent-evidence"
OVERLAP_REASON = "endpoint-overlap"
NO_OVERLAP_REASON = "no-observed-endpoint-overlap"


def conservative(header_conflict_threshold: float = 0.25) -> Predicate:
    """SAME takes a shared endpoint that answered and one HTTP signature; DIFFERENT takes disjoint
    endpoints that answered and two HTTP conflicts; all else is UNKNOWN."""
    if not 0 <= header_conflict_threshold <= 1:
        raise ValueError("the header threshold lies in [0, 1]")

    def vote(a: Column, b: Column) -> Column:
        overlap = F.arrays_overlap(a["endpoints"], b["endpoints"])
        answered = a["tcp_success"] & b["tcp_success"]
        http = F.coalesce(a["status"].between(100, 599) & b["status"].between(100, 599), F.lit(False))
        titles = (a["title"] != "") & (b["title"] != "")
        headers = (F.size(a["headers"]) > 0) & (F.size(b["headers"]) > 0)
        alike = jaccard(a["headers"], b["headers"])
        signature = http & (a["status"] == b["status"]) & ((titles & (a["title"] == b["title"])) | (headers & (alike >= 0.5)))
        conflicts = (
            F.floor(a["status"] / 100).__ne__(F.floor(b["status"] / 100)).cast("int")
            + (titles & (a["title"] != b["title"])).cast("int")
            + (headers & (alike <= header_conflict_threshold)).cast("int")
        )
        ends = (F.size(a["endpoints"]) > 0) & (F.size(b["endpoints"]) > 0) & ~overlap
        result = lambda v, r: F.struct(F.lit(v).alias("vote"), F.lit(r).alias("reason"))
        return (
            F.when(overlap & answered & signature, result(SAME, SIGNATURE_REASON))
            .when(ends & answered & http & (conflicts >= 2), result(DIFFERENT, CONFLICTS_REASON))
            .otherwise(result(UNKNOWN, INSUFFICIENT_REASON))
        )

    return vote


def endpoint_only(a: Column, b: Column) -> Column:
    """A closed-world control: no shared endpoint means DIFFERENT."""
    overlap = F.arrays_overlap(a["endpoints"], b["endpoints"])
    return F.struct(F.when(overlap, SAME).otherwise(DIFFERENT).alias("vote"), F.when(overlap, OVERLAP_REASON).otherwise(NO_OVERLAP_REASON).alias("reason"))


def enumerate_pairs(observations: DataFrame, block: str | None = None) -> DataFrame:
    """(a, b) structs of all unordered pairs, a before b by (case_id, vantage).

    Pairs of everything grow with the square of the rows; the operator is meant for case studies.
    With `block`, pairs are taken within equal values of that column, by an equi join.
    """
    rows = observations.select(F.struct(*observations.columns).alias("o"), F.concat_ws("\x01", "case_id", "vantage").alias("id"), *([F.col(block).alias("block")] if block else [F.lit(0).alias("block")]))
    return rows.toDF("a", "ida", "block").join(rows.toDF("b", "idb", "block"), "block").where("ida < idb").select("a", "b")


def pair_decisions(observations: DataFrame, predicate: Predicate | None = None, block: str | None = None) -> DataFrame:
    """Pairs with case_a, case_b, target_a, target_b, vantage_a, vantage_b, truth, vote, reason."""
    predicate = predicate or conservative()
    truth = F.when(F.col("a.target_id") == F.col("b.target_id"), SAME).otherwise(DIFFERENT)
    names = [F.col(f"{s}.{c}").alias(f"{n}_{s}") for c, n in (("case_id", "case"), ("target_id", "target"), ("vantage", "vantage")) for s in ("a", "b")]
    return enumerate_pairs(observations, block).select(*names, truth.alias("truth"), predicate(F.col("a"), F.col("b")).alias("p")).select("*", "p.vote", "p.reason").drop("p")


def _counts() -> list[Column]:
    n = lambda c: F.count_if(c)
    truth, vote = F.col("truth"), F.col("vote")
    return [
        F.count("*").alias("pairs"), n(truth == SAME).alias("true_same"), n(truth == DIFFERENT).alias("true_different"),
        n(vote == SAME).alias("predicted_same"), n(vote == DIFFERENT).alias("predicted_different"), n(vote == UNKNOWN).alias("predicted_unknown"),
        n((vote == SAME) & (truth != SAME)).alias("false_same"), n((vote == DIFFERENT) & (truth != DIFFERENT)).alias("false_different"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    c = F.col
    asserted = c("predicted_same") + c("predicted_different")
    return df.withColumns({
        "coverage": ratio(asserted, c("pairs")),
        "asserted_error_rate": ratio(c("false_same") + c("false_different"), asserted),
        "same_precision": ratio(c("predicted_same") - c("false_same"), c("predicted_same")),
        "same_recall": ratio(c("predicted_same") - c("false_same"), c("true_same")),
        "different_precision": ratio(c("predicted_different") - c("false_different"), c("predicted_different")),
        "different_recall": ratio(c("predicted_different") - c("false_different"), c("true_different")),
    })


def summarize(decided: DataFrame, *by: str) -> DataFrame:
    """The 14 metrics of decided pairs, one row or one a group."""
    return _rates(decided.groupBy(*by).agg(*_counts()))


def leave_one_out(decided: DataFrame, column: str) -> DataFrame:
    """Metrics without each value of `target` or `case`: all pairs less those that touch it, so pairs
    are aggregated once and no pair is copied to every fold."""
    names = [c.split(" AS ")[0] for c in ("pairs", "true_same", "true_different", "predicted_same", "predicted_different", "predicted_unknown", "false_same", "false_different")]
    touched = decided.select(F.explode(F.array_distinct(F.array(f"{column}_a", f"{column}_b"))).alias("fold"), "truth", "vote").groupBy("fold").agg(*_counts())
    total = decided.agg(*[c.alias(f"all_{n}") for c, n in zip(_counts(), names, strict=True)])
    left = touched.crossJoin(F.broadcast(total)).select("fold", *[(F.col(f"all_{n}") - F.col(n)).alias(n) for n in names])
    return _rates(left)


def partition_metrics(membership: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairs judged and true pairs, false merges and false splits with their rates, over
    membership(handle, label) and truth(handle, service)."""
    both = membership.join(truth.select("handle", "service"), "handle").groupBy("label", "service").agg(F.count("*").alias("n"))
    within = lambda *by: both.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0)).alias("p"))
    merged, true, right = within("label").toDF("merged"), within("service").toDF("true_pairs"), both.agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0)).alias("right"))
    row = merged.crossJoin(true).crossJoin(right)  # three single rows
    rows = row.select("merged", "true_pairs", (F.col("merged") - F.col("right")).alias("false_merges"), (F.col("true_pairs") - F.col("right")).alias("false_splits"))
    return rows.withColumn("false_merge_rate", ratio(F.col("false_merges"), F.col("merged"))).withColumn("false_split_rate", ratio(F.col("false_splits"), F.col("true_pairs")))


def selected(df: DataFrame, value: str, by: list[str], *places: Callable[[Column], Column]) -> DataFrame:
    """(by, k, value): for the k-th place function, the value at that zero-based place of each group's
    sorted values; a place maps the group's size to it. Null values have no place.

    Equal values are counted before they move, so ties are one row. Rows are dealt by range of (group,
    value) and counted up over ranges; a group's place lies in one of its ranges, and only that one's
    rows are looked at. A hot group is many tasks, and no task holds a group.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    dealt = staged(counted.repartitionByRange(ranges, *by, value).withColumn("__r", F.spark_partition_id()), "ranges")
    # a row a group and range: ranges of one group, or groups of one range
    parts = dealt.groupBy(*by, "__r").agg(F.sum("__n").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.sum("__rows").over(Window.partitionBy(*by))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), f(size).cast("bigint").alias("at")) for k, f in enumerate(places)])
    asked = parts.withColumn("__before", before).withColumn("__w", wanted).withColumn("__w", F.explode("__w"))
    asked = asked.where("__w.at >= __before and __w.at < __before + __rows").select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__r").alias("__in"), "__w.k", (F.col("__w.at") - F.col("__before")).alias("__at"))
    up_to = F.sum("__n").over(Window.partitionBy(*by, "__r").orderBy(value))
    rows = dealt.withColumn("__end", up_to).withColumn("__start", F.col("__end") - F.col("__n"))
    same = F.col("__r") == F.col("__in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(asked, same & (F.col("__at") >= F.col("__start")) & (F.col("__at") < F.col("__end"))).select(*by, "k", value)


def order_statistic(df: DataFrame, value: str, by: list[str], place: Callable[[Column], Column]) -> DataFrame:
    """The value at a zero-based place of each group's sorted values."""
    return selected(df, value, by, place).select(*by, value)


def medians(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, {column}_median for each column): exact medians of a group's values that are not null, the
    mean of both middle ones where their number is even; null where there are none."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    middle = lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2)
    found = selected(df.select(*by, each).select(*by, "x.*"), "v", [*by, "column"], *middle)
    return found.groupBy(*by).agg(*[F.avg(F.when(F.col("column") == c, F.col("v"))).alias(f"{c}_median") for c in columns])


def scale_place(n: Column) -> Column:
    """The 95th percentile of scale reports: max(0, floor(0.95 n) - 1)."""
    return F.greatest(F.lit(0), F.floor(0.95 * n) - 1)


def rpc_place(n: Column) -> Column:
    """The 95th percentile of call reports: floor(0.95 (n - 1))."""
    return F.floor(0.95 * (n - 1))


def transient_merges(votes: DataFrame) -> DataFrame:
    """sequence, unsealed, sealed: whether a merge is ever seen while votes(sequence, i, vote, n,
    threshold) arrive in order: without sealing, at any prefix with enough positives and no
    negative; with it, at the full vector alone."""
    so_far = Window.partitionBy("sequence").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    run = votes.select("*", F.sum((F.col("vote") == SAME).cast("int")).over(so_far).alias("same"), F.max((F.col("vote") == DIFFERENT).cast("int")).over(so_far).alias("no"))
    merged = (F.col("same") >= F.col("threshold")) & (F.col("no") == 0)
    return run.groupBy("sequence").agg(F.bool_or(merged).alias("unsealed"), F.bool_or(merged & (F.col("i") == F.col("n") - 1)).alias("sealed"))


def placements(partitions: DataFrame, sites: int, quorum: int = 3) -> DataFrame:
    """By number of components: mean shares of the sites that one central site serves, and that a
    quorum serves from components with a majority of it, over all placements, as exact fractions,
    and which of both serves more. partitions(rgs): the component of each site."""
    q = [s for s in combinations(range(sites), quorum)]
    members = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in q])).alias("q")
    each = partitions.select("rgs", F.explode(F.sequence(F.lit(0), F.lit(sites - 1))).alias("central")).select("rgs", "central", members)
    served = F.expr("size(filter(rgs, x -> x = rgs[central]))"), F.expr(f"size(filter(rgs, x -> size(filter(q, i -> rgs[i] = x)) > {quorum // 2}))")
    rows = each.select((F.array_max("rgs") + 1).cast("bigint").alias("components"), served[0].cast("bigint").alias("c"), served[1].cast("bigint").alias("s"))
    sums = rows.groupBy("components").agg(
        F.count("*").alias("placements"), F.sum("c").alias("c"), F.sum("s").alias("s"),
        F.count_if(F.col("c") > F.col("s")).alias("central_gt_quorum"), F.count_if(F.col("s") > F.col("c")).alias("quorum_gt_central"), F.count_if(F.col("s") == F.col("c")).alias("equal"),
    )
    every = F.col("placements") * sites
    return sums.select("components", "placements", fraction(F.col("c"), every).alias("central_mean"), fraction(F.col("s"), every).alias("quorum_mean"), "central_gt_quorum", "quorum_gt_central", "equal")


def navigation_rollup(rows: DataFrame, site: str, step: str, value: str) -> DataFrame:
    """Rows, distinct values and changes between neighbouring steps, by site."""
    before = F.lag(value).over(Window.partitionBy(site).orderBy(step))
    changed = rows.select(site, value, (before.isNotNull() & (before != F.col(value))).cast("int").alias("changed"))
    return changed.groupBy(site).agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_values"), F.sum("changed").alias("n_changes"))
