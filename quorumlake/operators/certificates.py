"""Certificates for batches of pair queries: why two handles are the same, different, or what it
would take to know. All queries share one partition; none rebuilds it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.components import connected_components
from quorumlake.operators.decisions import authorization_gap, decisions, source_slots
from quorumlake.operators.partition import fold, partition, quotient_edges, separators, with_ends
from quorumlake.schema import DIFFERENT, PAIR, SAME, UNKNOWN, Evidence
from quorumlake.session import staged


class Views:
    """A store's decisions, partition and separators, computed once and staged."""

    def __init__(self, store: Evidence) -> None:
        self.store = store
        self.decided = staged(decisions(store), "decisions")
        self.membership = staged(partition(store.handles, self.decided), "membership")
        self.separated = staged(separators(self.decided, self.membership), "separators")

    def gaps(self) -> DataFrame:
        """Slots and authorization gaps of the UNKNOWN relations."""
        unknown = self.decided.where(F.col("vote") == UNKNOWN)
        return authorization_gap(source_slots(self.store, unknown), self.store.threshold)


def classify(queries: DataFrame, views: Views) -> DataFrame:
    """queries(q_left, q_right) with l_label, r_label and kind. A pair of equal handles or with an
    unregistered one is an error when it is read."""
    ends = queries.join(views.membership.toDF("q_left", "l_label"), "q_left", "left").join(views.membership.toDF("q_right", "r_label"), "q_right", "left")
    wrong = F.col("l_label").isNull() | F.col("r_label").isNull() | (F.col("q_left") == F.col("q_right"))
    ends = ends.withColumn("q_left", F.when(wrong, F.raise_error(F.concat_ws(" ", F.lit("no such pair:"), "q_left", "q_right"))).otherwise(F.col("q_left")))
    between = ends.withColumn("a", F.least("l_label", "r_label")).withColumn("b", F.greatest("l_label", "r_label"))
    found = between.join(views.separated.withColumn("split", F.lit(True)), ["a", "b"], "left")
    kind = F.when(F.col("l_label") == F.col("r_label"), SAME).when(F.col("split"), DIFFERENT).otherwise("ambiguous")
    return found.select("q_left", "q_right", "l_label", "r_label", kind.alias("kind"))


def _further(front: DataFrame, before: DataFrame, steps: DataFrame, onto: Callable[[str, str], Column]) -> DataFrame:
    """The next level of a search: (end, node, path), the smallest path of each node reached anew."""
    grown = front.join(steps, "node").select("end", F.col("next").alias("node"), onto("path", "next").alias("path"))
    seen = before.select("end", "node").unionByName(front.select("end", "node"))
    return staged(grown.join(seen, ["end", "node"], "left_anti").groupBy("end", "node").agg(F.min("path").alias("path")), "level")


def same_paths(asked: DataFrame, views: Views) -> DataFrame:
    """(q_left, q_right, path): the shortest path of accepted edges, the smallest of equals.

    Searches run from both ends in turn, a level a round: from a left end with the smallest path to
    each handle, from a right end with the smallest path on from it. Queries of one end share its
    search. A query leaves when its searches first meet, which is after half of its path from either
    side; of all handles they meet at, the smallest whole path is the answer. Edges run both ways, so
    what a level reaches anew can have been seen in it and the one before alone.
    """
    q = ["q_left", "q_right"]
    accepted = with_ends(views.decided.where(F.col("vote") == SAME).select(*PAIR), views.membership).where("l_label = r_label").select(*PAIR)
    steps = staged(accepted.toDF("node", "next").unionByName(accepted.select(F.col("h_right").alias("node"), F.col("h_left").alias("next"))), "steps")
    open_ = staged(asked.select(*q).distinct(), "open")
    begin = lambda c: open_.select(F.col(c).alias("end"), F.col(c).alias("node"), F.array(c).alias("path")).distinct()
    ahead = [staged(begin(c), "front") for c in q]
    before = list(ahead)
    onto = lambda path, step: F.concat(path, F.array(step)), lambda path, step: F.concat(F.array(step), path)
    out, side = open_.select(*q, F.array("q_left").alias("path")).limit(0), 0
    while not open_.isEmpty():
        level = _further(ahead[side], before[side], steps, onto[side])
        before[side], ahead[side] = ahead[side], level
        heads, tails = ahead[0].toDF("q_left", "node", "head"), ahead[1].toDF("q_right", "node", "tail")
        met = open_.join(heads, "q_left").join(tails, ["q_right", "node"])
        met = staged(met.groupBy(*q).agg(F.min(F.concat("head", F.slice("tail", F.lit(2), F.size("tail")))).alias("path")), "met")
        out = out.unionByName(met)
        open_ = staged(open_.join(met, q, "left_anti"), "open")
        if level.isEmpty():  # one side has seen its whole component: the rest aren't connected
            break
        still = [open_.select(F.col(c).alias("end")).distinct() for c in q]
        ahead = [df.join(some, "end", "left_semi") for df, some in zip(ahead, still, strict=True)]
        side = 1 - side
    return out


def witnesses(asked: DataFrame, views: Views) -> DataFrame:
    """(q_left, q_right, w_left, w_right, epoch, source): the first DIFFERENT relation between the
    two components and its first DIFFERENT cell."""
    crossing = with_ends(views.decided.where(F.col("vote") == DIFFERENT).select(*PAIR, "epoch"), views.membership)
    side = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = crossing.groupBy(*side("l_label", "r_label")).agg(F.min(F.struct(*PAIR, "epoch")).alias("w")).select("a", "b", "w.*")
    cells = views.store.cells.where(F.col("vote") == DIFFERENT).groupBy(*PAIR, "epoch").agg(F.min("source").alias("source"))
    proof = first.join(cells, [*PAIR, "epoch"]).toDF("w_left", "w_right", "epoch", "a", "b", "source")
    return asked.select("q_left", "q_right", *side("l_label", "r_label")).join(proof, ["a", "b"]).drop("a", "b")


def plans(asked: DataFrame, views: Views) -> DataFrame:
    """(q_left, q_right, gap, edge_count, component_path, pairs): the cheapest set of UNKNOWN
    relations whose authorization joins the two components without joining any separated ones.

    Paths grow by one component a round, for all queries at once. A path that can't beat its query's
    best plan stops; every relation costs one source position at least and a direct relation costs
    all of them at most, so there are fewer rounds than sources. Of parallel relations between two
    components only the cheapest, then smallest, can be in a best plan.
    """
    n = len(views.store.sources)
    reduced = quotient_edges(views.gaps(), views.membership, views.separated).groupBy("a", "b").agg(F.min(F.struct("gap", *PAIR)).alias("e"))
    edges = staged(reduced.select("a", "b", "e.*"), "quotient")
    both = edges.toDF("node", "next", "gap", *PAIR).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next"), "gap", *PAIR))
    start = asked.select("q_left", "q_right", F.col("l_label").alias("node"), F.col("r_label").alias("goal"), F.array("l_label").alias("path"))
    empty = F.expr("cast(array() as array<struct<h_left:string,h_right:string>>)").alias("pairs")
    front = staged(start.select("*", F.lit(0).alias("cost"), empty), "front")
    pair = (F.least("q_left", "q_right").alias("h_left"), F.greatest("q_left", "q_right").alias("h_right"))
    # a relation that no source has spoken of yet: all positions are missing
    absent = asked.select("q_left", "q_right", "l_label", "r_label", *pair).join(views.decided.where(F.col("vote") == UNKNOWN).select(*PAIR), PAIR, "left_anti")
    objective = F.struct("cost", F.size("pairs").alias("n"), "pairs", "path")
    direct = absent.select("q_left", "q_right", F.lit(n).alias("cost"), F.array(F.struct(*PAIR)).alias("pairs"), F.array("l_label", "r_label").alias("path"))
    best = staged(direct.select("q_left", "q_right", objective.alias("best")), "best")
    for _ in range(n):
        grown = front.join(both, "node").where(~F.array_contains("path", F.col("next"))).select(
            "q_left", "q_right", F.col("next").alias("node"), "goal", F.col("path").alias("before"),
            F.concat("path", F.array("next")).alias("path"), (F.col("cost") + F.col("gap")).alias("cost"), F.concat("pairs", F.array(F.struct(*PAIR))).alias("pairs"),
        )
        grown = staged(grown, "grown")
        met = grown.select("q_left", "q_right", "path", "node", F.explode("before").alias("c")).select("q_left", "q_right", "path", F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
        apart = met.join(views.separated, ["a", "b"], "left_semi").select("q_left", "q_right", "path").distinct()
        sound = grown.join(apart, ["q_left", "q_right", "path"], "left_anti")
        ends = sound.where("node = goal").select("q_left", "q_right", objective.alias("best"))
        best = staged(best.unionByName(ends).groupBy("q_left", "q_right").agg(F.min("best").alias("best")), "best")
        open_ = sound.where("node <> goal").join(best, ["q_left", "q_right"], "left").where("best is null or cost < best.cost")
        front = staged(open_.select("q_left", "q_right", "node", "goal", "path", "cost", "pairs"), "front")
        if front.isEmpty():
            break
    return best.select("q_left", "q_right", F.col("best.cost").alias("gap"), F.col("best.n").alias("edge_count"), F.col("best.path").alias("component_path"), F.col("best.pairs").alias("pairs"))


def plan_cells(found: DataFrame, store: Evidence) -> DataFrame:
    """(q_left, q_right, h_left, h_right, epoch, source, vote): the cells that carry a plan out, one
    fresh sealed epoch above all that a relation has."""
    top = store.cells.groupBy(PAIR).agg(F.max("epoch").alias("top"))
    steps = found.select("q_left", "q_right", F.explode("pairs").alias("p")).select("q_left", "q_right", "p.*").join(top, PAIR, "left")
    source = F.explode(F.array(*[F.lit(s) for s in store.sources])).alias("source")
    return steps.select("q_left", "q_right", *PAIR, (F.coalesce("top", F.lit(-1)) + 1).alias("epoch"), source, F.lit(SAME).alias("vote"))


def execute_plans(found: DataFrame, views: Views) -> DataFrame:
    """(q_left, q_right, n_cells, last_epoch, kind): each plan carried out by itself, and the answer
    to its query after that.

    A plan's cells make its relations SAME. That can change the partition only within the
    components of the SAME graph that the plan's relations touch, so each query's own part of the
    decisions, with its plan in it, is made into a partition anew.
    """
    q = ["q_left", "q_right"]
    cells = staged(plan_cells(found, views.store), "plan_cells")
    counts = cells.groupBy(*q).agg(F.count("*").alias("n_cells"), F.max("epoch").alias("last_epoch"))
    fresh = staged(cells.select(*q, *PAIR).distinct(), "fresh")
    same = views.decided.where(F.col("vote") == SAME).select(*PAIR)
    cc = staged(connected_components(same, *PAIR).toDF("handle", "cc"), "cc")
    at = lambda df, c: df.join(cc.toDF(c, "cc"), c, "left").withColumn("cc", F.coalesce("cc", c))
    ends = fresh.select(*q, F.explode(F.array(*PAIR)).alias("handle"))
    touched = staged(at(ends, "handle").select(*q, "cc").distinct(), "touched")
    old = views.decided.where(F.col("vote").isin(SAME, DIFFERENT)).select(*PAIR, "vote")
    inner = at(at(old, "h_left").withColumnRenamed("cc", "x"), "h_right").withColumnRenamed("cc", "y")
    own = touched.withColumnRenamed("cc", "x").join(inner, "x").join(touched.withColumnRenamed("cc", "y"), [*q, "y"]).select(*q, *PAIR, "vote")
    rows = own.join(fresh, [*q, *PAIR], "left_anti").unionByName(fresh.withColumn("vote", F.lit(SAME)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pairs = [(v, (a, b)) for a, b, v in zip(part["h_left"], part["h_right"], part["vote"], strict=True)]
        label = fold([p for v, p in pairs if v == SAME], [p for v, p in pairs if v != SAME])
        return pd.DataFrame({"q_left": [key[0]], "q_right": [key[1]], "kind": [SAME if label.get(key[0], key[0]) == label.get(key[1], key[1]) else "other"]})

    answers = rows.groupBy(*q).applyInPandas(run, "q_left string, q_right string, kind string")
    return counts.join(answers, q)


def certificates(queries: DataFrame, store: Evidence) -> DataFrame:
    """One row a query: kind and, by kind, same{path}, different{...}, ambiguous{...}."""
    views = Views(store)
    asked = staged(classify(queries.distinct(), views), "asked")
    of = lambda kind: asked.where(F.col("kind") == kind)
    q = ["q_left", "q_right"]
    same = same_paths(of(SAME), views).select(*q, F.struct("path").alias("same"))
    different = witnesses(of(DIFFERENT), views).select(*q, F.struct(F.col("w_left"), F.col("w_right"), F.col("epoch"), F.col("source")).alias("different"))
    ambiguous = plans(of("ambiguous"), views).select(*q, F.struct("gap", "edge_count", "component_path", "pairs").alias("ambiguous"))
    return asked.select(*q, "kind").join(same, q, "left").join(different, q, "left").join(ambiguous, q, "left")
