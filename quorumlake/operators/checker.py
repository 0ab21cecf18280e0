"""Checks certificates against a store, with plans of its own: it imports no decision, partition or
certificate code. Decisions are ranked by window functions, the partition is rebuilt from them, and
an ambiguous certificate is refused if any plan is better than the one it states."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.components import connected_components
from quorumlake.schema import DIFFERENT, PAIR, SAME, UNKNOWN, Evidence
from quorumlake.session import discard, staged

#: Relations of a conflicted component that one task rebuilds; larger ones are rebuilt in rounds.
MOST_RELATIONS = 200_000


def recomputed(store: Evidence) -> DataFrame:
    """Each cell's relation with the epoch that speaks and its vote, by windows over the cells."""
    epoch = Window.partitionBy(*PAIR, "epoch")
    rows = store.cells.withColumn("n", F.size(F.collect_set("source").over(epoch)))
    latest = Window.partitionBy(*PAIR).orderBy((F.col("n") == len(store.sources)).desc(), F.col("epoch").desc())
    chosen = rows.withColumn("place", F.dense_rank().over(latest)).where("place = 1")
    votes = chosen.groupBy(*PAIR, "epoch", "n").pivot("vote", [SAME, DIFFERENT, UNKNOWN]).count().fillna(0, [SAME, DIFFERENT, UNKNOWN])
    sealed = F.col("n") == len(store.sources)
    vote = F.when(sealed & (F.col(DIFFERENT) > 0), DIFFERENT).when(sealed & (F.col(SAME) >= store.threshold), SAME).otherwise(UNKNOWN)
    return votes.select(*PAIR, "epoch", vote.alias("vote"))


def rebuilt(store: Evidence, own: DataFrame) -> DataFrame:
    """(handle, label): the partition, from own(h_left, h_right, vote). Groups of handles are kept as
    sets; a positive joins two of them unless a negative has an end in either. Components of more than
    MOST_RELATIONS relations are rebuilt in rounds of joins, see _in_rounds()."""
    same = own.where(F.col("vote") == SAME).select(*PAIR)
    whole = staged(connected_components(same, *PAIR).toDF("handle", "root"), "roots")
    root = lambda df, c, to: df.join(whole.toDF(c, to), c)
    inner = root(root(own.where(F.col("vote").isin(SAME, DIFFERENT)), "h_left", "root"), "h_right", "other").where("root = other").select("root", *PAIR, "vote")
    inner = staged(inner, "inner")
    torn = inner.groupBy("root").agg(F.count_if(F.col("vote") == DIFFERENT).alias("k"), F.count("*").alias("n")).where("k > 0")
    torn = staged(torn.select("root", (F.col("n") > MOST_RELATIONS).alias("large")), "torn")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        group = {h: {h} for h in {*part["h_left"], *part["h_right"]}}
        foes: dict[str, set[str]] = {h: set() for h in group}
        for a, b in part.loc[part["vote"] == DIFFERENT, PAIR].itertuples(index=False):
            foes[a].add(b)
            foes[b].add(a)
        for a, b in sorted(part.loc[part["vote"] == SAME, PAIR].itertuples(index=False, name=None)):
            x, y = sorted((group[a], group[b]), key=len)
            if x is not y and not any(foes[h] & y for h in x):
                y |= x
                group.update(dict.fromkeys(x, y))
        return pd.DataFrame([(h, min(g)) for h, g in group.items()], columns=["handle", "label"])

    split = inner.join(torn.where("not large"), "root", "left_semi").groupBy("root").applyInPandas(run, "handle string, label string")
    rest = staged(inner.join(torn.where("large"), "root", "left_semi").select(*PAIR, "vote"), "rest")
    if not rest.isEmpty():
        split = split.unionByName(_in_rounds(rest))
    sound = whole.join(torn, "root", "left_anti").select("handle", F.col("root").alias("label"))
    known = store.handles.select("handle").distinct()
    return known.join(sound.unionByName(split), "handle", "full").select("handle", F.coalesce("label", "handle").alias("label"))


def _in_rounds(rows: DataFrame) -> DataFrame:
    """(handle, label) of all ends of rows(h_left, h_right, vote), positives taken in order.

    Of the positives that still lie between two groups with no negative between them, one that is the
    first of both its groups is due: nothing before it can change either group. All that are due join
    at once; what a negative keeps apart stays so, as groups only grow.
    """
    ends = rows.select(F.explode(F.array(*PAIR)).alias("handle")).distinct()
    group = staged(ends.withColumn("label", F.col("handle")), "group")
    across = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in df.columns if c not in ("a", "b")])
    ordered = rows.where(F.col("vote") == SAME).select(F.col("h_left").alias("a"), F.col("h_right").alias("b"), F.struct(*PAIR).alias("turn"))
    positive, negative = staged(ordered, "positive"), staged(rows.where(F.col("vote") == DIFFERENT).select(F.col("h_left").alias("a"), F.col("h_right").alias("b")), "negative")
    while True:
        able = staged(across(positive).groupBy("a", "b").agg(F.min("turn").alias("turn")).join(across(negative), ["a", "b"], "left_anti"), "able")
        if able.isEmpty():
            return group
        turns = able.select("turn", F.explode(F.array("a", "b")).alias("g")).groupBy("g").agg(F.min("turn").alias("turn"))
        # a positive that leads in both of its groups is counted twice
        due = turns.groupBy("turn").count().where("count = 2").select("turn")
        joins = staged(able.join(due, "turn").select(F.col("b").alias("was"), F.col("a").alias("now")), "joins")
        follow = lambda df, c: df.join(joins.withColumnRenamed("was", c), c, "left").withColumn(c, F.coalesce("now", c)).drop("now")
        last = group, positive, negative, able
        group = staged(follow(group, "label").select("handle", "label"), "group")
        positive = staged(follow(follow(able, "a"), "b").select("a", "b", "turn"), "positive")
        negative = staged(across(follow(follow(negative, "a"), "b").select("a", "b")).distinct(), "negative")
        discard(*last)


def membership_violations(store: Evidence, membership: DataFrame) -> DataFrame:
    """(handle, label, rebuilt): handles whose label is not the one that the store's cells give."""
    own = rebuilt(store, recomputed(store)).withColumnRenamed("label", "rebuilt")
    return membership.select("handle", "label").join(own, "handle", "full").where("label is null or rebuilt is null or label <> rebuilt")


def check(store: Evidence, certificates: DataFrame) -> DataFrame:
    """(q_left, q_right, kind, ok): whether each certificate proves its answer.

    same: the path runs from end to end over SAME relations inside one component. different: the
    cell is a DIFFERENT vote of the speaking epoch, between the two components. ambiguous: the pairs
    are UNKNOWN or absent, chain the components of the path, cost the stated gap, no two components
    of the path are separated, and no plan is better: cheaper, of fewer relations, or smaller.
    Components are rebuilt from the store.
    """
    own, q = staged(recomputed(store), "recomputed"), ["q_left", "q_right"]
    membership = staged(rebuilt(store, own), "rebuilt")
    label = lambda name, to: membership.select(F.col("handle").alias(name), F.col("label").alias(to))
    ends = certificates.join(label("q_left", "x"), "q_left").join(label("q_right", "y"), "q_right")
    hops = ends.where("kind = 'same'").select(*q, "x", "y", F.expr("same.path").alias("path"))
    hop = F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as u, path[i] as v))")).alias("s")
    hops = hops.select(*q, "x", "y", "path", hop).select("*", F.least("s.u", "s.v").alias("h_left"), F.greatest("s.u", "s.v").alias("h_right")).join(own, PAIR, "left").join(label("h_left", "at"), "h_left")
    same = hops.groupBy(*q).agg(
        F.bool_and(F.coalesce(F.col("vote") == SAME, F.lit(False)) & (F.col("at") == F.col("x")) & (F.col("x") == F.col("y")) & (F.element_at("path", 1) == F.col("q_left")) & (F.element_at("path", -1) == F.col("q_right"))).alias("ok")
    )
    proof = ends.where("kind = 'different'").select(*q, "x", "y", "different.*").toDF(*q, "x", "y", "h_left", "h_right", "epoch", "source")
    proof = proof.join(own.withColumnRenamed("vote", "decided"), [*PAIR, "epoch"], "left").join(store.cells.select(*PAIR, "epoch", "source", "vote"), [*PAIR, "epoch", "source"], "left")
    proof = proof.join(label("h_left", "u"), "h_left").join(label("h_right", "v"), "h_right")
    crosses = (F.least("u", "v") == F.least("x", "y")) & (F.greatest("u", "v") == F.greatest("x", "y")) & (F.col("u") != F.col("v"))
    different = proof.select(*q, F.coalesce((F.col("decided") == DIFFERENT) & (F.col("vote") == DIFFERENT) & crosses, F.lit(False)).alias("ok"))
    return certificates.select(*q, "kind").join(same.unionByName(different).unionByName(_ambiguous(store, membership, ends, own)), q, "left").select(*q, "kind", F.coalesce("ok", F.lit(False)).alias("ok"))


def _costs(store: Evidence, own: DataFrame) -> DataFrame:
    """(h_left, h_right, cost): source positions that a relation which is not decided still takes."""
    votes = store.cells.groupBy(*PAIR, "epoch").agg(*[F.count_if(F.col("vote") == v).alias(f"n_{v}") for v in (SAME, DIFFERENT, UNKNOWN)])
    missing = len(store.sources) - F.col("n_same") - F.col("n_different") - F.col("n_unknown")
    cost = missing + F.col("n_different") + F.greatest(F.lit(0), store.threshold - F.col("n_same") - missing - F.col("n_different"))
    return own.where(F.col("vote") == UNKNOWN).join(votes, [*PAIR, "epoch"]).select(*PAIR, cost.cast("int").alias("cost"))


def better_plans(asked: DataFrame, membership: DataFrame, split: DataFrame, costs: DataFrame, n_sources: int) -> DataFrame:
    """(q_left, q_right): queries of asked(q_left, q_right, x, y, stated) that have a better plan than
    the stated (cost, n, pairs, path).

    All simple paths are tried, relation by relation, that cost no more than the stated plan; as each
    relation costs one at least, there are no more rounds than the dearest plan costs.
    """
    q = ["q_left", "q_right"]
    label = lambda name, to: membership.select(F.col("handle").alias(name), F.col("label").alias(to))
    crossing = costs.join(label("h_left", "u"), "h_left").join(label("h_right", "v"), "h_right").where("u <> v")
    pair = F.struct(*PAIR).alias("pair")
    arcs = crossing.select(F.col("u").alias("at"), F.col("v").alias("to"), "cost", pair).unionByName(crossing.select(F.col("v").alias("at"), F.col("u").alias("to"), "cost", pair))
    arcs = staged(arcs, "arcs")
    own = F.struct(F.least(*q).alias("h_left"), F.greatest(*q).alias("h_right"))
    direct = asked.withColumn("own", own).join(costs.select(pair, F.lit(True).alias("known")), F.col("own") == F.col("pair"), "left").where("known is null")
    plan = lambda cost, pairs, path: F.struct(cost.alias("cost"), F.size(pairs).alias("n"), pairs.alias("pairs"), path.alias("path"))
    found = direct.where(plan(F.lit(n_sources), F.array("own"), F.array("x", "y")) < F.col("stated")).select(*q)
    none = F.expr("cast(array() as array<struct<h_left:string,h_right:string>>)")
    front = staged(asked.select(*q, "y", "stated", F.col("x").alias("at"), F.array("x").alias("path"), F.lit(0).alias("spent"), none.alias("pairs")), "front")
    while not front.isEmpty():
        grown = front.join(arcs, "at").where((F.col("spent") + F.col("cost") <= F.col("stated.cost")) & ~F.array_contains("path", F.col("to")))
        reached = staged(grown.select(*q, "path", "to").distinct(), "reached")
        pairs = reached.select(*q, "path", "to", F.explode("path").alias("c")).select(*q, "path", "to", F.least("c", "to").alias("c"), F.greatest("c", "to").alias("d"))
        barred = pairs.join(split, ["c", "d"], "left_semi").select(*q, "path", "to").distinct()
        grown = staged(grown.join(barred, [*q, "path", "to"], "left_anti").select(*q, "y", "stated", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), (F.col("spent") + F.col("cost")).alias("spent"), F.concat("pairs", F.array("pair")).alias("pairs")), "grown")
        found = found.unionByName(grown.where("at = y").where(plan(F.col("spent"), F.col("pairs"), F.col("path")) < F.col("stated")).select(*q))
        front = grown.where((F.col("at") != F.col("y")) & (F.col("spent") < F.col("stated.cost")))
    return found.distinct()


def _ambiguous(store: Evidence, membership: DataFrame, ends: DataFrame, own: DataFrame) -> DataFrame:
    q = ["q_left", "q_right"]
    rows = ends.where("kind = 'ambiguous'").select(*q, "x", "y", "ambiguous.*")
    steps = rows.select(*q, "component_path", F.posexplode("pairs").alias("i", "p")).select(*q, "i", "component_path", "p.*")
    label = lambda name, to: membership.select(F.col("handle").alias(name), F.col("label").alias(to))
    costs = staged(_costs(store, own), "costs")
    steps = steps.join(own.select(*PAIR, "vote"), PAIR, "left").join(costs, PAIR, "left").join(label("h_left", "u"), "h_left").join(label("h_right", "v"), "h_right")
    a, b = F.get("component_path", F.col("i")), F.get("component_path", F.col("i") + 1)
    chained = ((F.col("u") == a) & (F.col("v") == b)) | ((F.col("u") == b) & (F.col("v") == a))
    fit = F.coalesce(F.col("vote"), F.lit(UNKNOWN)) == UNKNOWN
    sums = steps.groupBy(*q).agg(F.sum(F.coalesce("cost", F.lit(len(store.sources)))).alias("cost"), F.bool_and(F.coalesce(chained & fit, F.lit(False))).alias("sound"))
    both = rows.select(*q, F.explode("component_path").alias("c"), "component_path").select(*q, "c", F.explode("component_path").alias("d")).where("c < d")
    crossing = own.where(F.col("vote") == DIFFERENT).join(label("h_left", "c"), "h_left").join(label("h_right", "d"), "h_right")
    split = staged(crossing.select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct(), "split")
    bad = both.join(split, ["c", "d"], "left_semi").select(*q)
    stated = F.struct(F.col("gap").cast("int").alias("cost"), F.col("edge_count").cast("int").alias("n"), "pairs", F.col("component_path").alias("path"))
    bad = bad.unionByName(better_plans(rows.select(*q, "x", "y", stated.alias("stated")), membership, split, costs, len(store.sources)))
    done = rows.join(sums, q).join(bad.distinct().withColumn("bad", F.lit(True)), q, "left")
    ends_fit = (F.element_at("component_path", 1) == F.col("x")) & (F.element_at("component_path", -1) == F.col("y"))
    return done.select(*q, (F.col("sound") & (F.col("cost") == F.col("gap")) & (F.size("pairs") == F.col("edge_count")) & F.col("bad").isNull() & ends_fit).alias("ok"))
