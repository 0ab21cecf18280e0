"""Negative-safe partitions of handles.

SAME edges are taken in lexical order; an edge joins two components unless a DIFFERENT edge lies
between them. Joins happen along SAME edges alone, so a component of the SAME graph with no
DIFFERENT edge inside is accepted whole, and others can be worked on apart. A conflicted component
of up to FOLD_EDGES edges is folded in one task, small ones many in one call. A larger one is
contracted in rounds: the first open edge of both its ends is decided, as no earlier edge can touch
either, and components, edges and vetoes are relabelled by joins. Both give the sequential result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.components import connected_components
from quorumlake.operators.decisions import decisions
from quorumlake.operators.ranks import ranked
from quorumlake.schema import DIFFERENT, PAIR, SAME, UNKNOWN, Evidence
from quorumlake.session import discard, staged

#: SAME edges of a component, at most, and of several small ones, on average, that a task folds at once.
FOLD_EDGES, DEAL_EDGES = 200_000, 20_000
LABEL = "handle string, label string"


def fold(edges: list[tuple[str, str]], vetoes: list[tuple[str, str]]) -> dict[str, str]:
    """Label (smallest member) of each handle, by the greedy pass over sorted edges."""
    parent: dict[str, str] = {}
    against: dict[str, set[str]] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in vetoes:
        against.setdefault(a, set()).add(b)
        against.setdefault(b, set()).add(a)
        find(a), find(b)
    for a, b in sorted(edges):
        x, y = sorted((find(a), find(b)))
        if x == y or y in against.get(x, ()):
            continue
        parent[y] = x
        for other in against.pop(y, ()):  # vetoes name labels, so they follow the join
            against[other].discard(y)
            against[other].add(x)
            against.setdefault(x, set()).add(other)
    return {h: find(h) for h in parent}


def _folded(same: DataFrame, vetoes: DataFrame, deals: int) -> DataFrame:
    """(handle, label) of small components, many at once: no edge touches two of them, so a fold over
    several is the fold of each, and a component is no call of its own."""
    rows = same.select("cc", *PAIR, F.lit(True).alias("same")).unionByName(vetoes.select("cc", *PAIR, F.lit(False).alias("same")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(part["h_left"], part["h_right"], strict=True))
        labels = fold([p for p, s in zip(pairs, part["same"], strict=True) if s], [p for p, s in zip(pairs, part["same"], strict=True) if not s])
        return pd.DataFrame({"handle": list(labels), "label": list(labels.values())})

    return rows.groupBy(F.pmod(F.xxhash64("cc"), F.lit(deals)).alias("deal")).applyInPandas(run, LABEL)


def _contracted(same: DataFrame, vetoes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(handle, label) of large components and (first), the edges that joined them, in rounds of
    joins on staged tables.

    same(h_left, h_right, first): `first` is an edge's place in the order. vetoes(h_left, h_right,
    since): a veto holds from a place on, null for ever. An edge that is the first open one of both
    its ends meets exactly the components of its place; it is refused if a veto between them is
    older. Of parallel edges and vetoes the first ones count: what a veto keeps apart at its place,
    no later edge joins.
    """
    ends = same.select(*PAIR)
    labels = staged(ends.select(F.explode(F.array(*PAIR)).alias("handle")).distinct().withColumn("label", F.col("handle")), "labels")
    side = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges = staged(same.groupBy(*side("h_left", "h_right")).agg(F.min("first").alias("first")), "edges")
    earliest = F.when(F.count("since") == F.count("*"), F.min("since")).alias("since")  # null if any is
    against = staged(vetoes.groupBy(*side("h_left", "h_right")).agg(earliest), "against")
    joins = None
    while True:
        held = edges.join(against, ["a", "b"], "left").join(against.select("a", "b", F.lit(True).alias("any")), ["a", "b"], "left")
        refused = F.col("any").isNotNull() & (F.col("since").isNull() | (F.col("since") < F.col("first")))
        open_ = staged(held.where(~refused).select("a", "b", "first"), "edges")
        discard(edges)
        edges = open_
        if edges.isEmpty():
            return labels.select("handle", "label"), joins if joins is not None else edges.select("first")
        both = edges.select(F.explode(F.array("a", "b")).alias("c"), "first").groupBy("c").agg(F.min("first").alias("least"))
        ready = edges.join(both.toDF("a", "la"), "a").join(both.toDF("b", "lb"), "b").where("first = la and first = lb").select(F.col("b").alias("old"), F.col("a").alias("new"), "first")
        moves = staged(ready, "moves")  # a component is in one ready edge at most
        joins = moves.select("first") if joins is None else joins.unionByName(moves.select("first"))
        to = lambda df, c: df.join(moves.select(F.col("old").alias(c), F.col("new").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        relabel = lambda df: to(to(df, "a"), "b").where("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
        last = labels, edges, against
        labels = staged(to(labels, "label"), "labels")
        edges = staged(relabel(edges).groupBy("a", "b").agg(F.min("first").alias("first")), "edges")
        against = staged(relabel(against).groupBy("a", "b").agg(earliest), "against")
        discard(*last)


def _labels(decided: DataFrame, component_veto: bool, fold_edges: int) -> tuple[DataFrame, DataFrame]:
    """(handle, label) and (handle, component) of all handles with a SAME edge."""
    same = decided.where(F.col("vote") == SAME).select(*PAIR)
    cc = staged(connected_components(same, *PAIR).withColumnRenamed("component", "cc"), "cc")
    whole = cc.select(F.col("node").alias("handle"), F.col("cc").alias("label"))
    if component_veto:
        at = lambda df: df.join(cc.toDF("h_left", "cc"), "h_left")
        inside = at(decided.where(F.col("vote") == DIFFERENT).select(*PAIR)).join(cc.toDF("h_right", "other"), "h_right").where("cc = other").select("cc", *PAIR)
        inside = staged(inside, "inside")
        sizes = at(same).join(inside.select("cc").distinct(), "cc", "left_semi").groupBy("cc").agg(F.count("*").alias("n"))
        sizes = staged(sizes, "sizes")
        small, large = sizes.where(F.col("n") <= fold_edges).select("cc"), sizes.where(F.col("n") > fold_edges).select("cc")
        pick = lambda df, which: df.join(which, "cc", "left_semi")
        edges = at(same)
        n = sizes.where(F.col("n") <= fold_edges).agg(F.sum("n")).first()[0] or 0
        labels = _folded(pick(edges, small), pick(inside, small), n // DEAL_EDGES + 1)
        if not large.isEmpty():
            order = F.struct(F.col("h_left").alias("p"), F.col("h_right").alias("q"))
            never = F.lit(None).cast("struct<p:string,q:string>").alias("since")
            labels = labels.unionByName(_contracted(pick(edges, large).select(*PAIR, order.alias("first")), pick(inside, large).select(*PAIR, never))[0])
        clean = cc.join(sizes, "cc", "left_anti").select(F.col("node").alias("handle"), F.col("cc").alias("label"))
        whole = clean.unionByName(labels)
    return whole, cc.toDF("handle", "component")


def partition(handles: DataFrame, decided: DataFrame, component_veto: bool = True, fold_edges: int = FOLD_EDGES) -> DataFrame:
    """(handle, label): label is the smallest handle of its component. decided(h_left, h_right,
    vote). Handles no accepted edge touches are their own. Without the component veto, plain
    connected components of the SAME edges."""
    whole, _ = _labels(decided, component_veto, fold_edges)
    known = handles.select("handle").distinct()
    return known.join(whole, "handle", "full").select("handle", F.coalesce("label", "handle").alias("label"))


def partition_within(handles: DataFrame, decided: DataFrame, fold_edges: int = FOLD_EDGES) -> DataFrame:
    """(handle, label, component): the partition, and the component of the SAME graph that each handle
    is in, outside which nothing can change its label."""
    whole, cc = _labels(decided, True, fold_edges)
    both = handles.select("handle").distinct().join(whole, "handle", "full").join(cc, "handle", "left")
    return both.select("handle", F.coalesce("label", "handle").alias("label"), F.coalesce("component", "handle").alias("component"))


def materialize(store: Evidence, relation_veto: bool = True, component_veto: bool = True) -> DataFrame:
    """The partition of a store's handles."""
    return partition(store.handles, decisions(store, relation_veto), component_veto)


def component_ids(membership: DataFrame) -> DataFrame:
    """(label, component): places of components in the order of their smallest handle, from 0."""
    return ranked(membership.select("label").distinct(), "label", name="component")


def with_ends(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """edges with the labels l_label and r_label of their ends."""
    return edges.join(membership.toDF("h_left", "l_label"), "h_left").join(membership.toDF("h_right", "r_label"), "h_right")


def edge_status(decided: DataFrame, membership: DataFrame) -> DataFrame:
    """relation, status: accepted (also redundant), rejected, different or unknown."""
    inside = F.col("l_label") == F.col("r_label")
    status = F.when(F.col("vote") == SAME, F.when(inside, "accepted").otherwise("rejected")).otherwise(F.col("vote"))
    return with_ends(decided, membership).select(*PAIR, status.alias("status"), "l_label", "r_label")


def separators(decided: DataFrame, membership: DataFrame) -> DataFrame:
    """(a, b): component labels with a DIFFERENT edge between them, a < b."""
    crossing = with_ends(decided.where(F.col("vote") == DIFFERENT).select(*PAIR), membership).where("l_label <> r_label")
    return crossing.select(F.least("l_label", "r_label").alias("a"), F.greatest("l_label", "r_label").alias("b")).distinct()


def negative_violations(decided: DataFrame, membership: DataFrame) -> DataFrame:
    """DIFFERENT relations with both ends in one component."""
    return with_ends(decided.where(F.col("vote") == DIFFERENT).select(*PAIR), membership).where("l_label = r_label").select(*PAIR)


def quotient_edges(gaps: DataFrame, membership: DataFrame, separated: DataFrame) -> DataFrame:
    """UNKNOWN relations between components that no negative separates: (a, b, h_left, h_right,
    gap, ...), parallel edges kept. gaps has vote and gap."""
    crossing = with_ends(gaps.where(F.col("vote") == UNKNOWN), membership).where("l_label <> r_label")
    ends = crossing.withColumn("a", F.least("l_label", "r_label")).withColumn("b", F.greatest("l_label", "r_label"))
    return ends.drop("l_label", "r_label").join(separated, ["a", "b"], "left_anti")


def signature(membership: DataFrame) -> DataFrame:
    """label, n, low, high: an order-free fingerprint of each component's members, mergeable
    map-side; equal partitions have equal rows."""
    part = lambda at: F.sum(F.conv(F.substring(F.md5("handle"), at, 8), 16, 10).cast("bigint"))
    return membership.groupBy("label").agg(F.count("*").alias("n"), part(1).alias("low"), part(9).alias("high"))


def priority_preserving(handles: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The watershed that agrees with the negative-safe partition: all negatives at weight 2, all
    positives at weight 1. (handle, label), and relation, status as edge_status() has it: a positive
    inside a component, in the forest or not, is accepted."""
    weight = F.when(F.col("vote") == DIFFERENT, 2.0).otherwise(1.0).alias("weight")
    membership, status = mutex_watershed(handles, decided.where(F.col("vote") != UNKNOWN).select(*PAIR, "vote", weight))
    named = F.when(F.col("status").isin("forest", "redundant"), "accepted").when(F.col("status") == "rejected", "rejected").otherwise(DIFFERENT)
    unknown = decided.where(F.col("vote") == UNKNOWN).select(*PAIR, F.lit(UNKNOWN).alias("status"))
    return membership, status.select(*PAIR, named.alias("status")).unionByName(unknown)


def mutex_watershed(handles: DataFrame, edges: DataFrame, fold_edges: int = FOLD_EDGES) -> tuple[DataFrame, DataFrame]:
    """(handle, label) and (h_left, h_right, vote, status) of the weighted mutex watershed.

    edges(h_left, h_right, vote, weight >= 0). Order: weight descending, negatives first, then the
    pair. A negative between components becomes a mutex, one inside is ignored; a positive under a
    mutex is rejected, one inside is redundant, others join. Statuses: active, ignored, rejected,
    redundant, forest. Joins stay within components of the positive graph; a negative between those
    is active without any fold. A component of up to fold_edges edges is folded in one task, a larger
    one contracted in rounds, where a negative is a veto from its place on.
    """
    cc = staged(connected_components(edges.where(F.col("vote") == SAME), *PAIR).withColumnRenamed("component", "cc"), "cc")
    ended = edges.join(cc.toDF("h_left", "cc"), "h_left", "left").join(cc.toDF("h_right", "cc2"), "h_right", "left")
    inner = F.coalesce(F.col("cc") == F.col("cc2"), F.lit(False))
    within = staged(ended.where(inner).select("cc", *PAIR, "vote", "weight"), "within")
    large = staged(within.groupBy("cc").agg(F.count("*").alias("n")).where(F.col("n") > fold_edges).select("cc"), "large")
    outside = ended.where(~inner).select(*PAIR, "vote", F.lit("active").alias("status"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(sign=(part["vote"] == SAME).astype(int)).sort_values(["weight", "sign", "h_left", "h_right"], ascending=[False, True, True, True])
        label: dict[str, str] = {}
        members: dict[str, list[str]] = {}
        mutex: dict[str, set[str]] = {}
        out = []
        for h in {*part["h_left"], *part["h_right"]}:
            label[h], members[h], mutex[h] = h, [h], set()
        for a, b, same in zip(part["h_left"], part["h_right"], part["sign"], strict=True):
            x, y = sorted((label[a], label[b]))
            if not same:
                if x != y:
                    mutex[x].add(y)
                    mutex[y].add(x)
                out.append("active" if x != y else "ignored")
            elif x == y:
                out.append("redundant")
            elif y in mutex[x]:
                out.append("rejected")
            else:
                out.append("forest")
                for h in members[y]:
                    label[h] = x
                members[x] += members.pop(y)
                for other in mutex.pop(y):
                    mutex[other].discard(y)
                    mutex[other].add(x)
                    mutex[x].add(other)
        rows = pd.DataFrame({"h_left": part["h_left"], "h_right": part["h_right"], "vote": part["vote"], "status": out, "handle": None, "label": None})
        named = pd.DataFrame({"h_left": None, "h_right": None, "vote": None, "status": None, "handle": list(label), "label": list(label.values())})
        return pd.concat([rows, named], ignore_index=True)

    schema = "h_left string, h_right string, vote string, status string, handle string, label string"
    done = staged(within.join(large, "cc", "left_anti").groupBy("cc").applyInPandas(run, schema), "watershed")
    labels = done.where("handle is not null").select("handle", "label")
    status = done.where("handle is null").select(*PAIR, "vote", "status").unionByName(outside)
    if not large.isEmpty():
        place = F.struct((-F.col("weight")).alias("w"), (F.col("vote") == SAME).cast("int").alias("s"), F.col("h_left").alias("p"), F.col("h_right").alias("q"))
        rest = within.join(large, "cc", "left_semi").withColumn("first", place)
        more, joins = _contracted(rest.where(F.col("vote") == SAME).select(*PAIR, "first"), rest.where(F.col("vote") == DIFFERENT).select(*PAIR, F.col("first").alias("since")))
        labels = labels.unionByName(more)
        # a negative inside a component was inside it at its own place: before, it would have kept its ends apart
        told = with_ends(rest, more).join(joins.withColumn("joined", F.lit(True)), "first", "left")
        one = F.col("l_label") == F.col("r_label")
        named = F.when(F.col("vote") == DIFFERENT, F.when(one, "ignored").otherwise("active")).when(F.col("joined"), "forest").when(one, "redundant").otherwise("rejected")
        status = status.unionByName(told.select(*PAIR, "vote", named.alias("status")))
    membership = handles.select("handle").distinct().join(labels, "handle", "left").select("handle", F.coalesce("label", "handle").alias("label"))
    return membership, status
