"""Semantics of the evidence engine: hand-made vectors, exhaustive graphs and own brute force."""

import itertools
import json
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.functions import scalars
from quorumlake.operators import baselines, certificates, checker, decisions, evaluation, ingest, partition, replication, reports
from quorumlake.schema import CELL, PAIR, Evidence
from quorumlake.session import staged
from quorumlake.sources import generators, state
from quorumlake.streaming import ingest as stream

FIVE = ("v0", "v1", "v2", "v3", "v4")
MARK = {"s": "same", "d": "different", "u": "unknown"}


def vector(pair, epoch, votes, sources=FIVE):
    return [(*pair, epoch, s, MARK[v], "r") for s, v in zip(sources, votes, strict=False) if v != "-"]


def store_of(spark, rows, sources=FIVE, threshold=2, floors=None, handles=()):
    cells = spark.createDataFrame(rows, CELL)
    known = sorted({h for r in rows for h in r[:2]} | set(handles))
    f = spark.createDataFrame(floors, "h_left string, h_right string, epoch long") if floors is not None else None
    return Evidence(cells, spark.createDataFrame([(h,) for h in known], "handle string"), sources, threshold, f)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_the_greatest_sealed_epoch_speaks(spark):
    rows = vector("ab", 0, "ssuuu") + vector("ab", 1, "ssdu-")  # a newer open epoch hides nothing
    rows += vector("ac", 0, "ssuuu") + vector("ac", 2, "ssduu")  # a later veto
    rows += vector("ad", 3, "sss--") + vector("ae", 0, "suuuu")
    got = {r.h_right: (r.epoch, r.sealed, r.same_count, r.different_count, r.vote) for r in decisions.decisions(store_of(spark, rows)).collect()}
    assert got == {"b": (0, True, 2, 0, "same"), "c": (2, True, 2, 1, "different"), "d": (3, False, 3, 0, "unknown"), "e": (0, True, 1, 0, "unknown")}


def test_slots_and_gaps(spark):
    rows = vector("ab", 0, "suuuu") + vector("ac", 0, "sd-u-") + vector("ad", 0, "uuuu-")
    store = store_of(spark, rows, threshold=3)
    got = {r.h_right: (r.gap, r.gap_sources) for r in decisions.authorization_gap(decisions.source_slots(store, decisions.decisions(store)), 3).collect()}
    assert got == {"b": (2, ["v1", "v2"]), "c": (3, ["v2", "v4", "v1"]), "d": (3, ["v4", "v0", "v1"])}


def test_ingest_rules(spark):
    store = store_of(spark, vector("ab", 1, "ssuuu"), floors=[("a", "b", 1)])
    again = ingest.add(store, spark.createDataFrame(vector("ab", 1, "ss---") + vector("ab", 0, "uuuuu") + vector("cd", 0, "s----"), CELL))
    assert again.cells.count() == 6 and again.handles.count() == 4  # below the floor: handles known, cells dropped
    with pytest.raises(ValueError, match="equivocation"):
        ingest.add(store, spark.createDataFrame([("a", "b", 1, "v0", "same", "another reason")], CELL))
    for bad in (("b", "a", 0, "v0", "same", ""), ("a", "b", -1, "v0", "same", ""), ("a", "b", 0, "zz", "same", ""), ("a", "b", 0, "v0", "maybe", ""), ("", "b", 0, "v0", "same", "")):
        with pytest.raises(ValueError):
            ingest.add(store, spark.createDataFrame([bad], CELL))
    with pytest.raises(Exception, match="two handles"):
        ingest.canonical(spark.createDataFrame([("x", "x")], "a string, b string")).collect()
    for wrong in (((), 1), (("a", "a"), 1), (("a",), 2), (("a",), True)):
        with pytest.raises(ValueError):
            Evidence(store.cells, store.handles, *wrong)


def test_orders_of_arrival_end_alike(spark):
    cells = vector("ab", 0, "ssu", FIVE[:3]) + vector("ab", 1, "ssd", FIVE[:3])
    want = None
    for order in random.Random(1).sample(list(itertools.permutations(cells)), 4):
        store = store_of(spark, list(order[:1]), FIVE[:3])
        for c in (order[1:4], order[4:]):
            store = ingest.add(store, spark.createDataFrame(list(c), CELL))
        got = rows_of(decisions.decisions(store))
        want = want or got
        assert got == want and got[0][-1] == "different"


def greedy(edges, vetoes, handles):
    group = {h: frozenset([h]) for h in handles}
    for a, b in sorted(edges):
        x, y = group[a], group[b]
        if x != y and not any((p in x and q in y) or (p in y and q in x) for p, q in vetoes):
            for h in x | y:
                group[h] = x | y
    return {h: min(g) for h, g in group.items()}


@pytest.fixture(scope="module")
def ternary(spark):
    """All 729 graphs of four handles, side by side in one store with one source."""
    rows, graphs = [], []
    for n, votes in enumerate(itertools.product("sdu", repeat=6)):
        names = [f"g{n:03d}{h}" for h in "abcd"]
        pairs = list(itertools.combinations(names, 2))
        rows += [(*p, 0, "v0", MARK[v], "r") for p, v in zip(pairs, votes, strict=True)]
        graphs.append((names, dict(zip(pairs, votes, strict=True))))
    return store_of(spark, rows, ("v0",), 1), graphs


def test_all_ternary_graphs(spark, ternary):
    store, graphs = ternary
    decided = staged(decisions.decisions(store))
    want = {}
    for names, votes in graphs:
        want |= greedy([p for p, v in votes.items() if v == "s"], [p for p, v in votes.items() if v == "d"], names)
    folded = {r.handle: r.label for r in partition.partition(store.handles, decided).collect()}
    contracted = {r.handle: r.label for r in partition.partition(store.handles, decided, fold_edges=0).collect()}
    assert folded == want and contracted == want
    free = staged(partition.partition(store.handles, decided, component_veto=False))
    loose = {r.handle: r.label for r in free.collect()}
    assert sum(any(loose[h] != want[h] for h in names) for names, _ in graphs) == 259
    assert partition.negative_violations(decided, free).count() == 354
    queries = store.cells.select(F.col("h_left").alias("q_left"), F.col("h_right").alias("q_right"))
    made = staged(certificates.certificates(queries, store))
    assert {r.kind: r["count"] for r in made.groupBy("kind").count().collect()} == {"same": 1402, "different": 2329, "ambiguous": 643}
    membership = spark.createDataFrame(list(want.items()), "handle string, label string")
    assert checker.check(store, made).where("not ok").count() == 0
    assert checker.membership_violations(store, membership).count() == 0
    assert checker.membership_violations(store, free).count() == sum(loose[h] != want[h] for h in want)
    forged = made.withColumn("ambiguous", F.when(F.col("ambiguous").isNotNull(), F.col("ambiguous").withField("gap", F.col("ambiguous.gap") + 1)))
    forged = forged.withColumn("different", F.when(F.col("different").isNotNull(), F.col("different").withField("source", F.lit("v9"))))
    forged = forged.withColumn("same", F.when(F.col("same").isNotNull(), F.col("same").withField("path", F.reverse("same.path"))))
    assert checker.check(store, forged).where("ok").count() == 0


def test_a_sound_but_dearer_plan_is_refused(spark):
    rows = [(*p, 0, "v0", v, "r") for p, v in (((f"{a}", f"{b}"), "unknown") for a, b in (("a", "b"), ("b", "c"), ("a", "c")))]
    store = store_of(spark, rows, ("v0",), 1)
    made = staged(certificates.certificates(spark.createDataFrame([("a", "c")], "q_left string, q_right string"), store))
    assert made.first().ambiguous.component_path == ["a", "c"]
    plan = F.expr("named_struct('gap', 2, 'edge_count', 2, 'component_path', array('a', 'b', 'c'), 'pairs', array(named_struct('h_left', 'a', 'h_right', 'b'), named_struct('h_left', 'b', 'h_right', 'c')))")
    dearer = made.withColumn("ambiguous", plan.cast(made.schema["ambiguous"].dataType))
    assert [r.ok for r in checker.check(store, made.unionByName(dearer.withColumn("q_left", F.lit("a"))).limit(1)).collect()] == [True]
    assert [r.ok for r in checker.check(store, dearer).collect()] == [False]


def cheapest(start, goal, edges, split, direct):
    """(cost, n, pairs, path) by trying all simple paths."""
    best = direct
    stack = [((start,), 0, ())]
    while stack:
        path, cost, pairs = stack.pop()
        for a, b, gap, pair in edges:
            for x, y in ((a, b), (b, a)):
                if x != path[-1] or y in path or any(tuple(sorted((y, c))) in split for c in path):
                    continue
                new = (path + (y,), cost + gap, pairs + (pair,))
                if y == goal:
                    found = (new[1], len(new[2]), new[2], new[0])
                    best = min(best, found) if best else found
                else:
                    stack.append(new)
    return best


def test_plans_against_all_paths(spark):
    rng = random.Random(4)
    rows, graphs = [], []
    for n in range(60):
        names = [f"q{n:02d}{h}" for h in "abcdef"]
        for p in itertools.combinations(names, 2):
            kind = rng.choice("sduuu--")
            if kind != "-":
                votes = {"s": "ssuuu", "d": "ssduu", "u": "".join(rng.choice("suuu") for _ in range(4)) + rng.choice("u-")}[kind]
                rows += vector(p, 0, votes)
        graphs.append(names)
    store = store_of(spark, rows, handles=[h for g in graphs for h in g])
    views = certificates.Views(store)
    asked = staged(certificates.classify(spark.createDataFrame([(a, b) for g in graphs for a, b in itertools.combinations(g, 2)], "q_left string, q_right string"), views))
    label = {r.handle: r.label for r in views.membership.collect()}
    split = {(r.a, r.b) for r in views.separated.collect()}
    edges = [(label[r.h_left], label[r.h_right], r.gap, (r.h_left, r.h_right)) for r in views.gaps().collect()]
    edges = [e for e in edges if e[0] != e[1] and tuple(sorted(e[:2])) not in split]
    seen = {e[3] for e in edges}
    got = {(r.q_left, r.q_right): (r.gap, r.edge_count, tuple(map(tuple, r.pairs)), tuple(r.component_path)) for r in certificates.plans(asked.where("kind = 'ambiguous'"), views).collect()}
    want = {}
    for r in asked.where("kind = 'ambiguous'").collect():
        pair = (r.q_left, r.q_right)
        direct = None if pair in seen else (5, 1, (pair,), (r.l_label, r.r_label))
        own = [e for e in edges if e[3][0][:3] == r.q_left[:3]]
        want[pair] = cheapest(r.l_label, r.r_label, own, split, direct)
    assert len(want) > 50 and any(v[1] > 1 for v in want.values())
    assert got == want
    cells = certificates.plan_cells(certificates.plans(asked.where("kind = 'ambiguous'"), views), store)
    one = min(p for p, v in want.items() if v[1] > 1)
    new = cells.where((F.col("q_left") == one[0]) & (F.col("q_right") == one[1])).drop("q_left", "q_right").withColumn("reason", F.lit("plan"))
    after = {r.handle: r.label for r in partition.materialize(ingest.add(store, new)).collect()}
    assert after[one[0]] == after[one[1]]


def test_large_components_are_contracted_alike(spark):
    for family in ("sparse_cut", "dense_cut"):
        decided = staged(generators.stress(spark, family, 24).groupBy(*PAIR).agg(F.max("vote").alias("vote")))
        rows = decided.collect()
        names = {h for r in rows for h in (r.h_left, r.h_right)}
        want = greedy([r[:2] for r in rows if r.vote == "same"], [r[:2] for r in rows if r.vote == "different"], names)
        handles = spark.createDataFrame([(h,) for h in names], "handle string")
        assert {r.handle: r.label for r in partition.partition(handles, decided, fold_edges=0).collect()} == want
        assert {r.handle: r.label for r in partition.partition(handles, decided).collect()} == want


def test_the_checker_rebuilds_large_components_in_rounds(spark, ternary, monkeypatch):
    monkeypatch.setattr(checker, "MOST_RELATIONS", 0)
    store, graphs = ternary
    want = {}
    for names, votes in graphs:
        want |= greedy([p for p, v in votes.items() if v == "s"], [p for p, v in votes.items() if v == "d"], names)
    assert {r.handle: r.label for r in checker.rebuilt(store, staged(checker.recomputed(store))).collect()} == want
    decided = staged(generators.stress(spark, "dense_cut", 24).groupBy(*PAIR).agg(F.max("vote").alias("vote")))
    rows = decided.collect()
    names = {h for r in rows for h in (r.h_left, r.h_right)}
    handles = spark.createDataFrame([(h,) for h in names], "handle string")
    found = checker.rebuilt(Evidence(store.cells, handles, store.sources, store.threshold), decided)
    assert {r.handle: r.label for r in found.collect()} == greedy([r[:2] for r in rows if r.vote == "same"], [r[:2] for r in rows if r.vote == "different"], names)


def test_paths_from_both_ends(spark):
    """Against a search over all paths, with ties, hubs and long chains, many queries of one end."""
    rng = random.Random(6)
    edges = {tuple(sorted((f"k{i:02}", f"k{j:02}"))) for i in range(30) for j in rng.sample(range(30), 2) if i != j}
    edges |= {(f"m{i:02}", f"m{i + 1:02}") for i in range(17)} | {("hub", f"z{i}") for i in range(9)}
    rows = [(a, b, 0, "v0", "same", "") for a, b in sorted(edges)]
    names = sorted({h for e in edges for h in e})
    store = Evidence(spark.createDataFrame(rows, CELL), spark.createDataFrame([(n,) for n in names], "handle string"), ("v0",), 1)
    near = {n: sorted(b if a == n else a for a, b in edges if n in (a, b)) for n in names}

    def shortest(a, b):
        level = {a: (a,)}
        seen = {a}
        while level and b not in level:
            grown = {}
            for n, path in sorted(level.items()):
                for m in near[n]:
                    if m not in seen:
                        grown[m] = min(grown.get(m, (*path, m)), (*path, m))
            seen |= set(grown)
            level = grown
        return level.get(b)

    asked = [(a, b) for a in names for b in names if a < b and shortest(a, b)]
    asked = [*rng.sample(asked, 60), ("m00", "m17"), ("m03", "m04"), *[(a, b) for a, b in asked if a == "hub"]]
    asked += [(b, a) for a, b in asked[:20]]
    views = certificates.Views(store)
    found = certificates.same_paths(spark.createDataFrame(sorted(set(asked)), "q_left string, q_right string"), views)
    assert {(r.q_left, r.q_right): tuple(r.path) for r in found.collect()} == {q: shortest(*q) for q in asked}


def watershed(handles, edges):
    group, mutex, status = {h: frozenset([h]) for h in handles}, [], {}
    for a, b, vote, _ in sorted(edges, key=lambda e: (-e[3], e[2] == "same", e[:2])):
        x, y = group[a], group[b]
        if vote == "different":
            status[a, b, vote] = "ignored" if x == y else "active"
            mutex += [(a, b)] * (x != y)
        elif x == y:
            status[a, b, vote] = "redundant"
        elif any((p in x and q in y) or (p in y and q in x) for p, q in mutex):
            status[a, b, vote] = "rejected"
        else:
            status[a, b, vote] = "forest"
            for h in x | y:
                group[h] = x | y
    return {h: min(g) for h, g in group.items()}, status


def test_mutex_watershed(spark):
    rng = random.Random(5)
    edges, handles = [("a", "b", "same", 3.0), ("b", "c", "same", 2.0), ("a", "c", "different", 1.0)], set("abc")
    for n in range(40):
        names = [f"w{n:02d}{h}" for h in "abcdef"]
        handles |= set(names)
        edges += [(*p, rng.choice(["same", "different"]), float(rng.randrange(4))) for p in itertools.combinations(names, 2) if rng.random() < 0.7]
    want, status = watershed(handles, edges)
    for fold_edges in (10_000, 0):  # folded, and contracted in rounds
        m, s = partition.mutex_watershed(spark.createDataFrame([(h,) for h in handles], "handle string"), spark.createDataFrame(edges, "h_left string, h_right string, vote string, weight double"), fold_edges)
        assert {r.handle: r.label for r in m.collect()} == want
        assert {(r.h_left, r.h_right, r.vote): r.status for r in s.collect()} == status
    assert want["c"] == "a" and status["a", "c", "different"] == "ignored"


def test_replicas(spark):
    a = store_of(spark, vector("ab", 1, "ssuuu") + vector("ab", 3, "ssuuu"), floors=[("a", "b", 1)])
    b = store_of(spark, vector("ab", 1, "ssuuu") + vector("ab", 2, "ssuuu") + vector("ab", 4, "ssuuu") + vector("cd", 0, "s----"), floors=[("a", "b", 2)])
    ab, ba = replication.state_join(a, b), replication.state_join(b, a)
    assert rows_of(ab.cells.select(*PAIR, "epoch", "source")) == rows_of(ba.cells.select(*PAIR, "epoch", "source"))
    assert rows_of(ab.floors) == [("a", "b", 2)] and ab.cells.where("epoch < 2 and h_left = 'a'").count() == 0 and ab.handles.count() == 4
    assert rows_of(replication.state_join(ab, ab).cells) == rows_of(ab.cells)
    both = a.cells.withColumn("replica", F.lit(0)).unionByName(b.cells.withColumn("replica", F.lit(1)))
    assert rows_of(replication.common_floor(both, 2, 5)) == [("a", "b", 1)]  # not the least of the greatest
    assert rows_of(replication.inventory_delta(a.cells, b.cells).select("epoch").distinct()) == [(0,), (2,), (4,)]
    assert replication.fetch(b.cells, a.cells, b.floors).select("epoch").distinct().count() == 2
    with pytest.raises(ValueError, match="equal sources"):
        replication.state_join(a, Evidence(b.cells, b.handles, FIVE, 3))
    assert replication.divergence(both, 0, 1).count() == 16


def test_compaction(spark):
    rows = sum((vector("ab", e, "ssuuu") for e in range(5)), []) + vector("ab", 5, "s----") + vector("cd", 0, "ss---")
    store = store_of(spark, rows, floors=[("a", "b", 2)])
    rules = lambda floors, **k: [r.rule for r in replication.compaction_violations(store, spark.createDataFrame(floors, "h_left string, h_right string, epoch long"), **k).collect()]
    assert rules([("a", "b", 4)]) == [] and rules([("a", "b", 3)]) == []
    assert sorted(rules([("a", "b", 1)])) == ["regression", "too many pending epochs"]
    assert rules([("a", "b", 5)]) == ["epoch not sealed"] and rules([("c", "d", 0), ("a", "b", 4)]) == ["epoch not sealed"]
    assert sorted(rules([("x", "y", 0)])) == ["absent relation", "too many pending epochs"]
    assert sorted(rules([("c", "d", -1), ("a", "b", 2)])) == ["too many pending epochs"]
    small = replication.compact(store, spark.createDataFrame([("a", "b", 4)], "h_left string, h_right string, epoch long"))
    assert small.cells.count() == 8 and rows_of(decisions.decisions(small)) == rows_of(decisions.decisions(store))
    with pytest.raises(ValueError):
        replication.compact(store, spark.createDataFrame([("a", "b", 5)], "h_left string, h_right string, epoch long"))


def test_scalars(spark):
    urls = ["HTTP://Ex.com:80/a", "https://Ex.com:8443", "https://u:p@ex.com/", "ftp://x", "http://[2001:DB8::1]:0080/x", None, "http://", "https://a.b#f"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(scalars.authority_handle(F.col("u"))).collect()]
    assert got == ["http://ex.com", "https://ex.com:8443", None, None, "http://[2001:db8::1]", None, None, "https://a.b"]
    row = spark.range(1).select(scalars.fraction(F.lit(84), F.lit(120)), scalars.jaccard(F.array(F.lit("a")).cast("array<string>"), F.expr("cast(array() as array<string>)")), scalars.jaccard(F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<string>)")), scalars.parse_status(F.lit(" -1 ")), scalars.parse_status(F.lit("404")), scalars.parse_bool(F.lit(" Yes"))).first()
    assert tuple(row) == ("7/10", 0.0, 0.0, None, 404, True)
    low, high = scalars.wilson(F.lit(8), F.lit(10))
    assert tuple(round(x, 4) for x in spark.range(1).select(low, high).first()) == (0.4902, 0.9433)


def test_medians_of_hot_groups_and_ties(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": [float(x) for x in rng.integers(0, 5, 3000)], "one": [2.5], "two": [1.0, 4.0], "none": [None, None], None: [3.0, 1.0, None, 2.0], "far": [*map(float, rng.normal(size=501))]}
    rows = [(g, v, 2 * v if v is not None and i % 2 else None) for g, x in groups.items() for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    got = {r.g: r for r in evaluation.medians(frame, ["v", "w"], ["g"]).collect()}
    for g in groups:
        for c, at in (("v", 1), ("w", 2)):
            own = [r[at] for r in rows if r[0] == g and r[at] is not None]
            assert (got[g][f"{c}_median"] if g in got else None) == (float(np.median(own)) if own else None)
    spread = {r.g: r for r in reports.median_ranges(frame, ["g"], ["v"]).collect()}
    assert set(spread) == set(groups) and spread[None].v_median == 2.0 and spread["none"].v_median is None and spread["hot"].v_max == 4.0
    assert evaluation.medians(frame.limit(0), ["v"], ["g"]).count() == 0


def test_order_statistics_and_partitions(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 41)] + [("b", 1.0)], "g string, x double")
    assert rows_of(evaluation.order_statistic(rows, "x", ["g"], evaluation.scale_place)) == [("a", 38.0), ("b", 1.0)]
    assert rows_of(evaluation.order_statistic(rows, "x", ["g"], evaluation.rpc_place)) == [("a", 38.0), ("b", 1.0)]
    assert [generators.set_partitions(spark, n).count() for n in range(1, 6)] == [1, 2, 5, 15, 52]


def test_generators(spark):
    truth, cells = generators.workload(spark, 50, FIVE)
    assert truth.count() == 150 and rows_of(cells) == rows_of(generators.workload(spark, 50, FIVE)[1])
    assert ingest.equivocations(cells).isEmpty() and ingest.domain_violations(cells, FIVE).isEmpty()
    n = generators.services_within(80_000)
    assert generators.services_within(80_000) == n and 3000 < n < 4000
    store = Evidence(cells, truth.select("handle"), FIVE, 2)
    metrics = evaluation.partition_metrics(partition.materialize(store), truth).first()
    assert metrics.false_merges == 0
    names = evaluation.partition_metrics(baselines.name_only(truth), truth).first()
    assert names.false_merges > 0
    sent = generators.deliveries(cells, ["n0", "n1"], 3)
    got = sent.where("node = 'n1'").drop("node", "duplicate", "repair", "step").distinct()
    assert rows_of(got) == rows_of(cells) and sent.where("duplicate").count() > 0 and sent.where("repair").count() > 0


def test_state_documents(spark, tmp_path):
    doc = {"node_id": "n", "sources": ["v0", "v1"], "threshold": 1, "handles": ["a", "b"], "stable_floors": [{"left": "a", "right": "b", "epoch": 0}], "cells": [{"left": "a", "right": "b", "epoch": 0, "source": s, "vote": "same"} for s in ("v0", "v1")]}

    def read(change=None):
        value = json.loads(json.dumps(doc))
        if change:
            change(value)
        path = tmp_path / f"{random.random()}.json"
        path.write_text(json.dumps(value))
        return state.read_state(spark, str(path))

    store = read()
    assert decisions.decisions(store).first().vote == "same" and store.sources == ("v0", "v1")
    state.write_state(store, str(tmp_path / "tables"))
    assert rows_of(state.read_tables(spark, str(tmp_path / "tables")).cells) == rows_of(store.cells.select(*state.KEY, "vote", "reason"))
    for change in (
        lambda v: v["cells"][0].update(epoch=True), lambda v: v["cells"][0].update(epoch=0.5), lambda v: v.update(threshold="1"), lambda v: v.update(threshold=3),
        lambda v: v["cells"].append(v["cells"][0]), lambda v: v["handles"].append("a"), lambda v: v["handles"].remove("b"),
        lambda v: v["stable_floors"][0].update(epoch=1), lambda v: v["cells"][0].update(left="b", right="a"), lambda v: v["cells"][0].update(source="zz"),
    ):
        with pytest.raises(ValueError):
            read(change)


def test_navigation_rows(spark):
    rows = spark.createDataFrame([("http://a.com/x", "301", "https://a.com/x"), ("https://a.com", "302", "https://a.com/y"), ("https://b.com", "200", "")], "request_url string, status string, redirect_url string")
    handles, cells = state.navigation_evidence(rows, FIVE)
    assert rows_of(handles) == [("http://a.com",), ("https://a.com",), ("https://b.com",)] and cells.count() == 5


def test_streams_restart_and_refuse(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    rows = vector("ab", 0, "ssuuu") + vector("ab", 1, "ssduu")
    source = f"{base}/in"
    for part in (rows[:4], rows[2:7]):
        spark.createDataFrame(part, CELL).coalesce(1).write.mode("append").parquet(source)
    run = lambda: stream.run_available(stream.read_files(spark, source), f"{base}/out", f"{base}/log")
    assert run().count() == 7
    spark.createDataFrame(rows[5:] + rows[:3], CELL).coalesce(1).write.mode("append").parquet(source)
    cells = run()  # a new query goes on from the checkpoint
    assert rows_of(cells) == sorted(rows)
    assert decisions.decisions(Evidence(cells, ingest.handles_of(cells), FIVE, 2)).first().vote == "different"
    write, path = stream.validated_sink(f"{base}/table", FIVE), f"{base}/table"
    write(spark.createDataFrame(rows[:5], CELL), 0)
    write(spark.createDataFrame(rows[:5], CELL), 0)
    with pytest.raises(ValueError, match="equivocation"):
        write(spark.createDataFrame([("a", "b", 0, "v0", "different", "r"), *rows[5:6]], CELL), 1)
    assert spark.read.parquet(path).count() == 5
    write(spark.createDataFrame(rows[3:], CELL), 1)
    assert spark.read.parquet(path).count() == 10


def test_stateful_relations(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = tempfile.mkdtemp(prefix="spark-")
    cells = [r[:5] for r in vector("ab", 0, "ssuuu") + vector("ab", 2, "ssduu")]
    parts = [cells[:5], cells[5:], [("a", "b", 2, None, None)], [("a", "b", 1, "v0", "same")]]
    out = []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, "h_left string, h_right string, epoch long, source string, vote string").coalesce(1).write.parquet(f"{base}/in/{n}")
        rows = spark.readStream.schema("h_left string, h_right string, epoch long, source string, vote string").parquet(f"{base}/in/*")
        found = stream.stateful_decisions(rows, 5, 2)
        found.writeStream.foreachBatch(lambda b, _: out.append([tuple(r) for r in b.collect()])).outputMode("update").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    assert [r[0] for r in out if r] == [("a", "b", 0, True, "same"), ("a", "b", 2, True, "different"), ("a", "b", 2, True, "different"), ("a", "b", 2, True, "different")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_queries_match_their_oracles(spark):
    import duckdb

    from quorumlake.plans import catalog

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events pages".split():
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    for name in ("decisions", "materialize", "certificate_kind", "cert_same", "cert_different", "cert_ambiguous", "plan_execution", "certificate_check", "ablation_decisions", "ablation_factorial", "priority_preserving_status", "acknowledged_floors", "topology_placements", "equal_work", "state_join", "leave_one_out", "stream_decisions", "p95_rpc"):
        got, want = catalog.queries()[name](spark, sf), con.execute(catalog.oracle_sql()[name])
        names = sorted(got.columns)
        assert names == sorted(c[0] for c in want.description)
        rows = [tuple(r[c[0]] for c in sorted((x, x) for x in names)) for r in got.collect()]
        order = [[c[0] for c in want.description].index(n) for n in names]
        key = lambda r: tuple(map(str, r))
        assert sorted(rows, key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key), name


def test_floors_are_parsed_strictly(spark):
    from quorumlake.operators import reports

    raw = lambda *rows: spark.createDataFrame(list(rows), "left string, right string, epoch string")
    assert rows_of(reports.parse_floors(raw(("a", "b", "3"), ("a", "c", "0")))) == [("a", "b", 3), ("a", "c", 0)]
    for bad in ([("a", "b", "-1")], [("a", "b", "true")], [("b", "a", "1")], [("a", "b", "1"), ("a", "b", "2")], [(None, "b", "1")]):
        with pytest.raises(Exception):  # noqa: B017
            reports.parse_floors(raw(*bad)).collect()
    sized = reports.within(spark.createDataFrame([("x" * 5,), ("x" * 50,)], "t string"), 30).collect()
    assert [r.fits for r in sized] == [True, False] and sized[0].bytes == len('{"t":"xxxxx"}')
