"""Streams with floors, the partition that follows them, digests, floor rounds and agreement."""

import json
import os
import random
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import agreement, digests, replication
from quorumlake.operators import partition as partitions
from quorumlake.operators.partition import partition
from quorumlake.plans import catalog
from quorumlake.schema import CELL, KEY
from quorumlake.sources import records
from quorumlake.streaming import ingest as stream
from quorumlake.streaming.live import LivePartition

ROW = "h_left string, h_right string, epoch long, source string, vote string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_streamed_floors_restart_and_fold(spark):
    """Cells and floors over several runs; the second and third run go on from the first's state."""
    rng, base, sources = random.Random(3), tempfile.mkdtemp(prefix="spark-"), [f"v{i}" for i in range(3)]
    cells = {(f"h{r}", f"h{r + 1}", e, s): rng.choice(["same", "same", "different", "unknown"]) for r in range(12) for e in range(4) for s in sources if rng.random() < 0.9}
    rows = [(*k, v) for k, v in cells.items()] * 2 + [(f"h{r}", f"h{r + 1}", rng.randrange(1, 4), None, None) for r in range(0, 12, 2)]
    rows += [("h3", "h4", 9, None, None), ("x", "y", 1, None, None)]  # floors above all cells, and without any
    rng.shuffle(rows)
    for n in range(3):
        spark.createDataFrame(rows[n::3], ROW).coalesce(1).write.parquet(f"{base}/in/{n}")
        got = stream.floor_decisions(spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*"), 3, 2, f"{base}/state")
        seen = [r for k in range(n + 1) for r in rows[k::3]]
        floor = {}
        for a, b, e, s, _ in seen:
            if s is None:
                floor[a, b] = max(e, floor.get((a, b), -1))
        want, votes = [], {}
        for a, b, e, s, v in seen:
            if s is not None and e >= floor.get((a, b), -1):
                votes.setdefault((a, b), {}).setdefault(e, {})[s] = v
        for pair, by in votes.items():
            sealed, e = max((len(v) == 3, e) for e, v in by.items())
            own = list(by[e].values())
            want.append((*pair, e, sealed, "unknown" if not sealed else "different" if "different" in own else "same" if own.count("same") >= 2 else "unknown"))
        assert rows_of(got) == sorted(want, key=str)
    with pytest.raises(Exception, match="equivocation"):
        spark.createDataFrame([("q", "r", 20, "v0", "same"), ("q", "r", 20, "v0", "different")], ROW).coalesce(1).write.parquet(f"{base}/in/9")
        stream.floor_decisions(spark.readStream.schema(ROW).parquet(f"{base}/in/*"), 3, 2, f"{base}/state")


def test_cells_without_floors_are_decided_without_python(spark):
    """Repeats, late epochs and restarts end in the decisions of all cells; a clash of votes is an error."""
    rng, base, sources = random.Random(5), tempfile.mkdtemp(prefix="spark-"), [f"v{i}" for i in range(3)]
    cells = {(f"h{r}", f"h{r + 1}", e, s): rng.choice(["same", "same", "different", "unknown"]) for r in range(20) for e in rng.sample(range(40), 6) for s in sources if rng.random() < 0.8}
    cells |= {("x", "y", e, f"v{i}"): "same" for e, n in ((1, 2), (2, 3), (3, 4), (4, 1)) for i in range(n)}  # four sources are as little all three as two are
    rows = [(*k, v) for k, v in cells.items()] * 2
    rng.shuffle(rows)
    out, said = {}, lambda batch, _: out.update({(r.h_left, r.h_right): tuple(r) for r in batch.collect()})

    def run(part):
        spark.createDataFrame(part, ROW).coalesce(1).write.parquet(f"{base}/in/{len(os.listdir(f'{base}/in')) if os.path.isdir(f'{base}/in') else 0}")
        found = stream.cell_decisions(spark.readStream.schema(ROW).parquet(f"{base}/in/*"), 3, 2)
        assert "Python" not in (plan := found._jdf.queryExecution().analyzed().toString()) and "Pandas" not in plan
        stream.run_updates(found, said, f"{base}/log")

    for n in range(3):
        run(rows[n::3])
        votes = {}
        for a, b, e, s, v in [r for k in range(n + 1) for r in rows[k::3]]:
            votes.setdefault((a, b), {}).setdefault(e, {})[s] = v
        want = {}
        for pair, by in votes.items():
            sealed, e = max((len(v) == 3, e) for e, v in by.items())
            own = list(by[e].values())
            want[pair] = (*pair, e, sealed, "unknown" if not sealed else "different" if "different" in own else "same" if own.count("same") >= 2 else "unknown")
        assert out == want
    assert out["x", "y"] == ("x", "y", 2, True, "same")
    with pytest.raises(Exception, match="equivocation"):
        run([("x", "y", 4, "v0", "different")])


def test_known_decisions_touch_nothing(spark):
    """Decisions that stand already, and unknown ones of new relations, open no component."""
    schema, folder = "h_left string, h_right string, vote string", tempfile.mkdtemp(prefix="spark-")
    kept = LivePartition(spark, folder, buckets=4, batches=1)
    rows = [("a", "b", "same"), ("b", "c", "same"), ("a", "c", "different"), ("d", "e", "unknown")]
    kept.follow(spark.createDataFrame(rows, schema), 0)
    kept.follow(spark.createDataFrame([*rows[1:], ("f", "g", None)], schema), 1)
    with pytest.raises(ValueError, match="order"):
        kept.follow(spark.createDataFrame([("b", "a", "unknown")], schema), 2)
    assert set(kept.read) == {0} and rows_of(kept.membership()) == [("a", "a"), ("b", "a"), ("c", "c")]
    kept.follow(spark.createDataFrame([rows[1], ("a", "c", None), ("c", "d", "same")], schema), 3)
    assert kept.read[3] == {"components": 2, "handles": 4, "edges": 3}
    kept.follow(spark.createDataFrame([("a", "b", "unknown"), ("c", "d", "same")], schema), 4)
    kept.follow(spark.createDataFrame([("a", "b", "unknown")], schema), 5)  # its votes are folded by now
    assert set(kept.read) == {0, 3, 4} and rows_of(kept.membership()) == [("a", "a"), ("b", "b"), ("c", "b"), ("d", "b")]
    before = tempfile.mkdtemp(prefix="spark-")  # a folder from before votes were kept
    for table in ("index", "members", "edges"):
        shutil.copytree(f"{folder}/{table}", f"{before}/{table}")
    kept = LivePartition(spark, before, buckets=4)
    kept.follow(spark.createDataFrame([("b", "c", "unknown"), ("c", "d", "same")], schema), 6)
    assert rows_of(kept.membership()) == [("a", "a"), ("b", "b"), ("c", "c"), ("d", "c")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_streamed_partition_is_the_whole_one_without_python_state(spark, monkeypatch):
    plans, run = [], stream.run_updates
    monkeypatch.setattr(stream, "run_updates", lambda updates, *rest: (plans.append(updates._jdf.queryExecution().analyzed().toString()), run(updates, *rest)))
    got, want = (catalog.queries()[name](spark, "/root/testdata/sf0.001") for name in ("stream_partition", "materialize"))
    assert rows_of(got.select("handle", "label")) == rows_of(want.select("handle", "label"))
    assert len(plans) == 1 and "Python" not in plans[0] and "Pandas" not in plans[0]


def test_small_components_are_folded_together(spark, monkeypatch):
    """Components of several deals, and of one, have the labels of a fold over all edges."""
    rng = random.Random(6)
    decided = {(f"c{k}x{a}", f"c{k}x{b}"): rng.choice(["same", "same", "different"]) for k in range(30) for a in range(7) for b in range(a + 1, 7) if rng.random() < 0.6}
    decided |= {(f"c{k}x0", f"c{k + 1}x0"): "different" for k in range(9)}
    frame = spark.createDataFrame([(*k, v) for k, v in decided.items()], "h_left string, h_right string, vote string")
    handles = spark.createDataFrame([(x,) for k in decided for x in k], "handle string")
    want = sorted(partitions.fold(*([k for k, v in decided.items() if v == vote] for vote in ("same", "different"))).items())
    for deal in (40, 20_000):
        monkeypatch.setattr(partitions, "DEAL_EDGES", deal)
        assert rows_of(partition(handles, frame)) == want
    same, different = (frame.where(f"vote = '{vote}' and left(h_left, 3) = left(h_right, 3)").withColumn("cc", F.expr("left(h_left, 3)")) for vote in ("same", "different"))
    plan = partitions._folded(same, different, 1)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandas [deal#" in plan  # a call for each component, before


def test_live_partition_equals_the_whole_one(spark):
    """Edges come, turn and go; after each batch all labels are those of a partition made anew."""
    rng, decided = random.Random(8), {}
    kept = LivePartition(spark, tempfile.mkdtemp(prefix="spark-"), buckets=8, batches=2)
    names = [f"n{i:02}" for i in range(40)]
    for number in range(6):
        kept.fold_edges = 0 if number == 4 else 1000  # the distributed way, once
        near = lambda: sorted((i := rng.randrange(36), i + rng.randrange(1, 4)))
        changes = {(names[a], names[b]): rng.choice(["same", "same", "different", "unknown", None]) for a, b in (near() for _ in range(30 if number == 0 else 5))}
        frame = spark.createDataFrame([(*k, v) for k, v in changes.items()], "h_left string, h_right string, vote string")
        kept.apply(frame, number)
        if number in (1, 3):
            kept.apply(frame, number)  # a batch that is run again
        decided.update(changes)
        every = spark.createDataFrame([(*k, v) for k, v in decided.items()], frame.schema)
        handles = spark.createDataFrame([(x,) for k in decided for x in k], "handle string")
        assert rows_of(kept.membership()) == rows_of(partition(handles, every))
    assert max(len(kept._numbers(t)) for t in ("index", "members", "edges")) <= 4
    again = LivePartition(spark, kept.folder, buckets=8)
    assert rows_of(again.membership()) == rows_of(kept.membership())


def test_live_partition_reads_touched_components_only(spark):
    kept = LivePartition(spark, tempfile.mkdtemp(prefix="spark-"), buckets=4)
    chain = [(f"c{k}x{i}", f"c{k}x{i + 1}", "same") for k in range(9) for i in range(9)]
    schema = "h_left string, h_right string, vote string"
    kept.apply(spark.createDataFrame(chain + [("c0x0", "c1x0", "different")], schema), 0)
    kept.apply(spark.createDataFrame([("c0x3", "c0x4", "unknown")], schema), 1)
    assert kept.read[1] == {"components": 1, "handles": 10, "edges": 9}  # eight left, one to the next component
    kept.apply(spark.createDataFrame([("c0x9", "c1x9", "same")], schema), 2)
    labels = dict(rows_of(kept.membership()))
    assert len(set(labels.values())) == 9 and labels["c1x0"] == labels["c0x4"] and labels["c0x0"] == "c0x0"
    kept.apply(spark.createDataFrame([("c0x3", "c0x4", "same")], schema), 3)  # the old negative now lies within
    assert dict(rows_of(kept.membership()))["c1x0"] != "c0x0" and kept.read[3]["handles"] == 20
    kept.apply(spark.createDataFrame([], schema), 4)
    with pytest.raises(ValueError, match="order"):
        kept.apply(spark.createDataFrame([("b", "a", "same")], schema), 5)


def cell(a, b, e, s, v="same", r="why"):
    return a, b, e, s, v, r


def test_digests_find_every_unlike_cell(spark):
    rng = random.Random(4)
    cells = [cell(f"a{i}", f"b{i}", i % 3, f"v{i % 5}", r=rng.choice(["x", "", None])) for i in range(800)]
    own, other = cells[5:], [c for i, c in enumerate(cells) if i % 97]
    frames = [spark.createDataFrame(x, CELL) for x in (own, other, other[::-1])]
    same = digests.descend(*(digests.tree(f) for f in frames[1:]))
    assert rows_of(same) == [(0, "", len(other), len(other), False)]
    delta, seen = digests.digest_delta(digests.ranged(frames[0]), digests.ranged(frames[1]), spark)
    assert rows_of(delta.select(*KEY)) == sorted((c[:4] for c in set(other) - set(own)), key=str)
    leaves = seen.where("level = 3 and unlike").agg(F.sum("n_own"), F.sum("n_other")).first()
    assert 0 < leaves[0] < 40 and 0 < leaves[1] < 40  # of some 800 rows
    empty = digests.descend(digests.tree(frames[0].limit(0)), digests.tree(frames[0]))
    assert empty.where("not unlike").count() == 0 and digests.descend(digests.tree(frames[0].limit(0)), digests.tree(frames[1].limit(0))).count() == 0
    changed = [c if i else (*c[:4], "different", c[5]) for i, c in enumerate(own)]
    assert digests.descend(digests.tree(frames[0]), digests.tree(spark.createDataFrame(changed, CELL))).where("level = 3 and unlike").count() == 1


def test_versions_name_one_state(spark):
    none = spark.createDataFrame([], "h_left string, h_right string, epoch long")
    one = [cell("a", "b", 0, "v0"), cell("a", "b", 0, "v1", r=None), cell("a", "c", 1, "v0", r="")]
    of = lambda rows, floors=none: digests.version(spark.createDataFrame(rows, CELL), floors).first()[0]
    base = of(one)
    assert of(one[::-1]) == base
    others = [one[:2], [*one, cell("a", "d", 0, "v0")], [*one[:2], cell("a", "c", 1, "v0", r=None)], [*one[:2], cell("a", "c", 1, "v0", v="unknown", r="")], [cell("ab", "", 0, "v0")], [cell("a", "b", 0, "v0")]]
    floor = spark.createDataFrame([("a", "b", 0)], none.schema)
    assert len({base, of(one, floor), *(of(o) for o in others)}) == 8
    assert digests.version(spark.createDataFrame([], CELL), none).first()[0] == "0:0:0:0:0:0"


def test_floor_rounds_need_every_member_fresh(spark):
    vec = lambda rep, a, b, e, votes="sss", reason="why": [(rep, *cell(a, b, e, f"v{i}", "same" if v == "s" else "different", reason)) for i, v in enumerate(votes)]
    rows = [r for rep in (0, 1) for r in vec(rep, "a", "b", 0) + vec(rep, "a", "b", 1) + vec(rep, "c", "d", 0, reason=f"own {rep}") + vec(rep, "e", "f", 2)] + vec(0, "g", "h", 0) + vec(1, "g", "h", 0, "ss")
    schema = f"replica int, {CELL}"
    table = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([(0, "e", "f", 3), (1, "e", "f", 3)], "replica int, h_left string, h_right string, epoch long")
    floors = spark.createDataFrame([("a", "b", 1), ("c", "d", 0), ("e", "f", 2), ("g", "h", 0)], "h_left string, h_right string, epoch long")
    ask = lambda t: digests.acknowledge(replication.acknowledgements(t, floors, 3), digests.version(t, none, "replica"))
    refused, taken, left = digests.floor_round(table, none, ask(table), 2)
    assert rows_of(taken) == [("a", "b", 1)]
    assert rows_of(refused) == [(0, "e", "f", 2, "regression"), (1, "e", "f", 2, "regression"), (1, "g", "h", 0, "incomplete")]
    assert left.where("h_left = 'a'").count() == 6 and left.count() == len(rows) - 6
    later = table.unionByName(spark.createDataFrame(vec(1, "x", "y", 0), schema))
    refused, taken, left = digests.floor_round(later, none, ask(table), 2)
    assert taken.count() == 0 and {r.rule for r in refused.where("replica = 1").collect()} == {"stale"} and left.count() == later.count()
    assert rows_of(digests.floor_round(later, none, ask(later), 2)[1]) == [("a", "b", 1)]  # asked anew, it succeeds
    few = ask(table).where("replica = 0")
    assert digests.floor_round(table, none, few, 2)[1].count() == 0 and digests.floor_round(table, none, few.unionByName(few), 2)[1].count() == 0
    answers = spark.createDataFrame([(0, "yes"), (1, "no"), (7, "who")], "replica int, answer string").join(digests.version(table, none, "replica"), "replica", "left")
    assert rows_of(digests.accepted(answers, digests.version(later, none, "replica")).select("replica", "accepted")) == [(0, True), (1, False), (7, False)]


def test_tables_agree_or_not(spark):
    of = lambda *keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v long")
    got = agreement.disagreements({"a": of("x", "y", None), "b": of("x", "x", None), "c": of("x", "z", None, None)}, ["k"])
    assert rows_of(got) == [("y", "b"), ("y", "c"), ("z", "a"), ("z", "b")]
    rng = random.Random(2)
    value = lambda: rng.choice([rng.uniform(-3, 3), rng.randrange(-3, 4) * 0.5, float("nan"), None, float("inf"), -0.0])
    a, b = ([(rng.choice("pq"), value()) for _ in range(60)] for _ in range(2))
    frames = [spark.createDataFrame(x, "k string, v double") for x in (a, b)]
    sound = lambda x: x is not None and abs(x) < 9
    want = sorted((k, x, y) for k, x in a for j, y in b if k == j and sound(x) and sound(y) and abs(x - y) <= 0.5)
    assert sorted(map(tuple, agreement.within_tolerance(*frames, ["k"], "v", 0.5).collect())) == want
    with pytest.raises(ValueError, match="positive"):
        agreement.within_tolerance(*frames, ["k"], "v", 0.0)


def test_rollups_differ_beyond_a_tolerance(spark):
    schema, inf, nan = "k string, n int, x double, y double", float("inf"), float("nan")
    a = [("p", 1, 1.0, None), ("p", 2, 1e12, nan), (None, 1, 2.0, inf), ("q", 1, 0.0, 1.0), ("r", 1, 5.0, inf), ("s", None, 1.0, 1.0)]
    b = [("p", 1, 1.0 + 1e-10, None), ("p", 2, 1e12 + 100, nan), (None, 1, 2.1, inf), ("q", 1, 1e-8, None), ("r", 1, 5.0, -inf), ("t", None, 1.0, 1.0)]
    got = agreement.metric_differences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k", "n"], ["x", "y"])
    want = [(None, 1, "x", 2.0, 2.1, "unlike"), ("q", 1, "x", 0.0, 1e-8, "unlike"), ("q", 1, "y", 1.0, None, "one is null"), ("r", 1, "y", inf, -inf, "unlike")]
    want += [("s", None, m, 1.0, None, "only recomputed") for m in "xy"] + [("t", None, m, None, 1.0, "only stated") for m in "xy"]
    assert rows_of(got) == sorted(want, key=str)


def test_broken_records_are_set_aside_alone(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    good = [
        '{"kind":"registry","sources":["v0","v1"],"threshold":1}',
        '{"epoch":0,"kind":"cell","left":"a","reason":"","right":"b","source":"v0","vote":"same"}',
        '{"vote":"same","kind":"cell","left":"a","right":"b","source":"v1","epoch":0,"reason":"\\u00e9 \\n"}',
        '{"epoch":0,"kind":"floor","left":"a","right":"b"}',
        '{"handle":"lonely","kind":"handle"}',
    ]
    cell_line = lambda **x: json.dumps({"kind": "cell", "epoch": 1, "left": "a", "right": "c", "source": "v0", "vote": "same", "reason": "r"} | x)
    bad = {
        "": "not JSON", "{": "not JSON", '{"kind":"cell","kind":"cell"}': "not JSON", "[1]": "unknown kind", "7": "unknown kind", '{"kind":7}': "unknown kind", '{"kind":"vote"}': "unknown kind", "null": "unknown kind",
        cell_line(epoch="1"): "fields or types", cell_line(epoch=1.5): "fields or types", cell_line(epoch=True): "fields or types", cell_line(epoch=None): "fields or types", cell_line(more=1): "fields or types", '{"kind":"handle"}': "fields or types",
        cell_line(epoch=-1): "epoch must not be negative", cell_line(left="c"): "handles must be non-empty and in order", cell_line(left=""): "handles must be non-empty and in order", '{"handle":"","kind":"handle"}': "handles must be non-empty and in order",
        cell_line(vote="maybe"): "vote must be same, different or unknown", '{"kind":"registry","sources":["v0"],"threshold":2}': "threshold out of range",
        cell_line(source="v9"): "source must be registered", cell_line(right="d", vote="different"): "equivocation", cell_line(right="d"): "equivocation",
    }
    spark.createDataFrame([(x,) for x in [*good, *good, *bad]], "value string").repartition(3).write.text(f"{base}/in")
    found = records.read(spark, f"{base}/in")
    assert rows_of(found.quarantine) == sorted(bad.items(), key=str)
    store = found.evidence()
    assert rows_of(store.cells) == [("a", "b", 0, "v0", "same", ""), ("a", "b", 0, "v1", "same", "é \n")] and rows_of(store.floors) == [("a", "b", 0)]
    assert rows_of(store.handles) == [("lonely",)] and (store.sources, store.threshold) == (("v0", "v1"), 1)
    for compression in ("none", "gzip"):
        records.write(store, f"{base}/{compression}", compression)
        again = records.read(spark, f"{base}/{compression}")
        assert again.quarantine.count() == 0 and rows_of(again.evidence().cells) == rows_of(store.cells)
        written = [r.value for r in spark.read.text(f"{base}/{compression}").collect()]
        assert written == sorted(written, key=lambda x: [json.loads(x).get(c, "") for c in ("kind", "left", "right", "epoch", "source", "handle")]) and all(list(json.loads(x)) == sorted(json.loads(x)) for x in written)
    spark.createDataFrame([(x,) for x in good[1:]], "value string").write.text(f"{base}/none_known")
    lost = records.read(spark, f"{base}/none_known")
    assert lost.quarantine.count() == 2 and lost.cells.count() == 0
    with pytest.raises(ValueError, match="no registry"):
        lost.evidence()
