"""A trie of conversation prefixes by Patricia construction.

A turn is a 128-bit digest of role and text, a conversation the array of its digests: 24 bytes a
turn, a record like a text. Equal sequences are one. Distinct sequences are sorted by range; what each
shares with the one before it (lcp) is a branch point, and its end is an end or leaf point. Every
prefix longer than the lcp is new with its sequence, so each node of the trie belongs to one sequence.
Only points become nodes of the compressed tree; an edge is the run of new prefixes down to a point.

Subtree sums of the compressed tree take rounds of doubling: after k rounds a point holds the sums
of all points less than 2 ** k edges below it. Rounds grow with the logarithm of the tree's height.
Unary nodes then follow from their edge: its lower point's sums, and the edge's bytes below them.

Sums by ancestor combine in the map tasks and hot ancestors are joined by a counted split, so a first
turn or a whole sequence that a third of all conversations share costs no more than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import map_arrow
from quorumlake.operators.joins import counted_join
from quorumlake.session import discard, staged

#: Bytes of a digest. The root's key has none.
WIDTH = 16


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, digests, sizes): each conversation's turns in order, by their digests and the UTF-8
    bytes of their texts.

    Null turns come first; equal ones are ordered by role, then by digest. Null roles and texts are
    empty. Rows of null conv_id belong to no conversation. An empty table gives none.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)  # the length keeps role and text apart
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, WIDTH)
    turn = F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("size"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), turn.alias("t"))
    found = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return found.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.size").alias("sizes"))


def _keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each sequence's key: the digest of its digests."""
    keys = [_chain(digests)[-1] for digests in batch.column(1).to_pylist()]
    return pa.record_batch([pa.array(keys, pa.binary()), *batch.columns], ["key", "conv_id", "digests", "sizes"])


def _chain(digests: list[bytes]) -> list[bytes]:
    """Keys of all prefixes, the empty one first."""
    out = [b""]
    for digest in digests:
        out.append(hashlib.blake2b(out[-1] + digest, digest_size=WIDTH).digest())
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha): SHA-256 of each key's ids, which come in order. A key's ids stream through one
    task, eight bytes each: the hash has to see them one after another."""
    last, sha = None, None
    for batch in batches:
        keys, shas = [], []
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != last:
                if sha is not None:
                    keys.append(last)
                    shas.append(sha.hexdigest())
                last, sha = key, hashlib.sha256(str(conv).encode())
            else:
                sha.update(b",%d" % conv)
        if keys:
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(shas)], ["key", "sha"])
    if sha is not None:
        yield pa.record_batch([pa.array([last], pa.binary()), pa.array([sha.hexdigest()])], ["key", "sha"])


def _new(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of each sequence: the key of what it shares with the one before, and the keys of the prefixes
    that are new with it."""
    ups, lcps, chains = [], [], []
    for own, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        lcp, before = 0, before or []
        while lcp < min(len(own), len(before)) and own[lcp] == before[lcp]:
            lcp += 1
        chain = _chain(own)
        ups.append(chain[lcp])
        lcps.append(lcp)
        chains.append(chain[lcp + 1 :])
    columns = [batch.column(0), batch.column(3), batch.column(4), batch.column(5), pa.array(ups, pa.binary()), pa.array(lcps, pa.int32()), pa.array(chains, pa.list_(pa.binary()))]
    return pa.record_batch(columns, ["seq", "sizes", "n", "least", "start", "lcp", "chain"])


def _sorted(distinct: DataFrame) -> DataFrame:
    """distinct with `before`, the digests of the sequence before it in sorted order."""
    ranges = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(distinct.repartitionByRange(ranges, "digests").withColumn("range", F.spark_partition_id()), "sorted")
    lasts = dealt.groupBy("range").agg(F.max("digests").alias("last"))
    carried = lasts.select("range", F.lag("last").over(Window.orderBy("range")).alias("carried"))  # a row a range
    within = F.lag("digests").over(Window.partitionBy("range").orderBy("digests"))
    return dealt.withColumn("within", within).join(F.broadcast(carried), "range", "left").withColumn("before", F.coalesce("within", "carried"))


def compressed_edges(distinct: DataFrame) -> DataFrame:
    """A row for each prefix but the empty one: seq, depth, key; edge and up, the points below (itself,
    for a point) and above; top, the edge's least depth; bytes of the edge, and of what is left of it
    from here on; n and least of the conversations that end here."""
    args = _sorted(distinct).select("key", "digests", "before", "sizes", "n", "least")
    found = staged(map_arrow(args, _new, "seq binary, sizes array<bigint>, n bigint, least bigint, start binary, lcp int, chain array<binary>"), "new")
    each = found.select("seq", "start", "lcp", "n", "least", F.size("chain").alias("len"), F.slice("sizes", F.col("lcp") + 1, F.size("chain")).alias("sizes"), F.posexplode("chain").alias("i", "key"))
    end = F.col("i") == F.col("len") - 1
    nodes = each.select("seq", "start", (F.col("lcp") + F.col("i") + 1).cast("bigint").alias("depth"), "key", F.col("sizes")[F.col("i")].alias("size"), F.when(end, F.col("n")).alias("n"), F.when(end, F.col("least")).alias("least"))
    branches = found.where("lcp > 0").select(F.col("start").alias("key"), F.lit(True).alias("branch")).distinct()
    marked = nodes.join(branches, "key", "left").withColumn("point", F.when(F.col("branch") | F.col("n").isNotNull(), F.col("key")))
    down = Window.partitionBy("seq").orderBy("depth")
    marked = marked.withColumn("up", F.coalesce(F.last("point", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)), "start"))
    # prefixes of one sequence below the same point are one edge
    along = Window.partitionBy("seq", "up")
    left = F.sum("size").over(along.orderBy("depth").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = marked.withColumns({"edge": F.max("point").over(along), "top": F.min("depth").over(along), "bytes": F.sum("size").over(along), "left": left})
    out = staged(out.select("seq", "depth", "key", "edge", "up", "top", "bytes", "left", "n", "least"), "edges")
    discard(found)
    return out


def subtree(points: DataFrame, **sums: Column) -> DataFrame:
    """points(key, up, values) with the named aggregates over each one's subtree, itself included.

    A round adds what a point's ancestor 2 ** k edges above hasn't seen, then looks twice as far.
    """
    state, total = staged(points.select("key", F.col("up").alias("far"), *sums), "subtree"), points.count()
    while not (open_ := state.where("far is not null")).isEmpty():
        seen = open_.groupBy("far").agg(*[c.alias(f"more_{name}") for name, c in sums.items()], F.count(F.lit(1)).alias("n_far"))
        seen = staged(seen.withColumnRenamed("far", "key"), "seen")
        both = lambda name: F.array(name, f"more_{name}")
        folded = {name: F.array_min(both(name)) if name in MINIMA else F.col(name) + F.coalesce(f"more_{name}", F.lit(0)) for name in sums}
        added = state.join(seen, "key", "left").select("key", "far", *[c.alias(name) for name, c in folded.items()])
        further = state.select("key", F.col("far").alias("further")).join(seen.select("key", "n_far"), "key").withColumnRenamed("key", "far")
        moved = counted_join(added.where("far is not null"), further, "far", total, "n_far").drop("far").withColumnRenamed("further", "far")
        last, state = state, staged(added.where("far is null").unionByName(moved), "subtree")
        discard(last, seen)
    return points.drop(*sums).join(state.select("key", *sums), "key")


#: Aggregates of subtree() that are minima; the others are sums.
MINIMA = frozenset(["least"])


def prefix_trie(rows: DataFrame) -> DataFrame:
    """A row for each distinct prefix of rows(conv_id, digests, sizes), conv_id unique: conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    and key, by which equal prefixes of other runs can be found.

    Empty sequences end at the root. Equal ones are members of the same nodes; copies of a row need no
    other treatment. Without rows there is no root. Other columns are not read.
    """
    keyed = staged(map_arrow(rows.select("conv_id", "digests", "sizes"), _keys, "key binary, conv_id bigint, digests array<binary>, sizes array<bigint>"), "sequences")
    members = keyed.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = staged(members.mapInArrow(_ends, "key binary, sha string"), "ends")
    distinct = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("digests").alias("digests"), F.first("sizes").alias("sizes"))
    distinct = staged(distinct, "distinct")
    edges = compressed_edges(distinct.where(F.size("digests") > 0))

    none, no_key = F.lit(None), F.lit(b"")
    here = distinct.where(F.size("digests") == 0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("least").alias("least"))
    root = here.select(no_key.alias("key"), none.cast("binary").alias("up"), F.lit(0).cast("bigint").alias("bytes"), "n", "least")
    found = edges.where("key = edge").select("key", "up", "bytes", F.coalesce("n", F.lit(0)).alias("n"), "least")
    plain = staged(found.unionByName(root if not distinct.isEmpty() else root.limit(0)), "points")
    children = staged(plain.where("up is not null").groupBy("up").agg(F.count("*").alias("n_children")).withColumnRenamed("up", "key"), "children")
    points = plain.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    points = points.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"))
    counted = staged(subtree(points, n=F.sum("n"), least=F.min("least"), leaves=F.sum("leaves")), "counted")
    weighed = counted.withColumn("saved", (F.col("n") - 1) * F.col("bytes"))
    summed = staged(subtree(weighed, saved=F.sum("saved")), "summed")

    above = children.join(summed.select("key", F.col("least").alias("parent")), "key").withColumnRenamed("key", "up")
    below = counted_join(summed.where("up is not null"), above.select("up", "parent", F.col("n_children").alias("n_up")), "up", summed.count(), "n_up")
    below = below.select(F.col("key").alias("edge"), "parent", "least", F.col("n").alias("n_convs"), "n_children", "leaves", "saved")
    whole = edges.select("depth", "key", "edge", "top", "bytes", "left").join(below, "edge")
    point, first = F.col("key") == F.col("edge"), F.col("depth") == F.col("top")
    nodes = whole.select(
        "key", F.col("least").alias("conv_id"), "depth", F.when(first, F.col("parent")).otherwise(F.col("least")).alias("parent_conv_id"), "n_convs",
        F.when(point, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") - (F.col("n_convs") - 1) * (F.col("bytes") - F.col("left"))).alias("saved_tokens"),
    )
    zero = F.lit(0).cast("bigint")
    top = summed.where("up is null").select("key", F.col("least").alias("conv_id"), zero.alias("depth"), none.cast("bigint").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    every = nodes.unionByName(top)
    out = every.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key")
