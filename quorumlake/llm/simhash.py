"""SimHash near-duplicates, found without loss by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half of the 64-bit hashes of a text's word shingles.
Each of the 64 bits carries a vector of radius + 1 bits; table v keeps the fingerprint bits whose
vector has odd inner product with v. Any `radius` differing bits leave a v that is orthogonal to
all their vectors, so every pair within the radius agrees on all that table v keeps: 2 ** (radius +
1) - 1 tables find every pair, whatever the data are.

Texts of equal fingerprint are one node, so copies cost a row each. A bucket of few fingerprints
compares its pairs. A larger one links around centres (see _around_centres): rows in proportion to
its fingerprints, the same components, no pair left out.

Groups of near copies (see groups) start from these classes and add what fingerprints don't reach.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import map_arrow, text_of
from quorumlake.operators.components import connected_components
from quorumlake.operators.joins import counted_join, marked, marks, perhaps
from quorumlake.session import discard, release, staged

#: Fingerprints of a bucket up to which its pairs are compared one by one.
BUCKET = 64

#: Texts of a near-copy bucket up to which its pairs are compared one by one; in larger ones, texts
#: that all others are compared with first, and shingles of a block (2 MB) whatever its texts' lengths.
SMALL, PIVOTS, BLOCK = 32, 4, 1 << 18

#: Bits of a text's bitmap at most, as it moves with each candidate pair: longer ones are folded, which
#: rules out less and nothing wrongly.
MAP_BITS = 1 << 13

#: Orders of shingles that are tried until buckets are small; marks of common shingles, by their low
#: bits: two shingles that share a mark only come later in the order.
ROUNDS, MARKS = 4, 1 << 22


def _shingles(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def _fingerprint(text: bytes, shingle: int) -> int:
    return _majority(_shingles(text, shingle))


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # bounded memory for very long texts
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long. Null and wordless texts have 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_fingerprint(x, shingle) for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), text_of().cast("binary").alias("text")), run, "doc_id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The bits that each table keeps. Vectors cycle over all that are not zero, so every table
    keeps about half of the bits."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _around_centres(members: DataFrame, radius: int) -> DataFrame:
    """Edges that connect the same nodes as all pairs within radius 3, in linear numbers.

    Every fingerprint stands at all points up to 1 bit away (near) and up to 2 bits away (far). At
    a point, near ones are within 2 bits of each other and within 3 of far ones, so the smallest
    near one is linked to all. Two fingerprints 3 bits apart meet at the point 1 bit from either.
    """
    if radius != 3:
        raise ValueError("buckets above the limit need radius 3")
    flips = [0, *(_signed(1 << i) for i in range(64))]
    twice = sorted({a ^ b for a in flips for b in flips})
    one = members.select("fp").distinct()
    near = one.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip"))
    far = one.select("fp", F.explode(F.array(*[F.lit(x) for x in twice])).alias("flip"))
    at = F.col("fp").bitwiseXOR(F.col("flip")).alias("point")
    centre = near.select(at, "fp").groupBy("point").agg(F.min("fp").alias("a"))
    return far.select(at, F.col("fp").alias("b")).join(centre, "point").select("a", "b").where("a <> b").distinct()


def links(nodes: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b) over distinct fp of nodes: pairs within radius bits, all of them in small buckets and
    a spanning subset in large ones."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    tables = nodes.select("fp", F.posexplode(masks).alias("t", "m")).select("fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("key"))
    shared = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(tables.join(shared, ["t", "key"]), "buckets")
    few = members.where(F.col("n") <= bucket).select("t", "key", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["t", "key"]).where("a < b").where(near).select("a", "b")
    many = members.where(F.col("n") > bucket)
    return pairs if many.isEmpty() else pairs.unionByName(_around_centres(many, radius))


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) for every row of docs.

    Null and empty texts share fingerprint 0 and are linked like any other. Repeated rows each have
    a row. Rows of null id are linked too; a component of null ids alone has a null component_id.
    An empty table gives no rows. Other columns are not read.
    """
    found = staged(fingerprints(docs, shingle), "fingerprints")
    nodes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    joined = connected_components(links(nodes, radius), "a", "b")
    named = staged(nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "least", F.col("n").alias("rows")), "named")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    full = counted_join(named, roots, "root", nodes.count()).select("fp", "component_id", "rows")
    return counted_join(found, full, "fp", found.count(), "rows").select("doc_id", "fp", "component_id")


def prefix_size(shingles: int, similarity: float) -> int:
    """How many of a set's first shingles, in an order common to all sets, hold one at least of any
    set that is similar enough: such a set shares `similarity` of the shingles or more, so they are
    not all among the others."""
    return shingles - math.ceil(similarity * shingles - 1e-9) + 1 if shingles else 0


def _bits(grams: np.ndarray) -> bytes:
    """A bitmap of a set's shingles by their low bits, 4 to 8 bits a shingle up to MAP_BITS."""
    size = min(MAP_BITS, max(8, 1 << int(4 * len(grams)).bit_length()))
    bits = np.zeros(size, bool)
    bits[grams & (size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(x: bytes, y: bytes, n: int, m: int) -> int:
    """How many shingles sets of n and m can share at most, by their bitmaps: each bit that one has
    alone stands for a shingle of its own. The larger bitmap is folded to the smaller one's size."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def _possible(batch: pa.RecordBatch, similarity: float) -> pa.RecordBatch:
    """The pairs whose bitmaps allow the similarity."""
    a, b, x, y, n, m = (c.to_pylist() for c in batch.columns)
    kept = [most_shared(x[i], y[i], n[i], m[i]) >= similarity / (1 + similarity) * (n[i] + m[i]) - 1e-6 for i in range(len(a))]
    return batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))


def _prefixes(batch: pa.RecordBatch, verified: int, similarity: float) -> pa.RecordBatch:
    digest, sizes, first, bits = [], [], [], []
    for text in batch.column(1).to_pylist():
        grams = np.unique(_shingles(text, verified).view(np.int64))
        digest.append(hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest())
        sizes.append(len(grams))
        first.append(grams[: prefix_size(len(grams), similarity)])
        bits.append(_bits(grams))
    columns = [batch.column(0), pa.array(digest, pa.binary()), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
    return pa.record_batch(columns, ["doc_id", "digest", "size", "prefix", "bits"])


def _shingle_sets(batch: pa.RecordBatch, verified: int) -> pa.RecordBatch:
    grams = [np.unique(_shingles(text, verified).view(np.int64)) for text in batch.column(1).to_pylist()]
    return pa.record_batch([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "grams"])


def _counts(keys: DataFrame) -> DataFrame:
    """(key, n, low, high): keys of several texts, and sums that are alike for the same texts."""
    texts = F.xxhash64("b")
    halves = F.sum(texts.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(texts, 32)).alias("high")
    return staged(keys.groupBy("key").agg(F.count("*").alias("n"), *halves).where("n > 1"), "counts")


def _members(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, b, size, n): the texts of each bucket; of buckets with the same texts, one. Most keys are
    those of no bucket, and don't move."""
    buckets = staged(counts.groupBy("n", "low", "high").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    words = marks(buckets.select("key"))
    members = staged(perhaps(keys, "key", words).join(buckets, "key"), "members")
    discard(buckets, words)
    return members


def _pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of small buckets whose sizes allow the similarity."""
    few = members.where(F.col("n") <= SMALL).select("key", "b", "size")
    sizes = F.least("size", "m") >= similarity * F.greatest("size", "m") - 1e-9
    return few.join(few.toDF("key", "a", "m"), "key").where("a < b").where(sizes).select("a", "b")


def _marks(keys: DataFrame) -> np.ndarray:
    """Which marks the keys have. Words of 64 marks are put together in tasks: 65,536 rows at most."""
    at = F.col("key").bitwiseAND(F.lit(MARKS - 1))
    one = F.expr("shiftleft(1L, cast(key & 63 as int))")
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    out = np.zeros(MARKS // 64, np.int64)
    out[[r["word"] for r in words]] = [r["bits"] for r in words]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _of_ids(rows: DataFrame, ids: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn's rows for rows(doc_id, text) of ids, and of a few others whose ids share a mark. Texts don't
    move: those whose ids have no mark are left where they are read."""
    mark = F.xxhash64("doc_id").alias("key")
    marked = _marks(ids.select(mark))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        own = batch.filter(pa.array(marked[batch.column(2).to_numpy() & (MARKS - 1)]))
        return fn(own.select([0, 1])) if own.num_rows else None

    return map_arrow(rows.select("doc_id", "text", mark), run, schema)


def _but_copies(rows: DataFrame, firsts: DataFrame, words: DataFrame) -> DataFrame:
    """The rows whose doc_id is a node of firsts. Only ids with a mark in words, made of all copies' ids,
    may be none, so only their rows move."""
    found = marked(rows, "doc_id", words)
    # no semi join: Spark would do it before the marks are met
    doubted = found.where("__marked").join(firsts.select("node").distinct(), F.col("doc_id") == F.col("node"))
    return found.where("not __marked").select(*rows.columns).unionByName(doubted.select(*rows.columns))


def _rarer(batch: pa.RecordBatch, verified: int, similarity: float, common: np.ndarray) -> pa.RecordBatch:
    """Prefixes in another order: shingles marked common come last."""
    sizes, first = [], []
    for text in batch.column(1).to_pylist():
        grams = np.unique(_shingles(text, verified).view(np.int64))
        late = common[grams & (MARKS - 1)]
        sizes.append(len(grams))
        first.append(np.concatenate([grams[~late], grams[late]])[: prefix_size(len(grams), similarity)])
    return pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "size", "prefix"])


def _rest(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, b, part, main, n, r): the texts of buckets of several components (part), with the one
    that most of a bucket's texts are in (main), and how many shingles the bucket's texts have (n),
    and those of them outside main (r)."""
    named = members.join(joined, members["b"] == joined["node"], "left").select("key", "b", F.coalesce("component", "b").alias("part"), "size")
    parts = named.groupBy("key", "part").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    tops = parts.groupBy("key").agg(F.max(F.struct("c", "part", "s")).alias("top"), F.sum("s").alias("n"))
    open_ = tops.where("n > top.s").select("key", F.col("top.part").alias("main"), "n", (F.col("n") - F.col("top.s")).alias("r"))
    return named.drop("size").join(open_, "key")


def _across(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between texts of different components that share a bucket, one at least for
    each text outside the bucket's main component and each component it has links to.

    A bucket is cut in blocks; a pair of blocks is one task's comparison of all its pairs.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    block = lambda n: F.pmod(F.xxhash64("b"), blocks(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1))
    whole = rest.join(sets, rest["b"] == sets["id"])
    columns = ["key", "p", "q", "b", "part", "grams"]
    held = whole.withColumn("q", block("n")).withColumn("p", each("r")).select(columns)
    asked = whole.where("part <> main").withColumn("p", block("r")).withColumn("q", each("n")).select(columns)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(left) and len(right):
            right.columns = left.columns
            sizes = right["grams"].map(len).to_numpy()
            grams, owner = np.concatenate(right["grams"].to_list()), np.repeat(np.arange(len(right)), sizes)
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            ids, parts = right["b"].to_numpy(), right["part"].to_numpy()
            for one, part, own in zip(left["b"], left["part"], left["grams"], strict=True):
                low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
                n = high - low
                at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
                shared = np.bincount(owner[at], minlength=len(right))
                found = np.nonzero((shared >= similarity * (sizes + len(own) - shared)) & (parts != part))[0]
                found = found[np.unique(parts[found], return_index=True)[1]]
                a += [one] * len(found)
                b += ids[found].tolist()
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    held = held.toDF(*[f"{c}_" for c in columns])
    return asked.groupBy("key", "p", "q").cogroup(held.groupBy("key_", "p_", "q_")).applyInPandas(compare, "a bigint, b bigint")


def groups(docs: DataFrame, similarity: float = 0.8, verified: int = 5) -> DataFrame:
    """(doc_id, group_id) for rows in a group of two or more: near copies by fingerprints and by shingles.

    Documents are linked if their fingerprints are, by near_duplicates with its covering tables. These
    don't reach all near copies, so documents of different classes are linked as well if their sets of
    `verified`-word shingles have Jaccard similarity of `similarity` or more. Candidates share one of their prefix's shingles, the first by hash, which
    all such pairs do (see prefix_size). Bitmaps then rule out the pairs that can't share enough (see
    most_shared), and the exact similarity decides on the rest. Small buckets compare all
    their pairs. The texts of larger ones get keys anew, with the large buckets' shingles last: any
    order finds all pairs. What is large after ROUNDS orders is compared with a few of the bucket's texts; then
    texts outside a bucket's main component are compared with all its texts of other components.
    Texts equal but for case and white space are one node. group_id is the group's smallest doc_id;
    null ids belong to no group.
    """
    spark = docs.sparkSession
    classes = staged(near_duplicates(docs.where("doc_id is not null")).where("doc_id <> component_id").select("doc_id", "component_id").distinct(), "classes")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), text_of().cast("binary").alias("text"))
    known = staged(map_arrow(rows, lambda b: _prefixes(b, verified, similarity), "doc_id bigint, digest binary, size int, prefix array<bigint>, bits binary"), "prefixes")
    firsts = staged(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "firsts")
    same = counted_join(known.select("doc_id", "digest"), firsts, "digest", known.count()).where("doc_id <> node")
    copies = staged(same.select("doc_id", "node"), "copies")
    words = marks(copies.select("doc_id"))
    nodes = _but_copies(known, firsts, words)
    keys = nodes.select(F.explode("prefix").alias("key"), F.col("doc_id").alias("b"), "size")
    sets_of = lambda ids: _of_ids(rows, ids, lambda b: _shingle_sets(b, verified), "doc_id bigint, grams array<bigint>").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).toDF("id", "grams")
    counts = _counts(keys)
    members, common = _members(keys, counts), np.zeros(MARKS, bool)
    candidates, spent = _pairs(members, similarity), [counts]
    for turn in range(ROUNDS):
        release(spark)
        large = members.where(F.col("n") > SMALL)
        hot = staged(large.select(F.col("b").alias("doc_id")).distinct(), "hot")
        if hot.isEmpty():
            large = None
            break
        if turn == ROUNDS - 1:
            break
        common |= _marks(counts.where(F.col("n") > SMALL))
        # a text beside hot ones adds candidates and hides none, so the few that share a mark may stay
        rarer = staged(_of_ids(rows, hot, lambda b, c=common.copy(): _rarer(b, verified, similarity, c), "doc_id bigint, size int, prefix array<bigint>"), "rarer")
        keys = _but_copies(rarer, firsts, words).select(F.explode("prefix").alias("key"), F.col("doc_id").alias("b"), "size")
        spent += [members, hot]
        counts = _counts(keys)
        members = _members(keys, counts)
        spent.append(counts)
        release(spark, rarer)
        candidates = candidates.unionByName(_pairs(members, similarity))
    if large is not None:
        some = F.array(*[F.min_by("b", F.xxhash64(F.lit(k), "b")) for k in range(PIVOTS)])
        centres = large.groupBy("key").agg(some.alias("some")).select("key", F.explode(F.array_distinct("some")).alias("c"))
        around = large.join(centres, "key").where("b <> c").select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b"))
        candidates = candidates.unionByName(around)
    of = lambda end: classes.select(F.col("doc_id").alias(end), F.col("component_id").alias(f"class_{end}"))
    named = candidates.distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    pairs = staged(named.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b"), "pairs")
    release(spark, *spent)
    some = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    maps = staged(nodes.join(some, "doc_id", "left_semi").select("doc_id", "bits", "size").dropDuplicates(["doc_id"]), "maps")
    wide = pairs.join(maps.toDF("a", "x", "n"), "a").join(maps.toDF("b", "y", "m"), "b").select("a", "b", "x", "y", "n", "m")
    close = staged(map_arrow(wide, lambda batch: _possible(batch, similarity), "a bigint, b bigint"), "close")
    release(spark, maps, pairs)
    ids = staged(close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = staged(sets_of(ids), "sets")
    left = close.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = left.where((shared >= similarity * (F.size("x") + F.size("y") - shared)) & (F.size("x") > 0)).select("a", "b")
    ends = lambda least: (F.col(least).alias("a"), F.col("doc_id").alias("b"))
    edges = staged(linked.unionByName(copies.select(*ends("node"))).unionByName(classes.select(*ends("component_id"))), "edges")
    release(spark, sets, ids, close, known, firsts, classes, copies, words)
    joined = staged(connected_components(edges, "a", "b"), "joined")
    if large is not None:
        rest = staged(_rest(large, joined), "rest")
        if not rest.isEmpty():
            ids = staged(rest.select(F.col("b").alias("doc_id")).distinct(), "ids")
            sets = staged(sets_of(ids), "sets")
            across = staged(_across(rest, sets, similarity), "across")
            joined = staged(connected_components(edges.unionByName(across), "a", "b"), "joined")
            discard(ids, sets, across)
        discard(rest)
    release(spark, members, edges)
    return joined.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the smallest doc_id of each group; of rows that share an id, one stays.
    Null ids stay. Columns as in docs."""
    gone = staged(groups(docs, **options).where("doc_id <> group_id").select("doc_id"), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return kept
    some = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
    return some.unionByName(kept.where("doc_id is null"))
