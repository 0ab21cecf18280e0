"""Nearest neighbours by multi-index hashing of learned binary codes.

A code has BITS bits: the signs of a vector's principal components, rotated so that signs lose least
(iterative quantisation); rotations from several seeds follow one another where a vector has fewer
parts than that. Codes are cut in substrings, each with a table of its own. Two codes within a radius
agree, on one substring at least, up to the radius divided by the number of substrings (pigeonhole):
a query asks each table for all values so near to its own, which finds every code within the radius.
What is found is then ranked by distance of the original vectors.

The radius holds the neighbours of sampled queries, searched among all rows, up to a target recall;
a query that finds too few widens its radius, at last over all codes. The number of substrings is the one
of least estimated work. Codebook, radius and substrings come from bounded samples; all rows are indexed.

Equal vectors are one node with the ids that any answer can need. Table cells are cut in blocks, so a
hot cell is many tasks, and a block returns each query's nearest, never the pairs it looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import map_arrow
from quorumlake.llm.embeddings import vectors
from quorumlake.operators.joins import counted_join
from quorumlake.session import discard, staged

#: Bits of a code; rows that fit it; rounds of the rotation.
BITS, FIT_ROWS, ROUNDS = 64, 20_000, 30

#: Queries whose true neighbours set the radius.
RECALL_QUERIES = 256

#: Rows of a block on the side of the table and of the queries; pairs compared at once.
BLOCK, ASKED, PAIRS = 4096, 1024, 1 << 16

#: Work of a pair of codes, against that of moving a row.
PAIR_COST = 0.01


def _plain(x: np.ndarray, centre: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(x / scale - centre, -1e6, 1e6)


def fit_codes(sample: np.ndarray, seed: int = 3) -> Callable[[np.ndarray], np.ndarray]:
    """From rows of vectors to their codes as uint64, learned from a bounded sample."""
    scale = float(np.abs(sample).max())
    scaled = sample / scale
    centre = scaled.mean(0)
    z = _plain(sample, centre, scale)
    dim = z.shape[1]
    width = min(dim, BITS)
    _, axes = np.linalg.eigh(z.T @ z / len(z))
    axes = axes[:, ::-1][:, :width]
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < BITS:
        turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
        v = z @ axes
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        parts.append(axes @ turn)
    planes = np.concatenate(parts, 1)[:, :BITS]

    def encode(x: np.ndarray) -> np.ndarray:
        bits = (_plain(x, centre, scale) @ planes) > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]

    return encode


def substrings(parts: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, flips) of each substring: codes within the radius differ by at most `flips` bits
    on one of them. If the first radius % parts + 1 all differ by more than radius // parts and the
    others by radius // parts or more, the codes differ by more than the radius. flips may be -1: no
    look-up is needed there."""
    edges = [BITS * i // parts for i in range(parts + 1)]
    each, more = divmod(radius, parts)
    return [(a, b - a, each if i <= more else each - 1) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def _probes(tables: list[tuple[int, int, int]]) -> int:
    return sum(math.comb(width, k) for _, width, flips in tables for k in range(flips + 1))


def choose(radius: int, nodes: int, queries: int) -> list[tuple[int, int, int]]:
    """The substrings of least work a query: its look-ups, its share of rows moved to each table, and
    pairs of codes compared, as if codes were spread evenly."""

    def work(parts: int) -> float:
        tables = substrings(parts, radius)
        met = sum(sum(math.comb(w, k) for k in range(f + 1)) / 2**w for _, w, f in tables)
        return _probes(tables) + parts * nodes / max(1, queries) + PAIR_COST * nodes * met

    return substrings(min(range(2, BITS // 2 + 1), key=work), radius)


def masks(width: int, flips: int) -> np.ndarray:
    """All values of `width` bits with at most `flips` set, fewest first."""
    level, out = np.zeros(1, np.int64), [np.zeros(1, np.int64)]
    for _ in range(min(flips, width)):
        bits = np.int64(1) << np.arange(width)
        wide = level[:, None] | bits[None, :]
        level = np.unique(wide[bits[None, :] > level[:, None]])  # each set once, by its highest bit
        out.append(level)
    return np.concatenate(out) if flips >= 0 else np.zeros(0, np.int64)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x and y. A power of two is taken out of extreme differences
    first, so squares neither overflow nor vanish and others are not changed."""
    with np.errstate(over="ignore"):
        diff = x - y
    most = np.abs(diff).max(axis=1, initial=0.0)
    shift = np.where((most > 1e150) | ((most < 1e-140) & (most > 0)), np.frexp(most)[1], 0)
    if shift.any():
        half = shift // 2  # two steps: the power itself may be beyond the range
        diff = np.ldexp(np.ldexp(diff, -half[:, None]), -(shift - half)[:, None])
    with np.errstate(over="ignore"):
        return np.ldexp(np.sqrt(np.einsum("ij,ij->i", diff, diff)), shift)


def _nearest(of: np.ndarray, d: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest (d, least) for each number in `of`."""
    order = np.lexsort((least, d, of))
    ranked = of[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]


def _unpack(column: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _compare(asks: pd.DataFrame, rows: pd.DataFrame, tables: list[tuple[int, int, int]], radius: int, kind: str, k: int) -> pd.DataFrame:
    """(query, node, least, d) for a block of queries and a block of a cell's nodes: of the codes within
    the radius, those that no table before this one finds, the k nearest of each query."""
    out = pd.DataFrame({"query": [], "node": [], "least": [], "d": []}).astype({"query": "int64", "node": "int64", "least": "int64", "d": "float64"})
    if asks.empty or rows.empty:
        return out
    table = int(asks["t"].iloc[0])
    a, b = (f["code"].to_numpy(np.int64).view(np.uint64) for f in (asks, rows))
    x, y = (_unpack(f["v"].to_list(), kind) for f in (asks, rows))
    query, node, least = asks["query"].to_numpy(np.int64), rows["node"].to_numpy(np.int64), rows["least"].to_numpy(np.int64)
    step, found = max(1, PAIRS // len(rows)), [out]
    for at in range(0, len(asks), step):
        unlike = a[at : at + step, None] ^ b[None, :]
        i, j = np.nonzero(np.bitwise_count(unlike) <= radius)
        differ, new = unlike[i, j], np.ones(len(i), bool)
        for shift, width, flips in tables[:table]:
            part = differ >> np.uint64(shift) & np.uint64((1 << width) - 1)
            new &= np.bitwise_count(part) > flips if flips >= 0 else True
        i, j = i[new] + at, j[new]
        d = distances(x[i], y[j])
        best = _nearest(i, d, least[j], k)
        found.append(pd.DataFrame({"query": query[i[best]], "node": node[j[best]], "least": least[j[best]], "d": d[best]}))
    return pd.concat(found, ignore_index=True)


def _part(shift: int, width: int) -> Column:
    return F.shiftrightunsigned("code", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _search(nodes: DataFrame, asks: DataFrame, tables: list[tuple[int, int, int]], radius: int, kind: str, k: int) -> DataFrame:
    """(query, node, least, d): the k nearest nodes within the radius of each of asks(query, code, v)."""
    key = lambda: F.array(*[_part(s, w) for s, w, _ in tables])
    flips = F.array(*[F.split(F.lit(",".join(map(str, masks(w, f).tolist())) or None), ",").cast("array<bigint>") for _, w, f in tables])
    held = nodes.select("node", F.posexplode(key()).alias("t", "cell"))
    own = asks.select("query", F.posexplode(F.arrays_zip(key().alias("own"), flips.alias("flips"))).alias("t", "p"))
    cells = own.select("query", "t", F.col("p.own").alias("own"), F.explode("p.flips").alias("flip")).select("query", "t", F.col("own").bitwiseXOR(F.col("flip")).alias("cell"))
    cells = staged(cells, "cells")
    sizes = held.groupBy("t", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(cells.groupBy("t", "cell").agg(F.ceil(F.count("*") / ASKED).alias("asked")), ["t", "cell"])
    sizes = staged(sizes, "sizes")
    block = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    # vectors join their keys last, so that they move once for each block that reads them
    left = cells.join(sizes, ["t", "cell"]).withColumn("a", block("query", "asked")).withColumn("b", each("blocks")).join(asks, "query")
    right = held.join(sizes, ["t", "cell"]).withColumn("b", block("node", "blocks")).withColumn("a", each("asked")).join(nodes, "node")
    by = ["t", "cell", "a", "b"]
    left, right = left.select(*by, "query", "code", "v"), right.select(*[F.col(c).alias(f"{c}_") for c in by], "node", "least", "code", "v")
    pairs = left.groupBy(*by).cogroup(right.groupBy(*[f"{c}_" for c in by]))
    found = pairs.applyInPandas(lambda x, y: _compare(x, y, tables, radius, kind, k), "query bigint, node bigint, least bigint, d double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "least"))
    out = staged(found.withColumn("r", rank).where(F.col("r") <= k).drop("r"), "near")
    discard(cells, sizes)
    return out


def _radius(nodes: DataFrame, asks: DataFrame, encode: Callable, kind: str, k: int, recall: float) -> int:
    """The radius that holds `recall` of the sampled queries' k nearest vectors. A bounded query set is
    held against all rows, in batches; each task returns the k nearest it saw."""
    sample = asks.orderBy(F.xxhash64(F.lit(5), "query"), "query").limit(RECALL_QUERIES).select("query", "v").collect()
    ids, v = np.array([r["query"] for r in sample]), _unpack([r["v"] for r in sample], kind)
    codes = encode(v)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, x = batch.column(0).to_numpy(), _unpack(batch.column(1).to_pylist(), kind)
        own, out = encode(x), []
        for q in range(len(ids)):
            d = distances(np.broadcast_to(v[q], x.shape), x)
            best = np.flatnonzero(node != ids[q])
            best = best[np.argsort(d[best], kind="stable")[:k]]
            out.append((np.full(len(best), q), d[best], np.bitwise_count(own[best] ^ codes[q]).astype(np.int64)))
        q, d, bits = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.record_batch([pa.array(q, pa.int64()), pa.array(d, pa.float64()), pa.array(bits, pa.int64())], ["q", "d", "bits"])

    near = map_arrow(nodes.select("node", "v"), run, "q bigint, d double, bits bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "bits"))
    counts = near.withColumn("r", rank).where(F.col("r") <= k).groupBy("bits").agg(F.count("*").alias("n")).collect()  # a row a number of bits
    seen, total = 0, sum(r["n"] for r in counts)
    for r in sorted(counts, key=lambda r: r["bits"]):
        seen += r["n"]
        if seen >= recall * total:
            return r["bits"]
    return 0


def nearest(rows: DataFrame, is_query: Column, k: int = 10, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of rows(vec_id, embedding) found for each
    query, by Euclidean distance in double precision, nearest first, ties to the smaller vec_id.

    A query's own id is no candidate; with fewer than k others all are returned. Null, zero and
    non-finite vectors and null ids take no part. Vectors are compared with others of their length.
    Repeated rows each are a candidate; an id with several unlike vectors is a candidate with each, and
    asks with the first in order. Empty tables and tables without queries give none. Other columns are
    not read. `is_query` is a condition on vec_id.
    """
    kind = "<f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    sound = staged(vectors(rows).where("v is not null"), "vectors")
    once = sound.groupBy("v", "vec_id").agg(F.count("*").alias("n"))
    # an answer takes k rows at most beside the query's own id
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = once.withColumn("r", place).where(F.col("r") <= k + 1)
    groups = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", F.least("n", F.lit(k)).alias("n")))).alias("ids"))
    named = staged(groups.withColumn("node", F.monotonically_increasing_id()), "named")
    every_query = staged(sound.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "asking")
    out = None
    for dim in sorted(r["dim"] for r in named.groupBy(F.size("v").alias("dim")).count().collect()):
        own = named.where(F.size("v") == dim)
        fit = np.array([r[0] for r in own.orderBy(F.xxhash64("node"), "node").limit(FIT_ROWS).select("v").collect()])
        encode = fit_codes(fit)

        def pack(batch: pa.RecordBatch, encode: Callable = encode) -> pa.RecordBatch:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            packed = [r.tobytes() for r in np.ascontiguousarray(x.astype(kind))]
            return pa.record_batch([batch.column(0), batch.column(2), pa.array(encode(x).view(np.int64)), pa.array(packed, pa.binary())], ["node", "least", "code", "v"])

        nodes = staged(map_arrow(own.select("node", "v", F.col("ids")[0]["vec_id"].alias("least")), pack, "node bigint, least bigint, code bigint, v binary"), "nodes")
        asking = every_query.where(F.size("v") == dim)
        numbers = own.select("v", "node").join(asking.groupBy("v").agg(F.count("*").alias("n")), "v")
        asks = staged(counted_join(asking, numbers, "v", asking.count()).select("query_id", "node"), "queries")
        # queries of one vector are one question
        asked = staged(nodes.join(asks.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("query"), "code", "v"), "asks")
        n_asked = asked.count()
        if not n_asked:
            continue
        total, radius = nodes.count(), _radius(nodes, asked, encode, kind, k, recall)
        want, done, open_ = min(k + 1, total), None, asked
        while True:
            tables = choose(radius, total, n_asked) if radius < BITS else [(0, 0, 0)]
            found = _search(nodes, open_, tables, radius, kind, k + 1)
            enough = staged(found.groupBy("query").count().where(F.col("count") >= want).select("query"), "enough")
            complete = found.join(enough, "query", "left_semi")
            done = complete if done is None else done.unionByName(complete)
            open_ = staged(open_.join(enough, "query", "left_anti"), "open")
            n_asked = open_.count()
            if not n_asked:
                break
            radius = min(BITS, 2 * radius + 8)
        listed = done.join(own.select("node", "ids"), "node").select("query", "d", F.explode("ids").alias("id"))
        # a question's list is bounded, and so is what each of its queries gets
        lists = listed.select("query", "d", "id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("id.n"))).alias("copy"))
        one = F.struct("d", F.col("id.vec_id").alias("vec_id"), "copy")
        lists = lists.groupBy(F.col("query").alias("node")).agg(F.sort_array(F.collect_list(one)).alias("list")).join(asks.groupBy("node").agg(F.count("*").alias("n")), "node")
        full = counted_join(asks, lists, "node", asks.count())
        best = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        part = full.select("query_id", F.posexplode(best).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", F.col("x.d").alias("score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        none = F.lit(None).cast("bigint")
        return sound.limit(0).select(none.alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    return out
