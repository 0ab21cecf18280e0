"""Near-duplicate vectors through an inverted multi-index.

Vectors are scaled to length 1 and cut in halves; each half has a codebook of its own, and the
product of both is a grid of cells. A vector's cells are visited in ascending order of the sum of
its halves' squared distances to the codewords (multi-sequence traversal). How many cells are
visited follows from a target recall, measured on sampled vectors against all others and against
partners made at exactly the threshold; then cosines in double precision verify what the cells hold.

Equal vectors are one node with a count. Cells are cut in blocks, so a hot cell is many small tasks,
and a block pair returns counts and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import map_arrow
from quorumlake.operators.components import connected_components
from quorumlake.operators.joins import counted_join
from quorumlake.session import discard, staged

#: Rows that fit the codebooks, and vectors whose true neighbours set the number of cells visited.
FIT_ROWS, RECALL_ROWS = 20_000, 512

#: Partners at the threshold made for each sampled vector, in either kind of direction.
PARTNERS = 4

#: Rows of a block; a pair of blocks is one matrix product.
BLOCK = 1024


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles; v is null for those with nulls, non-finite parts or zero
    length, and for null ids."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.select("vec_id", v.alias("v")).withColumn("v", F.when(F.col("vec_id").isNotNull() & (F.size("v") > 0) & whole, F.col("v")))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # lengths of huge parts don't overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1))


def codebook(x: np.ndarray, size: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means codewords of a bounded sample."""
    rng = np.random.default_rng(seed)
    book = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, book).argmin(1)
        sums, n = np.zeros_like(book), np.bincount(near, minlength=len(book))
        np.add.at(sums, near, x)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def traversal(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The `visits` cells nearest to each row, nearest first.

    The cell of the i-th and j-th nearest codewords comes after (i + 1) (j + 1) - 1 others, so only
    sums with (i + 1) (j + 1) <= visits are looked at: about visits * log(visits) of them.
    """
    half, most = books[0].shape[1], [len(book) for book in books]
    order, cost = [], []
    for part, book in zip((x[:, :half], x[:, half:]), books, strict=True):
        d = _distances(part, book)
        o = np.argsort(d, axis=1, kind="stable")[:, :visits]
        order.append(o)
        cost.append(np.take_along_axis(d, o, 1))
    i = np.repeat(np.arange(min(visits, most[0])), [min(most[1], visits // (k + 1)) for k in range(min(visits, most[0]))])
    j = np.arange(len(i)) - np.searchsorted(i, i)
    sums = cost[0][:, i] + cost[1][:, j]
    cells = order[0][:, i] * most[1] + order[1][:, j]
    first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(cells, first, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _partners(sample: np.ndarray, threshold: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and for each one of cosine `threshold`: in random directions, and towards
    other sampled vectors, as data differ more in some directions than in others."""
    rng, x, ways = np.random.default_rng(seed), np.concatenate([sample] * PARTNERS), []
    for way in (rng.normal(size=x.shape), x[rng.permutation(len(x))]):
        way = way - (way * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(way, axis=1, keepdims=True)
        sound = length[:, 0] > 1e-6
        ways.append((x[sound], threshold * x[sound] + np.sqrt(1 - threshold**2) * way[sound] / length[sound]))
    return np.concatenate([a for a, _ in ways]), np.concatenate([b for _, b in ways])


def _worst_visits(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float) -> int:
    """Cells to visit so that of sampled vectors and partners at the threshold, the lowest cosine a
    link has, `recall` meet: one of both visits the other's cell."""
    x, y = _partners(sample, threshold)
    if not len(x):
        return 2
    places = np.sort(np.minimum(_places(x, y, books), _places(y, x, books)))
    return int(places[max(0, int(np.ceil(recall * len(places))) - 1)]) + 1


def _places(x: np.ndarray, y: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """At which place of its traversal each row of x meets the cell of the same row of y."""
    return _places_of(x, traversal(y, books, 1)[:, 0], books)


def _places_of(x: np.ndarray, own: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """At which place of its traversal each row of x meets a cell."""
    half = books[0].shape[1]
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 1024):
        some, cell = x[at : at + 1024], own[at : at + 1024]
        first, second = _distances(some[:, :half], books[0]), _distances(some[:, half:], books[1])
        row = np.arange(len(some))
        cost = first[row, cell // len(books[1])] + second[row, cell % len(books[1])] + 1e-12
        second.sort(axis=1)
        out[at : at + 1024] = [np.searchsorted(s, c - f, "right").sum() - 1 for f, s, c in zip(first, second, cost, strict=True)]
    return out


def _visits(nodes: DataFrame, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float) -> int:
    """Cells to visit so that `recall` of the sampled vectors' links are found, and as many of links
    at the threshold, however few there are in the table; at least 2.

    A bounded query set is held against all rows, in blocks; each task returns how many neighbours
    lie at each place of the traversal. Places are worked out there, for cells with neighbours.
    """
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").limit(RECALL_ROWS).select("v").collect()])
    least = max(2, _worst_visits(sample, books, threshold, recall))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(0))
        own, cosine = traversal(x, books, 1)[:, 0], sample @ x.T
        q, row = np.nonzero((cosine >= threshold) & (cosine < 1 - 1e-12))
        pairs, n = np.unique(np.stack([q, own[row]], 1), axis=0, return_counts=True)
        at, of = np.unique(_places_of(sample[pairs[:, 0]], pairs[:, 1], books), return_inverse=True)
        return pa.record_batch([pa.array(at, pa.int64()), pa.array(np.bincount(of, n, len(at)).astype(np.int64), pa.int64())], ["place", "n"])

    found = map_arrow(nodes.select("v"), run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    totals = staged(found, "places")
    total = totals.agg(F.sum("n")).first()[0] or 0
    seen = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # a row a place, not a vector
    enough = totals.withColumn("seen", F.sum("n").over(seen)).where(F.col("seen") >= recall * total).agg(F.min("place")).first()[0]
    return least if enough is None else max(least, enough + 1)


def _forest(rows: np.ndarray, columns: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) that connect what all links of a block pair connect."""
    label = np.arange(n + m)
    a, b = rows, columns + n
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    touched = np.unique(np.concatenate([a, b]))
    touched = touched[label[touched] != touched]
    return touched, label[touched]


def _links(nodes: DataFrame, dim: int, threshold: float, recall: float, codewords: int | None) -> DataFrame:
    """(vec_id, other, n) for nodes of one length: counts of links (other = vec_id), and pairs of a
    spanning forest (n = 0)."""
    count = nodes.count()
    size = codewords or max(2, int(np.sqrt(count / 32)))
    fit = np.array([r[0] for r in nodes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").collect()])
    half = max(1, dim // 2)
    books = (codebook(fit[:, :half], size), codebook(fit[:, half:], size)) if dim > 1 else (codebook(fit, size), np.zeros((1, 0)))
    visits = min(_visits(nodes, books, threshold, recall), len(books[0]) * len(books[1]))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = traversal(_matrix(batch.column(0)), books, visits)
        return pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(list(cells), pa.list_(pa.int64()))], ["v", "vec_id", "copies", "cells"])

    placed = staged(map_arrow(nodes, place, "v array<double>, vec_id bigint, copies bigint, cells array<bigint>"), "placed")
    base = placed.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("n_base"))
    asks = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n_ask"))
    sizes = staged(base.join(asks, "cell").select("cell", F.ceil(F.col("n_base") / BLOCK).alias("base_blocks"), F.ceil(F.col("n_ask") / BLOCK).alias("ask_blocks")), "cells")
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    columns = ["cell", "b", "a", "vec_id", "copies", "v", "cells"]
    held = placed.withColumn("cell", F.col("cells")[0]).join(sizes, "cell").withColumn("b", block("base_blocks")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ask_blocks") - 1)))
    asked = placed.withColumn("cell", F.explode("cells")).join(sizes, "cell").withColumn("a", block("ask_blocks")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("base_blocks") - 1)))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"vec_id": [], "other": [], "n": []}).astype("int64")
        if left.empty or right.empty:
            return none
        right.columns = left.columns
        x, y = np.stack(left["v"].to_list()), np.stack(right["v"].to_list())
        xid, yid = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        r, c = np.nonzero(x @ y.T >= threshold)
        other = xid[r] != yid[c]
        r, c = r[other], c[other]
        if not len(r):
            return none
        # a link counts for its asker here, and for the held one if that doesn't ask in the asker's cell
        own = np.array([cells[0] for cells in left["cells"]])
        asks_back = (np.stack(right["cells"].to_list())[c] == own[r, None]).any(1)
        n = np.bincount(r, right["copies"].to_numpy()[c], len(x)), np.bincount(c, np.where(asks_back, 0, left["copies"].to_numpy()[r]), len(y))
        i, j = _forest(r, c, len(x), len(y))
        both = np.concatenate([xid, yid])
        out = pd.DataFrame({"vec_id": both, "other": both, "n": np.concatenate(n).astype("int64")})
        return pd.concat([out[out["n"] > 0], pd.DataFrame({"vec_id": both[i], "other": both[j], "n": 0})], ignore_index=True)

    # other names on one side: both come from one table
    key, other_key = ["cell", "b", "a"], ["cell_", "b_", "a_"]
    held = held.select(columns).toDF(*[f"{c}_" for c in columns])
    found = asked.select(columns).groupBy(key).cogroup(held.groupBy(other_key)).applyInPandas(compare, "vec_id bigint, other bigint, n bigint")
    out = staged(found, "links")
    discard(placed, sizes)
    return out


def near_duplicates(rows: DataFrame, threshold: float = 0.95, recall: float = 0.999, codewords: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows(vec_id, embedding).

    Null, zero and non-finite vectors link with nothing: n_links 0, their own component, kept.
    Vectors link with others of their length; each length has an index of its own. Equal vectors are
    linked to each other. Repeated rows, and unlike vectors under one id, each have a row and count
    as vectors of their own; an id's component is that of all its vectors. Null ids are no vector's
    link. Other columns are not read. An empty table gives no rows.
    """
    every = vectors(rows)
    sound = staged(every.where("v is not null"), "vectors")
    lost = every.where("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    groups = sound.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # vectors, not ids, are the nodes: their numbers name them until the end
    named = staged(groups.withColumn("node", F.monotonically_increasing_id()), "groups")

    def unit(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _unit(_matrix(batch.column(0)))
        return pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["v", "vec_id", "copies"])

    links = None
    for dim in sorted(r["dim"] for r in named.groupBy(F.size("v").alias("dim")).count().collect()):
        own = named.where(F.size("v") == dim).select("v", F.col("node").alias("vec_id"), "copies")
        nodes = staged(map_arrow(own, unit, "v array<double>, vec_id bigint, copies bigint"), "nodes")
        found = _links(nodes, dim, threshold, recall, codewords)
        links = found if links is None else links.unionByName(found)
        discard(nodes)
    if links is None:
        return lost
    # an id with several vectors ties them together
    again = sound.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    tied = sound.join(again, "vec_id").join(named.select("v", "node"), "v").withColumn("first", F.min("node").over(Window.partitionBy("vec_id"))).select("node", "first")
    edges = links.where("vec_id <> other").select("vec_id", "other").unionByName(tied.toDF("vec_id", "other"))
    joined = connected_components(edges, "vec_id", "other")
    counts = links.where("n > 0").groupBy("vec_id").agg(F.sum("n").alias("linked"))
    full = (
        named.select("node", "least", "copies")
        .join(counts.withColumnRenamed("vec_id", "node"), "node", "left")
        .join(joined, "node", "left")
        .withColumn("root", F.coalesce("component", "node"))
    )
    full = staged(full.select("node", "least", "copies", "root", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links")), "full")
    roots = full.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    done = counted_join(full.select("node", "root", "n_links"), roots, "root", named.count()).select("node", "n_links", "component_id")
    held = named.select("v", "node", F.col("copies").alias("n")).join(done, "node").select("v", "n", "n_links", "component_id")
    out = counted_join(sound, held, "v", sound.count())
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(lost)
