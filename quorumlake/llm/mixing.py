"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Targets: sources share `share` of all words by weight; a target stops at `most` times its source's
size and the excess goes to the others by weight. Each source's documents are dealt to shards by a
hash, so a hot source has many. A cell (source, shard) lays its documents in seeded order, as one
stream of words cut into equal blocks. Blocks are apportioned to all cells by highest quotients
target / (2 k + 1), exactly: quotas sum to the house, and no block left out has a higher quotient
than one taken. Quotas above a cell's blocks take whole passes; the rest of a quota is taken by a
seeded permutation of its blocks. A document's share follows from the blocks that it overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import WORD, text_of
from quorumlake.operators.ranks import ranked
from quorumlake.session import staged

SHARD_WORDS, SHARD_DOCS = 1 << 18, 512

#: Divisors tried in a pass, passes, and quotients that may be left for ranking.
PROBES, PASSES, TIES = 33, 24, 1000

#: A prime above any number of blocks in a cell, so multiplying by it permutes them.
STEP = 1_000_003


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, docs, target) for sizes(source, size). weights repeat over the sources
    in code point order, the null source last. One row per source: the windows below order the
    catalogue of sources, never documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = most * F.col("source_size")
    by_ratio = Window.orderBy(cap / F.col("w"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (share * F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("w").over(onward))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", F.min(F.when(cap >= F.col("level") * F.col("w"), F.struct("place", "level"))).over(everything)["level"])
    )
    return found.select("source", "source_size", "docs", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).alias("target"))


def apportion(cells: DataFrame, house: int, near: float) -> DataFrame:
    """cells(name, shard, want, blocks) with quota: `house` seats by the highest quotients
    want / (k + 1/2) for k = 0, 1, ..., at most 2 * blocks a cell; ties by hash, name and shard.

    A cell has min(floor(want / d + 1/2), 2 * blocks) quotients of d or more. Counts at PROBES
    divisors a pass narrow d, first around `near`, until few quotients lie between the last divisor
    with too many seats and the first with too few; these are ranked.
    """
    seats = lambda d: F.least(F.floor(F.col("want") / F.lit(d) + 0.5), 2 * F.col("blocks"))
    if house == 0:
        return cells.withColumn("quota", F.lit(0).cast("bigint"))
    top = cells.agg(F.max("want")).first()[0] or 0.0
    low, high = near / 2, near * 2
    many = few = None
    for _ in range(PASSES):
        steps = [low * (high / low) ** (k / (PROBES - 1)) for k in range(PROBES)]
        counts = cells.agg(*[F.coalesce(F.sum(seats(d)), F.lit(0)) for d in steps]).first()
        above = [i for i, n in enumerate(counts) if n >= house]
        if not above:
            few, high = (low, counts[0]), low
            low = low / 1e6
        elif len(above) == PROBES:
            many, low = (high, counts[-1]), high
            high = max(4 * top, 2 * high)
        else:
            i = above[-1]
            many, few = (steps[i], counts[i]), (steps[i + 1], counts[i + 1])
            low, high = many[0], few[0]
            if many[1] == house or many[1] - few[1] <= TIES:
                break
    if many is None or few is None:
        raise RuntimeError("no divisor brackets the house")
    if many[1] == house:
        return cells.withColumn("quota", seats(many[0]))
    between = cells.withColumn("k", F.explode(F.sequence(seats(few[0]), seats(many[0])))).where(F.col("k") < seats(many[0]))
    tie = F.xxhash64("name", "shard")
    places = ranked(between.select("name", "shard", (-F.col("want") / (F.col("k") + 0.5)).alias("quotient"), tie.alias("tie"), "k"), "quotient", "tie", "name", "shard", "k")
    more = places.where(F.col("place") < house - few[1]).groupBy("name", "shard").agg(F.count(F.lit(1)).alias("more"))
    return cells.join(more, ["name", "shard"], "left").withColumn("quota", seats(few[0]) + F.coalesce("more", F.lit(0))).drop("more")


def _laid(docs: DataFrame, extra: list[str], weights: tuple[float, ...], share: float, most: float, block: int, seed: int) -> DataFrame:
    """One row per row of docs: doc_id, source, the extra columns, and the columns of mix()."""
    row = [F.col("doc_id").cast("bigint"), "source", n_words(text_of()).alias("size"), F.xxhash64(text_of()).alias("key")]
    sizes = staged(docs.select(*row), "sizes")
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sources = staged(source_targets(sizes, weights, share, most).withColumn("name", named), "sources")
    least = sources.where("source_size > 0").agg(F.min("source_size")).first()[0] or 0
    block = max(1, min(block, least // 128))

    def dealt(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("name", named)
            .join(sources.drop("source"), "name")
            .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("docs") / SHARD_DOCS)))
            .withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.col("shards")))
        )

    cells = dealt(sizes).groupBy("name", "shard").agg(F.sum("size").alias("cell"), F.first("source_size").alias("s"), F.first("target").alias("t"))
    want = F.coalesce(F.col("t") * F.col("cell") / F.nullif("s", F.lit(0)), F.lit(0.0))
    cells = staged(cells.select("name", "shard", want.alias("want"), F.ceil(F.col("cell") / block).alias("blocks")), "cells")
    house = round((cells.agg(F.sum("want")).first()[0] or 0) / block)
    quotas = staged(apportion(cells, house, float(block)), "quotas").select(
        "name", "shard", "blocks", "quota", F.pmod(F.xxhash64(F.lit(seed + 1), "name", "shard"), F.greatest(F.lit(1), F.col("blocks"))).alias("shift")
    )
    order = Window.partitionBy("name", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(docs.select(*row, *[F.col(c).alias(f"__x_{c}") for c in extra]) if extra else sizes)
    laid = rows.withColumn("end", F.sum("size").over(order)).join(quotas, ["name", "shard"])
    laid = laid.withColumn("start", F.col("end") - F.col("size")).withColumn("passes", F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(F.lit(0)))
    return laid.withColumn("block", F.lit(block).cast("bigint")).withColumn("taken", taken())


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 16, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the parts of taken: passes (whole
    copies), start and end in the cell's stream, and quota, blocks and shift of the cell.

    Null and empty texts have size 0 and are taken 0 words of. Repeated rows each have a row; the
    null source is a source; null ids lie in one order with the rest. Reruns agree. `block` shrinks
    where sources are tiny, so that a target is never rounded by more than about half a percent.
    Very long texts are blocks like others. Other columns are not read. Empty tables give no rows.
    """
    return _laid(docs, [], weights, share, most, block, seed).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "passes", "start", "end", "blocks", "quota", "shift", "block", "name", "shard"
    )


#: Whether block j of a cell is among the rest of its quota.
CHOSEN = f"pmod(j * {STEP} + shift, blocks) < quota % blocks"


def taken() -> Column:
    """Words taken of a document: whole passes and its overlap with the chosen blocks."""
    over = f"aggregate(sequence(start div block, (end - 1) div block), 0L, (n, j) -> n + if({CHOSEN}, least(end, (j + 1) * block) - greatest(start, j * block), 0L))"
    return F.expr(f"if(size = 0, 0L, passes * size + {over})")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 16, seed: int = 7) -> DataFrame:
    """Rows of docs as the mix takes them: `passes` whole copies, then the words of the chosen
    blocks, joined by one space. Columns as in docs; n_chars, where there, follows the text.

    Rows are laid with their texts, so repeated rows and null ids are each taken as themselves. Rows
    of which no word is taken go, so null and empty texts do. An empty table gives no rows.
    """
    names = docs.columns
    laid = _laid(docs, names, weights, share, most, block, seed).where("taken > 0")
    keep = f"filter(__w, (w, i) -> exists(array((start + i) div block), j -> {CHOSEN}))"
    rest = F.expr(f"array_join(transform(array(regexp_extract_all(__x_text, '{WORD}', 0)), __w -> array_join({keep}, ' ')), '')".replace("\\", "\\\\"))
    texts = F.array_compact(F.concat(F.array_repeat(F.col("__x_text"), F.col("passes").cast("int")), F.array(F.when(F.expr("taken > passes * size"), rest))))
    out = laid.withColumn("__text", F.explode(texts))
    made = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("bigint")}
    return out.select(*[made.get(c, F.col(f"__x_{c}")).alias(c) for c in names])
