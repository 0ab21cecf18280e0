"""How far sources of a language diverge in their terms.

A term is a run of letters A-Z, a-z or characters beyond ASCII, which in UTF-8 is a run of bytes: a
look-up table over the buffer of a batch's texts, with a separator between them, finds all boundaries
at once. Slices are grouped by XXH64; every slice is then compared with its group's first one byte by
byte, and those that differ are grouped by their bytes. Counts leave a task once for its terms, not
for its texts.

A language keeps terms of enough documents. Kept terms are dealt in blocks of about ENTRIES (source,
term) counts, whatever a language or term weighs; a block is a CSR matrix of sources by terms, and one
`reduceat` a source gives its divergence from all others on the block. What sources without a term
add is the same for each term, so it is a product, not a column. All numbers are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.session import discard, staged

#: Documents of a language that a kept term is in at least; terms listed for each group.
MIN_DOCS, TOP_TERMS = 30, 50

#: Smoothing of counts, and what probabilities are multiplied by: a thousand cubed.
PRIOR, SCALE = 5, 1000

#: (source, term) counts of a block; bytes of texts tokenized together; counts a task holds.
ENTRIES, CHUNK, HELD = 1 << 17, 1 << 21, 1 << 19

#: What a byte becomes: 0 outside terms, A-Z in lower case, others themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[:0x41] = LOWER[0x5B:0x61] = LOWER[0x7B:0x80] = 0
LOWER[0x41:0x5B] += 0x20


def boundaries(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not 0."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = buffer != 0
    turns = np.flatnonzero(np.diff(inside))
    return turns[::2], turns[1::2]


def grouped(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=None) -> tuple[list[bytes], np.ndarray]:
    """The distinct slices, and which of them each slice is. Hashes only propose groups."""
    from xxhash import xxh64_intdigest

    digest, whole = digest or xxh64_intdigest, buffer.tobytes()
    hashes = np.fromiter((digest(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    # bytes of each slice against those at the same place of the first slice of its group
    sizes, lead = ends - starts, first[of]
    wrong = sizes != sizes[lead]
    step = 1 << 16
    for at in range(0, len(starts), step):
        some = np.flatnonzero(~wrong[at : at + step]) + at
        n = sizes[some]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        unlike = buffer[np.repeat(starts[some], n) + inner] != buffer[np.repeat(starts[lead[some]], n) + inner]
        wrong[np.repeat(some, n)[unlike]] = True
    known: dict[tuple[int, bytes], int] = {}
    for i in np.flatnonzero(wrong).tolist():
        term = whole[starts[i] : ends[i]]
        if (int(of[i]), term) not in known:
            known[int(of[i]), term] = len(terms)
            terms.append(term)
        of[i] = known[int(of[i]), term]
    return terms, of


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of rows of about CHUNK bytes; a longer text is a span of its own."""
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")) + at)
        yield at, end
        at = end


def _tokenize(texts: pa.Array, group: np.ndarray, groups: int) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of each span of texts; group is a number for each text."""
    sizes = np.array([len(x) for x in texts.to_pylist()], np.int64)
    for a, b in _chunks(sizes):
        buffer = LOWER[np.frombuffer(b"\0".join(texts.slice(a, b - a).to_pylist()), np.uint8)]
        starts, ends = boundaries(buffer)
        if not len(starts):
            continue
        terms, of = grouped(buffer, starts, ends)
        doc = np.searchsorted(np.cumsum(sizes[a:b] + 1), starts, "right")
        own, n = np.unique(doc * len(terms) + of, return_counts=True)  # a (document, term) each
        key = group[a + own // len(terms)] * len(terms) + own % len(terms)
        keys, at = np.unique(key, return_inverse=True)
        yield keys // len(terms), [terms[t] for t in (keys % len(terms)).tolist()], np.bincount(at, n).astype(np.int64), np.bincount(at)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs(lang, source, text): occurrences, and texts with the term."""
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        n_held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                n, d = np.array(list(found.values()), np.int64).T
                term = pa.array(list(found), pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array([lang] * len(found)), pa.array([source] * len(found)), term, pa.array(n), pa.array(d)], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            numbers = {name: i for i, name in enumerate(dict.fromkeys(names))}
            listed = list(numbers)
            for groups, terms, n, d in _tokenize(batch.column(2), np.array([numbers[x] for x in names], np.int64), len(numbers)):
                for g, term, k, m in zip(groups.tolist(), terms, n.tolist(), d.tolist(), strict=True):
                    own = held.setdefault(listed[g], {})
                    if term in own:
                        own[term][0] += k
                        own[term][1] += m
                    else:
                        own[term] = [k, m]
                        n_held += 1
                if n_held > HELD:
                    yield from out()
                    n_held = 0
        yield from out()

    found = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, schema)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE ** 3 * n / of) for whole 0 < n <= of, by long division in base SCALE: nothing
    overflows below 9e15."""
    n, of = np.asarray(n, np.int64), np.asarray(of, np.int64)
    out, rest = n // of, n % of
    for _ in range(3):
        rest = rest * SCALE
        out, rest = out * SCALE + rest // of, rest % of
    return out + 1


def block_divergences(indptr: np.ndarray, cols: np.ndarray, p: np.ndarray, zero: np.ndarray, terms: int) -> np.ndarray:
    """Of a CSR block, sources x sources: the sum over its terms of |p_a - p_b| - |zero_a - zero_b|,
    which is 0 for terms that neither source has. `zero` is each source's p without occurrences."""
    sources = len(zero)
    out = np.zeros((sources, sources), np.int64)
    full = np.flatnonzero(np.diff(indptr))  # reduceat has no empty runs
    if not len(full):
        return out
    at = indptr[full]
    row = np.repeat(np.arange(sources), np.diff(indptr))
    for a in full.tolist():
        mine = slice(indptr[a], indptr[a + 1])
        flat = np.abs(zero[a] - zero)
        dense, has = np.full(terms, zero[a], np.int64), np.zeros(terms, bool)
        dense[cols[mine]], has[cols[mine]] = p[mine], True
        # terms that b has, then those that only a has: all of a's, without the common ones
        theirs = np.abs(dense[cols] - p) - flat[row]
        common = np.where(has[cols], np.abs(dense[cols] - zero[row]) - flat[row], 0)
        own = np.abs(p[mine][None, :] - zero[:, None]).sum(1) - flat * (indptr[a + 1] - indptr[a])
        out[a] = own
        out[a, full] += np.add.reduceat(theirs - common, at)
    only_b = np.setdiff1d(np.arange(sources), full)
    out[only_b[:, None], full] = out[full[:, None], only_b].T
    return out


def _block(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    """Of one block of a language's terms: (lang, part, source, item, value) for pairs of sources, the
    smaller name first, and for each source's leading terms."""
    if rows.empty or totals.empty:
        return pd.DataFrame({c: np.array([], object if c != "value" else np.int64) for c in ("lang", "part", "source", "item", "value")})
    totals = totals.sort_values("source", ignore_index=True)
    names, of = totals["source"].to_numpy(), totals["of"].to_numpy(np.int64)
    terms, col = np.unique(rows["term"].to_numpy(), return_inverse=True)
    row, n = np.searchsorted(names, rows["source"].to_numpy()), rows["n"].to_numpy(np.int64)
    order = np.lexsort((col, row))
    row, col, n = row[order], col[order], n[order]
    p, zero = probability(n + PRIOR, of[row]), probability(np.full(len(names), PRIOR), of)
    indptr = np.searchsorted(row, np.arange(len(names) + 1))
    found = block_divergences(indptr, col, p, zero, len(terms))
    a, b = np.nonzero(np.triu(found != 0, 1))

    q = probability(np.bincount(col, n, len(terms)).astype(np.int64) + PRIOR, int(totals["of_lang"].iloc[0]))
    above = p - q[col]
    lead = np.flatnonzero(above > 0)
    lead = lead[np.lexsort((col[lead], -above[lead], row[lead]))]
    place = np.arange(len(lead)) - np.searchsorted(row[lead], row[lead])
    lead = lead[place < TOP_TERMS]
    sources, items = np.concatenate([names[a], names[row[lead]]]), np.concatenate([names[b], terms[col[lead]]])
    part = np.repeat(np.array(["pair", "term"], object), [len(a), len(lead)])
    return pd.DataFrame({"lang": np.full(len(part), rows["lang"].iloc[0], object), "part": part, "source": sources, "item": items, "value": np.concatenate([found[a, b], above[lead]])})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, entries: int = ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank for each (lang, source) of docs(lang, source, text).

    A language keeps the V terms in at least min_docs of its rows; repeated rows count each. A term's p
    in a group is 1 + floor(10 ** 9 (n + 5) / (N + 5 V)), n its occurrences, N those of all kept terms.
    Part `pair`: the sum over kept terms of |p - q| for every other source of the language. Part `term`:
    the `top` kept terms that occur and whose p exceeds the language's, by the difference. Ranks are
    from 1, by value descending, then item. Null texts, languages and sources are empty strings. Texts
    without terms still make their group; an empty table gives none. Other columns are not read.
    """
    if not 0 < top <= TOP_TERMS:
        raise ValueError(f"a block keeps {TOP_TERMS} terms of a source")
    lang, source, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    plain = docs.select(lang, source, text)
    groups = staged(plain.select("lang", "source").distinct(), "groups")
    counts = staged(term_counts(plain), "counts")
    kept = staged(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term"), "kept")
    mine = staged(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "mine")
    discard(counts)

    # a row a language or group from here on
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = mine.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("entries"))
    every = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "n", "entries"])
    by_lang = Window.partitionBy("lang")
    every = every.select(
        "lang", "source", "v", (F.col("n") + PRIOR * F.col("v")).alias("of"), (F.sum("n").over(by_lang) + PRIOR * F.col("v")).alias("of_lang"),
        F.greatest(F.ceil(F.sum("entries").over(by_lang) / entries), F.lit(1)).cast("int").alias("blocks"),
    )
    every = staged(every, "totals")

    langs = every.select("lang", "blocks").distinct()
    dealt = mine.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n")
    beside = every.where("v > 0").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "of", "of_lang")

    blocks = dealt.groupBy("lang", "block").cogroup(beside.groupBy("lang", "block")).applyInPandas(_block, "lang string, part string, source string, item string, value bigint")
    found = staged(blocks, "blocks")

    p_zero = F.when(F.col("v") > 0, F.expr(f"1 + {SCALE**3 * PRIOR}L div of"))
    each = every.select("lang", "source", "v", p_zero.alias("zero"))
    pairs = each.join(each.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_item")), "lang").where("source <> item")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    flat: Column = F.col("v") * F.abs(F.col("zero") - F.col("zero_item"))
    pair = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce(flat, F.lit(0)) + F.coalesce("value", F.lit(0))).cast("bigint").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    term = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    out = pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
