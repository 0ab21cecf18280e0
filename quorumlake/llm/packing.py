"""Packing of documents into sequences of equal length, with balanced attention cost.

The cost of a piece of n tokens is n + n * n / capacity: a part that grows with its tokens and a
part that grows with the token pairs attention compares. Pieces are dealt to shards by a hash; in
each shard, in descending order of length, a piece goes to the sequence of lowest cost that has
room for it, and a new sequence is opened where none has. Shards hold about SHARD_SEQUENCES
sequences, however large the corpus is, so no task grows with the input and none waits for another.

A document longer than a sequence is cut into pieces of the full capacity and a rest. Cutting
depends on the document alone, so each text is encoded once, in one pass over the corpus.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import kept, map_arrow, text_of
from quorumlake.session import staged

SHARD_SEQUENCES = 256

#: Encoded strings between blanks that a Python worker keeps; at this size it starts anew.
CACHE_ENTRIES = 800_000

#: Letters of the Latin-1 block, perhaps with ASCII marks after them: the tokenizer lower-cases the
#: letters one by one and never forms a token across their end.
LETTERS = r"[a-z\xdf-\xf6\xf8-\xff]+"
PLAIN = re.compile(rf"({LETTERS})([!-/:-@\[-`{{-~]*)")

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class _Encoder:
    """Ids of texts as arrays.

    The tokenizer drops white space and never forms a token across it, so a text's ids are those
    of its blank-separated parts, one after another; parts recur, and each is encoded once. A plain
    part (see PLAIN) is its letters and its marks, which recur more often still.
    """

    def __init__(self, path: str, cache: int = CACHE_ENTRIES) -> None:
        from tokenizers import Tokenizer

        self.path, self.cache, self.tokenizer = path, cache, Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.word_end = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        if suffix:
            self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """An empty cache. A part has a code and two atoms, its letters and its marks; an atom has a
        code and a place in one buffer of ids. Atom 0 is empty."""
        self.parts: defaultdict[str, int] = defaultdict(count().__next__)
        self.atoms: defaultdict[str, int] = defaultdict(count(1).__next__, {"": 0})
        self.pair, self.ids = np.zeros((0, 2), np.int64), np.zeros(0, np.int32)
        self.start, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone, encoded together, and how many each has: the last token
        of each is a word end."""
        ids = self.whole(" ".join(words))
        ends = np.nonzero(self.word_end[ids])[0] + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self.apart(words)

    def apart(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As words(), for any parts: a token belongs to the part in which it starts."""
        found = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        starts = np.cumsum([0, *(len(x) + 1 for x in parts[:-1])])
        of = np.searchsorted(starts, [a for a, _ in found.offsets], side="right") - 1
        return np.array(found.ids, np.int32), np.bincount(of, minlength=len(parts))

    def _learn(self, parts: list[str]) -> None:
        """Atoms of parts that are new, and ids of atoms that are."""
        before, atom = len(self.atoms), self.atoms.__getitem__
        plain = [PLAIN.fullmatch(x.lower()) for x in parts]
        first = np.fromiter((atom(m[1] if m else x) for x, m in zip(parts, plain, strict=True)), np.int64, len(parts))
        second = np.fromiter((atom(m[2] if m else "") for m in plain), np.int64, len(parts))
        self.pair = np.concatenate([self.pair, np.stack([first, second], 1)])
        new = [*islice(reversed(self.atoms), len(self.atoms) - before)][::-1]
        size, ids = np.zeros(len(new), np.int64), [self.ids]
        start, at = np.zeros(len(new), np.int64), len(self.ids)
        letters = np.fromiter((bool(re.fullmatch(LETTERS, x)) for x in new), bool, len(new))
        for those, encode in ((np.nonzero(letters)[0], self.words), (np.nonzero(~letters)[0], self.apart)):
            for some in (those[k : k + 500] for k in range(0, len(those), 500)):
                found, n = encode([new[i] for i in some])
                size[some], start[some] = n, at + np.cumsum(n) - n
                ids.append(found)
                at += len(found)
        self.ids, self.start, self.size = np.concatenate(ids), np.append(self.start, start), np.append(self.size, size)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.parts) > self.cache:
            self.forget()
        before, code = len(self.parts), self.parts.__getitem__
        coded = [None if "<|" in t else np.fromiter(map(code, t.replace("\n", " ").split(" ")), np.int64) for t in texts]
        if len(self.parts) > before:
            self._learn([*islice(reversed(self.parts), len(self.parts) - before)][::-1])
        out = []
        for t, c in zip(texts, coded, strict=True):
            if c is None:
                out.append(self.whole(t))
            else:
                atoms = self.pair[c].ravel()
                n = self.size[atoms]
                out.append(self.ids[np.repeat(self.start[atoms] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return out


def _encoder(path: str, cache: int) -> _Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(f"encoder {path} {cache}", lambda: _Encoder(path, cache))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False, cache: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens; with_ids adds its ids.

    Null and empty texts give one piece that holds end_id alone. Repeated rows and null ids give a
    piece each. Other columns of docs are not read.
    """
    end = np.int32(end_id)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        rows: list[tuple] = []
        for doc, own in zip(ids, _encoder(tokenizer, cache).encode(batch.column(1).to_pylist()), strict=True):
            own = np.append(own, end).astype("<i4")
            for start in range(0, len(own), capacity):
                part = own[start : start + capacity]
                row = (doc, start, len(part), zlib.crc32(part), len(own))
                rows.append((*row, part) if with_ids else row)
        types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")), run, PIECES + ", ids array<int>" * with_ids)


def balance(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one shard; lengths are at most capacity."""
    order = np.argsort(-lengths, kind="stable")
    count = max(1, -(-int(lengths.sum()) // capacity))
    heap = [(0.0, i) for i in range(count)]
    fill, sequence, offset = [0] * count, np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in order.tolist():
        n, full = int(lengths[k]), []
        at = -1
        while heap:
            cost, i = heapq.heappop(heap)
            if fill[i] + n <= capacity:
                at = i
                break
            if fill[i] < capacity:
                full.append((cost, i))
        if at < 0:
            at, cost = len(fill), 0.0
            fill.append(0)
        sequence[k], offset[k] = at, fill[at]
        fill[at] += n
        heapq.heappush(heap, (cost + n + n * n / capacity, at))
        for x in full:
            heapq.heappush(heap, x)
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False, cache: int = CACHE_ENTRIES) -> DataFrame:
    """The pieces of docs with sequence_id and offset; offsets of a sequence run gapless from 0.

    Every id of every document lies in exactly one piece. Ties in length and cost go by doc_id and
    start, then by sequence number, so a rerun packs alike. An empty table gives no rows. Of `cache`,
    the encoded strings that a worker keeps, only time and memory depend.
    """
    found = staged(pieces(docs, tokenizer, capacity, end_id, with_ids, cache), "pieces")
    total = found.agg(F.sum("length")).first()[0] or 0
    shards = max(1, round(total / (capacity * SHARD_SEQUENCES)))
    schema = PIECES + ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="shard").sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        sequence, offset = balance(part["length"].to_numpy(), capacity)
        return part.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))
    return found.withColumn("shard", shard).groupBy("shard").applyInPandas(run, schema)
