"""Language identification by mixture inference.

A text is a mixture of languages. Each word has a likelihood under each language, from hashed
character n-grams; expectation-maximisation estimates the text's language proportions. Languages
are then taken out one at a time, the smallest proportion first, and the set is kept whose
penalised likelihood (half a log of the word count for each language) is highest. The prediction
is the language with the largest proportion in that set.

N-gram counts come from a bounded sample: about FIT_DOCS texts of each language, chosen by a hash
among rows that are not held out, whole texts, counted in tasks. Inference is one pass over all
texts without a shuffle; words recur, so their likelihoods are kept per worker.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import held_out, map_arrow, text_of
from quorumlake.session import staged

#: Texts of a language that are learned from, at most about so many; n-gram buckets.
FIT_DOCS, BUCKETS = 1500, 1 << 15

#: Rounds of expectation and maximisation for each set of languages.
ROUNDS = 8

#: Rounds end early when no proportion moves by more.
SETTLED = 1e-3

CACHE_WORDS = 600_000

#: Signs that stand for numbers, word characters to `re` but no letters, each to a space.
NUMBERS = {ord(c): " " for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha()}

#: Runs of letters and number signs, longer ones in consecutive pieces of 40, so that all count.
LETTERS = re.compile(r"[^\W\d_]{1,40}")


def words_of(text: str) -> list[str]:
    """Words: runs of letters. Only a text that holds number signs pays for taking them out."""
    found = LETTERS.findall(text.lower())
    if found and not text.isascii() and not "".join(found).isalpha():
        found = LETTERS.findall(text.lower().translate(NUMBERS))
    return found


def _grams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2 and 3 characters: the buckets of all words' n-grams, word after word, and how many
    each word has. Words are marked at both ends."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the word's end
    out, rolled = [], np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3):
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        mixed = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
        inside = left[: len(codes) - n + 1] >= n
        out.append(((mixed[inside] % np.uint64(BUCKETS)).astype(np.int64), sizes - n + 1))
    return out


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    out: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}
    for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        words.setdefault(lang, Counter()).update(words_of(text))
    for lang, found in words.items():
        if found:
            n = out.setdefault(lang, np.zeros(BUCKETS, np.int64))
            times = np.fromiter(found.values(), np.int64, len(found))
            for buckets, sizes in _grams(list(found)):
                n += np.bincount(buckets, np.repeat(times, sizes), BUCKETS).astype(np.int64)
    rows = [(lang, int(b), int(n[b])) for lang, n in out.items() for b in np.nonzero(n)[0]]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "bucket", "n"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of n-gram buckets, one row a language.

    Texts of other languages under one label are few; a second pass is not made for them.
    """
    known = docs.where("lang is not null").where(~held_out()).select("doc_id", "lang", text_of().alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, FIT_DOCS / n))]), F.col("lang"))
    sample = known.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = map_arrow(sample.select("text", "lang"), _count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted(sizes)
    counts = np.zeros((len(langs), BUCKETS))
    for r in rows:
        counts[langs.index(r["lang"]), r["bucket"]] = r["n"]
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(1, keepdims=True))


class _Likelihoods:
    """Log likelihoods of words under each language, divided by the number of n-gram orders as
    n-grams of one word overlap."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table.T.copy()
        self.forget()

    def forget(self) -> None:
        self.rows: defaultdict[str, int] = defaultdict(count().__next__)
        self.values = np.zeros((1024, self.table.shape[1]))  # a buffer that doubles

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE_WORDS:
            self.forget()
        before = len(self.rows)
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        if len(self.rows) > before:
            new = [*islice(reversed(self.rows), len(self.rows) - before)][::-1]
            sums = np.zeros((len(new), self.table.shape[1]))
            for buckets, sizes in _grams(new):
                sums += np.add.reduceat(self.table[buckets], np.cumsum(sizes) - sizes, axis=0) / 3.0
            while len(self.rows) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[before : len(self.rows)] = sums
        return self.values[at]


def mixtures(likelihood: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions of each text's selected languages. likelihood: words x languages, log; a text's
    words end before ends[i]. No text is empty. A text stops moving when it has settled itself, so
    its result doesn't depend on the texts beside it."""
    starts = np.concatenate([[0], ends[:-1]])
    texts, languages = len(ends), likelihood.shape[1]
    n = (ends - starts).astype(float)
    of = np.repeat(np.arange(texts), ends - starts)
    top = likelihood.max(1, keepdims=True)
    scaled = np.exp(likelihood - top)
    mask = np.ones((texts, languages), bool)
    best, best_score = np.zeros((texts, languages)), np.full(texts, -np.inf)
    share = mask / mask.sum(1, keepdims=True)
    for _ in range(languages):
        moving = np.ones(texts, bool)
        for _ in range(rounds):
            weighed = scaled * share[of]
            weighed /= np.maximum(weighed.sum(1, keepdims=True), 1e-300)
            last, share = share, np.where(moving[:, None], np.add.reduceat(weighed, starts, axis=0) / n[:, None], share)
            moving &= np.abs(share - last).max(1) >= SETTLED
            if not moving.any():
                break
        held = np.log(np.maximum((scaled * share[of]).sum(1), 1e-300)) + top[:, 0]
        value = np.add.reduceat(held, starts) - 0.5 * mask.sum(1) * np.log(n + 1)
        better = value > best_score
        best[better], best_score[better] = share[better], value[better]
        more = mask.sum(1) > 1
        if not more.any():
            break
        low = np.where(mask, share, np.inf).argmin(1)
        mask[more, low[more]] = False
        share = np.where(mask, share + 1e-6, 0.0)
        share /= share.sum(1, keepdims=True)
    return best


def identify(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, languages (name and proportion of the selected set)."""
    known = docs.sparkSession.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch, own: list[_Likelihoods] = []) -> pa.RecordBatch:  # noqa: B006
        if not own:
            own.append(_Likelihoods(known.value))  # once a task
        likelihoods = own[0]
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        some = [i for i, w in enumerate(words) if w and langs]
        pred, score, sets = ["und"] * len(words), [0.0] * len(words), [[] for _ in words]
        if some:
            ends = np.cumsum([len(words[i]) for i in some])
            found = mixtures(likelihoods([w for i in some for w in words[i]]), ends)
            for i, p in zip(some, found, strict=True):
                k = int(p.argmax())
                pred[i], score[i] = langs[k], float(min(1.0, p[k]))
                sets[i] = [{"lang": langs[j], "share": float(p[j])} for j in np.argsort(-p, kind="stable") if p[j] > 0]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return pa.record_batch([batch.column(0), pa.array(pred), pa.array(score, pa.float64()), pa.array(sets, kind)], ["doc_id", "lang_pred", "score", "languages"])

    return map_arrow(docs.select("doc_id", text_of().alias("text")), run, "doc_id bigint, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    Null, empty and letterless texts, and all texts if no language is known, are und with score 0.
    Ties go to the first language by name. Null ids teach nothing and are not held out. Repeated
    rows each have a row; an empty table gives none. Very long texts are read whole. Other columns are
    not read.
    """
    found = identify(docs, *learn(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
