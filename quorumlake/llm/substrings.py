"""Repeated word windows across documents, through a log-structured fingerprint index.

A window is `window` consecutive words. Its fingerprint is the least hash of the GRAM-word grams
inside it: equal windows have equal fingerprints, and neighbouring windows mostly share one, so the
index holds about a fifth as many hashes as there are windows, for all of them. The index is a list
of immutable runs, bucketed by hash and sorted. A batch of documents becomes a run; the new run is
merge-joined with itself and with each older run, bucket by bucket, without moving either; what they
share is verified with the windows themselves. When there are `fan_in` runs, they are compacted.

Hashes that a large share of all documents carry would fill one bucket. They are found by a sketch
that Spark merges in one aggregation, kept as a short list, and count as shared without a join.

Whole copies of a smaller document are known by their digest and leave before all this.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quorumlake.llm.common import map_arrow, text_of
from quorumlake.operators.joins import counted_join, marks, perhaps
from quorumlake.session import release, shared_dir, staged

WINDOW, GRAM = 13, 5

#: Hashes that the sketch tracks, and the least share and number of a batch's rows that make one hot.
TRACKED, HOT, LEAST_HOT = 4096, 1 / 2000, 1000

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _rolled(hashes: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """A hash of each n neighbouring word hashes."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * factor + hashes[k : len(hashes) - n + 1 + k]
    out = (out ^ (out >> np.uint64(29))) * factor
    return out ^ (out >> np.uint64(32))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """The fingerprint of each window."""
    grams = _rolled(hashes, GRAM, _P1)
    span = window - GRAM + 1
    least = grams[: len(grams) - span + 1].copy()
    for k in range(1, span):
        np.minimum(least, grams[k : len(grams) - span + 1 + k], out=least)
    return least


def _windows(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window, as two longs."""
    return _rolled(hashes, window, _P1).view(np.int64), _rolled(hashes, window, _P2).view(np.int64)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), text_of().cast("binary").alias("text"))


def described(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, sha (of all words, joined by a space), hashes (the text's fingerprints)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, found = [], [], []
        for text in batch.column(1).to_pylist():
            words = text.split()
            n.append(len(words))
            sha.append(_digest(words))
            found.append(np.unique(_fingerprints(_hashes(words), window)).view(np.int64) if len(words) >= window else [])
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n_words", "sha", "hashes"])

    return map_arrow(_source(docs), run, "doc_id bigint, n_words bigint, sha binary, hashes array<bigint>")


MANIFEST = "runs array<string>, hot array<bigint>, hot_rows array<string>, buckets int"


class FingerprintIndex:
    """Sorted runs of (hash, doc_id) below one folder, and the rows of hot hashes beside them.

    With a folder of its own an index lasts: each batch ends with a manifest of runs, hot hashes and
    bucket number, and a later session opens the folder and goes on. Runs are Spark tables, so that
    joins know their buckets; opening names them anew. Without a folder nothing of it is kept.
    """

    def __init__(self, spark: SparkSession, buckets: int, fan_in: int = 8, folder: str | None = None) -> None:
        self.spark, self.buckets, self.fan_in, self.lasting = spark, buckets, fan_in, folder is not None
        self.folder = folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.hot: set[int] = set()
        self.hot_rows: list[str] = []  # folders of hot hashes' rows
        self.before: list[str] = []  # those of earlier sessions, whose rows no ingest here has told
        self.saved = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fan_in: int = 8) -> FingerprintIndex:
        """The index as its last whole batch left it."""
        rows = spark.read.option("basePath", f"{folder}/manifest").schema(f"{MANIFEST}, number int").json(f"{folder}/manifest/number=*")
        last = rows.orderBy(F.desc("number")).first()
        out = cls(spark, last["buckets"], fan_in, folder)
        out.runs, out.hot, out.saved = list(last["runs"]), set(last["hot"]), last["number"]
        out.hot_rows, out.before = list(last["hot_rows"]), list(last["hot_rows"])
        for name in out.runs:
            place = f"{folder}/{name}".replace("'", "\\'")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (hash BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {out.buckets} BUCKETS LOCATION '{place}'")
        return out

    def _save(self) -> None:
        if self.lasting:
            self.saved += 1
            row = (self.runs, sorted(self.hot), self.hot_rows, self.buckets)
            self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/number={self.saved}")

    def _keep_hot(self, rows: DataFrame) -> None:
        if self.lasting:
            name = f"hot_{uuid.uuid4().hex}"
            rows.select("hash", "doc_id").write.parquet(f"{self.folder}/{name}")
            self.hot_rows.append(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "hash").sortWithinPartitions("hash", "doc_id")
        dealt.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _cold(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.col("hash").isin(sorted(self.hot))) if self.hot else rows

    def ingest(self, rows: DataFrame) -> DataFrame:
        """Add a batch (hash, doc_id). Returns the rows, of the batch and of older runs, whose hash
        stands in two documents of which one at least is in the batch."""
        top = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(hash, 1000, {TRACKED})").alias("top")).first()
        new = {r["item"] for r in top["top"] or [] if r["count"] > max(LEAST_HOT, HOT * top["n"])} - self.hot
        again = [self.spark.table(r).where(F.col("hash").isin(sorted(new))) for r in self.runs] if new else []
        self.hot |= new
        shared = [rows.where(F.col("hash").isin(sorted(self.hot)))] if self.hot else []
        shared += again
        for x in shared:
            self._keep_hot(x)
        if self.before:
            old = self.spark.read.schema("hash bigint, doc_id bigint").parquet(*[f"{self.folder}/{p}" for p in self.before])
            shared.append(old.join(rows.select("hash").distinct(), "hash", "left_semi"))
        name = self._write(self._cold(rows))
        run, group = self.spark.table(name), Window.partitionBy("hash")
        both = run.withColumn("lo", F.min("doc_id").over(group)).withColumn("hi", F.max("doc_id").over(group))
        shared.append(both.where("lo <> hi").select("hash", "doc_id"))
        for older in map(self.spark.table, self.runs):
            shared.append(run.join(older, "hash", "left_semi"))
            shared.append(older.join(run, "hash", "left_semi"))
        out = shared[0].select("doc_id", "hash")
        for x in shared[1:]:
            out = out.unionByName(x.select("doc_id", "hash"))
        out = staged(out, "shared")
        self.runs.append(name)
        self._save()
        if len(self.runs) >= self.fan_in:
            self.compact()
        return out

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            rows = self.spark.table(self.runs[0])
            for r in self.runs[1:]:
                rows = rows.unionByName(self.spark.table(r))
            last, self.runs = self.runs, [self._write(self._cold(rows))]
            self._save()
            self._delete(last)

    def drop(self) -> None:
        """Delete the runs and their files."""
        self._delete(self.runs)
        self.runs = []

    def _delete(self, runs: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_windows(docs: DataFrame, shared: DataFrame, window: int = WINDOW, hot: set[int] = frozenset()) -> DataFrame:
    """(h1, h2, doc_id, hot): distinct windows of documents under the fingerprints that they share;
    hot for those under a hot one."""
    hot_list = np.array(sorted(hot), np.int64)
    asked = shared.groupBy("doc_id").agg(F.collect_set("hash").alias("asked"))
    texts = perhaps(_source(docs), "doc_id", marks(shared.select("doc_id")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, firsts, seconds, hots = [], [], [], []
        for doc, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = text.split()
            if len(words) < window:
                continue
            hashes = _hashes(words)
            prints = _fingerprints(hashes, window).view(np.int64)
            kept = np.isin(prints, np.array(asked, np.int64))
            one, two = _windows(hashes, window)
            one, at = np.unique(one[kept], return_index=True)
            firsts.append(one)
            seconds.append(two[kept][at])
            hots.append(np.isin(prints[kept][at], hot_list))
            ids.append(np.full(len(one), doc))
        if not ids:
            return None
        columns = [pa.array(np.concatenate(x), pa.int64()) for x in (firsts, seconds, ids)]
        return pa.record_batch([*columns, pa.array(np.concatenate(hots), pa.bool_())], ["h1", "h2", "doc_id", "hot"])

    return map_arrow(texts.join(asked, "doc_id"), run, "h1 bigint, h2 bigint, doc_id bigint, hot boolean")


def repeated(seen: DataFrame, some_hot: bool) -> DataFrame:
    """(doc_id, asked): the windows (h1) of a document that a smaller doc_id has too.

    A window that is not hot stands in a bounded share of documents: its rows meet once, in a
    window function. A hot one may stand in a third of them. Its smallest doc_id comes from an
    aggregation that combines before the shuffle; a document's repeats are its hot windows but those
    that it is itself the first to have, so no row of a hot window is joined.
    """
    cold = seen.where("not hot") if some_hot else seen
    least = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    later = cold.select("h1", "doc_id", least.alias("least")).where("least < doc_id")
    out = later.groupBy("doc_id").agg(F.collect_set("h1").alias("asked"))
    if not some_hot:
        return out
    hot = seen.where("hot")
    firsts = hot.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("h1").alias("own"))
    every = hot.groupBy("doc_id").agg(F.collect_set("h1").alias("held")).join(firsts, "doc_id", "left")
    rest = F.array_except("held", F.coalesce("own", F.expr("cast(array() as array<bigint>)")))
    both = out.unionByName(every.select("doc_id", rest.alias("asked")).where("size(asked) > 0"))
    return both.groupBy("doc_id").agg(F.flatten(F.collect_list("asked")).alias("asked"))


def _cut(words: list[bytes], asked: list[int], window: int) -> np.ndarray:
    """True for each word that one of the asked windows covers."""
    hit = np.isin(_windows(_hashes(words), window)[0], np.array(asked, np.int64))
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.nonzero(hit)[0]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(
    docs: DataFrame, window: int = WINDOW, batches: int = 2, with_text: bool = False, index: FingerprintIndex | None = None, history: DataFrame | None = None
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha (hex) for every row of docs; with_text adds kept_text,
    null where nothing was removed.

    Documents come in `batches` by ascending id, each merged into the index. A word goes if a window
    that covers it also starts in a document of smaller id; windows are those of the input.
    With an `index` that holds earlier documents, and their texts as `history`, docs are judged against
    both and join the index, which stays; earlier documents are not judged again. Of history, only
    documents that share a fingerprint with docs are read further.
    Null and empty texts and texts below `window` words lose nothing. Rows of one id are one
    document. Null ids are nobody's smaller id and lose nothing. An empty table gives no rows. Other
    columns are not read.
    """
    spark, lasting = docs.sparkSession, index is not None
    whole = staged(described(docs, window), "described")
    known = staged(whole.select("doc_id", "n_words", "sha"), "known")
    long, total = F.col("n_words") >= window, known.count()
    named = known.where("doc_id is not null")
    first = staged(named.where(long).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "first")
    same = counted_join(named.where(long).select("doc_id", "sha"), first, "sha", total)
    marked = same.select("doc_id", "sha", (F.col("first") < F.col("doc_id")).alias("copy")).unionByName(named.where(~long).select("doc_id", "sha", F.lit(False).alias("copy")))
    copies = staged(marked.where("copy").distinct(), "copies")
    gone = staged(marked.groupBy("doc_id").agg(F.bool_and("copy").alias("copy")).where("copy").select("doc_id"), "gone")
    own = staged(whole.where("doc_id is not null").select("doc_id", "hashes").join(gone, "doc_id", "left_anti"), "own")
    release(spark, whole, gone)
    size = own.agg(F.sum(F.size("hashes").cast("bigint")).alias("n"), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000).alias("cuts")).first()
    index = index or FingerprintIndex(spark, buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), (size["n"] or 0) // 2_000_000))
    cuts = [None, *sorted(set(size["cuts"] or [])), None]
    told = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        batch = own.where(F.lit(True) if low is None else F.col("doc_id") > low).where(F.lit(True) if high is None else F.col("doc_id") <= high)
        told.append(index.ingest(batch.select(F.explode("hashes").alias("hash"), "doc_id")))
    if not lasting:
        index.drop()
    release(spark, own)
    texts = docs.select("doc_id", "text")
    texts = texts if history is None else texts.unionByName(history.select("doc_id", "text"))
    # texts move twice; what the first time leaves on disk goes before the second
    seen = staged(shared_windows(texts, reduce(DataFrame.unionByName, told), window, index.hot), "windows")
    release(spark, *told)
    cut = staged(repeated(seen, bool(index.hot)), "cut")
    release(spark, seen)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sha, removed, kept, texts = [], [], [], []
        for text, asked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            gone = _cut(words, asked, window) if len(words) >= window else np.zeros(len(words), bool)
            rest = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            sha.append(_digest(words))
            removed.append(int(gone.sum()))
            kept.append(_digest(rest))
            texts.append(b" ".join(rest).decode() if with_text else None)
        return pa.record_batch([batch.column(0), pa.array(sha, pa.binary()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "sha", "removed", "kept", "kept_text"])

    texts = perhaps(_source(docs), "doc_id", marks(cut.select("doc_id")))
    done = map_arrow(texts.join(cut, "doc_id"), run, "doc_id bigint, sha binary, removed bigint, kept binary, kept_text string").dropDuplicates(["doc_id", "sha"])
    empty = F.lit(hashlib.sha256(b"").digest())
    full = known.select("doc_id", "sha", "n_words").join(copies, ["doc_id", "sha"], "left").join(done, ["doc_id", "sha"], "left")
    is_copy = F.coalesce("copy", F.lit(False))
    columns = [
        "doc_id",
        "n_words",
        F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.lower(F.hex(F.when(is_copy, empty).otherwise(F.coalesce("kept", "sha")))).alias("kept_sha"),
    ]
    text = F.when(is_copy, F.lit("")).when(F.col("removed") > 0, F.col("kept_text")).alias("kept_text")
    return full.select(*columns, *[text] * with_text)
