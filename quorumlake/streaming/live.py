"""A partition that follows changing decisions.

A handle's label depends on its component of the SAME graph alone. A batch of changed decisions
therefore touches the components of its ends and no others: these are taken apart, joined with what
the batch brings, and built anew; all other components stay where they are, unread.

State is four append-only tables, each row under the batch that wrote it: `votes` (the last one taken
of each relation), `index` (handle to component), `members` and `edges` of components. A component's
rows are those of its last batch; one that has dissolved leaves a row without content. Tables are dealt
in buckets by key, so looking up touched keys reads their buckets. Old batches are folded into one from
time to time.

Touched components of up to FOLD_EDGES edges together are built in one task, more by the distributed
partition; both give the same labels.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators.partition import FOLD_EDGES, fold, partition_within
from quorumlake.schema import DIFFERENT, PAIR, SAME
from quorumlake.session import discard, staged

#: Buckets of each table; batches after which a table is folded into one.
BUCKETS, BATCHES = 64, 16

#: Key, columns and, null in a row without content, a column of each table.
TABLES = {
    "votes": (PAIR, "h_left string, h_right string, vote string", "vote"),
    "index": (["handle"], "handle string, component string", "handle"),
    "members": (["component"], "component string, handle string, label string", "handle"),
    "edges": (["component"], "component string, h_left string, h_right string, vote string", "h_left"),
}


#: Rows that are no relation, an error.
DISORDER = "h_left is null or h_right is null or h_left >= h_right"


def _built(edges: pd.DataFrame) -> pd.DataFrame:
    """(handle, label, component) of all ends of a bounded number of edges."""
    pairs = list(zip(edges["h_left"], edges["h_right"], strict=True))
    same, different = ([p for p, v in zip(pairs, edges["vote"], strict=True) if v == vote] for vote in (SAME, DIFFERENT))
    labels, whole = fold(same, different), fold(same, [])
    return pd.DataFrame({"handle": list(labels), "label": list(labels.values()), "component": [whole.get(h, h) for h in labels]})


def _stands(vote: str) -> Column:
    """The vote of an edge, else null."""
    return F.when(F.col(vote).isin(SAME, DIFFERENT), F.col(vote))


class LivePartition:
    """The partition kept in a shared folder. apply() takes batches in the order of their numbers; one
    that is applied again replaces what it wrote. `read` tells, for each batch applied here, how many
    components, handles and edges it looked at."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, batches: int = BATCHES, fold_edges: int = FOLD_EDGES) -> None:
        self.spark, self.folder, self.buckets, self.batches, self.fold_edges = spark, folder, buckets, batches, fold_edges
        self.read: dict[int, dict[str, int]] = {}

    def _path(self, at: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{at}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, table: str) -> list[int]:
        """Batches of a table that were written to their end."""
        path, fs = self._path(f"{table}/batch=*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in fs.globStatus(path) or [])

    def _rows(self, table: str, below: int, keys: DataFrame | None = None) -> DataFrame:
        """The newest rows of all keys, or of those in `keys`, from batches below a number."""
        key, columns, _ = TABLES[table]
        paths = [f"{self.folder}/{table}/batch={n}" for n in self._numbers(table) if n < below]
        if not paths:
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(f"{columns}, batch bigint, bucket int").option("basePath", f"{self.folder}/{table}").parquet(*paths)
        if keys is not None:
            wanted = keys.select(*key, self._bucket(key).alias("bucket"))
            which = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most `buckets`
            rows = rows.where(F.col("bucket").isin(which)).join(wanted, [*key, "bucket"], "left_semi")
        newest = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
        return rows.join(newest, [*key, "batch"]).drop("batch", "bucket")

    def _bucket(self, key: list[str]):  # noqa: ANN202
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame, number: int) -> None:
        dealt = rows.withColumn("bucket", self._bucket(TABLES[table][0]))
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{table}/batch={number}")

    def _ready(self, at: int) -> None:
        """Fold tables of many batches; give a folder from before votes were kept those of its edges."""
        for table in TABLES:
            if len([n for n in self._numbers(table) if n < at]) > self.batches:
                self._fold(table, at - 1)
        if not any(n < at for n in self._numbers("votes")) and any(n < at for n in self._numbers("edges")):
            self._write("votes", self._rows("edges", at).where("h_left is not null").select(*PAIR, "vote").distinct(), at - 1)

    def follow(self, decided: DataFrame, number: int) -> None:
        """Take decisions as apply() does, but only those whose vote is another than the last one taken of
        their relation. One of which none was taken is unknown, and its handles are not known by it."""
        at = 2 * number
        self._ready(at)
        rows = staged(decided.select(*PAIR, _stands("vote").alias("vote")), "decided")
        known = self._rows("votes", at, rows).withColumnRenamed("vote", "was")
        self.apply(rows.join(known, PAIR, "left").where(~F.col("vote").eqNullSafe(F.col("was")) | F.expr(DISORDER)), number)
        discard(rows)

    def apply(self, changes: DataFrame, number: int) -> None:
        """Take changed decisions(h_left, h_right, vote), a row a relation. Any vote but SAME and
        DIFFERENT, or null, takes the relation out. Handles never seen before are their own component;
        a relation of one handle with itself, or with null, is an error."""
        at = 2 * number  # odd numbers are folded tables
        self._ready(at)
        rows = staged(changes.select(*PAIR, _stands("vote").alias("vote")), "changes")
        if not rows.where(DISORDER).isEmpty():
            raise ValueError("relations need two handles in order")
        if rows.isEmpty():
            return
        ends = staged(rows.select(F.explode(F.array(*PAIR)).alias("handle")).distinct(), "ends")
        found = ends.join(self._rows("index", at, ends), "handle", "left").select("handle", F.coalesce("component", "handle").alias("component"))
        touched = staged(found.select("component").distinct(), "touched")
        handles = staged(self._rows("members", at, touched).where("handle is not null").select("handle").union(ends).distinct(), "affected")
        old = self._rows("edges", at, touched).where("h_left is not null").select(*PAIR, "vote").distinct()
        edges = old.join(rows, PAIR, "left_anti").unionByName(rows.where("vote is not null"))
        edges = staged(edges, "open")
        left, right = (handles.withColumnRenamed("handle", c) for c in PAIR)
        inside = edges.join(left, "h_left", "left_semi").join(right, "h_right", "left_semi")
        inside = staged(inside, "inside")
        if inside.count() <= self.fold_edges:
            found = inside.groupBy().applyInPandas(_built, "handle string, label string, component string")
            alone = [F.coalesce(c, "handle").alias(c) for c in ("label", "component")]
            new = handles.join(found, "handle", "left").select("handle", *alone)
        else:
            new = partition_within(handles, inside, self.fold_edges)
        new = staged(new, "rebuilt")
        ids = staged(touched.unionByName(new.select("component")).distinct(), "ids")
        empty = ids.join(new, "component", "left_anti").select("component", F.lit(None).cast("string").alias("handle"), F.lit(None).cast("string").alias("label"))
        # an edge between components stands with both; the untouched one's copy stays as it is
        sides = [edges.join(new.select(F.col("handle").alias(c), "component"), c).select("component", *PAIR, "vote") for c in PAIR]
        kept = staged(sides[0].unionByName(sides[1]).distinct(), "kept")
        bare = ids.join(kept, "component", "left_anti").select("component", *[F.lit(None).cast("string").alias(c) for c in (*PAIR, "vote")])
        self._write("votes", rows, at)
        self._write("members", new.select("component", "handle", "label").unionByName(empty), at)
        self._write("edges", kept.unionByName(bare), at)
        self._write("index", new.select("handle", "component"), at)
        self.read[number] = {"components": touched.count(), "handles": handles.count(), "edges": edges.count()}
        discard(rows, ends, touched, handles, edges, inside, new, ids, kept)

    def _fold(self, table: str, at: int) -> None:
        """One batch in place of all before it. A fold that is cut off leaves no _SUCCESS and is not
        read; one that has ended holds all that the batches it replaces did."""
        done = [n for n in self._numbers(table) if n < at]
        self._write(table, self._rows(table, at).where(f"{TABLES[table][2]} is not null"), at)
        for n in done:
            path, fs = self._path(f"{table}/batch={n}")
            fs.delete(path, True)

    def membership(self) -> DataFrame:
        """(handle, label) of all handles seen."""
        return self._rows("members", 1 << 62).where("handle is not null").select("handle", "label")
