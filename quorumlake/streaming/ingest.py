"""Evidence as a stream: unordered, repeated and late cells end in the same decisions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quorumlake.operators.ingest import domain_violations, equivocations
from quorumlake.schema import DIFFERENT, KEY, PAIR, SAME, UNKNOWN
from quorumlake.session import shared_dir


def read_files(spark: SparkSession, path: str, schema=None, max_files: int = 1) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream. A file's folder is read with a filter on
    its name, so other tables beside it stay out."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent())) if single else reader.parquet(path)


def cells_of_events(events: DataFrame) -> DataFrame:
    """A cell an event: neighbouring users, the event's type as source. The vote follows from the
    key, so a repeated key is a repeat and never an equivocation."""
    user = lambda c: F.concat(F.lit("u"), F.lpad(c.cast("string"), 7, "0"))
    epoch = F.col("event_id") % 4
    k = (F.col("user_id") * 7 + epoch * 3 + F.length("event_type")) % 5
    vote = F.when(k < 3, "same").when(k == 3, "unknown").otherwise("different")
    return events.select(user(F.col("user_id")).alias("h_left"), user(F.col("user_id") + 1).alias("h_right"), epoch.alias("epoch"), F.col("event_type").alias("source"), vote.alias("vote"))


def run_available(cells: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append each cell to a table, once for all there is, and read the table.

    Repeats are dropped by state per cell; the checkpoint and the sink's log make a restart go on
    where the stopped run was, without loss or repeats. Unlike cells of one key are an error, as in
    any ingest: none of them wins.
    """
    spark = cells.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/cells", checkpoint or f"{base}/checkpoint"
    once = cells.dropDuplicates()
    write = once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    write.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    table = spark.read.schema(cells.schema).parquet(path)
    body = F.struct(*[c for c in table.columns if c not in KEY])
    if bad := table.groupBy(KEY).agg(F.count_distinct(body).alias("n")).where("n > 1").limit(5).collect():
        raise ValueError("equivocation: " + "; ".join(f"{r.h_left}, {r.h_right}, {r.epoch}, {r.source}" for r in bad))
    return table


def validated_sink(path: str, sources: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that takes a micro-batch whole or, where a cell breaks a rule or a key
    equivocates, within the batch or against the table, not at all: the query stops and the table
    stays as it was. Batch numbers make a replayed batch a no-op."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            known = spark.read.parquet(path) if _exists(spark, path) else None
            if known is not None and not known.where(F.col("batch") == number).isEmpty():
                return
            every = batch if known is None else batch.unionByName(known.drop("batch").join(batch.select(KEY).distinct(), KEY, "left_semi"))
            bad = domain_violations(batch, sources).select("rule").unionByName(equivocations(every).select(F.lit("equivocation").alias("rule")))
            if rows := bad.distinct().limit(5).collect():
                raise ValueError(f"batch {number} refused: {', '.join(r.rule for r in rows)}")
            fresh = batch.dropDuplicates(KEY)
            if known is not None:
                fresh = fresh.join(known.select(KEY), KEY, "left_anti")
            fresh.withColumn("batch", F.lit(number).cast("bigint")).write.mode("append").parquet(path)
        finally:
            batch.unpersist()

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def rows_of_events(events: DataFrame) -> DataFrame:
    """Cells of events and, for one event in 97, a floor of its relation (source null) between 1 and 3."""
    user = lambda c: F.concat(F.lit("u"), F.lpad(c.cast("string"), 7, "0"))
    pair = user(F.col("user_id")).alias("h_left"), user(F.col("user_id") + 1).alias("h_right")
    cell = cells_of_events(events.select("event_id", "user_id", "event_type"))
    floor = events.where("event_id % 97 = 0").select(*pair, (1 + F.col("event_id") % 3).alias("epoch"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("vote"))
    return cell.unionByName(floor)


def landed(rows: DataFrame, *order: str, files: int = 4) -> str:
    """A folder with rows in so many files, dealt by range of `order`: what a stream reads file by file."""
    path = f"{shared_dir(rows.sparkSession)}/landed-{uuid.uuid4().hex}"
    rows.repartitionByRange(files, *order).write.parquet(path)
    return path


class RelationState(StatefulProcessor):
    """State of one relation: its floor and the cells at or above it. Rows are cells, or floors
    (source null). A cell below the floor is dropped however early it was sent; one above is taken
    however late. A floor only rises, and evicts what lies below. Each change gives the relation's
    decision anew, so readers update; a later epoch can turn SAME into DIFFERENT. A relation that a
    floor leaves without cells gives a row of null epoch and vote. With only_changes, a row comes
    only when the vote is another than the last one sent; a relation of which nothing was sent is
    unknown. Unlike votes of one key are an error."""

    def __init__(self, n_sources: int, threshold: int, only_changes: bool = False) -> None:
        self.n_sources, self.threshold, self.only_changes = n_sources, threshold, only_changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.floor = handle.getValueState("floor", "epoch bigint")
        self.cells = handle.getMapState("cells", "epoch bigint, source string", "vote string")
        self.last = handle.getValueState("last", "vote string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803, ANN001
        floor = self.floor.get()[0] if self.floor.exists() else -1
        held = {(epoch, source): vote for (epoch, source), (vote,) in self.cells.iterator()}
        new = {}
        for part in rows:
            for epoch, source, vote in zip(part["epoch"], part["source"], part["vote"], strict=True):
                if source is None or source != source:
                    floor = max(floor, int(epoch))
                elif epoch >= floor:
                    at = int(epoch), source
                    if held.get(at, new.setdefault(at, vote)) != vote or new[at] != vote:
                        raise ValueError(f"equivocation: {key[0]}, {key[1]}, {epoch}, {source}")
        self.floor.update((floor,))
        for at in [at for at in held if at[0] < floor]:
            self.cells.removeKey(at)
            del held[at]
        for at, vote in new.items():
            if at not in held and at[0] >= floor:
                self.cells.updateValue(at, (vote,))
                held[at] = vote
        votes: dict[int, list[str]] = {}
        for (epoch, _), vote in held.items():
            votes.setdefault(epoch, []).append(vote)
        sealed, epoch, vote = False, None, None
        if votes:
            sealed, epoch = max((len(v) == self.n_sources, e) for e, v in votes.items())
            same, different = votes[epoch].count("same"), votes[epoch].count("different")
            vote = "unknown" if not sealed else "different" if different else "same" if same >= self.threshold else "unknown"
        if self.only_changes:
            vote = vote or "unknown"
            if vote == (self.last.get()[0] if self.last.exists() else "unknown"):
                return
            self.last.update((vote,))
        yield pd.DataFrame({"h_left": [key[0]], "h_right": [key[1]], "epoch": pd.array([epoch], "Int64"), "sealed": [sealed], "vote": [vote]})

    def close(self) -> None:
        pass


def stateful_decisions(rows: DataFrame, n_sources: int, threshold: int, only_changes: bool = False) -> DataFrame:
    """Decisions of a stream of cells and floors (h_left, h_right, epoch, source, vote), in update
    mode. Needs the RocksDB state store."""
    out = "h_left string, h_right string, epoch bigint, sealed boolean, vote string"
    processor = RelationState(n_sources, threshold, only_changes)
    return rows.groupBy("h_left", "h_right").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Update", timeMode="None")


def cell_decisions(cells: DataFrame, n_sources: int, threshold: int) -> DataFrame:
    """Decisions of a stream of cells (h_left, h_right, epoch, source, vote) without floors, in update
    mode: a row for each relation that a batch brings cells of. Nothing is evicted, so the state is an
    aggregation, each relation's set of cells, and no task calls Python for a relation. Repeated cells
    are one. Unlike votes of one key, and a cell without epoch or source, are an error."""
    held = cells.groupBy(*PAIR).agg(F.sort_array(F.collect_set(F.struct("epoch", "source", "vote"))).alias("cells"))
    at = lambda i: F.get("cells", i)
    # sorted, so the cells of an epoch are a run, which is as long as its sources are many
    whole = F.filter("cells", lambda x, i: (at(i + n_sources - 1)["epoch"] == x["epoch"]) & ~at(i - 1)["epoch"].eqNullSafe(x["epoch"]) & ~at(i + n_sources)["epoch"].eqNullSafe(x["epoch"]))
    clash = F.filter("cells", lambda x, i: x["epoch"].isNull() | x["source"].isNull() | ((at(i + 1)["epoch"] == x["epoch"]) & (at(i + 1)["source"] == x["source"])))
    held = held.withColumns({"whole": whole, "clash": clash})
    held = held.select(*PAIR, "cells", "clash", F.coalesce(F.array_max("whole.epoch"), F.array_max("cells.epoch")).alias("epoch"), (F.size("whole") > 0).alias("sealed"))
    own = F.transform(F.filter("cells", lambda x: x["epoch"] == F.col("epoch")), lambda x: x["vote"])
    n = lambda vote: F.size(F.filter("own", lambda x: x == vote))
    named = F.concat_ws(", ", *PAIR, F.get("clash", F.lit(0))["epoch"], F.get("clash", F.lit(0))["source"])
    vote = F.when(F.size("clash") > 0, F.raise_error(F.concat(F.lit("equivocation, or no epoch or source: "), named)))
    vote = vote.when(~F.col("sealed"), UNKNOWN).when(n(DIFFERENT) > 0, DIFFERENT).when(n(SAME) >= threshold, SAME).otherwise(UNKNOWN)
    return held.select(*PAIR, "epoch", "sealed", "clash", own.alias("own")).select(*PAIR, "epoch", "sealed", vote.alias("vote"))


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_updates(updates: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream of update rows into a foreachBatch sink for all there is. The state store is set for
    this run only."""
    conf = updates.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKS)
    try:
        updates.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(STORE, before)


def updates_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch's update rows as a table of its own: a batch run again replaces what
    it wrote before."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def folded_updates(spark: SparkSession, path: str) -> DataFrame:
    """The table that update rows add up to: each relation's row of the last batch, without relations
    that a floor has emptied."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = rows.groupBy("h_left", "h_right").agg(F.max_by(F.struct("epoch", "sealed", "vote"), "batch").alias("x"))
    return last.where("x.epoch is not null").select("h_left", "h_right", "x.*")


def floor_decisions(rows: DataFrame, n_sources: int, threshold: int, path: str | None = None) -> DataFrame:
    """Decisions of a stream of cells and floors, as a table. `path` holds updates and checkpoint: a run
    that was stopped goes on there."""
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_updates(stateful_decisions(rows, n_sources, threshold), updates_sink(f"{path}/updates"), f"{path}/checkpoint")
    return folded_updates(spark, f"{path}/updates")
