"""JSON states, CSV observations and navigation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.scalars import authority_handle, parse_bool, parse_status, split_set
from quorumlake.operators.ingest import domain_violations, equivocations
from quorumlake.schema import KEY, PAIR, UNKNOWN, Evidence

STATE = """node_id string, sources array<string>, threshold bigint, handles array<string>,
 stable_floors array<struct<left:string,right:string,epoch:bigint>>,
 cells array<struct<left:string,right:string,epoch:bigint,source:string,vote:string,reason:string>>"""

OBSERVATION = """case_id string, target_id string, probe_cc string, probe_asn string, probe_endpoints string, control_endpoints string,
 probe_tcp_success string, control_tcp_success string, probe_status string, control_status string, probe_headers string, control_headers string,
 probe_title string, control_title string, probe_failure string, control_failure string"""


def write_state(store: Evidence, path: str, node_id: str = "node") -> None:
    """Write a store as tables below path: cells and floors as Parquet, handles and the registry as
    JSON lines. No row of it passes through one task."""
    spark = store.cells.sparkSession
    store.cells.select(*KEY, "vote", "reason").write.mode("overwrite").parquet(f"{path}/cells")
    store.handles.select("handle").write.mode("overwrite").json(f"{path}/handles")
    floors = store.floors if store.floors is not None else spark.createDataFrame([], "h_left string, h_right string, epoch bigint")
    floors.select(*PAIR, "epoch").write.mode("overwrite").parquet(f"{path}/floors")
    spark.createDataFrame([(node_id, list(store.sources), store.threshold)], "node_id string, sources array<string>, threshold bigint").write.mode("overwrite").json(f"{path}/registry")


def read_tables(spark: SparkSession, path: str) -> Evidence:
    registry = spark.read.schema("node_id string, sources array<string>, threshold bigint").json(f"{path}/registry").first()
    handles = spark.read.schema("handle string").json(f"{path}/handles")
    return Evidence(spark.read.parquet(f"{path}/cells"), handles, tuple(sorted(registry["sources"])), registry["threshold"], spark.read.parquet(f"{path}/floors"))


def type_violations(spark: SparkSession, path: str) -> DataFrame:
    """(path, rule) of values whose JSON type is not the declared one: epochs and thresholds that
    are true, text or fractions would be coerced by a typed read."""
    raw = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    kind = lambda v, p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    top = raw.select(F.explode(F.array(F.struct(F.lit("$.threshold").alias("path"), kind("v", "$.threshold").alias("kind")))).alias("x")).select("x.*")
    items = lambda name: raw.select(F.explode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("c"))
    epochs = items("cells").unionByName(items("stable_floors")).select(F.lit("epoch").alias("path"), kind("c", "$.epoch").alias("kind"))
    return top.unionByName(epochs).where("kind is null or kind <> 'BIGINT'").select("path", F.concat(F.lit("not an integer: "), F.coalesce("kind", F.lit("missing"))).alias("rule"))


def read_state(spark: SparkSession, path: str) -> Evidence:
    """One JSON document as a store, checked and never coerced; raises on the first broken rules."""
    if bad := type_violations(spark, path).limit(5).collect():
        raise ValueError("; ".join(f"{r.path} {r.rule}" for r in bad))
    doc = spark.read.schema(STATE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = doc.select("node_id", "sources", "threshold").first()
    rows = doc.select(F.explode("cells").alias("c")).select("c.*")
    cells = rows.select(F.col("left").alias("h_left"), F.col("right").alias("h_right"), "epoch", "source", "vote", F.coalesce("reason", F.lit("")).alias("reason"))
    handles = doc.select(F.explode("handles").alias("handle"))
    floors = doc.select(F.explode("stable_floors").alias("f")).select(F.col("f.left").alias("h_left"), F.col("f.right").alias("h_right"), "f.epoch")
    store = Evidence(cells, handles, tuple(sorted(head["sources"] or ())), head["threshold"], floors)
    if bad := state_violations(store).limit(5).collect():
        raise ValueError("; ".join(f"{r.rule}: {r.subject}" for r in bad))
    return store


def state_violations(store: Evidence) -> DataFrame:
    """(rule, subject) of a whole state: cell domains, repeated keys and handles, unregistered
    handles, and floors that are negative or whose epoch is not sealed and kept."""
    text = F.concat_ws(" ", *KEY).alias("subject")
    out = domain_violations(store.cells, store.sources).select("rule", text)
    out = out.unionByName(store.cells.groupBy(KEY).count().where("count > 1").select(F.lit("repeated key").alias("rule"), text))
    out = out.unionByName(equivocations(store.cells).select(F.lit("equivocation").alias("rule"), text))
    out = out.unionByName(store.handles.groupBy("handle").count().where("count > 1 or coalesce(handle, '') = ''").select(F.lit("handles must be unique and non-empty").alias("rule"), F.col("handle").alias("subject")))
    named = store.cells.select(F.explode(F.array(*PAIR)).alias("handle")).distinct()
    out = out.unionByName(named.join(store.handles, "handle", "left_anti").select(F.lit("unregistered handle").alias("rule"), F.col("handle").alias("subject")))
    if store.floors is None:
        return out
    slots = store.cells.groupBy(*PAIR, "epoch").agg(F.count_distinct("source").alias("n")).where(F.col("n") == len(store.sources))
    pair = F.concat_ws(" ", *PAIR).alias("subject")
    out = out.unionByName(store.floors.where("epoch < 0").select(F.lit("negative floor").alias("rule"), pair))
    out = out.unionByName(store.floors.groupBy(PAIR).count().where("count > 1").select(F.lit("repeated floor").alias("rule"), pair))
    out = out.unionByName(store.floors.join(slots, [*PAIR, "epoch"], "left_anti").select(F.lit("floor epoch not sealed").alias("rule"), pair))
    below = store.cells.join(store.floors.withColumnRenamed("epoch", "floor"), PAIR).where("epoch < floor")
    return out.unionByName(below.select(F.lit("cell below its floor").alias("rule"), text))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of cases, unpivoted; a missing column is an error."""
    raw = spark.read.option("header", True).csv(path)
    needed = [c.split()[0] for c in OBSERVATION.split(",")]
    if missing := [c for c in needed if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return unpivot(raw)


def unpivot(wide: DataFrame) -> DataFrame:
    """Two observations a case, of the vantages probe and control."""
    parts = ("endpoints", "tcp_success", "status", "headers", "title")
    stacked = ", ".join("'{v}', {c}".format(v=v, c=", ".join(f"{v}_{p}" for p in parts)) for v in ("probe", "control"))
    rows = wide.selectExpr("case_id", "target_id", f"stack(2, {stacked}) as (vantage, {', '.join(parts)})")
    return rows.select(
        "case_id", "target_id", "vantage",
        F.array_sort(split_set(F.col("endpoints"))).alias("endpoints"),
        parse_bool(F.col("tcp_success")).alias("tcp_success"),
        parse_status(F.col("status")).alias("status"),
        F.array_sort(split_set(F.col("headers"))).alias("headers"),
        F.coalesce(F.trim("title"), F.lit("")).alias("title"),
    )


def navigation_evidence(rows: DataFrame, sources: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(handles, cells) of rows(request_url, status, redirect_url): a redirect between authorities is
    a candidate relation, all of whose votes are UNKNOWN."""
    left, right = authority_handle(F.col("request_url")), authority_handle(F.col("redirect_url"))
    ends = rows.select(left.alias("a"), right.alias("b"), F.col("status").cast("int").alias("status"))
    handles = ends.select(F.explode(F.array_compact(F.array("a", "b"))).alias("handle")).distinct()
    pairs = ends.where("a <> b and status between 300 and 399").select(F.least("a", "b").alias("h_left"), F.greatest("a", "b").alias("h_right")).distinct()
    slots = F.posexplode(F.array(*[F.lit(s) for s in sources])).alias("i", "source")
    reason = F.when(F.col("i") == 0, "redirect candidate").otherwise("closing slot")
    cells = pairs.select(*PAIR, slots).select(*PAIR, F.lit(0).cast("bigint").alias("epoch"), "source", F.lit(UNKNOWN).alias("vote"), reason.alias("reason"))
    return handles, cells
