"""Evidence as JSON lines, one record a line, with a quarantine for broken ones.

A line is read as a variant, so nothing is coerced: its type is compared with the declared one of its
kind, field by field and without extra fields. Lines are independent, so a file is split over tasks and
a broken line costs itself alone; what breaks a rule that spans lines (a repeated key, an unregistered
source) is set aside with that rule. Written records are canonical: fields in order of name, lines in
order of kind and key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.schema import DIFFERENT, KEY, PAIR, SAME, UNKNOWN, Evidence
from quorumlake.session import staged

#: Fields of each kind of record beside `kind`, by name.
FIELDS = {
    "cell": {"epoch": "bigint", "left": "string", "reason": "string", "right": "string", "source": "string", "vote": "string"},
    "floor": {"epoch": "bigint", "left": "string", "right": "string"},
    "handle": {"handle": "string"},
    "registry": {"sources": "array<string>", "threshold": "bigint"},
}


@dataclass(frozen=True)
class Records:
    """What a reader found: cells, floors, handles, the registry's rows, and (line, rule) of the rest."""

    cells: DataFrame
    floors: DataFrame
    handles: DataFrame
    registry: DataFrame
    quarantine: DataFrame

    def evidence(self) -> Evidence:
        """The sound records as a store. Needs exactly one registry."""
        rows = self.registry.limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{len(rows) or 'no'} registry records, one is needed")
        return Evidence(self.cells, self.handles, tuple(sorted(rows[0]["sources"])), rows[0]["threshold"], self.floors)


def lines(store: Evidence) -> DataFrame:
    """(value): a store's canonical lines, in order. Null reasons are written as empty ones."""
    sides = F.col("h_left").alias("left"), F.col("h_right").alias("right")
    spark = store.cells.sparkSession
    floors = store.floors if store.floors is not None else spark.createDataFrame([], "h_left string, h_right string, epoch bigint")
    registry = spark.createDataFrame([(sorted(store.sources), store.threshold)], "sources array<string>, threshold bigint")
    parts = {
        "cell": store.cells.select("epoch", sides[0], F.coalesce("reason", F.lit("")).alias("reason"), sides[1], "source", "vote"),
        "floor": floors.select("epoch", *sides),
        "handle": store.handles.select("handle"),
        "registry": registry,
    }
    out = None
    for kind, df in parts.items():
        names = sorted([*df.columns, "kind"])
        made = df.select(F.lit(kind).alias("k"), F.struct(*[F.lit(kind).alias("kind") if n == "kind" else F.col(n) for n in names]).alias("r"))
        key = F.concat_ws("\x01", *[F.lpad(F.col(f"r.{c}").cast("string"), 19, "0") if c == "epoch" else F.col(f"r.{c}").cast("string") for c in ("left", "right", "epoch", "source", "handle") if c in df.columns])
        one = made.select("k", key.alias("key"), F.to_json("r").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("k", "key", "value").select("value")


def write(store: Evidence, path: str, compression: str = "none") -> None:
    """Canonical JSON lines below path. Uncompressed files can be split; gzip ones are a task each."""
    lines(store).write.mode("overwrite").option("compression", compression).text(path)


def _declared(kind: str) -> str:
    """How Spark names the type of a sound record's variant."""
    names = {"bigint": "BIGINT", "string": "STRING", "array<string>": "ARRAY<STRING>"}
    return "OBJECT<" + ", ".join(f"{n}: {names[t]}" for n, t in sorted([*FIELDS[kind].items(), ("kind", "string")])) + ">"


def _rule() -> Column:
    """The first rule that a line breaks by itself, null if it breaks none."""
    v, kind = F.col("v"), F.col("kind")
    number = lambda name: F.try_variant_get(v, f"$.{name}", "bigint")
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    declared = F.create_map(*[F.lit(x) for k in FIELDS for x in (k, _declared(k))])
    pair = kind.isin("cell", "floor")
    return (
        F.when(v.isNull(), "not JSON")
        .when(kind.isNull() | ~kind.isin(*FIELDS), "unknown kind")
        .when(F.schema_of_variant(v) != F.element_at(declared, kind), "fields or types")
        .when(pair & ((text("left") == "") | (text("right") == "") | (text("left") >= text("right"))), "handles must be non-empty and in order")
        .when(pair & (number("epoch") < 0), "epoch must not be negative")
        .when((kind == "cell") & ~text("vote").isin(SAME, DIFFERENT, UNKNOWN), "vote must be same, different or unknown")
        .when((kind == "handle") & (text("handle") == ""), "handles must be non-empty and in order")
        .when((kind == "registry") & ~((number("threshold") >= 1) & (number("threshold") <= F.size(F.try_variant_get(v, "$.sources", "array<string>")))), "threshold out of range")
    )


def read(spark: SparkSession, path: str) -> Records:
    """The records below path. Empty lines are not JSON. Of lines that repeat a record whole, one is
    kept and the others are no error, as in any ingest; cells of one key with unlike votes or reasons
    are all set aside, as are cells whose source the registry doesn't name (or no registry does)."""
    raw = spark.read.text(path).withColumn("v", F.try_parse_json("value"))
    kind = F.when(F.schema_of_variant(F.try_variant_get("v", "$.kind", "variant")) == "STRING", F.try_variant_get("v", "$.kind", "string"))
    told = staged(raw.withColumn("kind", kind).withColumn("rule", _rule()).select(F.col("value").alias("line"), "kind", "rule"), "records")
    sound = told.where("rule is null")

    def of(name: str) -> DataFrame:
        typed = F.from_json("line", ", ".join(f"{n} {t}" for n, t in FIELDS[name].items())).alias("r")
        return sound.where(F.col("kind") == name).select("line", typed).select("line", "r.*")

    registry = of("registry").drop("line").distinct()
    cells = of("cell").select("line", F.col("left").alias("h_left"), F.col("right").alias("h_right"), "epoch", "source", "vote", "reason")
    known = registry.select(F.explode("sources").alias("source")).distinct().withColumn("known", F.lit(True))
    unlike = cells.groupBy(*KEY).agg(F.count_distinct(F.struct("vote", "reason")).alias("n")).where("n > 1").select(*KEY, F.lit(True).alias("unlike"))
    ruled = cells.join(known, "source", "left").join(unlike, KEY, "left")
    ruled = staged(ruled.withColumn("rule", F.when(F.col("known").isNull(), "source must be registered").when(F.col("unlike"), "equivocation")), "cells")
    floors = of("floor").select(F.col("left").alias("h_left"), F.col("right").alias("h_right"), "epoch")
    return Records(
        ruled.where("rule is null").select(*KEY, "vote", "reason").distinct(),
        floors.groupBy(PAIR).agg(F.max("epoch").alias("epoch")),
        of("handle").select("handle").distinct(),
        registry,
        told.where("rule is not null").select("line", "rule").unionByName(ruled.where("rule is not null").select("line", "rule")),
    )
