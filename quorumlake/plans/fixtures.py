"""Evidence derived from the star schema by integer arithmetic, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.schema import PAIR, Evidence

SOURCES, THRESHOLD = ("v0", "v1", "v2", "v3", "v4"), 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def handle(key: str) -> F.Column:
    return F.concat(F.lit("c"), F.lpad(F.col(key).cast("string"), 7, "0"))


def neighbours(spark: SparkSession, sf_dir: str, distances: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(l, r, d): customers of a nation and segment whose places differ by d."""
    place = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    ahead = [F.lead("c_custkey", d).over(place).alias(f"r{d}") for d in distances]
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l"), *ahead)
    rows = rows.select("l", F.explode(F.array(*[F.struct(F.col(f"r{d}").alias("r"), F.lit(d).alias("d")) for d in distances])).alias("x"))
    return rows.select("l", "x.r", "x.d").where("r is not null")


VOTE = """case when k < 55 then if(s < 2, 'same', 'unknown')
  when k < 70 then case when s < 2 then 'same' when s = 2 then 'different' else 'unknown' end
  else if(s = 0, 'same', 'unknown') end"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells, with the keys l and r and the source number s."""
    slots = F.explode(F.expr("sequence(0, 9)")).alias("slot")
    rows = neighbours(spark, sf_dir).select("l", "r", slots).selectExpr("l", "r", "cast(slot div 5 as bigint) as epoch", "slot % 5 as s")
    rows = rows.selectExpr("*", "(l * 31 + r * 17 + epoch * 13) % 100 as k", "(l + 3 * r + 5 * epoch + 11 * s) % 23 as g")
    rows = rows.where("not (epoch = 1 and g = 0) and not (s = 3 and (l + r) % 17 = 0)").withColumn("vote", F.expr(VOTE))
    named = rows.withColumn("h_left", handle("l")).withColumn("h_right", handle("r")).withColumn("source", F.expr("concat('v', s)"))
    return named.withColumn("reason", F.concat(F.lit("derived "), "vote")).select(*PAIR, "epoch", "source", "vote", "reason", "l", "r", "s")


def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(handle("c_custkey").alias("handle"))


def store(spark: SparkSession, sf_dir: str) -> Evidence:
    return Evidence(cells(spark, sf_dir).drop("l", "r", "s"), handles(spark, sf_dir), SOURCES, THRESHOLD)


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three partial copies of the cells, with replica; their union is all cells."""
    every = cells(spark, sf_dir).withColumn("replica", F.explode(F.expr("sequence(0, 2)")))
    lost = "(epoch = 1 and (l + r + replica) % 4 = 0 and s = replica) or (epoch = 0 and (l + replica) % 5 = 0 and s = replica + 1)"
    return every.where(f"not ({lost})").drop("l", "r", "s")


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_left, q_right): all observed relations and, never observed, neighbours three apart."""
    return neighbours(spark, sf_dir, (1, 2, 3)).select(handle("l").alias("q_left"), handle("r").alias("q_right"))


def weighted(spark: SparkSession, sf_dir: str, decided: DataFrame) -> DataFrame:
    """Signed edges of the decisions, with many equal weights."""
    number = lambda c: F.substring(c, 2, 7).cast("bigint")
    weight = ((number("h_left") * 7 + number("h_right") * 3) % 5).cast("double")
    return decided.where("vote <> 'unknown'").select(*PAIR, "vote", weight.alias("weight"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two observations of each nation, in one wide row a case."""
    n = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as k", "n_name", "cast(n_regionkey as bigint) as t")
    return n.selectExpr(
        "concat('case', lpad(k, 3, '0')) as case_id", "concat('target', t) as target_id",
        "concat('E', k % 4, '; e', k % 7, ';;', if(k % 5 = 0, '', concat(' x', t))) as probe_endpoints",
        "concat('e', (k + 1) % 4, ';E', k % 9) as control_endpoints",
        "if(k % 6 = 0, 'false', 'TRUE') as probe_tcp_success", "if(k % 11 = 0, '0', 'yes') as control_tcp_success",
        "cast(case k % 5 when 0 then 200 when 1 then 301 when 2 then 404 when 3 then 0 else 503 end as string) as probe_status",
        "if(k % 4 = 3, '', cast(200 + 100 * (k % 3) as string)) as control_status",
        "concat('h', k % 3, ';h', k % 5, ';Server') as probe_headers", "concat('H', k % 2, ';server;h', k % 6) as control_headers",
        "if(k % 8 = 0, '', concat('title ', t)) as probe_title", "concat('title ', k % 3) as control_title",
    )


F1 = """c AS (SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS rn, c_nationkey AS n, c_mktsegment AS m FROM customer),
near AS (SELECT a.k AS l, b.k AS r, b.rn - a.rn AS d FROM c a JOIN c b ON a.n = b.n AND a.m = b.m AND b.rn - a.rn IN (1, 2, 3)),
slots AS (SELECT l, r, CAST(e AS BIGINT) AS epoch, s, (l * 31 + r * 17 + e * 13) % 100 AS k, (l + 3 * r + 5 * e + 11 * s) % 23 AS g
  FROM near, range(2) t(e), range(5) u(s) WHERE d <= 2),
cells AS (SELECT 'c' || lpad(CAST(l AS VARCHAR), 7, '0') AS h_left, 'c' || lpad(CAST(r AS VARCHAR), 7, '0') AS h_right, epoch, 'v' || s AS source,
  CASE WHEN k < 55 THEN CASE WHEN s < 2 THEN 'same' ELSE 'unknown' END
       WHEN k < 70 THEN CASE WHEN s < 2 THEN 'same' WHEN s = 2 THEN 'different' ELSE 'unknown' END
       ELSE CASE WHEN s = 0 THEN 'same' ELSE 'unknown' END END AS vote, l, r, s
  FROM slots WHERE NOT (epoch = 1 AND g = 0) AND NOT (s = 3 AND (l + r) % 17 = 0)),
handles AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS handle FROM customer)"""

EPOCHS = """epochs AS (SELECT h_left, h_right, epoch, count(*) FILTER (vote = 'same') AS same_count, count(*) FILTER (vote = 'different') AS different_count,
  count(DISTINCT source) AS n_sources, count(DISTINCT source) = 5 AS sealed FROM cells GROUP BY ALL)"""

DECISIONS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY h_left, h_right ORDER BY sealed DESC, epoch DESC) AS place FROM epochs),
decisions AS (SELECT h_left, h_right, epoch, sealed, same_count, different_count,
  CASE WHEN NOT sealed THEN 'unknown' WHEN different_count > 0 THEN 'different' WHEN same_count >= 2 THEN 'same' ELSE 'unknown' END AS vote
  FROM ranked WHERE place = 1)"""

COMPONENTS = """reach(node, root) AS (SELECT handle, handle FROM handles UNION
  SELECT CASE WHEN e.h_left = reach.node THEN e.h_right ELSE e.h_left END, root FROM reach JOIN same_edges e ON reach.node IN (e.h_left, e.h_right)),
cc AS (SELECT node AS handle, min(root) AS cc FROM reach GROUP BY node)"""

PARTITION = """same_edges AS (SELECT h_left, h_right FROM decisions WHERE vote = 'same'),
""" + COMPONENTS + """,
edges AS (SELECT cc, h_left AS a, h_right AS b, row_number() OVER (PARTITION BY cc ORDER BY h_left, h_right) AS k FROM same_edges JOIN cc ON h_left = handle),
vetoes AS (SELECT x.cc, list({'a': h_left, 'b': h_right}) AS v FROM decisions JOIN cc x ON h_left = x.handle JOIN cc y ON h_right = y.handle AND x.cc = y.cc
  WHERE vote = 'different' GROUP BY x.cc),
fold(cc, k, lab) AS (SELECT cc, 0::BIGINT, map_from_entries(list({'k': handle, 'v': handle})) FROM cc GROUP BY cc UNION ALL
  SELECT f.cc, e.k, CASE WHEN f.lab[e.a] = f.lab[e.b] OR len(list_filter(coalesce(v.v, []), lambda x: least(f.lab[x.a], f.lab[x.b]) = least(f.lab[e.a], f.lab[e.b]) AND greatest(f.lab[x.a], f.lab[x.b]) = greatest(f.lab[e.a], f.lab[e.b]))) > 0
    THEN f.lab ELSE map_from_entries(list_transform(map_entries(f.lab), lambda x: {'k': x.key, 'v': CASE WHEN x.value = greatest(f.lab[e.a], f.lab[e.b]) THEN least(f.lab[e.a], f.lab[e.b]) ELSE x.value END})) END
  FROM fold f JOIN edges e ON e.cc = f.cc AND e.k = f.k + 1 LEFT JOIN vetoes v ON v.cc = f.cc),
folded AS (SELECT cc, max_by(lab, k) AS lab FROM fold GROUP BY cc),
membership AS (SELECT x.key AS handle, x.value AS label FROM (SELECT unnest(map_entries(lab)) AS x FROM folded))"""

ENDED = "ended AS (SELECT d.*, x.label AS l_label, y.label AS r_label FROM decisions d JOIN membership x ON h_left = x.handle JOIN membership y ON h_right = y.handle)"

REPLICAS = """replicas AS (SELECT c.*, i AS replica FROM cells c, range(3) t(i)
  WHERE NOT ((epoch = 1 AND (l + r + i) % 4 = 0 AND s = i) OR (epoch = 0 AND (l + i) % 5 = 0 AND s = i + 1)))"""


def sql(select: str, *parts: str, prefix: str = F1) -> str:
    return f"WITH RECURSIVE {', '.join([prefix, *parts])}\n{select}"


def with_decisions(select: str, *parts: str) -> str:
    return sql(select, EPOCHS, DECISIONS, *parts)


def with_partition(select: str, *parts: str) -> str:
    return with_decisions(select, PARTITION, *parts)
