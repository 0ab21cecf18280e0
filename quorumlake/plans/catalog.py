"""Queries of the evidence engine and their DuckDB equivalents, by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import scalars
from quorumlake.operators import agreement, baselines, certificates, checker, decisions, digests, evaluation, ingest, partition, replication, reports
from quorumlake.plans import fixtures as fx
from quorumlake.plans.fixtures import ENDED, EPOCHS, REPLICAS, sql, with_decisions, with_partition
from quorumlake.schema import PAIR, SAME, UNKNOWN, Evidence
from quorumlake.sources import generators, records, state
from quorumlake.session import shared_dir, staged
from quorumlake.streaming import ingest as stream
from quorumlake.streaming import live

N = len(fx.SOURCES)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _decided(spark, d) -> DataFrame:
    return decisions.decisions(fx.store(spark, d))


def _views(spark, d) -> tuple[Evidence, DataFrame, DataFrame]:
    store = fx.store(spark, d)
    decided = staged(decisions.decisions(store), "decisions")
    return store, decided, staged(partition.partition(store.handles, decided), "membership")


def _arrivals(cells: DataFrame) -> DataFrame:
    """Cells with a made-up order of arrival, no two alike."""
    n = lambda c: F.substring(c, 2, 7).cast("bigint")
    slot = F.col("epoch") * 5 + F.substring("source", 2, 1).cast("bigint")
    return cells.withColumn("step", ((n("h_left") * 13 + n("h_right") * 7 + slot * 37) % 1009) * 10 + slot)


ARRIVALS = "arrivals AS (SELECT *, ((l * 13 + r * 7 + (epoch * 5 + s) * 37) % 1009) * 10 + epoch * 5 + s AS step FROM cells)"


# Ingest -------------------------------------------------------------------------------------------


@query(sql("SELECT DISTINCT least(a, b) AS h_left, greatest(a, b) AS h_right FROM (SELECT CASE WHEN (l + r) % 2 = 0 THEN h_left ELSE h_right END AS a, CASE WHEN (l + r) % 2 = 0 THEN h_right ELSE h_left END AS b FROM cells)"))
def canonical_relation(spark, d):
    c = fx.cells(spark, d)
    even = (F.col("l") + F.col("r")) % 2 == 0
    return ingest.canonical(c.select(F.when(even, F.col("h_left")).otherwise(F.col("h_right")).alias("a"), F.when(even, F.col("h_right")).otherwise(F.col("h_left")).alias("b"))).distinct()


@query(sql("SELECT handle FROM handles UNION SELECT h_left FROM cells UNION SELECT h_right FROM cells"))
def handle_registry(spark, d):
    return fx.handles(spark, d).unionByName(ingest.handles_of(fx.cells(spark, d))).distinct()


@query(sql("SELECT h_left, h_right, epoch, source, count(DISTINCT vote || '/' || reason) AS bodies FROM (SELECT h_left, h_right, epoch, source, vote, 'derived ' || vote AS reason FROM cells UNION ALL SELECT h_left, h_right, epoch, source, vote, 'late copy' FROM cells WHERE (l * 3 + r) % 50 = 0 AND s = 1) GROUP BY ALL HAVING count(DISTINCT vote || '/' || reason) > 1"))
def equivocation(spark, d):
    c = fx.cells(spark, d)
    copies = c.where("(l * 3 + r) % 50 = 0 and s = 1").withColumn("reason", F.lit("late copy"))
    return ingest.equivocations(c.unionByName(copies))


@query(sql("SELECT h_left, h_right, epoch, source, 'source must be registered' AS rule FROM moved WHERE s = 4 UNION ALL SELECT h_left, h_right, epoch, source, 'epoch must not be negative' FROM moved WHERE epoch < 0", "moved AS (SELECT h_left, h_right, source, s, CASE WHEN epoch = 0 THEN -1 ELSE epoch END AS epoch FROM cells)"))
def domain_violations(spark, d):
    c = fx.cells(spark, d)
    return ingest.domain_violations(c.withColumn("epoch", F.when(F.col("epoch") == 0, -1).otherwise(F.col("epoch")).cast("bigint")), fx.SOURCES[:4])


# Decisions ----------------------------------------------------------------------------------------


@query(sql("SELECT h_left, h_right, epoch, n_sources, sealed FROM epochs", EPOCHS))
def sealed_epochs(spark, d):
    return decisions.epochs(fx.cells(spark, d), N).select(*PAIR, "epoch", "n_sources", "sealed")


@query(sql("SELECT h_left, h_right, max(epoch) FILTER (sealed) AS epoch FROM epochs GROUP BY ALL", EPOCHS))
def highest_sealed_epoch(spark, d):
    return decisions.highest_sealed(fx.cells(spark, d), N)


@query(sql("SELECT h_left, h_right, epoch FROM epochs WHERE sealed ORDER BY ALL", EPOCHS))
def sealed_report(spark, d):
    return decisions.epochs(fx.cells(spark, d), N).where("sealed").select(*PAIR, "epoch").orderBy(*PAIR, "epoch")


@query(with_decisions("SELECT * FROM decisions"))
def decisions_of_relations(spark, d):
    return _decided(spark, d)


QUERIES["decisions"], ORACLES["decisions"] = QUERIES.pop("decisions_of_relations"), ORACLES.pop("decisions_of_relations")

SLOTS = """slots2 AS (SELECT d.h_left, d.h_right, d.epoch, d.vote,
  coalesce(string_agg(c.source, ',' ORDER BY c.source) FILTER (c.vote = 'same'), '') AS same_sources,
  coalesce(string_agg(c.source, ',' ORDER BY c.source) FILTER (c.vote = 'different'), '') AS different_sources,
  coalesce(string_agg(c.source, ',' ORDER BY c.source) FILTER (c.vote = 'unknown'), '') AS unknown_sources,
  array_to_string(list_filter(['v0', 'v1', 'v2', 'v3', 'v4'], lambda x: NOT list_contains(list(c.source), x)), ',') AS missing_sources,
  5 - count(*) AS missing, count(*) FILTER (c.vote = 'different') AS diff, count(*) FILTER (c.vote = 'same') AS same
  FROM decisions d JOIN cells c USING (h_left, h_right, epoch) GROUP BY d.h_left, d.h_right, d.epoch, d.vote)"""


@query(with_decisions("SELECT h_left, h_right, epoch, same_sources, different_sources, unknown_sources, missing_sources FROM slots2", SLOTS))
def source_slots(spark, d):
    s = decisions.source_slots(fx.store(spark, d), _decided(spark, d))
    return s.select(*PAIR, "epoch", *[F.array_join(f"{n}_sources", ",").alias(f"{n}_sources") for n in ("same", "different", "unknown", "missing")])


@query(with_decisions("SELECT h_left, h_right, missing + diff + greatest(0, 2 - same - missing - diff) AS gap FROM slots2 WHERE vote = 'unknown'", SLOTS))
def authorization_gap(spark, d):
    store = fx.store(spark, d)
    unknown = decisions.decisions(store).where(F.col("vote") == UNKNOWN)
    return decisions.authorization_gap(decisions.source_slots(store, unknown), store.threshold).select(*PAIR, F.col("gap").cast("bigint").alias("gap"))


@query(sql("SELECT vote, count(*) AS n FROM (SELECT CASE vote WHEN 'different' THEN 'unknown' ELSE vote END AS vote FROM cells) GROUP BY vote"))
def negative_mask(spark, d):
    return decisions.negative_mask(fx.cells(spark, d)).groupBy("vote").agg(F.count("*").alias("n"))


#: The cells with fewer positives: some relations have a negative and too few positives.
THIN = "thin AS (SELECT h_left, h_right, epoch, source, CASE WHEN vote = 'same' AND s = 1 AND (l + r) % 3 = 0 THEN 'unknown' ELSE vote END AS vote FROM cells)"


def _thin(spark, d) -> Evidence:
    thin = fx.cells(spark, d).withColumn("vote", F.expr("if(vote = 'same' and s = 1 and (l + r) % 3 = 0, 'unknown', vote)"))
    return Evidence(thin.drop("l", "r", "s"), fx.handles(spark, d), fx.SOURCES, fx.THRESHOLD)


@query(sql("SELECT h_left, h_right, CASE WHEN sealed AND same_count >= 2 THEN 'same' ELSE 'unknown' END AS vote FROM decisions", THIN, EPOCHS.replace("FROM cells", "FROM thin"), fx.DECISIONS))
def ablation_decisions(spark, d):
    return decisions.decisions(_thin(spark, d), relation_veto=False).select(*PAIR, "vote")


# Baselines ----------------------------------------------------------------------------------------


@query(sql("SELECT node AS handle, min(root) AS label FROM reach GROUP BY node", "same_edges AS (SELECT DISTINCT h_left, h_right FROM cells WHERE vote = 'same')", fx.COMPONENTS))
def union_find(spark, d):
    return baselines.union_find(fx.cells(spark, d), fx.handles(spark, d))


@query(sql("SELECT h_left, h_right, max_by(vote, step) AS vote FROM arrivals GROUP BY ALL", ARRIVALS))
def last_arrival(spark, d):
    return baselines.last_arrival(_arrivals(fx.cells(spark, d)))


@query(sql("SELECT h_left, h_right, max_by(vote, epoch * 100000 + step) AS vote FROM arrivals WHERE s = 1 GROUP BY ALL", ARRIVALS))
def local_only(spark, d):
    return baselines.local_only(_arrivals(fx.cells(spark, d)), "v1")


@query("SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS handle, min('c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')) OVER (PARTITION BY c_mktsegment || c_nationkey) AS label FROM customer")
def name_only(spark, d):
    c = fx.table(spark, d, "customer")
    return baselines.name_only(c.select(fx.handle("c_custkey").alias("handle"), F.concat("c_mktsegment", "c_nationkey").alias("token")))


@query("SELECT * FROM (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS h_left, lead('c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS h_right FROM customer) WHERE h_right IS NOT NULL")
def chain_edges(spark, d):
    c = fx.table(spark, d, "customer").select(fx.handle("c_custkey").alias("handle"), "c_nationkey", "c_custkey")
    return baselines.chain_edges(c, "c_nationkey", "c_custkey")


# Partitions ---------------------------------------------------------------------------------------


@query(with_partition("SELECT * FROM membership"))
def materialize(spark, d):
    return partition.materialize(fx.store(spark, d))


@query(with_partition("SELECT label, row_number() OVER (ORDER BY label) - 1 AS component FROM (SELECT DISTINCT label FROM membership)"))
def component_ids(spark, d):
    return partition.component_ids(_views(spark, d)[2])


@query(with_partition("SELECT label, count(*) AS n, sum(('0x' || substr(md5(handle), 1, 8))::BIGINT)::BIGINT AS low, sum(('0x' || substr(md5(handle), 9, 8))::BIGINT)::BIGINT AS high FROM membership GROUP BY label"))
def partition_signature(spark, d):
    return partition.signature(_views(spark, d)[2])


@query(with_partition("SELECT h_left, h_right, CASE WHEN vote <> 'same' THEN vote WHEN l_label = r_label THEN 'accepted' ELSE 'rejected' END AS status FROM ended", ENDED))
def edge_status(spark, d):
    _, decided, m = _views(spark, d)
    return partition.edge_status(decided, m).select(*PAIR, "status")


SEPARATORS = "separators AS (SELECT DISTINCT least(l_label, r_label) AS a, greatest(l_label, r_label) AS b FROM ended WHERE vote = 'different' AND l_label <> r_label)"


@query(with_partition("SELECT * FROM separators", ENDED, SEPARATORS))
def component_separators(spark, d):
    _, decided, m = _views(spark, d)
    return partition.separators(decided, m)


@query(with_partition("SELECT a, b, e.h_left, e.h_right, missing + diff + greatest(0, 2 - same - missing - diff) AS gap FROM (SELECT *, least(l_label, r_label) AS a, greatest(l_label, r_label) AS b FROM ended WHERE vote = 'unknown' AND l_label <> r_label) e JOIN slots2 USING (h_left, h_right) ANTI JOIN separators USING (a, b)", ENDED, SEPARATORS, SLOTS))
def quotient_edges(spark, d):
    v = certificates.Views(fx.store(spark, d))
    return partition.quotient_edges(v.gaps(), v.membership, v.separated).select("a", "b", *PAIR, F.col("gap").cast("bigint").alias("gap"))


@query(with_decisions("SELECT h_left, h_right FROM decisions JOIN cc x ON h_left = x.handle JOIN cc y ON h_right = y.handle WHERE vote = 'different' AND x.cc = y.cc", "same_edges AS (SELECT h_left, h_right FROM decisions WHERE vote = 'same')", fx.COMPONENTS))
def negative_violations(spark, d):
    store = fx.store(spark, d)
    decided = staged(decisions.decisions(store), "decisions")
    return partition.negative_violations(decided, partition.partition(store.handles, decided, component_veto=False))


#: Labels under each veto: without the relation veto there are no negatives, so the component veto is idle.
FACTORIAL = """same2 AS (SELECT h_left, h_right FROM decisions WHERE sealed AND same_count >= 2),
""" + fx.COMPONENTS.replace("reach", "reach2").replace("same_edges", "same2").replace("cc AS", "cc2 AS").replace("AS cc FROM", "AS cc FROM") + """,
labels AS (SELECT true AS relation_veto, true AS component_veto, handle, label FROM membership UNION ALL SELECT true, false, handle, cc FROM cc
  UNION ALL SELECT false, v, handle, cc FROM cc2, (VALUES (true), (false)) t(v))"""


@query(with_partition("""SELECT relation_veto, component_veto, count(DISTINCT x.label) AS components,
 (SELECT count(*) FROM decisions d JOIN labels y ON d.h_left = y.handle JOIN labels z ON d.h_right = z.handle WHERE d.vote = 'different' AND y.label = z.label
   AND y.relation_veto = x.relation_veto AND z.relation_veto = x.relation_veto AND y.component_veto = x.component_veto AND z.component_veto = x.component_veto) AS violations
 FROM labels x GROUP BY relation_veto, component_veto""", FACTORIAL))
def ablation_factorial(spark, d):
    """Components and violated negatives under each veto, on and off; cell counts hold for all."""
    store = fx.store(spark, d)
    truth = staged(decisions.decisions(store), "decisions")
    out = None
    for relation in (True, False):
        decided = truth if relation else staged(decisions.decisions(store, False), "decisions")
        for component in (True, False):
            m = staged(partition.partition(store.handles, decided, component), "membership")
            bad = partition.negative_violations(truth, m).agg(F.count("*").alias("violations"))
            row = m.agg(F.count_distinct("label").alias("components")).crossJoin(bad).select(F.lit(relation).alias("relation_veto"), F.lit(component).alias("component_veto"), "components", "violations")
            out = row if out is None else out.unionByName(row)
    return out


#: The watershed as a fold over each component's edges: labels, the pairs of labels kept apart, and
#: what became of each edge.
WATERSHED = """same_edges AS (SELECT h_left, h_right FROM decisions WHERE vote = 'same'),
""" + fx.COMPONENTS + """,
signed AS (SELECT h_left, h_right, vote, ((CAST(substr(h_left, 2) AS BIGINT) * 7 + CAST(substr(h_right, 2) AS BIGINT) * 3) % 5) AS weight FROM decisions WHERE vote <> 'unknown'),
inner_edges AS (SELECT x.cc, h_left AS a, h_right AS b, vote, row_number() OVER (PARTITION BY x.cc ORDER BY weight DESC, vote, h_left, h_right) AS k
  FROM signed JOIN cc x ON h_left = x.handle JOIN cc y ON h_right = y.handle AND x.cc = y.cc),
walk(cc, k, lab, mut, done) AS (SELECT cc, 0::BIGINT, map_from_entries(list({'k': handle, 'v': handle})), CAST([] AS STRUCT(x VARCHAR, y VARCHAR)[]), '' FROM cc GROUP BY cc UNION ALL
  SELECT cc, k,
    CASE WHEN fate = 'forest' THEN map_from_entries(list_transform(map_entries(lab), lambda e: {'k': e.key, 'v': CASE WHEN e.value = y THEN x ELSE e.value END})) ELSE lab END,
    CASE WHEN fate = 'active' THEN list_append(mut, {'x': x, 'y': y})
      WHEN fate = 'forest' THEN list_transform(mut, lambda m: {'x': CASE WHEN m.x = y THEN x ELSE m.x END, 'y': CASE WHEN m.y = y THEN x ELSE m.y END}) ELSE mut END, fate
  FROM (SELECT *, CASE WHEN vote = 'different' THEN CASE WHEN x = y THEN 'ignored' ELSE 'active' END WHEN x = y THEN 'redundant'
      WHEN len(list_filter(mut, lambda m: least(m.x, m.y) = x AND greatest(m.x, m.y) = y)) > 0 THEN 'rejected' ELSE 'forest' END AS fate
    FROM (SELECT f.cc, e.k, f.lab, f.mut, e.vote, least(f.lab[e.a], f.lab[e.b]) AS x, greatest(f.lab[e.a], f.lab[e.b]) AS y FROM walk f JOIN inner_edges e ON e.cc = f.cc AND e.k = f.k + 1))),
last_walk AS (SELECT cc, max_by(lab, k) AS lab FROM walk GROUP BY cc)"""


@query(with_decisions("SELECT x.key AS handle, x.value AS label FROM (SELECT unnest(map_entries(lab)) AS x FROM last_walk)", WATERSHED))
def mutex_watershed(spark, d):
    m, _ = partition.mutex_watershed(fx.handles(spark, d), staged(fx.weighted(spark, d, _decided(spark, d)), "weighted"))
    return m


@query(with_decisions("SELECT vote, status, count(*) AS n FROM (SELECT vote, done AS status FROM walk JOIN inner_edges USING (cc, k) UNION ALL SELECT vote, 'active' FROM signed JOIN cc x ON h_left = x.handle JOIN cc y ON h_right = y.handle AND x.cc <> y.cc) GROUP BY ALL", WATERSHED))
def mutex_edge_status(spark, d):
    _, status = partition.mutex_watershed(fx.handles(spark, d), staged(fx.weighted(spark, d, _decided(spark, d)), "weighted"))
    return status.groupBy("vote", "status").agg(F.count("*").alias("n"))


@query(with_partition("SELECT handle, label FROM membership"))
def priority_preserving_mws(spark, d):
    """The watershed with all negatives first is the negative-safe partition."""
    return partition.priority_preserving(fx.handles(spark, d), staged(_decided(spark, d), "decisions"))[0]


@query(with_partition("SELECT h_left, h_right, CASE WHEN vote <> 'same' THEN vote WHEN l_label = r_label THEN 'accepted' ELSE 'rejected' END AS status FROM ended", ENDED))
def priority_preserving_status(spark, d):
    return partition.priority_preserving(fx.handles(spark, d), staged(_decided(spark, d), "decisions"))[1]


# Certificates -------------------------------------------------------------------------------------

ASKED = """asked AS (SELECT 'c' || lpad(CAST(l AS VARCHAR), 7, '0') AS q_left, 'c' || lpad(CAST(r AS VARCHAR), 7, '0') AS q_right FROM near),
kinds AS (SELECT q_left, q_right, x.label AS l_label, y.label AS r_label, CASE WHEN x.label = y.label THEN 'same' WHEN s.a IS NOT NULL THEN 'different' ELSE 'ambiguous' END AS kind
  FROM asked JOIN membership x ON q_left = x.handle JOIN membership y ON q_right = y.handle LEFT JOIN separators s ON s.a = least(x.label, y.label) AND s.b = greatest(x.label, y.label))"""


@query(with_partition("SELECT q_left, q_right, kind FROM kinds", ENDED, SEPARATORS, ASKED))
def certificate_kind(spark, d):
    return certificates.classify(fx.queries_of(spark, d), certificates.Views(fx.store(spark, d))).select("q_left", "q_right", "kind")


def _asked(spark, d, kind: str):
    views = certificates.Views(fx.store(spark, d))
    return staged(certificates.classify(fx.queries_of(spark, d), views).where(F.col("kind") == kind), "asked"), views


#: Distances to each goal, then from the start the smallest neighbour that is one step nearer.
SAME_PATHS = """accepted AS (SELECT h_left AS node, h_right AS next FROM ended WHERE vote = 'same' AND l_label = r_label UNION ALL SELECT h_right, h_left FROM ended WHERE vote = 'same' AND l_label = r_label),
bfs(goal, node, d) AS (SELECT DISTINCT q_right, q_right, 0 FROM kinds WHERE kind = 'same' UNION SELECT goal, e.next, d + 1 FROM bfs JOIN accepted e ON e.node = bfs.node WHERE d < 24),
dist AS (SELECT goal, node, min(d) AS d FROM bfs GROUP BY ALL),
nearer AS (SELECT g.goal, g.node, min(e.next) AS next FROM dist g JOIN accepted e ON e.node = g.node JOIN dist h ON h.goal = g.goal AND h.node = e.next AND h.d = g.d - 1 GROUP BY ALL),
walk(q_left, q_right, node, path) AS (SELECT q_left, q_right, q_left, q_left FROM kinds WHERE kind = 'same' UNION ALL SELECT q_left, q_right, n.next, path || '>' || n.next FROM walk w JOIN nearer n ON n.goal = w.q_right AND n.node = w.node)"""


@query(with_partition("SELECT q_left, q_right, path FROM walk WHERE node = q_right", ENDED, SEPARATORS, ASKED, SAME_PATHS))
def cert_same(spark, d):
    asked, views = _asked(spark, d, SAME)
    return certificates.same_paths(asked, views).select("q_left", "q_right", F.array_join("path", ">").alias("path"))


@query(with_partition("""SELECT q_left, q_right, w.h_left AS w_left, w.h_right AS w_right, w.epoch, c.source FROM kinds k
 JOIN (SELECT least(l_label, r_label) AS a, greatest(l_label, r_label) AS b, h_left, h_right, epoch, row_number() OVER (PARTITION BY least(l_label, r_label), greatest(l_label, r_label) ORDER BY h_left, h_right) AS place FROM ended WHERE vote = 'different') w
   ON w.a = least(k.l_label, k.r_label) AND w.b = greatest(k.l_label, k.r_label) AND place = 1
 JOIN (SELECT h_left, h_right, epoch, min(source) AS source FROM cells WHERE vote = 'different' GROUP BY ALL) c ON c.h_left = w.h_left AND c.h_right = w.h_right AND c.epoch = w.epoch
 WHERE kind = 'different'""", ENDED, SEPARATORS, ASKED))
def cert_different(spark, d):
    asked, views = _asked(spark, d, "different")
    return certificates.witnesses(asked, views)


#: All simple paths of components, none of them separated, at a cost of five positions at most:
#: a relation that nobody has spoken of costs five and is a plan by itself.
PLANS = """gapped AS (SELECT least(l_label, r_label) AS a, greatest(l_label, r_label) AS b, e.h_left, e.h_right, missing + diff + greatest(0, 2 - same - missing - diff) AS gap FROM ended e JOIN slots2 s USING (h_left, h_right) WHERE e.vote = 'unknown' AND l_label <> r_label),
links AS (SELECT a, b, h_left, h_right, gap FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY gap, h_left, h_right) AS place FROM gapped ANTI JOIN separators USING (a, b)) WHERE place = 1),
arcs AS (SELECT a AS node, b AS next, gap, h_left || '-' || h_right AS pair FROM links UNION ALL SELECT b, a, gap, h_left || '-' || h_right FROM links),
apart AS (SELECT a AS x, b AS y FROM separators UNION ALL SELECT b, a FROM separators),
avoid AS (SELECT x, list(y) AS ys FROM apart GROUP BY x),
tries(q_left, q_right, node, goal, cost, pairs, path) AS (SELECT q_left, q_right, l_label, r_label, 0::BIGINT, []::VARCHAR[], [l_label] FROM kinds WHERE kind = 'ambiguous'
  UNION ALL SELECT q_left, q_right, e.next, goal, cost + e.gap, list_append(pairs, e.pair), list_append(path, e.next) FROM tries t JOIN arcs e ON e.node = t.node LEFT JOIN avoid v ON v.x = e.next
  WHERE t.node <> goal AND cost + e.gap <= 5 AND NOT list_contains(path, e.next) AND NOT list_has_any(path, coalesce(v.ys, []::VARCHAR[]))),
direct AS (SELECT k.q_left, k.q_right, 5::BIGINT AS cost, [least(k.q_left, k.q_right) || '-' || greatest(k.q_left, k.q_right)] AS pairs, [l_label, r_label] AS path FROM kinds k
  ANTI JOIN (SELECT h_left, h_right FROM decisions WHERE vote = 'unknown') u ON u.h_left = least(k.q_left, k.q_right) AND u.h_right = greatest(k.q_left, k.q_right) WHERE kind = 'ambiguous'),
plans AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_left, q_right ORDER BY cost, len(pairs), array_to_string(pairs, ','), array_to_string(path, ',')) AS place
  FROM (SELECT q_left, q_right, cost, pairs, path FROM tries WHERE node = goal UNION ALL SELECT * FROM direct)) WHERE place = 1)"""


@query(with_partition("SELECT q_left, q_right, cost::INT AS gap, len(pairs)::INT AS edge_count, array_to_string(path, '>') AS component_path, array_to_string(pairs, ',') AS pairs FROM plans", ENDED, SEPARATORS, ASKED, SLOTS, PLANS))
def cert_ambiguous(spark, d):
    asked, views = _asked(spark, d, "ambiguous")
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat_ws("-", p["h_left"], p["h_right"])), ",")
    return certificates.plans(asked, views).select("q_left", "q_right", "gap", "edge_count", F.array_join("component_path", ">").alias("component_path"), pairs.alias("pairs"))


@query(with_partition("SELECT q_left, q_right, kind, kind <> 'ambiguous' OR (least(ascii(right(q_left, 1)), ascii(right(q_right, 1))) - 48) % 3 <> 0 AS ok FROM kinds", ENDED, SEPARATORS, ASKED))
def certificate_check(spark, d):
    """What the independent checker says to every certificate; of the ambiguous ones a third is
    forged: the gap is one more than the plan costs."""
    store = fx.store(spark, d)
    made = certificates.certificates(fx.queries_of(spark, d), store)
    digit = F.least(*[F.substring(c, -1, 1).cast("int") for c in ("q_left", "q_right")])
    forged = F.when((F.col("kind") == "ambiguous") & (digit % 3 == 0), F.col("ambiguous").withField("gap", F.col("ambiguous.gap") + 1)).otherwise(F.col("ambiguous"))
    return checker.check(store, staged(made.withColumn("ambiguous", forged), "certificates")).select("q_left", "q_right", "kind", "ok")


@query(with_partition("SELECT handle, label FROM membership"))
def checker_partition(spark, d):
    """The partition as the checker rebuilds it."""
    store = fx.store(spark, d)
    return checker.rebuilt(store, staged(checker.recomputed(store), "recomputed"))


@query(with_partition("""SELECT q_left, q_right, 5 * count(*) AS n_cells, max(coalesce(top, -1) + 1) AS last_epoch, 'same' AS kind
 FROM (SELECT q_left, q_right, unnest(pairs) AS pair FROM plans) p LEFT JOIN (SELECT h_left || '-' || h_right AS pair, max(epoch) AS top FROM cells GROUP BY ALL) t USING (pair) GROUP BY ALL""", ENDED, SEPARATORS, ASKED, SLOTS, PLANS))
def plan_execution(spark, d):
    """Each plan carried out and its query asked again."""
    asked, views = _asked(spark, d, "ambiguous")
    return certificates.execute_plans(staged(certificates.plans(asked, views), "plans"), views)


# Replicas -----------------------------------------------------------------------------------------


def _replica(spark, d, i: int, floors=None) -> Evidence:
    r = fx.replicas(spark, d).where(F.col("replica") == i).drop("replica")
    return Evidence(r, ingest.handles_of(r), fx.SOURCES, fx.THRESHOLD, floors)


def _floors(spark, d, mod: int) -> DataFrame:
    sealed = decisions.epochs(fx.cells(spark, d), N).where("sealed").where(F.substring("h_left", 2, 7).cast("int") % mod == 0)
    return sealed.groupBy(PAIR).agg(F.max("epoch").alias("epoch"))


@query(sql("SELECT h_left, h_right, epoch, source, vote FROM (SELECT DISTINCT h_left, h_right, epoch, source, vote, l FROM replicas WHERE replica < 2) c LEFT JOIN (SELECT h_left, h_right, max(epoch) AS floor FROM epochs WHERE sealed AND (CAST(substr(h_left, 2) AS INT) % 3 = 0 OR CAST(substr(h_left, 2) AS INT) % 5 = 0) GROUP BY ALL) f USING (h_left, h_right) WHERE epoch >= coalesce(floor, -1)", EPOCHS, REPLICAS))
def state_join(spark, d):
    a, b = _replica(spark, d, 0, _floors(spark, d, 3)), _replica(spark, d, 1, _floors(spark, d, 5))
    return replication.state_join(a, b).cells.select(*PAIR, "epoch", "source", "vote")


@query(sql("SELECT h_left, h_right, epoch, source FROM replicas WHERE replica = 1 EXCEPT SELECT h_left, h_right, epoch, source FROM replicas WHERE replica = 0", REPLICAS))
def inventory_delta(spark, d):
    return replication.inventory_delta(_replica(spark, d, 0).cells, _replica(spark, d, 1).cells).select(*PAIR, "epoch", "source")


@query(sql("SELECT h_left, h_right, max(epoch) AS epoch FROM (SELECT h_left, h_right, epoch FROM (SELECT replica, h_left, h_right, epoch FROM replicas GROUP BY ALL HAVING count(DISTINCT source) = 5) GROUP BY ALL HAVING count(*) = 3) GROUP BY ALL", REPLICAS))
def common_floor(spark, d):
    return replication.common_floor(fx.replicas(spark, d), 3, N)


ACKS = """told AS (SELECT replica, h_left, h_right, epoch, source, vote, CASE WHEN replica = 2 AND CAST(substr(h_left, 2) AS INT) % 7 = 0 THEN 'other' ELSE 'derived ' || vote END AS reason FROM replicas),
proposed AS (SELECT h_left, h_right, max(epoch) AS epoch FROM (SELECT h_left, h_right, epoch FROM told WHERE replica = 0 GROUP BY ALL HAVING count(DISTINCT source) = 5) GROUP BY ALL),
vectors AS (SELECT replica, h_left, h_right, epoch, string_agg(source || vote || reason, ';' ORDER BY source) AS v FROM told JOIN proposed USING (h_left, h_right, epoch) GROUP BY ALL HAVING count(DISTINCT source) = 5)"""


@query(sql("SELECT p.h_left, p.h_right, p.epoch, count(v) = 3 AND count(DISTINCT v) = 1 AS agreed FROM proposed p LEFT JOIN vectors USING (h_left, h_right, epoch) GROUP BY ALL", REPLICAS, ACKS))
def acknowledged_floors(spark, d):
    told = fx.replicas(spark, d).withColumn("reason", F.expr("if(replica = 2 and cast(substring(h_left, 2) as int) % 7 = 0, 'other', reason)"))
    sealed = decisions.epochs(told.where("replica = 0"), N).where("sealed").groupBy(PAIR).agg(F.max("epoch").alias("epoch"))
    return replication.agreed_floors(replication.acknowledgements(told, staged(sealed, "floors"), N), 3)


@query(sql("SELECT replica, count(*) AS n, sum(strlen('{\"epoch\":' || epoch || ',\"left\":\"' || h_left || '\",\"reason\":\"derived ' || vote || '\",\"right\":\"' || h_right || '\",\"source\":\"' || source || '\",\"vote\":\"' || vote || '\"}'))::BIGINT AS payload_bytes FROM replicas GROUP BY replica", REPLICAS))
def payload_bytes(spark, d):
    return reports.payload_bytes(fx.replicas(spark, d), "replica").select(F.col("replica").cast("bigint").alias("replica"), "n", "payload_bytes")


@query(sql("SELECT h_left, h_right, epoch, source, vote FROM cells ORDER BY ALL"))
def canonical_cells(spark, d):
    return reports.canonical(fx.cells(spark, d)).select(*PAIR, "epoch", "source", "vote")


@query(sql("SELECT c.h_left, c.h_right, c.epoch, source FROM cells c LEFT JOIN (SELECT h_left, h_right, max(epoch) AS floor FROM epochs WHERE sealed AND CAST(substr(h_left, 2) AS INT) % 2 = 0 GROUP BY ALL) f USING (h_left, h_right) WHERE c.epoch >= coalesce(floor, -1)", EPOCHS))
def compaction(spark, d):
    return replication.compact(fx.store(spark, d), _floors(spark, d, 2)).cells.select(*PAIR, "epoch", "source")


@query(sql("SELECT h_left, h_right, 'epoch not sealed' AS rule FROM epochs WHERE epoch = 1 AND NOT sealed UNION ALL SELECT h_left, h_right, 'epoch not sealed' FROM (SELECT h_left, h_right FROM epochs EXCEPT SELECT h_left, h_right FROM epochs WHERE epoch = 1)", EPOCHS))
def compaction_violations(spark, d):
    store = fx.store(spark, d)
    return replication.compaction_violations(store, store.cells.select(*PAIR).distinct().withColumn("epoch", F.lit(1).cast("bigint")))


@query(sql("SELECT side, count(*) AS n FROM (SELECT 0 AS side, * FROM (SELECT h_left, h_right, epoch, source, vote FROM replicas WHERE replica = 0 EXCEPT SELECT h_left, h_right, epoch, source, vote FROM replicas WHERE replica = 2) UNION ALL SELECT 2, * FROM (SELECT h_left, h_right, epoch, source, vote FROM replicas WHERE replica = 2 EXCEPT SELECT h_left, h_right, epoch, source, vote FROM replicas WHERE replica = 0)) GROUP BY side", REPLICAS))
def replica_divergence(spark, d):
    return replication.divergence(fx.replicas(spark, d).drop("reason"), 0, 2).groupBy("side").agg(F.count("*").alias("n"))


# Records ------------------------------------------------------------------------------------------


def _records(spark, d) -> records.Records:
    """The customer evidence written as JSON lines, some of them spoilt on the way, and read again."""
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    store = fx.store(spark, d)
    records.write(Evidence(store.cells, store.handles, store.sources, store.threshold, _floors(spark, d, 3)), f"{path}/whole")
    k = F.regexp_extract("value", '"left":"c0*([0-9]+)"', 1).try_cast("int") % 40
    spoilt = F.when(k == 1, F.regexp_replace("value", '"epoch":([0-9]+)', '"epoch":"$1"')).when(k == 2, F.regexp_replace("value", '"vote":"same"', '"vote":"maybe"')).when(k == 3, F.regexp_replace("value", "}$", ""))
    spoilt = spoilt.when(k == 4, F.regexp_replace("value", '"source":"v4"', '"source":"v9"')).when(k == 5, F.regexp_replace("value", '"epoch":1', '"epoch":-1'))
    spark.read.text(f"{path}/whole").select(F.coalesce(spoilt, "value").alias("value")).write.text(f"{path}/spoilt")
    return records.read(spark, f"{path}/spoilt")


SPOILT = """spoilt AS (SELECT *, CASE WHEN l % 40 = 1 THEN 'fields or types' WHEN l % 40 = 2 AND vote = 'same' THEN 'vote must be same, different or unknown' WHEN l % 40 = 3 THEN 'not JSON'
  WHEN l % 40 = 4 AND source = 'v4' THEN 'source must be registered' WHEN l % 40 = 5 AND epoch = 1 THEN 'epoch must not be negative' END AS rule FROM cells),
floors AS (SELECT h_left, h_right, max(epoch) AS epoch FROM epochs WHERE sealed AND CAST(substr(h_left, 2) AS INT) % 3 = 0 GROUP BY ALL),
bad_floors AS (SELECT CASE n % 40 WHEN 1 THEN 'fields or types' WHEN 3 THEN 'not JSON' WHEN 5 THEN CASE WHEN epoch = 1 THEN 'epoch must not be negative' END END AS rule FROM (SELECT *, CAST(substr(h_left, 2) AS INT) AS n FROM floors))"""


@query(sql("SELECT h_left, h_right, epoch, source, vote, 'derived ' || vote AS reason FROM spoilt WHERE rule IS NULL", EPOCHS, SPOILT))
def records_cells(spark, d):
    return _records(spark, d).cells


@query(sql("SELECT rule, count(*) AS n FROM (SELECT rule FROM spoilt UNION ALL SELECT rule FROM bad_floors) WHERE rule IS NOT NULL GROUP BY rule", EPOCHS, SPOILT))
def records_quarantine(spark, d):
    return _records(spark, d).quarantine.groupBy("rule").agg(F.count("*").alias("n"))


# Digests, versions and floor rounds ---------------------------------------------------------------


def _hash(*columns: str) -> str:
    """SQL of a hash over columns with their lengths."""
    return "md5(" + " || ".join(f"length(CAST({c} AS VARCHAR)) || ':' || {c}" for c in columns) + ")"


_WORD = "sum(('0x' || substr({}, {}, 8))::BIGINT)::BIGINT"
CELL_HASH = _hash("h_left", "h_right", "epoch", "source", "vote", "reason")
HASHED = f"""hashed AS (SELECT side, substr({_hash('h_left', 'h_right', 'epoch', 'source')}, 1, 3) AS leaf, {CELL_HASH} AS h FROM sided),
tree AS (SELECT side, lv AS level, substr(leaf, 1, lv) AS node, count(*) AS n, {_WORD.format('h', 1)} AS low, {_WORD.format('h', 9)} AS high FROM hashed, range(4) t(lv) GROUP BY ALL),
nodes AS (SELECT coalesce(a.level, b.level) AS level, coalesce(a.node, b.node) AS node, coalesce(a.n, 0) AS n_own, coalesce(b.n, 0) AS n_other, (a.n, a.low, a.high) IS DISTINCT FROM (b.n, b.low, b.high) AS unlike
  FROM (FROM tree WHERE side = 0) a FULL JOIN (FROM tree WHERE side = 1) b ON a.level = b.level AND a.node = b.node)"""


def _some_lost(spark, d) -> tuple[DataFrame, DataFrame]:
    """The cells, once without a few and once without a few others."""
    c = fx.cells(spark, d)
    return c.where("not (l % 50 = 0 and s = 0)").drop("l", "r", "s"), c.where("not (l % 70 = 1 and s = 1)").drop("l", "r", "s")


@query(sql("SELECT n.level::INTEGER AS level, n.node, n.n_own, n.n_other, n.unlike FROM nodes n LEFT JOIN nodes up ON up.level = n.level - 1 AND up.node = substr(n.node, 1, n.level - 1) WHERE n.level = 0 OR up.unlike",
    "sided AS (SELECT 0 AS side, *, 'derived ' || vote AS reason FROM cells WHERE NOT (l % 50 = 0 AND s = 0) UNION ALL SELECT 1, *, 'derived ' || vote FROM cells WHERE NOT (l % 70 = 1 AND s = 1))", HASHED))
def digest_descent(spark, d):
    """What two replicas look at to find where they differ; n_own and n_other of unlike leaves are the
    rows that are read then."""
    own, other = _some_lost(spark, d)
    return digests.descend(staged(digests.tree(own), "tree"), staged(digests.tree(other), "tree"))


@query(sql("SELECT h_left, h_right, epoch, source, vote FROM cells WHERE l % 50 = 0 AND s = 0 AND NOT (l % 70 = 1 AND s = 1)"))
def digest_delta(spark, d):
    own, other = _some_lost(spark, d)
    return digests.digest_delta(digests.ranged(own), digests.ranged(other), spark)[0].select(*PAIR, "epoch", "source", "vote")


@query(sql("SELECT h_left, h_right, epoch, source FROM replicas WHERE replica = 1 EXCEPT SELECT h_left, h_right, epoch, source FROM replicas WHERE replica = 0", REPLICAS))
def digest_delta_of_replicas(spark, d):
    own, other = (digests.ranged(_replica(spark, d, i).cells) for i in (0, 1))
    return digests.digest_delta(own, other, spark)[0].select(*PAIR, "epoch", "source")


VERSIONS = f"""held AS (SELECT *, 'derived ' || vote AS reason FROM replicas),
versions AS (SELECT replica, count(*) || ':' || {_WORD.format(CELL_HASH, 1)} || ':' || {_WORD.format(CELL_HASH, 9)} || ':0:0:0' AS version FROM held GROUP BY replica)"""


def _no_floors(spark) -> DataFrame:
    return spark.createDataFrame([], "replica int, h_left string, h_right string, epoch bigint")


@query(sql("SELECT replica::BIGINT AS replica, version FROM versions", REPLICAS, VERSIONS))
def state_versions(spark, d):
    return digests.version(fx.replicas(spark, d), _no_floors(spark), "replica").select(F.col("replica").cast("bigint").alias("replica"), "version")


def _round(spark, d, late: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole round: every member reports, the greatest common sealed epochs are proposed, all
    acknowledge them, and the floors are taken. Replica 2 words some reasons in its own way; with
    `late`, replica 1 gets a cell more between its acks and the round's end."""
    told = staged(fx.replicas(spark, d).withColumn("reason", F.expr("if(replica = 2 and cast(substring(h_left, 2) as int) % 7 = 0, 'other', reason)")), "told")
    none = _no_floors(spark)
    proposed = staged(replication.common_floor(told, 3, N), "proposed")
    acks = digests.acknowledge(replication.acknowledgements(told, proposed, N), digests.version(told, none, "replica"))
    acks = staged(acks, "acks")
    more = told.where("replica = 1").orderBy(*PAIR, "epoch", "source").limit(1).withColumn("epoch", F.lit(9).cast("bigint"))
    return digests.floor_round(told.unionByName(more) if late else told, none, acks, 3)


ROUND = ACKS.split("vectors AS")[0].rstrip().rstrip(",") + """,
common AS (SELECT h_left, h_right, max(epoch) AS epoch FROM (SELECT h_left, h_right, epoch FROM (SELECT replica, h_left, h_right, epoch FROM replicas GROUP BY ALL HAVING count(DISTINCT source) = 5) GROUP BY ALL HAVING count(*) = 3) GROUP BY ALL),
taken AS (SELECT * FROM common c WHERE NOT EXISTS (SELECT 1 FROM told a JOIN told b USING (h_left, h_right, epoch, source) WHERE (a.vote, a.reason) <> (b.vote, b.reason) AND a.h_left = c.h_left AND a.h_right = c.h_right AND a.epoch = c.epoch))"""


@query(sql("SELECT h_left, h_right, epoch FROM taken", REPLICAS, ROUND))
def floor_round(spark, d):
    return _round(spark, d, False)[1]


@query(sql("SELECT replica::BIGINT AS replica, count(*) AS n, min(c.epoch) AS least_epoch FROM told c LEFT JOIN taken t USING (h_left, h_right) WHERE t.epoch IS NULL OR c.epoch >= t.epoch GROUP BY replica", REPLICAS, ROUND))
def floor_round_compacted(spark, d):
    left = _round(spark, d, False)[2]
    return left.groupBy(F.col("replica").cast("bigint").alias("replica")).agg(F.count("*").alias("n"), F.min("epoch").alias("least_epoch"))


@query(sql("SELECT 1::BIGINT AS replica, h_left, h_right, epoch, 'stale' AS rule FROM common", REPLICAS, ROUND))
def floor_round_stale(spark, d):
    """Acks of a state that has changed since are refused, and no floor is taken without them."""
    refused, taken, _ = _round(spark, d, True)
    if not taken.isEmpty():
        raise AssertionError("a floor was taken without a member")
    return refused.withColumn("replica", F.col("replica").cast("bigint"))


@query(sql("SELECT replica::BIGINT AS replica, h_left, h_right, CASE WHEN NOT sealed THEN 'unknown' WHEN x > 0 THEN 'different' WHEN s >= 2 THEN 'same' ELSE 'unknown' END AS vote, replica <> 1 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY replica, h_left, h_right ORDER BY sealed DESC, epoch DESC) AS place FROM (SELECT replica, h_left, h_right, epoch, count(DISTINCT source) = 5 AS sealed, count(*) FILTER (vote = 'same') AS s, count(*) FILTER (vote = 'different') AS x FROM replicas GROUP BY ALL)) WHERE place = 1", REPLICAS))
def coupled_answers(spark, d):
    """Decisions that each replica gave, with its version, held against the replicas after replica 1 has
    pulled what it lacks of replica 0."""
    then = staged(fx.replicas(spark, d), "then")
    pulled = replication.inventory_delta(*(then.where(F.col("replica") == i).drop("replica") for i in (1, 0))).withColumn("replica", F.lit(1))
    now = digests.version(then.unionByName(pulled), _no_floors(spark), "replica")
    answers = None
    for i in range(3):
        r = then.where(F.col("replica") == i).drop("replica")
        own = decisions.decisions(Evidence(r, ingest.handles_of(r), fx.SOURCES, fx.THRESHOLD)).select(F.lit(i).alias("replica"), *PAIR, "vote")
        answers = own if answers is None else answers.unionByName(own)
    coupled = digests.acknowledge(answers, digests.version(then, _no_floors(spark), "replica"))
    return digests.accepted(coupled, now).select(F.col("replica").cast("bigint").alias("replica"), *PAIR, "vote", "accepted")


@query(sql("SELECT h_left, h_right, epoch, source, 'replica ' || i AS lacks FROM (SELECT h_left, h_right, epoch, source, list(replica) AS held FROM replicas GROUP BY ALL), range(3) t(i) WHERE NOT list_contains(held, i)", REPLICAS))
def three_way_agreement(spark, d):
    """The cells that some of three replicas hold and others lack, in one exchange."""
    return agreement.disagreements({f"replica {i}": fx.replicas(spark, d).where(F.col("replica") == i) for i in range(3)}, [*PAIR, "epoch", "source"])


@query("WITH cents AS (SELECT user_id, event_id % 2 AS half, round(value * 100)::BIGINT AS v FROM events), rolled AS (SELECT user_id, half, sum(v) // count(*) AS m FROM cents GROUP BY ALL) SELECT a.user_id, a.m::DOUBLE AS a_value, b.m::DOUBLE AS b_value FROM rolled a JOIN rolled b USING (user_id) WHERE a.half = 0 AND b.half = 1 AND abs(a.m - b.m) <= 400")
def tolerance_match(spark, d):
    """Users whose mean value over even events is within four units of that over odd ones."""
    cents = fx.table(spark, d, "events").select("user_id", (F.col("event_id") % 2).alias("half"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
    rolled = cents.groupBy("user_id", "half").agg(F.expr("sum(v) div count(*)").cast("double").alias("m"))
    return agreement.within_tolerance(rolled.where("half = 0"), rolled.where("half = 1"), ["user_id"], "m", 400.0)


@query("""WITH rolled AS (SELECT l_linenumber % 3 AS execution, l_returnflag AS family, median(l_quantity) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL)
SELECT execution::BIGINT AS execution, family, 'l_quantity_median' AS metric, m AS recomputed, m + 1 AS stated, 'unlike' AS rule FROM rolled WHERE execution = 1 AND family = 'A'
UNION ALL SELECT execution, family, metric, v, NULL, 'only recomputed' FROM (SELECT execution, family, unnest(['l_quantity_median', 'l_quantity_min', 'l_quantity_max']) AS metric, unnest([m, lo, hi]) AS v FROM rolled WHERE execution = 2 AND family = 'R')
UNION ALL SELECT 7, 'N', metric, NULL, v, 'only stated' FROM (SELECT unnest(['l_quantity_median', 'l_quantity_min', 'l_quantity_max']) AS metric, unnest([m, lo, hi]) AS v FROM rolled WHERE execution = 0 AND family = 'N')""")
def summary_agreement(spark, d):
    """Medians and ranges by execution and family, recomputed and held against a table that states them
    with a wrong value, a row too few and a row too many."""
    rows = fx.table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).cast("bigint").alias("execution"), F.col("l_returnflag").alias("family"), "l_quantity")
    found = staged(reports.median_ranges(rows, ["execution", "family"], ["l_quantity"]), "rolled")
    wrong = F.expr("l_quantity_median + if(execution = 1 and family = 'A', 1, 0) + 1e-12")
    extra = found.where("execution = 0 and family = 'N'").withColumn("execution", F.lit(7).cast("bigint"))
    stated = found.where("not (execution = 2 and family = 'R')").withColumn("l_quantity_median", wrong).unionByName(extra)
    return agreement.metric_differences(found, stated, ["execution", "family"], [f"l_quantity_{n}" for n in ("median", "min", "max")])


# Observations -------------------------------------------------------------------------------------

OBSERVED = r"""n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS t FROM nation),
wide AS (SELECT 'case' || lpad(CAST(k AS VARCHAR), 3, '0') AS case_id, 'target' || t AS target_id,
  'E' || (k % 4) || '; e' || (k % 7) || ';;' || CASE WHEN k % 5 = 0 THEN '' ELSE ' x' || t END AS pe, 'e' || ((k + 1) % 4) || ';E' || (k % 9) AS ce,
  k % 6 <> 0 AS pt, k % 11 <> 0 AS ct, CASE k % 5 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN NULL ELSE 503 END AS ps,
  CASE WHEN k % 4 = 3 THEN NULL ELSE 200 + 100 * (k % 3) END AS cs, 'h' || (k % 3) || ';h' || (k % 5) || ';Server' AS ph, 'H' || (k % 2) || ';server;h' || (k % 6) AS ch,
  CASE WHEN k % 8 = 0 THEN '' ELSE 'title ' || t END AS px, 'title ' || (k % 3) AS cx FROM n),
raw AS (SELECT case_id, target_id, 'probe' AS vantage, pe AS e, pt AS tcp_success, ps AS status, ph AS h, px AS title FROM wide UNION ALL SELECT case_id, target_id, 'control', ce, ct, cs, ch, cx FROM wide),
obs AS (SELECT case_id, target_id, vantage, list_sort(list_distinct(list_filter(list_transform(string_split(e, ';'), lambda x: lower(trim(x))), lambda x: x <> ''))) AS endpoints,
  tcp_success, status, list_sort(list_distinct(list_filter(list_transform(string_split(h, ';'), lambda x: lower(trim(x))), lambda x: x <> ''))) AS headers, title FROM raw)"""

PAIRED = """paired AS (SELECT a.case_id AS case_a, b.case_id AS case_b, a.vantage AS vantage_a, b.vantage AS vantage_b, a.target_id AS target_a, b.target_id AS target_b,
  CASE WHEN a.target_id = b.target_id THEN 'same' ELSE 'different' END AS truth, a, b, list_has_any(a.endpoints, b.endpoints) AS o,
  CASE WHEN len(list_distinct(a.headers || b.headers)) = 0 THEN 0.0 ELSE len(list_intersect(a.headers, b.headers)) / len(list_distinct(a.headers || b.headers)) END AS j,
  a.title <> '' AND b.title <> '' AS tt, len(a.headers) > 0 AND len(b.headers) > 0 AS hh, coalesce(a.status BETWEEN 100 AND 599 AND b.status BETWEEN 100 AND 599, false) AS http
  FROM obs a JOIN obs b ON a.case_id || chr(1) || a.vantage < b.case_id || chr(1) || b.vantage),
judged AS (SELECT *, CASE WHEN o AND a.tcp_success AND b.tcp_success AND http AND a.status = b.status AND ((tt AND a.title = b.title) OR (hh AND j >= 0.5)) THEN 'same'
  WHEN len(a.endpoints) > 0 AND len(b.endpoints) > 0 AND NOT o AND a.tcp_success AND b.tcp_success AND http
   AND (a.status // 100 <> b.status // 100)::INT + (tt AND a.title <> b.title)::INT + (hh AND j <= 0.25)::INT >= 2 THEN 'different' ELSE 'unknown' END AS vote FROM paired)"""

SUMMARY = """count(*) AS pairs, count(*) FILTER (truth = 'same') AS true_same, count(*) FILTER (truth = 'different') AS true_different,
 count(*) FILTER (vote = 'same') AS predicted_same, count(*) FILTER (vote = 'different') AS predicted_different, count(*) FILTER (vote = 'unknown') AS predicted_unknown,
 count(*) FILTER (vote = 'same' AND truth <> 'same') AS false_same, count(*) FILTER (vote = 'different' AND truth <> 'different') AS false_different"""
COUNTS = ["pairs", "true_same", "true_different", "predicted_same", "predicted_different", "predicted_unknown", "false_same", "false_different"]


def _observed(spark, d):
    return state.unpivot(fx.observations(spark, d))


@query(f"WITH {OBSERVED} SELECT case_id, vantage, array_to_string(endpoints, ',') AS endpoints, tcp_success, status, array_to_string(headers, ',') AS headers, title FROM obs")
def unpivot_vantage(spark, d):
    o = _observed(spark, d)
    return o.select("case_id", "vantage", F.array_join("endpoints", ",").alias("endpoints"), "tcp_success", "status", F.array_join("headers", ",").alias("headers"), "title")


@query(r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(replace(p_name || '; ' || p_brand, ' ', ' ;'), ';'), lambda x: lower(trim(x))), lambda x: x <> ''))), ',') AS tokens FROM part")
def split_set(spark, d):
    p = fx.table(spark, d, "part")
    return p.select("p_partkey", F.array_join(F.array_sort(scalars.split_set(F.replace(F.concat_ws("; ", "p_name", "p_brand"), F.lit(" "), F.lit(" ;")))), ",").alias("tokens"))


@query("SELECT a.p_partkey, round(CASE WHEN len(list_distinct(a.t || b.t)) = 0 THEN 0 ELSE len(list_intersect(list_distinct(a.t), list_distinct(b.t))) / len(list_distinct(a.t || b.t)) END, 6) AS similarity FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS t FROM part) a JOIN (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS t FROM part) b ON b.p_partkey = a.p_partkey + 1")
def jaccard(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("t"))
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"))
    return p.join(following, "p_partkey").select("p_partkey", F.round(scalars.jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


@query(f"WITH {OBSERVED}, {PAIRED} SELECT case_a, case_b, vantage_a, vantage_b, truth, vote, CASE vote WHEN 'same' THEN 'successful-endpoint-and-http-signature' WHEN 'different' THEN 'disjoint-endpoints-and-two-http-conflicts' ELSE 'insufficient-independent-evidence' END AS reason FROM judged")
def pair_predicate(spark, d):
    return evaluation.pair_decisions(_observed(spark, d)).select("case_a", "case_b", "vantage_a", "vantage_b", "truth", "vote", "reason")


@query(f"WITH {OBSERVED}, {PAIRED} SELECT case_a, case_b, vantage_a, vantage_b, CASE WHEN o THEN 'same' ELSE 'different' END AS vote, CASE WHEN o THEN 'endpoint-overlap' ELSE 'no-observed-endpoint-overlap' END AS reason FROM paired")
def endpoint_predicate(spark, d):
    return evaluation.pair_decisions(_observed(spark, d), evaluation.endpoint_only).select("case_a", "case_b", "vantage_a", "vantage_b", "vote", "reason")


@query(f"WITH {OBSERVED} SELECT a.case_id AS case_a, b.case_id AS case_b, a.vantage AS vantage_a, b.vantage AS vantage_b FROM obs a JOIN obs b ON a.case_id || chr(1) || a.vantage < b.case_id || chr(1) || b.vantage")
def pair_enumeration(spark, d):
    p = evaluation.enumerate_pairs(_observed(spark, d))
    return p.selectExpr("a.case_id as case_a", "b.case_id as case_b", "a.vantage as vantage_a", "b.vantage as vantage_b")


@query(f"""WITH {OBSERVED}, {PAIRED}, s AS (SELECT {SUMMARY} FROM judged) SELECT *, round((predicted_same + predicted_different) / pairs, 9) AS coverage, round(coalesce((false_same + false_different) / nullif(predicted_same + predicted_different, 0), 0), 9) AS asserted_error_rate,
 round(coalesce((predicted_same - false_same) / nullif(predicted_same, 0), 0), 9) AS same_precision, round(coalesce((predicted_same - false_same) / nullif(true_same, 0), 0), 9) AS same_recall,
 round(coalesce((predicted_different - false_different) / nullif(predicted_different, 0), 0), 9) AS different_precision, round(coalesce((predicted_different - false_different) / nullif(true_different, 0), 0), 9) AS different_recall FROM s""")
def pair_summary(spark, d):
    rates = ["coverage", "asserted_error_rate", "same_precision", "same_recall", "different_precision", "different_recall"]
    return evaluation.summarize(evaluation.pair_decisions(_observed(spark, d))).select(*COUNTS, *[F.round(c, 9).alias(c) for c in rates])


@query(f"WITH {OBSERVED}, {PAIRED}, f AS (SELECT DISTINCT target_id AS fold FROM obs) SELECT fold, {SUMMARY} FROM f JOIN judged ON target_a <> fold AND target_b <> fold GROUP BY fold")
def leave_one_out(spark, d):
    return evaluation.leave_one_out(staged(evaluation.pair_decisions(_observed(spark, d)), "pairs"), "target").select("fold", *COUNTS)


@query(f"WITH {OBSERVED}, {PAIRED}, f AS (SELECT DISTINCT case_id AS fold FROM obs) SELECT fold, {SUMMARY} FROM f JOIN judged ON case_a <> fold AND case_b <> fold GROUP BY fold")
def leave_one_case_out(spark, d):
    return evaluation.leave_one_out(staged(evaluation.pair_decisions(_observed(spark, d)), "pairs"), "case").select("fold", *COUNTS)


@query(r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS handle FROM pages")
def authority_handle(spark, d):
    return fx.table(spark, d, "pages").select("page_id", scalars.authority_handle(F.col("url")).alias("handle"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_values, count(*) FILTER (event_type <> before) AS n_changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id")
def navigation_rollup(spark, d):
    return evaluation.navigation_rollup(fx.table(spark, d, "events"), "user_id", "event_id", "event_type")


# Metrics and rollups ------------------------------------------------------------------------------


@query(with_partition("""SELECT m.p::BIGINT AS merged, t.p::BIGINT AS true_pairs, (m.p - r.p)::BIGINT AS false_merges, (t.p - r.p)::BIGINT AS false_splits, round((m.p - r.p) / m.p, 9) AS false_merge_rate, round((t.p - r.p) / t.p, 9) AS false_split_rate FROM
 (SELECT sum(n * (n - 1) // 2) AS p FROM (SELECT count(*) AS n FROM truth GROUP BY label)) m, (SELECT sum(n * (n - 1) // 2) AS p FROM (SELECT count(*) AS n FROM truth GROUP BY service)) t,
 (SELECT sum(n * (n - 1) // 2) AS p FROM (SELECT count(*) AS n FROM truth GROUP BY label, service)) r""", "truth AS (SELECT label, c_nationkey || c_mktsegment AS service FROM membership JOIN customer ON handle = 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'))"))
def partition_metrics(spark, d):
    truth = fx.table(spark, d, "customer").select(fx.handle("c_custkey").alias("handle"), F.concat("c_nationkey", "c_mktsegment").alias("service"))
    return evaluation.partition_metrics(_views(spark, d)[2], truth).select("merged", "true_pairs", "false_merges", "false_splits", *[F.round(c, 9).alias(c) for c in ("false_merge_rate", "false_split_rate")])


@query("SELECT l_shipdate_month, l_returnflag, round(avg(l_quantity), 6) AS mean_quantity, max(l_quantity) AS most, bool_and(l_discount < 0.11) AS all_small FROM (SELECT *, month(l_shipdate) AS l_shipdate_month FROM lineitem) GROUP BY ALL")
def method_rollup(spark, d):
    rows = fx.table(spark, d, "lineitem").withColumn("l_shipdate_month", F.month("l_shipdate").cast("bigint"))
    return rows.groupBy("l_shipdate_month", "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.max("l_quantity").alias("most"), F.bool_and(F.col("l_discount") < 0.11).alias("all_small"))


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS middle FROM events GROUP BY event_type")
def kind_rollup(spark, d):
    return fx.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("middle"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, median(l_quantity) AS middle, grouping(l_linestatus)::BIGINT AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))")
def architecture_rollup(spark, d):
    fx.table(spark, d, "lineitem").createOrReplaceTempView("quorumlake_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, median(l_quantity) AS middle, cast(grouping(l_linestatus) AS bigint) AS level FROM quorumlake_lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))")


@query("SELECT l_returnflag, round(median(m), 6) AS middle, min(m) AS least, max(m) AS most FROM (SELECT l_returnflag, l_suppkey, median(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY ALL")
def nested_median(spark, d):
    one = evaluation.medians(fx.table(spark, d, "lineitem"), ["l_quantity"], ["l_returnflag", "l_suppkey"]).withColumnRenamed("l_quantity_median", "m")
    found = reports.median_ranges(staged(one, "medians"), ["l_returnflag"], ["m"])
    return found.select("l_returnflag", F.round("m_median", 6).alias("middle"), F.col("m_min").alias("least"), F.col("m_max").alias("most"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def action_counts(spark, d):
    return reports.action_counts(fx.table(spark, d, "events").withColumnRenamed("event_type", "action"), ("error", "view"), "user_id")


@query("SELECT user_id % 50 AS run, event_type AS phase, sum(event_id + CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END)::BIGINT AS total_ns FROM events GROUP BY ALL")
def phase_totals(spark, d):
    e = fx.table(spark, d, "events")
    timed = e.select((F.col("user_id") % 50).alias("run"), F.col("event_type").alias("phase"), F.col("event_id").alias("rpc_ns"), F.expr("if(event_id % 2 = 0, null, user_id)").alias("checker_ns"))
    return reports.phase_totals(timed, "run")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 250")
def head_queries(spark, d):
    return reports.head(fx.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 250)


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def ordered_distinct(spark, d):
    return reports.ordered_distinct(fx.table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("""SELECT l_returnflag, count(*) AS cases, round(avg(l_discount), 9) AS mean, sum(l_linenumber)::BIGINT AS total, median(l_quantity) AS middle, min(l_quantity) AS least, max(l_quantity) AS most, bool_and(l_tax < 0.08) AS all_low,
 (SELECT string_agg(l_linestatus || ':' || m, ',' ORDER BY l_linestatus) FROM (SELECT l_linestatus, round(avg(l_discount) * 1000000)::BIGINT AS m FROM lineitem i WHERE i.l_returnflag = lineitem.l_returnflag GROUP BY l_linestatus)) AS by_layout
 FROM lineitem GROUP BY l_returnflag""")
def equal_work(spark, d):
    rows = fx.table(spark, d, "lineitem")
    found = reports.equal_work(rows, "l_returnflag", "l_linestatus", "l_discount", ["l_linenumber"], ["l_quantity"], {"all_low": F.col("l_tax") < 0.08})
    layouts = F.array_join(F.transform("by_layout", lambda x: F.concat_ws(":", x["layout"], F.round(x["mean"] * 1000000).cast("bigint"))), ",")
    return found.select("l_returnflag", "cases", F.round("l_discount_mean", 9).alias("mean"), F.col("l_linenumber_total").alias("total"), F.col("l_quantity_median").alias("middle"), F.col("l_quantity_min").alias("least"), F.col("l_quantity_max").alias("most"), "all_low", layouts.alias("by_layout"))


@query("""WITH c AS (SELECT l_returnflag, l_suppkey, median(l_quantity) FILTER (l_linenumber % 3 = 0) AS k0, median(l_quantity) FILTER (l_linenumber % 3 = 1) AS k1, median(l_quantity) FILTER (l_linenumber % 3 = 2) AS k2 FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS cases, median(k0) AS k0_median, median(k1) AS k1_median, median(k2) AS k2_median, round(median(k0 / k1), 9) AS k0_over_k1_median, round(min(k0 / k1), 9) AS k0_over_k1_min, round(max(k0 / k1), 9) AS k0_over_k1_max,
 round(median(k2 / k1), 9) AS k2_over_k1_median, round(min(k2 / k1), 9) AS k2_over_k1_min, round(max(k2 / k1), 9) AS k2_over_k1_max FROM c GROUP BY l_returnflag""")
def implementation_medians(spark, d):
    rows = fx.table(spark, d, "lineitem").withColumn("kind", F.concat(F.lit("k"), F.col("l_linenumber") % 3))
    found = reports.implementation_medians(rows, ["l_suppkey"], "l_returnflag", "kind", ["k0", "k1", "k2"], "l_quantity", "k1")
    return found.select(*[F.round(c, 9).alias(c) if "_over_" in c else c for c in found.columns])


P95 = "SELECT event_type, round(value, 6) AS value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = {}"


@query(P95.format("greatest(0, floor(0.95 * n)::BIGINT - 1)"))
def p95_scale(spark, d):
    return evaluation.order_statistic(fx.table(spark, d, "events"), "value", ["event_type"], evaluation.scale_place).withColumn("value", F.round("value", 6))


@query(P95.format("floor(0.95 * (n - 1))::BIGINT"))
def p95_rpc(spark, d):
    return evaluation.order_statistic(fx.table(spark, d, "events"), "value", ["event_type"], evaluation.rpc_place).withColumn("value", F.round("value", 6))


@query("SELECT l_returnflag, round((p + z * z / (2 * n) - z * sqrt(n * (p * (1 - p) / n + z * z / (4 * n * n)) / n) ) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM (SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount > 0.05) / count(*) AS p, 1.959963984540054 AS z FROM lineitem GROUP BY l_returnflag)")
def wilson(spark, d):
    counts = fx.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("k"))
    low, high = scalars.wilson(F.col("k"), F.col("n"))
    return counts.select("l_returnflag", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH RECURSIVE rgs(s) AS (SELECT [0] UNION ALL SELECT list_append(s, k) FROM rgs, range(5) t(k) WHERE len(s) < 5 AND k <= list_max(s) + 1),
q AS (SELECT list_max(s) + 1 AS blocks, (SELECT count(*) FROM range(5) a(i), range(5) b(j) WHERE s[i + 1] = s[j + 1]) AS peer FROM rgs WHERE len(s) = 5)
SELECT blocks::BIGINT AS blocks, count(*) AS partitions, sum(peer)::BIGINT AS peer, (sum(peer) // gcd(sum(peer)::BIGINT, (count(*) * 25)::BIGINT))::BIGINT || '/' || ((count(*) * 25) // gcd(sum(peer)::BIGINT, (count(*) * 25)::BIGINT))::BIGINT AS mean FROM q GROUP BY blocks""")
def topology_responsiveness(spark, d):
    """Share of ordered endpoint pairs that can reach each other, over all partitions of five."""
    rows = generators.set_partitions(spark, 5)
    peer = F.expr("aggregate(transform(rgs, x -> size(filter(rgs, y -> y = x))), 0, (a, x) -> a + x)").cast("bigint")
    one = rows.select((F.array_max("rgs") + 1).cast("bigint").alias("blocks"), peer.alias("peer"))
    sums = one.groupBy("blocks").agg(F.count("*").alias("partitions"), F.sum("peer").alias("peer"))
    return sums.withColumn("mean", scalars.fraction(F.col("peer"), F.col("partitions") * 25))


@query("""WITH RECURSIVE rgs(s) AS (SELECT [0] UNION ALL SELECT list_append(s, k) FROM rgs, range(5) t(k) WHERE len(s) < 5 AND k <= list_max(s) + 1),
p AS (SELECT s, list_max(s) + 1 AS blocks FROM rgs WHERE len(s) = 5 AND list_max(s) > 0),
r AS (SELECT blocks, len(list_filter(s, lambda x: x = s[c + 1])) AS central, len(list_filter(s, lambda x: (s[i + 1] = x)::INT + (s[j + 1] = x)::INT + (s[k + 1] = x)::INT >= 2)) AS quorum
  FROM p, range(5) a(c), range(5) x(i), range(5) y(j), range(5) z(k) WHERE i < j AND j < k)
SELECT blocks::BIGINT AS components, count(*) AS placements, (sum(central) // gcd(sum(central)::BIGINT, 5 * count(*)))::BIGINT || '/' || (5 * count(*) // gcd(sum(central)::BIGINT, 5 * count(*)))::BIGINT AS central_mean,
 (sum(quorum) // gcd(sum(quorum)::BIGINT, 5 * count(*)))::BIGINT || '/' || (5 * count(*) // gcd(sum(quorum)::BIGINT, 5 * count(*)))::BIGINT AS quorum_mean,
 count(*) FILTER (central > quorum) AS central_gt_quorum, count(*) FILTER (quorum > central) AS quorum_gt_central, count(*) FILTER (central = quorum) AS equal FROM r GROUP BY blocks""")
def topology_placements(spark, d):
    """Sites that a central one and a quorum of three can serve, over all partitions and placements."""
    return evaluation.placements(generators.set_partitions(spark, 5).where(F.array_max("rgs") > 0), 5)


@query(sql("SELECT h_left, h_right, epoch, bool_or(same >= 2 AND no = 0) AS unsealed, bool_or(same >= 2 AND no = 0 AND i = n - 1) AS sealed FROM (SELECT h_left, h_right, epoch, s AS i, max(s) OVER w + 1 AS n, sum((vote = 'same')::INT) OVER (w ORDER BY s) AS same, max((vote = 'different')::INT) OVER (w ORDER BY s) AS no FROM cells WINDOW w AS (PARTITION BY h_left, h_right, epoch)) GROUP BY ALL"))
def transient_merge(spark, d):
    c = fx.cells(spark, d).groupBy(*PAIR, "epoch", "s", "vote").count()
    rows = c.withColumn("sequence", F.struct(*PAIR, "epoch")).withColumn("i", F.col("s")).withColumn("threshold", F.lit(2))
    sizes = c.groupBy(*PAIR, "epoch").agg((F.max("s") + 1).alias("n"))
    return evaluation.transient_merges(rows.join(sizes, [*PAIR, "epoch"])).select("sequence.*", "unsealed", "sealed")


@query(with_decisions("SELECT q_left, q_right, d.epoch, (SELECT string_agg(source, ',' ORDER BY source) FROM cells c WHERE c.h_left = d.h_left AND c.h_right = d.h_right AND c.epoch = d.epoch) AS sources FROM asked JOIN decisions d ON q_left = h_left AND q_right = h_right WHERE vote = 'same'", "asked AS (SELECT 'c' || lpad(CAST(l AS VARCHAR), 7, '0') AS q_left, 'c' || lpad(CAST(r AS VARCHAR), 7, '0') AS q_right FROM near)"))
def certificate_keys(spark, d):
    """Support keys of the direct SAME answers, as they travel."""
    store = fx.store(spark, d)
    decided = staged(decisions.decisions(store), "decisions")
    direct = decided.where(F.col("vote") == SAME).select(F.col("h_left").alias("q_left"), F.col("h_right").alias("q_right"), F.array(*PAIR).alias("path"))
    found = reports.supported_paths(direct, decided, store, keys_only=True)
    return found.select("q_left", "q_right", "epoch", F.array_join("cells.source", ",").alias("sources"))


@query(sql("""SELECT h_left, h_right, CASE WHEN strlen(f) <= 150 THEN 'full' WHEN strlen(c) <= 150 THEN 'compact' ELSE 'rejected' END AS form, CASE WHEN strlen(f) <= 150 THEN strlen(f) WHEN strlen(c) <= 150 THEN strlen(c) ELSE 0 END AS bytes
 FROM (SELECT h_left, h_right, '{"cells":"' || string_agg(source || '=' || vote, ';' ORDER BY epoch, source) || '"}' AS f, '{"cells":"' || string_agg(source, ';' ORDER BY epoch, source) || '"}' AS c FROM cells WHERE (l + s) % 3 <> 0 OR l % 2 = 0 GROUP BY ALL)"""))
def bounded_responses(spark, d):
    rows = fx.cells(spark, d).where("(l + s) % 3 <> 0 or l % 2 = 0").groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("epoch", "source", "vote"))).alias("c"))
    said = lambda f: rows.select(*PAIR, F.array_join(F.transform("c", f), ";").alias("cells"))
    found = reports.bounded_response(said(lambda c: F.concat_ws("=", c["source"], c["vote"])), said(lambda c: c["source"]), PAIR, 150)
    return found.select(*PAIR, "form", "bytes")


@query(with_decisions("SELECT count(*) FILTER (vote = 'same') AS same, count(*) FILTER (vote = 'different') AS different, count(*) FILTER (vote = 'unknown') AS unavailable FROM decisions"))
def answer_kinds(spark, d):
    return reports.answer_kinds(_decided(spark, d).withColumnRenamed("vote", "kind"), ("same", "different"))


@query("SELECT 'first' AS side, o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL EXCEPT ALL SELECT 'first', o_orderstatus, o_orderpriority, count(*) FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL UNION ALL (SELECT 'second' AS side, o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL EXCEPT ALL SELECT 'second', o_orderstatus, o_orderpriority, count(*) FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)")
def result_comparison(spark, d):
    o = fx.table(spark, d, "orders")
    half = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("seconds"))
    return reports.compare(half(0), half(1), ("seconds",))


@query(f"WITH {OBSERVED}, {PAIRED}, f AS (SELECT DISTINCT target_id AS fold FROM obs), s AS (SELECT fold, {SUMMARY} FROM f JOIN judged ON target_a <> fold AND target_b <> fold GROUP BY fold) SELECT min(pairs) AS min_pairs, max(pairs) AS max_pairs, min(predicted_unknown) AS min_predicted_unknown, max(predicted_unknown) AS max_predicted_unknown FROM s")
def fold_ranges(spark, d):
    folds = evaluation.leave_one_out(staged(evaluation.pair_decisions(_observed(spark, d)), "pairs"), "target")
    return reports.ranges(folds, "pairs", "predicted_unknown")


# Streams ------------------------------------------------------------------------------------------

STREAMED = """arrived AS (SELECT DISTINCT 'u' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS h_left, 'u' || lpad(CAST(user_id + 1 AS VARCHAR), 7, '0') AS h_right, event_id % 4 AS epoch, event_type AS source,
  CASE WHEN (user_id * 7 + (event_id % 4) * 3 + length(event_type)) % 5 < 3 THEN 'same' WHEN (user_id * 7 + (event_id % 4) * 3 + length(event_type)) % 5 = 3 THEN 'unknown' ELSE 'different' END AS vote FROM events)"""


@query(f"WITH {STREAMED} SELECT h_left, h_right, epoch, source, vote FROM arrived")
def stream_dedup(spark, d):
    return stream.run_available(stream.cells_of_events(stream.read_files(spark, f"{d}/events.parquet")))


@query(f"WITH {STREAMED}, n AS (SELECT count(DISTINCT event_type) AS n FROM events), e AS (SELECT h_left, h_right, epoch, count(DISTINCT source) = (SELECT n FROM n) AS sealed, count(*) FILTER (vote = 'same') AS s, count(*) FILTER (vote = 'different') AS x FROM arrived GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY h_left, h_right ORDER BY sealed DESC, epoch DESC) AS place FROM e) SELECT h_left, h_right, epoch, CASE WHEN NOT sealed THEN 'unknown' WHEN x > 0 THEN 'different' WHEN s >= 2 THEN 'same' ELSE 'unknown' END AS vote FROM r WHERE place = 1")
def stream_decisions(spark, d):
    cells = stream.run_available(stream.cells_of_events(stream.read_files(spark, f"{d}/events.parquet")))
    sources = tuple(sorted(r[0] for r in fx.table(spark, d, "events").select("event_type").distinct().collect()))
    return decisions.decisions(Evidence(cells, ingest.handles_of(cells), sources, 2)).select(*PAIR, "epoch", "vote")


@query(f"WITH {STREAMED}, n AS (SELECT count(DISTINCT event_type) AS n FROM events), floors AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS h_left, max(1 + event_id % 3) AS floor FROM events WHERE event_id % 97 = 0 GROUP BY ALL), e AS (SELECT h_left, h_right, epoch, count(DISTINCT source) = (SELECT n FROM n) AS sealed, count(*) FILTER (vote = 'same') AS s, count(*) FILTER (vote = 'different') AS x FROM arrived LEFT JOIN floors USING (h_left) WHERE epoch >= coalesce(floor, -1) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY h_left, h_right ORDER BY sealed DESC, epoch DESC) AS place FROM e) SELECT h_left, h_right, epoch, sealed, CASE WHEN NOT sealed THEN 'unknown' WHEN x > 0 THEN 'different' WHEN s >= 2 THEN 'same' ELSE 'unknown' END AS vote FROM r WHERE place = 1")
def stream_floor_decisions(spark, d):
    """Decisions by state per relation, cells and floors arriving in four files."""
    events = fx.table(spark, d, "events")
    n = events.agg(F.count_distinct("event_type")).first()[0]
    landed = stream.landed(events, "event_id")
    return stream.floor_decisions(stream.rows_of_events(stream.read_files(spark, landed, events.schema)), n, 2)


@query(ORACLES["materialize"])
def stream_partition(spark, d):
    """The partition kept up to date while the cells arrive in four files."""
    cells = fx.cells(spark, d).select(*PAIR, "epoch", "source", "vote")
    landed = stream.landed(cells, "epoch", "source", *PAIR)
    kept = live.LivePartition(spark, f"{landed}-partition")
    decided = stream.cell_decisions(stream.read_files(spark, landed, cells.schema), N, fx.THRESHOLD)
    stream.run_updates(decided, kept.follow, f"{landed}-checkpoint")
    return fx.handles(spark, d).join(kept.membership(), "handle", "left").select("handle", F.coalesce("label", "handle").alias("label"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
