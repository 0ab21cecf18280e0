"""The queries op1 to op13 and pipeline: their operators with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import ann, divergence, embeddings, langid, licenses, mixing, packing, quality, simhash, substrings, toxicity, trie, urls
from quorumlake.llm.common import read

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: The rules of op8: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.template_table(spark, licenses.TEMPLATES))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(read(spark, sf_dir, "documents")).withColumnRenamed("kept_sha", "kept_sha256")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def rebuilt(own: DataFrame, stride: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c of own(conv_id, digests, sizes) with its first h turns replaced by those of
    conversation c - c % stride, h being crc32 of c as text modulo `heads`."""
    c = F.col("conv_id")
    bases = own.where(c % stride == 0).select(c.alias("base"), *[F.slice(x, 1, heads).alias(f"base_{x}") for x in ("digests", "sizes")])
    both = own.withColumn("base", c - c % stride).withColumn("h", (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")).join(bases, "base", "left")
    whole = lambda x, kind: F.concat(F.coalesce(F.slice(f"base_{x}", F.lit(1), F.col("h")), F.array().cast(kind)), F.slice(x, F.col("h") + 1, F.size(x)))
    return both.select("conv_id", whole("digests", "array<binary>").alias("digests"), whole("sizes", "array<bigint>").alias("sizes"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(rebuilt(trie.sequences(read(spark, sf_dir, "conversations")))).drop("key")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it uses this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_packing, op2_mixing, op3_embeddings, op4_simhash, op5_quality, op6_licenses, op7_toxicity, op8_url_rules, op9_language, op10_substrings, op11_nearest, op12_prefix_trie, op13_source_divergence)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


OP8_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
  ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
split AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
hosts AS (SELECT DISTINCT host, path FROM split),
best AS (SELECT h.host, h.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM hosts h JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY ALL)
SELECT page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path
"""


OP12_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id AS c FROM t),
crc AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM ids),
rebuilt AS (SELECT c, 0 AS part, i, role, text FROM crc JOIN t ON conv_id = c - c % 5 WHERE i <= crc % 9
  UNION ALL SELECT c, 1, i, role, text FROM crc JOIN t ON conv_id = c WHERE i > crc % 9),
deep AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM rebuilt),
keyed AS (SELECT c, d, strlen(text) AS bytes, sha256(string_agg(sha256(length(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS key FROM deep
  UNION ALL SELECT c, 0, 0, 'root' FROM ids),
paths AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS last FROM keyed),
nodes AS (SELECT key, any_value(d) AS d, any_value(up) AS up, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n,
  coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last), '') AS ends FROM paths GROUP BY key),
childless AS (SELECT a.*, coalesce(b.n_children, 0) AS n_children FROM nodes a LEFT JOIN (SELECT up AS key, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up) b USING (key)),
sub AS (SELECT p.key, sum((x.n - 1) * x.bytes) AS saved, sum((x.n_children = 0)::BIGINT) AS leaves FROM childless x JOIN paths p ON p.c = x.conv_id AND p.d <= x.d GROUP BY p.key)
SELECT a.conv_id, a.d::BIGINT AS depth, u.conv_id AS parent_conv_id, a.n::BIGINT AS n_convs, a.n_children::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM childless a JOIN sub s USING (key) LEFT JOIN nodes u ON a.up = u.key
"""


OP13_SQL = r"""
WITH plain AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM plain),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM plain),
totals AS (SELECT g.lang, g.source, v.v, coalesce(sum(n.n), 0) + 5 * v.v AS d FROM groups g JOIN v USING (lang) LEFT JOIN n USING (lang, source) GROUP BY g.lang, g.source, v.v),
p AS (SELECT t.lang, t.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // t.d AS p
  FROM totals t JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
whole AS (SELECT lang, term, sum(n) AS n FROM p GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(c.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b USING (lang) LEFT JOIN pair c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source WHERE a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": licenses.oracle_sql(), "op8_url_rules": OP8_SQL, "op12_prefix_trie": OP12_SQL, "op13_source_divergence": OP13_SQL}
