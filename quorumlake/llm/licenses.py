"""License scans: MinHash bands over overlapping windows retrieve templates, shingles verify them.

Texts and templates become 5-word shingles of words, A-Z lower-cased. A template of WINDOW shingles
or more is cut in windows of WINDOW shingles, one at each shingle, and so is every text, at every
second shingle. Each of BANDS hash functions gives a window its least hash, a band of one row; a
shared band retrieves the template, and nothing else does. A template of fewer shingles is one
window of its own size: as a text must hold ceil(0.8 n) of its n shingles, one of its
n - ceil(0.8 n) + 1 least hashes is among the text's, which are windows of one shingle, and that is
its band.

Collision probability: a text that holds 0.8 of a long template's shingles has a window that shares
at least 6.4 - 1 shingles with one of the template's (1 for the windows being up to one shingle out
of step), so Jaccard is 5.4 / (16 - 5.4) = 0.51 at the very least and 7 / 9 = 0.78 for a verbatim
copy. With 6 bands of one row each, a single window then collides with probability 1 - 0.49 ** 6 =
0.986 or more, verbatim copies with 1 - 0.22 ** 6 = 0.9999, and each further window is another
chance. Bands of short templates collide with certainty.

Retrieved pairs are verified with the exact shingles: kept if the text holds 0.8 or more of the
template's distinct shingles. Texts stay where they are read; only band keys that hit a template
and the small table of candidates move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import WORD, text_of
from quorumlake.llm.license_texts import TEMPLATES
from quorumlake.session import staged

__all__ = ["TEMPLATES", "scan", "template_table"]

SHINGLE, WINDOW, STRIDE, BANDS = 5, 8, 2, 6
CONTAINMENT = 0.8

#: Rows of template keys, templates and candidates up to which they are broadcast: some 20 bytes a
#: key or candidate, a few kilobytes a template. More are joined by a shuffle.
BROADCAST_KEYS, BROADCAST_TEMPLATES, BROADCAST_CANDIDATES = 200_000, 10_000, 1_000_000


def _words(df: DataFrame) -> DataFrame:
    lower = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("__words", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)))


def _shingle_strings() -> str:
    parts = ", ".join(f"__words[i + {k}]" for k in range(SHINGLE))
    return f"array_distinct(transform(filter(sequence(0, size(__words)), i -> i <= size(__words) - {SHINGLE}), i -> concat_ws(' ', {parts})))"


def _hashed(df: DataFrame, own: str) -> DataFrame:
    """(own, __h): hashes of a text's shingles, in order."""
    parts = ", ".join(f"__hashes[i + {k}]" for k in range(SHINGLE))
    return (
        _words(df).select(own, F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
        .select(own, F.expr(f"if(size(__hashes) < {SHINGLE}, cast(array() as array<bigint>), transform(sequence(0, size(__hashes) - {SHINGLE}), i -> xxhash64({parts})))").alias("__h"))
    )


def _keyed(hashed: DataFrame, own: str, stride: int) -> DataFrame:
    """(own, long, key): band keys of all windows (long) and the shingles themselves, each once; a
    text shorter than a window is one window. Bands are rows of their own, so that a band's hashes
    are worked out once and not at each window."""
    bands = [F.expr(f"transform(__h, h -> xxhash64(h, {k}))") for k in range(BANDS)]
    # the filter stands above the generator: below it, it would hash every text once more
    each = hashed.select(own, F.posexplode(F.array(*bands, F.col("__h"))).alias("k", "p")).where(F.size("p") > 0)
    # minima of `stride` neighbours are shared by the windows that hold them; get() is null past the end
    part = ", ".join(f"get(p, {stride} * j + {i})" for i in range(stride))
    shared = f"transform(sequence(0, cast((size(p) - 1) div {stride} as int)), j -> least({part}))" if stride > 1 else "p"
    each = each.withColumn("m", F.when(F.col("k") < BANDS, F.expr(shared)))
    inside = ", ".join(f"get(m, s + {i})" for i in range(WINDOW // stride))  # slice() would copy the array at each window
    least = F.expr(f"transform(sequence(0, cast(greatest(0, size(p) - {WINDOW}) div {stride} as int)), s -> least({inside}))")
    long = F.col("k") < BANDS
    # the outer form: for the inner one Spark first filters by the array's size, and makes it twice
    keys = F.explode_outer(F.array_distinct(F.when(long, least).otherwise(F.col("p")))).alias("key")
    return each.select(own, long.alias("long"), keys).where("key is not null")


def template_keys(templates: DataFrame, bands: bool = True) -> DataFrame:
    """(template_id, long, key). `bands` False leaves out those of long templates, for tests."""
    hashed = staged(_hashed(templates, "template_id").withColumn("n", F.size(F.array_distinct("__h"))), "templates")
    wide = _keyed(hashed.where(F.size("__h") >= WINDOW), "template_id", 1).where("long")
    least = F.slice(F.array_sort(F.array_distinct("__h")), F.lit(1), (F.col("n") - F.ceil(F.lit(CONTAINMENT) * F.col("n") - 1e-9) + 1).cast("int"))
    short = hashed.where((F.size("__h") < WINDOW) & (F.col("n") > 0)).select("template_id", F.lit(False).alias("long"), F.explode(least).alias("key"))
    return (short.unionByName(wide) if bands else short).distinct()


def template_table(spark, templates: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(templates, "template_id string, text string")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A staged table, broadcast if it has `rows` rows or fewer."""
    return F.broadcast(df) if df.count() <= rows else df


def candidates(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, template_id): pairs that share a band."""
    asked = _keyed(_hashed(docs, "doc_id"), "doc_id", STRIDE)
    return asked.join(_small(keys, BROADCAST_KEYS), ["long", "key"]).select("doc_id", "template_id").distinct()


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template_id, containment: templates of which a text holds `containment` or more.

    One row per id and template; of repeated ids the fullest text counts, null ids are one id.
    Null, empty and short texts match nothing; templates below five words match nothing. Ties
    can't occur. Very long texts are read whole. Other columns are not read. An empty table gives no
    rows.
    """
    own, texts = templates.select("template_id", "text"), docs.select("doc_id", "text")
    found = staged(candidates(texts, staged(template_keys(own), "keys")), "candidates")
    asked = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("template_id").alias("asked"))
    asked = _small(staged(asked, "asked"), BROADCAST_CANDIDATES)
    wanted = _small(staged(_words(own).select("template_id", F.expr(_shingle_strings()).alias("wanted")), "templates"), BROADCAST_TEMPLATES)
    held = _words(texts.join(asked, F.col("doc_id").eqNullSafe(F.col("__id")))).select("doc_id", F.expr(_shingle_strings()).alias("held"), F.explode("asked").alias("template_id"))
    share = F.size(F.array_intersect("held", "wanted")) / F.size("wanted")
    rated = held.join(wanted, "template_id").select("doc_id", "template_id", share.alias("containment"))
    return rated.where(F.col("containment") >= containment).groupBy("doc_id", "template_id").agg(F.max("containment").alias("containment"))


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for scan() of documents: every text against every template, without bands."""
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in templates)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
    return f"""
WITH t(template_id, text) AS (VALUES {quoted}),
tw AS (SELECT template_id, {words.format(lower.format("text"))} AS w FROM t),
wanted AS (SELECT DISTINCT template_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM tw, unnest(range(1, len(w) - {SHINGLE - 2})) AS u(i)),
sizes AS (SELECT template_id, count(*) AS n FROM wanted GROUP BY ALL),
dw AS (SELECT row_number() OVER () AS r, doc_id, {words.format(lower.format("coalesce(text, '')"))} AS w FROM documents),
held AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM dw, unnest(range(1, len(w) - {SHINGLE - 2})) AS u(i)),
shared AS (SELECT r, doc_id, template_id, count(*) AS c FROM held JOIN wanted USING (s) GROUP BY ALL)
SELECT doc_id, template_id, max(c / n) AS containment FROM shared JOIN sizes USING (template_id) WHERE c / n >= {containment} GROUP BY ALL
"""
