"""URL rules by a sort-merge range join.

A rule (host, path) fits its host, all subdomains, and every path that starts with its own. The
canonical key of a url is its host, labels reversed, then its path, both as hex digits of their
bytes; below one host, a path prefix is an interval of keys. Each url stands once for each of its host's suffixes that carries a rule, so
a subdomain meets the rules of its parents. Rules and keys are sorted together and swept: a rule's
interval opens at its key and closes after it, and the active rule is the innermost open one. As
intervals of prefixes nest, the stack below an opening rule is fixed: closing it makes its parent
active again, so the sweep is one "last event before this key" window.

Keys are dealt by range, so a hot host spreads over many tasks; what is active at the start of a
range is carried in from the last event of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.session import staged

#: Between host and path of a key, before all hex digits; and the end of a rule's interval, after
#: them all, so that no character a path may hold gets past it.
BETWEEN, LAST = "/", "G"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _suffixes(host: Column) -> Column:
    """The host and its parents: a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict, parents): a rule and the shorter rules of its host that hold it.

    Rules of one host are few against urls; the chain of prefixes comes from the rule's own path,
    one look-up for each length, so it is no join of all pairs.
    """
    one = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("rule", F.concat("host", "path"))
    heads = one.select("host", F.col("path").alias("own"), F.explode(F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("path"))
    chain = heads.where("path <> own").join(one.select("host", "path", "rule", "verdict"), ["host", "path"])
    parent = chain.groupBy("host", F.col("own").alias("path")).agg(F.max(F.struct(F.char_length("path").alias("n"), "rule", "verdict")).alias("p"))
    return one.join(parent, ["host", "path"], "left")


def judge(pages: DataFrame, rules: DataFrame, ranges: int | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url).

    rules(host, path, verdict): of all that fit, the longest (host and path together, then host)
    decides; urls no rule fits, null ones and those without a host get `default` and a null rule.
    Of rules with equal host and path the smaller verdict counts. Repeated rows each have a row; an
    empty table gives none, without rules all get `default`. Other columns are not read.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = staged(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    spans = staged(intervals(rules), "rules")
    carried = spans.select(F.col("host").alias("at")).distinct()
    keys = split.select("host", "path").distinct().where("host <> ''").select("host", "path", F.explode(_suffixes(F.col("host"))).alias("at")).join(carried, "at")
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    key = lambda host, path: F.concat(F.hex(_reversed(host)), F.lit(BETWEEN), F.hex(path))
    urls = keys.select(key(F.col("at"), F.col("path")).alias("key"), F.lit(2).alias("kind"), none.alias("event"), F.col("host"), F.col("path"))
    at, no = key(F.col("host"), F.col("path")), F.lit(None).cast("string")
    opens = spans.select(at.alias("key"), F.lit(1).alias("kind"), F.struct("rule", "verdict").alias("event"), no.alias("host"), no.alias("path"))
    parent = F.struct(F.col("p.rule").alias("rule"), F.col("p.verdict").alias("verdict"))  # nulls inside where the stack is empty
    closes = spans.select(F.concat(at, F.lit(LAST)).alias("key"), F.lit(0).alias("kind"), parent.alias("event"), no.alias("host"), no.alias("path"))
    sorted_ = urls.unionByName(opens).unionByName(closes).repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id())
    swept = staged(sorted_, "swept")
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = swept.where("kind < 2").groupBy("range").agg(F.max_by("event", F.struct("key", "kind")).alias("event"))
    every = swept.select("range").distinct().join(marks, "range", "left")
    carry = every.select("range", F.last("event", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    active = swept.withColumn("active", F.last("event", ignorenulls=True).over(sweep)).where("kind = 2").join(carry, "range")
    best = (
        active.select("host", "path", F.coalesce("active", "carry").alias("a"))
        .where("a.rule is not null")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.char_length("a.rule").alias("n"), F.col("a.rule").alias("rule"), F.col("a.verdict").alias("verdict"))).alias("best"))
    )
    found = split.join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
