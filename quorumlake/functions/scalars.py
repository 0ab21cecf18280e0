"""Column functions; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_set(text: Column) -> Column:
    """The distinct non-empty parts between semicolons, trimmed and lower-cased."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def parse_status(text: Column) -> Column:
    """An integer status; blank, zero and below are missing."""
    value = F.nullif(F.trim(text), F.lit("")).cast("int")
    return F.when(value > 0, value)


def parse_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes"), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def pairs_of(n: Column) -> Column:
    """n choose 2, in whole numbers."""
    n = n.cast("bigint")
    return F.call_function("div", n * (n - 1), F.lit(2))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def authority(url: Column) -> Column:
    """The network location in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def authority_handle(url: Column) -> Column:
    """scheme://host[:port] of an http or https url, host in lower case, the scheme's own port left
    out. Null for other urls and for those with credentials."""
    form = r"^([Hh][Tt][Tt][Pp][Ss]?)://(\[[0-9A-Fa-f:.]+\]|[^/?#@:\[\]]+)(?::([0-9]*))?(?=[/?#]|$)"
    scheme, host, port = (F.lower(F.regexp_extract(url, form, i)) for i in (1, 2, 3))
    own = F.when(scheme == "http", "80").otherwise("443")
    number = F.regexp_replace(port, "^0+", "")
    shown = F.when((number == "") | (number == own), "").otherwise(F.concat(F.lit(":"), number))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, shown))


def gcd(a: Column, b: Column) -> Column:
    """By Euclid's steps; 64-bit values need at most 92."""
    step = lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), (x["a"] % x["b"]).alias("b")))
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda x: x["a"])


def fraction(a: Column, b: Column) -> Column:
    """An exact reduced fraction as text."""
    g = gcd(a, b)
    return F.concat_ws("/", *[F.call_function("div", x.cast("bigint"), g) for x in (a, b)])


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper bound of a binomial share."""
    p, n = successes / trials, trials
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
