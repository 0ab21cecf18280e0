"""Quality rules: plain counts, then robust multivariate outliers per language and source.

Counts of a text become a vector of five transformed statistics. For each (language, source), each
language and all texts together, a minimum covariance determinant estimate is sought: mean and
covariance of the half of the group's rows whose covariance has the smallest determinant. There are
four starts, all about the median: plain scales, and the correlations of hyperbolic tangents, of
signs and of directions. A concentration step takes the half that lies nearest to the last estimate,
by Mahalanobis distance. After FIRST steps of every start the one of smallest determinant goes on. A
group has settled, and leaves, when a step lowers its log determinant by less than SETTLED; the
smaller one stays. Each step that goes on lowers it by that much, and floors bound it from below, so
the steps end by themselves. Then all rows within the 0.975 quantile make the group's estimate.

A source's estimate leans on its language's as if that were PRIOR rows of the source, and a
language's on all texts' in the same way, whatever the sizes are. Rows beyond CUTOFF are rejected.

All is DataFrame expressions. Counting needs no shuffle. A concentration step is one pass over the
rows and one aggregation with map-side combine: counts, sums and products by hundredths of the log
distance. The half ends within one of these steps, whose rows count by the share that is still
needed, so every step keeps exactly half. A hot group costs no more than its rows; solving with the
covariance is a Cholesky factor in columns, one row a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import WORD, text_of
from quorumlake.session import discard, release, staged

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"

#: Statistics and the spread that each has at least: less than it is never an outlier's doing.
FLOORS = (("v0", 0.5), ("v1", 0.1), ("v2", 1.0), ("v3", 1.0), ("v4", 1.0))
P = len(FLOORS)

#: Share of rows a concentration step keeps, and what makes their covariance that of normal rows:
#: 0.5 / P(chi2 with 7 degrees <= q), q the 0.5 quantile of chi2 with 5 degrees.
KEEP, CONSISTENCY = 0.5, 1.912

#: The 0.975 quantile of chi2 with 5 degrees, and the factor of the rows within it.
WITHIN, WITHIN_FACTOR = 12.83, 1.0555

#: Steps of every start, and what a step lowers the log determinant of an open group by at least.
FIRST, SETTLED = 2, 0.01

#: Rows that the estimate of the next larger group counts as.
PRIOR = 50.0

#: The 0.9999 quantile of chi2 with 5 degrees of freedom.
CUTOFF = 25.74

#: Rows of estimates up to which they are broadcast: some 300 bytes each.
BROADCAST_GROUPS = 100_000

PAIRS = [(j, i) for i in range(P) for j in range(i + 1)]
FIT = ["n", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for j, i in PAIRS]]


def counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, whole texts."""
    text = F.col("__text")
    without = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.withColumn("__text", text_of()).withColumns(
        {
            "__words": F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)),
            "word_chars": without(SPACES).cast("bigint"),
            "n_symbols": (F.char_length(text) - without(SYMBOLS)).cast("bigint"),
            "__lines": lines,
        }
    )
    two = one.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "__windows": F.expr("if(size(__words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"),
        }
    ).drop("__words", "__lines", "__text")
    # only texts with a repeated window are sorted; places of equal windows are neighbours then
    three = two.withColumn("__sorted", F.expr("if(size(array_distinct(__windows)) < size(__windows), array_sort(transform(__windows, (x, i) -> struct(x, i))), null)"))
    four = three.withColumn(
        "__places",
        F.expr("array_sort(transform(filter(__sorted, (s, k) -> (k > 0 and s.x = __sorted[k - 1].x) or (k < size(__sorted) - 1 and s.x = __sorted[k + 1].x)), s -> s.i))"),
    )
    covered = "aggregate(__places, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p)).n"
    return four.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0).cast("bigint"))).drop("__windows", "__sorted", "__places")


def _statistics(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns(
        {
            "v0": F.log1p(F.col("n_words").cast("double")),
            "v1": F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))),
            "v2": F.log1p(1000.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            "v3": F.log1p(100.0 * F.col("n_dup_lines") / n),
            "v4": F.log1p(100.0 * F.col("n_repeat_words") / n),
        }
    )


def _sent(fit: DataFrame) -> DataFrame:
    """A staged table of estimates, broadcast if it is small: rows of a hot group then stay put."""
    return F.broadcast(fit) if fit.count() <= BROADCAST_GROUPS else fit


def _with_distance(rows: DataFrame, fit: DataFrame, how: str = "left") -> DataFrame:
    """rows with d2, for each estimate of its group: forward substitution with the Cholesky factor."""
    out = rows.join(_sent(fit), "grp", how)
    for i in range(P):
        y: Column = F.col(f"v{i}") - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", d2).drop(*[f"y{i}" for i in range(P)], *[c for c in FIT if c in fit.columns])


def _factor(moments: DataFrame, keys: list[str]) -> DataFrame:
    """The Cholesky factor, row by row, of the covariances c_ij."""
    out = moments
    for i in range(P):
        for j in range(i + 1):
            x: Column = F.col(f"c{j}{i}")
            for k in range(j):
                x = x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(x, F.lit(FLOORS[i][1] ** 2 / 100))) if i == j else x / F.col(f"l{j}{j}"))
    return out.select(*keys, *FIT)


def _sums() -> dict[str, Column]:
    """Sums of statistics and of their products, by name."""
    products = {f"t{i}": F.col(f"v{i}") for i in range(P)} | {f"t{j}{i}": F.col(f"v{j}") * F.col(f"v{i}") for j, i in PAIRS}
    return {name: F.sum(x).alias(name) for name, x in products.items()}


def _moments(found: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys, n, m_i, c_ij) from n and plain sums: statistics are logarithms, so their squares lose
    nothing."""
    mean = lambda i: F.col(f"t{i}") / F.col("n")
    c = lambda j, i: factor * (F.col(f"t{j}{i}") / F.col("n") - mean(j) * mean(i)) + F.lit(FLOORS[i][1] ** 2 if i == j else 0.0)
    return found.select(*keys, "n", *[mean(i).alias(f"m{i}") for i in range(P)], *[c(j, i).alias(f"c{j}{i}") for j, i in PAIRS])


def log_determinant() -> Column:
    """Of a fit's covariance."""
    return sum((2 * F.log(f"l{i}{i}") for i in range(1, P)), 2 * F.log("l00"))


def starts(rows: DataFrame) -> DataFrame:
    """(grp, s, fit): the first estimates of each group."""
    quart = rows.groupBy("grp").agg(*[F.percentile_approx(f"v{i}", [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(P)])
    spread = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i][1]))
    centre = staged(quart.select("grp", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(P)], *[spread(i).alias(f"s{i}") for i in range(P)]), "mcd")
    z = [(F.col(f"v{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(P)]
    length = F.greatest(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0])), F.lit(1e-9))
    ways = [F.lit(0.0)] * P, [F.tanh(x) for x in z], [F.signum(x) for x in z], [x / length for x in z]
    way = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), *[w[i].alias(f"w{i}") for i in range(P)]) for s, w in enumerate(ways)]))
    moved = rows.join(_sent(centre), "grp").select("grp", way.alias("w")).select("grp", "w.*")
    sums = [F.sum(f"w{i}").alias(f"t{i}") for i in range(P)] + [F.sum(F.col(f"w{j}") * F.col(f"w{i}")).alias(f"t{j}{i}") for j, i in PAIRS]
    seen = moved.groupBy("grp", "s").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)
    product = lambda j, i: F.col(f"t{j}{i}") / F.col("n") - F.col(f"t{j}") * F.col(f"t{i}") / F.col("n") ** 2
    seen = seen.select("grp", "s", "n", *[product(j, i).alias(f"r{j}{i}") for j, i in PAIRS])
    both = seen.join(centre, "grp")
    scale = lambda i: F.sqrt(F.greatest(F.col(f"r{i}{i}"), F.lit(1e-12)))
    c = lambda j, i: F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.col(f"r{j}{i}") / (scale(i) * scale(j)) * F.col(f"s{i}") * F.col(f"s{j}")
    out = staged(_factor(both.withColumns({f"c{j}{i}": c(j, i) for j, i in PAIRS}), ["grp", "s"]), "mcd")
    release(rows.sparkSession, centre)
    return out


def concentrate(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """One step: for each start of the groups in fit, the estimate of the half of the group's rows
    that lie nearest. Rows of other groups take no part."""
    keys = ["grp", "s"]
    bin_ = F.floor(100 * F.log(F.greatest(F.col("d2"), F.lit(1e-9)))).alias("bin")
    counted = _with_distance(rows, fit, "inner").groupBy(*keys, bin_).agg(F.count(F.lit(1)).alias("rows"), *_sums().values())
    # a group's steps of distance, not its rows, are ordered
    nearer = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    half = F.ceil(KEEP * F.sum("rows").over(Window.partitionBy(*keys)))
    share = (half - F.coalesce(F.sum("rows").over(nearer), F.lit(0))) / F.col("rows")
    kept = counted.withColumn("w", F.least(share, F.lit(1.0))).where("w > 0")
    halves = kept.groupBy(*keys).agg(F.sum(F.col("w") * F.col("rows")).alias("n"), *[F.sum(F.col("w") * F.col(name)).alias(name) for name in _sums()])
    return staged(_factor(_moments(halves, keys, CONSISTENCY), keys), "mcd")


def raw_estimate(rows: DataFrame) -> DataFrame:
    """(grp, s, fit): of each group, the settled estimate of smallest determinant. rows: grp, v0 to v4."""
    fit = starts(rows)
    for _ in range(FIRST):
        last, fit = fit, concentrate(rows, fit)
        discard(last)
    least = fit.groupBy("grp").agg(F.min_by("s", F.struct(log_determinant(), "s")).alias("s"))
    every, fit = fit, staged(fit.join(least, ["grp", "s"]), "mcd")
    discard(every)
    settled = []
    while True:
        new = concentrate(rows, fit)
        both = new.select("grp", log_determinant().alias("now")).join(fit.select("grp", log_determinant().alias("before")), "grp")
        falls, lower = F.col("now") <= F.col("before") - SETTLED, F.col("now") < F.col("before")
        marks = staged(both.select("grp", falls.alias("falls"), lower.alias("lower")), "mcd")
        those = lambda df, which: df.join(marks.where(which), "grp", "left_semi")
        settled.append(staged(those(new, "not falls and lower").unionByName(those(fit, "not falls and not lower")), "mcd"))
        last, fit = fit, staged(those(new, "falls"), "mcd")
        release(rows.sparkSession, last, new, marks)
        if fit.isEmpty():
            return staged(reduce(DataFrame.unionByName, settled), "mcd")


def _leaning(own: DataFrame, on: DataFrame) -> DataFrame:
    """The moments of own, mixed with those of `on` (same columns, prefixed) as PRIOR rows."""
    w = F.col("n") / (F.col("n") + PRIOR)
    both = own.join(on, "up")
    m = {f"m{i}": w * F.col(f"m{i}") + (1 - w) * F.col(f"up_m{i}") for i in range(P)}
    apart = lambda i: F.col(f"m{i}") - F.col(f"up_m{i}")
    c = {f"c{j}{i}": w * F.col(f"c{j}{i}") + (1 - w) * F.col(f"up_c{j}{i}") + w * (1 - w) * apart(j) * apart(i) for j, i in PAIRS}
    return both.select("grp", "n", *[x.alias(k) for k, x in (m | c).items()])


def estimate(rows: DataFrame) -> DataFrame:
    """(grp, fit) for each own group of rows(own, lang, v0 to v4)."""
    every = rows.select(F.explode(F.array("own", "lang", F.lit("all"))).alias("grp"), *[f"v{i}" for i in range(P)])
    raw = raw_estimate(every).drop("s")
    inside = _with_distance(every, raw).where(F.col("d2") <= WITHIN).groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n"), *_sums().values())
    found = staged(_moments(inside, ["grp"], WITHIN_FACTOR), "mcd")
    names = [c for c in found.columns if c not in ("grp", "n")]
    above = lambda df: df.select(F.col("grp").alias("up"), *[F.col(c).alias(f"up_{c}") for c in names])
    tree = staged(rows.select("own", "lang").distinct(), "tree")
    langs = found.join(tree.select(F.col("lang").alias("grp")).distinct(), "grp").withColumn("up", F.lit("all"))
    langs = staged(_leaning(langs, above(found)), "mcd")
    own = found.join(tree.select(F.col("own").alias("grp"), F.col("lang").alias("up")), "grp")
    return staged(_factor(_leaning(own, above(langs)), ["grp"]), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, d2 and kept for every row of docs.

    Null texts hold no words and fail. Null languages and sources are groups like others. Rows that
    fail the base rules take no part in the estimates; d2 is null for them. Repeated rows each have
    a row; an empty table gives none; very long texts are read whole; clashing extra columns are not
    read.
    """
    base = docs.select("doc_id", "lang", "source", "text")
    found = counts(base).drop("text").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    found = staged(_statistics(found.withColumn("__lang", named("lang")).withColumn("grp", F.concat_ws("\x01", named("lang"), named("source")))), "counts")
    sound = found.where(~F.col("base_failed")).select(F.col("grp").alias("own"), F.col("__lang").alias("lang"), *[f"v{i}" for i in range(P)])
    out = _with_distance(found, estimate(staged(sound, "statistics"))).withColumn("d2", F.when(~F.col("base_failed"), F.col("d2")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return out.withColumn("kept", kept).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept"
    )
