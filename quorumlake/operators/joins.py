"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.session import staged

#: Keys at most that a counted join broadcasts, and the least count that makes a key hot.
HOT_KEYS, LEAST_HOT = 4000, 1000

#: Marks of a table of keys (see marks), 64 in a row: 262,144 rows, about 10 MB when broadcast.
MARKS = 1 << 24


def counted_join(rows: DataFrame, table: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """rows joined with table, which has one row a key and `count`, how many of rows carry it.

    Keys of more than total / HOT_KEYS rows can't be more than HOT_KEYS, so their part of the table
    is bounded and goes to the rows; all other rows meet theirs through a shuffle, where no key is
    hot. Rows without a partner go, as in any inner join; `count` is left out.
    """
    bound = max(LEAST_HOT, total // HOT_KEYS)
    names = [c for c in table.columns if c not in (key, count)]
    hot = table.where(F.col(count) > bound).select(key, *names, F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    met = marked.where("__hot").select(*rows.columns, *names)
    rest = marked.where("__hot is null").select(*rows.columns).join(table.where(F.col(count) <= bound).select(key, *names), key)
    return met.unionByName(rest.select(*rows.columns, *names))


def _mark(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("bigint")).bitwiseAND(F.lit(MARKS - 1))


def marks(keys: DataFrame) -> DataFrame:
    """(word, bits), staged: which marks the keys, the only column, have, 64 in a word. Each word has a
    row, so the table is as large for few keys as for many."""
    (key,) = keys.columns
    one = F.expr(f"shiftleft(1L, cast(xxhash64(cast(`{key}` as bigint)) & 63 as int))")
    words = keys.select(F.shiftright(_mark(key), 6).alias("word"), one.alias("bits"))
    none = keys.sparkSession.range(MARKS // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    return staged(words.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits")), "marks")


def marked(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """rows with `__marked`, true where the key has a mark in words, so for all keys these were made of
    and by chance for a few others. The others need not move to a join that they have no part in."""
    with_word = rows.withColumn("__mark", _mark(key))
    met = with_word.join(F.broadcast(words.toDF("__word", "__bits")), F.shiftright("__mark", 6) == F.col("__word"))
    return met.select(*rows.columns, F.expr("(shiftright(__bits, cast(__mark & 63 as int)) & 1) = 1").alias("__marked"))


def perhaps(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """The rows whose key has a mark in words."""
    return marked(rows, key, words).where("__marked").select(*rows.columns)
