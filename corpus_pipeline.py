"""From raw documents to packed sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import mixing, packing, simhash, substrings, toxicity
from quorumlake.llm.common import read
from quorumlake.llm.queries import TOKENIZER
from quorumlake.operators.joins import marked, marks
from quorumlake.session import staged

#: A stage can't be put in SQL: fingerprints, learned weights and tokenizers are none.
ORACLE_SQL = None

#: Words of a block when sources are mixed: documents stay whole but for one block's rounding.
MIX_BLOCK = 256

#: Encoded strings that a packing worker keeps: fewer than in a query of its own, as executors still
#: hold the memory that the stages before took.
PACK_CACHE = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    Null and empty texts have the score of a text without a match. Repeated rows and null ids are
    judged row by row. An empty table gives none. Other columns are kept; one named score is, too.
    """
    names = ["__score" if c == "score" else c for c in docs.columns]
    scored = toxicity.score(docs.toDF(*names), *toxicity.learn(docs, read(spark, sf_dir, "labels")))
    return scored.where("score < 0.5").select(*names).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays: texts linked by operator 4's fingerprints,
    or by shingles where fingerprints don't reach.

    Null and empty texts are copies of each other. Of rows with one id one stays; rows of null id all
    stay. An empty table gives none. Columns are kept as they are.
    """
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that a smaller doc_id has too go; documents left without words go.

    Null, empty and short texts lose nothing and stay. Rows of one id are one document; null ids lose
    nothing. An empty table gives none. Other columns are kept; n_chars follows the text.
    """
    found = substrings.deduplicate(docs, with_text=True).where("n_removed > 0").select(F.col("doc_id").alias("__id"), "kept_text").dropDuplicates(["__id"])
    found = staged(found, "cuts")
    # most documents lose nothing, and don't move
    both = marked(docs, "doc_id", marks(found.select("__id")))
    cut = both.where("__marked").join(found, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    wide = cut.unionByName(both.where("not __marked").withColumn("kept_text", F.lit(None).cast("string")))
    text = F.coalesce("kept_text", "text")
    out = wide.where("kept_text is null or kept_text <> ''").withColumn("text", text)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them.

    Null and empty texts have no words and go. Repeated rows and null ids are taken each as itself; the
    null source is a source. An empty table gives none. Other columns are kept; n_chars follows.
    """
    return mixing.mixed_documents(docs, block=MIX_BLOCK)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    Null and empty texts are one piece, the end token. Repeated rows and null ids are packed row by
    row. An empty table gives none. Other columns are not read.
    """
    return packing.pack(docs, TOKENIZER, cache=PACK_CACHE)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("substrings", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return docs
