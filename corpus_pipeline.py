"""A training corpus from the table documents: language, exact copies, near copies, mixture, packed sequences.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is written
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapgauge.llm import exact_dedup, langid, mixing, packing
from mapgauge.llm import near as similar
from mapgauge.llm.common import discard, durable, read
from mapgauge.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go (null, empty and letterless texts); a null lang gets the one found."""
    model = langid.train(docs.where(langid.is_training()))
    found = langid.identify(docs, model).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.select(*[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the smallest doc_id stays."""
    return similar.drop_similar(docs, words=5, least=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture takes them: in part, whole, or in two passes, a row for each pass."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: None: language inference, fingerprint groups, seeded draws and a tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, durable(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
