"""From raw documents to packed training sequences, in stages that are each stored.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on,
with their columns; the last returns the packed pieces.

Defined results of all stages: rows are judged by their texts and places, never
by a unique id, so null and repeated ids are documents like any other; null texts
count as empty; languages and sources may be null; columns of any name besides
are carried along unread; very long texts are processed whole; an empty table goes
through as an empty table. What a stage does with ties and repeated rows is said
where it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import dedup_exact, mixing, near_dedup, packing, quality_classifier
from folioscan.llm.queries import tokenizer
from folioscan.workspace import persist_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least one half, all if the labels tell nothing; rows with equal texts stay or go together, empty texts as one blank would."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the least id (null last), then the first by place. Of all empty texts one stays."""
    return dedup_exact.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, documents without an id among them; see ``near_dedup.dedup``."""
    return near_dedup.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; documents without words are never taken, those that repeat an id are taken alike."""
    taken = mixing.mix(docs, keep=docs.columns).where("copies > 0")
    return taken.select("kept_columns", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("kept_columns.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; each row is a document of its own, one taken several times too."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("source mix", mix), ("packing", pack)]

#: The classifier, the signatures and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
