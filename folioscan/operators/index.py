"""A Parquet index of revisions with lookup by id and by title.

``revisions`` is sorted by revision id: the minimum and maximum of each row
group let a lookup by id skip nearly all of them. ``titles`` holds only
(title, id), sorted by title, and leads a lookup by title to its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class ArticleNotFound(KeyError):
    pass


def write_index(revisions: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """Write both tables. files: the number of output files, if it matters; one makes one global file."""
    ordered = revisions.orderBy("id")
    ordered = ordered.coalesce(files) if files else ordered
    ordered.write.mode(mode).option("compression", "zstd").parquet(f"{path}/revisions")
    kept = revisions.sparkSession.read.parquet(f"{path}/revisions")
    titles = kept.where(F.col("page.title").isNotNull()).select(F.col("page.title").alias("title"), "id")
    titles.orderBy("title", "id").write.mode(mode).parquet(f"{path}/titles")


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/revisions")


def lookup_id(spark: SparkSession, path: str, revision_id: int) -> Row:
    """The revision with this id; raises ArticleNotFound if there is none."""
    found = open_index(spark, path).where(F.col("id") == F.lit(revision_id)).limit(1).collect()
    if not found:
        raise ArticleNotFound(f"Revision with id {revision_id} does not exist")
    return found[0]


def lookup_title(spark: SparkSession, path: str, title: str) -> DataFrame:
    """All revisions of the page with exactly this title, case-sensitive, as a DataFrame.

    Raises ArticleNotFound if no page has it.
    """
    ids = spark.read.parquet(f"{path}/titles").where(F.col("title") == F.lit(title))
    span = ids.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if span["lo"] is None:
        raise ArticleNotFound(f"Article with title {title} does not exist")
    return open_index(spark, path).where(F.col("id").between(span["lo"], span["hi"]) & (F.col("page.title") == F.lit(title)))
