"""Filters, counters and order of revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folioscan.workspace import persist_table


def skip_redirects(revisions: DataFrame) -> DataFrame:
    """Without the revisions of redirect pages. A null page counts as no redirect."""
    return revisions.where(~F.coalesce(F.col("page.is_redirect"), F.lit(False)))


def redirect_counters() -> list[Column]:
    """Aggregates ``redirectPages`` (revisions of redirect pages, as the name has always meant) and ``revisions``."""
    return [F.count_if(F.coalesce(F.col("page.is_redirect"), F.lit(False))).alias("redirectPages"), F.count(F.lit(1)).alias("revisions")]


def count_redirects(revisions: DataFrame) -> tuple[DataFrame, Observation]:
    """Count the revisions of redirect pages as they pass, before any later filter.

    The observation holds the counters once an action has run. Rows that pass
    twice count twice: a sort further on samples its input first.
    """
    seen = Observation("redirects")
    return revisions.observe(seen, *redirect_counters()), seen


def sort_by_id(revisions: DataFrame) -> DataFrame:
    """One total order by revision id: a range exchange and a sort in each partition."""
    return revisions.orderBy("id")


def with_position(revisions: DataFrame, *keys: str, name: str = "position") -> DataFrame:
    """Number rows from 1 in the order of ``keys`` without bringing them to one task.

    The sorted rows are written, counted for each partition, and numbered by the
    partition's offset; the table of offsets has one row per shuffle partition.
    """
    ordered = persist_table(revisions.orderBy(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sorted")
    sizes = ordered.groupBy("_part").count().orderBy("_part").collect()
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    table = revisions.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    within = F.bitwise_and("_at", F.lit((1 << 33) - 1)) if hasattr(F, "bitwise_and") else F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(table), "_part").withColumn(name, F.col("_offset") + within + 1).drop("_part", "_at", "_offset")
