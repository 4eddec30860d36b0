"""What several operators share: white space, locators of rows, guarded broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.workspace import persist_table, write_once

#: The white space that separates words, U+0020 and U+0009 to U+000D.
WHITE_SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table counts as proven small enough to broadcast.
BROADCAST_ROWS = 20_000
#: Parts over which joins deal the rows of a key that may be hot.
PARTS = 8


def text_of(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def without_space(c: Column) -> Column:
    for char in WHITE_SPACE:
        c = F.replace(c, F.lit(char), F.lit(""))
    return c


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


#: Names of a row's place, unlikely in any table.
FILE, ROW = "folioscan_file", "folioscan_row"


def located(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with each row's place, (``FILE``, ``ROW``); as it is if it has them already.

    Tables read from files have such places. Any other input is written first, to
    ``path`` or the shared folder, so that a row keeps its place whenever it is computed.
    """
    if FILE in docs.columns:
        return docs
    store = lambda d: write_once(d, path) if path else persist_table(d, "located")
    place = (F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    if "_metadata" in docs.columns:  # a column of the table's own hides the place
        stored = store(docs.withColumnRenamed("_metadata", "folioscan_own"))
        return stored.select(*[F.col("folioscan_own").alias(c) if c == "_metadata" else F.col(c) for c in docs.columns], *place)
    try:
        return docs.select(*docs.columns, *place)
    except AnalysisException:
        return store(docs).select(*docs.columns, *place)


def small_or_plain(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table if it has been counted and is small, else leave the join to Spark."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def maybe_in(rows: DataFrame, keys: str | Sequence[str], wanted: DataFrame, places: int = 1 << 26) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not among those of ``wanted``.

    Keys are hashed to ``places`` bits, of which words of 64 that hold any are
    broadcast: at most 2^20 rows of two numbers. Of the rows to be left out a
    share of about len(wanted) / places stays: an exact join has to follow where
    that matters, but it moves far fewer rows while wanted is small against
    ``places``, and no more than before beyond that.
    """
    return _placed(rows, keys, wanted, places).where("_taken").select(*rows.columns)


def _placed(rows: DataFrame, keys: str | Sequence[str], wanted: DataFrame, places: int) -> DataFrame:
    """``rows`` with ``_taken``: false if the row's keys are surely not in ``wanted``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    place = F.pmod(F.xxhash64(*keys), F.lit(places))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    taken = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    met = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(taken), "_word", "left")
    return met.withColumn("_taken", F.coalesce(F.call_function("shiftright", F.col("_bits"), F.col("_bit")).bitwiseAND(F.lit(1)) == 1, F.lit(False)))


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str], places: int = 1 << 26) -> DataFrame:
    """``rows`` (read from files) less those whose keys, never null, are in ``gone``: only rows that may be in it are moved; the others are read in a scan of their own."""
    placed = _placed(rows, keys, gone, places)
    stay = placed.where("NOT _taken").select(*rows.columns)
    return stay.unionByName(placed.where("_taken").select(*rows.columns).hint("merge").join(gone, list(keys), "left_anti").select(*rows.columns))


def dealt_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", parts: int = PARTS) -> DataFrame:
    """``rows`` joined with ``table``, the rows of each key dealt over ``parts`` by their columns ``spread``.

    A key that a third of all rows have is met in ``parts`` tasks; ``table``, the narrow side with few rows a key, is repeated for each part.
    """
    left = rows.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    right = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, [*keys, "_part"], how).drop("_part")
