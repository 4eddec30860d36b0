"""Exact deduplication as a stateful stream, with DataFrame operations alone.

Documents are equal if they are identical without white space. A streaming
aggregation keyed by the SHA-256 of that text keeps, in disk-backed state that
never expires, how often the digest came and the best row so far: its length,
identifier and content locator (file and row). The copies of one text are
aggregated before the shuffle, so a text that makes up a third of all rows
reaches its state as one row for each task.

Digests that came more than once are hits. Only the texts of their rows are read
again, whole, and compared byte by byte; copies within a task are compared
before anything is moved. Should one digest ever stand for two texts, its rows
are grouped by the texts themselves.

Runs over one checkpoint share the state: a later run's rows are judged against
all rows so far, and the answer is about the rows of that run alone. The text of
an earlier best row is read by its locator, so the Parquet files of earlier runs
have to be there still; input that is not read from files is kept below the
checkpoint. A run that was interrupted goes on under the same ``run``: what it
has written counts once.

Defined results: null text counts as empty, and empty texts equal each other
and texts of white space alone. Of equal rows the longest stays, then the
smallest id (null ids last), then the first by file and row, so of rows that
repeat an id exactly one is kept. A later run's longer copy becomes the best
one; what the earlier run said is not taken back. Very long texts are compared
whole; a text has to fit in one string (2 GB). Other columns are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.common import FILE, ROW, dealt_join, located, maybe_in, text_of, without, without_space
from folioscan.workspace import persist_table, scratch, write_once

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no blocks set aside: a large cluster has many small stores
}
#: Parts in which the texts of one hit meet first.
SALTS = 32
#: The order of equal rows: the least is the best one. Length comes negated.
RANK = ("less", "no_id", "id", "at_file", "at_row")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, text, at_file, at_row): what the steps below need of a table."""
    return located(docs, path).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(FILE).alias("at_file"), F.col(ROW).alias("at_row"))


def digests(rows: DataFrame) -> DataFrame:
    """(digest and the columns of RANK) of ``placed`` rows; the text itself is not carried on."""
    length = F.length(text_of()).cast("long")
    return rows.select(F.sha2(without_space(text_of()), 256).alias("digest"), (-length).alias("less"), F.col("id").isNull().alias("no_id"), "id", "at_file", "at_row")


def ingest(spark: SparkSession, folder: str, schema: T.StructType, checkpoint: str, files_per_batch: int = 4096) -> None:
    """Bring the digest files below ``folder``/run=... that are new since the last run into the state at ``checkpoint``."""
    stream = spark.readStream.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())])).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    state = stream.groupBy("digest").agg(F.min(F.struct(*RANK)), F.count(F.lit(1)))
    with _settings(spark, STATE):
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def state_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, keep (the columns of RANK), copies."""
    with _settings(spark, STATE):
        state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", F.col("value.min").alias("keep"), F.col("value.count").alias("copies"))


def _has_state(spark: SparkSession, checkpoint: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _full(rows: DataFrame) -> DataFrame:
    """``placed`` rows to digest, at_file, at_row, full."""
    return rows.select(F.sha2(without_space(text_of()), 256).alias("digest"), "at_file", "at_row", without_space(text_of()).alias("full"))


def split_digests(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Digests whose rows (digest, at_file, at_row, full) differ in their full texts.

    The different texts of a digest are gathered, which is one: first those of
    each task, then of each part of the files, then of all parts.
    """
    part = F.pmod(F.xxhash64("at_file", F.shiftright("at_row", 20)), F.lit(salts))
    met = rows.groupBy("digest", part.alias("salt")).agg(F.collect_set("full").alias("texts"))
    return met.groupBy("digest").agg(F.collect_set("texts").alias("sets")).where((F.size("sets") > 1) | (F.size(F.col("sets")[0]) > 1)).select("digest")


def _earlier_texts(earlier: DataFrame, text_col: str) -> DataFrame:
    """(digest, at_file, at_row, full) of the best rows of earlier runs, read by their locators."""
    best = earlier.select(F.col("digest").alias("best"), "keep.at_file", "keep.at_row")
    files = [r["at_file"] for r in best.select("at_file").distinct().collect()]  # a name for each file, as for any listing
    table = placed(earlier.sparkSession.read.parquet(*files), text_col, text_col)
    return _full(maybe_in(table, ["at_file", "at_row"], best).join(best, ["at_file", "at_row"]).drop("best"))


def _regrouped(found: DataFrame, split: DataFrame, full: DataFrame, earlier: DataFrame) -> DataFrame:
    """Groups by full text for the rows of digests that stand for several; earlier rows of such a digest count as copies of its earlier best one."""
    new = found.select("digest", *RANK, F.lit(1).cast("long").alias("n"), F.lit(True).alias("mine"))
    old = earlier.select("digest", *[F.col(f"keep.{c}").alias(c) for c in RANK], F.col("copies").alias("n"), F.lit(False).alias("mine"))
    members = new.unionByName(old).join(split, "digest", "left_semi").join(full, ["digest", "at_file", "at_row"])
    best = members.groupBy("digest", "full").agg(F.min(F.struct(*RANK)).alias("keep"), F.sum("n").alias("copies"))
    return members.where("mine").join(best, ["digest", "full"]).select("id", "digest", "at_file", "at_row", "keep", "copies")


def _decide(rows: DataFrame, home: str, run: str, text_col: str) -> DataFrame:
    spark = rows.sparkSession
    digested = digests(rows)
    found = write_once(digested, f"{home}/digests/run={run}")
    state = f"{home}/state"
    if _has_state(spark, state):  # what is known of these digests before the state goes on
        known = state_table(spark, state).join(found.select("digest").distinct(), "digest", "left_semi")
    else:
        known = found.limit(0).select("digest", F.struct(*RANK).alias("keep"), F.lit(0).cast("long").alias("copies"))
    earlier = write_once(known, f"{home}/earlier/run={run}")
    ingest(spark, f"{home}/digests", digested.schema, state)
    hits = state_table(spark, state).where("copies > 1").select("digest", F.struct("keep.id", "keep.at_file", "keep.at_row").alias("keep"), "copies")
    own = F.struct("id", "at_file", "at_row")
    joined = dealt_join(found, hits, ["digest"], ["at_file", "at_row"], "left").select("id", "digest", "at_file", "at_row", F.coalesce("keep", own).alias("keep"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    joined = persist_table(joined, "decided")
    full = _full(maybe_in(rows, ["at_file", "at_row"], joined.where("copies > 1").select("at_file", "at_row")))
    if not earlier.isEmpty():
        full = full.unionByName(_earlier_texts(earlier, text_col))
    split = persist_table(split_digests(full), "split-digests")
    if not split.isEmpty():
        again = _regrouped(found, split, full, earlier).withColumn("keep", F.struct("keep.id", "keep.at_file", "keep.at_row"))
        joined = joined.join(split, "digest", "left_anti").unionByName(again)
    kept = (F.col("keep.at_file") == F.col("at_file")) & (F.col("keep.at_row") == F.col("at_row"))
    return joined.withColumn("kept", kept)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, run: str | None = None) -> DataFrame:
    """A row for each document: id, digest, keep (id and locator), copies, kept, and its own locator.

    checkpoint: a folder that keeps the state for later runs; by default one in
    the shared scratch space. run: the run's name, a new one by default.
    """
    home, run = checkpoint or scratch(docs.sparkSession, "dedup"), run or uuid.uuid4().hex
    return _decide(placed(docs, id_col, text_col, f"{home}/rows/run={run}" if checkpoint else None), home, run, text_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = located(docs)
    found = _decide(placed(rows, id_col, text_col), scratch(docs.sparkSession, "dedup"), "only", text_col)
    gone = found.where("NOT kept").select(F.col("at_file").alias(FILE), F.col("at_row").alias(ROW))
    return without(rows, gone, [FILE, ROW]).select(*docs.columns)
