"""Mixing sources to target weights by capped water-filling, with DataFrame operations alone.

Sizes are word counts. All sources share a budget (by default all words there
are) by weight; a source stops at ``max_epochs`` times its size and its excess
is dealt out again by weight until nobody is above. That fixed point is found
directly: with sources in order of size over weight, those that stop are a
prefix, and sums over prefixes (of whole numbers, hence exact) give the level
of the rest.

A source whose target is ``r`` times its size gets floor(r) whole repetitions
of every document, and one more of a seeded sample that holds the fraction.
Documents fall by a seeded hash into bins; bins join the sample in order until
it is as near to the fraction as whole bins get. Only sums of bins are ordered,
never the documents of a source.

The plan has a row for each source, and its windows over all sources run in one
task: that is meant for sources by the thousand, up to some ten million; bins are
4096 rows a source, ordered within their source.

Defined results: null text has size 0; a null source is a source of its own,
last in order; documents of size 0 take nothing; equal ids fall into the same
bin, so repeated rows are taken alike; sources at equal ratios of size and weight
are in order of their names; very long texts are counted whole, and one that is a
large part of its source makes the sample miss the target by up to half its size;
columns besides id, text and source are carried along if asked for and not looked
at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import small_or_plain, text_of, word_count
from folioscan.workspace import persist_table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BIN_DIGITS = 3
SEED = "mix-1"


def seeded_bin(id_col: Column, seed: str = SEED, digits: int = BIN_DIGITS) -> Column:
    """One of 16 ** digits bins; SQL engines with md5 can say the same."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target); a row for each source.

    weights: whole numbers that repeat over the sources in code-point order,
    null last. budget: words to share; all there are by default, and never more
    than the sources can give.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (turn + 1).cast("int")))
    everything = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    ranked = ranked.withColumns({"cap": cap, "all_size": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything)})
    share = F.lit(budget).cast("long") if budget is not None else F.col("all_size")
    # In this order a source is above only if all before it are.
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = ranked.withColumns({"cap_before": F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))})
    level = (F.least(share, F.col("all_size") * max_epochs) - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    stops = F.col("cap") <= level * F.col("weight")
    leveled = before.withColumns({"level": level, "stops": stops})
    # The level of the first source that does not stop holds for it and for all after it.
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("weight_before"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.least(final * F.col("weight"), F.col("cap").cast("double")))
    return leveled.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each document: id, source, size, source_size, target, copies, taken (copies * size).

    keep: columns to carry along, in a struct ``kept_columns``.
    """
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"), seeded_bin(F.col(id_col), seed).alias("bin"),
        F.struct(*[F.col(k) for k in keep]).alias("kept_columns") if keep else F.lit(None).cast("string").alias("kept_columns"),
    )
    if not keep:
        sized = persist_table(sized.drop("kept_columns"), "sized").withColumn("kept_columns", F.lit(None).cast("string"))
    bins = persist_table(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    plan = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(rate)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # Bins are in while the middle of the bin is within the rest: the nearest that whole bins get.
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        bins.withColumn("before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
        .join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .groupBy("source").agg(F.coalesce(F.min(F.when(F.col("before") + F.col("bin_size") / 2 > F.col("rest"), F.col("bin"))), F.lit(1 << 40)).alias("cut"))
    )
    plan = plan.join(cut.select(F.col("source").alias("s"), "cut"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "plan_source")
    plan = small_or_plain(persist_table(plan, "mix-plan"))
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("bin") < F.col("cut")).cast("long")).otherwise(F.lit(0)).cast("long")
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("copies", copies)
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["kept_columns"] if keep else []))
