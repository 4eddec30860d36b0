"""Components, semi-joins by place, places of rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from folioscan.llm.common import FILE, ROW, dealt_join, located, maybe_in, small_or_plain, without
from folioscan.llm.components import components
from folioscan.llm.packing import _encoders, encoder_of
from folioscan.llm.queries import tokenizer
from folioscan.llm.textscan import in_arrow, releasing


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in root if any(x in e for e in edges if e[0] != e[1])}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    edges += [(1000 + i, 1001 + i) for i in range(100)]  # a chain
    edges += [(5000, 5001 + i) for i in range(100)] + [(7, 7), (8, 8)]  # a star, and loops
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_maybe_in_loses_nothing(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    wanted = spark.range(0, 5000, 50).select(F.col("id").alias("k"))
    left = {r["k"] for r in maybe_in(rows, "k", wanted).collect()}
    assert left >= set(range(0, 5000, 50)) and len(left) < 200
    assert maybe_in(rows, "k", wanted, places=1).count() == 5000  # full: everything passes


def test_dealt_join_is_a_join(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(500)] + [(501, None)], "i long, k int")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k int, v string")
    for how in ("inner", "left", "left_semi"):
        want = rows.join(table, "k", how)
        assert sorted(map(str, dealt_join(rows, table, ["k"], ["i"], how).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_places_are_stable(spark, tmp_path):
    df = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, _metadata string").repartition(3)
    rows = located(df)
    first, second = ({r["doc_id"]: (r[FILE], r[ROW]) for r in rows.collect()} for _ in range(2))
    assert first == second and len(set(first.values())) == 50 and located(rows) is rows
    df.drop("_metadata").write.parquet(f"{tmp_path}/t")
    stored = located(spark.read.parquet(f"{tmp_path}/t"))
    assert all(str(tmp_path) in r[FILE] for r in stored.collect())


def test_large_tables_are_not_broadcast(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert small_or_plain(table, 99) is table and small_or_plain(table, 100) is not table


def test_without_is_an_anti_join(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("k"), F.lit("x" * 50).alias("text")).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    gone = spark.range(0, 6000, 3).select(F.col("id").alias("k"))
    for places in (64, 1 << 12, 1 << 26):
        left = [r["k"] for r in without(rows, gone, ["k"], places).collect()]
        assert sorted(left) == [k for k in range(3000) if k % 3]
    assert without(rows, gone.limit(0), ["k"]).count() == 3000 and without(rows, rows.select("k"), ["k"]).isEmpty()


def test_batches_to_workers_are_small(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    rows = spark.range(0, 900, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    got = in_arrow(rows, run, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 900 and max(r["bytes"] for r in got) < 3 << 20
    one = spark.range(0, 2, 1, 1).select(F.repeat(F.lit("word "), 1_000_000).alias("text"))  # a longer text is a batch of its own
    assert sum(r["n"] for r in in_arrow(one, run, "n long, bytes long").collect()) == 2


def test_workers_forget_what_another_operator_kept():
    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = encoder_of(f.read(), 2, True)

    def again(batches):
        return batches

    again.__module__ = encoder_of.__module__
    assert list(releasing(again)([1])) == [1] and encoder in _encoders.values()  # its own tasks keep it
    again.__module__ = "another"
    assert list(releasing(again)([1])) == [1] and not _encoders
