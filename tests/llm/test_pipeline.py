"""The pipeline's stages on a small table with planted cases, each against its own rule."""

import random

import pytest

import corpus_pipeline as cp
from folioscan.llm import near_dedup, quality_classifier


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    src = "/root/testdata/sf0.01"
    spark.read.parquet(f"{src}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{src}/documents.parquet")
    good = [r for r in docs.where("lang = 'en' AND n_chars BETWEEN 600 AND 3000").orderBy("doc_id").collect()][:40]
    rng = random.Random(0)
    planted = []
    for k, r in enumerate(good):
        planted.append((10_000 + k, r["text"] + " ", r["lang"], r["source"], 0))  # an exact copy
        words = r["text"].split(" ")
        words[rng.randrange(len(words))] = "changed"
        planted.append((20_000 + k, " ".join(words), r["lang"], r["source"], 0))  # a near copy
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).repartition(3).write.parquet(f"{base}/documents.parquet")
    return base


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    outs = {}
    for name, stage in cp.STAGES:
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{name}")
        outs[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert outs[name].columns == columns and outs[name].dtypes == docs.dtypes
            before = outs[name]
    good = outs["quality classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids(good) for i in clean) > 0.97 * len(clean) and sum(i in ids(good) for i, q in labels.items() if q == 0) < 0.15 * len(labels)
    net = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(good) == {r["id"] for r in quality_classifier.score(docs, net).where("score >= 0.5").collect()}

    norm = lambda t: "".join(c for c in t if c not in " \t\n\x0b\f\r")
    best = {}
    for r in good.collect():
        key = norm(r["text"])
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert ids(outs["exact dedup"]) == {i for _, i in best.values()}

    left = ids(outs["near dedup"])
    groups = {}
    for r in near_dedup.classes(outs["exact dedup"]).collect():
        groups.setdefault(r["class_id"], set()).add(r["id"])
    assert left == {min(g) for g in groups.values()} and any(len(g) > 1 for g in groups.values())

    mixed = outs["source mix"].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in mixed} <= left and max(r["count"] for r in mixed) <= 3
    pieces = outs["packing"].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    times = {r["doc_id"]: r["count"] for r in mixed}
    assert {r["doc_id"]: r["sum(length)"] for r in pieces} == {r["doc_id"]: times[r["doc_id"]] * r["max(doc_tokens)"] for r in pieces} and len(pieces) == len(times)


def test_run_is_the_stages(spark, sf_dir):
    assert cp.run(spark, sf_dir).columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 4 <= len(cp.STAGES) <= 5


@pytest.mark.parametrize("n", [0, 9])
def test_stages_on_odd_tables(spark, sf_dir, tmp_path, n):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names operators use themselves."""
    prose = "It was the best of all the days that they had seen in the old town by the sea, and all were glad of it. "
    rows = [
        (1, None, None, None, "i", 1, 1.0), (None, prose, "en", "a", None, None, None), (2, "", "en", "a", "i", 1, 1.0), (3, prose * 3, "en", None, "i", 1, 1.0), (3, prose * 3, "en", None, "i", 1, 1.0),
        (4, prose * 3000, "en", "b", "i", 1, 1.0), (5, prose * 3 + "x", "en", "b", "i", 1, 1.0), (None, None, None, None, None, None, None), (6, prose + "y z", None, "a", "i", 1, 1.0),
    ][:n]
    schema = "doc_id long, text string, lang string, source string, id string, size int, score double"
    before = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES:
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{n}{name}")
        after = spark.read.parquet(f"{tmp_path}/{n}{name}")
        if name != "packing":
            assert after.columns == before.columns
            before = after
    assert (after.count() > 0) == (n > 0)
