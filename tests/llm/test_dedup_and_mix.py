"""Exact dedup and the source mix beyond what their SQL shows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folioscan.llm import dedup_exact, mixing

ROWS = [
    (1, "a b", 1), (2, "ab", 1), (3, " a\nb ", 1), (4, None, 1), (5, "", 1), (6, " \x0b", 1), (7, "a\x85b", 1), (8, "a b", 1),
    (9, "same", 1), (9, "same", 1), (None, "ab\t\t\t\t", 1), (None, "only", 1), (10, "tie x", 1), (11, "ti ex", 1), (12, "é", 1),
]
SCHEMA = "doc_id long, text string, digest int"


def brute(rows):
    groups = {}
    for k, (i, t, _) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, k))
    return groups


def test_groups(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    rows = dedup_exact.decide(df).collect()
    assert len(rows) == len(ROWS)
    for norm, members in brute(ROWS).items():
        sha = hashlib.sha256(norm.encode()).hexdigest()
        mine = [r for r in rows if r["digest"] == sha]
        best = min(members)
        assert len(mine) == len(members) and {r["copies"] for r in mine} == {len(members)}
        assert {r["keep"]["id"] for r in mine} == {ROWS[best[3]][0]} and sum(r["kept"] for r in mine) == 1
    kept = dedup_exact.dedup(df)
    assert kept.columns == df.columns and kept.count() == len(brute(ROWS))
    assert dedup_exact.decide(df.limit(0)).collect() == []


def runs_by_hand(runs):
    """For each run its (id, keep id, copies, kept), in plain Python; a best row is known by (run, place)."""
    state, out = {}, []
    for n, rows in enumerate(runs):
        for k, (i, t, _) in enumerate(rows):
            best, copies = state.get(norm(t), ((1,), 0))
            state[norm(t)] = (min(best, (-len(t or ""), i is None, i or 0, n, k)), copies + 1)
        out.append(sorted((str(i), str(rows_id(runs, state[norm(t)][0])), state[norm(t)][1], state[norm(t)][0][3:] == (n, k)) for k, (i, t, _) in enumerate(rows)))
    return out


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")


def rows_id(runs, best):
    return runs[best[3]][best[4]][0]


@pytest.mark.parametrize("stored", [True, False])
def test_later_runs_over_one_checkpoint(spark, tmp_path, stored):
    """Two and three runs: each is told about its own rows, judged against all rows so far."""
    checkpoint = f"file://{tmp_path}/check"
    runs = [
        [(1, "a b", 1), (2, "x", 1), (3, None, 1), (4, "long  text", 1), (5, "only once", 1)],
        [(6, "ab", 1), (7, "x   ", 1), (8, "new", 1), (9, "new", 1), (10, "longtext", 1)],
        [(11, "a b c", 1), (12, "ab", 1), (13, " x", 1), (14, "new ", 1), (None, "", 1), (0, "a b", 1)],
    ]
    for n, want in enumerate(runs_by_hand(runs)):
        df = spark.createDataFrame(runs[n], SCHEMA).coalesce(1)
        if stored:
            df.write.parquet(f"file://{tmp_path}/in{n}")
            df = spark.read.parquet(f"file://{tmp_path}/in{n}")
        rows = dedup_exact.decide(df, checkpoint=checkpoint, run=f"r{n}").collect()
        assert sorted((str(r["id"]), str(r["keep"]["id"]), r["copies"], r["kept"]) for r in rows) == want
        again = dedup_exact.decide(df, checkpoint=checkpoint, run=f"r{n}").collect()  # as after an interruption
        assert sorted(map(str, again)) == sorted(map(str, rows))


def test_earlier_texts_are_compared_too(spark, tmp_path, monkeypatch):
    """A hash that only sees the first letter: a later run's rows are told apart from the earlier best one by its text."""
    monkeypatch.setattr(F, "sha2", lambda c, bits: F.substring(c, 1, 1))
    checkpoint = f"file://{tmp_path}/check"
    dedup_exact.decide(spark.createDataFrame([(1, "apple", 0), (2, "app le", 0), (3, "pear", 0)], SCHEMA), checkpoint=checkpoint).collect()
    rows = dedup_exact.decide(spark.createDataFrame([(4, "avocado", 0), (5, "ap p le", 0), (6, "p e a r", 0)], SCHEMA), checkpoint=checkpoint).collect()
    assert {r["id"]: (r["keep"]["id"], r["copies"], r["kept"]) for r in rows} == {4: (4, 1, True), 5: (5, 3, True), 6: (6, 2, True)}


def test_only_texts_of_hits_are_moved(spark, tmp_path):
    """Rows that reach the comparison of texts are those of hits, and of the few that share their places."""
    rows = [(i, f"text number {i}", 0) for i in range(2000)] + [(5000 + i, "the same", 0) for i in range(50)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/t")
    placed = dedup_exact.placed(spark.read.parquet(f"file://{tmp_path}/t"))
    hits = placed.where("text = 'the same'").select("at_file", "at_row")
    assert 50 <= dedup_exact.maybe_in(placed, ["at_file", "at_row"], hits).count() <= 52


def test_a_very_long_text(spark):
    long = "word " * 400_000
    rows = [(1, long, 0), (2, long + " ", 0), (3, long + "x", 0)]
    got = {r["id"]: (r["keep"]["id"], r["copies"]) for r in dedup_exact.decide(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1)}


def test_a_digest_of_two_texts_is_split(spark, monkeypatch):
    """A hash that only sees the first letter: full texts decide."""

    def weak(c, bits):
        return F.substring(c, 1, 1)

    monkeypatch.setattr(F, "sha2", weak)
    rows = [(1, "apple", 0), (2, "app le", 0), (3, "avocado", 0), (4, "pear", 0), (5, "p ear", 0), (6, "zoo", 0)]
    got = {r["id"]: (r["keep"]["id"], r["copies"], r["kept"]) for r in dedup_exact.decide(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True)}


def water(sizes, weights, epochs):
    """Reshare step by step, as the rule is told."""
    total, targets, free, left = sum(sizes), [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / w >= epochs * sizes[i]}
        if not above:
            for i in free:
                targets[i] = left * weights[i] / w
            break
        for i in above:
            targets[i] = epochs * sizes[i]
        left -= sum(targets[i] for i in above)
        free -= above
    assert sum(targets) == pytest.approx(total)
    return targets


@pytest.mark.parametrize("seed", range(6))
def test_targets_follow_the_rule(spark, seed):
    rng = random.Random(seed)
    names = sorted(f"s{k}" for k in range(rng.randint(1, 12)))
    sizes = [rng.choice([0, 1, 10, 100, 5000, rng.randint(1, 10**6)]) for _ in names]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    assert [got[n] for n in names] == pytest.approx(want)


def test_taken_is_near_the_target(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"), F.max(F.col("taken") / F.greatest(F.lit(1), "size")).alias("times")).collect()
    assert all(abs(r["taken"] - r["target"]) <= max(r["largest"], 0.01 * r["target"]) and r["times"] <= 3 for r in rows)


def test_mix_edges(spark):
    rows = [(1, None, None, 5), (2, "", "b", 5), (3, "x y", None, 5), (3, "x y", None, 5), (None, "x", "a", 5), (4, "w " * 9999, "b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df, keep=["doc_id", "size"]).collect()
    assert len(got) == 6 and sum(r["size"] for r in got) == 4 + 1 + 9999
    assert {r["taken"] for r in got if r["size"] == 0} == {0} and len({r["copies"] for r in got if r["id"] == 3}) == 1
    assert [r["kept_columns"]["size"] for r in got] == [5] * 6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3), keep=["doc_id", "size"]).collect()))
    assert mixing.mix(df.limit(0)).collect() == []
