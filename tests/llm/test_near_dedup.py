"""Near-duplicate classes against all pairs, and DartMinHash against exact similarities."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscan.llm import near_dedup
from folioscan.llm.dartminhash import signatures


def brute(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (Counter([tuple(w)]) if w else Counter()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and (sets[i] & sets[j]).total() >= threshold * (sets[i] | sets[j]).total() - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = ["", None, " \n", "a b", "a  b", "a b c", "one"]
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append("\n".join(copy) if rng.random() < 0.5 else " ".join(copy))
        texts.append(" ".join(passage + base[:20]))  # shares much with others, but not enough
    lines = [" ".join(word() for _ in range(6)) for _ in range(5)]
    for k in (1, 2, 8, 9, 10, 30):  # the same shingles, more and more often: near by count or not at all
        texts.append("\n".join([*lines, *lines[:2] * k]))
    base = [word() for _ in range(200)]
    for i in range(40):  # a chain: neighbours are near, ends are not
        base = [*base[4:], *(word() for _ in range(4))]
        texts.append(" ".join(base))
    return texts


def test_classes_equal_all_pairs(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, size string, node int").repartition(5)
    got = {r["id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert near_dedup.classes(spark.createDataFrame([], schema)).collect() == []
    rows = [(5, "a b c d e f"), (5, "u v w x y z"), (None, "a b c d e f"), (None, "q r s t u"), (9, "u v w x y z"), (7, None), (None, None), (3, "a  b c d e f")]
    got = sorted(near_dedup.classes(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert sorted((r["id"], r["class_id"]) for r in got if r["id"]) == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]
    assert sorted((r["class_id"] or -1) for r in got if r["id"] is None) == [-1, -1, 3]


def test_a_hub_with_several_texts(spark):
    """Document 1 has two texts and is the hub of both buckets."""
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, x), (1, y), (2, x + " end"), (3, y + " end"), (4, x + " fin"), (5, y + " fin"), (6, "other words than these")]
    got = {(r["id"], r["class_id"]) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)}


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_jaccard(weighted):
    rng = np.random.default_rng(1)
    u = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    owner = np.repeat([0, 1], 900)
    elements = np.concatenate([u[:900], u[100:]])
    w = rng.integers(1, 6, 1800).astype(float) if weighted else np.ones(1800)
    s = signatures(elements, owner, 2, 4000, w if weighted else None)
    a, b = np.zeros(1000), np.zeros(1000)
    a[:900], b[100:] = w[:900], w[900:]
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    alone = signatures(u, np.zeros(50, np.int64), 1, 125)
    company = signatures(np.concatenate([u[:3], u, u[:20]]), np.repeat([0, 1, 2], [3, 50, 20]), 3, 125)
    assert (alone[0] == company[1]).all()


def test_a_hub_with_many_nodes_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUB_NODES", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    texts = corpus(8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_order_by_owner_and_hash():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    hashes[::3] = hashes[0] ^ rng.integers(0, 8, 300, dtype=np.uint64)  # told apart by their last bits alone
    owner = np.sort(rng.integers(0, 40, 900))
    order, want = near_dedup.by_owner(hashes, owner, 40), np.lexsort((hashes, owner))
    assert (hashes[order] == hashes[want]).all() and (owner[order] == owner[want]).all()


def test_spelled_out_sets_have_the_weighted_similarity():
    hashes, owner, times = np.array([5, 9, 5, 9, 11], np.uint64), np.array([0, 0, 1, 1, 1]), np.array([3, 1, 2, 4, 1])
    elements, who = near_dedup.spelled_out(hashes, owner, times)
    a, b = (set(elements[who == k].tolist()) for k in (0, 1))
    assert (len(a), len(b), len(a & b)) == (4, 7, 2 + 1)


def test_one_of_each_class_stays_whatever_its_id(spark):
    """Rows without ids and rows that repeat one are judged by their place; a very long text and texts without words too."""
    long = " ".join(f"w{i}" for i in range(60_000))
    prose = " ".join(f"v{i}" for i in range(50))
    rows = [(None, prose), (None, prose + " x"), (None, prose + " y"), (3, long), (4, long + " x"), (5, "a b c d e f g"), (5, "a b  c d e f g"), (6, None), (7, ""), (None, None), (8, "q r s"), (None, "q r s")]
    kept = near_dedup.dedup(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int").coalesce(1))
    assert kept.columns == ["doc_id", "text", "size"]
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert left == sorted([(None, prose), (3, long), (5, "a b c d e f g"), (6, None), (7, ""), (None, None), (8, "q r s")], key=str)


def weighted_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append(Counter(hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)) or (Counter([hash(tuple(w))]) if w else Counter()))
    return out


def test_recall_on_the_table(spark):
    """All documents whose id is divisible by 50 against all rows of sf0.1, by brute force: every link is within a class."""
    from folioscan.llm.queries import op6_near_dedup

    rows = sorted(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect())
    sets = weighted_sets([r["text"] for r in rows])
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for e, n in s.items():
            where[e].append((k, n))
    got = {r["doc_id"]: r["class_id"] for r in op6_near_dedup(spark, "/root/testdata/sf0.1").collect()}
    links = found = 0
    for k, r in enumerate(rows):
        if r["doc_id"] % 50 == 0:
            common = Counter()
            for e, n in sets[k].items():
                for other, m in where[e]:
                    common[other] += min(n, m)
            for other, c in common.items():
                if other != k and c >= 0.8 * (sets[k].total() + sets[other].total() - c) - 1e-9:
                    links += 1
                    found += got[r["doc_id"]] == got[rows[other]["doc_id"]]
    assert links >= 20 and found == links, (found, links)
