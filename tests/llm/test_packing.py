"""Packing against the tokenizer library, piece by piece."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from folioscan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, tier string"


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, packing.END_ID] for x in texts]


def check(df, texts):
    rows = packing.pack(df, PATH).collect()
    ids = library_ids(texts)
    seen = {}
    for r in rows:
        want = ids[r["doc_id"]]
        piece = np.array(want[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["length"] == len(piece) > 0 and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(piece.tobytes())
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, want in enumerate(ids):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == len(want)
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= pieces[0]["tier"] <= 4096 and len({(r["tier"], r["step_group"]) for r in pieces}) == 1
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return rows, windows, padding


def test_pieces(spark):
    rng = random.Random(5)
    alphabet = "aB théàñ é \n\t\x00\x1c\x85\xa0 日本😀.,!?'\"s't're0123ΣΑΣ</s> ́ſİ≠"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["", None, " \n", "<|endoftext|> x<|endoftext|>y", "it's we'll don't '' 's", "word, other. " * 9000, "x" * 20_000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], SCHEMA).repartition(3, "doc_id")
    rows, windows, padding = check(df, texts)
    assert padding <= 3 * 4096 and sum(r["length"] for r in rows) == sum(map(len, library_ids(texts)))
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "a b", "z"), (1, "a b", "z"), (None, "c", "z")], SCHEMA).coalesce(1)
    rows = packing.pack(df, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 2), (1, 3), (1, 3)]


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    rows, windows, padding = check(docs, texts)
    total = sum(r["length"] for r in rows)
    assert padding < 0.002 * total
    pieces = Counter(r["doc_id"] for r in rows if r["doc_tokens"] <= 4096)
    assert sum(n > 1 for n in pieces.values()) <= 0.02 * len(pieces)  # the last windows of the partition, mostly
    assert {r["tier"] for r in rows} >= set(packing.TIERS)
    # Full groups of a tier hold the same number of tokens; their costs are near each other.
    cost, size = {}, {}
    for r in rows:
        key = (r["tier"], r["step_group"])
        cost[key] = cost.get(key, 0) + r["length"] ** 2
        size[key] = size.get(key, 0) + r["length"]
    for tier in packing.TIERS:
        full = [cost[k] for k in cost if k[0] == tier and size[k] == 16 * 4096]
        assert not full or max(full) <= 1.25 * min(full)


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 5000)
    text = ("some words, and more; " * 400 + "y" * 7000 + "\n") * 2
    assert b"".join(packing._blocks(text.encode())) == text.encode() and len(list(packing._blocks(text.encode()))) > 2
    enc = packing.WordEncoder(open(PATH, encoding="utf-8").read(), 2)
    whole = enc.ids([text.encode()])[0][:-1]
    assert (np.concatenate([enc.ids([p])[0][:-1] for p in packing._blocks(text.encode())]) == whole).all()


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 50)
    enc = packing.WordEncoder(open(PATH, encoding="utf-8").read(), 2)
    for k in range(5):
        texts = [f"w{k}x{i} z" for i in range(40)]
        ids, ends = enc.ids([t.encode() for t in texts])
        assert [list(map(int, x)) for x in np.split(ids, ends[:-1])] == library_ids(texts)
        assert len(enc.known) < 250


def test_tiers_are_checked():
    with pytest.raises(ValueError, match="powers of two"):
        packing.Packer((512, 1000), 0)


def lengths_packed(lengths, packer=None):
    packer = packer or packing.Packer(packing.TIERS, 0)
    for i, n in enumerate(lengths):
        packer.add(i, np.full(n, i, np.uint32))
    packer.finish()
    windows, pieces = {}, Counter()
    for r in packer.rows:
        windows.setdefault(r[5], []).append(r)
        pieces[r[0]] += 1
    sums = {k: (sum(p[2] for p in v), v[0][7]) for k, v in windows.items()}
    assert sum(s for s, _ in sums.values()) == sum(lengths) and all(s <= t and (s == t or t == 4096) for s, t in sums.values())
    return sum(4096 - s for s, t in sums.values() if s < t), sum(pieces[i] > 1 for i, n in enumerate(lengths) if n <= 4096), Counter(t for _, t in sums.values())


def test_fitting_documents_stay_whole():
    """Lengths of several kinds: hardly any document that fits is cut, and hardly anything is padded."""
    rng = random.Random(1)
    kinds = {
        "prose": [min(30_000, int(rng.lognormvariate(5.6, 1.1)) + 1) for _ in range(20_000)], "short": [rng.randint(1, 80) for _ in range(20_000)],
        "long": [rng.randint(1500, 4096) for _ in range(3000)], "mixed": [rng.choice([3, 700, 700, 2049, 4096, 5000]) for _ in range(6000)],
    }
    for kind, lengths in kinds.items():
        padding, cut, tiers = lengths_packed(lengths)
        assert padding <= 0.005 * sum(lengths), (kind, padding)
        fitting = sum(n <= 4096 for n in lengths)
        assert cut <= {"prose": 0.005, "short": 0.005}.get(kind, 1) * fitting, (kind, cut, fitting)
        if kind == "prose":
            assert set(tiers) >= set(packing.TIERS)


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097], [8192], [63], [4095, 1], [5, 5, 5], [512] * 9, [100_000]])
def test_few_documents(lengths):
    padding, _, _ = lengths_packed(lengths)
    assert padding == 0


def test_sums_of_lengths():
    rng = random.Random(3)
    pool = packing.Pool()
    for n in (rng.randint(1, 60) for _ in range(25)):
        pool.put((0, 0, np.zeros(n), n))
    there = Counter({n: len(p) for n, p in pool.by_length.items()})
    for total in range(1, 130):
        found = pool.sum_of(total)
        if found is not None:
            assert sum(found) == total and not Counter(found) - there
        elif total in there or any(there[total - a] - (2 * a == total) > 0 for a in there):
            raise AssertionError(total)
        fill = pool.filling(total)
        assert sum(fill) <= total and not Counter(fill) - there
    assert there == Counter({n: len(p) for n, p in pool.by_length.items()}) and pool.tokens == sum(n * k for n, k in there.items()) and pool.lengths == sorted(there)
