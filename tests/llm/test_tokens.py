"""Token counts against the library."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from folioscan.llm import tokens, transducer

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ALPHABET = "ab théàñ  \n\t\x00日本😀①.,!?'\"0123▁</s>▁  xyzſ"


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    out += ["", " ", "▁", "<s> x</s>", "a" * 5000, " " * 3000, "x" * 60_000 + " b", "日本" * 3000, "a  b" * 2000]
    solid = ALPHABET.replace(" ", "").replace("▁", "")
    return out + ["".join(rng.choice(solid) for _ in range(4000)) for _ in range(3)]


def machine():
    return tokens.compiled(MODEL)


def test_counts_equal_the_library():
    t = texts()
    assert tokens.count_texts(machine(), [x.encode() for x in t]).tolist() == [len(LIBRARY.encode(x)) for x in t]


@pytest.mark.parametrize("size", [1, 3, 20])
def test_long_texts_in_blocks(size):
    t = [x[:400] for x in texts()[::5]] + ["a ", "a  ", "▁ a", "a ▁ b", " a", "a b ", "  "]
    assert tokens.count_texts(machine(), [x.encode() for x in t], size).tolist() == [len(LIBRARY.encode(x)) for x in t]
    blocks = list(tokens.blocks_of("wörd 日本😀".encode() * 100, 50))
    assert b"".join(blocks).decode() and max(map(len, blocks)) < 54 and all(x.decode() for x in blocks)


@pytest.mark.parametrize("chunk", [1, 2, 7, 100])
def test_maps_of_chunks_compose(chunk):
    m = machine()
    t = [x[:300] for x in texts()[::7]] + ["a" * 700, "aa▁" * 90, "日" * 200]
    classes = m.class_of[np.frombuffer("".join(t).encode("utf-32-le"), "<u4")]
    ends = np.cumsum([len(x) for x in t])
    assert m.count(classes, ends, chunk).tolist() == [len(LIBRARY.encode(x)) for x in t]


def test_maps_hold_several_states_where_nothing_falls_into_step(monkeypatch):
    """Runs of one letter: a wrong guess before a chunk is mended by further states of its map, for all chunks side by side."""
    monkeypatch.setattr(transducer, "LEAD", 3)
    m, widths = machine(), []
    run = m._run
    monkeypatch.setattr(m, "_run", lambda state, *rest: widths.append(len(state)) or run(state, *rest))
    text = "q" + "a" * 20_000
    classes = m.class_of[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    assert m.count(classes, np.array([len(classes)]), 50).tolist() == [len(LIBRARY.encode(text))]
    assert len(widths) < 40  # rounds, not chunks


def test_states_of_the_table_can_be_sent():
    m = machine()
    t = texts()[:500]
    tokens.count_texts(m, [x.encode() for x in t])
    other = transducer.Machine([(p.piece, p.score) for p in sentencepiece_model_pb2.ModelProto.FromString(MODEL).pieces if p.type == p.NORMAL])
    other.load(m.compiled_table())
    n = len(other.keys)
    assert tokens.count_texts(other, [x.encode() for x in t]).tolist() == [len(LIBRARY.encode(x)) for x in t] and len(other.keys) == n


def test_tokens_stay_apart_as_the_library_says():
    """Against merging the pair's characters from the start, the best pair first."""
    m = machine()
    score = {p.piece: p.score for p in sentencepiece_model_pb2.ModelProto.FromString(MODEL).pieces if p.type == p.NORMAL}

    def merged(s):
        parts = list(s)
        while found := max(((score[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in score), default=None):
            i = -found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    runs = [t for t in range(len(m.text)) if m.run[t]]
    assert len(runs) > 10 and all(m.fits(x, y) == (merged(m.text[x] + m.text[y]) == [m.text[x], m.text[y]]) for x in runs for y in runs)
    rng = random.Random(1)
    starts = {}
    for t in range(len(m.text)):
        starts.setdefault(m.text[t][0], []).append(t)
    for _ in range(6000):
        x = rng.randrange(len(m.text))
        follow = [g for g in m.bigrams if g[0] == m.last[x]] if rng.random() < 0.02 else []
        y = rng.choice(starts[m.text[rng.choice(follow)[1]]]) if follow else rng.randrange(len(m.text))
        assert m.fits(x, y) == (merged(m.text[x] + m.text[y]) == [m.text[x], m.text[y]]), (m.text[x], m.text[y])


def test_runs_of_spaces():
    t = ["x" * k + s * n + "y" * k for n in range(80) for s in (" ", "▁") for k in (0, 1)]
    assert tokens.count_texts(machine(), [x.encode() for x in t]).tolist() == [len(LIBRARY.encode(x)) for x in t]


def test_state_table_is_bounded(monkeypatch):
    m = transducer.Machine([(p.piece, p.score) for p in sentencepiece_model_pb2.ModelProto.FromString(MODEL).pieces if p.type == p.NORMAL], max_states=400)
    t = [*texts()[:800], "".join(random.Random(9).choice("abcdefghijklmnop") for _ in range(3000))]
    for k in range(0, 801, 100):
        part = t[k : k + 100]
        assert tokens.count_texts(m, [x.encode() for x in part]).tolist() == [len(LIBRARY.encode(x)) for x in part]
        assert len(m.keys) < 3000


def test_a_long_text_without_a_space():
    """Two megabytes, in seconds; they would be minutes one character at a time."""
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    text = "".join(rng.choice(words) for _ in range(400_000))
    began = time.time()
    got = tokens.count_texts(machine(), [text.encode()])
    assert got.tolist() == [len(LIBRARY.encode(text))] and time.time() - began < 30 and len(text) > 1_900_000


def test_operator(spark):
    rows = [(1, None, 7), (2, "", 7), (2, "two words", 7), (None, "x é", 7), (4, "long " * 5000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tokens.count_tokens(df, PATH).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 4096) for i, t, _ in rows), key=str)
    assert got == want
    assert tokens.count_tokens(df.limit(0), PATH).collect() == []


def test_table(spark):
    from folioscan.llm.queries import op4_token_counts

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op4_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and all(r["n_tokens"] == len(LIBRARY.encode(docs[r["doc_id"]])) for r in rows)


def test_other_models_are_refused():
    proto = sentencepiece_model_pb2.ModelProto.FromString(MODEL)
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="no byte-pair model"):
        tokens.compiled(proto.SerializeToString())
