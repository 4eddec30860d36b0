"""Quality classifier: a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover the whole of it. Each byte has
a learned vector, filters of ``WIDTH`` bytes run over these, and each filter's
greatest answer in a chunk describes the chunk. The chunks' greatest and mean
answers together give the logit of the text by learned weights.

Scoring multiplies no matrices at bytes: byte vectors and filters are folded
into a table for each pair of positions in a filter, from pairs of byte classes
to answers, so a filter bank costs ``WIDTH / 2`` lookups a byte. Bytes beyond the
``CLASSES - 1`` most common of the training sample share one class.

The network is trained on the driver from a bounded sample of labelled texts:
the ``TRAIN_ROWS`` with the least hash of their id, whole, as long as they hold
``TRAIN_BYTES`` together; a text that would go beyond that is left to others. It
learns from all chunks of a text at once, as it scores, and beside that from
short runs of each text, so that short texts are scored well. Only texts and
labels are looked at. The seed is fixed, so reruns agree.

Defined results: null text is empty; an empty text is scored as one blank
chunk; repeated rows score alike, and so do ties; a very long text is scored by
all its chunks, one at a time; an empty table gives an empty result; other
columns are not looked at. Labels that are null or contradict each other are left
out; without both labels in the sample the score is the share of label 1, or 0.5
if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.textscan import in_arrow, slices, texts_of
from folioscan.workspace import persist_table

#: The sample to learn from: so many texts at most, of so many bytes together.
TRAIN_ROWS, TRAIN_BYTES = 3000, 16 << 20
#: Bytes of the short runs that are learned beside whole texts, and what such a run weighs against a text.
SHORT_BYTES, SHORT_WEIGHT = (12, 400), 0.4
FILTERS = 16
WIDTH = 8
VECTOR = 8
CLASSES = 128
CHUNK = 2048
OVERLAP = 64
EPOCHS = 10
BATCH = 24
RATE = 0.004
SEED = 7


@dataclass
class Network:
    class_of: np.ndarray  # byte -> class
    vectors: np.ndarray  # class -> vector
    filters: np.ndarray  # WIDTH x VECTOR x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS: greatest, then mean over chunks
    out_bias: float


def pair_tables(vectors: np.ndarray, filters: np.ndarray) -> list[np.ndarray]:
    """For each pair of positions of a filter, answers by pair of classes."""
    single = [(vectors @ filters[k]).astype(np.float32) for k in range(WIDTH)]
    return [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(CLASSES * CLASSES, FILTERS) for k in range(0, WIDTH, 2)]


def answers(tables: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """Of each filter at each place of a run of at least WIDTH byte classes."""
    pair = classes[:-1] * CLASSES + classes[1:]
    n = len(classes) - WIDTH + 1
    z = tables[0].take(pair[:n], axis=0)
    for k, t in enumerate(tables[1:], 1):
        z += t.take(pair[2 * k : 2 * k + n], axis=0)
    return z


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _short(text: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    size = int(rng.integers(*SHORT_BYTES))
    at = int(rng.integers(0, max(1, len(text) - size + 1)))
    return text[at : at + size]


def _chunks(byte: np.ndarray) -> list[np.ndarray]:
    """Overlapping chunks that cover a run of byte classes."""
    byte = np.pad(byte, (0, max(0, WIDTH - len(byte))))
    return [byte[a : a + CHUNK] for a in range(0, max(1, len(byte) - OVERLAP), CHUNK - OVERLAP)]


def train(texts: list[bytes], labels: np.ndarray) -> Network:
    rng = np.random.default_rng(SEED)
    seen = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
    class_of = np.zeros(256, np.int64)
    class_of[np.argsort(-seen, kind="stable")[: CLASSES - 1]] = np.arange(1, CLASSES)
    p = {
        "v": rng.normal(0, 0.3, (CLASSES, VECTOR)), "w": rng.normal(0, 0.7 / (WIDTH * VECTOR) ** 0.5, (WIDTH * VECTOR, FILTERS)),
        "b": np.zeros(FILTERS), "o": rng.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1),
    }
    p = {k: x.astype(np.float32) for k, x in p.items()}
    first = {k: np.zeros_like(x) for k, x in p.items()}
    second = {k: np.zeros_like(x) for k, x in p.items()}
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])
    weight = 0.5 / share[labels]
    step = 0
    blank = class_of[np.full(1, 0x20)]
    coded = [class_of[np.frombuffer(t, np.uint8)] if t else blank for t in texts]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(order), BATCH):
            g = {k: np.zeros_like(x) for k, x in p.items()}
            tables = pair_tables(p["v"], p["w"].reshape(WIDTH, VECTOR, FILTERS))
            batch = [(i, run, w) for i in order[at : at + BATCH] for run, w in ((coded[i], 1.0), (_short(coded[i], rng), SHORT_WEIGHT))]
            for i, run, w in batch:
                cuts = _chunks(run)
                tops, where = np.empty((len(cuts), FILTERS), np.float32), np.empty((len(cuts), FILTERS), np.int64)
                for n, c in enumerate(cuts):
                    z = answers(tables, c)
                    where[n] = z.argmax(0)
                    tops[n] = z[where[n], np.arange(FILTERS)]
                h = np.maximum(tops + p["b"], 0)
                feats = np.concatenate([h.max(0), h.mean(0)])
                err = (_sigmoid(feats @ p["o"] + p["c"][0]) - labels[i]) * weight[i] * w / BATCH
                g["o"] += err * feats
                g["c"] += err
                dh = np.tile(err * p["o"][FILTERS:] / len(cuts), (len(cuts), 1))
                dh[h.argmax(0), np.arange(FILTERS)] += err * p["o"][:FILTERS]
                dh *= h > 0
                g["b"] += dh.sum(0)
                # The bytes under each filter where it answered most, chunk after chunk in one run.
                flat = np.concatenate(cuts)
                begins = np.cumsum([0, *map(len, cuts[:-1])])
                under = flat[(begins[:, None] + where)[:, None, :] + np.arange(WIDTH)[None, :, None]]  # chunks x WIDTH x FILTERS
                g["w"] += np.einsum("cwfv,cf->wvf", p["v"][under], dh).reshape(WIDTH * VECTOR, FILTERS)
                back = p["w"].reshape(WIDTH, VECTOR, FILTERS).transpose(0, 2, 1)[None] * dh[:, None, :, None]
                np.add.at(g["v"], under.ravel(), back.reshape(-1, VECTOR).astype(np.float32))
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return Network(class_of, p["v"], p["w"].reshape(WIDTH, VECTOR, FILTERS), p["b"], p["o"], float(p["c"][0]))


class Scorer:
    def __init__(self, net: Network):
        self.net, self.tables = net, pair_tables(net.vectors, net.filters)

    def tops(self, byte: np.ndarray) -> np.ndarray:
        """The greatest answer of each filter in a run of bytes, at every place."""
        c = self.net.class_of[byte]
        return answers(self.tables, np.pad(c, (0, max(0, WIDTH - len(c))))).max(0)

    def score(self, text: np.ndarray) -> float:
        if not len(text):
            text = np.full(1, 0x20, np.uint8)
        tops = [self.tops(text[a : a + CHUNK]) for a in range(0, max(1, len(text) - OVERLAP), CHUNK - OVERLAP)]
        h = np.maximum(np.stack(tops) + self.net.bias, 0)
        return float(_sigmoid(np.concatenate([h.max(0), h.mean(0)]) @ self.net.out + self.net.out_bias))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, n_bytes: int = TRAIN_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` labelled texts of ``n_bytes`` together that are not held out, the least by the hash of their id; half of each label if there are enough."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2")
    turn = F.md5(F.col(id_col).cast("string").cast("binary"))
    picked = [r for y in (0, 1) for r in one.where(F.col("y") == y).orderBy(turn, id_col).limit(rows // 2).select(F.col(id_col).alias("id"), "y", turn.alias("turn")).collect()]
    if not picked:
        return [], np.zeros(0, np.int64)
    near = F.broadcast(docs.sparkSession.createDataFrame(picked, one.select(F.col(id_col).alias("id"), "y", turn.alias("turn")).schema))  # at most ``rows`` rows
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(near, "id")
    # Of rows that repeat an id the least text counts.
    found = persist_table(found.groupBy("id", "y", "turn").agg(F.min("text").alias("text")), "training-texts")
    fit, left = [], n_bytes
    for r in sorted(found.select("id", "turn", F.octet_length("text").alias("size")).collect(), key=lambda r: (r["turn"], str(r["id"]))):
        if r["size"] <= left:
            fit.append(r["id"])
            left -= r["size"]
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fit], found.select("id").schema))
    got = sorted(found.join(chosen, "id", "left_semi").collect(), key=lambda r: str(r["id"]))
    return [r["text"].encode() for r in got], np.array([int(r["y"]) for r in got], np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Network | float:
    """The network, or a constant score if the labels tell nothing."""
    texts, y = sample(docs, labels, id_col, text_col, label_col, rows)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return train(texts, y)


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: id, score, and a struct ``kept_columns`` of the columns of ``keep``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*keep).alias("kept_columns")] if keep else []))
    names = [n for n in rows.columns if n != "text"]
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), "score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if isinstance(sent.value, float) else Scorer(sent.value)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts):
                at = texts.offsets[a : b + 1]
                scores = [sent.value if scorer is None else scorer.score(texts.data[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, b - a) for n in names), pa.array(scores, pa.float64())], [*names, "score"])

    return in_arrow(rows, run, schema)


def keep_good(docs: DataFrame, model: Network | float, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text scores at least ``least``, with all their columns."""
    if isinstance(model, float):  # the labels tell nothing
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = texts_of(batch.column(place))
            scores = [scorer.score(texts.data[x:y]) for x, y in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
            yield batch.filter(pa.array([s >= least for s in scores], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
