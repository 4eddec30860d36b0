"""Token counts of whole texts, by the finite-state machine of ``transducer``.

Counts are those of the sentencepiece library for the same model: no begin or
end tokens, control strings inside a text are ordinary text. Models have to be
byte-pair models that keep characters as they are (identity normalisation with
space marks and a mark in front); others raise ValueError.

The driver compiles the machine from the vocabulary and from the transitions that
a bounded sample of texts meets, and sends it along; workers add what they meet
besides. The sample changes speed alone, never a count. A text beyond ``BLOCK``
bytes goes through the machine block by block, its state carried on.

Defined results: null text counts as empty and has no tokens; repeated rows and
ties need no care, as rows are independent; very long texts are counted whole; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from folioscan.llm.textscan import in_arrow, slices, texts_of
from folioscan.llm.transducer import SPACE, Machine

LIMIT = 4096
#: Bytes of text whose chunks run side by side.
BLOCK = 1 << 21
#: The sample whose transitions are compiled on the driver: so many texts of up to so many bytes.
SAMPLE_TEXTS, SAMPLE_BYTES = 256, 8192

_machines: dict[bytes, Machine] = {}


def compiled(model: bytes, table: tuple | None = None) -> Machine:
    """The machine of a serialised model, once for each worker; table: see ``Machine.load``."""
    if model not in _machines:
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        n, t = proto.normalizer_spec, proto.trainer_spec
        plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not t.treat_whitespace_as_suffix and t.byte_fallback
        if not plain or t.model_type != t.BPE:
            raise ValueError("the model is no byte-pair model that keeps characters as they are")
        pieces = [(p.piece, p.score) for p in proto.pieces if p.type == p.NORMAL]
        often = Counter(s for p, s in pieces if len(p) > 1)
        runs = sorted(p for p, _ in pieces if len(p) > 1 and not p.strip(SPACE))
        tied = sorted(p for p, s in pieces if len(p) > 1 and often[s] > 1)
        # Pieces that share a score have no order of merges, but for runs of the space mark below all others.
        grow = set(tied) <= set(runs) and (not tied or tied == runs and dict(pieces)[runs[0]] == min(often))
        inside = any(SPACE in p.lstrip(SPACE) for p, _ in pieces if p not in runs)
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces) or inside or not grow:
            raise ValueError("the model has pieces that the machine does not know")
        machine = Machine(pieces)
        if table:
            machine.load(table)
        _machines[model] = machine
    return _machines[model]


def blocks_of(text: bytes, size: int) -> Iterator[bytes]:
    """A text in blocks of about ``size`` bytes that hold whole characters."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        yield text[at:end]
        at = end


def _classes(machine: Machine, data: bytes) -> np.ndarray:
    return machine.class_of[np.frombuffer(data.decode().encode("utf-32-le"), "<u4")]


def count_texts(machine: Machine, texts: list[bytes], size: int = BLOCK) -> np.ndarray:
    """Tokens of each text."""
    out, short = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        if len(text) <= size:
            short.append(i)
            continue
        key, out[i] = None, 1  # the space mark in front
        for block in blocks_of(text, size):
            classes = _classes(machine, block)
            (key,), added = machine.go_on([key], classes, np.array([len(classes)]))
            out[i] += added[0]
    if short:
        lengths = [len(texts[i].decode()) for i in short]
        out[short] = machine.count(_classes(machine, b"".join(texts[i] for i in short)), np.cumsum(lengths))
    return out


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row for each document: id, n_bytes, n_tokens, over_limit. The model is read on the driver and sent along, with the compiled table."""
    with open(model_path, "rb") as f:
        model = f.read()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    _machines.clear()
    machine = compiled(model)  # raises here for a model of another kind
    sample = [r["text"].encode() for r in rows.where(F.octet_length("text") <= SAMPLE_BYTES).select("text").limit(SAMPLE_TEXTS).collect()]
    count_texts(machine, sample)
    sent = docs.sparkSession.sparkContext.broadcast((model, machine.compiled_table()))  # bounded by the sample: some ten megabytes
    _machines.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(*sent.value)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts, BLOCK):
                data, at = texts.data[texts.offsets[a] : texts.offsets[b]].tobytes(), texts.offsets[a : b + 1] - texts.offsets[a]
                n_tokens = count_texts(machine, [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(np.diff(at)), pa.array(n_tokens), pa.array(n_tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"]
                )

    return in_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
