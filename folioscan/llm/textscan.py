"""Words, hashes and counts of many texts at once, over the UTF-8 bytes of Arrow columns.

Nothing here looks at one character at a time: bytes are classified by table,
words found at the borders of white space, and each word hashed by a difference
of prefix sums. Texts are taken in slices of bounded size; a text beyond that
is read in blocks that end at white space. What is kept of a text is some 24 bytes
for each of its words, so memory is bounded by ``BLOCK`` and, beyond that, by a few
times the size of the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 19
#: Bytes of an Arrow batch on its way to a worker, and rows that a Parquet reader holds decoded at once; an executor has several of either.
ARROW_BYTES, READ_ROWS = 2 << 20, 1024

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018  raises where there is none
except (OSError, AttributeError):
    _libc = None

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that begin a code point.
IS_FIRST = (np.arange(256) & 0xC0) != 0x80

_BYTE_VALUE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def release() -> None:
    """Give memory that is free again back to the system; workers live on between tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


#: What operators keep in a worker from task to task, by their modules.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """Where the tasks of a module keep what serves the next of them; emptied when a task of another module begins in the worker."""
    return _kept.setdefault(owner, {})


def forget(owner: str) -> None:
    """Empty what modules besides ``owner`` have kept."""
    others = [found for name, found in _kept.items() if name != owner and found]
    for found in others:
        found.clear()
    if others:
        release()


def releasing(run):
    """An Arrow function that calls ``forget`` when its task begins and ``release`` when it has ended."""
    owner = run.__module__

    def wrapped(batches):
        forget(owner)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def in_arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in batches of bounded size, whose workers give memory back.

    Spark says how large batches are by settings of the session, looked at when a
    plan runs; so larger values there are lowered for good. A row beyond it is a batch of its own.
    """
    conf = rows.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        said = str(conf.get(key)).removesuffix("b")
        if not said.isdigit() or not 0 < int(said) <= most:
            conf.set(key, str(most))
    return rows.mapInArrow(releasing(run), schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get(0, ((),))[0]):
        size = max(n, 1 << 16)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[0] = tuple(tables)
    up, down = _powers[0]
    return up[:n], down[:n]


@dataclass
class Texts:
    """Bytes of a run of texts: text k is data[offsets[k]:offsets[k + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[ends[0] : ends[-1]], ends - ends[0])


def slices(texts: Texts, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts with up to ``block`` bytes, or one longer text each."""
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(texts.offsets, texts.offsets[a] + block, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


@dataclass
class Words:
    """Words of a run of texts, in order: hash, the text's number in the run, byte length."""

    hash: np.ndarray
    text: np.ndarray
    length: np.ndarray

    def starts(self, n: int) -> np.ndarray:
        """Where the words of each text begin, and the end: n + 1 numbers."""
        return np.searchsorted(self.text, np.arange(n + 1))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes data[start:end] of each span; equal bytes have equal hashes anywhere."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = _BYTE_VALUE[data]
    values *= up[:-1]
    np.cumsum(values, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _words_of_block(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """breaks: places at which a text begins."""
    space = IS_SPACE[data]
    new = np.zeros(len(data) + 1, bool)
    new[breaks] = True
    new[-1] = True
    inside = ~space
    after_gap = np.empty(len(data), bool)
    after_gap[0] = True
    after_gap[1:] = space[:-1]
    before_gap = np.empty(len(data), bool)
    before_gap[-1] = True
    before_gap[:-1] = space[1:]
    starts = np.flatnonzero(inside & (after_gap | new[:-1]))
    ends = np.flatnonzero(inside & (before_gap | new[1:])) + 1
    return starts, ends, hash_spans(data, starts, ends)


def words_of(texts: Texts, a: int, b: int, block: int = BLOCK) -> Words:
    """Words of the texts a to b."""
    lo, hi = int(texts.offsets[a]), int(texts.offsets[b])
    parts, at = [], lo
    begins = texts.offsets[a:b]
    while at < hi:
        end = min(hi, at + block)
        while end < hi:  # not within a word
            gaps = np.flatnonzero(IS_SPACE[texts.data[max(at, end - 65536) : end]])
            if len(gaps):
                end = max(at, end - 65536) + int(gaps[-1]) + 1
                break
            end = min(hi, end + 65536)
        inner = begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)] - at
        starts, ends, hashes = _words_of_block(texts.data[at:end], inner)
        parts.append((hashes, np.searchsorted(begins, starts + at, "right") - 1, ends - starts))
        at = end
    if not parts:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Words(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def windows_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the number of the first word of each."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words.hash[:count].copy()
    for k in range(1, n):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words.hash[k : k + count]
    first = np.flatnonzero(words.text[:count] == words.text[n - 1 :])
    return mix64(h[first]), first


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise array over each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
