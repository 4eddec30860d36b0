"""Hierarchical multi-length packing of documents into training sequences.

A document's token ids, closed by an end id, are routed to the shortest context
tier that holds them. A document beyond the longest tier fills windows of that
tier, and only its remainder is routed. Documents wait in a pool of bounded size,
whole. The longest is taken first and a window of its tier is filled exactly with
other whole documents of that tier and shorter ones, found by sums of lengths.
Where no such set is there, the document opens a long window, whose gap is
filled from all tiers, exactly if possible. A long window that stays open by
more than ``SLACK`` tokens is closed with the beginning of another document: only
then, and where a partition ends, is a document that fits into a window cut.
What remains below one long window at the end of a partition goes to full windows
of lesser powers of two. So windows other than the longest are always full.

Full windows of a tier are dealt into step groups of ``step_tokens`` tokens so
that the sum of squared document lengths, which attention pays for, is about
the same in each group: a pool of windows is ranked by it and dealt back and
forth.

Partitions are packed on their own: no shuffle. Window numbers hold the
partition's number, so a task that runs again gives the same rows if its input
does; read the documents from stored files.

Words are tokenised once for each worker and looked up after that.

Defined results: null and empty texts are documents of just the end id;
repeated rows and equal ids are packed each for itself; documents of equal length
are taken the last come first; very long texts are coded in blocks and packed
whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.textscan import IS_SPACE, hash_spans, in_arrow, kept, mix64, release, slices, texts_of

TIERS = (512, 1024, 2048, 4096)
#: Tokens of documents that wait for a window, at most, and so many are left when windows have been made.
POOL_TOKENS = 256 * 4096
#: Tokens by which a long window may stay open.
SLACK = 16
#: First documents that are tried for sums of three.
TRIES = 12
END_ID = 2
STEP_WINDOWS = 16
POOL_GROUPS = 8
#: Some 50 bytes each.
MEMO_WORDS = 800_000
#: Bytes of text that are coded at once; some fifty times as much is needed meanwhile.
BLOCK = 1 << 18


#: The pre-tokenizer whose words are known here, after lower-casing; see ``WordEncoder``.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Apostrophes (contractions), the beginning of special strings, and all beyond U+00FF or no letter.
_ODD = re.compile(rb"['\xc2\xc4-\xff]|\xc3[\x97\xb7]|<\|")
#: In texts without ODD ones: white space 0, letters (with their second bytes) 1, all else 2; and letters of ASCII lowered.
_KIND = np.full(256, 2, np.uint8)
_KIND[IS_SPACE] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def splits_words(serialised: str) -> bool:
    """Whether a tokenizer lower-cases, drops white space and splits by ``SPLIT``; every special string has to begin with "<|", which is odd."""
    spec = json.loads(serialised)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    lowers = {"type": "Lowercase"} in (spec.get("normalizer") or {}).get("normalizers", [])
    special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", []))
    return lowers and special and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("behavior") == "Removed"


class WordEncoder:
    """Ids of texts by a tokenizer, remembered by word within bounds.

    If the tokenizer lower-cases, drops white space and splits by ``SPLIT``, no
    token crosses white space, nor the border of a letter and another character
    among ASCII and the letters up to U+00FF: those runs are coded once, and
    found again by a 64-bit hash. Texts with other characters are remembered by
    what stands between white space.
    Any other tokenizer codes whole texts.
    """

    def __init__(self, serialised: str, end_id: int, by_word: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(serialised)
        self.library.no_truncation()
        self.library.no_padding()
        self.end_id = end_id
        self.by_word = splits_words(serialised) if by_word is None else by_word
        self._clear()

    def _clear(self) -> None:
        #: Hashes of runs and words, sorted, and their places; place 0 is the end of a document.
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat = np.array([self.end_id], np.uint32)
        self.offset = np.array([0], np.int64)
        self.length = np.array([1], np.int64)

    def _places(self, hashes: np.ndarray, word_at) -> np.ndarray:
        """Where the ids of each hash are; those not met before are coded by the library. word_at: bytes of the word at an index."""
        if len(self.known) > MEMO_WORDS:
            self._clear()
        each, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, each)
        inside = np.minimum(at, max(0, len(self.known) - 1))
        met = self.known[inside] == each if len(self.known) else np.zeros(len(each), bool)
        found = self.place[inside] if len(self.known) else np.zeros(len(each), np.int64)
        new = np.flatnonzero(~met)
        if len(new):
            words = [word_at(i).decode() for i in first[new].tolist()]
            coded = [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            ids = np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum()))
            found[new] = len(self.length) + np.arange(len(new))
            self.known, self.place = np.insert(self.known, at[new], each[new]), np.insert(self.place, at[new], found[new])
            self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.flat = np.concatenate([self.flat, ids])
        return found[back]

    def _gather(self, places: np.ndarray, runs: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, which has so many ``runs``, closed by the end id."""
        at = np.insert(places, np.cumsum(runs), 0)
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.offset[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        return np.split(ids, ends[np.cumsum(runs + 1) - 1][:-1])

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Texts without ODD ones: runs of letters and of other characters, found for all texts at once."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum([0, *map(len, texts[:-1])])
        kind = _KIND[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[begins] = True
        edge[len(data)] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        some = kind[starts] != 0
        starts, ends = starts[some], ends[some]
        hashes = hash_spans(_LOWER[data], starts, ends)
        whole = data.tobytes()
        places = self._places(hashes, lambda i: whole[starts[i] : ends[i]])
        return self._gather(places, np.diff(np.searchsorted(starts, np.append(begins, len(data)))))

    def _by_space(self, text: bytes) -> np.ndarray:
        """Any text: what stands between white space."""
        words = text.split()
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = ends - np.array([len(w) for w in words], np.int64)
        # Apart from the runs of plain texts, whose letters are lowered.
        hashes = mix64(hash_spans(data, starts, ends) + np.uint64(1))
        return self._gather(self._places(hashes, lambda i: words[i]), np.array([len(words)]))[0]

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by the end id, and where each text ends."""
        if not self.by_word:
            coded = [np.array([*x.ids, self.end_id], np.uint32) for x in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        else:
            odd = [bool(_ODD.search(t)) for t in texts]
            plain = [t for t, o in zip(texts, odd, strict=True) if not o]
            rest = iter(self._plain(plain) if plain else [])
            coded = [self._by_space(t) if o else next(rest) for t, o in zip(texts, odd, strict=True)]
        return np.concatenate([np.zeros(0, np.uint32), *coded]), np.cumsum([len(x) for x in coded], dtype=np.int64)


_encoders: dict[tuple[str, int], WordEncoder] = kept(__name__)


def encoder_of(serialised: str, end_id: int, by_word: bool) -> WordEncoder:
    """The worker's encoder: what one task has learned serves the next, until a task of another operator begins."""
    key = (serialised, end_id)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(serialised, end_id, by_word)
        release()
    return _encoders[key]


def _blocks(text: bytes) -> Iterator[bytes]:
    """A long text in blocks that end at white space."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and not IS_SPACE[data[end]]:
            step = np.flatnonzero(IS_SPACE[data[end : end + 65536]])
            end = end + int(step[0]) if len(step) else min(len(text), end + 65536)
        yield text[at:end]
        at = end


class Pool:
    """Pieces of documents by length."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.lengths: list[int] = []  # in order
        self.tokens = 0

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        if n not in self.by_length:
            self.by_length[n] = []
            insort(self.lengths, n)
        self.by_length[n].append(piece)
        self.tokens += n

    def take(self, n: int) -> tuple:
        pieces = self.by_length[n]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[n]
            del self.lengths[bisect_left(self.lengths, n)]
        self.tokens -= n
        return piece

    def _pair(self, total: int) -> list[int] | None:
        """One or two lengths of that sum."""
        if total in self.by_length:
            return [total]
        there = self.by_length
        for a in self.lengths[: bisect_right(self.lengths, total // 2)]:
            if total - a in there and (2 * a < total or len(there[a]) > 1):
                return [total - a, a]
        return None

    def sum_of(self, total: int) -> list[int] | None:
        """Up to three lengths that are there and make up ``total``; None if none are found."""
        if not total:
            return []
        found = self._pair(total)
        below = self.lengths[: bisect_left(self.lengths, total)]
        for a in below[-TRIES:][::-1] if found is None else []:
            piece = self.take(a)
            rest = self._pair(total - a)
            self.put(piece)
            if rest:
                return [a, *rest]
        return found

    def filling(self, gap: int) -> list[int]:
        """Lengths that are there and fill the gap, exactly if such are found, the longest first."""
        taken, out = [], []
        while (exact := self.sum_of(gap)) is None and self.lengths and self.lengths[0] <= gap:
            n = self.lengths[bisect_right(self.lengths, gap) - 1]
            taken.append(self.take(n))
            out.append(n)
            gap -= n
        for piece in taken:
            self.put(piece)
        return [*out, *(exact or [])]


class Packer:
    """Packs the documents of one partition; ``rows`` fills with finished pieces."""

    def __init__(self, tiers: Sequence[int], partition: int):
        if sorted(tiers) != list(tiers) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be powers of two in ascending order")
        self.tiers = tuple(tiers)
        self.base = partition << 32
        self.pool = Pool()
        self.pools: dict[int, list] = {}
        self.sequences = self.groups = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, top = len(ids), self.tiers[-1]
        whole = n // top * top if n > top else 0
        for start in range(0, whole, top):
            self._close(top, [(doc, start, ids[start : start + top], n)])
        if whole < n:
            self.pool.put((doc, whole, ids[whole:].copy(), n))
        if self.pool.tokens >= POOL_TOKENS:
            while self.pool.tokens > POOL_TOKENS // 2:
                self._window()

    def _window(self) -> None:
        """Make a window around the longest piece that waits."""
        pool, top = self.pool, self.tiers[-1]
        first = pool.take(pool.lengths[-1])
        n = len(first[2])
        tier = next(t for t in self.tiers if n <= t)
        exact = pool.sum_of(tier - n)
        if exact is None:
            tier, exact = top, pool.filling(top - n)
        pieces = [first, *(pool.take(k) for k in exact)]
        gap = tier - n - sum(exact)
        if gap > SLACK and pool.tokens >= gap:
            pieces += self._cut(gap)
        self._close(tier, pieces)

    def _cut(self, gap: int) -> list[tuple]:
        """Pieces of ``gap`` tokens, all but the last of them whole, the rest of that one going back."""
        out = []
        while gap:
            doc, start, ids, n = self.pool.take(self.pool.lengths[-1])
            if len(ids) > gap:
                self.pool.put((doc, start + gap, ids[gap:], n))
            out.append((doc, start, ids[:gap], n))
            gap -= len(out[-1][2])
        return out

    def _close(self, tier: int, pieces: list) -> None:
        closed, offset = [], 0
        for doc, start, ids, doc_tokens in pieces:
            closed.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, self.base | self.sequences, offset, tier))
            offset += len(ids)
        self.sequences += 1
        pool = self.pools.setdefault(tier, [])
        pool.append((sum(p[2] ** 2 for p in closed), closed))
        if len(pool) == self._group_size(tier) * POOL_GROUPS:
            self._deal(tier)

    def _group_size(self, tier: int) -> int:
        return max(1, STEP_WINDOWS * self.tiers[-1] // tier)

    def _deal(self, tier: int) -> None:
        pool = self.pools.pop(tier, [])
        groups = -(-len(pool) // self._group_size(tier))
        for rank, (_, closed) in enumerate(sorted(pool, key=lambda x: -x[0])):
            turn, place = divmod(rank, groups)
            group = self.base | (self.groups + (place if turn % 2 == 0 else groups - 1 - place))
            self.rows += [(*p, group) for p in closed]
        self.groups += groups

    def finish(self) -> None:
        """Make windows of what waits, the last of them of lesser powers of two, and deal the last groups."""
        while self.pool.tokens >= self.tiers[-1]:
            self._window()
        while self.pool.tokens:
            size = 1 << (self.pool.tokens.bit_length() - 1)
            exact = self.pool.sum_of(size)
            self._close(size, self._cut(size) if exact is None else [self.pool.take(k) for k in exact])
        for tier in sorted(self.pools):
            self._deal(tier)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: Sequence[int] = TIERS, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    tier is the window's length; only windows that are not full are padded. The
    tokenizer is read on the driver and sent along.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        serialised = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((serialised, end_id, splits_words(serialised)))  # some megabytes
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    if out_type == pa.string():
        rows = rows.withColumn("id", F.col("id").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(*sent.value)
        packer = Packer(tiers, TaskContext.get().partitionId())

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * len(NAMES)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], out_type), *(pa.array(c, pa.int64()) for c in columns[1:])], NAMES)

        for batch in batches:
            texts, names = texts_of(batch.column("text")), batch.column("id").to_pylist()
            for a, b in slices(texts, BLOCK):
                at = texts.offsets[a : b + 1]
                parts = [texts.data[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                if encoder.by_word and len(parts) == 1 and len(parts[0]) > BLOCK:
                    coded = [encoder.ids([p])[0][:-1] for p in _blocks(parts[0])]
                    packer.add(names[a], np.concatenate([*coded, np.array([end_id], np.uint32)]))
                else:
                    ids, ends = encoder.ids(parts)
                    for name, x, y in zip(names[a:b], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                        packer.add(name, ids[x:y])
                if packer.rows:
                    yield flush()
            release()
        packer.finish()
        yield flush()

    return in_arrow(rows, run, f"doc_id {'bigint' if out_type == pa.int64() else 'string'}, " + ", ".join(f"{n} bigint" for n in NAMES[1:]))
