"""Near-duplicate classes: DartMinHash signatures, a banded join, and exact checks.

Texts are weighted sets of shingles of five words (a shorter text with words is
one shingle); a shingle weighs as often as it occurs. Texts with the same set
are one node from the start, whatever their number. Nodes that share a band of
their signatures are candidates:

1. In each bucket every node is paired with the least one, the hub; pairs are
   checked by the exact weighted Jaccard similarity of their shingles, and
   components are found. Thousands of near copies cost one pair for each node and
   hub; the nodes of a hub are dealt over tasks, each of which gets the hub's set once.
2. Where the nodes of a hub still make up several components, those outside the
   largest are compared with all others, in blocks: a block of each side meets
   in one task, overlaps are counted through the shingles that both sides hold,
   and only links that join components are put out. After that any two nodes
   that ever shared a bucket are compared or connected, so no link among
   candidates is lost, and no pair of a large bucket becomes a row.

With 25 bands of 5 a pair at the threshold of 0.8 is missed by all bands once
in 20,000, at 0.85 once in 10 million. Shingles are told apart by 64-bit hashes.

Defined results: texts without words, null texts among them, are alone in their
class; rows that repeat an id are one document, and the classes of their texts are
one; rows with a null id get the class of the rows with the same shingles, or
null if these have no id either; ties go to the least id; very long texts are
looked at as a whole, and a block of comparisons holds so many fewer of them; an
empty table gives an empty result; other columns are not looked at. Identifiers
are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import FILE, ROW, dealt_join, located, maybe_in, without
from folioscan.llm.components import components
from folioscan.llm.dartminhash import band_keys, signatures
from folioscan.llm.textscan import Texts, in_arrow, mix64, slices, texts_of, windows_of, words_of
from folioscan.workspace import persist_table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Nodes of a side that meet in one task, and the shingles that they hold together on average at most.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Nodes of a hub that are checked against it one after the other, and the parts over which a hub's nodes are dealt at most.
HUB_NODES, HUB_PARTS = 256, 4096
#: Nodes of classes without any id are numbered from here up.
NO_ID = (1 << 63) - 1 - (1 << 40)


def by_owner(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The order by owner, one of ``n``, and then hash: one number holds the owner and the upper bits of the hash; where these don't tell hashes apart, both are sorted by."""
    bits = np.uint64(max(1, n.bit_length()))
    key = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)
    order = np.argsort(key)
    key, ranked = key[order], hashes[order]
    if ((key[1:] == key[:-1]) & (ranked[1:] != ranked[:-1])).any():
        return np.lexsort((hashes, owner))
    return order


def shingles_of(texts: Texts, a: int, b: int, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, times) of the distinct shingles of the texts a to b, by owner and then hash."""
    words = words_of(texts, a, b)
    starts = words.starts(b - a)
    hashes, first = windows_of(words, n)
    owner = words.text[first]
    count = np.diff(starts)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        h = np.full(len(short), 0x51ED270B, np.uint64)
        for k in range(n - 1):
            more = count[short] > k
            h[more] = mix64(h[more] * np.uint64(0xD6E8FEB86659FD93) + words.hash[starts[short[more]] + k])
        hashes, owner = np.concatenate([hashes, h]), np.concatenate([owner, short])
    order = by_owner(hashes, owner, b - a)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def spelled_out(hashes: np.ndarray, owner: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sets as plain ones: an element for each time that a shingle occurs, by owner and then element."""
    if not len(times) or times.max() == 1:
        return hashes, owner
    which = np.repeat(np.arange(len(hashes)), times)
    turn = (np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    elements, owner = hashes[which], owner[which]
    again = turn > 0
    elements[again] = mix64(elements[again] + turn[again] * np.uint64(0xA24BAED4963EE407))
    order = by_owner(elements, owner, int(owner[-1]) + 1)
    return elements[order], owner[order]


def sketch(docs: DataFrame) -> DataFrame:
    """(id, text, others) to (id, others, size, d1, d2, bands): the number of shingles, a digest of their weighted set, and band keys."""
    names = [n for n in docs.columns if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts):
                hashes, owner, times = shingles_of(texts, a, b)
                n = b - a
                hashes_in = mix64(hashes + times.astype(np.uint64))
                edge = np.searchsorted(owner, np.arange(n + 1))
                digests = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    sums = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(mix64(hashes_in ^ np.uint64(salt)), out=sums[1:])
                    digests.append(pa.array((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64)))
                weights = np.zeros(len(hashes) + 1, np.int64)
                np.cumsum(times, out=weights[1:])
                keys = band_keys(signatures(hashes, owner, n, BANDS * ROWS, times), ROWS)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, n) for c in names), pa.array(weights[edge[1:]] - weights[edge[:-1]]), *digests, bands], [*names, "size", "d1", "d2", "bands"])

    schema = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    return in_arrow(docs, run, f"{schema}, size long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, text) to (node, shingles): the weighted set spelled out, in order; 64-bit hashes as signed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts):
                elements, owner = spelled_out(*shingles_of(texts, a, b))
                edge = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(edge), pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), sets], ["node", "shingles"])

    return in_arrow(docs, run, "node long, shingles array<long>")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _check(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes and their hubs whose sets are at least so similar."""
    parts = pairs.groupBy("b").agg(F.least(F.ceil(F.count(F.lit(1)) / HUB_NODES), F.lit(HUB_PARTS)).alias("parts")).where("parts > 1")
    dealt = dealt_join(pairs, parts, ["b"], ["a"], "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))
    dealt = persist_table(dealt, "pairs")
    nodes = dealt.hint("merge").join(sets.withColumnRenamed("node", "a"), "a").select("b", "part", F.lit(True).alias("member"), F.col("a").alias("node"), "shingles")
    hubs = dealt.select("b", "part").distinct().hint("merge").join(sets.withColumnRenamed("node", "b"), "b").select("b", "part", F.lit(False).alias("member"), F.col("b").alias("node"), "shingles")
    rows = nodes.unionByName(hubs).repartition("b", "part").sortWithinPartitions("b", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, []
        for batch in batches:  # a hub's own row comes before those of its nodes; an id with several texts has a row for each
            offsets, values = _lists(batch.column("shingles"))
            member = batch.column("member").to_numpy(zero_copy_only=False)
            where = list(zip(batch.column("b").to_pylist(), batch.column("part").to_pylist(), strict=True))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = values[offsets[i] : offsets[i + 1]]
                if not member[i]:
                    at, hub = where[i], [*(hub if at == where[i] else []), x.copy()]
                    continue
                keep[i] = any((common := _common(x, y)) >= threshold * (len(x) + len(y) - common) - 1e-9 for y in hub)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return in_arrow(rows, run, "a long, b long")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)


def _similar(x: list[np.ndarray], y: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets x and y are at least so similar, as a matrix, by the shingles that occur on both sides."""
    nx, ny = np.array([len(s) for s in x], np.float32), np.array([len(s) for s in y], np.float32)
    ax, ay = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(ax, ay)
    common = np.zeros((len(x), len(y)), np.float32)
    rows = []
    for sets, every in ((x, ax), (y, ay)):
        at = np.searchsorted(both, every)
        at[at == len(both)] = 0
        hit = both[at] == every if len(both) else np.zeros(len(every), bool)
        rows.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]))
    for lo in range(0, len(both), 4096):  # so many shingles at once
        part = []
        for (who, at), n in zip(rows, (len(x), len(y)), strict=True):
            here = (at >= lo) & (at < lo + 4096)
            m = np.zeros((n, min(4096, len(both) - lo)), np.float32)
            m[who[here], at[here] - lo] = 1
            part.append(m)
        common += part[0] @ part[1].T
    return common >= threshold * (nx[:, None] + ny[None, :] - common) - 1e-4


def _link_block(table: pa.Table, threshold: float) -> pa.Table:
    """The links of one block of each side that join components not yet joined here."""
    node, root, left = (table.column(c).to_numpy() for c in ("node", "root", "left"))
    shingles = table.column("shingles").combine_chunks()
    offsets, values = _lists(shingles)
    sets = [values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
    xs, ys = np.flatnonzero(left), np.flatnonzero(~left)
    a, b = [], []
    if len(xs) and len(ys):
        found = _similar([sets[i] for i in xs], [sets[i] for i in ys], threshold) & (root[xs][:, None] != root[ys][None, :])
        up: dict[int, int] = {}

        def top(r: int) -> int:
            while up.get(r, r) != r:
                r = up[r]
            return r

        for i, j in zip(*np.nonzero(found), strict=True):
            p, q = top(int(root[xs[i]])), top(int(root[ys[j]]))
            if p != q:
                up[max(p, q)] = min(p, q)
                a.append(int(node[xs[i]]))
                b.append(int(node[ys[j]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _check_rest(stars: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among nodes of the same hub that are in different components; the hub itself has been compared with all."""
    member = stars.select(F.col("b").alias("hub"), F.col("a").alias("node"), "size").join(roots, "node", "left").select("hub", "node", "size", F.coalesce("root", "node").alias("root"))
    member = persist_table(member, "hub-members")
    parts = member.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    main = F.max(F.struct("n", "root", "w"))
    groups = parts.groupBy("hub").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES))
    lefts, rights = blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")), blocks(F.col("n"), F.col("w"))
    groups = persist_table(groups.select("hub", F.col("main.root").alias("main"), lefts.alias("lefts"), rights.alias("rights")), "mixed-hubs")
    mixed = dealt_join(member, groups, ["hub"], ["node"])
    deal = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = mixed.where("root <> main").select("hub", "node", "root", F.lit(True).alias("left"), deal("lefts", 1).alias("i"), every("rights").alias("j"))
    two = mixed.select("hub", "node", "root", F.lit(False).alias("left"), every("lefts").alias("i"), deal("rights", 2).alias("j"))
    met = one.unionByName(two).hint("merge").join(sets, "node")
    return met.groupBy("hub", "i", "j").applyInArrow(lambda t: _link_block(t, threshold), "a long, b long")


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: id, its place (at_file, at_row), class: the least node of its class, null for texts without words.

    Nodes are the least ids of equal sets, and numbers from NO_ID up where there is no id.
    """
    docs = located(docs)
    place = ["at_file", "at_row"]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(FILE).alias("at_file"), F.col(ROW).alias("at_row"))
    rows = persist_table(sketch(docs), "sketches")
    own = F.coalesce("id", F.lit(NO_ID) + F.pmod(F.col("d1"), F.lit(1 << 40)))
    nodes = rows.where("size > 0").groupBy("d1", "d2", "size").agg(F.min("id").alias("id"), F.min(F.struct(*place)).alias("at"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    nodes = persist_table(nodes.withColumn("node", own).drop("id"), "nodes")

    spread = nodes.select(F.explode("bands").alias("band"), "node", "size")
    hubs = spread.groupBy("band").agg(F.min(F.struct("node", "size")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "hub")
    stars = dealt_join(spread, hubs, ["band"], ["node"]).where(F.col("node") != F.col("hub.node"))
    stars = stars.select(F.col("node").alias("a"), "size", F.col("hub.node").alias("b"), F.col("hub.size").alias("hub_size")).distinct()
    stars = persist_table(stars, "stars")
    candidates = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # A node's text is that of one of its rows; an id that has several texts has a node for each.
    candidates = persist_table(nodes.join(candidates, "node", "left_semi").select("node", "size", "at.*"), "candidates")
    texts = maybe_in(docs, place, candidates).hint("merge").join(candidates.select("node", *place), place).select("node", "text")
    sets = persist_table(_sets(texts), "shingle-sets")

    near = F.least("size", "hub_size") >= F.lit(threshold) * F.greatest("size", "hub_size") - 1e-9
    links = persist_table(_check(stars.where(near).select("a", "b"), sets, threshold), "links")
    roots = persist_table(components(links), "star-roots")
    more = _check_rest(stars, roots, sets, threshold)
    shared = nodes.where("copies > 1").select("d1", "d2", "size", "node")
    member = dealt_join(rows.drop("bands"), shared, ["d1", "d2", "size"], place, "left")
    member = persist_table(member.select("id", *place, F.when(F.col("size") > 0, F.coalesce("node", own)).alias("node")), "members")
    several = member.where("id IS NOT NULL AND node IS NOT NULL").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").select("id", "b")
    same_id = dealt_join(member, several, ["id"], place).select(F.col("node").alias("a"), "b").where("a <> b")
    links = persist_table(links.unionByName(more).unionByName(same_id), "links")
    found = dealt_join(member, components(links), ["node"], place, "left")
    return found.select("id", *place, F.coalesce("root", "node").alias("class"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: id, class_id (the least id of its class)."""
    key = F.coalesce("class", "id")
    return membership(docs, id_col, text_col, threshold).select("id", F.when(key < NO_ID, key).alias("class_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all its columns: the least id (null ids last), then the first by file and row. Texts without words all stay."""
    rows, place = located(docs), ["at_file", "at_row"]
    found = persist_table(membership(rows, id_col, text_col, threshold).where("class IS NOT NULL"), "near-classes")
    best = found.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", *place)).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = dealt_join(found, best.select("class", "best"), ["class"], place)
    gone = met.where((F.col("best.at_file") != F.col("at_file")) | (F.col("best.at_row") != F.col("at_row"))).select(F.col("at_file").alias(FILE), F.col("at_row").alias(ROW))
    return without(rows, gone, [FILE, ROW]).select(*docs.columns)
