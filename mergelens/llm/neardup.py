"""Near-duplicate documents: MinHash bands name the candidates, exact similarity of whole shingle sets decides.

Two texts are near duplicates where the Jaccard similarity of their sets of word 5-shingles is ``SIMILARITY`` or more.
``BANDS`` bands of ``ROWS`` minima each meet in one band at least with probability 1 - (1 - s^ROWS)^BANDS: all but 6 in a
million pairs at s = 0.8, and fewer above it. Of texts that share a cell, a pair is a candidate only where enough of all minima
agree, by four bits of each: ``MISS`` is the probability that a pair of just s fails, and pairs below about 0.67 rarely pass,
so a passage that many texts share doesn't chain them together. Candidates that hang together are compared with their whole
sets, so no link rests on an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.llm._store import keyed, materialise
from mergelens.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
#: How probable it may be that a pair of just the similarity asked for has fewer agreeing minima than the cutoff.
MISS = 1e-6
#: Nodes of a cell that one task compares.
CELL_CAP = 2048
SEED = 42
BLOCK = 1 << 12  # shingles whose minima are taken at once
_RNG = np.random.default_rng(SEED)
FACTORS = _RNG.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
SHIFTS = _RNG.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32)
MIX = _RNG.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)
SALT = _RNG.integers(0, 2**64, BANDS, np.uint64)
#: How many halves of a byte are zero.
HALVES = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], np.uint8)
_MASK = 2**64 - 1


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: lower() maps A-Z alone, split() cuts at \x20 and \x09-\x0d


def _shingles(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-shingles; fewer than ``n`` words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, lens = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    n = min(n, len(words))
    first, last = (ends - lens)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def _minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), BLOCK):
        np.minimum(low, (FACTORS * h[k : k + BLOCK] + SHIFTS).min(axis=1), out=low)
    return low


def _cells(low: np.ndarray) -> np.ndarray:
    """The cell of each band of minima."""
    return (low.reshape(BANDS, ROWS).astype(np.uint64) * MIX).sum(axis=1, dtype=np.uint64) ^ SALT


def _sketch(low: np.ndarray) -> bytes:
    """Four bits of each minimum."""
    bits = ((low * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return (bits[::2] << np.uint8(4) | bits[1::2]).tobytes()


@cache
def cutoff(similarity: float) -> int:
    """The least number of agreeing minima that ``similarity`` leaves possible but for a probability of ``MISS``; those that
    differ agree by chance in one case of sixteen."""
    n, p, below = BANDS * ROWS, similarity + (1 - similarity) / 16, 0.0
    for c in range(n):
        below += comb(n, c) * p**c * (1 - p) ** (n - c)
        if below > MISS:
            return c
    return n


def _forest(sketches: np.ndarray, side: np.ndarray, cut: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of sketches with ``cut`` agreeing minima. Side 0 meets all, 1 and 2 only each other."""
    left, queue = np.arange(len(sketches)), []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        i = queue.pop()
        near = HALVES[sketches[left] ^ sketches[i]].sum(axis=1, dtype=np.int64) >= cut
        if side[i]:
            near &= side[left] != side[i]
        for j in left[near].tolist():
            yield i, j
            queue.append(j)
        left = left[~near]


def _similar(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of non-empty sets that are similar. Each set is held against those of fitting size
    that no link has reached yet, so a group of near copies costs about one comparison a member."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    end = np.cumsum(size)
    mine = [flat[e - s : e] for s, e in zip(size.tolist(), end.tolist(), strict=True)]
    mark = np.zeros(int(flat.max()) + 1, bool)
    left, held = np.arange(len(order)), flat  # those not reached, by size, and their shingles
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            held, left = held[size[left[0]] :], left[1:]
            continue
        i = queue.pop()
        sizes = size[left]
        a, b = np.searchsorted(sizes, similarity * size[i] - 1e-6), np.searchsorted(sizes, size[i] / similarity + 1e-6, "right")
        if a == b:
            continue
        begins = np.cumsum(sizes) - sizes
        mark[mine[i]] = True
        hits = np.add.reduceat(mark[held[begins[a] : begins[b - 1] + sizes[b - 1]]], begins[a:b] - begins[a], dtype=np.int64)
        mark[mine[i]] = False
        near = np.zeros(len(left), bool)
        near[a:b] = hits >= similarity * (size[i] + sizes[a:b] - hits) - 1e-9
        if near.any():
            for j in left[near].tolist():
                yield order[i], order[j]
                queue.append(j)
            held, left = held[np.repeat(~near, sizes)], left[~near]


def _links(sets: DataFrame, similarity: float, cap: int) -> DataFrame:
    """(a, b): links of similar nodes, enough to connect all that are similar. ``sets``: component, node, size, shingles.

    A component of candidates of more than ``cap`` shingles is dealt to blocks and each pair of blocks is compared on its
    own, so no task holds a whole large component and no pair is lost.
    """
    # a table, so that the join has an exchange on either side and a large component's rows are split among tasks
    totals = materialise(sets.groupBy("component").agg(F.ceil(F.sum("size") / cap).cast("int").alias("k")), "near-totals")
    k = F.col("k")
    dealt = sets.join(totals, "component").withColumn("own", F.pmod(F.xxhash64("node"), k).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    # a block stands in a pair with each other one, and alone only where there is no other
    dealt = dealt.where("k = 1 or own <> other").select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {}

        def out() -> pa.RecordBatch:
            nodes = list(group)
            found = list(_similar([np.frombuffer(s, np.uint64) for s in group.values()], similarity)) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])

        for b in batches:
            for key, node, s in zip(b.column("key").to_pylist(), b.column("node").to_pylist(), b.column("shingles"), strict=True):
                if key != now:
                    if group:
                        yield out()
                    now, group = key, {}
                group[node] = s.as_py()
        if group:
            yield out()

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def _candidates(nodes: DataFrame, similarity: float, cell_cap: int) -> DataFrame:
    """(a, b): pairs that share a cell and pass by their sketches, enough to connect all such pairs. ``nodes``: node, cells,
    sketch.

    Cells of the same nodes, as a group of few copies has many, are compared once: they are told by two 64-bit sums over their
    nodes. A cell of more than ``cell_cap`` nodes is dealt to blocks and each pair of blocks is a task's work.
    """
    placed = materialise(nodes.select("node", F.explode("cells").alias("cell")), "near-cells")
    sums = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"sum{i}") for i in range(2)]
    full = placed.groupBy("cell").agg(F.count("*").alias("members"), *sums).where("members > 1")
    shared = materialise(full.groupBy("members", "sum0", "sum1").agg(F.min("cell").alias("cell")).select("cell", "members"), "near-shared")
    met = materialise(placed.join(shared, "cell"), "near-met")
    # a table, so that the join has an exchange on either side
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = met.join(nodes.select("node", "sketch"), "node").withColumn("blocks", F.ceil(F.col("members") / cell_cap).cast("int")).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte")
    rows = rows.select("cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), side.alias("side"), "node", "sketch")
    cut = cutoff(similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            nodes = np.array([n for n, _, _ in held], np.int64)
            sketches = np.frombuffer(b"".join(s for _, _, s in held), np.uint8).reshape(len(held), -1)
            found = np.array(list(_forest(sketches, np.array([x for _, x, _ in held]), cut)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(nodes[found[:, 0]]), pa.array(nodes[found[:, 1]])], ["a", "b"])

        for b in batches:
            for cell, p, q, *row in zip(*[b.column(c).to_pylist() for c in ("cell", "p", "q", "node", "side", "sketch")], strict=True):
                if (cell, p, q) != now:
                    if len(held) > 1:
                        yield out()
                    now, held = (cell, p, q), []
                held.append(row)
        if len(held) > 1:
            yield out()

    return rows.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q").mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, cap: int = 1 << 20, cell_cap: int = CELL_CAP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, th, group): documents of one group are joined by links of ``similarity`` or more.

    A node is a text with its A-Z lower-cased and its blanks made alike, told by a digest of 128 bits; it is compared once
    however many documents have it. Null and blank texts are one node. ``th`` is the key of a text, see ``keyed``, and ``group``
    the digest of one of the group's texts. Bands are laid out for a ``similarity`` of 0.8 or more. An empty table gives an
    empty one.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, cells, sketches = [], [], []
            for t in b.column("text"):
                words = _words(t.as_py())
                d = xxhash.xxh3_128_intdigest(b" ".join(words))
                digests.append((d >> 64, d & _MASK))
                low = _minima(_shingles(words))
                cells.append(_cells(low).view(np.int64) if words else np.zeros(0, np.int64))
                sketches.append(_sketch(low))
            high, low = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64).T
            cols = [*(b.column(c) for c in ("doc_id", "dk", "th")), pa.array(high), pa.array(low), pa.array(cells, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "dk", "th", "high", "low", "cells", "sketch"])

    keys = keyed(docs, id_col, text_col)
    marked = materialise(keys.mapInArrow(place, "doc_id long, dk long, th long, high long, low long, cells array<long>, sketch binary"), "near-docs")
    # copies are reduced to one row a node before their shuffle
    nodes = marked.groupBy("high", "low").agg(F.min(F.struct("dk", "th")).alias("x"), F.first("cells").alias("cells"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes.select("*", F.monotonically_increasing_id().alias("node")), "near-nodes")
    return settled(keys, marked, nodes, _candidates(nodes.select("node", "cells", "sketch"), similarity, cell_cap), similarity, cap)


def settled(keys: DataFrame, marked: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, cap: int) -> DataFrame:
    """(doc_id, th, group) of ``marked`` (doc_id, th, high, low): ``pairs`` of candidates (a, b: nodes) that hang together are
    compared with their whole sets. ``nodes``: node, high, low, x (dk and th of one of its documents in ``keys``)."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingles(_words(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["component", "node", "size", "shingles"])

    candidates = components(pairs)
    firsts = nodes.select("node", "x.dk", "x.th").join(candidates, "node")
    texts = keys.select("dk", "th", "text").join(firsts, ["dk", "th"]).select("component", "node", "text")
    sets = materialise(texts.mapInArrow(shingled, "component long, node long, size long, shingles binary"), "near-sets")
    found = components(_links(sets, similarity, cap)).join(nodes.select("node", "high", "low"), "node")
    named = nodes.select(F.col("node").alias("component"), F.struct("high", "low").alias("group"))
    # a table, so that the join has an exchange on either side and the copies of one node are split among tasks
    found = materialise(found.join(named, "component").select("high", "low", "group"), "near-found")
    joined = marked.select("doc_id", "th", "high", "low").join(found, ["high", "low"], "left")
    return joined.select("doc_id", "th", F.coalesce("group", F.struct("high", "low")).alias("group"))
