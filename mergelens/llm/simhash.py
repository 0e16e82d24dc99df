"""SimHash near-dedup: segment-popcount embedding, grid range-join under Manhattan distance, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mergelens.llm import neardup
from mergelens.llm._rolling import mix
from mergelens.llm._store import NO_ID, keyed, materialise
from mergelens.llm.components import components

BLOCK = 1 << 16  # shingles hashed at once
EVEN = np.uint64(0x5555555555555555)
#: Wide fingerprints: words of 64 bits, a hash for each.
WORDS = 4
_RNG = np.random.default_rng(42)
ODD, SALT, FOLD = (_RNG.integers(0, 2**64, WORDS, np.uint64) | np.uint64(1) for _ in range(3))
#: How probable it may be that two texts of just the similarity asked for share no cell.
MISS = 1e-5
#: More bits of their wide fingerprints may differ with this probability.
BEYOND = 1e-6
#: What a row of a grid costs, in comparisons.
ROW = 300
#: Rows of a cell that are held against all others at once, and cells that are broadcast.
AT_ONCE, FEW = 256, 10_000


def _fingerprint(text: str | None, n: int, seed: int) -> int:
    words = (text or "").encode().lower().split()  # bytes: lower() maps A-Z alone, split() cuts at \x20 and \x09-\x0d
    if not words:
        return 0
    joined, lens = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    n = min(n, len(words))
    first, last = starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    h, total, counts = xxhash.xxh64_intdigest, len(first), np.zeros(64, np.int64)
    for k in range(0, total, BLOCK):
        got = [h(joined[a:b], seed) for a, b in zip(first[k : k + BLOCK], last[k : k + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(got, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp long), th a hash of the text: the 64-bit SimHash of the word ``n``-shingles of each whole text, repeats included.

    Null and blank texts have fingerprint zero; a text of fewer than ``n`` words is one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([_fingerprint(t.as_py(), n, seed) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fps)], ["doc_id", "th", "fp"])

    return keyed(docs, id_col, text_col).select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Counts of ones in the 32 segments of two bits, in thermometer code (0: 00, 1: 01, 2: 11), so that the Manhattan
    distance of two rows of counts is the number of differing bits of their codes. It never exceeds the Hamming distance."""
    low, high = fp & EVEN, (fp >> np.uint64(1)) & EVEN
    return (low | high) | ((low & high) << np.uint64(1))


def grid_masks(distance: int, spare: int = 2) -> list[int]:
    """The segments are dealt to ``distance`` + ``spare`` groups. Rows within Manhattan ``distance`` have equal counts in
    ``spare`` groups at least, and so share a cell of one of the grids that this returns as masks of bits."""
    k = distance + spare
    groups = [sum(3 << (2 * s) for s in range(32) if s * k // 32 == g) for g in range(k)]
    return [sum(pair) for pair in combinations(groups, spare)]


def spare_groups(n: int, distance: int) -> int:
    """How many groups of segments a cell fixes for ``n`` fingerprints: more cells of fewer rows each as ``n`` grows. The
    cost of a fingerprint is that of its rows, one a grid, and of the strangers in its cells; a segment's count has one
    and a half bits."""
    grids = lambda s: comb(distance + s, s)
    return min(range(2, 9), key=lambda s: grids(s) * (4 + n / 2 ** (48 * s / (distance + s))))


def _forest(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links (x, y): no component is lost, no cycle is kept."""
    top: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := top.get(v, v)) != v:
            top[v] = v = top.get(p, p)
        return v

    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        if (p := find(a)) != (q := find(b)):
            top[max(p, q)] = min(p, q)
            yield a, b


def _pairs(key: np.ndarray, fp: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the linked pairs of rows with equal keys; rows are sorted by key. Side 0 meets all, 1 and 2 only each
    other."""
    code, xs, ys = embed(fp), [], []
    held = np.arange(len(key) - 1)
    d = 1
    while True:
        held = held[held + d < len(key)]
        held = held[key[held] == key[held + d]]
        if not len(held):
            break
        i, j = held, held + d
        near = np.bitwise_count(code[i] ^ code[j]) <= distance  # the lower bound
        i, j = i[near], j[near]
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (fp[i] != fp[j]) & ((side[i] == 0) | (side[i] != side[j]))
        xs.append(fp[i[near]])
        ys.append(fp[j[near]])
        d += 1
    if not xs:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    kept = list(_forest(x, y))
    return np.array([a for a, _ in kept], np.uint64), np.array([b for _, b in kept], np.uint64)


def links(fps: DataFrame, distance: int = 4, cell_cap: int = 2048) -> DataFrame:
    """(a, b): links between distinct fingerprints that differ in ``distance`` bits or fewer, enough to connect all that
    are linked. ``fps``: one column fp, distinct.

    Every fingerprint goes to its cell of each grid. A cell of more than ``cell_cap`` fingerprints is dealt to blocks and
    each pair of blocks is compared as a cell of its own, so no task holds a whole hot cell and no pair is lost. The
    number of grids follows the number of fingerprints, see ``spare_groups``.
    """
    masks = grid_masks(distance, spare_groups(fps.count(), distance))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            code = embed(fp)
            for g, m in enumerate(masks):  # the cell's coordinates and the grid's number
                k = (code & np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((g + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(fp.view(np.int64))], ["cell", "fp"])

    placed = fps.mapInArrow(cells, "cell long, fp long")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes, "simhash-cells")
    full = placed.join(sizes, "cell")
    k = F.ceil(F.col("n") / cell_cap).cast("int")
    own = F.pmod(F.xxhash64("fp"), k).cast("int")
    other = F.explode(F.sequence(F.lit(0), k - 1))
    full = full.withColumn("own", own).withColumn("other", other).select(
        F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("k"),
        "fp",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            x, y = _pairs(cols[0], cols[1].view(np.uint64), cols[2], distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for b in batches:
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "fp", "side")]
            held = now if held is None else [np.concatenate(p) for p in zip(held, now, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last cell may go on
            if cut:
                yield out([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield out(held)

    return full.repartition("k").sortWithinPartitions("k").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 4, seed: int = 42, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp, component_id, group): group names the component by a fingerprint, component_id is the smallest doc_id reachable over links of ``distance`` bits or fewer.

    Equal texts share a fingerprint, which is compared once however many documents have it. Null doc_ids are never the
    smallest unless a component has no other. Repeated rows come back as often as they stand in ``docs``; an empty table
    gives an empty one.
    """
    marked = materialise(fingerprints(docs, n, seed, id_col, text_col), "simhash-docs")
    one = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = components(links(one.select("fp"), distance))
    group = F.coalesce("component", "fp")
    joined = materialise(one.join(found, one.fp == found.node, "left").select("fp", "first", group.alias("group")), "simhash-groups")
    # a table, so that the join has an exchange on either side and the rows of a large group are split among tasks
    least = materialise(joined.groupBy("group").agg(F.min("first").alias("component_id")), "simhash-least")
    named = joined.join(least, "group").select("fp", "component_id", "group")
    return marked.join(named, "fp").select("doc_id", "th", "fp", "component_id", "group")


def wide(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of ``WORDS`` words of a set of hashes: a bit is 1 if set in over half of them."""
    counts = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(shingles), 255):  # so many are counted in a byte
        h = mix(shingles[k : k + 255, None] * ODD + SALT)
        counts += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(shingles)).view(np.uint64)


def differing(similarity: float) -> float:
    """How probable it is that a bit of two sets of that Jaccard similarity differs: their angle. Of sizes that differ as well the
    angle is less; small sets, whose counts are often even, have some more, hence the tenth."""
    return 1.1 * acos(2 * similarity / (1 + similarity)) / pi


def reach(similarity: float) -> int:
    """How many bits of two wide fingerprints may differ: more do with a probability of ``BEYOND``."""
    n, p, more = 64 * WORDS, differing(similarity), 1.0
    for d in range(n):
        more -= comb(n, d) * p**d * (1 - p) ** (n - d)
        if more < BEYOND:
            return d
    return n


def drawn_grids(n: int, similarity: float) -> np.ndarray:
    """Masks of grids, each of some segments drawn at random: enough that two texts of ``similarity`` share a cell but for
    a probability of ``MISS``. The more fingerprints (``n``) there are, the more segments a cell fixes, up to eight, for disk's
    sake: a segment's counts are equal by chance in three cases of eight."""
    p = differing(similarity)
    same = (1 - p) ** 2 + p * p / 2
    grids = lambda s: ceil(log(MISS) / log(1 - same**s))
    s = min(range(2, 9), key=lambda s: grids(s) * (ROW + n * 0.375**s / 2))
    rng, out = np.random.default_rng(7), np.zeros((grids(s), WORDS), np.uint64)
    for mask in out:
        for at in rng.choice(32 * WORDS, s, replace=False).tolist():
            mask[at // 32] |= np.uint64(3 << (2 * (at % 32)))
    return out


def _close(fp: np.ndarray, side: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of wide fingerprints (a row each) that differ in ``most`` bits or fewer. Side 0 meets
    all, 1 and 2 only each other."""
    code, label = embed(fp), np.arange(len(fp))
    for a in range(0, len(fp), AT_ONCE):
        bound = np.zeros((min(AT_ONCE, len(fp) - a), len(fp) - a), np.uint16)
        for w in range(fp.shape[1]):
            bound += np.bitwise_count(code[a : a + AT_ONCE, w, None] ^ code[None, a:, w])
        i, j = np.nonzero(bound <= most)  # the lower bound
        i, j = i[j > i] + a, j[j > i] + a
        near = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= most
        near &= (side[i] == 0) | (side[i] != side[j])
        i, j = i[near], j[near]
        rows, begins = np.unique(i, return_index=True)
        for r, js in zip(rows.tolist(), np.split(j, begins[1:]), strict=False):
            for other, k in zip(*np.unique(label[js], return_index=True), strict=True):
                if other != label[r]:
                    yield r, int(js[k])
                    label[label == other] = label[r]


def _stars(nodes: np.ndarray, found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The links ``found`` (places in ``nodes``) as stars: each node that they join and the least one of those it is joined
    with. Cells that share a group mostly share its least nodes, so their stars have more links in common than forests."""
    top: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := top.get(v, v)) != v:
            top[v] = v = top.get(p, p)
        return v

    for i, j in found:
        p, q = find(int(nodes[i])), find(int(nodes[j]))
        top[max(p, q)] = min(p, q)
    joined = np.array([(v, find(v)) for v in top], np.int64).reshape(-1, 2)
    joined = joined[joined[:, 0] != joined[:, 1]]
    return joined[:, 0], joined[:, 1]


def wide_links(nodes: DataFrame, similarity: float, cell_cap: int = 4096) -> DataFrame:
    """(a, b): stars that connect the nodes whose wide fingerprints differ in ``reach`` bits or fewer and that share a cell, those
    and no others. ``nodes``: node, fp (its words, one after the other).

    As in ``links`` a fingerprint goes to its cell of each grid, and a cell of more than ``cell_cap`` nodes is dealt to blocks.
    """
    masks, most = drawn_grids(nodes.count(), similarity), reach(similarity)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = embed(np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint64).reshape(-1, WORDS))
            for g, mask in enumerate(masks):
                k = mix(((code & mask) * FOLD).sum(axis=1, dtype=np.uint64) + np.uint64((g + 1) * 0xC2B2AE3D27D4EB4F % 2**64))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), b.column("node"), b.column("fp")], ["cell", "node", "fp"])

    placed = nodes.select("node", "fp").mapInArrow(cells, "cell long, node long, fp binary")
    hot = materialise(placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_cap), "simhash-hot")
    k = F.coalesce(F.ceil(F.col("n") / cell_cap), F.lit(1)).cast("int")
    rows = placed.join(F.broadcast(hot) if hot.count() <= FEW else hot, "cell", "left").withColumn("k", k)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte")
    rows = rows.select("cell", (F.least("own", "other") * F.col("k") + F.greatest("own", "other")).alias("block"), side.alias("side"), "node", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            nodes, side = (np.concatenate(p) for p in zip(*[(n, s) for n, s, _ in held], strict=True))
            if len(nodes) > 1:
                fp = np.frombuffer(b"".join(f for _, _, f in held), np.uint64).reshape(-1, WORDS)
                a, b = _stars(nodes, list(_close(fp, side, most)))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            cell, block, node, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "node", "side"))
            fps = b.column("fp").to_pylist()
            new = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
            for x, z in zip([0, *new.tolist()], [*new.tolist(), len(cell)], strict=True):
                if x < z and (cell[x], block[x]) != now:
                    if held:
                        yield from out()
                    now, held = (cell[x], block[x]), []
                held.append((node[x:z], side[x:z], b"".join(fps[x:z])))
        if held:
            yield from out()

    return rows.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(compare, "a long, b long")


def similar_texts(
    docs: DataFrame, similarity: float = neardup.SIMILARITY, cap: int = 1 << 20, cell_cap: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, th, group): documents of one group are joined by links of Jaccard ``similarity`` or more of their sets of word
    5-shingles. Columns and rows are those of ``neardup.near_duplicates``.

    Candidates are found by SimHash: wide fingerprints of the sets, segment counts, grids and the Manhattan bound, then
    the Hamming distance. Whole sets decide. Texts of few shingles have coarser angles than ``differing`` takes, so a similar
    pair of those may be missed more often.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, fps = [], []
            for t in b.column("text"):
                words = neardup._words(t.as_py())
                d = xxhash.xxh3_128_intdigest(b" ".join(words))
                digests.append((d >> 64, d & (2**64 - 1)))
                fps.append(wide(neardup._shingles(words)).tobytes() if words else None)
            high, low = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64).T
            cols = [*(b.column(c) for c in ("doc_id", "dk", "th")), pa.array(high), pa.array(low), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "dk", "th", "high", "low", "fp"])

    keys = keyed(docs, id_col, text_col)
    marked = materialise(keys.mapInArrow(place, "doc_id long, dk long, th long, high long, low long, fp binary"), "simhash-wide")
    nodes = marked.groupBy("high", "low").agg(F.min(F.struct("dk", "th")).alias("x"), F.first("fp").alias("fp"))
    nodes = materialise(nodes.select("*", F.monotonically_increasing_id().alias("node")), "simhash-nodes")
    return neardup.settled(keys, marked, nodes, wide_links(nodes.where("fp is not null"), similarity, cell_cap), similarity, cap)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one document of each group in ``found`` (see ``near_duplicates``) is left: the one of
    smallest id, and of smallest text hash among several texts of that id; a null id only where there is no other. Of
    rows that repeat id and text one stays."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NO_ID)).alias("dk"), "th")
    firsts = found.groupBy("group").agg(F.min(rank).alias("x")).select("x.dk", "x.th")
    rows = keyed(docs, id_col, text_col, {"row": F.struct("*")}).select("dk", "th", "row").join(firsts, ["dk", "th"])
    nth = F.row_number().over(W.partitionBy("dk", "th").orderBy(F.xxhash64("row")))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
