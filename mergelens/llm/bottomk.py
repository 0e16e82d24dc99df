"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is its set of distinct word shingles, a shingle its 64-bit hash, and a sketch the ``K`` least hashes of a set.

1. Sets that are equal are one node, whatever the number of their documents.
2. Inverted lists: a retained value lists the nodes that retain it. Two sets of the similarity asked for retain at least
   ``cutoff`` values in common, so each node is listed by its rarest ``kept - cutoff + 1`` values alone: one of these is
   common to both. A passage of the whole corpus then lists only documents that consist mostly of such passages.
3. In a list, a pair whose rarest common value is the list's is estimated by its union sketch: how many of the K least
   hashes of both are in both. Pairs below the cutoff go.
4. Pairs that pass, and what hangs together by them within one list, are compared with their whole sets.

No pair is written at any step, only a list's forest; lists that outgrow a task are dealt to blocks, each pair of which is a task.
The estimate misses a pair of the similarity asked for with probability ``MISS`` at most; where both sets are no larger than K
the sketches are the sets and nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mergelens.llm._store import keyed, materialise
from mergelens.llm.components import components
from mergelens.llm.neardup import _links, _shingles, _words

SHINGLE, PERCENT = 3, 85
#: Values that a sketch retains.
K = 64
#: How probable it may be that a pair of just the similarity asked for has fewer common values than the cutoff.
MISS = 1e-11
#: Nodes of a list that one task compares.
LIST_CAP = 2048
_MASK = 2**64 - 1


@cache
def cutoff(k: int, percent: int) -> int:
    """The least number of common values among the ``k`` least of a union that ``percent`` similarity leaves possible but
    for a probability of ``MISS``; at least one."""
    p, below = percent / 100, 0.0
    for c in range(k + 1):
        below += comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > MISS:
            return max(c, 1)
    return max(k, 1)


def listed(kept: int, k: int, percent: int) -> int:
    """How many of its ``kept`` values, the rarest, list a node: any partner shares one of them."""
    fewest = min(cutoff(k, percent), ceil(kept * percent / 100))
    return max(kept - fewest + 1, 0)


def estimated(sketches: list[np.ndarray], sizes: np.ndarray, owned: list[np.ndarray], side: np.ndarray, k: int, percent: int) -> np.ndarray:
    """For each node the number of its component within a list: nodes are linked where their union sketch passes.

    ``sketches`` are sorted values; ``owned`` are the values that list the node and come before the list's own: a pair that has
    one of these in common belongs to that list. Side 0 meets all, 1 and 2 only each other. Each node is held against
    those of fitting size that no link has reached, so a group of near copies costs about one comparison a member.
    """
    n = len(sketches)
    order = np.argsort(sizes, kind="stable")
    top, label = -1, np.full(n, -1, np.int64)
    left, queue, cut = order, [], cutoff(k, percent)
    while len(left) or queue:
        if not queue:
            top += 1
            queue.append(int(left[0]))
            label[left[0]], left = top, left[1:]
        i = queue.pop()
        if not len(left):
            continue
        ranked = sizes[left]
        a = np.searchsorted(ranked, percent * sizes[i] / 100 - 1e-6)
        b = np.searchsorted(ranked, 100 * sizes[i] / percent + 1e-6, "right")
        some = left[a:b]
        if side[i]:
            some = some[side[some] != side[i]]
        if not len(some):
            continue
        passed = some[_passing(sketches[i], int(sizes[i]), [sketches[j] for j in some], sizes[some], owned[i], [owned[j] for j in some], k, percent, cut)]
        if len(passed):
            label[passed] = top
            queue += passed.tolist()
            left = left[label[left] < 0]
    return label


def _passing(mine: np.ndarray, size: int, others: list[np.ndarray], sizes: np.ndarray, before: np.ndarray, befores: list[np.ndarray], k: int, percent: int, cut: int) -> np.ndarray:
    m = np.array([len(o) for o in others])
    flat, row = np.concatenate(others), np.repeat(np.arange(len(others)), m)
    at = np.searchsorted(mine, flat)
    both = (at < len(mine)) & (mine[np.minimum(at, len(mine) - 1)] == flat)
    begin = np.cumsum(m) - m
    run = np.cumsum(both)
    shared = np.bincount(row[both], minlength=len(others))
    nth = run[both] - (np.cumsum(shared) - shared)[row[both]]  # of the common values, from one
    rank = at[both] + 1 + (np.flatnonzero(both) - begin[row[both]] + 1) - nth  # in the union
    within = np.bincount(row[both], weights=rank <= k, minlength=len(others))
    whole = (size <= k) & (sizes <= k)  # the sketches are the sets
    fits = np.where(whole, 100 * shared >= percent * (len(mine) + m - shared), within >= cut)
    if len(before) and fits.any():
        lens = np.array([len(o) for o in befores])
        if lens.sum():
            hit = np.isin(np.concatenate(befores), before)
            fits &= np.bincount(np.repeat(np.arange(len(others)), lens)[hit], minlength=len(others)) == 0
    return fits


def sketched(docs: DataFrame, n: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, dk, th (see ``keyed``), size, high, low, sketch: the size of each document's set, its digest of 128 bits and
    its sketch. Without words the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, high, low, sketch = [], [], [], []
            for t in b.column("text"):
                s = _shingles(_words(t.as_py()), n)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                size.append(len(s))
                high.append(d >> 64)
                low.append(d & _MASK)
                sketch.append(s[:k].view(np.int64))
            words = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)]
            cols = [*(b.column(c) for c in ("doc_id", "dk", "th")), pa.array(size, pa.int64()), *words, pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "dk", "th", "size", "high", "low", "sketch"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, dk long, th long, size long, high long, low long, sketch array<long>")


def _lists(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, node, rank): the lists of more than one node. ``rank`` orders a node's values from rare to frequent."""
    values = nodes.select("node", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    often = materialise(values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "bottomk-often")
    shared = values.join(often, "value")  # the rest are a node's own: its rarest
    by_node = W.partitionBy("node")
    mine = F.col("kept") - F.count("*").over(by_node)
    shared = shared.withColumn("rank", mine + F.row_number().over(by_node.orderBy("n", "value")))
    most = F.element_at(F.array(*[F.lit(listed(s, k, percent)) for s in range(1, k + 1)]), F.col("kept").cast("int"))
    rows = materialise(shared.where(F.col("rank") <= most).select("value", "node", "rank"), "bottomk-listed")
    several = materialise(rows.groupBy("value").agg(F.count("*").alias("members")).where("members > 1"), "bottomk-lists")
    return rows.join(several, "value")


def _candidates(nodes: DataFrame, lists: DataFrame, k: int, percent: int, cap: int) -> DataFrame:
    """(key, node): nodes that hang together by estimated pairs of one list, under a key of that list's component."""
    lists = materialise(lists, "bottomk-members")
    order = lists.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("order"))  # K at most
    placed = nodes.join(order, "node").select("node", "size", "sketch", F.transform("order", lambda x: x["value"]).alias("order"))
    blocks = F.ceil(F.col("members") / cap).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = lists.join(placed, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte")
    rows = rows.select(F.col("value"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), side.alias("side"), "node", "size", "sketch", "order")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> pa.RecordBatch:
            ids, members = list(held), list(held.values())
            before = [o[: int(np.flatnonzero(o == now[0])[0])] for _, _, _, o in members]
            sketches = [s for _, _, s, _ in members]
            label = estimated(sketches, np.array([m for _, m, _, _ in members]), before, np.array([x for x, _, _, _ in members]), k, percent)
            many = np.bincount(label)[label] > 1
            name = lambda c: xxhash.xxh64_intdigest(f"{now} {c}")
            keys = np.array([name(c) for c in label[many].tolist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.array(ids, np.int64)[many])], ["key", "node"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("value", "p", "q", "node", "side", "size")]
            lists_ = zip(b.column("sketch"), b.column("order"), strict=True)
            for value, p, q, node, side, size, (sketch, order) in zip(*cols, lists_, strict=True):
                if (value, p, q) != now:
                    if len(held) > 1:
                        yield out()
                    now, held = (value, p, q), {}
                held[node] = (side, size, sketch.values.to_numpy().view(np.uint64), order.values.to_numpy())
        if len(held) > 1:
            yield out()

    return rows.repartition("value", "p", "q").sortWithinPartitions("value", "p", "q").mapInArrow(compare, "key long, node long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, k: int = K, list_cap: int = LIST_CAP, cap: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, th, n_shingles, group, component_id) for every row: documents are linked where ``100 * common >= percent *
    united`` shingles; ``group`` names those that links connect, component_id is the smallest doc_id among them.

    A-Z are lower-cased; a shingle is ``shingle`` words between blanks (\\x20, \\x09-\\x0D), and a text of fewer words is
    one. Null and blank texts have no shingle and are linked with nothing, not even each other: each such row is its own
    component, its group null. A null id is never the smallest unless a component has no other. Rows that share an id but
    not a text are documents of their own, repeated rows are copies; other columns are not looked at; an empty table gives
    an empty one. ``th`` is the key of a text, see ``keyed``.
    """
    marked = materialise(sketched(docs, shingle, k, id_col, text_col), "bottomk-docs")
    digest = ["high", "low", "size"]
    first = F.min(F.struct("dk", "th")).alias("x")
    sets = marked.where("size > 0").groupBy(*digest).agg(first, F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"))
    nodes = materialise(sets.select("*", F.monotonically_increasing_id().alias("node")), "bottomk-nodes")
    met = materialise(_candidates(nodes.select("node", "size", "sketch"), _lists(nodes, k, percent), k, percent, list_cap), "bottomk-met")
    found = materialise(components(_links(_sets(docs, nodes, met, shingle, id_col, text_col), percent / 100, cap)), "bottomk-found")
    named = nodes.select(*digest, "node", "least").join(found, "node", "left").select(*digest, "least", F.coalesce("component", "node").alias("group"))
    named = materialise(named, "bottomk-named")
    # tables, so that the joins have an exchange on either side and the copies of one set are split among tasks
    least = materialise(named.groupBy("group").agg(F.min("least").alias("component_id")), "bottomk-least")
    named = named.join(least, "group").select(*digest, "group", "component_id")
    out = marked.select("doc_id", "th", *digest).join(named, digest, "left")
    return out.select("doc_id", "th", F.col("size").alias("n_shingles"), "group", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _sets(docs: DataFrame, nodes: DataFrame, met: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """component, node, size, shingles: the whole sets of candidates under each of their keys."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingles(_words(t.as_py()), shingle) for t in b.column("text")]
            cols = [b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "size", "shingles"])

    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "x.dk", "x.th")
    texts = keyed(docs, id_col, text_col).select("dk", "th", "text").join(wanted, ["dk", "th"]).select("node", "text").dropDuplicates(["node"])
    whole = materialise(texts.mapInArrow(shingled, "node long, size long, shingles binary"), "bottomk-sets")
    return materialise(met.join(whole, "node").select(F.col("key").alias("component"), "node", "size", "shingles"), "bottomk-meet")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
