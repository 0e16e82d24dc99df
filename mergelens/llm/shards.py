"""Sharding by a K-d tree over metadata, split at distributed weighted medians."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mergelens.llm._store import materialise

BINS = 512
#: A cut may miss its place by this share of a shard.
SLACK = 1 / 2000
#: A group of equal texts over this share of a shard's bytes, or of all rows, is heavy.
HEAVY_BYTES, HEAVY_ROWS = 1 / 16, 1 / 128


@dataclass(frozen=True)
class _Piece:
    """A heavy group of equal texts, or a part of one."""

    g: int
    piece: int
    weight: float
    x: tuple[float, ...]


@dataclass
class _Node:
    """A region of the tree that ``leaves`` shards share, from shard ``first`` on."""

    first: int
    leaves: int
    heavy: list[_Piece]
    axis: int = 0
    low: float = 0.0  # where the cut is known to lie, along the axis or, once ``at`` is known, along the tie
    high: float = 0.0
    at: float | None = None  # a value that points on both sides have
    below: int = 0  # bytes known to lie left of ``low``
    want: float = -1.0  # bytes of light points that belong to the left
    cut: tuple[float, float] | None = None  # left: coordinate < cut[0], or equal to it and tie < cut[1]
    left: list[_Piece] = field(default_factory=list)
    right: list[_Piece] = field(default_factory=list)


def _ordinal(df: DataFrame, c: str) -> Column:
    """A number that orders the values of a column: itself if numeric, else its first seven bytes."""
    kind = dict(df.dtypes)[c]
    if kind in ("string", "binary"):
        packed = F.conv(F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 7)), 14, "0"), 16, 10)
        return F.coalesce(packed.cast("double"), F.lit(-1.0))
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.coalesce(F.unix_micros(F.col(c).cast("timestamp")).cast("double"), F.lit(-1.0))
    return F.coalesce(F.col(c).cast("double"), F.lit(-1.0))


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of driver rows, a few for each shard; broadcast while that is little."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= 20_000 else df


def _settle(n: _Node, bins: list, goal: float, slack: float) -> None:
    """Chooses the cut of a node from a histogram of its light points, or the bin in which to look on.

    ``bins``: rows (bytes, points, least and greatest place) in order; ``goal``: bytes that belong to the left.
    """
    if n.want < 0:  # first histogram: heavy pieces take sides by their place, light points make up for them
        total, here, i = sum(b[0] for b in bins), 0.0, 0
        for h in sorted(n.heavy, key=lambda h: h.x[n.axis]):
            while i < len(bins) and bins[i][3] < h.x[n.axis]:
                here, i = here + bins[i][0], i + 1
            done = sum(p.weight for p in n.left)
            (n.left if here + done + h.weight / 2 < goal and done + h.weight <= goal + slack else n.right).append(h)
        while n.right and goal - sum(p.weight for p in n.left) > total + slack:
            n.left.append(n.right.pop(0))
        n.want = min(max(goal - sum(p.weight for p in n.left), 0.0), float(total))
    edge, rest = n.below, n.want
    for k, (w, points, least, most) in enumerate(bins):
        if edge + w >= rest or k == len(bins) - 1:
            if w <= slack or points == 1 or least == most and n.at is not None:
                right = edge + w - rest < rest - edge  # the nearer edge of the bin
                # beyond the last bin of a range there is no place known but the next number: other points may follow
                place = (bins[k + 1][2] if k + 1 < len(bins) else math.nextafter(most, math.inf)) if right else least
                n.cut = (place, 0.0) if n.at is None else (n.at, place)
            elif least == most:
                n.at, n.low, n.high, n.below = least, 0.0, 1.0, edge
            else:
                n.low, n.high, n.below = least, most, edge
            return
        edge += w
    n.cut = (math.nextafter(n.high, math.inf), 0.0)


def _split(points: DataFrame, nodes: list[_Node], extent: list[tuple[float, float]], shard_bytes: float) -> tuple[DataFrame, list[_Node]]:
    """One level of the tree: all nodes that several shards share are cut at the same time."""
    spark, dims = points.sparkSession, len(extent)
    open_ = [i for i, n in enumerate(nodes) if n.leaves > 1]
    stats = {r[0]: r for r in points.groupBy("node").agg(F.sum("w"), *[f(f"x{i}") for i in range(dims) for f in (F.min, F.max)]).collect()}
    goals = {}
    for i in open_:
        n, r = nodes[i], stats.get(i)
        lows = [min(([r[2 + 2 * d]] if r else []) + [h.x[d] for h in n.heavy], default=0.0) for d in range(dims)]
        highs = [max(([r[3 + 2 * d]] if r else []) + [h.x[d] for h in n.heavy], default=0.0) for d in range(dims)]
        n.axis = max(range(dims), key=lambda d: (highs[d] - lows[d]) / ((extent[d][1] - extent[d][0]) or 1.0))
        n.low, n.high = (r[2 + 2 * n.axis], r[3 + 2 * n.axis]) if r else (0.0, 0.0)
        goals[i] = ((r[1] if r else 0) + sum(h.weight for h in n.heavy)) * (n.leaves // 2) / n.leaves
    todo = open_
    while todo:
        n_bins = max(8, min(BINS, 65_536 // len(todo)))
        spec = _small(spark, [(i, nodes[i].axis, nodes[i].low, nodes[i].high, nodes[i].at) for i in todo], "node int, axis int, low double, high double, at double")
        x = F.element_at(F.array(*[F.col(f"x{d}") for d in range(dims)]), F.col("axis") + 1)
        seen = points.join(spec, "node").withColumn("x", x).where("at is null or x = at").withColumn("v", F.when(F.col("at").isNull(), F.col("x")).otherwise(F.col("tie"))).where("v >= low and v <= high")
        share = F.when(F.col("high") > F.col("low"), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
        counted = seen.groupBy("node", F.least(F.floor(share * n_bins), F.lit(n_bins - 1)).alias("bin")).agg(F.sum("w"), F.count("*"), F.min("v"), F.max("v")).collect()
        by: dict[int, list] = {i: [] for i in todo}
        for r in sorted(counted, key=lambda r: (r[0], r[1])):
            by[r[0]].append(r[2:])
        for i in todo:
            _settle(nodes[i], by[i], goals[i], shard_bytes * SLACK)
        todo = [i for i in todo if nodes[i].cut is None]
    children: list[_Node] = []
    rows = []
    for i, n in enumerate(nodes):
        here = len(children)
        if n.cut is None:
            rows.append((i, 0, 0.0, 0.0, here, here))
            children.append(n)
        else:
            rows.append((i, n.axis, *n.cut, here, here + 1))
            k = n.leaves // 2
            children += [_Node(n.first, k, n.left), _Node(n.first + k, n.leaves - k, n.right)]
    spec = _small(spark, rows, "node int, axis int, cut double, at double, l int, r int")
    x = F.element_at(F.array(*[F.col(f"x{d}") for d in range(dims)]), F.col("axis") + 1)
    left = (x < F.col("cut")) | ((x == F.col("cut")) & (F.col("tie") < F.col("at")))
    moved = points.join(spec, "node").withColumn("node", F.when(left, F.col("l")).otherwise(F.col("r"))).select(*points.columns)
    return materialise(moved, "shards-level"), children


def kd_shards(df: DataFrame, dims: Sequence[str], n_shards: int | None = None, target_bytes: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row of ``df`` in one of ``n_shards`` shards of near equal bytes, or in
    as many as give each ``target_bytes``.

    Rows of equal text are one point of the tree, with the least value of each of ``dims`` as its coordinates and the sum
    of their sizes (UTF-8 bytes plus one, a null text counts as one) as its weight. A node that several leaves share is
    split along its widest dimension, by extent as a share of the whole extent, where the weight to the left is the
    leaves' share to the left: a median, found by histograms of ``BINS`` bins that are counted on the executors and
    refined until a bin holds less than ``SLACK`` of a shard. Points of one value are cut by a hash. Groups of equal text
    that are heavy (at most 16 for each shard and 128 more) are placed on the driver, and the cut moves to make up for
    them; a group that is larger than that share is cut into pieces by a hash of the id, so that no shard overflows.
    slot counts a shard's rows from 0 without gaps. Nulls count as the least value; repeated rows are rows of their own;
    an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    coords = [f"x{i}" for i in range(len(dims))]
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        *[_ordinal(df, d).alias(x) for d, x in zip(dims, coords, strict=True)],
    )
    rows = materialise(rows, "shards-rows")
    groups = rows.groupBy("g", "text_crc32", "size").agg(F.count("*").alias("n"), *[F.min(x).alias(x) for x in coords])
    groups = groups.select(F.xxhash64("g", "text_crc32", "size").alias("g"), "text_crc32", "size", (F.col("n") * F.col("size")).alias("w"), "n", *coords)
    groups = materialise(groups, "shards-groups")
    total = groups.agg(F.sum("w"), F.sum("n"), *[f(x) for x in coords for f in (F.min, F.max)]).head()
    weight, count = total[0] or 0, total[1] or 0
    k = n_shards or max(1, -(-weight // (target_bytes or weight or 1)))
    extent = [(total[2 + 2 * i] or 0.0, total[3 + 2 * i] or 0.0) for i in range(len(dims))]
    shard_bytes = max(1.0, weight / k)

    pieces: list[_Piece] = []
    parts: dict[int, int] = {}
    for r in groups.where((F.col("w") > shard_bytes * HEAVY_BYTES) | (F.col("n") > max(16.0, count * HEAVY_ROWS))).collect():  # few: see above
        parts[r.g] = m = min(r.n, math.ceil(r.w / (shard_bytes * HEAVY_BYTES))) if r.w > shard_bytes / 2 else 1
        pieces += [_Piece(r.g, p, r.w / m, tuple(r[x] for x in coords)) for p in range(m)]
    spark = df.sparkSession
    light = groups.join(_small(spark, [(g,) for g in parts], "g long"), "g", "left_anti")

    nodes = [_Node(0, k, pieces)]
    points = light.withColumn("node", F.lit(0)).withColumn("tie", F.pmod(F.xxhash64("g"), F.lit(2**40)).cast("double") / F.lit(float(2**40)))
    while any(n.leaves > 1 for n in nodes):
        points, nodes = _split(points, nodes, extent, shard_bytes)

    homes = _small(spark, [(i, n.first) for i, n in enumerate(nodes)], "node int, shard int")
    key = ["g", "text_crc32", "size"]  # two texts rarely share the first, and hardly ever all three
    own = points.join(homes, "node").select(*key, "shard")
    named = rows.withColumn("g", F.xxhash64("g", "text_crc32", "size")).join(_small(spark, list(parts.items()), "g long, m int"), "g", "left")
    hot = named.where("m is not null").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("m")).cast("int"))
    placed = _small(spark, [(h.g, h.piece, n.first) for n in nodes for h in n.heavy], "g long, piece int, shard int")
    cols = ["doc_id", "size", "text_crc32", "shard"]
    both = hot.join(placed, ["g", "piece"]).select(cols).union(named.where("m is null").join(own, key).select(cols))
    return _slots(both, count, k)


def _slots(rows: DataFrame, count: int, k: int) -> DataFrame:
    """Numbers a shard's rows from 0 without gaps, in buckets of some 50,000 rows whose first numbers are sums of counts."""
    buckets = max(1, count // (k * 50_000))
    rows = materialise(rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int")), "shards-placed")
    counts = rows.groupBy("shard", "b").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("b")) - F.col("n")).select("shard", "b", "base")
    slot = F.row_number().over(W.partitionBy("shard", "b").orderBy("doc_id", "text_crc32")) - 1
    numbered = rows.withColumn("slot", slot.cast("long")).join(before, ["shard", "b"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("base")).alias("slot"))


def write_shards(df: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id", files_per_shard: int = 16) -> None:
    """Writes the rows of ``df`` as Parquet in a folder for each shard, by a join on a unique, non-null id."""
    named = df.join(shards.select(F.col("doc_id").alias(id_col), "shard"), id_col)
    named.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(files_per_shard))).write.partitionBy("shard").parquet(path)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = kd_shards(docs, ["source", "lang", "n_chars", "doc_id"], n_shards=8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
