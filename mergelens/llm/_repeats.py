"""What the two operators on repeated windows share.

Consecutive windows that choose the same minimiser form a *run*. A run is described by a row of ``RUNS``: the hash of
its minimiser (mh), a digest of all it covers (dg), its document (dk, th), its first window (start) and the number of
its windows (n). Equal windows have equal minimisers, so they meet under one mh; equal runs have equal digests and need
no text to be found; only a representative of each digest whose mh has several travels with its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mergelens.llm._rolling import mix
from mergelens.llm._store import NO_ID, keyed, materialise

RUNS = "mh long, dg long, dk long, th long, start int, n int, twice boolean, dup boolean"
#: From so many different runs under one minimiser, each window goes to a bucket of its own.
HOT = 500
#: Partitions and rows of each that are looked at for frequent minimisers, how often such a one is found there, and how many
#: there may be.
PARTS, ROWS, OFTEN, MOST = 64, 320, 24, 100_000
#: Tasks among which the runs of a frequent minimiser are dealt.
SALT = 256


def combine(mh: np.ndarray, dg: np.ndarray, dk: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray, first_stays: bool) -> pa.RecordBatch:
    """The runs of one batch, combined before the shuffle: of equal runs the earliest goes on, the others are known
    duplicates. Their rows, merged where one follows another, get keys of their own and spread evenly. With
    ``first_stays`` the earliest occurrence is no duplicate; else it carries ``twice``."""
    order = np.lexsort((start, th, dk, dg, mh))
    mh, dg, dk, th, start, n = (x[order] for x in (mh, dg, dk, th, start, n))
    if len(mh):
        again = np.concatenate([[False], (mh[1:] == mh[:-1]) & (dg[1:] == dg[:-1])])
        same = np.concatenate([[False], again[1:] & (dk[1:] == dk[:-1]) & (th[1:] == th[:-1]) & (start[1:] == start[:-1])])  # a repeated row
        mh, dg, dk, th, start, n, again = (x[~same] for x in (mh, dg, dk, th, start, n, again))
        heads = np.flatnonzero(~again)
        counts = np.diff(np.concatenate([heads, [len(mh)]]))
        twice = (counts > 1) if not first_stays else np.zeros(len(heads), bool)
        rest = np.flatnonzero(again)
        rest = rest[np.lexsort((start[rest], th[rest], dk[rest]))]
        a, b, s, k = dk[rest], th[rest], start[rest], n[rest]
        cut = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1] + k[:-1])]) if len(rest) else np.zeros(0, bool)
        at = np.flatnonzero(cut)
        k = np.add.reduceat(k, at) if len(at) else k
        a, b, s = a[at], b[at], s[at]
        own = mix(b.view(np.uint64) ^ mix(s.astype(np.uint64) ^ a.view(np.uint64))).view(np.int64)
        cols = [np.concatenate(x) for x in ((mh[heads], own), (dg[heads], own), (dk[heads], a), (th[heads], b), (start[heads], s), (n[heads], k), (twice, np.zeros(len(a), bool)), (np.zeros(len(heads), bool), np.ones(len(a), bool)))]
    else:
        cols = [mh, dg, dk, th, start, n, np.zeros(0, bool), np.zeros(0, bool)]
    kinds = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, bool, bool]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(cols, kinds, strict=True)], ["mh", "dg", "dk", "th", "start", "n", "twice", "dup"])


def frequent(texts: DataFrame, cut: Callable, label: str) -> DataFrame:
    """mh: minimisers that ``OFTEN`` or more different runs have in the first ``ROWS`` rows of some ``PARTS`` partitions.

    Only where runs are compared depends on this, never which: a frequent minimiser is dealt among tasks by digest, window
    by window, and one that was not seen here is dealt the same way where ``judge`` counts over ``HOT`` runs of it.
    """
    step = max(1, texts.rdd.getNumPartitions() // PARTS)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % step == 0:
            for b in batches:
                yield from cut(iter([b.slice(0, ROWS)]))
                return

    counts = texts.mapInArrow(some, RUNS).where("not dup").groupBy("mh").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return materialise(counts.orderBy(F.col("n").desc()).limit(MOST).select("mh"), label)


def judge(rows: DataFrame, first_stays: bool, label: str, often: DataFrame) -> DataFrame:
    """Of all runs those that are duplicates as a whole (dup) and the representatives whose windows have to be compared
    (rep; hot if there are over ``HOT`` of them, or their minimiser is among those of ``often``, whose runs are dealt
    among ``SALT`` tasks). One shuffle by minimiser; equal runs were combined before it, batch by batch."""
    rows = rows.join(F.broadcast(often.withColumn("often", F.lit(True))), "mh", "left")
    rows = rows.withColumn("part", F.when(F.col("often"), F.pmod("dg", F.lit(SALT))).otherwise(0)).repartition("mh", "part")
    by_dg = W.partitionBy("mh", "part", "dg").orderBy("dk", "th", "start")
    at = F.struct("dk", "th", "start")
    rows = rows.withColumn("head", F.first(at).over(by_dg)).withColumn("new", F.row_number().over(by_dg) == 1)
    if first_stays:
        known = F.col("dup") | (F.col("head") != at)
    else:
        whole = by_dg.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        rows = rows.withColumn("tail", F.last(at).over(whole)).withColumn("any", F.max("twice").over(whole))
        known = F.col("dup") | F.col("any") | (F.col("head") != F.col("tail"))
    kinds = F.sum(F.col("new").cast("int")).over(W.partitionBy("mh", "part"))
    rows = rows.withColumn("known", known).withColumn("kinds", kinds)
    dealt = F.coalesce("often", F.lit(False))
    rep = F.col("new") & ((F.col("kinds") > 1) | dealt)
    rows = rows.select("mh", "dk", "th", "start", "n", F.col("known").alias("dup"), rep.alias("rep"), ((F.col("kinds") > HOT) | dealt).alias("hot"))
    return materialise(rows.where("dup or rep"), label)


def spans(docs: DataFrame, judged: DataFrame, pack: Callable, compare: Callable, hot: Callable | None = None) -> DataFrame:
    """(dk, th, text, .., spans): every document with the windows found twice, as runs (start, n), and what other columns
    ``docs`` has.

    ``pack`` cuts the representatives out of their texts and sends them to buckets; ``compare`` gets whole buckets,
    sorted, and returns runs of windows. The texts are shuffled by document once, for both joins. With ``hot`` the runs
    of hot minimisers are left to it: it gets (dk, th, text) and those runs and returns (dk, th, start, n) or None.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "dk", "th", "text")]
    docs = docs.select("dk", "th", F.col("text").cast("binary").alias("text"), *more)
    wanted = judged.where("rep and not hot" if hot else "rep").groupBy("dk", "th").agg(F.collect_list(F.struct("mh", "start", "n", "hot")).alias("runs"))
    packed = docs.join(wanted, ["dk", "th"]).select("dk", "th", "text", *more, "runs").mapInArrow(pack, "bucket long, body binary, dk long, th long, start int")
    sorted_ = packed.repartition("bucket").sortWithinPartitions("bucket", "dk", "th", "start")
    found = sorted_.mapInArrow(_buckets(compare), "dk long, th long, start int, n int")
    both = judged.where("dup").select("dk", "th", "start", "n").union(found)
    more_found = hot(docs.select("dk", "th", "text"), judged.where("rep and hot").select("mh", "dk", "th", "start", "n")) if hot else None
    both = both if more_found is None else both.union(more_found)
    both = both.groupBy("dk", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return docs.join(both, ["dk", "th"], "left").select("dk", "th", "text", *more, "spans")


def _buckets(compare: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hands on whole buckets, one batch of them at a time."""
        held: pa.Table | None = None
        for b in batches:
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            keys = held.column("bucket").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield _found(compare(held.slice(0, cut)))
                held = held.slice(cut)
        if held is not None and len(held):
            yield _found(compare(held))

    return run


def _found(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Windows (dk, th, place) as runs of consecutive ones."""
    dk, th, at = rows
    order = np.lexsort((at, th, dk))
    dk, th, at = dk[order], th[order], at[order]
    cut = np.concatenate([[True], (dk[1:] != dk[:-1]) | (th[1:] != th[:-1]) | (at[1:] > at[:-1] + 1)]) if len(dk) else np.zeros(0, bool)
    heads = np.flatnonzero(cut)
    ends = np.concatenate([heads[1:], [len(dk)]])[: len(heads)] - 1
    cols = [dk[heads], th[heads], at[heads].astype(np.int32), (at[ends] - at[heads] + 1).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["dk", "th", "start", "n"])


def covered(spans_: list[dict] | None, width: int) -> list[tuple[int, int]]:
    """Disjoint maximal ranges covered by windows of ``width``, from runs of windows."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["start"] + x["n"] - 1 + width) for x in spans_ or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def doc_id(dk: pa.Array) -> pa.Array:
    """The doc_id of a key: null where it stands for none."""
    values = dk.to_numpy(zero_copy_only=False)
    return pa.array(values, mask=values == NO_ID)


__all__ = ["RUNS", "combine", "covered", "doc_id", "frequent", "judge", "keyed", "spans"]
