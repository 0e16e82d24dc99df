"""Suffix-array dedup by a depth-limited radix sort over bytes.

A suffix is ordered through its first ``width`` bytes only, most significant digit first, and groups of equal digits are
all that the order is needed for. The first digit of a window is its minimiser, a gram of ``gram`` bytes that equal
windows choose at the same offset: one row stands for the whole run of windows that share it, so the first pass costs a
row for some 150 bytes. The second digit is a digest of all the run covers. Runs alone in their group drop out, whole
runs that are equal are settled, and what is left is sorted by its bytes, in digits of eight. Only windows of a minimiser
with very many different runs meet by digests of 128 bits instead: of ranges of neighbouring windows, which are divided
where they are neither equal to another's nor without any like.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm import _repeats as R
from mergelens.llm._rolling import BYTE_WORDS, grams, prefix, runs, sliding_argmin
from mergelens.llm._store import materialise

CHUNK = 1 << 19  # bytes hashed at once


def _runs(pieces: list[tuple[int, int, bytes]], width: int, gram: int) -> list[np.ndarray]:
    """For pieces (row, first byte, bytes): mh, dg, row, start, n of each run of windows that share a minimiser."""
    joined = b"".join(p[2] for p in pieces)
    values = grams(prefix(BYTE_WORDS[np.frombuffer(joined, np.uint8)]), gram)
    best = sliding_argmin(values, width - gram + 1)
    lens = np.array([len(p[2]) for p in pieces])
    first = np.cumsum(lens) - lens
    piece = np.repeat(np.arange(len(pieces)), lens)
    at = np.flatnonzero(piece[: len(best)] == piece[width - 1 : width - 1 + len(best)])
    chosen = best[at]
    a, b = runs(chosen * np.int64(2) ** 31 + (at - np.arange(len(at))))  # a gap in the windows ends a run too
    i, j = at[a], at[b - 1] if len(b) else at[:0]
    digest = xxhash.xxh3_64_intdigest
    dg = np.array([digest(joined[s:e]) for s, e in zip(i.tolist(), (j + width).tolist(), strict=True)], np.uint64)
    rows, bases = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    return [values[chosen[a]].view(np.int64), dg.view(np.int64), rows[piece[i]], i - first[piece[i]] + bases[piece[i]], j - i + 1]


def _rows(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dk, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dk", "th"))
            parts, group, size = [], [], 0
            for row, text in enumerate(b.column("text")):
                data = text.as_py()
                for base in range(0, len(data) - width + 1, CHUNK):
                    group.append((row, base, data[base : base + CHUNK + width - 1]))
                    size += len(group[-1][2])
                    if size >= CHUNK:
                        parts.append(_runs(group, width, gram))
                        group, size = [], 0
            if group:
                parts.append(_runs(group, width, gram))
            if parts:
                mh, dg, row, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield R.combine(mh, dg, dk[row], th[row], start, n, False)

    return run


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, body, dk, th, start = [], [], [], [], []
            for k, t, text, wanted in zip(*(b.column(c).to_pylist() for c in ("dk", "th", "text", "runs")), strict=True):
                for r in wanted:
                    bucket.append(r["mh"])
                    body.append(text[r["start"] : r["start"] + r["n"] - 1 + width])
                    start.append(r["start"])
                    dk.append(k)
                    th.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(body, pa.binary()), pa.array(dk, pa.int64()), pa.array(th, pa.int64()), pa.array(start, pa.int32())], ["bucket", "body", "dk", "th", "start"])

    return run


def _passes(joined: bytes, at: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows at ``at`` have an equal in their group, in the order of their bytes: passes over digits of eight
    bytes, the most significant first. A pass sorts the groups that its digit splits; groups of one drop out."""
    data = np.frombuffer(joined + bytes(8), np.uint8).astype(np.uint64)
    words = np.zeros(len(joined), np.uint64)
    for k in range(8):
        words |= data[k : k + len(joined)] << np.uint64(56 - 8 * k)
    left = np.argsort(group, kind="stable")
    new = np.concatenate([[True], group[left[1:]] != group[left[:-1]]])[: len(left)]  # where a group begins

    def several() -> np.ndarray:
        return ~(new & np.concatenate([new[1:], [True]])[: len(new)])

    left, new = left[several()], new[several()]
    for a in sorted({*range(0, width - 7, 8), max(width - 8, 0)}):
        digit = words[at[left] + a]
        if width < 8:
            digit >>= np.uint64(64 - 8 * width)
        apart = (digit[1:] != digit[:-1]) & ~new[1:]
        if not apart.any():
            continue
        number = np.cumsum(new) - 1
        split = np.zeros(number[-1] + 1, bool)
        split[number[1:][apart]] = True
        some = np.flatnonzero(split[number])
        order = np.lexsort((digit[some], number[some]))
        left[some], digit[some] = left[some[order]], digit[some[order]]
        new[1:] |= digit[1:] != digit[:-1]
        stay = several()
        left, new = left[stay], new[stay]
    return left


def _compare(width: int):
    def run(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Radix passes over the windows of whole buckets; those with an equal come back."""
        bucket, dk, th, start = (t.column(c).to_numpy() for c in ("bucket", "dk", "th", "start"))
        bodies = t.column("body").to_pylist()
        fresh = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (dk[1:] != dk[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1])])  # no repeated rows
        lens = np.array([len(x) for x in bodies])
        out, whole = [np.zeros((0, 3), np.int64)], np.flatnonzero(fresh)
        heads, ends = runs(bucket[whole])
        k = 0
        while k < len(heads):  # so many buckets at once as fill a chunk
            stop, size = k, 0
            while stop < len(heads) and (stop == k or size < CHUNK):
                size += int(lens[whole[heads[stop] : ends[stop]]].sum())
                stop += 1
            own = whole[heads[k] : ends[stop - 1]]
            windows = lens[own] - width + 1
            row = np.repeat(np.arange(len(own)), windows)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = (np.cumsum(lens[own]) - lens[own])[row] + offset
            left = _passes(b"".join(bodies[i] for i in own), at, bucket[own][row].view(np.uint64), width)
            r = own[row[left]]
            out.append(np.stack([dk[r], th[r], start[r] + offset[left]], 1))
            k = stop
        got = np.concatenate(out)
        return got[:, 0], got[:, 1], got[:, 2]

    return run


def _bodies(width: int, gram: int):
    """dk, th, start, n, at, body of runs of hot minimisers: ``at`` is the minimiser's place in the run's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t, text, wanted in zip(*(b.column(c).to_pylist() for c in ("dk", "th", "text", "runs")), strict=True):
                for r in wanted:
                    body = text[r["start"] : r["start"] + r["n"] - 1 + width]
                    values = grams(prefix(BYTE_WORDS[np.frombuffer(body, np.uint8)]), gram).view(np.int64)
                    rows.append((k, t, r["start"], r["n"], int(np.flatnonzero(values == r["mh"])[0]), body))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["dk", "th", "start", "n", "at", "body"])

    return run


def _cells(width: int, span: int):
    """The windows of runs, from ``a`` to ``b``, dealt to cells of ``span`` neighbours by their distance to the minimiser:
    ``every`` is a digest of all that a cell's windows cover, ``common`` of what lies in each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            rows = []
            for dk, th, start, at, body, a, b in zip(*(batch.column(c).to_pylist() for c in ("dk", "th", "start", "at", "body", "a", "b")), strict=True):
                for cell in range((at - b) // span, (at - a) // span + 1):
                    near, far = cell * span, cell * span + span - 1
                    i, j = max(a, at - far), min(b, at - near)
                    every = digest(body[i : j + width]) + struct.pack(">ii", at - j, at - i)
                    rows.append((dk, th, start, i, j, every, digest(body[at - near : at - far + width]) + struct.pack(">i", cell)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["dk", "th", "start", "a", "b", "every", "common"])

    return run


def _hot(width: int, gram: int):
    def found(docs: DataFrame, runs_: DataFrame) -> DataFrame | None:
        """dk, th, start, n: windows found twice among the runs of minimisers that have too many different runs for a task.

        Windows are dealt to cells of some fifty neighbours, then of seven, then of one. Cells that are equal in several
        runs are settled whole and one of each kind goes on; a cell whose common part no other kind has drops out; the kinds
        that share a common part are divided. So a run costs a few rows for each place where it parts from others, however
        many runs there are.
        """
        if runs_.isEmpty():
            return None
        wanted = runs_.groupBy("dk", "th").agg(F.collect_list(F.struct("mh", "start", "n")).alias("runs"))
        bodies = docs.join(wanted, ["dk", "th"]).select("dk", "th", "text", "runs").mapInArrow(_bodies(width, gram), "dk long, th long, start int, n int, at int, body binary")
        bodies = materialise(bodies.dropDuplicates(["dk", "th", "start"]), "suffix-bodies")  # repeated rows are one document
        third = round((width - gram + 1) ** (1 / 3))
        rows, out = bodies.withColumns({"a": F.lit(0), "b": F.col("n") - 1}).drop("n"), None
        for span in dict.fromkeys((max(1, third * third), max(1, third), 1)):
            cells = materialise(rows.mapInArrow(_cells(width, span), "dk long, th long, start int, a int, b int, every binary, common binary"), f"suffix-cells-{span}")
            first = F.min(F.struct("dk", "th", "start", "a", "b")).alias("first")
            kinds = materialise(cells.groupBy("common", "every").agg(F.count("*").alias("k"), first), f"suffix-kinds-{span}")
            now = cells.join(kinds.where("k > 1").select("every"), "every", "left_semi").select("dk", "th", (F.col("start") + F.col("a")).alias("start"), (F.col("b") - F.col("a") + 1).alias("n"))
            out = now if out is None else out.union(now)
            parted = materialise(kinds.groupBy("common").agg(F.count("*").alias("n")).where("n > 1"), f"suffix-parted-{span}")
            rows = kinds.join(parted, "common").select("first.*").join(bodies.drop("n"), ["dk", "th", "start"])
        return out

    return found


def _finish(width: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kept_bytes = [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                gone = R.covered(found, width)
                kept, at = [], 0
                for s, e in gone:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest()))
                kept_bytes.append(left)
            n, removed, n_spans, digests = zip(*rows, strict=True) if rows else ((), (), (), ())
            cols = [R.doc_id(b.column("dk")), *(pa.array(x, pa.int64()) for x in (n, removed, n_spans)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept_bytes, pa.binary())] * with_bytes, names + ["kept"] * with_bytes)

    return run


def suffix_dedup(docs: DataFrame, width: int = 400, gram: int = 100, with_bytes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every row of ``docs``.

    Removes each byte covered by a string of ``width`` bytes that also starts anywhere else, in another document or in
    the same one; overlaps count and strings are judged on the input. A null text is empty. Documents with one id but
    several texts are several; rows that repeat both are one document, whose strings don't count as found elsewhere for
    that, and all get its result. An empty table gives an empty one; a text shorter than ``width`` stays whole.
    """
    docs = R.keyed(docs, id_col, text_col)
    texts = docs.selectExpr("dk", "th", "cast(text as binary) as text")
    cut = _rows(width, gram)
    judged = R.judge(texts.mapInArrow(cut, R.RUNS), False, "suffix-runs", R.frequent(texts, cut, "suffix-often"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return R.spans(docs, judged, _pack(width), _compare(width), _hot(width, gram)).mapInArrow(_finish(width, with_bytes), out)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
