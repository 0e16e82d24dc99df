"""Substring dedup by super-k-mer partitioning over words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mergelens.llm import _repeats as R
from mergelens.llm._rolling import BYTE_WORDS, grams, prefix, runs, sliding_argmin
from mergelens.llm._rolling import spans as span_hash

CHUNK = 1 << 19  # bytes of text hashed at once
SPACE = re.compile(rb"[\x20\x09-\x0d]")
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def word_pieces(data: bytes, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text in pieces that share ``overlap`` words, each with the number of its first word."""
    at, base, carry = 0, 0, []
    while at < len(data) or not base and not carry:
        end = at + CHUNK
        if end < len(data):
            found = SPACE.search(data, end)
            end = found.start() if found else len(data)
        words = carry + data[at:end].split()
        yield base, words
        if end >= len(data):
            return
        carry = words[-overlap:] if overlap else []
        base += len(words) - len(carry)
        at = end


def _superkmers(pieces: list[tuple[int, int, list[bytes]]], width: int, m: int) -> list[np.ndarray]:
    """For pieces (row, first word, words): mh, dg, row, start, n of each run of windows that share a minimiser."""
    joined = b" ".join(b" ".join(ws) for _, _, ws in pieces)
    values = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(values == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(values)]])
    words = span_hash(prefix(BYTE_WORDS[values]), starts, ends)
    gram = grams(prefix(words), m)
    best = sliding_argmin(gram, width - m + 1)
    lens = np.array([len(ws) for _, _, ws in pieces])
    piece = np.repeat(np.arange(len(pieces)), lens)
    first = np.cumsum(lens) - lens
    at = np.flatnonzero(piece[: len(best)] == piece[width - 1 : width - 1 + len(best)])
    chosen = best[at]
    a, b = runs(chosen * np.int64(2) ** 31 + (at - np.arange(len(at))))  # a gap in the windows ends a run too
    i, j = at[a], at[b - 1] if len(b) else at[:0]
    digest = xxhash.xxh3_64_intdigest
    dg = np.array([digest(joined[s:e]) for s, e in zip(starts[i].tolist(), ends[j + width - 1].tolist(), strict=True)], np.uint64)
    rows, bases = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    return [gram[chosen[a]].view(np.int64), dg.view(np.int64), rows[piece[i]], i - first[piece[i]] + bases[piece[i]], j - i + 1]


def _rows(width: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dk, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dk", "th"))
            parts, group, size = [], [], 0
            for row, text in enumerate(b.column("text")):
                for base, words in word_pieces(text.as_py(), width - 1):
                    if len(words) >= width:
                        group.append((row, base, words))
                        size += sum(map(len, words))
                        if size >= CHUNK:
                            parts.append(_superkmers(group, width, m))
                            group, size = [], 0
            if group:
                parts.append(_superkmers(group, width, m))
            if parts:
                mh, dg, row, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield R.combine(mh, dg, dk[row], th[row], start, n, True)

    return run


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, body, dk, th, start = [], [], [], [], []
            for k, t, text, wanted in zip(*(b.column(c).to_pylist() for c in ("dk", "th", "text", "runs")), strict=True):
                words = text.split()
                for r in wanted:
                    s, n = r["start"], r["n"]
                    if r["hot"]:
                        made = [(b" ".join(words[i : i + width]), i) for i in range(s, s + n)]
                        bucket += [xxhash.xxh3_64_intdigest(x) - 2**63 for x, _ in made]
                    else:
                        made = [(b" ".join(words[s : s + n - 1 + width]), s)]
                        bucket.append(r["mh"])
                    body += [x for x, _ in made]
                    start += [i for _, i in made]
                    dk += [k] * len(made)
                    th += [t] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(body, pa.binary()), pa.array(dk, pa.int64()), pa.array(th, pa.int64()), pa.array(start, pa.int32())], ["bucket", "body", "dk", "th", "start"])

    return run


def _compare(width: int):
    def run(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorts the windows of each bucket; all but the earliest of equal ones come back."""
        buckets, bodies, dks, ths, starts = (t.column(c).to_pylist() for c in ("bucket", "body", "dk", "th", "start"))
        out: list[tuple[int, int, int]] = []
        k = 0
        while k < len(buckets):
            windows, end = [], k
            while end < len(buckets) and buckets[end] == buckets[k]:
                body, dk, th, start = bodies[end], dks[end], ths[end], starts[end]
                words = body.split(b" ")
                lens = [len(w) + 1 for w in words]
                a, b = 0, sum(lens[:width]) - 1
                for i in range(len(words) - width + 1):
                    windows.append((body[a:b], dk, th, start + i))
                    a += lens[i]
                    b += lens[i + width] if i + width < len(words) else 0
                end += 1
            windows.sort()
            head = None
            for w in windows:
                if head is None or w[0] != head[0]:
                    head = w
                elif w != head:  # a repeated row is no second occurrence
                    out.append(w[1:])
            k = end
        got = np.array(out, np.int64).reshape(-1, 3)
        return got[:, 0], got[:, 1], got[:, 2]

    return run


def _finish(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words, gone = text.split(), R.covered(found, width)
                kept, at = [], 0
                for s, e in gone:
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                if with_text:
                    texts.append(_without(text, gone) if gone else text)
            cols = [R.doc_id(b.column("dk")), b.column("th"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "th", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array([x.decode() for x in texts], pa.string()), b.column("row")], [*names, "text", "row"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The text without the words in ``gone`` and the white space after each."""
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, last = [], 0
    for s, e in gone:
        out.append(text[last : at[s]])
        last = at[e]
    out.append(text[last:])
    return b"".join(out)


def substring_dedup(docs: DataFrame, width: int = 20, m: int = 5, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, n_words, n_removed, kept_sha256 of every row of ``docs`` and, if asked for, the kept text and a struct
    ``row`` of the columns besides the text.

    Removes each word covered by a window of ``width`` words whose sequence also starts earlier: in a document of smaller
    doc_id, or earlier in the same one. Windows are judged on the input. Words are runs of bytes other than ASCII white
    space; a null text has none. A null doc_id comes before all others; documents with one id but several texts are
    ordered by a hash of the text; rows that repeat both are one document and all get its result. An empty table gives an
    empty one, a text of fewer words than a window stays whole.
    """
    row, places = None, []
    if with_text:  # columns by their places: names may hold anything
        names = docs.columns
        places = [k for k, c in enumerate(names) if c != text_col]
        row = StructType([StructField(names[k], docs.schema[k].dataType) for k in places])
        docs = docs.toDF(*[c if c in (id_col, text_col) and names.index(c) == k else f"_{k}" for k, c in enumerate(names)])
    more = {"row": F.struct(*[docs.columns[k] for k in places])} if with_text else {}
    docs = R.keyed(docs, id_col, text_col, more)
    texts = docs.selectExpr("dk", "th", "cast(text as binary) as text")
    cut = _rows(width, m)
    judged = R.judge(texts.mapInArrow(cut, R.RUNS), True, "substring-runs", R.frequent(texts, cut, "substring-often"))
    out = [("doc_id", LongType()), ("th", LongType()), ("n_words", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType())]
    out += [("text", StringType()), ("row", docs.schema["row"].dataType)] if with_text else []
    done = R.spans(docs, judged, _pack(width), _compare(width)).mapInArrow(_finish(width, with_text), StructType([StructField(*c) for c in out]))
    return done.withColumn("row", F.col("row").cast(row)) if with_text else done


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
