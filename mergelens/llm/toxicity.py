"""Toxicity from bags of subwords: embeddings averaged over a window of words into a linear softmax.

A word is the bag of its character 3- to 5-grams and itself, so an unseen misspelling shares the vectors of the grams it
keeps. Embeddings and softmax are trained jointly in numpy. A label marks a text, not a place in it, so training
alternates: the windows of clean texts are clean, those of a toxic text that score highest are toxic. A text's score is
that of its worst window, calibrated on the training texts.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm._rolling import BYTE_WORDS, grams, mix, prefix, spans

BITS = 18
SIZES = (3, 4, 5)
WINDOW = 8  # words of a window, and the scale of its average
PART = 16_000  # words of a long text whose windows are scored at once
CHUNK = 1 << 18
MARKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


@dataclass
class Model:
    """What scoring needs: a number for each bucket of grams (its embedding along the softmax's direction), the bias, and
    the calibration (slope, offset) of a text's highest logit."""

    toxic: np.ndarray
    bias: float
    slope: float
    offset: float


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(MARKS).split()


def subwords(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the grams of each word, and the word that each belongs to."""
    joined = b"<" + b"><".join(ws) + b">"
    lens = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(ws)), lens)
    sums = prefix(BYTE_WORDS[np.frombuffer(joined, np.uint8)])
    ids, idx = [spans(sums, ends - lens, ends)], [np.arange(len(ws))]
    for n in SIZES:
        g = grams(sums, n)
        inside = owner[: len(g)] == owner[n - 1 :]
        ids.append(mix(g[inside] + np.uint64(n)))
        idx.append(owner[: len(g)][inside])
    return (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(idx)


def _windows(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: first word and number of words of each window, and the text it is of."""
    per = -(-lens // WINDOW)
    of = np.repeat(np.arange(len(lens)), per)
    first = (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
    size = np.minimum(WINDOW, lens[of] - first)
    return (np.cumsum(lens) - lens)[of] + first, size, of


def train(texts: list[str], labels: list[int], dim: int = 4, rounds: int = 3, steps: int = 24, rate: float = 0.1, decay: float = 1e-6, least: int = 3, aside: int = 5, seed: int = 0) -> Model:
    """Fits a model; words of fewer than ``least`` texts are left out, so that no text is learnt by heart. One text in
    ``aside``, by its hash, is kept for the calibration."""
    kept = [i for i, t in enumerate(texts) if zlib.crc32(t.encode("utf-8", "replace")) % aside]
    spare = [i for i in range(len(texts)) if i not in set(kept)] if len(kept) < len(texts) else []
    model = _fit([words(texts[i]) for i in kept], [labels[i] for i in kept], dim, rounds, steps, rate, decay, least, seed)
    top = _top(model, [texts[i] for i in spare])
    y = np.array([labels[i] for i in spare], float)
    share = (sum(labels) + 1) / (len(labels) + 2)
    # two numbers by Newton steps; without evidence to the contrary, a flat line at the share of toxic texts
    a, c = 0.1, float(np.log(share / (1 - share)))
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * top + c, -30, 30)))
        s = p * (1 - p) + 1e-6
        ga, gc = ((p - y) * top).sum() + 1e-2 * a, (p - y).sum()
        haa, hac, hcc = (s * top * top).sum() + 1e-2, (s * top).sum(), s.sum() + 1e-2
        det = haa * hcc - hac * hac
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        a, c = a - np.clip(da, -1, 1), c - np.clip(dc, -1, 1)
        if abs(da) + abs(dc) < 1e-9:
            break
    model.slope, model.offset = float(max(a, 0.0)), float(c)
    return model


def _fit(bags: list[list[bytes]], labels: list[int], dim: int, rounds: int, steps: int, rate: float, decay: float, least: int, seed: int) -> Model:
    y = np.array(labels)
    vocabulary: dict[bytes, int] = {}
    spread: dict[bytes, int] = {}
    for bag in bags:
        for w in set(bag):
            spread[w] = spread.get(w, 0) + 1
    for w, n in spread.items():
        if n >= least:
            vocabulary[w] = len(vocabulary)
    if not vocabulary or len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 0.0)
    lens = np.array([len(b) for b in bags])
    first, size, of = _windows(lens)
    flat = np.fromiter((vocabulary.get(w, -1) for b in bags for w in b), np.int64, int(lens.sum()))
    window_of = np.repeat(np.arange(len(first)), size)
    known = flat >= 0
    word, place = flat[known], window_of[known]
    ids, owner = subwords(list(vocabulary))
    order = np.argsort(owner, kind="stable")
    ids, owner = ids[order], owner[order]
    used, ids = np.unique(ids, return_inverse=True)
    share = (1 / np.bincount(owner, minlength=len(vocabulary))).astype(np.float32)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (len(used), dim)).astype(np.float32)
    w, b = rng.normal(0, 1, dim).astype(np.float32), np.float32(-1)
    part = (WINDOW / np.maximum(size, 1)).astype(np.float32)
    m, v, t = [np.zeros_like(e), np.zeros_like(w), np.float32(0)], [np.zeros_like(e), np.zeros_like(w), np.float32(0)], 0

    def total(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(index, values[:, d], n) for d in range(values.shape[1])], 1).astype(np.float32)

    def forward() -> tuple[np.ndarray, np.ndarray]:
        vec = total(owner, e[ids], len(vocabulary)) * share[:, None]
        hid = total(place, vec[word], len(first)) * part[:, None]
        return hid, hid @ w + b

    goal = y[of].astype(np.float32)
    weight = np.ones(len(first), np.float32)
    for k in range(rounds):
        if k:  # of a toxic text the best windows alone
            top = np.full(len(bags), -np.inf)
            np.maximum.at(top, of, logit)
            weight = np.where(y[of] == 0, 1, ((logit >= top[of]) | (logit > 0)).astype(np.float32)).astype(np.float32)
        for _ in range(steps):
            hid, logit = forward()
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            g = weight * (p - goal) / weight.sum()
            back = (g * part)[place, None] * w[None, :]
            dv = total(word, back, len(vocabulary)) * share[:, None]
            grads = [total(ids, dv[owner], len(used)) + decay * e, hid.T @ g + decay * w, g.sum()]
            t += 1
            for i, (x, d) in enumerate(zip((e, w, b), grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.99 * v[i] + 0.01 * d * d
                step = rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
                if i == 2:
                    b = np.float32(b - step)
                else:
                    x -= step.astype(np.float32)
        _, logit = forward()
    toxic = np.zeros(1 << BITS, np.float32)
    toxic[used] = e @ w
    return Model(toxic, float(b), 1.0, 0.0)


def score(model: Model, texts: list[str | None]) -> np.ndarray:
    """Score in [0, 1] of each whole text; one without words has that of no evidence."""
    return 1 / (1 + np.exp(-np.clip(model.slope * _top(model, texts) + model.offset, -30, 30)))


def _top(model: Model, texts: list[str | None]) -> np.ndarray:
    """The highest logit of the windows of each text: one from every word on, and the short last one of ``_windows``."""
    top = np.full(len(texts), model.bias)
    group: list[tuple[int, list[bytes], int]] = []  # row, words, and those of the last that training had as a short window

    def flush() -> None:
        lens, tail = np.array([len(b) for _, b, _ in group]), np.array([x for _, _, x in group])
        ids, owner = subwords([w for _, b, _ in group for w in b])
        n = int(lens.sum())
        value = np.bincount(owner, model.toxic[ids], n) / np.bincount(owner, minlength=n)
        # a window begins at each word that has WINDOW words from there on; a shorter text is one window, filled with zeros
        width = np.maximum(lens, WINDOW)
        begin = np.cumsum(width) - width
        padded = np.zeros(int(width.sum()))
        padded[np.arange(n) + np.repeat(begin - (np.cumsum(lens) - lens), lens)] = value
        sums = sum(padded[k : len(padded) - WINDOW + 1 + k] for k in range(WINDOW))
        per = width - WINDOW + 1
        at = np.cumsum(per) - per
        logit = sums[np.arange(int(per.sum())) + np.repeat(begin - at, per)] * np.repeat(WINDOW / np.minimum(lens, WINDOW), per) + model.bias
        rows = np.array([r for r, _, _ in group])
        best = np.maximum.reduceat(logit, at)
        end = begin + width
        last = sum(np.where(k <= tail, padded[end - k], 0.0) for k in range(1, WINDOW))
        best = np.where(tail > 0, np.maximum(best, last * (WINDOW / np.maximum(tail, 1)) + model.bias), best)
        for r, x in zip(rows.tolist(), best.tolist(), strict=True):
            top[r] = x if not seen[r] else max(top[r], x)
            seen[r] = True
        group.clear()

    seen = np.zeros(len(texts), bool)
    size = 0
    for row, text in enumerate(texts):
        ws = words(text)
        for at in range(0, ws and max(1, len(ws) - WINDOW + 1) or 0, PART):  # the windows that begin in a part of a long text
            part = ws[at : at + PART + WINDOW - 1]
            group.append((row, part, len(ws) % WINDOW if at + len(part) == len(ws) > WINDOW else 0))
            size += sum(map(len, part))
            if size >= CHUNK:
                flush()
                size = 0
    if group:
        flush()
    return top


def toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = 5000, sample_chars: int = 12_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    ``labels``: doc_id, toxic 0/1. Learns from labelled rows whose crc32(doc_id as text) is no multiple of ``folds``: of
    those with the lowest hash of their id, ``sample_docs`` at most, the texts of ``sample_chars`` characters at most.
    Equal texts are learnt once; null labels are ignored; without labels of both kinds every score is the smoothed share of
    toxic ones. Scores read the whole text and nothing but it: repeated rows score alike, null and empty texts as if
    nothing were known of them. A null doc_id is not held out. An empty table gives an empty one.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null and doc_id is not null").where(fold != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    short = own.where(F.char_length("text") <= sample_chars)
    # at most sample_docs labels, so the broadcast is bounded; equal texts go on once
    rows = short.join(F.broadcast(known), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.text)
    model = train([r.text for r in rows], [int(r.toxic) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(model, b.column("text").to_pylist()))], ["doc_id", "score"])

    held = F.coalesce(fold == 0, F.lit(False))
    return own.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
