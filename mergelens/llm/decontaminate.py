"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed is the shortest run of ``SHORT`` to ``LONG`` words of a test item, from each of its words on, that is rare: that
chance would put at a place of the corpus so seldom that all seeds together cause ``CHANCE`` alignments a document, words
taken one by one with their frequencies in all documents. A leaked item hardly moves those, so a leak of many copies doesn't make its own seeds common. Where a document
holds a seed, the item is aligned with the words around, and the score of the best local alignment, as a share of the
item's score with itself, tells edited copies from chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm._rolling import BYTE_WORDS, grams, prefix, spans
from mergelens.llm._store import shield
from mergelens.llm.toxicity import words

SHORT, LONG = 2, 6
#: Alignments of a document that chance may cause, all seeds of a block together.
CHANCE = 0.1
#: Words of a text that one alignment takes on at once.
REACH = 1 << 16
CHUNK = 1 << 18
MATCH, MISS, GAP = 2, -1, 1


def word_hashes(bags: list[list[bytes]]) -> np.ndarray:
    """A hash of each word of all bags, one after another."""
    joined = b" ".join(b" ".join(b) for b in bags if b)
    values = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(values == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(values)]])
    return spans(prefix(BYTE_WORDS[values]), starts, ends) if joined else np.zeros(0, np.uint64)


def _bags(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts in groups of some size: their rows, their numbers of words and the hashes of those."""
    rows, bags, size = [], [], 0
    for row, text in enumerate(texts):
        if ws := words(text):
            rows.append(row)
            bags.append(ws)
            size += sum(map(len, ws))
            if size >= CHUNK:
                yield rows, np.array([len(b) for b in bags]), word_hashes(bags)
                rows, bags, size = [], [], 0
    if bags:
        yield rows, np.array([len(b) for b in bags]), word_hashes(bags)


class Seeds:
    """The seeds of some test items: for each length sorted hashes, with the items and places that each stands for."""

    def __init__(self, items: list[np.ndarray], frequency: dict[int, float], rare: float = 1e-8):
        self.items = items
        found: dict[int, dict[int, list[tuple[int, int]]]] = {n: {} for n in range(1, LONG + 1)}
        for k, item in enumerate(items):
            logs = np.concatenate([[0.0], np.cumsum([math.log(max(frequency.get(int(w), 0.0), 1e-12)) for w in item])])
            hashed = {n: grams(prefix(item), n) for n in range(1, LONG + 1)}
            for i in range(len(item)):
                for n in range(min(SHORT, len(item)), LONG + 1):
                    if i + n > len(item):
                        break
                    if n == min(LONG, len(item)) or logs[i + n] - logs[i] <= math.log(rare):
                        found[n].setdefault(int(hashed[n][i]), []).append((k, i))
                        break
        self.tables = {}
        for n, seeds in found.items():
            if seeds:
                keys = np.array(sorted(seeds), np.uint64)
                self.tables[n] = keys, [seeds[int(x)] for x in keys]

    def hits(self, hashes: np.ndarray, text_of: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(text, item) to the places where the item would begin."""
        sums, out = prefix(hashes), {}
        for n, (keys, where) in self.tables.items():
            g = grams(sums, n)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            for i in np.flatnonzero((keys[at] == g) & (text_of[: len(g)] == text_of[n - 1 :])).tolist():
                for item, place in where[at[i]]:
                    out.setdefault((int(text_of[i]), item), []).append(i - place)
        return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment of two runs of words, and where it begins and ends in ``text``."""
    cols = np.arange(len(text) + 1)
    last, begin = np.zeros(len(text) + 1, np.int64), cols.copy()
    best = (0, 0, 0)
    for w in item:
        diagonal = last[:-1] + np.where(text == w, MATCH, MISS)
        now = np.concatenate([[0], np.maximum(np.maximum(diagonal, last[1:] - GAP), 0)])
        start = np.concatenate([[0], np.where(now[1:] == 0, cols[1:], np.where(now[1:] == diagonal, begin[:-1], begin[1:]))])
        run = np.maximum.accumulate(now + GAP * cols)  # gaps along the text
        came = np.maximum.accumulate(np.where(now + GAP * cols == run, cols, 0))
        last, begin = run - GAP * cols, start[came]
        top = int(last.argmax())
        if last[top] > best[0]:
            best = int(last[top]), int(begin[top]), top
    return best


def _best(own: np.ndarray, hashes: np.ndarray, places: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Score, begin and end of the best alignment of an item with a text (``low`` to ``high`` of ``hashes``) around the
    places where a seed would have it begin: one sweep over the sorted places. Stretches that overlap are aligned as one;
    a long one in parts that overlap by more words than an alignment of positive score can have, so none is cut."""
    near, best, k = len(own) // 2 + 1, (0, 0, 0), 0
    places = sorted(set(places))
    while k < len(places):
        first = places[k]
        while k + 1 < len(places) and places[k + 1] - near <= places[k] + len(own) + near:
            k += 1
        a, stop = max(low, first - near), min(high, places[k] + len(own) + near)
        while True:
            b = min(stop, a + REACH + 4 * len(own))
            got = align(own, hashes[a:b])
            if got[0] > best[0]:
                best = got[0], a + got[1], a + got[2]
            if b == stop:
                break
            a += REACH
        k += 1
    return best


def _matches(seeds: Seeds, threshold: float, texts: list[str | None]) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, number of words) of every item that a text holds."""
    for rows, lens, hashes in _bags(texts):
        ends = np.cumsum(lens)
        text_of = np.repeat(np.arange(len(lens)), lens)
        for (k, item), places in sorted(seeds.hits(hashes, text_of).items()):
            low, high, own = int(ends[k] - lens[k]), int(ends[k]), seeds.items[item]
            score, begin, end = _best(own, hashes, places, low, high)
            similarity = score / (MATCH * len(own))
            if similarity >= threshold:
                yield rows[k], item, similarity, begin - low, end - begin


def _prepared(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, Seeds]]:
    """Blocks of test items of bounded size, each with its seeds. Counts the items' words over all documents."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        some = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        ids, items = [r.item_id for r in some], [word_hashes([words(r.text)]) for r in some]
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *items]))

        def count(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray = vocabulary) -> Iterator[pa.RecordBatch]:
            totals, n, rows = np.zeros(len(vocabulary), np.int64), 0, 0
            for b in batches:
                rows += b.num_rows
                for _, lens, hashes in _bags(b.column("text").to_pylist()):
                    n += int(lens.sum())
                    if len(vocabulary):
                        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                        totals += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
            some = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(totals[some], [n, rows]))], ["w", "n"])

        counted = dict(docs.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n")).collect())  # a row a word of the items
        total, rows = max(1, counted.pop(-1, 0)), max(1, counted.pop(-2, 0))
        rare = min(1.0, CHANCE / max(1.0, sum(map(len, items)) * total / rows))
        yield ids, Seeds(items, {int(vocabulary[w]): n / total for w, n in counted.items()}, rare)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: a row for each document and test item that it holds whole, in
    part or edited, with a similarity of ``threshold`` or more, and where.

    Words are compared in lower case and without ASCII punctuation. ``benchmark`` (item_id, text) is the stated query
    set: it goes to the executors in blocks of ``block_bytes`` at most, a pass over the documents for each, and no
    document is joined with another. Null and empty texts hold and are held by nothing; repeated rows are each reported;
    a text that holds an item many times, or is one long repetition, has one row an item, of its best copy; empty tables
    give an empty one. Other columns are read by nothing.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for ids, seeds in _prepared(own.select("text"), benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], ids: list = ids, seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(_matches(seeds, threshold, b.column("text").to_pylist()))
                row, item, similarity, first, n = zip(*found, strict=True) if found else ((), (), (), (), ())
                cols = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array([ids[i] for i in item], pa.int64()), pa.array(similarity, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        got = own.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = got if out is None else out.union(got)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = 8_000_000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns as they are; see ``contaminated``."""
    docs, named = shield(docs, text_col)
    out, texts = docs, docs.select(F.col(text_col).alias("text"))
    for _, seeds in _prepared(texts, benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for row, *_ in _matches(seeds, threshold, b.column(text_col).to_pylist()):
                    clean[row] = False
                yield b.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return named(out)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
