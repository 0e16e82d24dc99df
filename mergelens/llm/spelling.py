"""Spelling variants: words that one edit parts, found in a forward and a reversed sorted dictionary.

One edit leaves one half of the shorter word as it is: its first ``l // 2`` letters, or its last ones. So the two words
stand in one block of the dictionary that is sorted by the words, or of the one sorted by the words reversed; a block is a range
of words of length l and l + 1 that begin alike, and a task scans whole ranges. A block of more than ``CAP`` words is divided by
one more letter; a pair that this letter parts is then alike in all that follows it, which is a key of its own. So no
task holds a large block and no pair is lost. Each pair is reported once, by the place of its edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm._store import materialise

SHORTEST, SELDOM, RATIO = 5, 3, 2
#: Words of a block that one task compares.
CAP = 400
#: Distinct words that a task counts before it sends them on.
HELD = 1 << 18
#: Letters that are compared at once.
CELLS = 1 << 22
#: Runs of letters in UTF-8, A-Z being lower-cased: U+00C0 to U+00FF are C3 80 to C3 BF there.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BLOCK = ["side", "l", "depth", "key"]


def vocabulary(docs: DataFrame, change: Callable[[int | None, bytes], bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters [A-Za-z\\u00C0-\\u00FF] of all texts, A-Z lower-cased, and their occurrences.

    ``change`` makes another word of a run (UTF-8) by the document's id. A null text has no words. Words are counted in
    each task before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                if not t.is_valid:
                    continue
                words = Counter(LETTERS.findall(t.as_py().encode().lower()))
                if change is None:
                    total.update(words)
                else:
                    for w, n in words.items():
                        total[change(i, w)] += n
                if len(total) >= HELD:
                    yield out()
                    total.clear()
        yield out()

    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(name(id_col).cast("long").alias("id"), name(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _head(depth: Column) -> Column:
    return F.substring(F.col("t"), F.lit(1), depth)


def _rest(after: Column) -> Column:
    return F.substring(F.col("t"), after + 1, F.char_length("t"))


def _blocks(words: DataFrame, shortest: int, cap: int) -> DataFrame:
    """side, l, depth, key, wild, t, n: the words of every block of at most ``cap`` words. ``t`` is the word as its dictionary
    has it, side 1 reversed; wild blocks are of words that differ at ``depth``."""
    length = F.char_length("word")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("t")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("t")))
    rows = words.withColumn("l", F.explode(F.array(length, length - 1))).where(F.col("l") >= shortest)
    rows = rows.select("n", "l", F.explode(sides).alias("s")).select("s.side", "l", F.floor(F.col("l") / 2).cast("int").alias("depth"), "s.t", "n")
    parts, step = [], 0
    short = F.char_length("t") == F.col("l")
    while True:
        rows = materialise(rows.withColumn("key", _head(F.col("depth"))), f"spelling-rows-{step}")
        sizes = rows.groupBy(*BLOCK).agg(F.count("*").alias("all"), F.count(F.when(short, 1)).alias("short")).where("short > 0 and all > 1")
        sizes = materialise(sizes.select(*BLOCK, (F.col("all") > cap).alias("large")), f"spelling-sizes-{step}")
        sized = rows.join(sizes, BLOCK)
        parts.append(sized.where("not large").select(*BLOCK, F.lit(False).alias("wild"), "t", "n"))
        if sizes.where("large").isEmpty():
            break
        large = sized.where("large").drop("key", "large")
        d = F.col("depth")
        replaced = F.when(short & (F.char_length("t") > d), F.concat(_head(d), F.lit("\0"), _rest(d + 1)))
        inserted = F.concat(_head(d), F.lit("\1"), F.when(short, _rest(d)).otherwise(_rest(d + 1)))
        apart = large.withColumn("key", F.explode(F.array_compact(F.array(replaced, inserted))))
        parts.append(apart.select(*BLOCK, F.lit(True).alias("wild"), "t", "n"))
        rows = large.where(F.char_length("t") > d).withColumn("depth", d + 1)
        step += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _letters(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal first letters of each row of one with each of the other."""
    differ = x[:, None, :] != y[None, :, :]
    at = differ.argmax(axis=2)
    return np.where(differ.any(axis=2), at, x.shape[1])


def near_pairs(words: list[str], l: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:  # noqa: E741
    """Places of words one edit apart, the first of length ``l`` and the second of that or one more, with the numbers of their
    equal first and equal last letters."""
    size = np.array([len(w) for w in words])
    shorts, longs = np.flatnonzero(size == l), np.flatnonzero(size == l + 1)
    if not len(shorts):
        return
    s = _letters([words[i] for i in shorts], l)
    g = _letters([words[i] for i in longs], l + 1)
    step = max(1, CELLS // (l * len(words)))
    for k in range(0, len(shorts), step):
        mine = s[k : k + step]
        for theirs, other in ((s, shorts), (g, longs)):
            if not len(other):
                continue
            ahead, back = _alike(mine, theirs[:, :l]), _alike(mine[:, ::-1], theirs[:, ::-1][:, :l])
            near = ahead + back >= l if other is longs else (ahead + back == l - 1) & (shorts[k : k + step, None] < shorts[None, :])
            i, j = np.nonzero(near)
            yield shorts[k + i], other[j], ahead[i, j], back[i, j]


def near_words(words: DataFrame, shortest: int = SHORTEST, cap: int = CAP) -> DataFrame:
    """(a, a_n, b, b_n): pairs of ``words`` (word, n; distinct) that differ by one inserted, deleted or replaced code point,
    each once. Words of fewer than ``shortest`` letters, at least two, are in none."""
    if shortest < 2:
        raise ValueError("a word of one letter has no half")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def out() -> Iterator[pa.RecordBatch]:
            (side, l, depth, _, wild), (words, n) = now, held  # noqa: E741
            n = np.array(n, np.int64)
            for i, j, ahead, back in near_pairs(words, l):
                first = back if side else ahead  # equal first letters as the words are written
                own = (first < l // 2) if side else np.ones(len(i), bool)
                own &= (ahead == depth) if wild else True
                if own.any():
                    i, j = i[own], j[own]
                    a, b = ([words[x][:: -1 if side else 1] for x in p.tolist()] for p in (i, j))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n[i]), pa.array(b, pa.string()), pa.array(n[j])], ["a", "a_n", "b", "b_n"])

        for batch in batches:
            for *block, t, n in zip(*(batch.column(c).to_pylist() for c in (*BLOCK, "wild", "t", "n")), strict=True):
                if block != now:
                    if len(held[0]) > 1:
                        yield from out()
                    now, held = block, ([], [])
                held[0].append(t)
                held[1].append(n)
        if len(held[0]) > 1:
            yield from out()

    order = [*BLOCK, "wild"]
    blocks = materialise(_blocks(words, shortest, cap), "spelling-blocks")
    return blocks.repartitionByRange(*order).sortWithinPartitions(*order, "t").mapInArrow(scan, "a string, a_n long, b string, b_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling. A form is more frequent than its word, so there
    is no circle and the rounds grow with the logarithm of the longest chain."""
    now, k = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots-0"), 0
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        k += 1
        now = materialise(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"spelling-roots-{k}")


def spelling_variants(words: DataFrame, shortest: int = SHORTEST, ratio: int = RATIO, cap: int = CAP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``words`` (word, n; distinct, whatever other columns).

    n_near is the number of words one edit away; form the one of them of greatest n (the smallest in code-point order of
    several) where that is at least ``ratio`` times the word's own, else null; root what forms lead to in the end, the
    word itself without a form. Words too short to be compared come back without near ones; null words go. An empty
    table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    own = materialise(words.where("word is not null").select("word", "n"), "spelling-words")
    pairs = near_words(own, shortest, cap)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("form"))).alias("top")
    near = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = own.join(near, "word", "left")
    fits = -F.col("top.less") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("top.form")).alias("form"), F.when(fits, -F.col("top.less")).alias("form_n"))
    rows = materialise(rows, "spelling-forms")
    roots = _roots(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def slip(doc_id: int | None, word: bytes) -> bytes:
    """The word as a careless writer leaves it: of each 97th, by the checksum of id and word, one letter is missing. Without an
    id all words are right."""
    if doc_id is None:
        return word
    h = zlib.crc32(b"%d:%b" % (doc_id, word))
    if h % 97:
        return word
    letters = word.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1 :]).encode()


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), slip)
    return spelling_variants(words.where((F.col("n") >= SELDOM) & (F.char_length("word") >= SHORTEST)))
