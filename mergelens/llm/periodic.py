"""Periodic runs of words: Kolpakov and Kucherov's algorithm.

A text's words are factorised by Lempel and Ziv with a suffix automaton. Runs that touch a factor's beginning are found by
Main's extensions, which look no further than the two factors beside it; every other run lies strictly inside a factor and
is copied from that factor's earlier occurrence. All steps are linear in the words.

The factorisation is needed only where a text repeats itself: in a run of ``least`` words or more, of which a period is
at most the ``power``-th part, every word lies in a window of ``least - least // power`` words that stands twice in the
text. So words that no such window covers are in no run, no run goes across them, and each stretch between them is a string
of its own.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm._rolling import grams, mix, prefix, runs as equal_runs

LEAST, POWER = 24, 3
#: A batch of results is sent on from so many bytes of text.
FLUSH = 1 << 22
RUN = "struct<start: long, length: long, period: long>"
_NONE = -1


class Automaton:
    """The suffix automaton of a sequence of numbers; ``first`` is where the strings of a state end first.

    Most states have one transition: it stands in ``letter`` and ``target``, and only those with more have a dict.
    """

    def __init__(self, word: Sequence[int]):
        n = 2 * len(word) + 2
        self.letter, self.target, self.first = (array("q", [_NONE]) * n for _ in range(3))
        self.more: dict[int, dict[int, int]] = {}
        self._grow(word, array("q", [_NONE]) * n, array("q", [0]) * n)

    def go(self, state: int, c: int) -> int:
        if self.letter[state] == c:
            return self.target[state]
        more = self.more.get(state)
        return more.get(c, _NONE) if more else _NONE

    def _put(self, state: int, c: int, to: int) -> None:
        if self.letter[state] in (_NONE, c):
            self.letter[state], self.target[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _grow(self, word: Sequence[int], link: array, length: array) -> None:
        go, put, first = self.go, self._put, self.first
        last, states = 0, 1
        for i, c in enumerate(word):
            now, states = states, states + 1
            length[now], first[now] = length[last] + 1, i
            p = last
            while p != _NONE and go(p, c) == _NONE:
                put(p, c, now)
                p = link[p]
            if p == _NONE:
                link[now] = 0
            else:
                q = go(p, c)
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    twin, states = states, states + 1
                    length[twin], first[twin], link[twin] = length[p] + 1, first[q], link[q]
                    self.letter[twin], self.target[twin] = self.letter[q], self.target[q]
                    if q in self.more:
                        self.more[twin] = dict(self.more[q])
                    while p != _NONE and go(p, c) == q:
                        put(p, c, twin)
                        p = link[p]
                    link[q] = link[now] = twin
            last = now


def factors(word: Sequence[int]) -> list[tuple[int, int, int]]:
    """(begin, length, earlier): each factor is the longest string that also begins at ``earlier`` < begin, or one letter
    that is new (earlier is -1). Occurrences may overlap."""
    auto, out, i, n = Automaton(word), [], 0, len(word)
    go, first = auto.go, auto.first
    while i < n:
        state, m, end = 0, 0, 0
        while i + m < n:
            to = go(state, word[i + m])
            if first[to] >= i + m:
                break
            state, m, end = to, m + 1, first[to]
        out.append((i, m, end - m + 1) if m else (i, 1, _NONE))
        i += max(m, 1)
    return out


def common(s: Sequence[int]) -> list[int]:
    """For each place the length of the longest common prefix of the string from there with the whole one."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    a = b = 0
    for i in range(1, n):
        k = min(b - i, z[i - a]) if i < b else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def crossing(word: Sequence[int], at: int, before: int, after: int, least: int, power: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs that touch the place ``at`` between a factor of ``before`` letters and one of ``after``:
    those that end in the latter and begin at or before it, and those that end with the former.

    A factor that began a period or more into such a run, and ended before it does, could be made longer; hence the bounds
    on the period and on how far a run goes to the left. What reaches a bound is no whole run and belongs to another place.
    """
    n, most = len(word), (before + after) // (power - 1)
    reach = min(before + most, at)
    if reach + after < least or not most:
        return
    right = list(word[at : min(at + after + 1, n)])
    left = list(word[at - reach : at])[::-1]
    low, high = at - reach, at + len(right)
    z_right, z_left = common(right), common(left)
    ahead = min(most, len(right))
    back = common(left + [_NONE] + right[:ahead][::-1] + left)[reach + 1 :]
    behind = min(most, reach)
    forth = common(right + [_NONE] + left[:behind][::-1] + right)[len(right) + 1 :]

    def whole(s: int, e: int, p: int) -> bool:
        return e - s >= max(least, power * p) and (s > low or low == 0) and (e < high or high == n)

    for p in range(1, ahead + 1):  # the letters at and at + p
        s, e = at - back[ahead - p], at + p + (z_right[p] if p < len(right) else 0)
        if whole(s, e, p):
            yield s, e, p
    for p in range(1, behind + 1):  # the letters at - p and at
        s, e = at - p - (z_left[p] if p < reach else 0), at + min(forth[behind - p], len(right))
        if whole(s, e, p):
            yield s, e, p


def word_runs(word: Sequence[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period), sorted, of the maximal runs of at least ``least`` letters and ``power`` (two or more) periods."""
    ends: dict[int, dict[int, int]] = {}

    def add(s: int, e: int, p: int) -> None:
        here = ends.setdefault(s, {})
        here[e] = min(p, here.get(e, p))

    before = 0
    for begin, length, earlier in [*factors(word), (len(word), 0, _NONE)]:
        for run in crossing(word, begin, before, length, least, power):
            add(*run)
        if ends and earlier != _NONE:
            shift, stop = begin - earlier, earlier + length
            for s in range(earlier + 1, stop - least):
                for e, p in list(ends.get(s, {}).items()):
                    if e < stop:
                        add(s + shift, e + shift, p)
        before = length
    return sorted((s, e - s, p) for s, here in ends.items() for e, p in here.items())


def stretches(words: Sequence[bytes], width: int) -> list[tuple[int, int]]:
    """Maximal ranges of words that windows of ``width`` words cover which stand twice in the text."""
    if len(words) <= width:
        return []
    h = mix(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    g = grams(prefix(h), width)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    if not twice.any():
        return []
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    inside = np.cumsum(edge)[:-1] > 0
    starts, stops = equal_runs(inside)
    return [(a, b) for a, b in zip(starts.tolist(), stops.tolist(), strict=True) if inside[a]]


def text_runs(words: Sequence[bytes], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """``word_runs`` of a text's words."""
    out = []
    for a, b in stretches(words, least - least // power):
        if b - a >= least:
            number: dict[bytes, int] = {}
            letters = [number.setdefault(w, len(number)) for w in words[a:b]]
            out += [(a + s, m, p) for s, m, p in word_runs(letters, least, power)]
    return out


def _best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    top = None
    for s, m, p in found:  # by start, then period
        if top is None or m * top[2] > top[1] * p:
            top = (s, m, p)
    return top


def collapse(words: Sequence[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stay: of each run only its first period, unless another run drops that."""
    gone = bytearray(len(words))
    for s, m, p in found:
        gone[s + p : s + m] = b"\1" * (m - p)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) for every row: its maximal runs (start, length, period; by start, then
    period) of at least ``least`` words and ``power`` periods, the one of greatest length by period (the first of several;
    null without runs), and the text without what runs repeat, its words joined by one space.

    A word is what stands between blanks (\\x20, \\x09-\\x0D), unchanged. A null text has no words. Each row is judged on its
    own, repeated rows and ids alike, and a null id is returned as it is; other columns are not looked at. An empty
    table gives an empty one. A task holds one batch of rows and, for one text at a time, some 60 bytes a repeated word.
    """
    if power < 2 or least < power:
        raise ValueError("a run has two periods or more, and a word for each")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            ids, n, runs, best, kept, size, begin = b.column("doc_id"), [], [], [], [], 0, 0
            for k, t in enumerate(b.column("text")):
                words = (t.as_py() or "").encode().split()
                found = text_runs(words, least, power)
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                top = _best(found)
                best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                kept.append(b" ".join(collapse(words, found) if found else words).decode())
                size += len(kept[-1])
                if size >= FLUSH or k + 1 == len(ids):
                    cols = [ids.slice(begin, k + 1 - begin), pa.array(n, pa.int64()), pa.array(runs, pa.list_(kind)), pa.array(best, kind), pa.array(kept, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "best", "collapsed"])
                    n, runs, best, kept, size, begin = [], [], [], [], 0, k + 1

    rows = docs.select(F.col(_name(id_col)).cast("long").alias("doc_id"), F.col(_name(text_col)).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``documents``; of each tenth document by the checksum of its id the words from some place on repeat
    with a period of their own. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("ws"))
    n, g = F.nullif(F.size("ws"), F.lit(0)), F.floor(F.col("h") / 10)  # no remainder by zero words: it would be an error
    rows = rows.withColumn("n", n).withColumn("a", (g % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + g % 8)) + 1).cast("int"))
    rest: Column = F.col("n") - F.col("a")
    period = F.slice("ws", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), again), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
