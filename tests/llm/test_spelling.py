"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from mergelens.llm import spelling
from tests.llm.fixtures import SCHEMA, corpus

RUN = re.compile("[A-Za-zÀ-ÿ]+")
AZ = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes one of the other, by trying."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, shortest=5, ratio=2):
    at = {w: [x for x in counts if len(w) >= shortest <= len(x) and near(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(at[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(at[w]), form[w], form[w] and counts[form[w]], root))
    return out


def dictionary(rng, size, alphabet="abcé", longest=9):
    out = {}
    while len(out) < size:
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(3, longest)))
        out[w] = rng.randint(1, 60)
        if rng.random() < 0.5:
            k = rng.randrange(len(w))
            out[w[:k] + rng.choice(["", w[k] * 2, "z", "日"]) + w[k + 1 :]] = rng.randint(1, 9)
    return out


@pytest.mark.parametrize(("cap", "shortest", "ratio", "cells"), [(400, 5, 2, 1 << 22), (3, 5, 2, 1 << 22), (1, 2, 3, 50), (20, 5, 2, 200)])
def test_variants(spark, monkeypatch, cap, shortest, ratio, cells):
    monkeypatch.setattr(spelling, "CELLS", cells)
    rng = random.Random(cap)
    counts = dictionary(rng, 420) | {"a" * 40: 3, "a" * 41: 8, "a" * 42: 20, "ab" * 30: 1, "ba" * 30: 1}
    rows = [(n, w, "x", 1) for w, n in counts.items()]
    words = spark.createDataFrame([*rows, (None, None, None, None)], "n long, word string, form string, `a.b` int").repartition(3)
    got = spelling.spelling_variants(words, shortest, ratio, cap).collect()
    want = brute(counts, shortest, ratio)
    assert {tuple(r) for r in got} == want and len(got) == len(counts)
    assert sum(r[2] for r in want) > 200 and any(r[3] and r[5] != r[3] for r in want)


def test_pairs_are_reported_once(spark):
    counts = dictionary(random.Random(7), 300)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    for cap in (2, 400):
        got = [frozenset((r.a, r.b)) for r in spelling.near_words(words, cap=cap).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {frozenset((a, b)) for a in counts for b in counts if a < b and len(a) >= 5 <= len(b) and near(a, b)}


def texts():
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in corpus()]
    base = ["".join(rng.choice("aeiourstnÉé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for i in range(300, 500):
        rows.append((i, " ".join(rng.choice(base).title() + rng.choice([" ", "-", "7", "×", "'"]) for _ in range(60))))
    return [*rows, (300, rows[-1][1]), (None, " ".join(base))]


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rows, counts = texts(), Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(AZ)
            h = None if i is None else zlib.crc32(f"{i}:{w}".encode())
            counts[w if h is None or h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    spark.createDataFrame([(*r, None, None, None, 1, "s", "f", "r") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute({w: n for w, n in counts.items() if n >= 3 and len(w) >= 5})
    got = spelling.op13_spelling(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r[3] for r in want)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.vocabulary(none)).count() == 0
    one = spark.createDataFrame([(1, None), (2, ""), (3, "12 34"), (4, "Seule")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.spelling_variants(spelling.vocabulary(one)).collect()] == [("seule", 1, 0, None, None, "seule")]
    with pytest.raises(ValueError):
        spelling.near_words(spelling.vocabulary(none), shortest=1)
