"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from mergelens.llm import periodic
from tests.llm.fixtures import SCHEMA, corpus, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(ws, least=24, power=3):
    out = {}
    for q in range(1, len(ws)):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(least, power * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def letters(rng):
    ws = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 50))]
    if len(ws) > 4 and rng.random() < 0.6:
        a, q = rng.randrange(len(ws)), rng.randint(1, 9)
        ws = [w if i < a else ws[a + (i - a) % q] if a + (i - a) % q < len(ws) else 0 for i, w in enumerate(ws)]
        ws = ws + ws[: rng.randrange(len(ws))] + ws * rng.randrange(2)
    return ws


@pytest.mark.parametrize(("least", "power"), [(2, 2), (3, 3), (6, 2), (8, 3), (24, 3), (20, 4)])
def test_runs_of_short_strings(least, power):
    rng = random.Random(least * power)
    found = 0
    for _ in range(1200):
        ws = letters(rng)
        want = brute(ws, least, power)
        assert periodic.word_runs(ws, least, power) == want
        assert periodic.text_runs([b"w%d" % w for w in ws], least, power) == want
        found += len(want)
    assert found > 100


def test_factors_are_longest_and_earlier():
    rng = random.Random(3)
    for _ in range(300):
        ws, at = letters(rng), 0
        for begin, n, earlier in periodic.factors(ws):
            assert begin == at and n >= 1
            earliest = lambda m: next((k for k in range(begin) if ws[k : k + m] == ws[begin : begin + m]), -1)  # noqa: B023, E731
            if earlier >= 0:
                assert earlier < begin and ws[earlier : earlier + n] == ws[begin : begin + n]
                assert begin + n == len(ws) or earliest(n + 1) < 0
            else:
                assert n == 1 and earliest(1) < 0
            at += n
        assert at == len(ws)


def test_a_long_text_of_one_word():
    assert periodic.word_runs([7] * 20_000) == [(0, 20_000, 1)]
    block = list(range(500))
    assert periodic.word_runs([-5, *block * 40, -6]) == [(1, 20_000, 500)]


def texts():
    rng = random.Random(11)
    rows = [(r[0], r[1]) for r in corpus()]
    for i in range(100, 140):
        a, b, c = prose(rng, rng.randint(0, 30)), prose(rng, rng.randint(1, 9)), prose(rng, rng.randint(0, 30))
        rows.append((i, f"{a} {' '.join([b] * rng.randint(2, 12))}\n{c}"))
    rows += [(200, "a " * 23), (201, "a " * 24), (202, "x y z " * 8), (203, ("p q " * 12 + "r ") * 4), (203, ("p q " * 12 + "r ") * 4), (None, "é è " * 30)]
    return rows


def expected(ws):
    runs = brute(ws)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, best, " ".join(w for i, w in enumerate(ws) if i not in gone)


def test_operator(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", None, 3, 1) for i, t in rows], "doc_id long, text string, runs string, best string, `a.b` int, `x y` int").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in periodic.periodic_runs(docs).collect())
    want = []
    for i, t in rows:
        ws = WORD.findall(t or "")
        runs, best, kept = expected(ws)
        want.append((str(i), len(ws), runs, best, kept))
    assert got == sorted(want, key=lambda r: r[:2])
    assert sum(len(r[2]) for r in want) > 20
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, least=1, power=3)


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic, "FLUSH", 2000)
    rows = texts()
    spark.createDataFrame([(*r, None, None, None, 1, "s", "f", "r") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op11_periodic(spark, str(tmp_path)).collect()]
    want, changed = [], 0
    for i, t in rows:
        ws = WORD.findall(t or "")
        h = None if i is None else zlib.crc32(str(i).encode())
        if ws and h is not None and h % 10 == 0:
            a = h // 10 % len(ws)
            p = 1 + (len(ws) - a) // (3 + h // 10 % 8)
            ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
            changed += 1
        runs, best, kept = expected(ws)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], _sha(listed), _sha(kept)))
    assert changed > 3
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_on_texts_without_words(spark, tmp_path):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]  # those in which words are planted
    rows = list(zip(ids, ["", " \n", None, "a b"], strict=True))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in periodic.op11_periodic(spark, str(tmp_path)).collect())
    h = zlib.crc32(str(ids[3]).encode()) // 10
    a, p = h % 2, 1 + (2 - h % 2) // (3 + h % 8)
    last = " ".join("ab"[i if i < a else a + (i - a) % p] for i in range(2))
    assert got == [(i, 0, None, None, None, None, _sha(""), _sha(t)) for i, t in zip(ids, ["", "", "", last], strict=True)]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
