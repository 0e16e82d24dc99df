"""Bottom-k sketches: groups against all pairs of whole sets."""

import random
import re
from collections import Counter
from math import comb

import numpy as np
import pytest

from mergelens.llm import bottomk
from tests.llm.fixtures import SCHEMA, corpus, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}


def shingles(text, n=3):
    ws = WORD.findall((text or "").translate(AZ))
    n = min(n, len(ws))
    return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if ws else frozenset()


def brute(rows, n, percent):
    """Of each row its set's size and the least id that links reach; rows without words are alone."""
    sets = [shingles(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def edited(rng, ws, share):
    return [rng.choice(["new", "word", "here"]) + str(rng.randrange(10**6)) if rng.random() < share else w for w in ws]


def texts():
    rng = random.Random(21)
    rows = [(r[0], r[1]) for r in corpus()]
    shared = words(rng, 90)  # a passage that many hold, some of them little else
    for g in range(12):
        base = words(rng, rng.choice([4, 12, 40, 150, 400]))
        for k in range(rng.randint(1, 9)):
            rows.append((1000 + 20 * g + k, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05])))))
    for k in range(60):
        rows.append((3000 + k, " ".join(shared + words(rng, rng.choice([1, 3, 8, 90, 300])))))
    base = words(rng, 120)  # many texts near the edge of the similarity, chained
    for k in range(70):
        rows.append((4000 + k, " ".join(base)))
        base = list(base)
        base[rng.randrange(len(base))] = f"step{k}"
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent", "k", "list_cap", "cap"), [(3, 85, 64, 2048, 1 << 20), (3, 85, 64, 7, 900), (5, 80, 32, 2048, 1 << 20), (3, 100, 64, 2048, 1 << 20)])
def test_groups(spark, n, percent, k, list_cap, cap):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, size int, node string, `a.b` int, `x y` int").repartition(4)
    got = bottomk.near_duplicates(docs, n, percent, k, list_cap, cap).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows, n, percent))
    assert len({r.group for r in got}) < len(rows) - (60 if percent < 100 else 15)


def test_query(spark, tmp_path):
    rows = texts()[:150]
    spark.createDataFrame([(*r, None, None, None, 1, "s", "f", "r") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = bottomk.op12_minhash(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter((i, s, c, i == c) for i, s, c in brute(rows, 3, 85))
    assert {r.kept for r in got if r.doc_id in (60, 61, 62)} <= {True}


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bottomk.near_duplicates(none).count() == 0
    assert bottomk.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_cutoff_is_safe():
    for k, percent in ((64, 85), (32, 80), (16, 85)):
        c, p = bottomk.cutoff(k, percent), percent / 100
        below = sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(c))
        assert below <= bottomk.MISS < below + comb(k, c) * p**c * (1 - p) ** (k - c)
    for kept in range(1, 65):  # whatever the partner, one of the listed values is common
        assert 1 <= bottomk.listed(kept, 64, 85) <= kept


def test_union_sketches_count_as_sets_do():
    rng = np.random.default_rng(4)
    for _ in range(200):
        k = int(rng.choice([4, 16, 64]))
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        if rng.random() < 0.7:
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], b[:3]]))
        least = sorted(set(a.tolist()) | set(b.tolist()))[:k]
        within = sum(x in set(a.tolist()) and x in set(b.tolist()) for x in least)
        exact = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        want = exact if max(len(a), len(b)) <= k else within >= bottomk.cutoff(k, 80)
        none = np.zeros(0, np.int64)
        got = bottomk._passing(a[:k], len(a), [b[:k]], np.array([len(b)]), none, [none], k, 80, bottomk.cutoff(k, 80))
        assert got.tolist() == [want]
