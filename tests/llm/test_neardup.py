"""Near duplicates of the pipeline against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from mergelens.llm import neardup, simhash
from tests.llm.fixtures import prose, words
from tests.llm.test_dedup import AZ, WORD, fingerprint

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    ws = WORD.findall((text or "").translate(AZ))
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def similar(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def rows_of(seed=4):
    rng, rows = random.Random(seed), []
    for _ in range(60):  # copies with one to five words changed, some copied on: similarities on both sides of 0.8
        ws = words(rng, rng.randint(50, 260))
        rows.append(" ".join(ws))
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                ws = ws[:]
            for _ in range(rng.randint(1, 5)):
                ws[rng.randrange(len(ws))] = "".join(words(rng, 2))
            rows.append(" ".join(ws))
    rows += [None, "", " \n", "one two", "One  TWO", "one two three", rows[0].upper(), prose(rng, 3000)]
    rows.append(rows[-1] + " and more")
    return list(enumerate(rows))


def brute(rows):
    sets, top = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    for i, j in pairs:
        p, q = find(i), find(j)
        top[max(p, q)] = min(p, q)
    return {i: find(i) for i in range(len(rows))}, pairs


@pytest.mark.parametrize("cap, cell_cap", [(1 << 20, 2048), (300, 2)])
def test_groups_are_those_of_all_similar_pairs(spark, cap, cell_cap):
    rows = rows_of()
    want, pairs = brute(rows)
    far = [(i, j) for i, j in pairs if (fingerprint(rows[i][1]) ^ fingerprint(rows[j][1])).bit_count() > 4]
    assert len(far) > 20  # beyond the distance of op2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.group for r in neardup.near_duplicates(df, cap=cap, cell_cap=cell_cap).collect()}
    assert len(got) == len(rows)
    named = {}
    for i, g in got.items():
        named[g] = min(i, named.get(g, i))
    assert {i: named[g] for i, g in got.items()} == want


def test_stage_keeps_one_of_similar_texts(spark):
    rows = rows_of(8)
    want, _ = brute(rows)
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert Counter(r.doc_id for r in got.collect()) == Counter(set(want.values())) and got.columns == df.columns
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_forest_connects_what_is_similar():
    rng = np.random.default_rng(2)
    base = [rng.choice(5000, 100, replace=False) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[: 100 - k], rng.choice(5000, k)])).astype(np.uint64) for b in base for k in (0, 3, 8, 15, 40)]
    links = set(neardup._similar(sets, 0.8))
    assert all(len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) for i, j in links)
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in links:
        top[find(i)] = find(j)
    assert all(find(i) == find(j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])))


def test_sketches_pass_what_is_similar():
    rng = np.random.default_rng(5)
    cut, near, far = neardup.cutoff(0.8), 0, 0
    for _ in range(300):
        base = rng.integers(0, 2**64, 180, np.uint64)
        other = np.concatenate([base[:160], rng.integers(0, 2**64, 20, np.uint64)])  # a similarity of 0.8
        third = np.concatenate([base[:90], rng.integers(0, 2**64, 90, np.uint64)])  # one of a third
        sketches = np.stack([np.frombuffer(neardup._sketch(neardup._minima(np.unique(s))), np.uint8) for s in (base, other, third)])
        got = set(neardup._forest(sketches, np.zeros(3, int), cut))
        near += (0, 1) in got
        far += len(got) > 1
    assert (near, far) == (300, 0)
    # sides 1 and 2 meet only each other, side 0 everything
    same = np.zeros((4, 120), np.uint8)
    assert len(list(neardup._forest(same, np.array([1, 1, 1, 1]), cut))) == 0
    assert len(list(neardup._forest(same, np.array([1, 2, 1, 2]), cut))) == 3
    assert len(list(neardup._forest(same, np.array([0, 0, 0, 0]), cut))) == 3


@pytest.mark.parametrize("cap, cell_cap", [(1 << 20, 4096), (300, 2)])
def test_groups_by_simhash_are_those_of_all_similar_pairs(spark, cap, cell_cap):
    rows = rows_of(6)
    want, pairs = brute(rows)
    assert sum((fingerprint(rows[i][1]) ^ fingerprint(rows[j][1])).bit_count() > 4 for i, j in pairs) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.group for r in simhash.similar_texts(df, cap=cap, cell_cap=cell_cap).collect()}
    named = {}
    for i, g in got.items():
        named[g] = min(i, named.get(g, i))
    assert len(got) == len(rows) and {i: named[g] for i, g in got.items()} == want


def test_stage_asks_simhash(spark, monkeypatch):
    calls, real = [], simhash.wide_links
    monkeypatch.setattr(simhash, "wide_links", lambda *a: (calls.append(a), real(*a))[1])
    corpus_pipeline.near_dedup(spark, spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s")], SCHEMA), "")
    assert len(calls) == 1


@pytest.mark.parametrize("size", [46, 90, 400])
def test_wide_fingerprints_of_similar_sets(size):
    """Bits that differ, cells shared: within what is reckoned with, whether one set holds the other or both have some of their own."""
    rng, most = np.random.default_rng(size), simhash.reach(0.8)
    masks = simhash.drawn_grids(100_000, 0.8)
    apart, missed = [], 0
    for k in range(400):
        base = rng.integers(0, 2**64, size, np.uint64)
        a, b = (base, base[: -(-size * 4 // 5)]) if k % 2 else (base[: size - size // 10], base[size // 10 :])
        x, y = simhash.wide(np.unique(a)), simhash.wide(np.unique(b))
        apart.append(int(np.bitwise_count(x ^ y).sum()))
        missed += not ((simhash.embed(x) & masks) == (simhash.embed(y) & masks)).all(axis=1).any()
    assert missed == 0 and max(apart) <= most
    assert np.mean(apart) <= 256 * simhash.differing(0.8)


def test_forest_of_wide_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    rng = np.random.default_rng(1)
    fp = np.repeat(rng.integers(0, 2**64, (9, simhash.WORDS), np.uint64), 4, axis=0)
    fp[:, 0] ^= rng.integers(0, 8, len(fp)).astype(np.uint64)
    for side in (np.zeros(36, int), rng.integers(1, 3, 36)):
        near = lambda i, j: np.bitwise_count(fp[i] ^ fp[j]).sum() <= 2 and (side[i] == 0 or side[i] != side[j])  # noqa: B023, E731
        tops = []
        for links in (list(simhash._close(fp, side, 2)), [(i, j) for i in range(36) for j in range(i) if near(i, j)]):
            assert all(near(i, j) for i, j in links)
            top = list(range(36))
            for i, j in links:
                p, q = top[i], top[j]
                top = [min(p, q) if t in (p, q) else t for t in top]
            tops.append(top)
        assert tops[0] == tops[1]


def test_stars_join_what_links_join():
    nodes = np.array([50, 7, 30, 9, 8, 60])
    a, b = simhash._stars(nodes, [(0, 2), (2, 3), (1, 4)])
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {50: 9, 30: 9, 8: 7}
    assert len(simhash._stars(nodes, [])[0]) == 0
