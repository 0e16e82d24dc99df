"""SimHash, substring and suffix dedup against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from mergelens.llm import _repeats, simhash, substring, suffix
from mergelens.llm import components as connected
from mergelens.llm.components import components
from tests.llm.fixtures import SCHEMA, corpus, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


def fingerprint(text):
    ws = WORD.findall((text or "").translate(AZ))
    if not ws:
        return 0
    n = min(4, len(ws))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + n]).encode(), 42) for i in range(len(ws) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, distance=4):
    """Fingerprint to the least one reachable."""
    distinct = sorted(set(fps))
    top = {f: f for f in distinct}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {f: find(f) for f in distinct}


def test_simhash(docs):
    rows = corpus()
    fps = [fingerprint(r[1]) for r in rows]
    group = groups(fps)
    least = defaultdict(list)
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[group[f]].append(r[0])
    want = Counter((r[0], f, min(least[group[f]], default=None)) for r, f in zip(rows, fps, strict=True))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want and len({x for _, _, x in got}) < len(rows) - 15


def test_more_fingerprints_more_grids():
    assert [simhash.spare_groups(n, 4) for n in (0, 10**5)] == [2, 2]
    chosen = [simhash.spare_groups(10**k, 4) for k in range(5, 13)]
    assert chosen == sorted(chosen) and chosen[-1] > 3
    for s in (2, 3, 5):  # fingerprints within the distance share ``s`` of the groups, so one of the cells
        assert len(simhash.grid_masks(4, s)) == math.comb(4 + s, s)


@pytest.mark.parametrize(("cap", "spare"), [(2048, None), (3, None), (2048, 4)])
def test_links_lose_no_component(spark, monkeypatch, cap, spare):
    if spare:
        monkeypatch.setattr(simhash, "spare_groups", lambda n, d: spare)
    rng = random.Random(3)
    fps = set()
    for _ in range(40):  # chains of neighbours and strangers
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(f)
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << rng.randrange(64)
    fps |= {0, 1, 15, 2**64 - 1}
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long").repartition(3), cell_cap=cap)
    pairs = [(r.a % 2**64, r.b % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    top = {f: f for f in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[max(find(a), find(b))] = min(find(a), find(b))
    assert {f: find(f) for f in fps} == groups(fps)


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 2**64, 5000, np.uint64)
    b[:2000] = a[:2000] ^ (np.uint64(1) << rng.integers(0, 64, 2000, np.uint64))
    bound = np.bitwise_count(simhash.embed(a) ^ simhash.embed(b))
    assert (bound <= np.bitwise_count(a ^ b)).all()
    counts = lambda x: np.stack([(x >> np.uint64(2 * s) & np.uint64(1)) + (x >> np.uint64(2 * s + 1) & np.uint64(1)) for s in range(32)]).astype(int)
    assert (np.abs(counts(a) - counts(b)).sum(axis=0) == bound).all()


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            top[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in top}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(docs):
    rows = corpus()
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs)).collect()
    group = groups([fingerprint(r[1]) for r in rows])
    assert sorted(group[fingerprint(r.text)] for r in kept) == sorted(set(group.values()))
    least = defaultdict(set)
    for r in rows:
        least[group[fingerprint(r[1])]].add(r[0])
    for r in kept:
        ids = least[group[fingerprint(r.text)]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)
    assert kept[0].asDict().keys() == dict(docs.dtypes).keys()


def order(rows):
    """Documents in order: a null id first, then by id, then by the text's hash; repeated rows are one."""
    from mergelens.llm._store import NO_ID

    spark_hash = {t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)) for t in {r[1] or "" for r in rows}}
    return sorted({(NO_ID if r[0] is None else r[0], spark_hash[r[1] or ""], r[1] or "") for r in rows})


def brute_substring(rows, width):
    seen, out = set(), {}
    for dk, _, text in order(rows):
        ws = WORD.findall(text)
        gone = [False] * len(ws)
        for j in range(len(ws) - width + 1):
            w = tuple(ws[j : j + width])
            if w in seen:
                gone[j : j + width] = [True] * width
            seen.add(w)
        kept = [x for x, g in zip(ws, gone, strict=True) if not g]
        out[dk, text] = (len(ws), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize(("width", "hot", "chunk", "often"), [(20, 2000, 1 << 19, 24), (20, 1, 400, 2), (8, 2, 1 << 19, 24), (8, 2000, 1 << 19, 1)])
def test_substring(docs, monkeypatch, width, hot, chunk, often):
    from mergelens.llm._store import NO_ID

    monkeypatch.setattr(_repeats, "HOT", hot)
    monkeypatch.setattr(_repeats, "OFTEN", often)
    monkeypatch.setattr(substring, "CHUNK", chunk)
    want = brute_substring(corpus(), width)
    got = substring.substring_dedup(docs, width=width, m=4, with_text=True).collect()
    assert len(got) == len(corpus())
    removed = 0
    for r in got:
        text = next(t for (dk, t) in want if dk == (NO_ID if r.doc_id is None else r.doc_id) and _hash(t) == r.th)
        n, gone, digest, kept = want[NO_ID if r.doc_id is None else r.doc_id, text]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, digest)
        assert WORD.findall(r.text) == kept and (gone or r.text == text)
        removed += gone
    assert removed > 300


def _hash(t):
    return int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))


def brute_suffix(rows, width):
    texts = {(dk, t): t.encode() for dk, _, t in order(rows)}
    counts = Counter(t[j : j + width] for t in texts.values() for j in range(len(t) - width + 1))
    out = {}
    for key, t in texts.items():
        gone = bytearray(len(t))
        for j in range(len(t) - width + 1):
            if counts[t[j : j + width]] > 1:
                gone[j : j + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[key] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("width", "gram", "hot", "chunk", "often"), [(400, 100, 2000, 1 << 19, 24), (100, 24, 1, 700, 2), (60, 16, 3, 1 << 19, 24), (60, 16, 2000, 1 << 19, 1)])
def test_suffix(docs, monkeypatch, width, gram, hot, chunk, often):
    from mergelens.llm._store import NO_ID

    monkeypatch.setattr(_repeats, "HOT", hot)
    monkeypatch.setattr(_repeats, "OFTEN", often)
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    want = brute_suffix(corpus(), width)
    rows = suffix.suffix_dedup(docs, width=width, gram=gram).collect()
    got = Counter((NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == Counter((NO_ID if r[0] is None else r[0], *want[NO_ID if r[0] is None else r[0], r[1] or ""]) for r in corpus())


def test_empty_tables(docs):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == substring.substring_dedup(none).count() == suffix.suffix_dedup(none).count() == 0


def test_word_pieces():
    rng = random.Random(1)
    text = prose(rng, 900).encode()
    held, substring.CHUNK = substring.CHUNK, 300
    try:
        pieces = list(substring.word_pieces(text, 7))
    finally:
        substring.CHUNK = held
    ws = text.split()
    assert all(p == ws[base : base + len(p)] for base, p in pieces)
    starts = [base + j for base, p in pieces for j in range(len(p) - 7)]
    assert starts == list(range(len(ws) - 7))


def test_components_of_a_group_linked_many_times_over(spark, monkeypatch):
    """One group as 60 cells of a sixth of its nodes give it: of the edges of all stars few more than one a node go on to the rounds."""
    rng, n = random.Random(3), 300
    cells = [sorted(rng.sample(range(n), n // 6)) for _ in range(60)]
    edges = [(c[0], x) for c in cells for x in c[1:]]
    written, real = {}, connected.materialise
    monkeypatch.setattr(connected, "materialise", lambda df, label: written.setdefault(label, real(df, label)))
    got = {r.node: r.component for r in connected.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(sorted({x for e in edges for x in e}), 0)
    assert len(set(edges)) > 5 * n and written["cc-0"].count() < 1.2 * n
