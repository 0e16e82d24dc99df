"""Sharding, tokens, quality, decontamination, licences, URLs and toxicity."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from mergelens.llm import decontaminate, licenses, pieces, quality, shards, toxicity, urls
from tests.llm.fixtures import SCHEMA, corpus, prose, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


# sharding


def check_shards(rows, source, k, tolerance):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in source)
    total, slots = Counter(), defaultdict(list)
    for r in rows:
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(total) <= set(range(k))
    mean = sum(total.values()) / k
    assert max(abs(total[s] - mean) for s in range(k)) <= tolerance * mean
    return total


def test_shards_have_equal_bytes_and_whole_groups(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(5, 60)) for _ in range(1500)]
    source = [(i, texts[i % 1400] if i < 2000 else texts[3]) for i in range(2200)]
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, i * 7 % 50) for i, t in source], "doc_id long, text string, lang string, score int")
    rows = shards.kd_shards(df, ["lang", "score", "doc_id"], n_shards=8).collect()
    check_shards(rows, source, 8, 0.02)
    homes = defaultdict(set)
    for r in rows:
        homes[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())


def test_a_group_larger_than_a_shard_is_cut(spark):
    source = [(i, "same text " * 5 if i % 2 else f"own {i} " * 6) for i in range(3000)]
    rows = shards.kd_shards(spark.createDataFrame(source, "doc_id long, text string"), ["doc_id"], n_shards=5).collect()
    check_shards(rows, source, 5, 0.12)


def test_shards_are_a_tree_of_weighted_medians(spark):
    """Every split of the tree against brute force: along the widest dimension, at the point nearest to the weighted median."""
    rng = random.Random(3)
    xs, ys = rng.sample(range(10**6), 300), rng.sample(range(300), 300)
    rows = [(i, "t" * rng.randint(1, 400) + str(i), float(xs[i]) ** 3, float(ys[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x double, y double").repartition(3)
    shard = {r.doc_id: r.shard for r in shards.kd_shards(df, ["x", "y"], n_shards=6).collect()}
    points = [(r[2:], len(r[1]) + 1, shard[r[0]]) for r in rows]
    extent = [max(p[0][d] for p in points) - min(p[0][d] for p in points) for d in (0, 1)]
    todo = [(0, 6)]
    while todo:
        first, n = todo.pop()
        if n == 1:
            continue
        own = [p for p in points if first <= p[2] < first + n]
        axis = max((0, 1), key=lambda d: (max(p[0][d] for p in own) - min(p[0][d] for p in own)) / extent[d])
        own.sort(key=lambda p: p[0][axis])
        left = [p[2] < first + n // 2 for p in own]
        k = sum(left)
        assert all(left[:k]) and not any(left[k:])
        goal, before = sum(p[1] for p in own) * (n // 2) / n, sum(p[1] for p in own[:k])
        slack = sum(p[1] for p in points) / 6 * shards.SLACK
        assert abs(before - goal) <= min(abs(before - own[k - 1][1] - goal), abs(before + own[k][1] - goal)) + slack
        todo += [(first, n // 2), (first + n // 2, n - n // 2)]


@pytest.mark.parametrize("ids", [range(4000), [10**16 + 7 * i for i in range(4000)]])
def test_registered_shards_of_skewed_values(spark, tmp_path, ids):
    """Nearly all rows tie in all dimensions but the id, which is beyond the doubles' whole numbers; sizes differ widely."""
    rng = random.Random(9)
    rows = [(d, prose(rng, 1 + int(60 * rng.random() ** 4)) + str(i), "en", "hot" if i % 10 else f"s{i % 70}", 5) for i, d in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = shards.op1_shards(spark, str(tmp_path)).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 8
    assert len(got) == len(rows) and sorted(sizes) == list(range(8)) and all(abs(v / mean - 1) < 0.02 for v in sizes.values()), sizes
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {r[0]: (len(r[1].encode()) + 1, zlib.crc32(r[1].encode())) for r in rows}


def test_shards_of_odd_rows(spark, docs):
    source = [(r[0], r[1]) for r in corpus()]
    check_shards(shards.kd_shards(docs, ["lang", "source", "n_chars", "doc_id"], n_shards=3).collect(), source, 3, 0.9)
    one = shards.kd_shards(docs, ["doc_id"], target_bytes=10**9).collect()
    assert {r.shard for r in one} == {0}
    assert shards.kd_shards(docs.limit(0), ["doc_id"], n_shards=4).count() == 0
    ties = spark.createDataFrame([(1, "x")] * 40 + [(2, None)] * 3, "doc_id long, text string")
    assert len(shards.kd_shards(ties, ["doc_id"], n_shards=4).collect()) == 43


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}" * 9) for i in range(50)], "doc_id long, text string")
    got = shards.kd_shards(df, ["doc_id"], n_shards=2)
    shards.write_shards(df, got, str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1}


# tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    return data, sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Vocabulary(data)


def test_tokens_are_the_library_s(spark, docs, model):
    _, library, _ = model
    rows = pieces.tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, with_text=True).collect()
    want = Counter()
    for r in corpus():
        ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
        back = library.decode(ids)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), tuple(ids), back] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in rows) == want
    assert pieces.tokenize(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_random_strings(model):
    data, library, v = model
    rng = random.Random(4)
    alphabet = "ab the\n\t  ▁é日😀.,<s>x0€ﬁ\0ıing##"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "▁", "\n", "word" * 40]
    got = [np.frombuffer(e, "<u4").tolist() for e in pieces.encode_batch(data, texts)]
    assert got == library.encode(texts)
    assert [v.agenda(("▁" + t.replace(" ", "▁")) if t else "") for t in texts[:400]] == got[:400]


def test_random_ids(model):
    _, library, v = model
    rng = random.Random(5)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, 3, 100, 198, 228, 240, 162, 194, 259, 264, 300, 28705]) for _ in range(rng.randint(0, 9))]
        assert v.decode(ids) == library.decode(ids)


def test_other_kinds_are_refused(model):
    with pytest.raises(ValueError):
        pieces.Vocabulary(b"")


# quality


def features(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + o for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_features(docs):
    got = quality.quality(docs).collect()
    want = Counter((r[0], r[1], *features(r[1])) for r in corpus())
    assert Counter((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.quality(docs.limit(0)).count() == 0 and any(r.kept for r in got)
    kept = quality.quality(docs).where("kept").count()  # a filter on what it makes
    assert kept == sum(r.kept for r in got)


def test_rules_reject_what_they_name(spark):
    rng = random.Random(6)
    good = prose(rng, 200)
    bad = {"symbols": " ".join(w + "***" for w in words(rng, 90)), "shouting": good.upper(), "dup_lines": "\n".join(["menu one", "menu two"] * 40 + [prose(rng, 300)]), "word_length": " ".join("w" * 40 + str(i) for i in range(90))}
    rows = [(0, good)] + [(k, t) for k, t in enumerate(bad.values(), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in quality.quality(df).where("kept").collect()} == {0}
    plan = quality.plan_cascade(quality.take_sample(df), quality.default_rules())
    worth = [(share + 1e-6) / seconds for _, seconds, share in plan]
    assert worth == sorted(worth, reverse=True) and len(plan) == 4
    in_order = sorted(plan, key=lambda x: list(bad).index(x[0].name))
    named = {r.doc_id: r.by for r in quality.features(df).select("doc_id", quality.first_failed(in_order, quality._columns("text")).alias("by")).collect()}
    assert named[0] is None and [named[k] for k in range(1, 5)] == list(bad)


def test_the_verdict_alone_is_that_of_all_features(spark, docs):
    clash = docs.selectExpr("*", "'mine' as kept", "1 as base_failed", "'x' as rejected_by", "doc_id as n_symbols", "2 as __w")
    judged = quality.quality(docs.select("doc_id", "text")).collect()
    got = quality.passing(clash)
    assert got.columns == clash.columns and {(r.kept, r.base_failed, r.rejected_by) for r in got.collect()} == {("mine", 1, "x")}
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r.doc_id, r.text) for r in judged if r.kept)
    again = quality.quality(clash)
    assert {r.rejected_by for r in again.collect()} == {"x"} and again.where("kept").count() == got.count()  # own columns replace the others
    assert quality.passing(docs.limit(0)).count() == 0
    none = quality.passing(docs, rules=[quality.Rule("null", lambda f: quality.F.lit(None).cast("boolean"))])
    assert none.count() == sum(not r.base_failed for r in judged)  # a rule that is null rejects nothing


def test_what_a_later_rule_reads_is_not_computed(spark):
    """A row that the first rule rejects doesn't reach the second, which would raise."""
    df = quality._prepared(spark.createDataFrame([(1, "few words"), (2, "w " * 60)], "doc_id long, text string"), "text")
    fail = quality.Rule("fail", lambda f: quality.F.when(f["n_words"] < 50, quality.F.raise_error(quality.F.lit("asked")).cast("boolean")).otherwise(False))
    plan = [(quality.BASE[0], 1.0, 0.5), (fail, 1.0, 0.0)]
    assert [r[0] for r in df.orderBy("doc_id").select(quality.first_failed(plan, quality.expressions())).collect()] == ["few_words", None]


def in_duckdb(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in rows])
    got = con.sql(sql)
    return got.columns, got.fetchall()


def test_quality_sql(docs):
    columns, want = in_duckdb(quality.ORACLE, corpus())
    got = quality.quality(docs.select("doc_id", "text")).drop("text").select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(want)


# decontamination


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(max(r) for r in h)


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 40))
        score, s, e = decontaminate.align(a, b)
        assert score == brute_align(a.tolist(), b.tolist()) == brute_align(a.tolist(), b[s:e].tolist())


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(8)
    items = [prose(rng, rng.randint(15, 60)) for _ in range(12)]
    rows, want = [], set()
    for i in range(120):
        body = [prose(rng, 60), prose(rng, 60)]
        if i % 3 == 0:
            k = i % 12
            ws = items[k].split()
            if i % 2:  # an edited copy
                for _ in range(len(ws) // 8):
                    j = rng.randrange(len(ws))
                    ws[j : j + 1] = rng.choice([[], ["other"], [ws[j].upper(), "more"]])
            body.insert(1, " ".join(ws))
            want.add((i, k))
        rows.append((i, "\n".join(body)))
    rows += [(500, None), (501, ""), (502, items[2]), (502, items[2]), (None, items[3]), (503, prose(rng, 5000) + " " + items[4])]
    want |= {(502, 2), (None, 3), (503, 4)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, "")], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    for r in got:  # the place that it names holds the item
        text = next(t for i, t in rows if i == r.doc_id)
        found = toxicity.words(text)[r.first_word : r.first_word + r.n_words]
        assert brute_align(toxicity.words(items[r.item_id]), found) / (2 * len(toxicity.words(items[r.item_id]))) == pytest.approx(r.similarity)
    blocks = decontaminate.contaminated(df, bench, block_bytes=900).collect()
    assert Counter(map(tuple, blocks)) == Counter(map(tuple, got))
    clean = decontaminate.decontaminate(df, bench)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in rows if not any(i == d for d, _ in want))
    assert decontaminate.contaminated(df, bench.limit(0)).count() == decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_edited_copies_against_all_pairs(spark):
    """Recall of seeds: every document aligned with every item, at all rates of edits, also a regular one."""
    rng = random.Random(21)
    items = [prose(rng, rng.randint(20, 60)) for _ in range(10)]
    rows = [(i, prose(rng, 80)) for i in range(100)]
    for i in range(240):
        ws, rate = items[i % 10].split(), 0.05 * (i % 9)
        if i % 9 == 8:  # each third word another
            ws = [w if j % 3 else "".join(words(rng, 2)) for j, w in enumerate(ws)]
        else:
            ws = [x for w in ws for x in ([w] if rng.random() >= rate else rng.choice([[], words(rng, 1), [w, *words(rng, 1)]]))]
        rows.append((1000 + i, prose(rng, 30) + " " + " ".join(ws) + " " + prose(rng, 20)))
    want = {}
    hashed = [decontaminate.word_hashes([toxicity.words(t)]) for t in items]
    for d, t in rows:
        text = decontaminate.word_hashes([toxicity.words(t)])
        for k, item in enumerate(hashed):
            similarity = decontaminate.align(item, text)[0] / (2 * len(item))
            if similarity >= 0.5:
                want[d, k] = similarity
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert set(got) <= set(want) and all(got[x] == pytest.approx(want[x]) for x in got)
    assert len(want) > 200 and len(got) >= 0.95 * len(want), (len(got), len(want))


def test_a_repetitive_text_is_swept_once(monkeypatch):
    rng = random.Random(4)
    item = prose(rng, 30)
    hashed = decontaminate.word_hashes([toxicity.words(item)])
    seeds = decontaminate.Seeds([hashed], {})
    text = prose(rng, 50) + " " + " ".join([item] * 3000) + " " + prose(rng, 50)
    calls, align = [], decontaminate.align
    monkeypatch.setattr(decontaminate, "align", lambda a, b: calls.append(len(b)) or align(a, b))
    assert [(r, i, s, n) for r, i, s, _, n in decontaminate._matches(seeds, 0.5, [text])] == [(0, 0, 1.0, len(hashed))]
    assert sum(calls) < 1.1 * len(text.split())
    monkeypatch.setattr(decontaminate, "REACH", 64)  # parts that overlap lose no alignment
    for edit in range(5):
        ws = item.split()
        del ws[3 * edit : 3 * edit + 2]
        text = " ".join([prose(rng, 40), " ".join(ws), item, prose(rng, 10)] * 3)
        got = [(s, f, n) for _, _, s, f, n in decontaminate._matches(seeds, 0.5, [text])]
        score, a, b = align(hashed, decontaminate.word_hashes([toxicity.words(text)]))
        assert [s for s, _, _ in got] == [score / (2 * len(hashed))] and got[0][1:] == (a, b - a)


# licences


def test_licences(spark):
    mit = licenses.TEXTS["MIT"]
    rng = random.Random(3)
    wrapped = "The MIT Licence\n\nCopyright (c) 2020 Somebody Else\nAll rights reserved.\n\n" + re.sub(r"((?:\S+ ){9})", r"\1\n  ", mit).replace('"', "“").upper()
    rows = [(1, mit), (2, wrapped), (3, mit + " and more"), (4, prose(rng, 50) + "\nreleased under the  MIT licence!\n" + prose(rng, 9)), (5, None), (6, ""), (7, licenses.TEXTS["BSD-3-Clause"]), (8, licenses.TEXTS["BSD-2-Clause"]),
            (9, "SPDX-License-Identifier: Apache-2.0\ncode\n// SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: MIT"), (1, mit), (None, mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(licenses.known_texts(), "license_id string, kind string, text string")
    for most in (100_000, 0):
        got = licenses.scan_licenses(df, known, max_known=most).collect()
        ids = {r.doc_id: (r.license_id, r.notice_ids, r.n_notice_lines) for r in got}
        assert len(got) == len(rows)
        assert ids == {1: ("MIT", "", 0), 2: ("MIT", "", 0), 3: (None, "", 0), 4: (None, "MIT", 1), 5: (None, "", 0), 6: (None, "", 0), 7: ("BSD-3-Clause", "", 0), 8: ("BSD-2-Clause", "", 0), 9: (None, "Apache-2.0,MIT", 3), None: ("MIT", "", 0)}
    columns, want = in_duckdb(licenses.ORACLE, rows)
    assert Counter(map(tuple, licenses.scan_licenses(df, known).select(*columns).collect())) == Counter(want)
    assert licenses.scan_licenses(df.limit(0), known).count() == 0


PUBLISHED = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
PUBLISHED |= {f"{k}-{v}": f"{k}-{v}.0" if "." not in v else f"{k}-{v}" for k, v in (("GPL", "1"), ("GPL", "2"), ("GPL", "3"), ("LGPL", "2"), ("LGPL", "2.1"), ("LGPL", "3"), ("GFDL", "1.2"), ("GFDL", "1.3"))}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no published texts here")
def test_published_texts(spark):
    """Digests from the texts, and the texts as others set them: re-indented, in capitals, spelt and quoted otherwise; where
    no line but of a holder matters, also wrapped anew."""
    import textwrap

    rows = []
    for file, name in PUBLISHED.items():
        with open(f"/usr/share/common-licenses/{file}", encoding="utf-8") as f:
            text = f.read()
        end = text.find("END OF TERMS AND CONDITIONS")
        forms = {"whole": text, "indented": re.sub("(?m)^ *", "\t", text), "capitals": text.upper().replace("LICENSE", "LICENCE").replace('"', "'"), "notice": "Copyright (c) 2021 A. N. Other\n\n" + text}
        if end > 0 and len(licenses.DIGESTS[name]) > 1:
            forms["terms"] = text[:end] + "END OF TERMS AND CONDITIONS"
        if not re.match("L?GPL|GFDL|MPL-1.1", name):  # these have lines of holders that other wraps would begin or end elsewhere
            for width in (50, 64, 90, 10**6):
                forms[f"wrapped at {width}"] = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text))
        rows += [(len(rows) + k, t, f, name) for k, (f, t) in enumerate(forms.items())]
        rows.append((len(rows), text.replace("hereby", "thereby", 1) + " more", "edited", None))
    known = spark.createDataFrame(licenses.known_texts(), "license_id string, kind string, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), known).collect()}
    assert [(r[3], r[2], got[r[0]]) for r in rows if got[r[0]] != r[3]] == []
    assert {r[3] for r in rows if r[3]} == set(licenses.DIGESTS)
    columns, want = in_duckdb(licenses.ORACLE, rows)
    assert {r[columns.index("doc_id")]: r[columns.index("license_id")] for r in want} == got


def test_a_long_text_and_clashing_columns(spark):
    rng = random.Random(5)
    long = prose(rng, 60_000) + "\nLicensed under the MIT License.\n" + "x" * 100_000
    df = spark.createDataFrame([(1, long, "a", "b", 3)], "doc_id long, text string, license_id string, canon_lines string, line long")
    known = spark.createDataFrame(licenses.known_texts(), "license_id string, kind string, text string")
    assert [(r.license_id, r.notice_ids, r.n_notice_lines) for r in licenses.scan_licenses(df, known).collect()] == [(None, "MIT", 1)]
    pages = spark.createDataFrame([(1, "http://a.b/" + "s/" * 30 + "q" * 200_000, "x", "y", 1, 2)], "page_id long, url string, host string, verdict string, segs int, bad int")
    assert [(r.host, len(r.path), r.verdict) for r in urls.filter_urls(pages, urls.RULES).collect()] == [("a.b", 200_061, "allow")]


# urls


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    hosts = ["a.org", "org", "Example.ORG", "x.example.org", "notexample.org", "b.com", "com", "c.net", "", "a.org:80", "É.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/z#a", "/de/1", "?q=/de/", "#/fr/", "/a\nb/", "//de/"]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(900, None), (901, ""), (902, "no scheme"), (903, "x://"), (904, "a://b.com/fr/://c"), (0, "http://a.org")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(3), urls.RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *brute_url(u)[:3]) for i, u in rows)
    said = {(i, brute_url(u)[1]): brute_url(u)[3] for i, u in rows}
    ruled = [r for r in got if said[r.page_id, r.path]]
    assert len(ruled) > 30 and all(r.verdict == said[r.page_id, r.path] for r in ruled)
    assert all(r.verdict == "allow" for r in got if not r.host)  # what blocks pages without a rule: test_urls.py


def test_templates_learn_from_labels(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        kind = ["articles", "spam", "news", f"topic-{rng.choice('abcdef')}"][i % 4]
        rows.append((i, f"http://host.net/{kind}/{rng.randrange(10**6)}"))
        if i % 3 == 0:
            labels.append((i, int(kind == "spam")))
    rows.append((1000, "http://host.net/spam/77.html"))
    df, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")
    got = {r.page_id: r for r in urls.filter_urls(df, urls.RULES, lab).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {i for i, u in rows if "/spam/" in u}  # the last by its branch
    assert got[1].template == "host.net/spam/{n}" and got[3].template.startswith("host.net/*/")
    assert urls.filter_urls(df.limit(0), urls.RULES).count() == 0


# toxicity


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    stems = ["zworthl", "qidio", "xscumb"]
    rows = []
    for i in range(n):
        ws, bad = words(rng, rng.randint(20, 150)), i % 5 == 2
        if bad:
            for _ in range(2 + len(ws) // 60):
                ws[rng.randrange(len(ws))] = rng.choice(stems) + rng.choice(["", "t", "s", "ing", rng.choice("abcdefg") + "x"])
        rows.append((i, " ".join(ws), int(bad)))
    return rows


def test_toxicity_on_texts_held_out(spark):
    rows = toxic_corpus(1500, 1)
    extra = [(9000, None), (9001, ""), (9002, "qidiom zworthly"), (None, "plain words the of"), (9003, "th er on " * 9000 + "qidiot"), (9003, "th er on " * 9000)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(i, t, "x") for i, t in extra], "doc_id long, text string, score string").repartition(4)
    lab = spark.createDataFrame([(i, y) for i, _, y in rows] + [(8000, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    odd = {(r.doc_id, r.predicted) for r in got if r.doc_id is None or r.doc_id >= 9000}
    assert odd == {(9000, 0), (9001, 0), (9002, 1), (None, 0), (9003, 1), (9003, 0)}


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(df, none).collect()] in ([0, 0], [1, 1])
    assert toxicity.toxicity(df.limit(0), none).count() == 0


def test_same_text_same_score():
    model = toxicity.train([t for _, t, _ in toxic_corpus(300, 3)], [y for _, _, y in toxic_corpus(300, 3)])
    texts = [t for _, t, _ in toxic_corpus(40, 4)]
    one = toxicity.score(model, texts)
    again = np.array([toxicity.score(model, [t])[0] for t in texts])
    assert np.allclose(one, again)


def test_nothing_else_imports_this_subpackage():
    import mergelens

    root = os.path.dirname(mergelens.__file__)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "mergelens.llm" not in f.read(), n


def test_whole_licenses_through_the_query(spark, tmp_path):
    """Every licence that is known by its words, set anew, and none of a text that says more."""
    kept = [(name, t) for name, kind, t in licenses.known_texts() if kind == "text"]
    rows = []
    for name, t in kept:
        rows += [(len(rows) + k, x, name) for k, x in enumerate((t, "Copyright (c) 2001-2024 Some One\n" + t.upper(), "\n".join("  # " + x for x in t.split("\n")), re.sub(r"[ \n]+", "\r\n", t)))]
        rows.append((len(rows), t + "\nand what else is said", None))
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.license_id for r in licenses.op8_licenses(spark, str(tmp_path)).collect()}
    assert {i: got[i] for i, _, n in rows if got[i] != n} == {} and len({n for _, _, n in rows}) > 6
