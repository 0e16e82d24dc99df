"""The pipeline and each of its stages against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from mergelens.llm import toxicity
from tests.llm.fixtures import corpus, prose
from tests.llm.test_dedup import WORD, brute_substring, fingerprint, groups
from tests.llm.test_operators import brute_align, features

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [prose(rng, 25) for _ in range(4)]
    rows = [(i, t, lang, s, n) for i, t, lang, s, n, *_ in corpus() if i is not None]
    rows += [(200 + i, prose(rng, 70) + "\n" + items[i % 4] + "\n" + prose(rng, 40), "en", "s", 1) for i in range(6)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def passes(text):
    n, chars, symbols, dup, rep = features(text)
    text = text or ""
    upper = sum("A" <= c <= "Z" for c in text)
    lines = text.count("\n") + 1
    failed = n < 50 or 100 * rep > 50 * n
    return not (failed or symbols * 5 > n or upper * 2 > chars or dup > 2 and dup * 10 > 3 * lines or chars < 2 * n or chars > 20 * n)


def brute(rows, items):
    kept = [r for r in rows if passes(r[1])]
    yield kept
    group = groups([fingerprint(r[1]) for r in kept])
    by = defaultdict(list)
    for r in kept:
        by[group[fingerprint(r[1])]].append(r)
    kept = []
    for rs in by.values():  # the smallest id, then the smallest hash of the text
        least = min(r[0] for r in rs)
        kept.append(min((r for r in rs if r[0] == least), key=lambda r: _signed(r[1])))
    yield kept
    left = brute_substring(kept, 20)
    out = []
    for r in kept:
        n, gone, _, words = left[r[0], r[1]]
        if not gone:
            out.append((r, r[1]))
        elif gone < n:
            out.append((r, words))
    yield out
    clean = []
    for r, t in out:
        words = toxicity.words(t if isinstance(t, str) else " ".join(t))
        if all(brute_align(toxicity.words(i), words) / (2 * len(toxicity.words(i))) < 0.5 for i in items):
            clean.append(r[0])
    yield clean


def _signed(text):
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64))


def test_stages(spark, tables):
    folder, rows, items = tables
    quality, near, sub, clean = brute(rows, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    docs = stage["quality_rules"](spark, docs, folder)
    assert Counter(map(tuple, docs.collect())) == Counter(quality) and 0 < len(quality) < len(rows)
    docs = stage["near_dedup"](spark, spark.createDataFrame(docs.collect(), SCHEMA), folder)
    assert Counter(map(tuple, docs.collect())) == Counter(near) and len(near) < len(quality)
    docs = stage["substring_dedup"](spark, spark.createDataFrame(docs.collect(), SCHEMA), folder)
    got = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert set(got) == {r[0] for r, _ in sub} and any(not isinstance(t, str) for _, t in sub)
    for r, t in sub:
        g = got[r[0]]
        assert (g.text == t and g.n_chars == r[4]) if isinstance(t, str) else (WORD.findall(g.text) == t and g.n_chars == len(g.text))
        assert (g.lang, g.source) == (r[2], r[3])
    docs = stage["decontamination"](spark, spark.createDataFrame(docs.collect(), SCHEMA), folder)
    assert {r.doc_id for r in docs.collect()} == set(clean) and len(clean) == len(sub) - 4  # of six copies two lost the passage before


def test_whole_run(spark, tables):
    import sentencepiece

    folder, rows, items = tables
    *_, clean = brute(rows, items)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(clean)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 and len(r.ids) == r.n_tokens
        if library.encode(texts[r.doc_id], add_bos=True, add_eos=True) == r.ids:
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert sum(library.encode(texts[r.doc_id], add_bos=True, add_eos=True) == r.ids for r in got) > len(got) // 2


def test_empty(spark, tables, tmp_path):
    folder, _, _ = tables
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_of_any_name(spark, tables):
    """Each stage with columns that are called what the operators call theirs, with repeated rows, and with an id of two
    texts."""
    folder, rows, _ = tables
    names = ["row", "dk", "th", "spans", "n_words", "kept", "base_failed", "rejected_by", "group", "node", "component", "nth", "cell", "bucket", "__w", "__text", "start"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names += ["a.b", "x y", "tick`s", "c:d", "", "TEXT", "Doc_Id", "_other_3", "é", "struct<a:int>"]
    plain_names = docs.columns
    for k in range(len(names)):
        docs = docs.withColumn(f"extra-{k}", docs.doc_id + k)
    docs = docs.toDF(*plain_names, *names)
    for name, stage in corpus_pipeline.STAGES:
        plain = stage(spark, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"), folder)
        got = stage(spark, docs, folder)
        if name != "tokens":
            assert got.columns == docs.columns, name
            got = got.collect()
            assert all(r[len(plain_names) + k] == r[plain_names.index("doc_id")] + k for r in got for k in range(len(names))), name
        else:
            got = got.collect()
        order = [(docs.columns if name != "tokens" else plain.columns).index(c) for c in plain.columns]
        assert Counter(str([r[c] for c in order]) for r in got) == Counter(str(list(r)) for r in plain.collect()), name
