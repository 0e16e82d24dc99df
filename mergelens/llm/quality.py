"""Quality rules as a short-circuit cascade of native expressions."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm._store import materialise, shield

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
UPPER = "[A-Z]+"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A row for which ``fails`` is true is rejected; ``fails`` gets what to read by name: ``text``, never null, and
    ``FEATURES``, as columns or as expressions that are evaluated where they are asked for."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is evaluated once however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeats(w: Column) -> Column:
    """Of an array of words, how many are in windows of three that are found twice or more."""
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def hits(s: Column) -> Column:
        near = F.transform(s, lambda x, j: F.when((x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h), x.p))
        return F.size(F.array_distinct(F.flatten(F.transform(F.filter(near, lambda p: p.isNotNull()), lambda p: F.array(p, p + 1, p + 2)))))

    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(placed(h), hits)).otherwise(0))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def _prepared(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with __text, never null, and __w, its words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__text": text, "__w": _words(text)})


def expressions() -> dict[str, Column]:
    """What rules read, of a frame that ``_prepared`` made: each computed from the whole text where it is asked for."""
    made = {
        "n_words": F.size("__w"),
        "word_chars": F.char_length(F.array_join("__w", "")),
        "n_symbols": _count(F.col("__text"), SYMBOLS),
        "n_dup_lines": _dup_lines(F.col("__text")),
        "n_repeat_words": _repeats(F.col("__w")),
    }
    return {"text": F.col("__text")} | {k: v.cast("long") for k, v in made.items()}


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) of each whole text.

    Words are runs of characters other than ASCII white space, a null text has none. n_repeat_words counts the words in
    windows of three that are found twice or more in the text. Columns of these names that ``docs`` has are replaced.
    Only array functions within a row: no shuffle, whatever the length of the text or the number of its copies.
    """
    made = expressions()
    # A generator of one row: a filter on what it makes is not pushed below it, where it would copy the expressions above
    # into each other and evaluate arrays for each of their elements.
    return _prepared(docs, text_col).select(*[c for c in docs.columns if c not in FEATURES], F.inline(F.array(F.struct(*[made[k].alias(k) for k in FEATURES]))))


def _columns(text_col: str) -> dict[str, Column]:
    """What rules read, of a frame that ``features`` made."""
    return {"text": F.coalesce(F.col(text_col), F.lit(""))} | {k: F.col(k) for k in FEATURES}


#: What op6's contract fixes: texts of few words, and those that mostly repeat themselves.
BASE = [
    Rule("few_words", lambda f: f["n_words"] < 50),
    Rule("repeats", lambda f: f["n_repeat_words"] * 100 > f["n_words"] * 50),
]


def default_rules() -> list[Rule]:
    """Marks instead of words, shouting, lines said again, words that are no words by their length."""
    return [
        Rule("symbols", lambda f: f["n_symbols"] * 5 > f["n_words"]),
        Rule("shouting", lambda f: _count(f["text"], UPPER) * 2 > f["word_chars"]),
        Rule("dup_lines", lambda f: (f["n_dup_lines"] > 2) & (f["n_dup_lines"] * 10 > F.lit(3) * (F.char_length(f["text"]) - F.char_length(F.replace(f["text"], F.lit("\n"), F.lit(""))) + 1))),
        Rule("word_length", lambda f: (f["word_chars"] < F.lit(2) * f["n_words"]) | (f["word_chars"] > F.lit(20) * f["n_words"])),
    ]


def take_sample(docs: DataFrame, text_col: str = "text", rows: int = 1000, seed: int = 7) -> DataFrame:
    """The texts and words of ``rows`` rows at most, drawn before anything is computed from them, and written."""
    total = docs.count()
    some = docs.select(text_col).sample(min(1.0, 1.2 * rows / max(total, 1)), seed).limit(rows)
    return materialise(_prepared(some, text_col).select("__text", "__w"), "quality-sample")


def plan_cascade(sample: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), the most rejection for its cost first. ``sample`` is what ``take_sample`` wrote, and a
    rule's seconds are those of computing what it reads and of evaluating it, less those of reading texts and words. The
    order changes which rule is asked first and never which rows fail."""
    names = expressions()

    def timed(what: Column) -> tuple[float, float]:
        best, got = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            got = sample.agg(F.avg(F.when(what, 1.0).otherwise(0.0))).head()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, got

    if not rules:
        return []
    floor, _ = timed((F.char_length("__text") < 0) | (F.size("__w") < 0))
    found = [(r, *timed(r.fails(names))) for r in rules]
    found = [(r, max(s - floor, 1e-3), share) for r, s, share in found]
    return sorted(found, key=lambda x: -(x[2] + 1e-6) / x[1])


def first_failed(plan: Sequence[tuple[Rule, float, float]], names: Mapping[str, Column]) -> Column:
    """The name of the first rule in the order of ``plan`` that rejects the row, null where none does. A row that has failed
    asks no further rule, and where ``names`` are expressions, what only those rules read isn't computed for it. A rule
    that is null for a row doesn't reject it."""
    first: Column = F.lit(None).cast("string")
    for rule, _, _ in reversed(plan):
        first = F.when(rule.fails(names), F.lit(rule.name)).otherwise(first)
    return first


def quality(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """``docs`` with the columns of ``features``, base_failed (fewer than 50 words, or over half of them in repeated
    windows) and kept: false if base_failed, else the verdict of the cascade, whose order is planned on ``sample_rows``
    rows at most. Columns of these names that ``docs`` has are replaced, all others stay. Null and empty texts fail; an
    empty table gives an empty one; repeated rows are judged alike. All features of every row are computed, since all are
    results here; see ``passing`` for the verdict alone."""
    own = [k for k, c in enumerate(docs.columns) if c not in (*FEATURES, "base_failed", "kept")]
    docs, named = shield(docs, text_col)
    plan = plan_cascade(take_sample(docs, text_col, sample_rows), default_rules() if rules is None else rules)
    df = features(docs.select(*[docs.columns[k] for k in own]), text_col)
    names = _columns(text_col)
    failed = F.coalesce(BASE[0].fails(names) | BASE[1].fails(names), F.lit(False))
    return named(df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & first_failed(plan, names).isNull()))


def passing(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, all columns as they are. The base rules are part of the cascade, and a
    row that one rule has rejected computes nothing that only later rules read. Null and empty texts go; rows that repeat
    are judged alike; an empty table gives an empty one."""
    both = [*BASE, *(default_rules() if rules is None else rules)]
    docs, named = shield(docs, text_col)
    plan = plan_cascade(take_sample(docs, text_col, sample_rows), both)
    df = _prepared(docs.select(F.struct("*").alias("row"), F.col(text_col)), text_col)
    verdict = F.explode(F.array(first_failed(plan, expressions())))  # evaluated once, see ``features``
    return named(df.select("row", verdict.alias("rejected_by")).where("rejected_by is null").select("row.*"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", *FEATURES, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS k FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN l ON l.r = w.r LEFT JOIN rep ON rep.r = w.r),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols * 5 > n_words OR (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) * 2 > word_chars
    OR n_dup_lines > 2 AND n_dup_lines * 10 > 3 * (length(t) - length(replace(t, chr(10), '')) + 1)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""
