"""From raw documents to tokens: quality rules, near-dedup, substring dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a frame; all but the last
return the columns of ``docs``, whatever else these are called, and no other; the last returns columns of its own.

In every stage a null text is an empty one, and an empty table gives an empty one. Rows that repeat id and text are judged
alike; documents that share an id but not a text are documents of their own. No stage has a limit on a text's length. A
null id is an id, the smallest. What else a stage does with such rows stands there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm import decontaminate, pieces, quality, simhash, substring
from mergelens.llm._store import materialise, shield

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def any_names(stage: Stage) -> Stage:
    """The stage with other columns renamed by their places before it and back after it: they may be called anything."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs, named = shield(docs, *COLUMNS)
        return named(stage(spark, docs, sf_dir))

    return run


@any_names
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, empty ones among them; the rules stop at the first that rejects. Repeated rows
    all stay or all go."""
    return quality.passing(docs)


@any_names
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: candidates by SimHash, then word 5-shingles, exact Jaccard
    similarity of 0.8 or more. Of equal texts and of repeated rows one stays, that of the smallest id (a null id only where there is no other), and of
    the smallest hash of the text among several texts of that id. Empty texts are equal."""
    return simhash.keep_one(docs, simhash.similar_texts(docs))


@any_names
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words of windows that start earlier elsewhere; a text that loses all of them goes. An empty text stays
    as it is, but a null one becomes empty; n_chars is counted anew where words went. Repeated rows are one document and all
    get its result."""
    kept = substring.substring_dedup(docs, with_text=True).where("n_removed = 0 or n_removed < n_words")
    own = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length("text").cast("long"))}
    return kept.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@any_names
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, whole or edited, go, each of repeated rows; empty texts stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@any_names
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document, a row for each; an empty one has the begin
    and end ids alone."""
    import public_tokenizers

    return pieces.tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Near-duplicate links, alignment and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
