"""Findings: union, first-wins dedupe, rank, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mergelens.functions.lineage import cut
from mergelens.functions.text import severity_weight
from mergelens.schemas import SEVERITIES


def finding(**columns: Column) -> list[Column]:
    """The columns of a finding in order, with defaults for those not given; ``seq`` says when it arrived."""
    base = {
        "id": F.lit(""), "rule_id": F.lit(""), "category": F.lit(""), "severity": F.lit("warning"), "source": F.lit("analyzer"),
        "file": F.lit(""), "line_start": F.lit(None), "line_end": F.lit(None), "message": F.lit(""), "reasoning": F.lit(""),
        "evidence": F.expr("cast(array() as array<string>)"), "confidence": F.lit(1.0), "demoted": F.lit(False), "seq": F.expr("cast(array() as array<bigint>)"),
    } | columns
    kinds = {"line_start": "int", "line_end": "int", "confidence": "double", "seq": "array<bigint>"}
    return [(v.cast(kinds[k]) if k in kinds else v).alias(k) for k, v in base.items()]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All findings, those of earlier parts arriving before those of later ones."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("seq", F.concat(F.array(F.lit(k).cast("long")), "seq"))
        out = part if out is None else out.unionByName(part)
    return out


def dedupe(findings: DataFrame, seq: Sequence[str] = ("seq",)) -> DataFrame:
    """The first to arrive of findings with one file, line and rule; without a rule the category counts too. Lines of 0
    or less are no line."""
    line = F.when(F.coalesce("line_start", F.lit(0)) > 0, F.col("line_start")).otherwise(0)
    own = F.when(F.col("rule_id") == "", F.col("category")).otherwise(F.lit(None))
    w = W.partitionBy("file", line, "rule_id", own).orderBy(*seq)
    return findings.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def rank_keys(seq: Sequence[str] = ("seq",)) -> list[Column]:
    return [severity_weight(F.col("severity")).desc(), F.col("confidence").desc(), F.col("file").asc(), F.col("line_start").asc(), *[F.col(c).asc() for c in seq]]


def rank(findings: DataFrame, seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Sorted: severity, then confidence, highest first; then file and line; then arrival."""
    return findings.orderBy(*rank_keys(seq))


def with_rank(findings: DataFrame, seq: Sequence[str] = ("seq",), parts: int = 64, out: str = "rank") -> DataFrame:
    """``findings`` with their rank as a column, without one task for all: rows are numbered within ranges of the sort
    order, and counts of the ranges before are added. The numbered rows are written first, since the bounds of the ranges
    come from a sample that another run would draw anew."""
    keys = rank_keys(seq)
    ranged = findings.repartitionByRange(parts, *keys).withColumn("_p", F.spark_partition_id())
    # within a range the rows are sorted where they are: no second shuffle by the range's number
    numbered = cut(ranged.sortWithinPartitions(*keys).withColumn("_n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1), "rank")
    counts = numbered.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return numbered.join(F.broadcast(before), "_p").withColumn(out, (F.col("_n") + F.col("_b")).cast("long")).drop("_p", "_n", "_b")


def with_ids(findings: DataFrame) -> DataFrame:
    """An id for findings that have none, from what they say."""
    made = F.substring(F.sha2(F.concat_ws("\x1f", "rule_id", "category", "source", "file", F.col("line_start").cast("string"), "message", F.array_join("evidence", "\x1e")), 256), 1, 16)
    return findings.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", made).otherwise(F.col("id")))


def visible(findings: DataFrame, severities: Sequence[str] = (), sources: Sequence[str] = ()) -> DataFrame:
    """Findings of some severities and sources; no choice means all."""
    if severities:
        findings = findings.where(F.col("severity").isin(*severities))
    if sources:
        findings = findings.where(F.col("source").isin(*sources))
    return findings


def severity_summary(findings: DataFrame) -> DataFrame:
    """severity, n, and the weight to sort by."""
    return findings.groupBy("severity").agg(F.count("*").alias("n")).withColumn("weight", severity_weight(F.col("severity")))


def summary_line(findings: DataFrame) -> str:
    """``2 critical, 1 info`` from the most severe on, or ``no findings``."""
    counts = {r.severity: r.n for r in severity_summary(findings).collect()}  # four rows at most
    return ", ".join(f"{counts[s]} {s}" for s in reversed(SEVERITIES) if counts.get(s)) or "no findings"
