"""The model stage: routing, answers to findings, verification against the change."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mergelens.functions.text import normal_severity
from mergelens.operators.findings import finding

SYSTEM = "You review a code change. Answer with a JSON array of objects with the keys file, line, severity (info, warning, error or critical), message and reasoning, and nothing else."
ANSWER = "array<struct<file:string,line:int,line_end:int,severity:string,category:string,rule_id:string,message:string,reasoning:string,confidence:double>>"
CONFIRMED, DEMOTED = 0.6, 0.2


class NoProvider(RuntimeError):
    """No provider answered."""


@dataclass(frozen=True)
class Provider:
    """Answers a prompt; ``complete`` raises if it can't."""

    name: str
    model: str
    local: bool
    complete: Callable[[str, str], str]
    available: Callable[[], bool] = lambda: True


def fixture_provider(fixtures: Sequence[tuple[str, str, str]], name: str = "fixture", model: str = "recorded", local: bool = True) -> Provider:
    """Answers from (system, prompt, response): the first whose system is equal and whose prompt is equal or empty."""

    def complete(system: str, prompt: str) -> str:
        for s, p, response in fixtures:
            if s == system and p in ("", prompt):
                return response
        raise NoProvider("no recorded answer fits")

    return Provider(name, model, local, complete)


def route(providers: Sequence[Provider], system: str, prompt: str, local_only: bool) -> tuple[str, str]:
    """(provider, answer) of the first that is available and answers, local ones before others, in order. Raises
    NoProvider."""
    tried = []
    for p in sorted((p for p in providers if p.local or not local_only), key=lambda p: not p.local):
        try:
            if p.available():
                return p.name, p.complete(system, prompt)
            tried.append(f"{p.name} is not available")
        except Exception as e:  # a provider is foreign code: the next is asked
            tried.append(f"{p.name}: {e}")
    raise NoProvider("; ".join(tried) or "no provider is configured")


def choose_provider(providers: DataFrame, keys: Sequence[str] = (), local_only: bool = False) -> DataFrame:
    """Of rows (name, is_local, available, ord) the one that routing takes, for each value of ``keys``."""
    open_ = providers.where("available" + " and is_local" * local_only)
    return open_.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("is_local").desc(), "ord"))).where("_n = 1").drop("_n")


def lookup_fixtures(prompts: DataFrame, fixtures: DataFrame) -> DataFrame:
    """``prompts`` (id, system, prompt) with the response of the first fixture that fits, null if none does. Fixtures are
    first brought down to one for each system and prompt, so that each prompt meets two at most: its own and the one for
    any prompt."""
    first = fixtures.groupBy("system", "prompt").agg(F.min(F.struct("ord", "response")).alias("own"))
    any_ = first.where("prompt = ''").select("system", F.col("own").alias("any"))
    out = prompts.join(first, ["system", "prompt"], "left").join(any_, "system", "left")
    return out.select(*prompts.columns, F.least("own", "any").getField("response").alias("response"))


def parse_answer(answer: str) -> list[dict]:
    """Objects of an answer, a JSON array; keys in any case. Raises ValueError for anything else."""
    doc = json.loads(answer)
    if doc is None:
        return []
    if not isinstance(doc, list) or not all(isinstance(x, dict) for x in doc):
        raise ValueError("the answer is no JSON array of objects")
    kinds = {"line": int, "line_end": int, "confidence": (int, float)}
    out = []
    for x in doc:
        row = {k.lower(): v for k, v in x.items()}
        for k, v in row.items():
            if v is not None and k in ("file", "severity", "category", "rule_id", "message", "reasoning", *kinds) and (not isinstance(v, kinds.get(k, str)) or isinstance(v, bool)):
                raise ValueError(f"{k} has the wrong type")
        out.append(row)
    return out


def candidates(answers: DataFrame, column: str = "answer", keep: Sequence[str] = ()) -> DataFrame:
    """Findings that answers (JSON arrays, one a row, with ``ord``) propose, with ``valid``: an entry needs a file, a line
    and a message. Missing keys get defaults. An answer that isn't such an array is an error where it is read."""
    rows = answers.select(*keep, "ord", F.posexplode(F.from_json(column, ANSWER, {"mode": "FAILFAST"})).alias("pos", "x"))
    text = lambda c, default: F.when(F.coalesce(F.col(f"x.{c}"), F.lit("")) == "", default).otherwise(F.col(f"x.{c}"))
    valid = (F.coalesce("x.file", F.lit("")) != "") & (F.coalesce("x.line", F.lit(0)) > 0) & (F.coalesce("x.message", F.lit("")) != "")
    end = F.when(F.coalesce("x.line_end", F.lit(0)) > 0, F.col("x.line_end")).otherwise(F.col("x.line"))
    return rows.select(
        *keep,
        *finding(
            rule_id=text("rule_id", "llm"), category=text("category", "llm"), severity=normal_severity(F.col("x.severity")), source=F.lit("llm"), file=F.coalesce("x.file", F.lit("")),
            line_start=F.col("x.line"), line_end=end, message=F.coalesce("x.message", F.lit("")), reasoning=F.coalesce("x.reasoning", F.lit("")),
            confidence=F.when(F.coalesce("x.confidence", F.lit(0.0)) > 0, F.col("x.confidence")).otherwise(0.5), seq=F.array(F.col("ord").cast("long"), F.col("pos").cast("long")),
        ),
        valid.alias("valid"),
    )


def verify(found: DataFrame, added: DataFrame) -> DataFrame:
    """Findings on an added line are confirmed; others are demoted to info of low confidence and keep what they say."""
    lines = added.select(F.col("path").alias("file"), F.col("number").alias("line_start"), F.lit(True).alias("_hit")).distinct()
    out = found.join(lines, ["file", "line_start"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return out.withColumns(
        {
            "severity": F.when(F.col("_hit"), F.col("severity")).otherwise("info"),
            "confidence": F.when(F.col("_hit"), CONFIRMED).otherwise(DEMOTED),
            "demoted": ~F.col("_hit"),
        }
    ).select(*found.columns)
