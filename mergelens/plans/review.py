"""A review from the working tree to ranked findings."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mergelens.functions.lineage import cut
from mergelens.functions.text import split_budget
from mergelens.operators import agent, context, findings, graph
from mergelens.operators.detect import run_detectors
from mergelens.operators.diff import added_lines
from mergelens.operators.rules import Rule, default_rules, evaluate
from mergelens.plans.store import Store, sync
from mergelens.sources import config as configs
from mergelens.sources.files import discover
from mergelens.sources.git import GitError, NotARepository, working_diff

VERSION = "0.1.0"


@dataclass
class Review:
    id: str
    repo: str
    mode: str
    findings: DataFrame
    analyzers_run: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    degradations: list[str] = field(default_factory=list)
    started_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    def golden(self) -> dict:
        """What a review says, without ids and times."""
        cols = ["rule_id", "category", "severity", "source", "file", "line_start", "line_end", "message", "reasoning", "evidence", "confidence", "demoted"]
        rows = [r.asDict() for r in findings.rank(self.findings).select(*cols).collect()]
        return {"repo": self.repo, "mode": self.mode, "analyzers_run": self.analyzers_run, "findings": rows}

    def to_json(self) -> str:
        return json.dumps({"id": self.id, **self.golden(), "degradations": self.degradations}, indent=2, ensure_ascii=False)


def reduce_findings(parts: Sequence[DataFrame]) -> DataFrame:
    """Union in order of arrival, first-wins dedupe, ids."""
    return findings.with_ids(findings.dedupe(findings.union_all(parts)))


class SyncFailed(RuntimeError):
    """The index could not be brought up to date."""


def related_files(spark: SparkSession, repo: str, lines: DataFrame, store: Store) -> DataFrame:
    """path, distance, code of files that the change may touch, beyond the changed ones."""
    files = discover(spark, repo)
    try:
        sync(files, repo, store)
    except Exception as e:
        raise SyncFailed(e) from e
    changed = [r.path for r in lines.select("path").distinct().collect()]  # a row a changed file
    return graph.context_files(store.index.impact_set(repo, changed), files.select("path", F.col("content").cast("string").alias("code")))


def model_findings(lines: DataFrame, related: DataFrame | None, baseline: DataFrame, providers: Sequence[agent.Provider], budget: int, local_only: bool) -> tuple[DataFrame, int, int, str]:
    """Verified findings of the model stage, the number of entries that were no findings and of findings that are not on
    added lines, and the provider's name. Raises what routing and parsing raise."""
    spark = lines.sparkSession
    room, _ = split_budget(budget)
    prompt = context.pack_context(lines, related, context.baseline_block(baseline), room)
    name, answer = agent.route(providers, agent.SYSTEM, prompt, local_only)
    agent.parse_answer(answer)  # raises for what isn't an array of findings
    entries, kept = Observation(), Observation()
    found = agent.candidates(spark.createDataFrame([(0, answer)], "ord int, answer string"))
    found = cut(found.observe(entries, F.count_if(~F.col("valid")).alias("invalid")), "model-entries")
    verified = agent.verify(found.where("valid").drop("valid"), lines)
    verified = cut(verified.observe(kept, F.count_if("demoted").alias("demoted")), "model-findings")  # counted as it is written
    return verified, entries.get["invalid"], kept.get["demoted"], name


def review(
    spark: SparkSession,
    repo: str,
    config: dict | None = None,
    rules: Sequence[Rule] | None = None,
    detectors: Sequence[str] = ("secrets",),
    providers: Sequence[agent.Provider] = (),
    store: Store | None = None,
) -> Review:
    """Reviews a working tree against HEAD. Raises ValueError if ``repo`` is no folder; whatever else fails becomes a
    degradation and the review goes on without it."""
    if not os.path.isdir(repo):
        raise ValueError(f"{repo} is no folder")
    config = config or configs.merge([])
    rules = default_rules() if rules is None else rules
    out = Review(uuid.uuid4().hex[:16], repo, config["mode"], spark.createDataFrame([], "id string"))
    try:
        _, diffs = working_diff(spark, repo)
    except NotARepository:
        out.degradations.append("the folder is no git working tree: reviewed without a diff")
        diffs = spark.createDataFrame([], "path string, diff_text string")
    except GitError as e:
        out.degradations.append(f"diff not available: {e}")
        diffs = spark.createDataFrame([], "path string, diff_text string")
    lines = added_lines(diffs).persist()
    try:
        parts, out.analyzers_run, notes = run_detectors(lines, detectors)
        out.degradations += notes
        parts.append(evaluate(lines, rules))
        if rules:
            out.analyzers_run.append("rules")
        if providers:
            related = None
            if store:
                try:
                    related = related_files(spark, repo, lines, store)
                except SyncFailed as e:
                    out.degradations.append(f"index sync failed: {e}")
                except Exception as e:  # the pack goes on without related code
                    out.degradations.append(f"impact slice not available: {e}")
            try:
                found, invalid, demoted, name = model_findings(lines, related, reduce_findings(parts), providers, config["budgets.review_tokens"], config["mode"] == "offline")
                parts.append(found)
                out.analyzers_run.append(f"llm:{name}")
                if invalid:
                    out.degradations.append(f"model stage: {invalid} entries were no findings")
                if demoted:
                    out.degradations.append(f"model stage: {demoted} findings are not on added lines")
            except Exception as e:  # the model stage only adds
                out.degradations.append(f"model stage skipped: {e}")
        out.findings = findings.with_rank(reduce_findings(parts), parts=8)
        if store:
            now = datetime.now(timezone.utc).replace(tzinfo=None)
            store.save_review({"id": out.id, "repo_path": repo, "mode": out.mode, "started_at": out.started_at, "finished_at": now}, out.findings)
            out.findings = store.get_review(out.id)[1].withColumnRenamed("position", "rank").withColumn("seq", F.array(F.col("rank").cast("long")))
        else:
            out.findings = cut(out.findings, "review")
    finally:
        lines.unpersist()
    return out


def main(argv: Sequence[str] | None = None) -> int:
    """``review [--config FILE] [--json] [--store FOLDER] [REPO]`` and ``version``. 1: the review failed, 2: usage."""
    import argparse
    import sys

    from mergelens.plans.app import settings

    parser = argparse.ArgumentParser("mergelens")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    r = commands.add_parser("review")
    r.add_argument("repo", nargs="?", default=".")
    r.add_argument("--config", default="")
    r.add_argument("--json", action="store_true")
    r.add_argument("--store", default="")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        s = settings(os.path.abspath(args.repo), args.config)
        got = review(spark, os.path.abspath(args.repo), s.config, s.rules, providers=s.providers, store=Store(spark, args.store) if args.store else None)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if args.json:
        print(got.to_json())
    else:
        print(f"review {got.id} of {got.repo} ({got.mode}): {findings.summary_line(got.findings)}")
        for x in findings.rank(got.findings).collect():
            print(f"{x.severity:<8} {x.file}:{x.line_start} {x.message}")
        for note in [*s.warnings, *got.degradations]:
            print(f"note: {note}")
    return 0
