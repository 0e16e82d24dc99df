"""A lint command over changed folders."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.functions.lineage import cut
from mergelens.operators.detect import changed_dirs, lint_findings, split_diagnostic

VET = ("go", "vet")


class LintError(RuntimeError):
    """The command failed and said nothing that is a diagnostic."""


def lint_output(dirs: DataFrame, repo: str, command: Sequence[str] = VET) -> DataFrame:
    """dir, ord, raw, code: the lines that a command prints about each folder (column dir) of a repository, of stdout or,
    where that is empty, of stderr, and its exit code; a folder without output has one null line. The command runs on the
    executors, which must see the repository; its arguments end in the folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for folder in b.dir:
                try:
                    done = subprocess.run([*command, "./" + folder], cwd=repo, capture_output=True, env=os.environ | {"GOTOOLCHAIN": "local"})
                    text, code = (done.stdout or done.stderr).decode("utf-8", "replace"), done.returncode
                except OSError as e:
                    text, code = str(e), 127
                rows += [(folder, k, raw, code) for k, raw in enumerate(text.splitlines() or [None])]
            yield pd.DataFrame(rows, columns=["dir", "ord", "raw", "code"])

    return dirs.select("dir").distinct().mapInPandas(run, "dir string, ord int, raw string, code int")


def lint_detector(repo: str, command: Sequence[str] = VET, rule_id: str = "go-vet", suffix: str = ".go") -> Callable[[DataFrame], DataFrame]:
    """A detector that runs a command over the folders of changed files. It raises LintError where the command fails
    without a diagnostic; one that fails with diagnostics has done its work."""

    def detect(lines: DataFrame) -> DataFrame:
        said = cut(lint_output(changed_dirs(lines, suffix), repo, command), "lint")
        found = split_diagnostic(said)
        mute = said.where("code <> 0").join(found.select("dir").distinct(), "dir", "left_anti")
        bad = mute.groupBy("dir").agg(F.min_by("raw", "ord").alias("raw"), F.min("code").alias("code")).orderBy("dir").head(1)
        if bad:
            raise LintError(f"{' '.join(command)} {bad[0].dir} ended with {bad[0].code}: {bad[0].raw}")
        return lint_findings(said.select("raw", "ord"), repo, rule_id)

    return detect
