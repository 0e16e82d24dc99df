"""Working trees as relations: a batch data source ``git_worktree``, and blame."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class GitError(RuntimeError):
    """git failed; the message is what it said."""


class NotARepository(GitError):
    """The path isn't inside a working tree."""


def git(folder: str, *args: str) -> str:
    done = subprocess.run(["git", *args], cwd=folder, capture_output=True)
    if done.returncode:
        raise GitError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} ended with {done.returncode}")
    return done.stdout.decode("utf-8", "replace")


def is_repo(folder: str) -> bool:
    try:
        return os.path.isdir(folder) and git(folder, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except (GitError, OSError):
        return False


def file_diff(folder: str, path: str) -> str:
    """Diff of a path against HEAD, staged and unstaged together; empty if git has none."""
    try:
        return git(folder, "diff", "--no-color", "--no-ext-diff", "-U3", "HEAD", "--", path)
    except GitError:
        return ""


def status_lines(folder: str) -> list[str]:
    """Porcelain status, untracked files one by one. Raises NotARepository."""
    if not is_repo(folder):
        raise NotARepository(f"{folder} is not a git working tree")
    return [x for x in git(folder, "-c", "core.quotepath=off", "status", "--porcelain", "--untracked-files=all").split("\n") if x]


def blame(folder: str, path: str, line: int) -> tuple[str, str]:
    """Commit and author of a line."""
    lines = git(folder, "blame", "--porcelain", "-L", f"{line},{line}", "--", path).split("\n")
    return lines[0].split(" ")[0], next((x.removeprefix("author ") for x in lines if x.startswith("author ")), "")


#: Changed files of a task at least, and tasks at most.
FILES, TASKS = 16, 256


class _Part(InputPartition):
    def __init__(self, lines: list[str]):
        self.lines = lines


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Part]:
        lines = status_lines(self.folder)
        size = max(FILES, -(-len(lines) // TASKS))
        return [_Part(lines[i : i + size]) for i in range(0, len(lines), size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple[str, str | None, str | None]]:
        """The status line, the file's diff, and for an untracked file its text."""
        for raw in partition.lines:
            if raw.startswith("??"):
                try:
                    with open(os.path.join(self.folder, raw[2:].strip()), encoding="utf-8", errors="replace", newline="") as f:
                        yield raw, None, f.read()
                except OSError:
                    yield raw, None, None
                continue
            old, _, new = raw[3:].strip().partition(" -> ") if raw[0] == "R" else (raw[3:].strip(), "", "")
            yield raw, file_diff(self.folder, new or old) or (file_diff(self.folder, old) if new else ""), None


class GitWorktree(DataSource):
    """``spark.read.format("git_worktree").load(path)``: raw status line, diff, text of an untracked file. Some
    changed files a task; the path must be visible to the executors."""

    @classmethod
    def name(cls) -> str:
        return "git_worktree"

    def schema(self) -> str:
        return "raw string, diff string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def working_diff(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(changes, diffs) of a working tree against HEAD. Raises NotARepository."""
    from mergelens.operators.diff import diff_stat, parse_status, synthetic_diff

    if not is_repo(folder):
        raise NotARepository(f"{folder} is not a git working tree")
    spark.dataSource.register(GitWorktree)
    rows = parse_status(spark.read.format("git_worktree").load(folder))
    rows = rows.withColumn("diff_text", F.when(F.col("untracked"), synthetic_diff(F.col("content"))).otherwise(F.coalesce("diff", F.lit(""))))
    diffs = rows.select("path", "diff_text")
    stats = diff_stat(diffs)
    changes = rows.select("path", "old_path", "status").join(stats, "path", "left")
    return changes.select("path", "old_path", "status", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("additions", "deletions")]), diffs
