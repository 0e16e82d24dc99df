"""Source trees: walking, hashing, and what turns Go files into index rows."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.functions.lineage import cut
from mergelens.functions.paths import dir_of

SKIPPED_DIRS = (".git", ".codegraph", "node_modules", "vendor", "dist", "build")
LANGUAGES = {".go": "go"}
INDEX = "repo_path string, dir string, record string, file string, name string, kind string, line int, dst_file string, dst_name string"


def language_of(path: Column) -> Column:
    """Column: the language of a path by its extension, null if it isn't known."""
    out = F.lit(None).cast("string")
    for ext, name in LANGUAGES.items():
        out = F.when(path.endswith(ext), name).otherwise(out)
    return out


def walk(root: str, skip_dirs: Sequence[str] = SKIPPED_DIRS) -> list[str]:
    """Relative paths, with slashes, of files of known languages, sorted; folders of the names in ``skip_dirs`` are passed
    over, but never the root."""
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in skip_dirs)
        out += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names if os.path.splitext(n)[1] in LANGUAGES]
    return sorted(out)


def discover(spark: SparkSession, root: str, skip_dirs: Sequence[str] = SKIPPED_DIRS, parts: int = 8) -> DataFrame:
    """repo_path, path, language, hash, content of a repository that driver and executors both see; the files are read on
    the executors. Unreadable files are left out."""
    paths = spark.createDataFrame([(p,) for p in walk(root, skip_dirs)], "path string").repartition(parts)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b.path:
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        rows.append((p, f.read()))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "content"])

    return source_files(paths.mapInPandas(read, "path string, content binary"), root)


def source_files(files: DataFrame, repo_path: str) -> DataFrame:
    """path and content to the relation of source files: language by extension, others left out, and the SHA-256."""
    return files.select(
        F.lit(repo_path).alias("repo_path"), "path", language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"), "content"
    ).where("language is not null")


def index_rows(files: DataFrame) -> DataFrame:
    """Symbols, imports, references and unparsable files of source files, one row each (``INDEX``): record is ``file``,
    ``symbol``, ``import``, ``ref`` or ``skipped``. A file is parsed on its own and what it gives is written as a table; what it
    mentions is then joined with the symbols of its directory's package, so no task holds a directory."""
    # by number, so that few bytes that take long to parse aren't one task
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("repo_path", dir_of(F.col("path")).alias("dir"), "path", "content").repartition(parts, "repo_path", "path")
    parsed = cut(dealt.mapInArrow(_parsed, PARSED), "index-parsed")
    own = parsed.where("record <> 'mention'").select(*[c.split()[0] for c in INDEX.split(", ")])
    return own.unionByName(_references(parsed).select("*", F.lit("ref").alias("record"), F.lit(None).cast("int").alias("line")))


#: Rows of ``INDEX`` and the mentions of ``goparse.mentions``: name, kind (call, ref or sel), target, member, called.
PARSED = INDEX + ", package string, nth int, member string, called boolean"
#: Rows that are handed on at once.
ROWS = 20_000


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from mergelens.sources.goparse import GoSyntaxError, mentions, parse

    names = [c.split()[0] for c in PARSED.split(", ")]
    kinds = [{"int": pa.int32(), "boolean": pa.bool_()}.get(c.split()[1], pa.string()) for c in PARSED.split(", ")]
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows.clear()
        return got

    for b in batches:
        for repo, folder, path, content in zip(*[b.column(c) for c in ("repo_path", "dir", "path", "content")], strict=True):
            repo, folder, path = repo.as_py(), folder.as_py(), path.as_py()
            row = lambda record, name=None, kind=None, line=None, target=None, *more: (repo, folder, record, path, name, kind, line, None, target, *more, *(None,) * (4 - len(more)))  # noqa: B023, E731
            try:
                f = parse(path, content.as_py().decode("utf-8", "replace"))
            except (GoSyntaxError, RecursionError):
                rows.append(row("skipped"))
                continue
            rows.append(row("file"))
            rows += [row("symbol", n, k, line, None, f.package, i) for i, (n, k, line) in enumerate(f.symbols)]
            rows += [row("import", i) for i in f.imports]
            rows += [row("mention", owner, what, None, name, f.package, None, member, called) for owner, what, name, member, called in mentions(f)]
            if len(rows) >= ROWS:
                yield out()
    if rows:
        yield out()


def _references(parsed: DataFrame) -> DataFrame:
    """``goparse.resolve`` of all files: mentions joined with the names that their packages declare; of several declarations the
    least file is the target and the last one gives the kind."""
    key = ["repo_path", "dir", "package"]
    declared = parsed.where("record = 'symbol'").groupBy(*key, F.col("name").alias("found")).agg(F.min("file").alias("at"), F.max_by("kind", F.struct("file", "nth")).alias("is"))
    said = parsed.where("record = 'mention'").select(*key, "file", "name", F.col("kind").alias("what"), F.col("dst_name").alias("found"), "member", "called")
    plain = said.join(declared, [*key, "found"])
    owned = declared.where(F.instr("found", ".") > 0).select(*key, F.col("found").alias("method"), F.col("at").alias("method_at"))
    method = F.when(F.col("what") == "sel", F.concat("found", F.lit("."), "member"))
    both = plain.withColumn("method", method).join(owned, [*key, "method"], "left")
    has = F.col("method_at").isNotNull()
    kind = F.when(has, F.col("called")).otherwise((F.col("what") == "call") & (F.col("is") == "func"))
    edges = both.select(
        "repo_path", "dir", "file", "name", F.when(kind, "call").otherwise("use").alias("kind"), F.coalesce("method_at", "at").alias("dst_file"), F.when(has, F.col("method")).otherwise(F.col("found")).alias("dst_name")
    )
    return edges.where("not (dst_file = file and dst_name = name)").distinct()
