"""Incremental upkeep of the index: which directories are stale, and what replaces them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.functions.paths import dir_of


@dataclass
class SyncSummary:
    files: int = 0
    symbols: int = 0
    refs: int = 0
    dirs_changed: int = 0
    skipped: list[str] = field(default_factory=list)


def changed_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Paths (column path) that are new, gone or of another hash: a full outer join of path and hash."""
    s, c = stored.select("path", F.col("hash").alias("was")), current.select("path", F.col("hash").alias("now"))
    return s.join(c, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("path", F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "added").otherwise("changed").alias("change"))


def digests(files: DataFrame) -> DataFrame:
    """dir, own: a digest of the paths and hashes of each directory's files, in whatever order. 128 bits and the number of files;
    one aggregate, combined before its shuffle."""
    one = F.xxhash64("path", "hash")
    other = F.xxhash64(F.lit("other"), "hash", "path")
    whole = F.concat_ws(":", F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.bit_xor(other))
    return files.groupBy(dir_of(F.col("path")).alias("dir")).agg(whole.alias("own"))


def root_digest(dirs: DataFrame) -> DataFrame:
    """One row, root: the digest of all directories; its parts are those of ``digests``, so the order doesn't matter."""
    one = F.xxhash64("dir", "own")
    return dirs.agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("other"), "own", "dir"))).alias("root"))


def stale_by_digest(stored: DataFrame, current: DataFrame) -> DataFrame:
    """dir: directories that are new, gone or of other files, from their digests (dir, own).

    Where the digests of the whole trees are alike nothing is compared; else directories are joined, never files.
    """
    s, c = (root_digest(x).head().root for x in (stored, current))
    if s == c:
        return current.select("dir").limit(0)
    was, now = stored.select("dir", F.col("own").alias("was")), current.select("dir", F.col("own").alias("now"))
    return was.join(now, "dir", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("dir")


def stale_dirs(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``stale_by_digest`` of files (path, hash)."""
    return stale_by_digest(digests(stored), digests(current))


def split_index(rows: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Rows of ``sources.files.index_rows`` as the four tables of the index, with ``dir``."""
    is_ = lambda r: rows.where(F.col("record") == r)
    known = is_("file").select("repo_path", "dir", F.col("file").alias("path"))
    return {
        "index_files": known.join(files.select("repo_path", "path", "language", "hash"), ["repo_path", "path"]).select("repo_path", "dir", "path", "language", "hash", F.date_trunc("SECOND", F.current_timestamp()).alias("updated_at")),
        "index_symbols": is_("symbol").select("repo_path", "dir", F.col("file").alias("file_path"), "name", "kind", "line"),
        "index_refs": is_("ref").select("repo_path", "dir", F.col("file").alias("src_file"), F.col("name").alias("src_name"), "dst_file", "dst_name", "kind"),
        "index_imports": is_("import").select("repo_path", "dir", F.col("file").alias("file_path"), F.col("name").alias("import_path")),
    }
