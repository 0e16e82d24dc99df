"""Queries over the symbol graph. ``refs`` is denormalised: an edge names both ends, so no query joins to find them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.functions.lineage import cut, cut_counted
from mergelens.functions.paths import clean_path
from mergelens.schemas import TYPE_KINDS

EDGE = ["src_file", "src_name", "dst_file", "dst_name", "kind"]
DEPTH = 2
#: Frontiers up to this number are broadcast.
FEW = 10_000
#: Frontiers up to this number are handed to the scan as values, and row groups and pages without any aren't read.
NAMED = 1000
#: What a step with a larger frontier asks of Spark: a bloom filter of the frontier, whatever the size of the links.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "64MB",
}


def refs_to(refs: DataFrame, file: str, name: str) -> DataFrame:
    return refs.where((F.col("dst_file") == file) & (F.col("dst_name") == name)).select(*EDGE).distinct().orderBy(*EDGE)


def refs_from(refs: DataFrame, file: str, name: str) -> DataFrame:
    return refs.where((F.col("src_file") == file) & (F.col("src_name") == name)).select(*EDGE).distinct().orderBy(*EDGE)


def callers(refs: DataFrame, file: str, name: str) -> DataFrame:
    """file, name, kind of every edge into a symbol."""
    return refs_to(refs, file, name).select(F.col("src_file").alias("file"), F.col("src_name").alias("name"), "kind").distinct().orderBy("file", "name", "kind")


def callees(refs: DataFrame, file: str, name: str) -> DataFrame:
    """file, name, kind of every edge out of a symbol."""
    return refs_from(refs, file, name).select(F.col("dst_file").alias("file"), F.col("dst_name").alias("name"), "kind").distinct().orderBy("file", "name", "kind")


def refs_into_file(refs: DataFrame, file: str) -> DataFrame:
    """Edges into any symbol of a file."""
    return refs.where(F.col("dst_file") == file).select(*EDGE).distinct().orderBy(*EDGE)


def symbol_kind(symbols: DataFrame, file: str, name: str) -> str | None:
    """Kind of a symbol, of its first line if it has several."""
    row = symbols.where((F.col("file_path") == file) & (F.col("name") == name)).agg(F.min_by("kind", F.struct("line", "kind")).alias("k")).head()
    return row.k


def type_uses(refs: DataFrame, symbols: DataFrame, file: str, name: str) -> DataFrame:
    """``callers`` of a type. Raises ValueError if there is no such symbol or it is no type."""
    kind = symbol_kind(symbols, file, name)
    if kind is None:
        raise ValueError(f"no symbol {name} in {file}")
    if kind not in TYPE_KINDS:
        raise ValueError(f"{name} in {file} is a {kind}, not a type")
    return callers(refs, file, name)


def imports_of(imports: DataFrame, file: str) -> DataFrame:
    """import_path of a file, sorted; an index holds each once."""
    return imports.where(F.col("file_path") == file).select("import_path").orderBy("import_path")


def files_touching(refs: DataFrame, file: str, name: str) -> DataFrame:
    """The declaring file, indexed or not, and all that refer to the symbol."""
    own = refs.sparkSession.createDataFrame([(file,)], "path string")
    return refs_to(refs, file, name).select(F.col("src_file").alias("path")).union(own).distinct().orderBy("path")


def file_links(refs: DataFrame) -> DataFrame:
    """a, b: files that an edge joins, both ways, each once; edges within a file left out. One shuffle."""
    ends = F.array(F.struct(F.col("src_file").alias("a"), F.col("dst_file").alias("b")), F.struct(F.col("dst_file").alias("a"), F.col("src_file").alias("b")))
    return refs.where("src_file <> dst_file").select(F.explode(ends).alias("e")).select("e.*").distinct()


def _step(links: DataFrame, frontier: DataFrame, n: int, found: DataFrame, d: int) -> tuple[DataFrame, int]:
    """The files at distance ``d``, written as a table, and their number.

    The links are scanned once. Of a frontier of up to ``NAMED`` files the names are asked of the scan itself. One of up to
    ``FEW`` files is broadcast, so the links aren't shuffled; a larger one is a selected part of a table, from which Spark
    makes a bloom filter that the scan of the links applies before its shuffle.
    """
    conf, had, more = links.sparkSession.conf, {}, {}
    if n <= min(NAMED, FEW):
        near = links.where(F.col("a").isin([r.path for r in frontier.select("path").collect()]))
        more = {"spark.sql.parquet.pushdown.inFilterThreshold": str(NAMED)}
    else:
        few = F.broadcast(frontier) if n <= FEW else frontier
        near = links.join(few.select(F.col("path").alias("a")), "a")
        more = BLOOM if n > FEW else {}
    reached = near.select(F.col("b").alias("path")).distinct()
    new = reached.join(found.select("path"), "path", "left_anti").select("path", F.lit(d).alias("distance"))
    try:
        had = {k: conf.get(k, None) for k in more}
        for k, v in more.items():
            conf.set(k, v)
        return cut_counted(new, f"impact-{d}")
    finally:
        for k, v in had.items():
            conf.unset(k) if v is None else conf.set(k, v)


def impact(links: DataFrame, seeds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, distance: files at up to ``depth`` steps from ``seeds`` (column path), the least distance each.

    ``links`` go both ways (a, b; repeated ones do no harm). Each frontier is a table, written once and counted as it is
    written; a step reads the links and leaves out what has been reached. The rows never come to the driver.
    """
    found, n = cut_counted(seeds.select("path").distinct().withColumn("distance", F.lit(0)), "impact-0")
    frontier = found
    for d in range(1, depth + 1):
        if not n:
            break
        frontier, n = _step(links, frontier.where(F.col("distance") == d - 1), n, found, d)
        found = found.union(frontier)
    return found


def seeds(spark: SparkSession, changed: Iterable[str]) -> DataFrame:
    """path: changed paths, cleaned; empty and root paths are none."""
    df = spark.createDataFrame([(p,) for p in changed], "raw string")
    return df.select(clean_path(F.col("raw")).alias("path"), "raw").where("raw <> '' and path not in ('.', '/')").select("path").distinct()


def impact_set(refs: DataFrame, changed: Iterable[str], depth: int = DEPTH) -> DataFrame:
    """``impact`` of changed paths over edges that no index holds: their links are written first, sorted by file, and the
    steps read those. A path that isn't indexed is at distance 0."""
    links = cut(file_links(refs).sortWithinPartitions("a"), "impact-links")
    return impact(links, seeds(refs.sparkSession, changed), depth).orderBy("distance", "path")


def context_files(reached: DataFrame, contents: DataFrame) -> DataFrame:
    """path, distance, code of what ``impact`` reached beyond its seeds; ``contents``: path, code. Files that can't be read
    are left out."""
    return reached.where("distance > 0").join(contents, "path").select("path", "distance", "code")


def repo_index(files: DataFrame, symbols: DataFrame, imports: DataFrame, directory: str | None = None) -> DataFrame:
    """repo_path, path, language, hash, symbols, imports: a row for each file, also for those without symbols; symbols of
    files that aren't indexed don't appear. ``directory`` picks one."""
    from mergelens.functions.paths import dir_of

    if directory is not None:
        files = files.where(dir_of(F.col("path")) == directory)
    key = ["repo_path", "path"]
    s = symbols.groupBy("repo_path", F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))).alias("symbols"))
    i = imports.groupBy("repo_path", F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list("import_path")).alias("imports"))
    none_s, none_i = F.expr("cast(array() as array<struct<line:int,name:string,kind:string>>)"), F.expr("cast(array() as array<string>)")
    out = files.join(s, key, "left").join(i, key, "left")
    return out.select(*key, "language", "hash", F.coalesce("symbols", none_s).alias("symbols"), F.coalesce("imports", none_i).alias("imports"))


def symbol_rows(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with their symbols, flat; a file without has nulls."""
    s = symbols.select("repo_path", F.col("file_path").alias("path"), "name", "kind", "line")
    return files.join(s, ["repo_path", "path"], "left")


def dangling(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of which an end is no symbol."""
    s = symbols.select("repo_path", "file_path", "name").distinct()
    ends = [s.select("repo_path", F.col("file_path").alias(f"{x}_file"), F.col("name").alias(f"{x}_name"), F.lit(True).alias(f"{x}_ok")) for x in ("src", "dst")]
    out = refs
    for x, e in zip(("src", "dst"), ends, strict=True):
        out = out.join(e, ["repo_path", f"{x}_file", f"{x}_name"], "left")
    return out.where("src_ok is null or dst_ok is null").select("repo_path", *EDGE)


def check_refs(refs: DataFrame, symbols: DataFrame) -> None:
    """Raises ValueError if an edge has an end that is no symbol. What is compared is the ends, each once; the edges are
    joined only where one is missing."""
    key = ["repo_path", "file_path", "name"]
    src, dst = (refs.select("repo_path", F.col(f"{x}_file").alias("file_path"), F.col(f"{x}_name").alias("name")) for x in ("src", "dst"))
    if src.union(dst).distinct().join(symbols.select(*key), key, "left_anti").count():
        raise ValueError(f"edge with an unknown end: {dangling(refs, symbols).head().asDict()}")
