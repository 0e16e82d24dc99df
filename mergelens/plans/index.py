"""The index of repositories: generations of rows under a commit log, laid out for lookups.

Edges are kept twice, sorted by their source and by their target, which are also the links between files, both ways; each
table is sorted by what it is asked for and has bloom filters, so a lookup reads the row groups that hold its rows. A
generation is a folder of its own: those without a directory left are not read and may be deleted. ``compact`` writes what is left
of many generations as one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Collection, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.functions import fs
from mergelens.operators import graph
from mergelens.operators.sync import digests
from mergelens.plans.commits import EVERY, FEW, CommitLog
from mergelens.schemas import INDEX_FILES, INDEX_IMPORTS, INDEX_REFS, INDEX_SYMBOLS

DIGESTS = "repo_path string, own string"
#: Columns, sort order, columns with bloom filters.
TABLES = {
    "index_files": (INDEX_FILES, ["repo_path", "path"], ["path"]),
    "index_symbols": (INDEX_SYMBOLS, ["repo_path", "file_path", "name"], ["file_path", "name"]),
    "index_imports": (INDEX_IMPORTS, ["repo_path", "file_path"], ["file_path"]),
    "index_refs": (INDEX_REFS, ["repo_path", "src_file", "src_name"], ["src_file"]),
    "index_refs_into": (INDEX_REFS, ["repo_path", "dst_file", "dst_name"], ["dst_file"]),
    "index_digests": (DIGESTS, ["repo_path", "dir"], []),
}
#: Tables that an earlier version of this engine kept as well.
FORMER = ["index_links"]
#: Bytes of a generation's table from which on it isn't sorted again.
LARGE = 16 << 20
#: Generations that are read side by side before they are written as one.
MOST = 64


def _each(f: Callable[[str], None], names: Iterable[str]) -> None:
    """``f`` of all tables side by side: the last tasks of one leave cores to the next."""
    with ThreadPoolExecutor(len(TABLES)) as pool:
        list(pool.map(f, names))


class Index:
    def __init__(self, spark: SparkSession, root: str, most: int = MOST, every: int = EVERY, options: dict[str, str] | None = None):
        self.spark, self.root, self.most, self.options = spark, root.rstrip("/"), most, options or {}
        self.log = CommitLog(spark, f"{self.root}/index_log", every)
        self._known: tuple[int, DataFrame, dict[str, bool], bool] = (-1, None, {}, True)

    def _current(self) -> tuple[DataFrame, dict[str, bool]]:
        """The state, and of each generation that it names whether all its directories are still current. Generations are
        few: ``compact`` sees to it."""
        if self._known[0] != self.log.version():
            version, state = self.log.state()
            gens = state.groupBy("gen").agg((F.count("*") == F.first("total")).alias("whole"), F.count("*").alias("n")).collect()
            self._known = (version, state, {r.gen: r.whole for r in gens}, sum(r.n for r in gens if not r.whole) <= FEW)
        return self._known[1:3]

    def _read(self, table: str, gens: Iterable[str]) -> DataFrame:
        schema = TABLES[table][0] + ", dir string, gen string"
        paths = [f"{self.root}/{table}/gen={g}" for g in sorted(gens)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def read(self, table: str, repo: str | None = None, of: Iterable[str] | None = None) -> DataFrame:
        """Current rows of a table, or of some of its generations. Generations that are whole are read as they are; only those
        of which some directory was replaced since are joined with the state, whose directories are broadcast if they are few,
        so that the rows stay where they are and as they are sorted."""
        state, gens = self._current()
        if of is not None:
            gens = {g: gens[g] for g in of if g in gens}
        pick = (lambda df: df) if repo is None else (lambda df: df.where(F.col("repo_path") == repo))
        out = pick(self._read(table, [g for g, whole in gens.items() if whole]))
        torn = [g for g, whole in gens.items() if not whole]
        if torn:
            left = pick(state).where(F.col("gen").isin(torn)).select("repo_path", "dir", "gen")
            left = F.broadcast(left) if self._known[3] else left
            out = out.unionByName(pick(self._read(table, torn)).join(left, ["repo_path", "dir", "gen"], "left_semi"))
        return out.drop("gen")

    def _write(self, table: str, df: DataFrame, gen: str, repo: str | None = None, ordered: bool = False, ranges: bool = True) -> None:
        """Adds rows to a generation, sorted, or in the order that they come in (``ordered``). ``repo``: all are of this
        repository, which travels with none of them and is no part of the order. Sorted rows are dealt out by ranges of the
        order, for which Spark reads them once more, or by its hash."""
        schema, order, blooms = TABLES[table]
        names = [*[c.split()[0] for c in schema.split(", ")], "dir"]
        rows = df.select(*names)
        if repo is not None:
            rows, order = rows.drop("repo_path"), [c for c in order if c != "repo_path"]
        if not ordered:
            rows = (rows.repartitionByRange(*order) if ranges else rows.repartition(*order)).sortWithinPartitions(*order)
        if repo is not None:
            rows = rows.select(*[F.lit(repo).alias(c) if c == "repo_path" else c for c in names])
        writer = rows.write.mode("append")
        for c in blooms:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.options(**{"parquet.bloom.filter.adaptive.enabled": "true"} | self.options).parquet(f"{self.root}/{table}/gen={gen}")

    def replace(self, repo: str, dirs: Iterable[str], tables: dict[str, DataFrame], ordered: Collection[str] = ()) -> int:
        """Replaces directories whole in all tables; those that get no file are gone. ``tables`` are files, symbols, refs and
        imports with ``dir``; those that ``ordered`` names come sorted, or in a few sorted runs a partition, and are written as
        they lie. The others are dealt out by hash and sorted. All of it becomes visible with one commit. Returns the version."""
        gen, refs = uuid.uuid4().hex, tables["index_refs"]
        own = digests(tables["index_files"]).withColumn("repo_path", F.lit(repo))
        rows = {**tables, "index_refs_into": refs, "index_digests": own}
        _each(lambda name: self._write(name, rows[name], gen, repo, name in ordered, ranges=False), rows)
        there = {r.dir for r in self._read("index_files", [gen]).select("dir").distinct().collect()}  # a row a changed directory
        version = self.log.commit(gen, [(repo, d, d in there) for d in sorted(set(dirs))])
        if len(self._current()[1]) > self.most:
            self.compact()
        return version

    def delete(self, repo: str, *folders: str) -> int:
        return self.log.commit("", [(repo, f, False) for f in folders])

    def compact(self) -> int:
        """Writes the current rows of all generations as one. Those of a large generation, which are sorted, are copied as they
        lie, without a shuffle, unless so many directories are left that they aren't broadcast; all others are sorted together.
        Returns the version."""
        state, gens = self._current()
        if not gens:
            return self.log.version()
        gen, repos = uuid.uuid4().hex, [r.repo_path for r in state.select("repo_path").distinct().limit(2).collect()]
        one = repos[0] if len(repos) == 1 else None

        def write(name: str) -> None:
            large = [g for g in gens if (gens[g] or self._known[3]) and fs.size(self.spark, f"{self.root}/{name}/gen={g}") >= LARGE]
            small = [g for g in gens if g not in large]
            if small:
                self._write(name, self.read(name, of=small), gen, one)
            if large:
                self._write(name, self.read(name, of=large), gen, ordered=True)

        _each(write, TABLES)
        return self.log.replace(state, gen)

    def vacuum(self, older_s: float = 86_400) -> list[str]:
        """Deletes generations that the state doesn't name and whose files are older than any running writer or reader, and
        what the log has no need of. Returns their names."""
        before = int((time.time() - older_s) * 1000)
        _, gens = self._current()
        dead = set()
        for table in [*TABLES, *FORMER]:
            for name, at in fs.names(self.spark, f"{self.root}/{table}").items():
                if name.startswith("gen=") and name[4:] not in gens and at < before:
                    fs.delete(self.spark, f"{self.root}/{table}/{name}")
                    dead.add(name[4:])
        self.log.vacuum(before)
        return sorted(dead)

    # lookups, each on the table that is sorted by what it asks for

    def callers(self, repo: str, file: str, name: str) -> DataFrame:
        return graph.callers(self.read("index_refs_into", repo), file, name)

    def callees(self, repo: str, file: str, name: str) -> DataFrame:
        return graph.callees(self.read("index_refs", repo), file, name)

    def refs_into_file(self, repo: str, file: str) -> DataFrame:
        return graph.refs_into_file(self.read("index_refs_into", repo), file)

    def type_uses(self, repo: str, file: str, name: str) -> DataFrame:
        return graph.type_uses(self.read("index_refs_into", repo), self.read("index_symbols", repo), file, name)

    def files_touching(self, repo: str, file: str, name: str) -> DataFrame:
        return graph.files_touching(self.read("index_refs_into", repo), file, name)

    def imports_of(self, repo: str, file: str) -> DataFrame:
        return graph.imports_of(self.read("index_imports", repo), file)

    def impact_set(self, repo: str, changed: Iterable[str], depth: int = graph.DEPTH) -> DataFrame:
        """``graph.impact`` over the edges that are kept with the index: by source and by target they are its links."""
        return graph.impact(self.links(repo), graph.seeds(self.spark, changed), depth).orderBy("distance", "path")

    def links(self, repo: str) -> DataFrame:
        """a, b: files that an edge joins, both ways, as often as edges do."""
        out, into = (self.read(t, repo).where("src_file <> dst_file") for t in ("index_refs", "index_refs_into"))
        return out.select(F.col("src_file").alias("a"), F.col("dst_file").alias("b")).union(into.select("dst_file", "src_file"))
