"""Stored reviews and index tables as Parquet.

What belongs together is written first and becomes visible by one small write at the end: a review by its row in
``reviews``, a change of the index by a version of its log (``plans.index``). A run that dies in between leaves rows that
nothing refers to.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Collection, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mergelens.functions.lineage import cut
from mergelens.operators.findings import with_ids
from mergelens.operators.graph import check_refs
from mergelens.operators.sync import SyncSummary, digests, split_index, stale_by_digest
from mergelens.plans.index import Index
from mergelens.schemas import MIGRATIONS, REVIEWS, STORED_FINDINGS



#: Folders that reviews are dealt to by their repository.
BUCKETS = 64


def latest_per_repo(reviews: DataFrame, repo: str = "repo_path", at: str = "started_at", id_: str = "id") -> DataFrame:
    """Of each repository the review that started last, of the greatest id among several, and the number of its reviews:
    one aggregate, combined before its shuffle."""
    top = F.max_by(F.struct("*"), F.struct(at, id_)).alias("top")
    return reviews.groupBy(repo).agg(top, F.count("*").alias("reviews")).select("top.*", "reviews")


def review_findings(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of reviews, each with what its review says of itself: ``findings`` joined by review_id with ``reviews``
    (id, mode, ..) and the number of the review's findings, counted before the join."""
    counted = findings.groupBy("review_id").agg(F.count("*").alias("findings_count"))
    heads = reviews.withColumnRenamed("id", "review_id").drop("findings_count").join(counted, "review_id")
    return findings.join(heads, "review_id")


def finding_order() -> list[Column]:
    """By file and line, findings of a whole file first."""
    return [F.col("file"), F.col("line_start").asc_nulls_first(), F.col("position")]


def _bucket(repo: Column) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(BUCKETS)).cast("int")


class Store:
    """Tables in a folder; missing ones are made when the store opens."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.index = Index(spark, self.root)
        self.migrate()

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _schema(self, table: str) -> str:
        return {"reviews": REVIEWS + ", bucket int", "findings": STORED_FINDINGS, "schema_migrations": "version int"}[table]

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str) -> DataFrame:
        if not self._exists(table):
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).parquet(self._path(table))

    def migrate(self) -> list[int]:
        """Applies the migrations that the ledger doesn't have, in order; returns their numbers."""
        done = {r.version for r in self.read("schema_migrations").collect()}
        new = [v for v, _ in MIGRATIONS if v not in done]
        for v in new:
            self.spark.createDataFrame([(v,)], "version int").coalesce(1).write.mode("append").parquet(self._path("schema_migrations"))
        return new

    # reviews

    def save_review(self, review: dict, findings: DataFrame) -> None:
        """``review``: id, repo_path, mode, started_at, finished_at; findings in the order of ``rank`` if they have it. A
        review is there with all its findings or not at all: they are written to a folder of this attempt, which the
        review's row then names, so that what a lost attempt wrote belongs to no review. They are counted as they are written."""
        own = with_ids(findings)
        position = F.col("rank").cast("int") if "rank" in own.columns else F.lit(None).cast("int")
        attempt, seen = uuid.uuid4().hex, Observation()
        names = [c.split()[0] for c in STORED_FINDINGS.split(", ") if not c.startswith("attempt")]
        rows = own.withColumns({"review_id": F.lit(review["id"]), "position": position}).select(*names)
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(self._findings(attempt))
        row = (review["id"], review["repo_path"], review["mode"], review["started_at"].replace(microsecond=0), review["finished_at"].replace(microsecond=0), seen.get["n"], attempt)
        heads = self.spark.createDataFrame([row], REVIEWS).withColumn("bucket", _bucket(F.col("repo_path")))
        heads.coalesce(1).write.mode("append").partitionBy("bucket").option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(self._path("reviews"))

    def _findings(self, attempt: str) -> str:
        return f"{self._path('findings')}/attempt={attempt}"

    def get_review(self, id_: str, repo: str | None = None) -> tuple[dict, DataFrame]:
        """A review and its findings by file and line, none first; of the findings ever stored only its own are read, and with
        ``repo`` only that repository's reviews are looked through. Raises KeyError."""
        found = self.reviews(repo).where(F.col("id") == id_).head(1)
        if not found:
            raise KeyError(id_)
        schema = ", ".join(c for c in STORED_FINDINGS.split(", ") if not c.startswith("attempt"))
        rows = self.spark.read.schema(schema).parquet(self._findings(found[0].attempt))
        return found[0].asDict(), rows.orderBy(*finding_order())

    def findings_of(self, reviews: DataFrame) -> DataFrame:
        """The findings of some reviews, each with what its review says of itself, see ``review_findings``. ``reviews`` is a page
        of ``list_reviews``; only the folders that it names are read."""
        some = reviews.where("findings_count > 0")
        paths = [self._findings(r.attempt) for r in some.select("attempt").collect()]  # a page of reviews
        schema = ", ".join(c for c in STORED_FINDINGS.split(", ") if not c.startswith("attempt"))
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return review_findings(some.select("id", "repo_path", "started_at"), rows.withColumnRenamed("id", "finding_id"))

    def reviews(self, repo: str | None = None) -> DataFrame:
        """All reviews, or those of a repository, whose bucket alone is read."""
        rows = self.read("reviews")
        if repo is not None:
            rows = rows.where((F.col("bucket") == _bucket(F.lit(repo))) & (F.col("repo_path") == repo))
        return rows.drop("bucket")

    def list_reviews(self, repo: str, limit: int | None = None, after: tuple[datetime, str] | None = None) -> DataFrame:
        """Reviews of a repository, the latest first. ``limit`` asks for a page of so many; the next one goes on ``after``
        (started_at, id) of its last row. A page is the least rows of each task, not a sort of all."""
        rows = self.reviews(repo)
        if after is not None:
            at, id_ = F.lit(after[0]), F.lit(after[1])
            rows = rows.where((F.col("started_at") < at) | ((F.col("started_at") == at) & (F.col("id") < id_)))
        rows = rows.orderBy(F.col("started_at").desc(), F.col("id").desc())
        return rows if limit is None else rows.limit(limit)

    def list_repos(self) -> DataFrame:
        """repo_path, last_started, last_findings, reviews."""
        latest = latest_per_repo(self.reviews())
        named = latest.select("repo_path", F.col("started_at").alias("last_started"), F.col("id").alias("last_id"), F.col("findings_count").alias("last_findings"), "reviews")
        return named.orderBy(F.col("last_started").desc(), "repo_path")

    # index

    def digests(self, repo: str) -> DataFrame:
        """dir, own: the digests of a repository's directories, see ``operators.sync.digests``."""
        return self.index.read("index_digests", repo).select("dir", "own")

    def replace_dirs(self, repo: str, dirs: Iterable[str], tables: dict[str, DataFrame], ordered: Collection[str] = ()) -> None:
        """Replaces directories whole in all tables of the index; those that get no file are gone. Raises ValueError, and
        changes nothing, if an edge has an unknown end. ``ordered`` names tables that come sorted."""
        check_refs(tables["index_refs"], tables["index_symbols"])
        self.index.replace(repo, dirs, tables, ordered)

    def delete_dirs(self, repo: str, *folders: str) -> None:
        """With one commit."""
        self.index.delete(repo, *folders)


def sync(files: DataFrame, repo: str, store: Store | None = None) -> SyncSummary:
    """Brings the index of a repository up to its source files (``sources.files.source_files``); without a store nothing
    is written and the summary says what would be. Files that can't be parsed get no row, so their directory is looked at
    again each time."""
    from mergelens.functions.paths import dir_of
    from mergelens.sources.files import index_rows

    spark = files.sparkSession
    stored = store.digests(repo) if store else spark.createDataFrame([], "dir string, own string")
    dirs = [r.dir for r in stale_by_digest(stored, digests(files)).orderBy("dir").collect()]  # one row a changed directory
    if not dirs:
        return SyncSummary()
    wanted = F.broadcast(spark.createDataFrame([(d,) for d in dirs], "dir string"))
    own = files.join(wanted, dir_of(F.col("path")) == wanted.dir, "left_semi")
    seen = Observation()
    counts = [F.count_if(F.col("record") == r).alias(r) for r in ("file", "symbol", "ref", "skipped")]
    rows = cut(index_rows(own).observe(seen, *counts), "sync-rows")  # counted as it is written
    n = seen.get
    skipped = sorted(r.file for r in rows.where("record = 'skipped'").select("file").collect()) if n["skipped"] else []
    if store:
        store.replace_dirs(repo, dirs, split_index(rows, own))
    return SyncSummary(n["file"], n["symbol"], n["ref"], len(dirs), skipped)


def numbered_reviews(reviews: DataFrame, repo_col: str) -> DataFrame:
    """Reviews with their place in the list of their repository, the latest first."""
    return reviews.withColumn("position", F.row_number().over(W.partitionBy(repo_col).orderBy(F.col("started_at").desc(), F.col("id").desc())))


def default_path() -> str:
    return os.path.join(os.path.expanduser("~"), ".mergelens", "store")
