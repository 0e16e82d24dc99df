"""Cutting lineage with tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a null doc_id stands in the order of documents: before every other.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves a local master; on a cluster,
    whose machines share none, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="mergelens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to a table of its own in the shared folder and read it back, so that a lost executor costs no
    recomputation of what stands before it; and the table's path."""
    path = f"{shared_dir(df.sparkSession)}/mergelens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``table`` for good."""
    return table(df, label)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shield(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns ``own`` under their names and every other renamed by its place, so that no name, whatever
    characters or twins it has, meets one of an operator's; and a function that gives such columns their names back."""
    names = docs.columns
    inner = [n if n in own and names.index(n) == k else f"_other_{k}" for k, n in enumerate(names)]
    former = dict(zip(inner, names, strict=True))
    return docs.toDF(*inner), lambda df: df.toDF(*[former.get(c, c) for c in df.columns])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text, ``more`` and the key of a document: ``dk`` (its id, a null id as the smallest) with ``th`` (a hash of its text).

    Rows that repeat both id and text are one document; rows that share an id but not a text are several.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("dk"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
        *[v.alias(k) for k, v in (more or {}).items()],
    )
