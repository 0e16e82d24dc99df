"""Small files in whatever store a path is in, through Hadoop's file systems."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> dict[str, int]:
    """Name and time of change (milliseconds) of what a folder holds; nothing if there is no folder."""
    p, fs = _at(spark, folder)
    if not fs.exists(p):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(p)}


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder."""
    p, fs = _at(spark, path)
    return fs.getContentSummary(p).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def put_if_absent(spark: SparkSession, path: str, text: str, link: bool = True) -> bool:
    """Writes a whole file under a name that nothing has yet; False if something has it. Of several writers one succeeds.

    The file is written under a name of its own first. On a local disk a hard link gives it the other (``link``), elsewhere a
    rename that doesn't overwrite, which is atomic where the store's rename is.
    """
    p, fs = _at(spark, path)
    fs.mkdirs(p.getParent())
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    temp, _ = _at(spark, own)
    out = fs.create(temp, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if link and fs.getScheme() == "file":
            where = lambda x: fs.makeQualified(x).toUri().getPath()
            try:
                os.link(where(temp), where(p))
            except FileExistsError:
                return False
            return True
        jvm = spark._jvm
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(temp, p, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True
    finally:
        if fs.exists(temp):
            fs.delete(temp, False)
