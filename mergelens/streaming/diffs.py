"""Findings of diffs as they arrive: a front end over the batch operators, in micro-batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mergelens.operators.detect import run_detectors
from mergelens.operators.diff import added_lines
from mergelens.operators.findings import dedupe, union_all, with_ids
from mergelens.operators.rules import Rule, default_rules, evaluate
from mergelens.schemas import DIFFS, FINDINGS

#: A diff of a path and when it was taken; of two diffs of a path the one taken later stands.
VERSIONS = DIFFS + ", at timestamp"
ACCEPTED = VERSIONS + ", version long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def watch(spark: SparkSession, source: str, sink: str, checkpoint: str, rules: Sequence[Rule] | None = None, detectors: Sequence[str] = ("secrets",), **trigger) -> StreamingQuery:
    """Starts a query that reads Parquet files of diffs (path, diff_text) from ``source`` and writes their findings under
    ``sink``, a folder for each micro-batch that a repeated batch replaces, so each diff's findings are there once.

    Numbering and dedupe look at one diff at a time; nothing is kept between batches, for that there is ``follow``.
    ``trigger`` goes to the query, as ``availableNow=True``.
    """
    rules = default_rules() if rules is None else rules

    def write(batch: DataFrame, batch_id: int) -> None:
        _findings(batch, rules, detectors).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream = spark.readStream.schema(DIFFS).parquet(source)
    return _start(stream.writeStream.foreachBatch(write), checkpoint, trigger)


def _findings(diffs: DataFrame, rules: Sequence[Rule], detectors: Sequence[str]) -> DataFrame:
    lines = added_lines(diffs)
    found, _, _ = run_detectors(lines, detectors)
    return with_ids(dedupe(union_all([*found, evaluate(lines, rules)])))


def _start(writer, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


class Latest(StatefulProcessor):
    """Keeps of each path when its last diff was taken, a digest of it and how many there were. Of a batch's diffs only the
    last goes on, and only if it is later than that and says something else; a diff that comes late, or again, goes nowhere."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "at long, digest string, version long", self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = None
        for df in rows:
            for text, at in zip(df["diff_text"], df["at"], strict=True):
                now = (-(2**63) if pd.isna(at) else pd.Timestamp(at).value, text or "")
                best = now if best is None or now > best else best
        digest = hashlib.sha256(best[1].encode()).hexdigest()
        was = self.state.get() if self.state.exists() else None
        if was is not None and was[0] >= best[0]:
            return
        again = was is not None and was[1] == digest
        version = (was[2] if was else 0) + (not again)
        self.state.update((best[0], digest, version))
        if not again:
            at = pd.NaT if best[0] == -(2**63) else pd.Timestamp(best[0])
            yield pd.DataFrame({"path": [key[0]], "diff_text": [best[1]], "at": pd.Series([at], dtype="datetime64[ns]"), "version": [version]})

    def close(self) -> None:
        pass


def latest_diffs(diffs: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """A stream of ``VERSIONS`` without what is outdated or repeated, numbered by path (``ACCEPTED``). ``forget_ms`` is how long
    a path that gets no diff is remembered, for ever if it is None. Rows without a path go."""
    grouped = diffs.where("path is not null").groupBy("path")
    return grouped.transformWithStateInPandas(Latest(forget_ms), ACCEPTED, "Update", "ProcessingTime" if forget_ms else "None")


def follow(
    spark: SparkSession, source: str, sink: str, checkpoint: str, rules: Sequence[Rule] | None = None, detectors: Sequence[str] = ("secrets",), forget_ms: int | None = None, **trigger
) -> StreamingQuery:
    """Starts a query that keeps the findings of each path's last diff. It reads Parquet files of ``VERSIONS`` and writes
    under ``sink`` the versions that count and their findings, a folder each for a micro-batch, replaced if it is repeated;
    ``current`` reads what stands. The findings of older versions stay as history."""
    rules = default_rules() if rules is None else rules
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the state's output is read twice
        try:
            found = _findings(batch.select("path", "diff_text"), rules, detectors)
            heads = batch.select("path", "at", "version")
            found.join(heads.select(F.col("path").alias("file"), "version"), "file").select(*_columns(), "version").write.mode("overwrite").parquet(f"{sink}/findings/batch={batch_id}")
            heads.write.mode("overwrite").parquet(f"{sink}/versions/batch={batch_id}")  # last: what it names is there
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(VERSIONS).parquet(source)
    return _start(latest_diffs(stream, forget_ms).writeStream.outputMode("update").foreachBatch(write), checkpoint, trigger)


def _columns() -> list[str]:
    return [c.split()[0] for c in FINDINGS.split(", ")]


def current(spark: SparkSession, sink: str) -> DataFrame:
    """The findings that stand: of each path those of its last version, none if that has none."""
    versions = spark.read.schema("path string, at timestamp, version long").parquet(f"{sink}/versions")
    last = versions.groupBy(F.col("path").alias("file")).agg(F.max("version").alias("version"))
    rows = spark.read.schema(FINDINGS + ", version long").parquet(f"{sink}/findings")
    return rows.join(last, ["file", "version"], "left_semi").select(*_columns(), "version")
