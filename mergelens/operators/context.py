"""Context packs within a token budget, and code windows."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mergelens.functions.lineage import cut
from mergelens.functions.text import estimate_tokens, lines_of

BASELINE = "Findings that are known already; do not report them again:\n"
DIFF = "Added lines of the change:\n"
RELATED = "Code that the change may touch:\n"
NOTE = "\n(context truncated to fit the token budget)\n"
RADIUS = 3


def chunks(added: DataFrame, related: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """section, ord, chunk: what may be shown. Section 0 is a line feed; 1 the diff, by path and line; 2 the related
    files, nearest first, blank lines left out. ``keys`` are columns that tell several packs apart."""
    keys = keys or []
    spark = added.sparkSession
    packs = added.select(*keys).distinct() if keys else spark.range(1).select()

    def row(df: DataFrame, section: int, a: Column, b: Column, c: Column, chunk: Column) -> DataFrame:
        return df.select(*keys, F.lit(section).alias("section"), F.struct(a.cast("long").alias("a"), b.alias("b"), c.cast("long").alias("c")).alias("ord"), chunk.alias("chunk"))

    zero, none = F.lit(0), F.lit("")
    files = added.select(*keys, "path").distinct()
    parts = [
        row(packs, 0, zero, none, zero, F.lit("\n")),
        row(packs, 1, F.lit(-1), none, zero, F.lit(DIFF)),
        row(files, 1, zero, F.col("path"), F.lit(-1), F.concat(F.lit("--- "), F.col("path"), F.lit("\n"))),
        row(added, 1, zero, F.col("path"), F.col("line_ord"), F.concat(F.lit("+"), F.col("number").cast("string"), F.lit(" "), F.col("text"), F.lit("\n"))),
    ]
    if related is not None:
        some = related.select(*keys).distinct() if keys else related.limit(1).select()
        lines = related.select(*keys, "path", "distance", F.posexplode(lines_of(F.col("code"))).alias("pos", "text")).where("text <> ''")
        head = F.concat(F.lit("--- "), F.col("path"), F.lit(" (distance "), F.col("distance").cast("string"), F.lit(")\n"))
        parts += [
            row(some, 2, F.lit(-1), none, zero, F.lit(RELATED)),
            row(related, 2, F.col("distance"), F.col("path"), F.lit(-1), head),
            row(lines, 2, F.col("distance"), F.col("path"), F.col("pos"), F.concat(F.col("text"), F.lit("\n"))),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit(parts: DataFrame, remaining: int, keys: list[str] | None = None) -> DataFrame:
    """The chunks of ``parts`` (section, ord, chunk) that are shown, with their cost: each section shows its chunks in order
    up to the first that doesn't fit, and the next section goes on with what is left of ``remaining`` tokens.

    Costs are one or more, so a section's part is exactly the chunks whose running sum stays within what remains for it.
    The chunks are written once with their costs, dealt to blocks by ranges of their order. A first sweep sums the blocks,
    which gives the sum before each; a second one sums within the blocks that begin inside the budget, and only those are
    shuffled again. So a task holds a block or a pack's budget, however much a pack has.
    """
    own = [*(keys or []), "section"]
    cost = parts.withColumn("cost", estimate_tokens(F.col("chunk")))
    cost = cut(cost.repartitionByRange(*own, "ord").withColumn("_block", F.spark_partition_id()), "context-costs")
    sums = cost.groupBy(*own, "_block").agg(F.sum("cost").alias("_total"))
    by_block = W.partitionBy(*own).orderBy("_block").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row a block
    before = sums.withColumn("_before", F.sum("_total").over(by_block) - F.col("_total")).where(F.col("_before") < remaining).drop("_total")
    near = cost.join(F.broadcast(before) if not keys else before, [*own, "_block"])
    run = F.sum("cost").over(W.partitionBy(*own, "_block").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = near.withColumn("run", run + F.col("_before")).where(F.col("run") <= remaining).withColumn("_pack", F.lit(0))
    pack, left, kept = W.partitionBy("_pack", *(keys or [])), F.lit(remaining), F.lit(False)  # three budgets of rows at most
    for s in range(3):  # what a section takes is the largest running sum that fits
        fits = (F.col("section") == s) & (F.col("run") <= F.col("_left"))
        out = out.withColumn("_left", left)
        out = out.withColumn("_took", F.max(F.when(fits, F.col("run"))).over(pack)).withColumn("_kept", kept | fits)
        left, kept = F.col("_left") - F.coalesce("_took", F.lit(0)), F.col("_kept")
    return out.where("_kept").select(*parts.columns, "cost")


def baseline_block(findings: DataFrame | None) -> str:
    """The findings that the model must not repeat, ranked; it is shown whole, whatever its length."""
    if findings is None:
        return BASELINE + "(none)\n"
    from mergelens.operators.findings import rank

    rows = [f"- [{r.severity}] {r.file}:{r.line_start} {r.message}\n" for r in rank(findings).select("severity", "file", "line_start", "message").collect()]
    return BASELINE + ("".join(rows) or "(none)\n")


def pack_context(added: DataFrame, related: DataFrame | None, baseline: str, budget: int) -> str:
    """The text of a context pack: the baseline, then what fits of the diff and of the related code, then a note if
    anything was cut. Only what fits comes to the driver."""
    parts = chunks(added, related)
    shown = fit(parts, budget - (len(baseline.encode()) + 3) // 4).orderBy("section", "ord").select("chunk").collect()
    return baseline + "".join(r.chunk for r in shown) + NOTE * (len(shown) < parts.count())


def window_bounds(start: Column, end: Column, radius: Column, total: Column) -> tuple[Column, Column]:
    """First and last line around a location, clamped to the file; past its end, the last radius + 1 lines."""
    radius = F.when(radius <= 0, RADIUS).otherwise(radius)
    start = F.when(start <= 0, 1).otherwise(start)
    end = F.when(end < start, start).otherwise(end)
    first, last = F.greatest(start - radius, F.lit(1)), F.least(end + radius, total)
    gone = first > total
    return F.when(gone, F.greatest(total - radius, F.lit(1))).otherwise(first), F.when(gone, total).otherwise(last)


def code_window(spark: SparkSession, repo: str, file: str, line_start: int, line_end: int, radius: int = 0) -> DataFrame:
    """number, text, hit: the lines of a file of a working tree around a place; ``hit`` marks those of the place itself.
    Raises ValueError for a path that is empty or leads out of the repository, OSError for one that can't be read."""
    path = os.path.normpath(file or "..")
    if not repo or os.path.isabs(path) or path.split(os.sep)[0] == os.pardir:
        raise ValueError(f"no file of the repository: {file!r}")
    with open(os.path.join(repo, path), encoding="utf-8", errors="replace", newline="") as f:
        text = f.read()
    first, last = max(line_start, 1), max(line_end, line_start, 1)
    df = spark.createDataFrame([(path, text, line_start, line_end, radius)], "path string, text string, line_start int, line_end int, radius int")
    return file_window(df).select("number", "text", F.col("number").between(first, last).alias("hit")).orderBy("number")


def file_window(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, number, text: for rows with line_start, line_end and radius the lines around, cut out of the file's array of
    lines before it explodes."""
    df = files.withColumn("_l", lines_of(F.col(text_col)))
    first, last = window_bounds(F.col("line_start"), F.col("line_end"), F.col("radius"), F.size("_l"))
    df = df.withColumns({"_first": first, "_last": last})
    df = df.withColumn("_w", F.slice("_l", F.col("_first").cast("int"), (F.col("_last") - F.col("_first") + 1).cast("int")))
    return df.select(F.col(path_col).alias("path"), "_first", F.posexplode("_w").alias("_i", "text")).select("path", (F.col("_first") + F.col("_i")).cast("int").alias("number"), "text")
