"""Unified diffs and status lines as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions.text import lines_of


def synthetic_diff(text: Column) -> Column:
    """Diff that adds a whole file; empty for a text that can't be read (null)."""
    lines = lines_of(text)
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n")
    return F.when(text.isNull(), "").otherwise(F.concat(F.lit("@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"), body, F.lit("\n")))


def new_start(header: Column) -> Column:
    """First new-side line of a hunk header: its third field without ``+``, up to a comma; null if that is no number."""
    field = F.get(F.filter(F.split(header, r"\s+"), lambda x: x != ""), F.lit(2))
    return F.regexp_replace(field, r"^\+|,.*$", "").try_cast("int")


def _is(line: Column, kind: str) -> Column:
    """What a line of a diff is: ``head``, ``skip`` (a file header), ``add``, ``same`` or ``gone``."""
    header = line.startswith("+++") | line.startswith("---")
    return {
        "head": line.startswith("@@"),
        "skip": header,
        "add": line.startswith("+") & ~header,
        "same": line.startswith(" "),
        "gone": line.startswith("-") & ~header,
    }[kind]


def added_lines(diffs: DataFrame, path_col: str = "path", diff_col: str = "diff_text") -> DataFrame:
    """path, number, text, line_ord: added lines with their new-side numbers, of each diff for itself.

    A header sets the number, added and unchanged lines advance it; a line that looks like a file header (``+++``,
    ``---``) is passed over without advancing, also inside a hunk. Lines before any header count from 0. A diff is cut at
    its headers; of a hunk only the lines that advance are left, so their places in it are their numbers: no window and
    no shuffle, and a diff never leaves its row.
    """
    at = F.transform(F.split(F.col(diff_col), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    starts = F.filter(F.transform(F.filter("_at", lambda a: _is(a.x, "head")), lambda a: F.struct(a.i.alias("i"), new_start(a.x).alias("n"))), lambda h: h.n.isNotNull())
    heads = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("n"))), starts)
    end = lambda k: F.coalesce(F.get("_heads", k + 1).i, F.size("_at"))
    hunk = lambda h, k: F.struct(h.n.alias("n"), F.slice("_at", h.i + 2, end(k) - h.i - 1).alias("ls"))
    df = diffs.select(F.col(path_col).alias("path"), at.alias("_at")).withColumn("_heads", heads)
    df = df.select("path", F.explode(F.transform("_heads", hunk)).alias("h"))
    step = df.select("path", "h.n", F.posexplode(F.filter("h.ls", lambda a: _is(a.x, "add") | _is(a.x, "same"))).alias("k", "a"))
    return step.where(_is(F.col("a.x"), "add")).select("path", (F.col("n") + F.col("k")).cast("int").alias("number"), F.substring("a.x", 2, 2**31 - 1).alias("text"), F.col("a.i").alias("line_ord"))


def file_lines(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """The added lines of whole files, straight from their texts: what ``added_lines`` makes of ``synthetic_diff``, but
    with lines that begin with ``++`` kept out as it does, and without a window."""
    exploded = files.select(F.col(path_col).alias("path"), F.posexplode(lines_of(F.col(text_col))).alias("i", "text"))
    return exploded.select("path", (F.col("i") + 1).alias("number"), "text", (F.col("i") + 1).alias("line_ord"))


def diff_stat(diffs: DataFrame, path_col: str = "path", diff_col: str = "diff_text") -> DataFrame:
    """path, additions, deletions of each diff: counted within its row from the first ``@@`` line on, file headers left
    out."""
    lines = F.split(F.col(diff_col), "\n", -1)
    first = F.array_position(F.transform("_ls", lambda x: _is(x, "head")), True).cast("int")
    df = diffs.select(F.col(path_col).alias("path"), lines.alias("_ls")).withColumn("_in", F.when(first > 0, F.slice("_ls", first, F.size("_ls"))))
    n = lambda kind: F.greatest(F.size(F.filter("_in", lambda x: _is(x, kind))), F.lit(0)).cast("long")
    return df.select("path", F.coalesce(n("add"), F.lit(0)).alias("additions"), F.coalesce(n("gone"), F.lit(0)).alias("deletions"))


def parse_status(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``df`` with path, old_path, status, untracked of a porcelain status line; lines of under three characters go."""
    raw = F.col(raw_col)
    x, y, rest = F.substring(raw, 1, 1), F.substring(raw, 2, 1), F.trim(F.substring(raw, 4, 2**31 - 1))
    untracked = raw.startswith("??")
    status = (
        F.when(untracked | (x == "A") | (y == "A"), "added")
        .when((x == "D") | (y == "D"), "deleted")
        .when(x == "R", "renamed")
        .otherwise("modified")
    )
    pair = F.split(rest, " -> ", 2)
    moved = (status == "renamed") & (F.size(pair) == 2)
    path = F.when(untracked, F.trim(F.substring(raw, 3, 2**31 - 1))).when(moved, pair[1]).otherwise(rest)
    return df.where(F.length(raw) >= 3).withColumns({"path": path, "old_path": F.when(moved, pair[0]).otherwise(""), "status": status, "untracked": untracked})
