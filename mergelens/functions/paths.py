"""Path expressions: directory, lexical cleaning, safe joins, globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dir_of(path: Column) -> Column:
    """Directory of a relative path, empty for the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def clean_path(path: Column) -> Column:
    """Backslashes become slashes; ``.``, ``..`` and repeated slashes go, lexically; an empty path is ``.``."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))

    def step(acc: Column, x: Column) -> Column:
        back = F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).when(rooted, acc).otherwise(F.array_append(acc, x))
        return F.when(x == "..", F.when(F.size(acc) == 0, F.when(rooted, acc).otherwise(F.array_append(acc, x))).otherwise(back)).otherwise(F.array_append(acc, x))

    kept = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")
    joined = F.when(rooted, F.concat(F.lit("/"), kept)).otherwise(kept)
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def is_safe(path: Column) -> Column:
    """Whether a path stays inside the folder it is joined to: not empty, not absolute, not above it."""
    c = clean_path(path)
    return (path != "") & ~c.startswith("/") & (c != "..") & ~c.startswith("../")


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob: ``**/`` any folders or none, ``**`` anything, ``*`` and ``?`` within a name."""
    wild = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out, rest = ["^"], glob
    while rest:
        token = next((t for t in wild if rest.startswith(t)), rest[0])
        out.append(wild.get(token) or (token if token.isalnum() or token in "_/" or ord(token) > 127 else "\\" + token))
        rest = rest[len(token) :]
    return "".join(out) + "$"


def in_scope(path: Column, path_res: Column) -> Column:
    """Whether a path is in a rule's scope, an array of regular expressions; no scope holds all paths."""
    return (F.size(path_res) == 0) | F.exists(path_res, lambda r: F.rlike(path, r))
