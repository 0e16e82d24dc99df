"""Rule documents and their evaluation over added lines."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from mergelens.functions.paths import glob_regex, in_scope
from mergelens.functions.rx import PatternError, compile_pattern
from mergelens.functions.text import quoted
from mergelens.operators.findings import finding
from mergelens.operators.ruleset import candidate_rows, literals
from mergelens.schemas import RULES, SEVERITIES


class RuleError(ValueError):
    """A rule document that can't be used."""


@dataclass(frozen=True)
class Rule:
    name: str
    paths: tuple[str, ...] = ()
    severity: str = "warning"
    pattern: str = ""  # none: for the model stage alone
    message: str = ""
    source: str = ""
    regex: str = field(default="", compare=False)
    path_res: tuple[str, ...] = field(default=(), compare=False)

    @property
    def model_assisted(self) -> bool:
        return not self.pattern


# Name, scope, severity and pattern of the built-in rules.
DEFAULTS = [
    ("merge-conflict-markers", [], "error", r"^(<<<<<<<|>>>>>>>|=======)$", "A merge conflict was left unresolved here: keep one side and delete the markers."),
    ("trailing-whitespace", [], "info", r"[ \t]+$", "The line ends in blanks, which only add noise to diffs."),
    ("debug-print-in-go", ["**/*.go"], "warning", r"fmt\.(Println|Printf|Print)\(|log\.Println\(", "A debugging print was left in: log it properly or drop it."),
    ("debug-print-in-js", ["**/*.js", "**/*.ts", "**/*.tsx", "**/*.jsx", "**/*.vue"], "warning", r"console\.(log|debug)\(", "A console call was left in: log it properly or drop it."),
]


def make_rule(name: str, paths: Sequence[str] = (), severity: str = "", pattern: str = "", message: str = "", source: str = "") -> Rule:
    """Checks and compiles a rule. Raises RuleError."""
    if not name:
        raise RuleError(f"{source}: a rule needs a name")
    severity = severity or "warning"
    if severity not in SEVERITIES:
        raise RuleError(f"{source}: no such severity: {severity!r}")
    try:
        regex = compile_pattern(pattern.strip()) if pattern.strip() else ""
    except PatternError as e:
        raise RuleError(f"{source}: {e}") from e
    return Rule(name, tuple(paths), severity, pattern.strip(), message.strip(), source, regex, tuple("(?d)" + glob_regex(p) for p in paths))


def split_documents(text: str) -> list[str]:
    """Documents of a text: each begins with a ``---`` line, has its front matter up to the next and its body up to the
    one after."""
    out, fences = [], 0
    for line in text.splitlines(keepends=True):
        if line.rstrip("\r\n") == "---":
            fences += 1
            if fences % 2:
                out.append("")
        if out:
            out[-1] += line
        elif line.strip():
            out.append(line)
    return out


def parse_rule(text: str, source: str) -> Rule:
    """A rule of YAML front matter between ``---`` lines and a body that is its message."""
    lines = text.split("\n")
    if lines[0].rstrip("\r") != "---":
        raise RuleError(f"{source}: the document doesn't begin with ---")
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip("\r") == "---"), None)
    if end is None:
        raise RuleError(f"{source}: the front matter has no end")
    try:
        meta = yaml.safe_load("\n".join(lines[1:end])) or {}
    except yaml.YAMLError as e:
        raise RuleError(f"{source}: {e}") from e
    if not isinstance(meta, dict):
        raise RuleError(f"{source}: the front matter is no mapping")
    paths = meta.get("paths") or []
    return make_rule(str(meta.get("name") or ""), [str(p) for p in paths], str(meta.get("severity") or ""), str(meta.get("pattern") or ""), "\n".join(lines[end + 1 :]), source)


def parse_rules(text: str, source: str) -> list[Rule]:
    """All rules of a text of several documents; one bad document spoils all."""
    return [parse_rule(d, f"{source}#{k}") for k, d in enumerate(split_documents(text), 1) if d.strip()]


def default_rules() -> list[Rule]:
    return [make_rule(n, p, s, x, m, "default") for n, p, s, x, m in DEFAULTS]


def load_rules(candidates: Sequence[str], include: Sequence[str] = ()) -> tuple[list[Rule], list[str]]:
    """Built-in rules, then for each included name those of the first candidate folder that has a readable, valid file.
    Missing and bad files are warnings."""
    import os

    rules, warnings = default_rules(), []
    for name in include:
        tried = []
        for folder in candidates:
            try:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    rules += parse_rules(f.read(), name)
                break
            except (OSError, RuleError) as e:
                tried.append(str(e))
        else:
            warnings.append(f"rules {name} not loaded: {'; '.join(tried) or 'no folder to look in'}")
    return rules, warnings


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.name, list(r.paths), list(r.path_res), r.severity, r.pattern, r.message, r.source, k) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULES)


#: Up to so many rules each line is held against every pattern; beyond it, against those whose literals it has.
MANY = 32


def evaluate(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of the rules that have a pattern, one for each line and rule that match: columns of findings, arriving by
    file, rule and line. A null path or text matches nothing.

    Rules are known on the driver. A few are literal patterns of one expression, see ``_by_pattern``; of ``MANY`` and more
    those with a literal are found by it, see ``_by_literal``.
    """
    numbered = [(k, r) for k, r in enumerate(rules) if not r.model_assisted]
    if len(numbered) <= MANY:
        return _by_pattern(lines, numbered)
    words = {k: literals(r.pattern) for k, r in numbered}
    plain = [(k, r) for k, r in numbered if words[k] is None]
    if len(plain) > MANY:  # too many for one expression: tried on every line in their scope
        plain = []
    taken = {k for k, _ in plain}
    found = _by_literal(lines, [(k, r, words[k]) for k, r in numbered if k not in taken])
    return found.unionByName(_by_pattern(lines, plain)) if plain else found


def _by_pattern(lines: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """Each pattern is a literal that is compiled once. A line is read once: it makes an array of the rules that match,
    which is empty for nearly all lines and explodes to the findings."""
    hits = []
    for k, r in rules:
        scope = in_scope(F.col("path"), F.array(*[F.lit(p) for p in r.path_res]).cast("array<string>")) if len(r.path_res) != 1 else F.col("path").rlike(r.path_res[0])
        fits = F.col("text").rlike(r.regex) if not r.path_res else scope & F.col("text").rlike(r.regex)
        hits.append(F.when(fits, F.struct(F.lit(k).alias("k"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"), F.lit(r.pattern).alias("pattern"), F.lit(r.message).alias("message"))))
    kind = "array<struct<k:int,name:string,severity:string,pattern:string,message:string>>"
    found = F.array_compact(F.array(*hits)).cast(kind) if hits else F.expr(f"cast(array() as {kind})")
    return _findings(lines.where("path is not null").select("path", "number", "text", "line_ord", F.explode(found).alias("m")))


def _by_literal(lines: DataFrame, rules: Sequence[tuple[int, Rule, frozenset[str] | None]]) -> DataFrame:
    """One pass over each line finds the rules whose literals it has, among those that hold its file; their patterns are then
    tried where all others are, by the engine. The rules travel with the task and as a broadcast list of the driver's own."""
    given = [(r.paths, words) for _, r, words in rules]
    key = hashlib.sha256(repr([(p, sorted(w or ())) for p, w in given]).encode()).hexdigest()
    rows = lines.select("path", "number", "text", "line_ord")
    tried = rows.mapInArrow(candidate_rows(key, given), StructType([*rows.schema.fields, StructField("k", IntegerType())]))
    listed = [(i, k, r.name, r.severity, r.pattern, r.message, r.regex) for i, (k, r, _) in enumerate(rules)]
    known = lines.sparkSession.createDataFrame(listed, "k int, own int, name string, severity string, pattern string, message string, regex string")
    hit = tried.join(F.broadcast(known), "k").where(F.rlike(F.col("text"), F.col("regex")))
    return _findings(hit.select("path", "number", "text", "line_ord", F.struct(F.col("own").alias("k"), "name", "severity", "pattern", "message").alias("m")))


def _findings(hit: DataFrame) -> DataFrame:
    reason = F.concat(F.lit("rule "), quoted(F.col("m.name")), F.lit(" matched pattern "), quoted(F.col("m.pattern")))
    return hit.select(
        *finding(
            rule_id=F.col("m.name"), category=F.lit("rule"), severity=F.col("m.severity"), source=F.lit("rule"), file=F.col("path"), line_start=F.col("number"),
            line_end=F.col("number"), message=F.col("m.message"), reasoning=reason, evidence=F.array("text"), seq=F.array(F.col("m.k").cast("long"), F.col("line_ord").cast("long")),
        )
    )
