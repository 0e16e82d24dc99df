"""Detectors: secrets on added lines, lint diagnostics, and the seam for others."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions.paths import dir_of
from mergelens.operators.findings import finding

#: name, severity, what stands before the secret, the secret, what follows it, what it is. The choice of patterns is this
#: engine's own.
SECRETS = [
    ("aws-access-key-id", "critical", r"\b", r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"\b", "AWS access key id"),
    ("aws-secret-key", "critical", r"(?i)aws[a-z_\-]*secret[a-z_\-]*[\"']?\s*[:=]\s*[\"']?", r"[A-Za-z0-9/+=]{40}", "", "AWS secret key"),
    ("github-token", "critical", r"\b", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})", "", "GitHub token"),
    ("private-key", "critical", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "", "private key"),
    ("slack-token", "error", r"\b", r"xox[abprs]-[A-Za-z0-9-]{10,}", "", "Slack token"),
    ("stripe-key", "critical", r"\b", r"[sr]k_live_[A-Za-z0-9]{16,}", "", "Stripe key"),
    ("generic-api-key", "error", r"(?i)(?:api[_-]?key|secret|token|passw(?:or)?d)[\"']?\s*[:=]\s*[\"']", r"[A-Za-z0-9_\-+/=.]{16,}", r"[\"']", "credential"),
]
#: Every secret's line holds one of these; they cost less to look for than the patterns.
SIGNS = ("=", ":", "AKIA", "ASIA", "gh", "PRIVATE KEY", "xox", "_live_")
LOCK_FILES = ("go.sum", "go.mod", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "composer.lock", "Gemfile.lock", "uv.lock")


def redact(text: Column) -> Column:
    """The text with every secret in it replaced."""
    for _, _, before, secret, after, _ in SECRETS:
        text = F.regexp_replace(text, f"(?d)({before}){secret}({after})", "$1[redacted]$2")
    return text


def detect_secrets(lines: DataFrame) -> DataFrame:
    """A finding for each added line that holds a secret, by the first pattern of ``SECRETS`` that matches; its evidence
    hides every secret of the line. Lock files are passed over."""
    base = F.regexp_replace("path", r"^.*/", "")
    kind: Column = F.lit(None)
    for k, (name, severity, *pattern, what) in reversed(list(enumerate(SECRETS))):
        kind = F.when(F.col("text").rlike("(?d)" + "".join(pattern)), F.struct(F.lit(k).alias("k"), F.lit(f"secret.{name}").alias("rule"), F.lit(severity).alias("severity"), F.lit(what).alias("what"))).otherwise(kind)
    may = reduce(Column.__or__, [F.col("text").contains(x) for x in SIGNS])
    hit = lines.where(may & ~base.isin(*LOCK_FILES)).withColumn("s", F.when(may, kind)).where("s is not null")
    return hit.select(
        *finding(
            rule_id=F.col("s.rule"), category=F.lit("secret"), severity=F.col("s.severity"), file=F.col("path"), line_start=F.col("number"), line_end=F.col("number"),
            message=F.concat(F.lit("This line seems to hold a "), F.col("s.what"), F.lit("; move it out of the code and revoke it.")),
            reasoning=F.concat(F.lit("matched "), F.col("s.rule")), evidence=F.array(redact(F.col("text"))), seq=F.array(F.col("s.k").cast("long"), F.col("line_ord").cast("long")),
        )
    )


def split_diagnostic(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``df`` with file, line, message of ``file:line:[col:] message``; other lines go. The column is dropped only where it
    is a number that ``: `` follows."""
    raw = F.col(raw_col)
    file = F.regexp_extract(raw, r"(?s)\A([^:]*):", 1)
    rest = F.regexp_extract(raw, r"(?s)\A[^:]*:(.*)\z", 1)
    line = F.regexp_extract(rest, r"(?s)\A([^:]*):", 1).try_cast("int")
    tail = F.regexp_extract(rest, r"(?s)\A[^:]*:(.*)\z", 1)
    message = F.trim(F.regexp_replace(tail, r"(?s)\A[0-9]+: ", ""))
    ok = raw.contains(":") & rest.contains(":") & line.isNotNull()
    return df.where(ok).withColumns({"file": file, "line": line, "message": message})


def lint_findings(diagnostics: DataFrame, repo_path: str = "", rule_id: str = "go-vet") -> DataFrame:
    """Findings of lint output lines (columns raw and ord), with paths relative to the repository."""
    file = F.col("file")
    if repo_path:
        prefix = repo_path.rstrip("/") + "/"
        file = F.when(file.startswith(prefix), F.substring(file, len(prefix) + 1, 2**31 - 1)).otherwise(file)
    file = F.regexp_replace(file, r"^\./", "")
    d = split_diagnostic(diagnostics).withColumn("file", file)
    return d.select(
        *finding(
            rule_id=F.lit(rule_id), category=F.lit("lint"), severity=F.lit("warning"), file=F.col("file"), line_start=F.col("line"), line_end=F.col("line"),
            message=F.col("message"), evidence=F.array("raw"), seq=F.array(F.col("ord").cast("long")),
        )
    )


def changed_dirs(lines: DataFrame, suffix: str = ".go") -> DataFrame:
    """Directories of the changed files of a language."""
    return lines.where(F.col("path").endswith(suffix)).select(dir_of(F.col("path")).alias("dir")).distinct()


#: A detector takes added lines and returns findings.
Detector = Callable[[DataFrame], DataFrame]
DETECTORS: dict[str, Detector] = {"secrets": detect_secrets}


def register(name: str, detector: Detector) -> None:
    DETECTORS[name] = detector


def run_detectors(lines: DataFrame, names: Sequence[str]) -> tuple[list[DataFrame], list[str], list[str]]:
    """Findings of each detector, the names of those that ran, and a note for each that failed."""
    found, ran, notes = [], [], []
    for name in names:
        try:
            got = DETECTORS[name](lines)
            got.schema  # noqa: B018  a plan that can't be made shows here
            found.append(got)
            ran.append(name)
        except Exception as e:  # a detector is foreign code: its failure is a note
            notes.append(f"analyzer {name} failed: {e}")
    return found, ran, notes
