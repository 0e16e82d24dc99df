"""Schemas and fixed values of the engine's relations."""

from __future__ import annotations

SEVERITIES = {"info": 1, "warning": 2, "error": 3, "critical": 4}
SOURCES = ("analyzer", "rule", "llm", "agent")
MODES = ("offline", "online", "agent")
STATUSES = ("added", "modified", "deleted", "renamed")
SYMBOL_KINDS = ("func", "method", "type", "struct", "interface", "const", "var")
TYPE_KINDS = ("type", "struct", "interface")
EDGE_KINDS = ("call", "use")

CHANGES = "path string, old_path string, status string, additions int, deletions int"
DIFFS = "path string, diff_text string"
ADDED_LINES = "path string, number int, text string, line_ord int"
FINDINGS = (
    "id string, rule_id string, category string, severity string, source string, file string, line_start int, line_end int, "
    "message string, reasoning string, evidence array<string>, confidence double, demoted boolean, seq array<long>"
)
REVIEWS = "id string, repo_path string, mode string, started_at timestamp, finished_at timestamp, findings_count int, attempt string"
STORED_FINDINGS = "review_id string, " + FINDINGS.replace(", seq array<long>", ", position int, attempt string")
RULES = "name string, paths array<string>, path_res array<string>, severity string, pattern string, message string, source string, ord int"
INDEX_FILES = "repo_path string, path string, language string, hash string, updated_at timestamp"
INDEX_SYMBOLS = "repo_path string, file_path string, name string, kind string, line int"
INDEX_REFS = "repo_path string, src_file string, src_name string, dst_file string, dst_name string, kind string"
INDEX_IMPORTS = "repo_path string, file_path string, import_path string"
CONTEXT_FILES = "path string, distance int, code string"
FIXTURES = "model string, system string, prompt string, response string, ord int"
SOURCE_FILES = "repo_path string, path string, language string, hash string, content binary"

#: Versions of the stored tables, applied in order and once; see plans.store.
MIGRATIONS = [
    (1, {"reviews": REVIEWS, "findings": STORED_FINDINGS}),
    (2, {"index_files": INDEX_FILES, "index_symbols": INDEX_SYMBOLS, "index_refs": INDEX_REFS, "index_imports": INDEX_IMPORTS}),
    (3, {"learnings": "id string, body string, source string, weight double, created_at timestamp"}),
]
