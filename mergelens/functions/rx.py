"""Patterns of the linear-time dialect (no look-around, no back-references), compiled for Java's engine."""

from __future__ import annotations

import re

_REJECTED = [
    (re.compile(r"(?<!\\)(?:\\\\)*\(\?(?:=|!|<=|<!|>)"), "look-around and atomic groups"),
    (re.compile(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)"), "back-references"),
    (re.compile(r"(?<!\\)(?:\\\\)*[*+?}]\+"), "possessive quantifiers"),
]


class PatternError(ValueError):
    """A pattern that the dialect doesn't have."""


def compile_pattern(pattern: str) -> str:
    """The pattern for ``rlike``: line ends are line feeds alone, named groups in Java's spelling, classes as the dialect
    has them. Raises PatternError for what the dialect rejects."""
    bare = re.sub(r"\[(?:\\.|[^\]\\])*\]", "[]", pattern)
    for rx, what in _REJECTED:
        if rx.search(bare):
            raise PatternError(f"{what} are not supported: {pattern!r}")
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\s", r"\1[\\t\\n\\f\\r ]", out) if "[" not in pattern else out
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\z", r"\1\\z", out)
    try:
        re.compile(re.sub(r"\\z", r"\\Z", re.sub(r"\(\?<(?![=!])", "(?P<", re.sub(r"\\p\{\w+\}", "x", out))))
    except re.error as e:
        raise PatternError(f"bad pattern {pattern!r}: {e}") from e
    return "(?d)" + out
