"""Rules by the thousand: which rules a path is in the scope of, and which a line can match, before any pattern is tried.

Of each pattern the literals are found of which every match has one. All of them are searched for in one pass over a line,
by an automaton, and only the rules whose literal is there, and whose scope holds the path, go on to their pattern. Scopes are
a trie of path segments, walked once a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from re import _constants as op
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa

from mergelens.functions.paths import glob_regex

#: A literal of fewer letters is found in too many lines to be of use.
SHORT = 2
#: Paths whose rules, and texts whose literals, a task remembers.
HELD = 1 << 16


def literals(pattern: str) -> frozenset[str] | None:
    """Strings, A-Z lower-cased, of which one at least is in whatever the pattern matches (lower-cased too); None if there
    are none of use. Of the sets that the pattern offers it is the one whose shortest string is longest."""
    plain = re.sub(r"\(\?<(?![=!])", "(?P<", re.sub(r"\\[pP]\{\w+\}", r"\\w", pattern)).replace("\\z", "\\Z")
    try:
        tree = _parser.parse(plain)
    except (re.error, OverflowError):
        return None
    if tree.state.flags & re.X:
        return None
    found = _required(tree, bool(tree.state.flags & re.I))
    return found if found and min(map(len, found)) >= SHORT else None


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    worth = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
    return a if worth(a) >= worth(b) else b


def _required(items: Iterable, fold: bool) -> frozenset[str] | None:
    best, run = None, ""
    for kind, value in [*items, (None, None)]:
        if kind is op.LITERAL and not (fold and value > 127):
            run += chr(value + 32 if 65 <= value <= 90 else value)
            continue
        if kind is op.AT:  # has no width
            continue
        best, run = _better(best, frozenset([run]) if run else None), ""
        if kind is op.SUBPATTERN and not value[1] & re.X:
            best = _better(best, _required(value[3], (fold or bool(value[1] & re.I)) and not value[2] & re.I))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            best = _better(best, _required(value[2], fold))
        elif kind is op.BRANCH:
            ways = [_required(w, fold) for w in value[1]]
            best = _better(best, frozenset().union(*ways) if all(ways) else None)
    return best


class Scopes:
    """The rules whose scope holds a path: each rule has globs, or none and holds all paths."""

    def __init__(self, globs: Sequence[Sequence[str]]):
        self.everywhere = frozenset(k for k, gs in enumerate(globs) if not gs)
        self.nodes: list[dict] = []
        self.sets: dict[frozenset[int], frozenset[int]] = {}
        self.folders: dict[str, set[int]] = {}
        self.odd: list[tuple[re.Pattern, int]] = []  # ``**`` within a name: the whole pattern
        self.all = [(re.compile(glob_regex(g)), k) for k, gs in enumerate(globs) for g in gs]
        self.root = self._node()
        for k, gs in enumerate(globs):
            for g in gs:
                self._add(g, k)

    def _node(self, loop: bool = False) -> int:
        self.nodes.append({"names": {}, "wild": {}, "deep": None, "loop": loop, "rules": set()})
        return len(self.nodes) - 1

    def _add(self, glob: str, rule: int) -> None:
        parts = glob.split("/")
        if any("**" in p and p != "**" for p in parts):
            self.odd.append((re.compile(glob_regex(glob)), rule))
            return
        at = self.root
        for i, p in enumerate(parts):
            node = self.nodes[at]
            if p == "**" and i + 1 < len(parts):  # any folders or none
                if not node["loop"]:
                    if node["deep"] is None:
                        node["deep"] = self._node(True)
                    at = node["deep"]
            elif p == "**":  # one segment or more
                at = node["wild"].setdefault("**", None) or self._below(node)
            elif "*" in p or "?" in p:
                at = node["wild"].setdefault(glob_regex(p), None) or self._put(node["wild"], glob_regex(p))
            else:
                at = node["names"].get(p) or self._put(node["names"], p)
        self.nodes[at]["rules"].add(rule)

    def _put(self, where: dict, key: str) -> int:
        where[key] = self._node()
        return where[key]

    def _below(self, node: dict) -> int:
        node["wild"]["**"] = self._node(True)
        return node["wild"]["**"]

    def _below_folder(self, folder: str) -> set[int]:
        """The states below a folder (its path with the last slash), remembered: many files have one folder."""
        got = self.folders.get(folder)
        if got is None:
            if len(self.folders) >= HELD:
                self.folders.clear()
            got = self._enter({self.root})
            for part in folder.split("/")[:-1]:
                got = self._step(got, part)
            self.folders[folder] = got
        return got

    def _step(self, states: set[int], part: str) -> set[int]:
        after = set()
        for s in states:
            node = self.nodes[s]
            if node["loop"]:
                after.add(s)
            if part in node["names"]:
                after.add(node["names"][part])
            for rx, to in node["wild"].items():
                if rx == "**" or _pattern(rx).search(part):
                    after.add(to)
        return self._enter(after)

    def of(self, path: str) -> frozenset[int]:
        """The rules with a scope that holds ``path``; those without one are not among them."""
        if "\n" in path:  # which ends no segment, but a pattern's any-character
            return frozenset(k for rx, k in self.all if rx.search(path))
        cut = path.rfind("/") + 1
        states = self._step(self._below_folder(path[:cut]), path[cut:])
        ends = frozenset(s for s in states if self.nodes[s]["rules"])
        out = self.sets.get(ends)
        if out is None:  # many paths end alike, so their rules are one set
            out = self.sets[ends] = frozenset(k for s in ends for k in self.nodes[s]["rules"])
        odd = [k for rx, k in self.odd if rx.search(path)]
        return out.union(odd) if odd else out

    def _enter(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            deep = self.nodes[todo.pop()]["deep"]
            if deep is not None and deep not in states:
                states.add(deep)
                todo.append(deep)
        return states


@lru_cache(maxsize=1 << 16)
def _pattern(regex: str) -> re.Pattern:
    return re.compile(regex)


class Finder:
    """Candidates among rules given as (globs, literals or None); made once in each worker."""

    def __init__(self, rules: Sequence[tuple[Sequence[str], frozenset[str] | None]]):
        self.scopes = Scopes([globs for globs, _ in rules])
        self.always = frozenset(k for k, (_, words) in enumerate(rules) if words is None)
        holders: dict[str, list[int]] = {}
        for k, (_, words) in enumerate(rules):
            for w in words or ():
                holders.setdefault(w, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for w, ks in holders.items():
            self.automaton.add_word(w, tuple(ks))
        if holders:
            self.automaton.make_automaton()
        self.empty = not holders
        self.held: dict[str, frozenset[int]] = {}
        self.seen: dict[str, tuple[int, ...]] = {}

    def holders(self, text: str) -> tuple[int, ...]:
        """The rules of which the text has a literal, in order; a text that comes again is not searched again."""
        got = self.seen.get(text)
        if got is None:
            if len(self.seen) >= HELD:
                self.seen.clear()
            low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            got = self.seen[text] = tuple(sorted({k for _, ks in self.automaton.iter(low) for k in ks}))
        return got

    def scope(self, path: str) -> frozenset[int]:
        got = self.held.get(path)
        if got is None:
            if len(self.held) >= HELD:
                self.held.clear()
            got = self.held[path] = self.scopes.of(path)
        return got

    def candidates(self, path: str, text: str) -> list[int]:
        """Rules that hold the path and may match the text, in order."""
        here, everywhere = self.scope(path), self.scopes.everywhere
        found = [] if self.empty else [k for k in self.holders(text) if k in here or k in everywhere]
        return sorted({*found, *(k for k in self.always if k in here or k in everywhere)}) if self.always else found


_FINDERS: dict[str, Finder] = {}


def finder(key: str, rules: Sequence[tuple[Sequence[str], frozenset[str] | None]]) -> Finder:
    if key not in _FINDERS:
        _FINDERS.clear()  # a worker serves one set of rules at a time
        _FINDERS[key] = Finder(rules)
    return _FINDERS[key]


def candidate_rows(key: str, rules: Sequence[tuple[Sequence[str], frozenset[str] | None]]):
    """For ``mapInArrow``: rows (path, text, ..) with each rule ``k`` that is to be tried on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(key, rules)
        for b in batches:
            rows, ks = [], []
            for i, (path, text) in enumerate(zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True)):
                if path is not None and text is not None:
                    got = find.candidates(path, text)
                    ks += got
                    rows += [i] * len(got)
            # rows of one rule stand together: the engine compiles a pattern again only where it changes
            ks = np.array(ks, np.int32)
            order = np.argsort(ks, kind="stable")
            taken = b.take(pa.array(np.array(rows, np.int64)[order]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ks[order])], [*b.schema.names, "k"])

    return run
