"""Rules by the thousand against each rule on each line."""

import random
import re

import pyarrow as pa
import pytest

from mergelens.functions.paths import glob_regex
from mergelens.operators import rules, ruleset
from mergelens.operators.ruleset import Scopes, literals
from mergelens.plans import queries

WORDS = ["alpha", "Beta", "gamma(", "x.y", "==>", "öl", "Kern", "ab", "q"]


def test_literals_are_in_every_match():
    for pattern, want in {
        r"^(<<<|>>>>)$": {"<<<", ">>>>"}, r"[ \t]+$": None, r"lo?g\.debug": {"g.debug"}, r"(?i)API[_-]KEY": {"api"}, r"(?i)straße": {"stra"}, r"a+b": None, r"(ab|c)": None,
        r"(?P<who>hello)\s+\w": {"hello"}, r"(xyz){2,3}q?": {"xyz"}, r"(xyz)*q": None, r"\p{L}+Abc\z": {"abc"}, r"\bfoo\.bar\b": {"foo.bar"}, r"a[bc]de": {"de"}, r"(?i:Ab)Cd": {"ab"},
        r"(?x) abc": None, "": None,
    }.items():
        got = literals(pattern)
        assert (got and set(got)) == want, pattern


def glob(rng):
    part = lambda: rng.choice(["a", "b", "src", "*", "*.go", "a?", "**", "x*y", "**.md", ""])
    return "/".join(part() for _ in range(rng.randint(1, 4)))


def test_scopes_are_those_of_the_regular_expressions():
    rng = random.Random(8)
    globs = [[glob(rng) for _ in range(rng.randint(0, 3))] for _ in range(400)]
    scopes = Scopes(globs)
    paths = ["/".join(rng.choice(["a", "b", "ab", "src", "m.go", "xzy", "r.md", "", "a\nb"]) for _ in range(rng.randint(1, 5))) for _ in range(600)]
    held = 0
    for p in paths:
        want = {k for k, gs in enumerate(globs) if any(re.search(glob_regex(g), p) for g in gs)}
        assert scopes.of(p) == want, p
        held += len(want)
    assert held > 2000 and scopes.everywhere == {k for k, gs in enumerate(globs) if not gs}


def made(rng, n):
    out = []
    for k in range(n):
        a, b = rng.choice(WORDS), f"n{rng.randrange(3 * n)}"
        pattern = rng.choice([rf"{re.escape(a)} {b}\b", rf"(?i){b} {re.escape(a)}", rf"({re.escape(a)}|{b}x) {b}$", rf"^{b}\s", rf"[0-9]+{b}[xy]", b])
        out.append(rules.make_rule(f"r{k}", [glob(rng) for _ in range(rng.choice([0, 0, 1, 2]))], rng.choice(["info", "error"]), pattern))
    return out


def text(rng, n):
    return " ".join(rng.choice([rng.choice(WORDS), f"n{rng.randrange(3 * n)}", f"N{rng.randrange(3 * n)}", f"7n{rng.randrange(3 * n)}x"]) for _ in range(rng.randint(0, 8)))


@pytest.mark.parametrize(("n", "blank"), [(5000, 3), (60, 45), (33, 0)])
def test_many_rules_find_what_each_finds(spark, n, blank):
    rng = random.Random(n)
    given = made(rng, n - blank) + [rules.make_rule(f"blank{k}", ["**/*.go"] * (k % 2), "info", rf"[ \t]{{{k + 1},}}$") for k in range(blank)]
    given.insert(5, rules.make_rule("said", message="for the model alone"))
    rows = [("/".join(rng.choice(["a", "b", "src", "m.go", "ab"]) for _ in range(rng.randint(1, 3))), i, text(rng, n) + " " * rng.choice([0, 0, 2, 50]), i) for i in range(400)]
    rows += [(None, 1, "alpha n1", 1), ("a", 2, None, 2)]
    lines = spark.createDataFrame(rows, "path string, number int, text string, line_ord int").repartition(3)
    want = []
    for p, i, t, _ in rows:
        for k, r in enumerate(given):
            if p is not None and t is not None and r.pattern and (not r.paths or any(re.search(glob_regex(g), p) for g in r.paths)) and re.search(r.pattern, t):
                want.append((p, i, r.name, r.severity, [k, i]))
    got = [(r.file, r.line_start, r.rule_id, r.severity, r.seq) for r in rules.evaluate(lines, given).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5
    few = rules._by_pattern(lines, list(enumerate(given[:20])))  # both ways give the same columns
    assert few.schema.simpleString() == rules.evaluate(lines, given).schema.simpleString()


def test_catalogue_reads_lines_once(spark):
    plan = queries.rule_catalogue(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_what_comes_again_is_not_worked_out_again(monkeypatch):
    """Texts are searched once, folders walked once however many files they have, and rows of a rule stand together."""
    find = ruleset.Finder([(["a/b/*.txt"], frozenset(["some"])), (["**/c/**"], frozenset(["thing"])), ([], None)])
    steps, real = [], ruleset.Scopes._step
    monkeypatch.setattr(ruleset.Scopes, "_step", lambda self, states, part: (steps.append(part), real(self, states, part))[1])
    got = [find.candidates(f"a/b/{k}.txt", "something") for k in range(50)] + [find.candidates(f"a/c/{k}", "something") for k in range(50)]
    assert got == [[0, 2]] * 50 + [[1, 2]] * 50
    assert len(steps) == 100 + 4 and len(find.seen) == 1
    batch = pa.RecordBatch.from_pydict({"path": ["a/b/x.txt", "c/y"] * 3, "text": ["something"] * 6})
    out = next(ruleset.candidate_rows("again", [(["a/b/*.txt"], frozenset(["some"])), (["**/c/**"], frozenset(["thing"])), ([], None)])(iter([batch])))
    assert out.column("k").to_pylist() == [0] * 3 + [1] * 3 + [2] * 6 and out.column("path").to_pylist()[:6] == ["a/b/x.txt"] * 3 + ["c/y"] * 3
