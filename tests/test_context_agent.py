import json

import pytest
from pyspark.sql import functions as F

from mergelens.functions.text import estimate_tokens, split_budget
from mergelens.operators import agent, context


def added(spark, rows):
    return spark.createDataFrame([(p, n, t, n) for p, n, t in rows], "path string, number int, text string, line_ord int")


def related(spark, rows):
    return spark.createDataFrame(rows, "path string, distance int, code string")


def greedy(baseline, lines, files, budget):
    """The pack, chunk by chunk."""
    est = lambda s: (len(s.encode()) + 3) // 4
    out, left, cut = baseline, budget - est(baseline), False
    sections = [["\n"], [context.DIFF], []]
    for p in sorted({p for p, _, _ in lines}):
        sections[1] += [f"--- {p}\n", *[f"+{n} {t}\n" for q, n, t in lines if q == p]]
    if files:
        sections[2] = [context.RELATED]
        for p, d, code in sorted(files, key=lambda f: (f[1], f[0])):
            sections[2] += [f"--- {p} (distance {d})\n", *[x + "\n" for x in code.removesuffix("\n").split("\n") if x]]
    for s in sections:
        for chunk in s:
            if left < est(chunk):
                cut = True
                break
            out, left = out + chunk, left - est(chunk)
    return out + context.NOTE * cut


@pytest.mark.parametrize("budget", [4096, 20, 40, 50, 60, 75, 90, 0, 5])
def test_pack_is_the_greedy_one(spark, budget):
    lines = [("b.go", 3, "x := 1"), ("a.go", 1, "y := 2 // é"), ("a.go", 2, "z" * 40)]
    files = [("far.go", 2, "package far\n\nfunc F() {}\n"), ("near.go", 1, "package near\n")]
    base = context.baseline_block(None)
    assert context.pack_context(added(spark, lines), related(spark, files), base, budget) == greedy(base, lines, files, budget)


def test_a_misfit_does_not_stop_the_next_section(spark):
    lines, files = [("a.go", 1, "w" * 400)], [("n.go", 1, "ok")]
    text = context.pack_context(added(spark, lines), related(spark, files), "", 60)
    assert "ok\n" in text and "w" * 400 not in text and text.endswith(context.NOTE)


def test_budget_and_estimates(spark):
    assert split_budget(12_000) == (9000, 3000) and split_budget(0) == (9000, 3000) and split_budget(100) == (75, 128)
    df = spark.createDataFrame([("",), ("abcd",), ("abcde",), ("éé",)], "s string")
    assert [r[0] for r in df.select(estimate_tokens(F.col("s"))).collect()] == [0, 1, 2, 1]


def test_windows_by_the_law(spark):
    """A window holds the lines within its radius of the place; where that is none, the file's last radius + 1 lines."""
    n = 9
    places = [(s, e, r) for s in (-1, 0, 1, 4, 9, 10, 13, 40) for e in (0, 3, 6, 11) for r in (-2, 0, 1, 2, 12)]
    text = "\n".join(f"l{i}" for i in range(1, n + 1)) + "\n"
    df = spark.createDataFrame([(f"{s}:{e}:{r}", text, s, e, r) for s, e, r in places], "path string, text string, line_start int, line_end int, radius int")
    got = {}
    for x in context.file_window(df).orderBy("path", "number").collect():
        assert x.text == f"l{x.number}"
        got.setdefault(x.path, []).append(x.number)
    for s, e, r in places:
        first, reach = (s if s > 0 else 1), (r if r > 0 else context.RADIUS)
        last = e if e >= first else first
        near = [i for i in range(1, n + 1) if first - reach <= i <= last + reach]
        assert got[f"{s}:{e}:{r}"] == (near or [i for i in range(1, n + 1) if i >= n - reach]), (s, e, r)


def test_answers(spark):
    full = {"file": "a.go", "line": 2, "line_end": 4, "severity": " ERROR", "category": "bug", "rule_id": "x", "message": "m", "reasoning": "r", "confidence": 0.9}
    doc = json.dumps([full, {"file": "a.go", "line": 3, "message": "m"}, {"line": 1, "message": "m"}, {"file": "a", "line": 1}])
    df = spark.createDataFrame([(0, doc), (1, "[]")], "ord int, answer string")
    got = agent.candidates(df).orderBy("seq").collect()
    assert [r.valid for r in got] == [True, True, False, False]
    assert (got[0].severity, got[0].line_end, got[0].category, got[0].confidence) == ("error", 4, "bug", 0.9)
    assert (got[1].rule_id, got[1].category, got[1].severity, got[1].line_end, got[1].confidence, got[1].source) == ("llm", "llm", "warning", 3, 0.5, "llm")
    assert agent.parse_answer("null") == [] and agent.parse_answer('[{"File": "a", "LINE": 1}]') == [{"file": "a", "line": 1}]
    for bad in ("words", "{}", '[{"line": "2"}]', '[{"line": 2.5}]', "[1]"):
        with pytest.raises(ValueError):
            agent.parse_answer(bad)


def test_verification(spark):
    cols = "file string, line_start int, severity string, confidence double, demoted boolean, message string"
    found = spark.createDataFrame([("a.go", 2, "error", 0.5, False, "x"), ("a.go", 99, "error", 0.5, False, "y"), ("b.go", 1, "error", 0.5, False, "z")], cols)
    lines = added(spark, [("a.go", 2, "t"), ("a.go", 2, "t")])
    got = {r.message: (r.severity, r.confidence, r.demoted) for r in agent.verify(found, lines).collect()}
    assert got == {"x": ("error", 0.6, False), "y": ("info", 0.2, True), "z": ("info", 0.2, True)}


def test_routing():
    answers = lambda text: lambda s, p: text

    def fails(s, p):
        raise RuntimeError("down")

    remote, local, broken = agent.Provider("r", "m", False, answers("remote")), agent.Provider("l", "m", True, answers("local")), agent.Provider("b", "m", True, fails)
    asleep = agent.Provider("s", "m", True, answers("asleep"), lambda: False)
    assert agent.route([remote, local], "", "", False) == ("l", "local")
    assert agent.route([broken, asleep, remote], "", "", False) == ("r", "remote")
    for providers, only in (([], False), ([remote], True), ([broken], False)):
        with pytest.raises(agent.NoProvider):
            agent.route(providers, "", "", only)


def test_fixtures(spark):
    p = agent.fixture_provider([("s", "p", "exact"), ("s", "", "any"), ("s", "q", "late")])
    assert [p.complete("s", x) for x in ("p", "q", "z")] == ["exact", "any", "any"]
    with pytest.raises(agent.NoProvider):
        p.complete("other", "p")
    prompts = spark.createDataFrame([(1, "s", "p"), (2, "s", "q"), (3, "o", "p")], "id int, system string, prompt string")
    fixtures = spark.createDataFrame([("s", "p", "exact", 0), ("s", "", "any", 1), ("s", "q", "late", 2)], "system string, prompt string, response string, ord int")
    assert {r.id: r.response for r in agent.lookup_fixtures(prompts, fixtures).collect()} == {1: "exact", 2: "any", 3: None}
