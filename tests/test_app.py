import io
import json
import subprocess
import sys
import urllib.error

import pytest

from mergelens.operators import agent, context
from mergelens.operators.detect import run_detectors
from mergelens.operators.detect import register as register_detector
from mergelens.plans.app import App, settings
from mergelens.sources import lint, models
from mergelens.sources.config import ConfigError


class Reply(io.BytesIO):
    def __init__(self, status, doc):
        super().__init__(doc if isinstance(doc, bytes) else json.dumps(doc).encode())
        self.status = status


def endpoint(reply, log=None):
    def opener(request, timeout):
        if log is not None:
            log.append((request.full_url, dict(request.header_items()), request.data and json.loads(request.data)))
        if isinstance(reply, Exception):
            raise reply
        if reply.status >= 400:
            raise urllib.error.HTTPError(request.full_url, reply.status, "no", {}, reply)
        return reply

    return models.ChatEndpoint("http://host:1/", "m1", "k3y", opener)


def test_completion_over_http():
    log = []
    reply = Reply(200, {"choices": [{"message": {"content": "fine"}}], "usage": {"total_tokens": 9, "note": "x"}})
    got = endpoint(reply, log).complete(models.Request("look", "be brief", max_tokens=5))
    assert got == models.Answer("fine", "m1", {"total_tokens": 9})
    url, headers, body = log[0]
    assert url == "http://host:1/v1/chat/completions" and headers["Authorization"] == "Bearer k3y"
    assert body == {"model": "m1", "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "look"}], "max_tokens": 5}


@pytest.mark.parametrize("reply", [Reply(404, b"gone"), Reply(500, b""), Reply(200, b"words"), Reply(200, {"choices": []}), Reply(200, {"choices": [{"message": {"content": ""}}]}), Reply(200, [])])
def test_answers_that_are_none(reply):
    with pytest.raises(models.ModelError):
        endpoint(reply).complete(models.Request("p"))


def test_an_answer_is_read_up_to_a_bound():
    long = b'{"choices": [{"message": {"content": "' + b"a" * models.ANSWER_BYTES + b'"}}]}'
    with pytest.raises(models.ModelError):
        endpoint(Reply(200, long)).complete(models.Request("p"))


def test_which_endpoints_are_up():
    """An endpoint is up where it answers below 500, whatever it says; not where nothing answers."""
    for status in (*range(200, 500, 23), 499):
        assert endpoint(Reply(status, b"?")).available()
    for reply in (Reply(500, {"ok": True}), Reply(511, b""), Reply(599, b""), TimeoutError("slow"), ConnectionResetError("cut")):
        assert not endpoint(reply).available()


def test_providers_by_name(tmp_path, monkeypatch, spark):
    log = []

    def opener(request, timeout):
        log.append((request.full_url, request.get_header("Authorization")))
        return Reply(200, {"choices": [{"message": {"content": "[]"}}]})

    monkeypatch.setenv("SOME_KEY", "abc")
    near = [models.provider({"name": n, "model": "m", "api_key_env": "SOME_KEY"}, opener=opener) for n in (" Ollama", "llama.cpp")]
    far = models.provider({"name": "remote", "model": "m", "base_url": "https://far.example", "api_key_env": "SOME_KEY"}, opener=opener)
    assert [p.local for p in (*near, far)] == [True, True, False]
    assert agent.route([far, *near], "s", "p", False) == ("ollama", "[]") and far.complete("s", "p") == "[]"
    assert log[-1] == ("https://far.example/v1/chat/completions", "Bearer abc") and {a for _, a in log[:-1]} == {None}
    with pytest.raises(ConfigError):
        models.provider({"name": "oracle", "model": "m"})
    recorded = tmp_path / "f.json"
    recorded.write_text(json.dumps([{"system": "s", "prompt": "p", "response": "one"}, {"system": "s", "response": "two"}]))
    p = models.provider({"name": "fixture", "model": "m"}, models.load_fixtures(str(recorded)))
    assert [p.complete("s", x) for x in ("p", "q")] == ["one", "two"] and p.local
    prompts = spark.createDataFrame([(1, "s", "p"), (2, "s", "q"), (3, "t", "p")], "id int, system string, prompt string")
    got = agent.lookup_fixtures(prompts, models.fixtures_frame(spark, str(recorded)))
    assert {r.id: r.response for r in got.collect()} == {1: "one", 2: "two", 3: None}
    recorded.write_text("{}")
    with pytest.raises(ValueError):
        models.load_fixtures(str(recorded))


LINTER = "import sys\nfolder = sys.argv[1]\nif 'bad' in folder:\n    sys.exit('no such module')\nif 'odd' in folder:\n    print(folder[2:] + '/x.go:3:1: shadowed', file=sys.stderr)\n    sys.exit(1)\n"


def test_lint_command(spark, tmp_path):
    tool = tmp_path / "tool.py"
    tool.write_text(LINTER)
    command = (sys.executable, str(tool))
    lines = lambda *paths: spark.createDataFrame([(p, 1, "t", 1) for p in paths], "path string, number int, text string, line_ord int")
    run = lint.lint_detector(str(tmp_path), command)
    got = run(lines("odd/x.go", "odd/y.go", "fine/z.go", "bad/readme.md")).collect()
    assert [(r.file, r.line_start, r.message, r.rule_id) for r in got] == [("odd/x.go", 3, "shadowed", "go-vet")]
    assert run(lines("a.txt")).count() == 0
    with pytest.raises(lint.LintError, match="no such module"):
        run(lines("bad/x.go", "odd/x.go"))
    with pytest.raises(lint.LintError, match="127"):
        lint.lint_detector(str(tmp_path), ("no-such-command-here",))(lines("odd/x.go"))
    register_detector("lint-test", run)
    _, ran, notes = run_detectors(lines("bad/x.go"), ["lint-test", "secrets"])
    assert ran == ["secrets"] and "lint-test failed" in notes[0]


def test_code_around_a_place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_text("".join(f"r{i}\n" for i in range(1, 8)))
    got = context.code_window(spark, str(tmp_path), "./in/f.txt", 4, 5, 1).collect()
    assert [tuple(r) for r in got] == [(3, "r3", False), (4, "r4", True), (5, "r5", True), (6, "r6", False)]
    for path in ("", "/etc/passwd", "../x", "in/../../x", ".."):
        with pytest.raises(ValueError):
            context.code_window(spark, str(tmp_path), path, 1, 1)
    with pytest.raises(OSError):
        context.code_window(spark, str(tmp_path), "in/none.txt", 1, 1)


def test_app_with_rules_of_the_repository(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    root = tmp_path / "work"
    (root / ".mergelens").mkdir(parents=True)
    subprocess.run(["git", "init", "-q"], cwd=root, check=True)
    (root / ".mergelens" / "config.yaml").write_text("mode: online\nrules:\n  include: [own.md, missing.md]\n")
    (root / ".mergelens" / "own.md").write_text("---\nname: no-todo\nseverity: error\npattern: TODO\n---\nWrite it now.\n")
    (root / "a.txt").write_text("TODO later\n")
    app = App(spark, str(tmp_path / "store"))
    got = app.review(str(root))
    assert [(f["rule_id"], f["file"], f["message"]) for f in got.golden()["findings"]].count(("no-todo", "a.txt", "Write it now.")) == 1
    assert any("missing.md" in w for w in got.warnings) and app.repo_mode(str(root)) == "online" and app.version()
    assert [r.repo_path for r in app.list_repos().collect()] == [str(root)]
    assert [r.id for r in app.list_reviews(str(root)).collect()] == [got.id]
    assert app.get_review(got.id)[1].where("rule_id = 'no-todo' and file = 'a.txt'").count() == 1
    assert app.review_context(str(root), "a.txt", 1, 1).head().hit
    (root / ".mergelens" / "config.yaml").write_text("providers:\n  - {name: oracle, model: m}\n")
    with pytest.raises(ConfigError):
        settings(str(root))
