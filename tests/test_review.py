import json
import subprocess
from datetime import datetime

import pytest

from mergelens.operators import agent
from mergelens.plans.review import main, review
from mergelens.plans.store import Store
from mergelens.sources import git as g
from mergelens.sources.config import merge


def run(folder, *args):
    subprocess.run(["git", *args], cwd=folder, check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    run(root, "init", "-q")
    run(root, "config", "user.email", "a@example.org")
    run(root, "config", "user.name", "A Person")
    (root / "base.go").write_text("package demo\n\nfunc Base() {}\n")
    (root / "tide.go").write_text("package demo\n\nconst Ebb = 4\n")
    (root / "quay.go").write_text("package demo\n\nvar berths = [...]int{Ebb, 9}\n")
    (root / "README.md").write_text("one\n")
    run(root, "add", ".")
    run(root, "commit", "-qm", "first")
    return root


def test_working_tree(spark, repo):
    (repo / "README.md").write_text("one\ntwo\nthree\n")
    (repo / "new.txt").write_text("n\n")
    (repo / "base.go").unlink()
    run(repo, "mv", "tide.go", "moved.go")
    changes, diffs = g.working_diff(spark, str(repo))
    got = {r.path: (r.status, r.old_path, r.additions, r.deletions) for r in changes.collect()}
    assert got == {"README.md": ("modified", "", 2, 0), "new.txt": ("added", "", 1, 0), "base.go": ("deleted", "", 0, 3), "moved.go": ("renamed", "tide.go", 3, 0)}
    assert {r.path: r.diff_text for r in diffs.collect()}["new.txt"] == "@@ -0,0 +1,1 @@\n+n\n"
    assert g.blame(str(repo), "quay.go", 3)[1] == "A Person"


def test_not_a_repository(spark, tmp_path):
    assert not g.is_repo(str(tmp_path))
    with pytest.raises(g.NotARepository):
        g.working_diff(spark, str(tmp_path))
    got = review(spark, str(tmp_path))
    assert got.findings.count() == 0 and "without a diff" in got.degradations[0]
    with pytest.raises(ValueError):
        review(spark, str(tmp_path / "none"))


def test_clean_tree(spark, repo):
    got = review(spark, str(repo), detectors=())
    assert got.golden() == {"repo": str(repo), "mode": "offline", "analyzers_run": ["rules"], "findings": []}
    assert review(spark, str(repo), rules=[], detectors=()).analyzers_run == []


def test_findings_are_ranked_redacted_and_kept(spark, repo, tmp_path):
    (repo / "app.go").write_text('package demo\n\nimport "fmt"\n\nfunc M() {\n\tBase()\n\tfmt.Println("x")\n}\n')
    (repo / "secret.txt").write_text('aws_secret_access_key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"\n')
    store = Store(spark, str(tmp_path / "store"))
    got = review(spark, str(repo), store=store)
    found = [(f["rule_id"], f["file"], f["line_start"]) for f in got.golden()["findings"]]
    assert found == [("secret.aws-secret-key", "secret.txt", 1), ("debug-print-in-go", "app.go", 7)]
    assert "wJalrXUtnFEMI" not in got.to_json() and json.loads(got.to_json())["mode"] == "offline"
    head, rows = store.get_review(got.id)
    assert (head["findings_count"], [r.file for r in rows.collect()]) == (2, ["app.go", "secret.txt"])
    assert [r.repo_path for r in store.list_repos().collect()] == [str(repo)]
    with pytest.raises(KeyError):
        store.get_review("none")


def test_model_stage(spark, repo, tmp_path):
    (repo / "tide.go").write_text("package demo\n\nconst Ebb = 6\n")
    seen = []

    def answer(system, prompt):
        seen.append(prompt)
        return json.dumps([{"file": "tide.go", "line": 3, "severity": "error", "message": "changed"}, {"file": "tide.go", "line": 99, "severity": "error", "message": "nowhere"}, {"message": "no place"}])

    store = Store(spark, str(tmp_path / "store"))
    got = review(spark, str(repo), providers=[agent.Provider("p", "m", True, answer)], store=store)
    rows = {f["message"]: f for f in got.golden()["findings"]}
    assert (rows["changed"]["severity"], rows["changed"]["confidence"], rows["changed"]["demoted"]) == ("error", 0.6, False)
    assert (rows["nowhere"]["severity"], rows["nowhere"]["demoted"]) == ("info", True)
    assert "--- quay.go (distance 1)" in seen[0] and "+3 const Ebb = 6" in seen[0]
    assert got.degradations == ["model stage: 1 entries were no findings", "model stage: 1 findings are not on added lines"]
    assert got.analyzers_run == ["secrets", "rules", "llm:p"]
    remote = agent.Provider("far", "m", False, answer)
    skipped = review(spark, str(repo), merge([]), providers=[remote])
    assert skipped.findings.count() == 0 and "model stage skipped" in skipped.degradations[0]
    broken = review(spark, str(repo), providers=[agent.fixture_provider([(agent.SYSTEM, "", "words")])])
    assert "model stage skipped" in broken.degradations[0]


def test_history(spark, tmp_path):
    from mergelens.operators.findings import finding

    store = Store(spark, str(tmp_path / "s"))
    none = spark.range(1).select(*finding()).limit(0)
    for i, r, h, n in (("r1", "/a", 1, 1), ("r2", "/a", 3, 2), ("r3", "/b", 2, 0), ("r4", "/b", 2, 0)):
        at = datetime(2024, 1, 1, h, 0, 0, 123)
        rows = none if not n else spark.range(n).select(*finding(file=none_col("f")))
        store.save_review({"id": i, "repo_path": r, "mode": "offline", "started_at": at, "finished_at": at}, rows)
    got = [(r.repo_path, r.last_started.hour, r.last_id, r.last_findings, r.reviews) for r in store.list_repos().collect()]
    assert got == [("/a", 3, "r2", 2, 2), ("/b", 2, "r4", 0, 2)]
    assert [r.id for r in store.list_reviews("/a").collect()] == ["r2", "r1"] and [r.id for r in store.list_reviews("/b").collect()] == ["r4", "r3"]
    assert store.list_reviews("/none").count() == 0
    with pytest.raises(KeyError):
        store.get_review("r1", "/b")
    assert store.get_review("r1", "/a")[0]["id"] == "r1"


def test_pages_of_history(spark, tmp_path):
    """Pages by key are the whole list, whatever ties; a page's findings come from its own folders, and a review's from one."""
    from mergelens.operators.findings import finding

    store, seen = Store(spark, str(tmp_path / "s")), []
    for k in range(9):
        at = datetime(2024, 1, 1 + k // 3)
        store.save_review({"id": f"r{k}", "repo_path": "/a", "mode": "offline", "started_at": at, "finished_at": at}, spark.range(k % 3).select(*finding(file=none_col(f"f{k}"))))
    after = None
    while page := store.list_reviews("/a", 4, after).collect():
        assert len(page) <= 4
        seen += [r.id for r in page]
        after = (page[-1].started_at, page[-1].id)
    assert seen == [r.id for r in store.list_reviews("/a").collect()] == [f"r{k}" for k in range(8, -1, -1)]
    plan = store.list_reviews("/a", 4)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    rows = store.findings_of(store.list_reviews("/a", 4)).collect()
    assert sorted((r.review_id, r.file, r.findings_count) for r in rows) == [("r5", "f5", 2), ("r5", "f5", 2), ("r7", "f7", 1), ("r8", "f8", 2), ("r8", "f8", 2)]
    _, found = store.get_review("r5")
    assert {f.rsplit("/", 2)[-2] for f in found.inputFiles()} == {"attempt=" + store.reviews().where("id = 'r5'").head().attempt}


def none_col(name):
    from pyspark.sql import functions as F

    return F.lit(name)


def test_command_line(capsys):
    assert main(["version"]) == 0 and capsys.readouterr().out.strip()
    with pytest.raises(SystemExit) as e:
        main([])
    assert e.value.code == 2


def test_what_a_lost_attempt_wrote_is_no_part_of_a_review(spark, tmp_path):
    from mergelens.operators.findings import finding

    store, at = Store(spark, str(tmp_path / "s")), datetime(2025, 5, 5)
    review_ = {"id": "r", "repo_path": "/a", "mode": "offline", "started_at": at, "finished_at": at}
    written = Store.__dict__["save_review"]
    lost = Store(spark, str(tmp_path / "s"))
    lost.spark = _NoRows(spark)
    with pytest.raises(RuntimeError):  # dies between the findings and the review's row
        written(lost, review_, spark.range(3).select(*finding(file=none_col("f"))))
    assert store.read("findings").count() == 3 and store.list_reviews("/a").count() == 0
    store.save_review(review_, spark.range(2).select(*finding(file=none_col("g"))))
    head, rows = store.get_review("r")
    assert head["findings_count"] == 2 and {r.file for r in rows.collect()} == {"g"}


class _NoRows:
    """A session that can read but makes no rows."""

    def __init__(self, spark):
        self.spark = spark

    def __getattr__(self, name):
        return getattr(self.spark, name)

    def createDataFrame(self, *_):
        raise RuntimeError("lost")
