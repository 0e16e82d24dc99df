"""The index under its commit log, and what its layout saves."""

import random
import threading
from collections import defaultdict

import pytest

from mergelens.functions import fs
from mergelens.operators import graph
from mergelens.plans.commits import CommitLog
from mergelens.plans.index import TABLES, Index
from mergelens.schemas import INDEX_FILES, INDEX_IMPORTS, INDEX_REFS, INDEX_SYMBOLS


def tables(spark, repo, dirs, edges=()):
    """Rows of an index: ``dirs`` gives each directory's files, ``edges`` are (from file, to file)."""
    files = [(repo, f"{d}/{f}", "go", f"hash of {f}", None, d) for d, fs_ in dirs.items() for f in fs_]
    of = {r[1]: r[5] for r in files}
    symbols = [(repo, r[1], "run", "func", 1, r[5]) for r in files]
    refs = [(repo, a, "run", b, "run", "call", of[a]) for a, b in edges]
    imports = [(repo, r[1], "os", r[5]) for r in files]
    made = {"index_files": (files, INDEX_FILES), "index_symbols": (symbols, INDEX_SYMBOLS), "index_refs": (refs, INDEX_REFS), "index_imports": (imports, INDEX_IMPORTS)}
    return {k: spark.createDataFrame(rows, schema + ", dir string") for k, (rows, schema) in made.items()}


def paths(index, repo=None):
    return sorted(r.path for r in index.read("index_files", repo).select("path").collect())


def test_put_if_absent(spark, tmp_path):
    for link in (True, False):
        at = f"{tmp_path}/{link}/x"
        assert fs.put_if_absent(spark, at, "one é", link) and not fs.put_if_absent(spark, at, "two", link)
        assert fs.read_text(spark, at) == "one é" and list(fs.names(spark, f"{tmp_path}/{link}")) == ["x"]
        won = []
        racers = [threading.Thread(target=lambda k=k, at=at: won.append(k) if fs.put_if_absent(spark, at + "2", str(k), True) else None) for k in range(6)]
        for t in racers:
            t.start()
        for t in racers:
            t.join()
        assert len(won) == 1 and fs.read_text(spark, at + "2") == str(won[0])


def test_log_of_many_versions(spark, tmp_path):
    log, want, rng = CommitLog(spark, f"{tmp_path}/log", every=4), {}, random.Random(1)
    assert log.state()[0] == 0 and log.state()[1].count() == 0
    for k in range(1, 15):
        dirs = [("r", f"d{rng.randrange(6)}", rng.random() < 0.7)]
        assert log.commit(f"g{k}", dirs) == k
        for repo, d, there in dirs:
            want.pop((repo, d), None)
            if there:
                want[repo, d] = f"g{k}"
        if k % 5 == 0:
            assert {(r.repo_path, r.dir): r.gen for r in log.state()[1].collect()} == want
    commits, snapshots = log._listing()
    assert sorted(snapshots) == [4, 8, 12] and len(commits) == 14
    base = log.state()[1]
    log.commit("late", [("r", next(iter(want))[1], True)])
    log.replace(base, "all")
    want = {k: "late" if k == next(iter(want)) else "all" for k in want}
    assert {(r.repo_path, r.dir): r.gen for r in log.state()[1].collect()} == want
    log.vacuum(1 << 60)
    assert CommitLog(spark, f"{tmp_path}/log").state()[0] == 16 and {(r.repo_path, r.dir): r.gen for r in log.state()[1].collect()} == want
    assert [len(x) for x in log._listing()] == [0, 1]


def test_writers_at_once(spark, tmp_path):
    """Each writer's directories are there, and of those that all write the rows are one writer's alone, the last's."""
    index = Index(spark, str(tmp_path), every=2)
    failed = []

    def write(k):
        try:
            own = Index(spark, str(tmp_path), every=2)
            for step in range(2):
                own.replace("r", [f"own{k}", "shared"], tables(spark, "r", {f"own{k}": [f"f{step}"], "shared": [f"w{k}s{step}{x}" for x in "ab"]}))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert not failed and index.log.version() == 6
    got = paths(index)
    shared = [p for p in got if p.startswith("shared/")]
    assert [p for p in got if p not in shared] == [f"own{k}/f1" for k in range(3)]
    assert len(shared) == 2 and shared[0][:-1] == shared[1][:-1] and "s1" in shared[0]


def test_a_lost_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path))
    index.replace("r", ["a"], tables(spark, "r", {"a": ["x"]}))
    monkeypatch.setattr(CommitLog, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.replace("r", ["a"], tables(spark, "r", {"a": ["y"]}))
    monkeypatch.undo()
    assert paths(Index(spark, str(tmp_path))) == ["a/x"]
    assert len(Index(spark, str(tmp_path)).vacuum(-60)) == 1 and paths(index) == ["a/x"]


def test_history_does_not_grow_reads(spark, tmp_path):
    index, want = Index(spark, str(tmp_path), most=4, every=3), {}
    for k in range(10):
        d, repo = f"d{k % 4}", f"r{k % 2}"
        want[repo, d] = [f"{d}/v{k}"] if k != 7 else []
        index.replace(repo, [d], tables(spark, repo, {d: [f"v{k}"]} if k != 7 else {}))
        assert len(index._current()[1]) <= 4 and paths(index) == sorted(x for v in want.values() for x in v)
    index.compact()
    assert len(index._current()[1]) == 1 and all(index._current()[1].values())
    index.vacuum(-60)
    for table in TABLES:
        assert len([n for n in fs.names(spark, f"{tmp_path}/{table}") if n.startswith("gen=")]) == 1
    assert paths(Index(spark, str(tmp_path))) == sorted(x for v in want.values() for x in v)
    assert paths(index, "r0") == sorted(x for (r, _), v in want.items() if r == "r0" for x in v)
    index.delete("r0", "d0")
    assert not [p for p in paths(index) if p.startswith("d0/")] and index.read("index_refs", "r0").count() == 0


def scanned(df):
    """Rows that the scans of a query handed on."""
    df.collect()
    out, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            plans.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            plans.append(p.plan())
        if p.nodeName().startswith("Scan parquet"):
            out += p.metrics().apply("numOutputRows").value()
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return out


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """An index of 40,000 edges in row groups of some thousand rows."""
    rng = random.Random(2)
    dirs = {"p": [f"f{i}" for i in range(2000)]}
    edges = sorted({(f"p/f{rng.randrange(2000)}", f"p/f{rng.randrange(2000)}") for _ in range(40_000)})
    options = {"parquet.block.size": "65536", "parquet.page.size": "4096", "parquet.block.row.count.limit": "2000"}
    index = Index(spark, str(tmp_path_factory.mktemp("large")), options=options)
    index.replace("r", ["p"], tables(spark, "r", dirs, edges))
    return index, edges


def test_lookups_read_few_row_groups(large):
    index, edges = large
    for df, want in (
        (index.callers("r", "p/f77", "run"), sorted((a, "run", "call") for a, b in edges if b == "p/f77")),
        (index.callees("r", "p/f77", "run"), sorted((b, "run", "call") for a, b in edges if a == "p/f77")),
        (index.refs_into_file("r", "p/f8"), sorted((a, "run", b, "run", "call") for a, b in edges if b == "p/f8")),
    ):
        assert [tuple(r) for r in df.collect()] == want
        assert scanned(df) <= len(edges) / 8
    assert [r.import_path for r in index.imports_of("r", "p/f3").collect()] == ["os"]
    assert [r.path for r in index.files_touching("r", "p/f3", "run").collect()] == sorted({"p/f3"} | {a for a, b in edges if b == "p/f3"})
    with pytest.raises(ValueError):
        index.type_uses("r", "p/f3", "run")


def reach(edges, seeds, depth):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = dict.fromkeys(seeds, 0)
    for d in range(1, depth + 1):
        for p in [p for p, x in out.items() if x == d - 1]:
            for q in near[p]:
                out.setdefault(q, d)
    return out


@pytest.mark.parametrize("few", [10_000, 0])
def test_impact_over_kept_links(large, monkeypatch, few):
    index, edges = large
    monkeypatch.setattr(graph, "FEW", few)
    for changed, depth in ((["p/f1", "./p/f2", "", "new.go"], 2), (["p/f5"], 1), ([], 2)):
        got = {r.path: r.distance for r in index.impact_set("r", changed, depth).collect()}
        assert got == reach(edges, [c.removeprefix("./") for c in changed if c], depth)


def test_a_large_frontier_prunes_the_links(spark, large, monkeypatch):
    """Beyond what may be broadcast, the scan of the links is filtered by a bloom filter before its shuffle."""
    index, _ = large
    plans = []
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(graph, "cut_counted", lambda df, label: (plans.append(df._jdf.queryExecution().toString()), _cut(df, label))[1])
    from mergelens.functions.lineage import cut_counted as _cut

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.impact_set("r", ["p/f1"], 1).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "might_contain" in plans[1]
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold") != "0"


def torn(spark, root):
    """An index of two generations, of which the first has lost a directory to the second and another to a deletion."""
    dirs = {d: [f"f{i}" for i in range(30)] for d in "abc"}
    edges = [(f"{d}/f{i}", f"{e}/f{(i * 7 + 1) % 30}") for d in dirs for e in dirs for i in range(30)]
    index, later = Index(spark, root), [(a, b) for a, b in edges if a[0] == "a" and a < "a/f2"]
    index.replace("r", list(dirs), tables(spark, "r", dirs, edges))
    index.replace("r", ["a"], tables(spark, "r", {"a": dirs["a"]}, later))
    index.delete("r", "c")
    return index, sorted(later + [(a, b) for a, b in edges if a[0] == "b"])


def test_torn_generations_are_read_where_they_lie(spark, tmp_path):
    """The few directories that are left are broadcast: neither lookups nor links deal out the edges of an index."""
    index, want = torn(spark, str(tmp_path))
    rows = index.read("index_refs", "r")
    assert sorted((r.src_file, r.dst_file) for r in rows.collect()) == want
    for df in (rows, index.links("r")):
        assert "SortMergeJoin" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan
    assert {r.path: r.distance for r in index.impact_set("r", ["a/f0"], 2).collect()} == reach(want, ["a/f0"], 2)
    assert "index_links" not in fs.names(spark, str(tmp_path))  # edges by source and by target are the links


@pytest.mark.parametrize("few", [10_000, 0])
def test_large_generations_are_not_sorted_again(spark, tmp_path, monkeypatch, few):
    from mergelens.plans import index as module

    index, want = torn(spark, str(tmp_path))
    monkeypatch.setattr(module, "LARGE", 1)
    monkeypatch.setattr(module, "FEW", few)
    index, sorted_ = Index(spark, str(tmp_path)), []
    ranged = type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, *a: (sorted_.append(a), ranged(self, *a))[1])
    index.compact()
    assert bool(sorted_) == (not few)  # beyond what may be broadcast all that is torn is sorted
    assert list(index._current()[1].values()) == [True]
    for table in ("index_refs", "index_refs_into"):
        assert sorted((r.src_file, r.dst_file) for r in index.read(table, "r").collect()) == want
        for f in index.read(table, "r").inputFiles():
            part = [tuple(r) for r in spark.read.parquet(f).select(*(["src_file", "src_name"] if table == "index_refs" else ["dst_file", "dst_name"])).collect()]
            assert sum(x > y for x, y in zip(part, part[1:], strict=False)) < 8  # whole runs, one for each file that was read
    assert sorted(r.file for r in index.callers("r", "b/f1", "run").collect()) == sorted(a for a, b in want if b == "b/f1")


def test_a_small_frontier_is_asked_of_the_scan(large, monkeypatch):
    """A step from few files reads the row groups that hold them, not all links."""
    index, edges = large
    read = []
    monkeypatch.setattr(graph, "cut_counted", lambda df, label: (read.append(scanned(df)), _cut(df, label))[1])
    from mergelens.functions.lineage import cut_counted as _cut

    got = {r.path: r.distance for r in index.impact_set("r", ["p/f1"], 1).collect()}
    assert got == reach(edges, ["p/f1"], 1) and len(read) == 2
    assert read[1] <= len(edges) / 4  # of twice as many links
    assert index.spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold") == "10"


def test_a_replacement_reads_its_rows_once(spark, tmp_path, monkeypatch):
    """Tables that come sorted are written as they lie, the others are sorted without a first reading for ranges."""
    dirs = {"p": [f"f{i}" for i in range(50)]}
    edges = sorted((f"p/f{i}", f"p/f{i * 7 % 50}") for i in range(50))
    kind, dealt = type(spark.range(1)), []
    for name in ("repartition", "repartitionByRange"):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), name=name: (dealt.append((name, a)), f(self, *a))[1])
    index, given = Index(spark, str(tmp_path)), tables(spark, "r", dirs, edges)
    index.replace("r", ["p"], {**given, "index_refs": given["index_refs"].coalesce(1)}, ordered=["index_refs"])
    assert sorted(a[0] for _, a in dealt) == ["dir", "dst_file", "file_path", "file_path", "path"] and {n for n, _ in dealt} == {"repartition"}
    for table, key in (("index_refs", "src_file"), ("index_refs_into", "dst_file")):
        rows = index.read(table, "r")
        assert sorted((r.repo_path, r.src_file, r.dst_file, r.dir) for r in rows.collect()) == [("r", a, b, "p") for a, b in edges]
        for f in rows.inputFiles():
            part = [r[0] for r in spark.read.parquet(f).select(key).collect()]
            assert part == sorted(part)


def test_edges_with_an_unknown_end(spark):
    refs, symbols = (tables(spark, "r", {"p": ["a", "b"]}, [("p/a", "p/b"), ("p/b", "p/a")])[k] for k in ("index_refs", "index_symbols"))
    graph.check_refs(refs, symbols)
    for end in ("p/a", "p/b"):
        with pytest.raises(ValueError, match=end):
            graph.check_refs(refs.where(f"src_file = '{end}'"), symbols.where(f"file_path <> '{end}'"))
        with pytest.raises(ValueError, match=end):
            graph.check_refs(refs.where(f"dst_file = '{end}'"), symbols.where(f"file_path <> '{end}'"))
