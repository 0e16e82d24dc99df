import random

import pytest

from mergelens.operators import graph, sync as sync_ops
from mergelens.plans.store import Store, sync
from mergelens.schemas import INDEX_IMPORTS, INDEX_REFS, INDEX_SYMBOLS
from mergelens.sources import files as fsrc
from mergelens.sources.goparse import GoSyntaxError, index_directory, parse

CRATES = """package depot

type Crate struct {
	weight int
	lid    *Lid
}

type Lid struct{ open bool }

const (
	heaviest = 40
	lightest = heaviest / 8
)

var ledger []Crate

func fill(n int) Crate {
	if n > heaviest {
		n = heaviest
	}
	return Crate{weight: n, lid: &Lid{}}
}

func (c Crate) Light() bool { return c.weight <= lightest }

func (l *Lid) flip(times int) {
	if l.open = !l.open; times > 1 {
		l.flip(times - 1)
	}
}
"""
LOADS = """package depot

import (
	"os"
	"strconv"
)

type Scale interface{ Light() bool }

func load(onto []Crate, sizes ...int) []Crate {
	for _, s := range sizes {
		onto = append(onto, fill(s))
	}
	ledger = onto
	return onto
}

func print(s Scale) { os.Stdout.WriteString(strconv.FormatBool(s.Light())) }

func borrowed(fill func(int) Crate) Crate { return fill(1) }

func countdown(n int) {
	if n > 0 {
		countdown(n - 1)
	}
}
"""
YARD = "package yard\n\nconst rails = 3\n\ntype Crane struct{ load [rails]int }\n"
TORN = "package depot\n\nvar half = [\n"
EDGES = [
    ("crates.go", "Crate", "crates.go", "Lid", "use"), ("crates.go", "lightest", "crates.go", "heaviest", "use"), ("crates.go", "ledger", "crates.go", "Crate", "use"),
    ("crates.go", "fill", "crates.go", "Crate", "use"), ("crates.go", "fill", "crates.go", "Lid", "use"), ("crates.go", "fill", "crates.go", "heaviest", "use"),
    ("crates.go", "Crate.Light", "crates.go", "Crate", "use"), ("crates.go", "Crate.Light", "crates.go", "lightest", "use"), ("crates.go", "Lid.flip", "crates.go", "Lid", "use"),
    ("loads.go", "load", "crates.go", "Crate", "use"), ("loads.go", "load", "crates.go", "fill", "call"), ("loads.go", "load", "crates.go", "ledger", "use"),
    ("loads.go", "print", "loads.go", "Scale", "use"), ("loads.go", "borrowed", "crates.go", "Crate", "use"),
]


def edges(*sources):
    parsed, refs, skipped = index_directory(list(sources))
    return sorted((p, s, f, d, k) for p, rs in refs.items() for s, f, d, k in rs), parsed, skipped


def test_a_package_of_two_files():
    got, parsed, skipped = edges(("crates.go", CRATES), ("loads.go", LOADS), ("torn.go", TORN))
    assert got == sorted(EDGES) and skipped == ["torn.go"]
    kinds = {n: k for f in parsed for n, k, _ in f.symbols}
    assert kinds == {
        "Crate": "struct", "Lid": "struct", "heaviest": "const", "lightest": "const", "ledger": "var", "fill": "func", "Crate.Light": "method",
        "Lid.flip": "method", "Scale": "interface", "load": "func", "print": "func", "borrowed": "func", "countdown": "func",
    }
    assert parsed[1].imports == ["os", "strconv"]
    assert edges(("loads.go", LOADS), ("crates.go", CRATES))[0] == got


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("func g() { f() }", [("g", "f", "call")]),
        ("func g() { h := f; h() }", [("g", "f", "use")]),
        ("func g() { f := f() }", []),
        ("func g() { (f)() }", [("g", "f", "use")]),
        ("func g(f int) { _ = f }", []),
        ("func g() { for f := range xs { _ = f } }", [("g", "xs", "use")]),
        ("func g() { var f = 1; _ = f }", [("g", "f", "use")]),
        ("func g() { _ = T{f: 1} }", [("g", "T", "use")]),
        ("func g() { _ = map[int]int{c: 1} }", [("g", "c", "use")]),
        ("func g() { if T := 1; T > 0 { } }", []),
        ("func g() { T.M(t) }", [("g", "T.M", "call"), ("g", "t", "use")]),
        ("func g() { _ = T.M }", [("g", "T.M", "use")]),
        ("func g() { _ = T.Z }", [("g", "T", "use")]),
        ("func g() { x.f() }", []),
        ("func g() { func(f int) { _ = f }(1); f() }", [("g", "f", "call")]),
        ("func g() { switch c { case 1: f := 2; _ = f; case 3: f() } }", [("g", "c", "use"), ("g", "f", "call")]),
        ("func g() { switch v := any(c).(type) { case T: _ = v } }", [("g", "T", "use"), ("g", "c", "use")]),
        ("func g[P any](p P) T { var q P; return T(q) }", [("g", "T", "use")]),
        ("func g() { f: for { break f } }", []),
        ("func g() { go f(); defer f() }", [("g", "f", "call")]),
        ("func g() { select { case v := <-ch: _ = v; default: f() } }", [("g", "ch", "use"), ("g", "f", "call")]),
        ("func g() { if (T{}) == (T{}) { f() } }", [("g", "T", "use"), ("g", "f", "call")]),
        ("type U[K comparable, V T] struct { m map[K]V; T }", [("U", "T", "use")]),
        ("type V [c]T", [("V", "T", "use"), ("V", "c", "use")]),
        ("var _ = f()", []),
        ("var _, w = f(), c", [("w", "c", "use"), ("w", "f", "call")]),
        ("func (r *T) N() { r.M(); c++ }", [("T.N", "T", "use"), ("T.N", "c", "use")]),
        ("func g() { xs[c] = f(xs[1:c]...) }", [("g", "c", "use"), ("g", "f", "call"), ("g", "xs", "use")]),
    ],
)
def test_references(body, expected):
    base = "package p\nfunc f(...int) int { return 0 }\ntype T struct{ a int }\nfunc (T) M(T) {}\nvar t T\nvar c int\nvar xs []int\nvar ch chan int\n"
    parsed, refs, skipped = index_directory([("base.go", base), ("z.go", "package p\n" + body + "\n")])
    assert not skipped
    assert [(s, d, k) for s, _, d, k in refs["z.go"]] == expected


def test_index_rows_are_those_of_whole_directories(spark, monkeypatch):
    """The same rows as from whole directories, files being parsed apart; nothing is grouped by directory in Python."""
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", lambda *a, **k: pytest.fail("a directory is one group"))
    again = "package yard\n\nconst Crate = 1\n\nfunc rails() {}\n\nvar lid = rails\n"  # declares two names again
    other = "package depot\n\ntype heaviest struct{}\n\nfunc (Crate) Light() { fill(); Lid.flip(nil); ledger.x() }\n"
    trees = {"a": {"crates.go": CRATES, "loads.go": LOADS, "torn.go": TORN}, "b": {"crates.go": CRATES, "yard.go": YARD, "zz.go": again, "d.go": other}, "c": {"loads.go": LOADS}}
    want = []
    for d, tree in trees.items():
        parsed, refs, skipped = index_directory([(f"{d}/{p}", t) for p, t in tree.items()])
        want += [(d, "skipped", p, None, None, None, None, None) for p in skipped]
        for f in parsed:
            want += [(d, "file", f.path, *[None] * 5), *[(d, "symbol", f.path, n, k, line, None, None) for n, k, line in f.symbols], *[(d, "import", f.path, i, *[None] * 4) for i in f.imports]]
            want += [(d, "ref", f.path, src, kind, None, at, dst) for src, at, dst, kind in refs[f.path]]
    rows = [("r", f"{d}/{p}", t.encode()) for d, tree in trees.items() for p, t in tree.items()]
    got = fsrc.index_rows(spark.createDataFrame(rows, "repo_path string, path string, content binary").repartition(5))
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r[1:]) for r in got.select("repo_path", "dir", "record", "file", "name", "kind", "line", "dst_file", "dst_name").collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] == "ref" for r in want) >= 30


def test_syntax_errors():
    for bad in ("", "package", "package p\nfunc (", "package p\nvar x = ", "package p\nx := 1", "package p\nfunc f() { if { }", 'package p\nvar s = "open'):
        with pytest.raises(GoSyntaxError):
            parse("x.go", bad)


def source_frame(spark, texts, repo="r"):
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary")
    return fsrc.source_files(df, repo)


SOURCES = {"crates.go": CRATES, "loads.go": LOADS, "yard/y.go": YARD}


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("index")))
    first = sync(source_frame(spark, SOURCES), "r", store)
    return store, first


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_queries_of_an_index(spark, indexed):
    store, first = indexed
    assert (first.files, first.symbols, first.refs, first.dirs_changed) == (3, 15, len(EDGES) + 1, 2)
    refs, symbols, imports = (store.index.read(t, "r") for t in ("index_refs", "index_symbols", "index_imports"))
    for file, name in {(e[2], e[3]) for e in EDGES}:  # every symbol that an edge leads to
        assert rows(graph.callers(refs, file, name)) == sorted((a, b, k) for a, b, c, d, k in EDGES if (c, d) == (file, name))
    for file, name in {(e[0], e[1]) for e in EDGES}:
        assert rows(graph.callees(refs, file, name)) == sorted((c, d, k) for a, b, c, d, k in EDGES if (a, b) == (file, name))
    assert rows(graph.type_uses(refs, symbols, "crates.go", "Lid")) == [("crates.go", "Crate", "use"), ("crates.go", "Lid.flip", "use"), ("crates.go", "fill", "use")]
    for name in ("fill", "Barrel"):
        with pytest.raises(ValueError):
            graph.type_uses(refs, symbols, "crates.go", name)
    assert rows(graph.refs_into_file(refs, "yard/y.go")) == [("yard/y.go", "Crane", "yard/y.go", "rails", "use")]
    assert rows(graph.refs_into_file(refs, "crates.go")) == sorted(e for e in EDGES if e[2] == "crates.go")
    assert [rows(graph.imports_of(imports, f)) for f in ("loads.go", "crates.go")] == [[("os",), ("strconv",)], []]
    assert rows(graph.files_touching(refs, "crates.go", "fill")) == [("crates.go",), ("loads.go",)]
    assert rows(graph.files_touching(refs, "yard/y.go", "Crane")) == [("yard/y.go",)]
    got = {r.path: (len(r.symbols), r.imports) for r in graph.repo_index(store.index.read("index_files", "r"), symbols, imports).collect()}
    assert got == {"crates.go": (8, []), "loads.go": (5, ["os", "strconv"]), "yard/y.go": (2, [])}
    assert graph.repo_index(store.index.read("index_files", "r"), symbols, imports, "yard").count() == 1


def test_impact_by_steps(spark, indexed):
    refs = indexed[0].index.read("index_refs", "r")
    assert rows(graph.impact_set(refs, ["./loads.go", "yard/../yard/y.go", "", "/"])) == [("loads.go", 0), ("yard/y.go", 0), ("crates.go", 1)]
    assert rows(graph.impact_set(refs, ["nowhere.go"])) == [("nowhere.go", 0)]
    chain = spark.createDataFrame([("r", f"f{i}", "n", f"f{i + 1}", "n", "use") for i in range(5)], INDEX_REFS)
    assert rows(graph.impact_set(chain, ["f2"])) == [("f2", 0), ("f1", 1), ("f3", 1), ("f0", 2), ("f4", 2)]


def test_later_syncs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    dry = sync(source_frame(spark, SOURCES), "r")
    assert dry == sync(source_frame(spark, SOURCES), "r", store) and dry.files == 3
    assert sync(source_frame(spark, SOURCES), "r", store).dirs_changed == 0
    edited = SOURCES | {"loads.go": LOADS + "\nvar spare = heaviest\n"}
    got = sync(source_frame(spark, edited), "r", store)
    assert (got.dirs_changed, got.files, got.symbols) == (1, 2, 14)  # both files of the folder, none of the other
    assert rows(graph.callers(store.index.read("index_refs", "r"), "crates.go", "heaviest"))[-1] == ("loads.go", "spare", "use")
    gone = sync(source_frame(spark, {k: v for k, v in edited.items() if "/" not in k}), "r", store)
    assert (gone.dirs_changed, gone.files) == (1, 0)
    assert store.index.read("index_files", "r").where("dir = 'yard'").count() == 0 and store.index.read("index_refs", "r").count() == len(EDGES) + 1
    for _ in range(2):  # a file that can't be parsed has no row, so its folder is looked at each time
        torn = sync(source_frame(spark, {"crates.go": CRATES, "loads.go": edited["loads.go"], "torn.go": TORN}), "r", store)
        assert torn.skipped == ["torn.go"] and torn.dirs_changed == 1
    assert store.migrate() == []


def test_an_unchanged_tree_reads_no_rows_of_files(spark, tmp_path, monkeypatch):
    store, read = Store(spark, str(tmp_path / "s")), []
    sync(source_frame(spark, SOURCES), "r", store)
    kept = type(store.index).read
    monkeypatch.setattr(type(store.index), "read", lambda self, table, repo=None: (read.append(table), kept(self, table, repo))[1])
    assert sync(source_frame(spark, SOURCES), "r", store).dirs_changed == 0 and read == ["index_digests"]
    read.clear()
    sync(source_frame(spark, SOURCES | {"yard/z.go": YARD.replace("Crane", "Hoist").replace("rails", "ropes")}), "r", store)
    assert "index_files" not in read


def test_digests_tell_what_files_tell(spark):
    rng = random.Random(4)
    for _ in range(6):
        was = {f"d{rng.randrange(4)}/f{rng.randrange(9)}": str(rng.randrange(3)) for _ in range(20)}
        now = {p: (h if rng.random() < 0.9 else "9") for p, h in was.items() if rng.random() < 0.9}
        frames = [spark.createDataFrame(list(x.items()), "path string, hash string") for x in (was, now)]
        want = {r.dir for r in sync_ops.changed_files(*frames).selectExpr("substring_index(path, '/', 1) as dir").collect()}
        assert {r.dir for r in sync_ops.stale_dirs(*frames).collect()} == want
        swapped = frames[0].selectExpr("path", "case when path = 'x' then hash else hash end as hash").orderBy(sync_ops.F.col("path").desc())
        assert sync_ops.stale_dirs(frames[0], swapped).count() == 0


def test_edges_with_unknown_ends_are_refused(spark):
    symbols = spark.createDataFrame([("r", "a", "x", "func", 1)], INDEX_SYMBOLS)
    refs = spark.createDataFrame([("r", "a", "x", "a", "y", "use")], INDEX_REFS)
    with pytest.raises(ValueError):
        graph.check_refs(refs, symbols)
    graph.check_refs(refs.limit(0), symbols)


def test_change_kinds(spark):
    s = spark.createDataFrame([("d/a", "1"), ("d/b", "1"), ("c", "1"), ("e/n", None)], "path string, hash string")
    c = spark.createDataFrame([("d/a", "1"), ("d/b", "2"), ("f/z", "1"), ("e/n", None)], "path string, hash string")
    assert {tuple(r) for r in sync_ops.changed_files(s, c).collect()} == {("d/b", "changed"), ("c", "deleted"), ("f/z", "added")}
    assert {r.dir for r in sync_ops.stale_dirs(s, c).collect()} == {"d", "", "f"}


def test_walk(tmp_path, spark):
    for p in ("a.go", "_x.go", ".hidden/y.go", "vendor/v.go", "sub/build/z.go", "sub/q.txt", "sub/q.go"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("package p\n")
    assert fsrc.walk(str(tmp_path)) == [".hidden/y.go", "_x.go", "a.go", "sub/q.go"]
    assert "vendor/v.go" in fsrc.walk(str(tmp_path), ["sub"])
    got = fsrc.discover(spark, str(tmp_path)).collect()
    assert {r.path for r in got} == {".hidden/y.go", "_x.go", "a.go", "sub/q.go"} and all(r.language == "go" and len(r.hash) == 64 for r in got)


def test_imports_schema(spark):
    assert spark.createDataFrame([], INDEX_IMPORTS).columns == ["repo_path", "file_path", "import_path"]


def test_edges_are_checked_by_their_ends(spark, monkeypatch):
    """Edges are joined with the symbols only to name one that has a missing end."""
    refs = spark.createDataFrame([("r", "a", "f", "b", "g", "call")] * 2, "repo_path string, src_file string, src_name string, dst_file string, dst_name string, kind string")
    symbols = spark.createDataFrame([("r", "a", "f"), ("r", "b", "g"), ("r", "b", "g")], "repo_path string, file_path string, name string")
    for lost in ("file_path = 'a'", "name = 'g'"):
        with pytest.raises(ValueError, match="unknown end: .*'src_file': 'a'"):
            graph.check_refs(refs, symbols.where(f"not ({lost})"))
    monkeypatch.setattr(graph, "dangling", None)
    graph.check_refs(refs, symbols)
