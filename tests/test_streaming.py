from mergelens.schemas import DIFFS
from mergelens.streaming.diffs import watch


def test_diffs_that_arrive_are_reviewed_once(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def arrive(path, text):
        spark.createDataFrame([(path, text)], DIFFS).coalesce(1).write.mode("append").parquet(source)
        watch(spark, source, sink, check, availableNow=True).awaitTermination()

    arrive("a.go", "@@ -0,0 +1,2 @@\n+x\n+fmt.Println(1)")
    arrive("b.js", "@@ -0,0 +7,1 @@\n+console.log(1)  ")
    got = {(r.file, r.line_start, r.rule_id) for r in spark.read.parquet(sink).collect()}
    assert got == {("a.go", 2, "debug-print-in-go"), ("b.js", 7, "debug-print-in-js"), ("b.js", 7, "trailing-whitespace")}
    assert spark.read.parquet(sink).count() == 3


def diff_of(path, *lines):
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -0,0 +1,{len(lines)} @@\n" + "".join(f"+{x}\n" for x in lines)


def test_a_newer_diff_replaces_the_findings_of_the_older(spark, tmp_path):
    from datetime import datetime

    from mergelens.streaming.diffs import VERSIONS, current, follow

    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def arrive(*rows):
        spark.createDataFrame([(p, d, at and datetime(2025, 1, at)) for p, d, at in rows], VERSIONS).coalesce(1).write.mode("append").parquet(src)
        query = follow(spark, src, sink, ck, availableNow=True)
        assert query.awaitTermination(300) is not False and query.exception() is None
        return sorted((r.file, r.line_start, r.rule_id, r.version) for r in current(spark, sink).collect())

    mess, tidy = diff_of("a.go", "x", 'fmt.Println("x")'), diff_of("a.go", "x")
    trail = diff_of("b.txt", "one ", "two ")
    assert arrive(("a.go", mess, 2), ("b.txt", trail, 2), (None, trail, 2)) == [
        ("a.go", 2, "debug-print-in-go", 1), ("b.txt", 1, "trailing-whitespace", 1), ("b.txt", 2, "trailing-whitespace", 1)
    ]
    got = arrive(("a.go", tidy, 3), ("a.go", diff_of("a.go", "older "), 1), ("b.txt", trail, 4), ("c.txt", diff_of("c.txt", "new "), None))
    assert got == [("b.txt", 1, "trailing-whitespace", 1), ("b.txt", 2, "trailing-whitespace", 1), ("c.txt", 1, "trailing-whitespace", 1)]
    got = arrive(("a.go", mess, 2), ("b.txt", diff_of("b.txt", "one"), 3), ("c.txt", diff_of("c.txt", "a", "b "), 1), ("c.txt", diff_of("c.txt", "a", "b"), 1))
    assert [g for g in got if g[0] == "b.txt"] == [("b.txt", 1, "trailing-whitespace", 1), ("b.txt", 2, "trailing-whitespace", 1)]  # came late
    assert [g for g in got if g[0] == "a.go"] == [] and [g[3] for g in got if g[0] == "c.txt"] in ([2], [])
