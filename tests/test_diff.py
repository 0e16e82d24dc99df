from pyspark.sql import functions as F

from mergelens.operators import diff


def added(spark, text, path="p.go"):
    df = spark.createDataFrame([(path, text)], "path string, diff_text string")
    return [(r.number, r.text) for r in diff.added_lines(df).orderBy("line_ord").collect()]


def test_numbers_follow_the_new_side(spark):
    text = "diff --git a/p b/p\n--- a/p\n+++ b/p\n@@ -1,3 +1,4 @@\n same\n+two\n same\n-gone\n same\n+five\n"
    assert added(spark, text) == [(2, "two"), (5, "five")]


def test_lines_that_look_like_headers_do_not_advance(spark):
    assert added(spark, "@@ -1 +1,3 @@\n+a\n+++b\n+c") == [(1, "a"), (2, "c")]


def test_lines_before_a_header_count_from_zero_and_bad_headers_are_passed_over(spark):
    assert added(spark, "+x\n@@ nonsense\n+y\n@@ -1 +10 @@\n+z") == [(0, "x"), (1, "y"), (10, "z")]


def test_several_hunks_and_markers(spark):
    assert added(spark, "@@ -1 +1 @@\n+a\n\\ No newline at end of file\n@@ -9,2 +20,3 @@ func f()\n x\n+b") == [(1, "a"), (21, "b")]


def test_synthetic_diff_strips_one_line_feed(spark):
    df = spark.createDataFrame([("a", "x\ny\n"), ("b", ""), ("c", None), ("d", "x\n\n")], "path string, text string")
    got = {r.path: r.d for r in df.select("path", diff.synthetic_diff(F.col("text")).alias("d")).collect()}
    assert got == {"a": "@@ -0,0 +1,2 @@\n+x\n+y\n", "b": "@@ -0,0 +1,1 @@\n+\n", "c": "", "d": "@@ -0,0 +1,2 @@\n+x\n+\n"}


def test_whole_files_have_the_lines_of_their_synthetic_diffs(spark):
    df = spark.createDataFrame([("a", "x\ny"), ("b", "one\n"), ("c", "")], "path string, text string")
    direct = {(r.path, r.number, r.text) for r in diff.file_lines(df, "path", "text").collect()}
    made = diff.added_lines(df.select("path", diff.synthetic_diff(F.col("text")).alias("diff_text")))
    assert direct == {(r.path, r.number, r.text) for r in made.collect()}


def test_stat_counts_inside_hunks_only(spark):
    df = spark.createDataFrame([("p", "+no\n-no\n@@ x\n+a\n-b\n--- c\n+++ d\n e\n-f")], "path string, diff_text string")
    r = diff.diff_stat(df).head()
    assert (r.additions, r.deletions) == (1, 2)


def test_status_lines(spark):
    raws = ["?? new file.txt", "A  a.go", " A b.go", "AD c.go", "D  d.go", " D e.go", "R  old.go -> new.go", "R  odd.go", " M m.go", "M", "MM n -> o"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = {r.raw: (r.path, r.old_path, r.status, r.untracked) for r in diff.parse_status(df).collect()}
    assert got == {
        "?? new file.txt": ("new file.txt", "", "added", True), "A  a.go": ("a.go", "", "added", False), " A b.go": ("b.go", "", "added", False),
        "AD c.go": ("c.go", "", "added", False), "D  d.go": ("d.go", "", "deleted", False), " D e.go": ("e.go", "", "deleted", False),
        "R  old.go -> new.go": ("new.go", "old.go", "renamed", False), "R  odd.go": ("odd.go", "", "renamed", False), " M m.go": ("m.go", "", "modified", False),
        "MM n -> o": ("n -> o", "", "modified", False),
    }


def test_partitions_do_not_matter(spark):
    rows = [(f"p{i}", f"@@ -1 +{i},9 @@\n" + "\n".join(f"+l{j}" for j in range(i))) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "path string, diff_text string")
    one, many = (sorted(map(tuple, diff.added_lines(df.repartition(n)).collect())) for n in (1, 8))
    assert one == many and len(one) == 66
