import pytest
from pyspark.sql import functions as F

from mergelens.operators import findings as fs

COLS = "rule_id string, category string, severity string, file string, line_start int, message string, confidence double"


def frame(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    made = df.withColumn("_o", F.monotonically_increasing_id())
    return made.select(*fs.finding(**{c: F.col(c) for c in ("rule_id", "category", "severity", "file", "line_start", "message", "confidence")}, seq=F.array("_o")))


def test_first_of_equal_findings_stays(spark):
    rows = [("r1", "c", "info", "a", 1, "first", 1.0), ("r1", "d", "error", "a", 1, "second", 1.0), ("r2", "c", "info", "a", 1, "third", 1.0)]
    got = [(r.rule_id, r.message) for r in fs.dedupe(frame(spark, rows).coalesce(1)).orderBy("seq").collect()]
    assert got == [("r1", "first"), ("r2", "third")]


def test_category_counts_without_a_rule_and_no_line_is_one_place(spark):
    rows = [("", "x", "info", "a", None, "1", 1.0), ("", "y", "info", "a", 0, "2", 1.0), ("", "x", "info", "a", -3, "3", 1.0), ("r", "x", "info", "a", None, "4", 1.0), ("r", "y", "info", "a", 0, "5", 1.0)]
    assert sorted(r.message for r in fs.dedupe(frame(spark, rows).coalesce(1)).collect()) == ["1", "2", "4"]


def test_earlier_parts_win(spark):
    a, b = frame(spark, [("r", "c", "info", "a", 1, "late", 1.0)]), frame(spark, [("r", "c", "info", "a", 1, "early", 1.0)])
    assert fs.dedupe(fs.union_all([b, a])).head().message == "early"


def test_rank(spark):
    rows = [("a", "c", "info", "f", 1, "m", 1.0), ("b", "c", "critical", "z", 9, "m", 0.5), ("c", "c", "critical", "a", 2, "m", 0.9), ("d", "c", "warning", "a", 1, "m", 1.0), ("e", "c", "odd", "a", 1, "m", 1.0)]
    df = frame(spark, rows)
    assert [r.rule_id for r in fs.rank(df).collect()] == ["c", "b", "d", "a", "e"]
    for parts in (1, 3, 7):
        got = fs.with_rank(df.repartition(3), parts=parts).collect()
        assert [r.rule_id for r in sorted(got, key=lambda r: r["rank"])] == ["c", "b", "d", "a", "e"]
        assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]


def test_empty(spark):
    df = frame(spark, [("a", "c", "info", "f", 1, "m", 1.0)]).limit(0)
    assert fs.dedupe(df).count() == fs.with_rank(df).count() == 0
    assert fs.summary_line(df) == "no findings"


def test_summary_and_filters(spark):
    df = frame(spark, [("a", "c", "info", "f", 1, "m", 1.0), ("b", "c", "critical", "z", 9, "m", 0.5), ("c", "c", "critical", "a", 2, "m", 0.9)])
    assert fs.summary_line(df) == "2 critical, 1 info"
    assert fs.visible(df, ["info"]).count() == 1 and fs.visible(df, sources=["rule"]).count() == 0 and fs.visible(df).count() == 3


def test_ids_say_what_a_finding_says(spark):
    df = frame(spark, [("a", "c", "info", "f", 1, "m", 1.0), ("a", "c", "info", "f", 2, "m", 1.0)])
    one, two = (sorted(r.id for r in fs.with_ids(df.repartition(n)).collect()) for n in (1, 4))
    assert one == two and len(set(one)) == 2 and all(len(i) == 16 for i in one)


@pytest.mark.parametrize("parts", [1, 8])
def test_order_of_partitions_does_not_matter(spark, parts):
    rows = [(f"r{i % 3}", "c", "info", f"f{i % 4}", i % 5, str(i), 1.0) for i in range(60)]
    base = frame(spark, rows).withColumn("seq", F.array(F.col("message").cast("long")))
    got = sorted(r.message for r in fs.dedupe(base.repartition(parts)).collect())
    assert len(got) == len({(i % 3, i % 4, i % 5) for i in range(60)}) == 60
