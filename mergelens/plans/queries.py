"""The registered queries: each operator over whole tables, with the SQL that DuckDB checks it with.

Tables that the operators need are derived: a document is an untracked file, its path made of source, id and an extension;
an order line is a reference from a customer to a supplier; an event is a review of a user's repository.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mergelens.functions.lineage import cut, shared_dir
from mergelens.functions.paths import clean_path, dir_of, glob_regex, is_safe
from mergelens.functions.text import estimate_tokens, normal_severity, severity_weight, whole_seconds
from mergelens.operators import agent, context, detect, diff, findings, graph, rules, sync
from mergelens.plans.store import Store, latest_per_repo, numbered_reviews, review_findings
from mergelens.sources import config, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> Column:
    ext = F.element_at(F.array(F.lit(".go"), F.lit(".js"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    return F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)


PATH = "'src/' || source || '/' || doc_id || ['.go', '.js', '.txt'][doc_id % 3 + 1]"
LINES = f"""docs AS (SELECT doc_id, source, {PATH} AS path, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, source, path, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS number FROM docs)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(_path().alias("path"), "text")
    return diff.file_lines(docs, "path", "text")


# Lines that the rules have something to say about, by their place: none of the built-in rules matches the documents.
SEEDED = """CASE number % 40 WHEN 1 THEN text || '  ' WHEN 2 THEN 'fmt.Println(' || text WHEN 3 THEN 'console.log(' || text WHEN 4 THEN '=======' ELSE text END"""


def _seeded(lines: DataFrame) -> DataFrame:
    n, t = F.col("number") % 40, F.col("text")
    text = F.when(n == 1, F.concat(t, F.lit("  "))).when(n == 2, F.concat(F.lit("fmt.Println("), t)).when(n == 3, F.concat(F.lit("console.log("), t)).when(n == 4, "=======").otherwise(t)
    return lines.withColumn("text", text)


def _rules() -> list[rules.Rule]:
    return [*rules.default_rules(), rules.make_rule("word-the", pattern=r"\bthe\b", severity="info", message="the")]


RULE_SQL = """r(k, name, severity, scope, pattern) AS (VALUES
  (0, 'merge-conflict-markers', 'error', '', '^(<<<<<<<|>>>>>>>|=======)$'), (1, 'trailing-whitespace', 'info', '', '[ \\t]+$'),
  (2, 'debug-print-in-go', 'warning', '\\.go$', 'fmt\\.(Println|Printf|Print)\\(|log\\.Println\\('),
  (3, 'debug-print-in-js', 'warning', '\\.(js|ts|tsx|jsx|vue)$', 'console\\.(log|debug)\\('), (4, 'word-the', 'info', '', '\\bthe\\b'))"""


@query(f"WITH {LINES} SELECT path, CAST(number AS INT) AS number, text FROM lines")
def added_lines(spark, d):
    return _lines(spark, d).select("path", "number", "text")


@query(f"WITH {LINES} SELECT path, CAST(number AS INT) AS number, sha256(text) AS digest FROM lines WHERE text NOT LIKE '++%'")
def synthetic_diff(spark, d):
    docs = _table(spark, d, "documents").select(_path().alias("path"), diff.synthetic_diff(F.col("text")).alias("diff_text"))
    return diff.added_lines(docs).select("path", "number", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    head = F.concat(F.lit("@@ -1,1 +"), (F.col("doc_id") % 97 + 1).cast("string"), F.lit(",1 @@\n"))
    sign = lambda i: F.when(i % 3 == 0, "+").when(i % 3 == 1, " ").otherwise("-")
    body = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 5 == 0, head).otherwise(""), sign(i), x))
    return docs.select(_path().alias("path"), F.concat(F.lit("--- a\n+++ b\n"), F.array_join(body, "\n")).alias("diff_text"))


DIFF_SQL = f"""d0 AS (SELECT {PATH} AS path, doc_id % 97 + 1 AS k, string_split(text, chr(10)) AS ls FROM documents),
d1 AS (SELECT path, k, unnest(ls) AS x, unnest(range(0, len(ls))) AS i FROM d0),
d2 AS (SELECT *, CASE i % 3 WHEN 0 THEN '+' WHEN 1 THEN ' ' ELSE '-' END || x AS raw FROM d1),
d3 AS (SELECT *, NOT starts_with(raw, '+++') AND starts_with(raw, '+') AS plus, NOT starts_with(raw, '---') AND starts_with(raw, '-') AS minus, starts_with(raw, ' ') AS same FROM d2)"""


@query(f"""WITH {DIFF_SQL} SELECT path, CAST(k + n - 1 AS INT) AS number, text FROM (SELECT path, k, plus, x AS text,
sum(CAST(plus OR same AS INT)) OVER (PARTITION BY path, i // 5 ORDER BY i) AS n FROM d3) WHERE plus""")
def diff_parse(spark, d):
    return diff.added_lines(_diffs(spark, d)).select("path", "number", "text")


@query(f"WITH {DIFF_SQL} SELECT path, CAST(sum(plus::INT) AS BIGINT) AS additions, CAST(sum(minus::INT) AS BIGINT) AS deletions FROM d3 GROUP BY path")
def diff_stat(spark, d):
    return diff.diff_stat(_diffs(spark, d))


@query("""WITH o AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN '??' WHEN 1 THEN 'A ' WHEN 2 THEN 'R ' WHEN 3 THEN ' D' ELSE ' M' END AS xy, 'dir/' || o_custkey || '.go' AS p FROM orders)
SELECT o_orderkey, CASE WHEN xy = 'R ' THEN 'new/' || p ELSE p END AS path, CASE WHEN xy = 'R ' THEN p ELSE '' END AS old_path,
CASE xy WHEN '??' THEN 'added' WHEN 'A ' THEN 'added' WHEN 'R ' THEN 'renamed' WHEN ' D' THEN 'deleted' ELSE 'modified' END AS status, xy = '??' AS untracked FROM o""")
def status_parse(spark, d):
    k, p = F.col("o_orderkey") % 5, F.concat(F.lit("dir/"), F.col("o_custkey").cast("string"), F.lit(".go"))
    xy = F.when(k == 0, "?? ").when(k == 1, "A  ").when(k == 2, "R  ").when(k == 3, " D ").otherwise(" M ")
    raw = F.concat(xy, p, F.when(k == 2, F.concat(F.lit(" -> new/"), p)).otherwise(""))
    return diff.parse_status(_table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))).drop("raw")


@query(f"""WITH {LINES}, {RULE_SQL}, s AS (SELECT path, number, {SEEDED} AS text FROM lines)
SELECT path AS file, CAST(number AS INT) AS line_start, r.name AS rule_id, r.severity FROM s, r WHERE regexp_matches(path, scope) AND regexp_matches(s.text, pattern)""")
def rule_eval(spark, d):
    return rules.evaluate(_seeded(_lines(spark, d)), _rules()).select("file", "line_start", "rule_id", "severity")


@query("""WITH r AS (SELECT DISTINCT p_name, p_brand, p_type FROM part), b AS (SELECT DISTINCT p_brand FROM part),
s AS (SELECT lower(p_type) || '/' || l_returnflag || '/s' || l_suppkey || '.txt' AS file, l_orderkey AS number, p_name, p_brand, p_type, CAST(l_quantity AS INT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT file, CAST(number AS INT) AS line_start, 'goods ' || s.p_name || ' ' || s.p_brand || ' ' || s.p_type AS rule_id, 'info' AS severity FROM s JOIN r ON s.p_name = r.p_name AND s.p_brand = r.p_brand AND s.p_type = r.p_type
UNION ALL SELECT file, CAST(number AS INT), 'many of ' || s.p_brand, 'warning' FROM s JOIN b ON s.p_brand = b.p_brand WHERE q BETWEEN 40 AND 49 AND file LIKE '%/R/%' """)
def rule_catalogue(spark, d):
    """Rules made from the kinds of goods (name, brand and type, of which there are fewer than 10,000), for the lines of deliveries."""
    part, li = _table(spark, d, "part"), _table(spark, d, "lineitem")
    kinds = part.select("p_name", "p_brand", "p_type").distinct().orderBy("p_name", "p_brand", "p_type").collect()
    made = [rules.make_rule(f"goods {k.p_name} {k.p_brand} {k.p_type}", [f"{k.p_type.lower()}/**"], "info", rf"\b{k.p_name} of {k.p_brand}\b") for k in kinds]
    made += [rules.make_rule(f"many of {b}", ["**/R/*.txt"], "warning", rf"{b}\b, 4\d pieces$") for b in sorted({k.p_brand for k in kinds})]
    path = F.concat(F.lower("p_type"), F.lit("/"), F.col("l_returnflag"), F.lit("/s"), F.col("l_suppkey").cast("string"), F.lit(".txt"))
    text = F.concat(F.lit("sold "), F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(", "), F.col("l_quantity").cast("int").cast("string"), F.lit(" pieces"))
    lines = li.join(part, li.l_partkey == part.p_partkey).select(path.alias("path"), F.col("l_orderkey").cast("int").alias("number"), text.alias("text"), F.col("l_linenumber").cast("int").alias("line_ord"))
    return rules.evaluate(lines, made).select("file", "line_start", "rule_id", "severity")


@query("""SELECT n_name || '/c' || c_custkey || '.txt' AS file, CAST(c_custkey AS INT) AS line_start, 'digits of ' || n_name AS rule_id, CASE WHEN n_nationkey % 2 = 0 THEN 'warning' ELSE 'error' END AS severity,
'Names of ' || n_name || chr(10) || 'are looked at.' AS message FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name LIKE '%' || (n_nationkey % 10)
UNION ALL SELECT n_name || '/c' || c_custkey || '.txt', CAST(c_custkey AS INT), 'round numbers', 'info', '' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name LIKE '%00'""")
def rule_documents(spark, d):
    """Rules that were written as documents: one for each region, of a rule for each of its nations and one for the model alone;
    and a rule for all."""
    nations = _table(spark, d, "nation").orderBy("n_nationkey").collect()  # 25
    texts: dict[int, str] = {}
    for n in nations:
        severity = "severity: error\n" if n.n_nationkey % 2 else ""
        rule = f'---\nname: digits of {n.n_name}\npaths: ["{n.n_name}/**"]\n{severity}pattern: "{n.n_nationkey % 10}$"\n---\n\nNames of {n.n_name}\nare looked at.\n\n'
        texts[n.n_regionkey] = texts.get(n.n_regionkey, "---\nname: manners\n---\nAsk the model.\n") + rule
    made = [r for k, t in texts.items() for r in rules.parse_rules(t, f"region-{k}")]
    made += rules.parse_rules('---\nname: round numbers\nseverity: info\npattern: " 00$|00$"\n---\n', "all")
    c, n = _table(spark, d, "customer"), _table(spark, d, "nation")
    path = F.concat(F.col("n_name"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    lines = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(path.alias("path"), F.col("c_custkey").cast("int").alias("number"), F.col("c_name").alias("text"), F.lit(1).alias("line_ord"))
    return rules.evaluate(lines, made).select("file", "line_start", "rule_id", "severity", "message")


# The one pattern of the detector that the documents hold, its quotes doubled for SQL.
GENERIC = r"(?i)(?:api[_-]?key|secret|token|passw(?:or)?d)[\"'']?\s*[:=]\s*[\"'']([A-Za-z0-9_\-+/=.]{16,})[\"'']"


# What is put into lines by their place: a secret of each of the other patterns, and near misses that are none.
PLANTED = {
    5: "key AKIA" + "Q7" * 8, 6: "AWS_SECRET_ACCESS_KEY = " + "aB3/" * 10, 7: "clone with ghp_" + "x9" * 18 + " please", 8: "-----BEGIN RSA PRIVATE KEY-----",
    9: "hook xoxb-" + "12-ab" * 3, 10: "pay sk_live_" + "Zz0" * 6, 11: "short AKIA" + "Q7" * 7, 12: "ghp_" + "x9" * 10, 13: "token = [redacted]",
}
SECRET_KINDS = [(5, "aws-access-key-id", "critical"), (6, "aws-secret-key", "critical"), (7, "github-token", "critical"), (8, "private-key", "critical"), (9, "slack-token", "error"), (10, "stripe-key", "critical")]
HIDDEN = {5: "key [redacted]", 6: "AWS_SECRET_ACCESS_KEY = [redacted]", 7: "clone with [redacted] please", 8: "[redacted]", 9: "hook [redacted]", 10: "pay [redacted]"}


@query(f"""WITH {LINES}, p AS (SELECT path, number, CASE number % 40 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in PLANTED.items())} ELSE text END AS text FROM lines)
SELECT path AS file, CAST(number AS INT) AS line_start, 'secret.generic-api-key' AS rule_id, 'error' AS severity,
replace(text, regexp_extract(text, '{GENERIC}', 1), '[redacted]') AS evidence FROM p WHERE regexp_matches(text, '{GENERIC}')
UNION ALL SELECT path, CAST(number AS INT), 'secret.' || name, severity, evidence FROM lines JOIN (VALUES {", ".join(f"({k}, '{n}', '{s}', '{HIDDEN[k]}')" for k, n, s in SECRET_KINDS)}) v(k, name, severity, evidence) ON number % 40 = k""")
def secret_scan(spark, d):
    text = F.col("text")
    for k, v in PLANTED.items():
        text = F.when(F.col("number") % 40 == k, v).otherwise(text)
    found = detect.detect_secrets(_lines(spark, d).withColumn("text", text))
    return found.select("file", "line_start", "rule_id", "severity", F.col("evidence")[0].alias("evidence"))


GLOBS = ["**/*.go", "src/src1/*.js", "src/src?/*", "src/**", "*.txt"]


@query(f"""WITH g(pat, rx) AS (VALUES ('**/*.go', '^(?:.*/)?[^/]*\\.go$'), ('src/src1/*.js', '^src/src1/[^/]*\\.js$'), ('src/src?/*', '^src/src[^/]/[^/]*$'), ('src/**', '^src/.*$'), ('*.txt', '^[^/]*\\.txt$'))
SELECT pat, count(*) AS n FROM (SELECT {PATH} AS path FROM documents), g WHERE regexp_matches(path, rx) GROUP BY pat""")
def glob_scope(spark, d):
    paths = _table(spark, d, "documents").select(_path().alias("path"))
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike("(?d)" + glob_regex(g)), g) for g in GLOBS]))
    return paths.select(F.explode(hits).alias("pat")).groupBy("pat").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, replace(p_name, ' ', '_') || '.go' AS file, CAST(p_size AS INT) AS line, p_type AS message FROM part WHERE p_partkey % 7 NOT IN (5, 6)""")
def lint_diag(spark, d):
    p = _table(spark, d, "part")
    k = F.col("p_partkey") % 7
    at = F.when(k == 5, ":x: ").when(k == 6, " ").when(k < 3, F.concat(F.lit(":"), F.col("p_size").cast("string"), F.lit(":7: "))).otherwise(F.concat(F.lit(":"), F.col("p_size").cast("string"), F.lit(": ")))
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".go"), at, F.col("p_type"))
    return detect.split_diagnostic(p.select("p_partkey", raw.alias("raw"))).select("p_partkey", "file", "line", "message")


SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def _line_findings(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem")
    severity = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "critical").otherwise("error")).when(F.col("l_returnflag") == "A", "warning").otherwise("info")
    return li.select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_linenumber").alias("line_start"), F.col("l_returnflag").alias("rule_id"), F.lit("c").alias("category"), severity.alias("severity"), F.col("l_discount").alias("confidence"), *SEQ)


FINDINGS_SQL = """f AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, l_linenumber AS line_start, l_returnflag AS rule_id, l_discount AS confidence,
CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'critical' ELSE 'error' END WHEN l_returnflag = 'A' THEN 'warning' ELSE 'info' END AS severity,
l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, line_start, rule_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n FROM f) WHERE n = 1)"""


@query(f"WITH {FINDINGS_SQL} SELECT file, line_start, rule_id, severity, l_orderkey, l_partkey FROM dd")
def findings_dedupe(spark, d):
    return findings.dedupe(_line_findings(spark, d), SEQ).select("file", "line_start", "rule_id", "severity", "l_orderkey", "l_partkey")


@query(f"""WITH {FINDINGS_SQL} SELECT file, line_start, rule_id, severity, confidence, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC,
confidence DESC, file, line_start, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rank FROM dd""")
def findings_rank(spark, d):
    ranked = findings.with_rank(findings.dedupe(_line_findings(spark, d), SEQ), SEQ, parts=8)
    return ranked.select("file", "line_start", "rule_id", "severity", "confidence", "rank")


@query(f"WITH {FINDINGS_SQL} SELECT severity, count(*) AS n, CAST(CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS INT) AS weight FROM f WHERE severity <> 'info' GROUP BY severity")
def severity_summary(spark, d):
    return findings.severity_summary(findings.visible(_line_findings(spark, d), ["critical", "error", "warning"]))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    return e.select(F.col("user_id").alias("repo_path"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), whole_seconds(F.col("ts")).cast("timestamp_ntz").alias("started_at"), (F.col("event_id") % 7).alias("findings_count"))


REVIEWS_SQL = "r AS (SELECT user_id AS repo_path, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, date_trunc('second', ts) AS started_at, event_id % 7 AS findings_count FROM events)"


@query(f"""WITH {REVIEWS_SQL} SELECT a.repo_path, a.id, a.findings_count, (SELECT count(*) FROM r c WHERE c.repo_path = a.repo_path) AS reviews FROM r a
WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.repo_path = a.repo_path AND (b.started_at > a.started_at OR b.started_at = a.started_at AND b.id > a.id))""")
def list_repos(spark, d):
    return latest_per_repo(_reviews(spark, d)).select("repo_path", "id", "findings_count", "reviews")


@query(f"WITH {REVIEWS_SQL} SELECT repo_path, id, findings_count, CAST(row_number() OVER (PARTITION BY repo_path ORDER BY started_at DESC, id DESC) AS INT) AS position FROM r")
def list_reviews(spark, d):
    return numbered_reviews(_reviews(spark, d), "repo_path").select("repo_path", "id", "findings_count", "position")


@query("""SELECT o_orderkey AS review_id, o_orderpriority AS mode, l_partkey, NULLIF(l_linenumber, 3) AS line_start, count(*) OVER (PARTITION BY o_orderkey) AS findings_count
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def get_review(spark, d):
    o = _table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("mode"))
    li = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review_id"), "l_partkey", F.expr("nullif(l_linenumber, 3)").alias("line_start"))
    return review_findings(o, li)


def _refs(spark: SparkSession, d: str) -> DataFrame:
    o, li = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "call").otherwise("use")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    return joined.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src_file"), F.col("o_orderpriority").alias("src_name"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst_file"), F.col("l_returnflag").alias("dst_name"), kind.alias("kind"), "l_orderkey")


REFS_SQL = "e AS (SELECT 'c' || o_custkey AS src_file, o_orderpriority AS src_name, 's' || l_suppkey AS dst_file, l_returnflag AS dst_name, CASE WHEN l_linenumber % 2 = 0 THEN 'call' ELSE 'use' END AS kind, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {REFS_SQL} SELECT DISTINCT src_file AS file, src_name AS name, kind FROM e WHERE dst_file = 's7' AND dst_name = 'R'")
def callers(spark, d):
    return graph.callers(_refs(spark, d), "s7", "R")


@query(f"WITH {REFS_SQL} SELECT DISTINCT dst_file AS file, dst_name AS name, kind FROM e WHERE src_file = 'c11' AND src_name = (SELECT min(o_orderpriority) FROM orders WHERE o_custkey = 11)")
def callees(spark, d):
    first = _table(spark, d, "orders").where("o_custkey = 11").agg(F.min("o_orderpriority")).head()[0]
    return graph.callees(_refs(spark, d), "c11", first or "")


@query(f"WITH {REFS_SQL} SELECT DISTINCT src_file, src_name, dst_file, dst_name, kind FROM e WHERE dst_file = 's9'")
def refs_into_file(spark, d):
    return graph.refs_into_file(_refs(spark, d), "s9")


@query(f"WITH {REFS_SQL} SELECT DISTINCT src_file AS file, src_name AS name, kind FROM e WHERE dst_file = 's6' AND dst_name = 'A'")
def type_uses(spark, d):
    s = _table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_path"), F.lit("A").alias("name"), F.lit("struct").alias("kind"), F.lit(1).alias("line"))
    return graph.type_uses(_refs(spark, d), s, "s6", "A")


@query("SELECT DISTINCT 'p' || l_partkey AS import_path FROM lineitem WHERE l_suppkey = 7")
def imports_of(spark, d):
    i = _table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file_path"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("import_path"))
    return graph.imports_of(i.distinct(), "s7")


@query(f"WITH {REFS_SQL} SELECT DISTINCT src_file AS path FROM e WHERE dst_file = 's5' AND dst_name = 'N' UNION SELECT 's5'")
def files_touching(spark, d):
    return graph.files_touching(_refs(spark, d), "s5", "N")


@query(f"""WITH {REFS_SQL}, p AS (SELECT DISTINCT src_file AS a, dst_file AS b FROM e), g AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
s AS (SELECT unnest(['c11', 'c25', 'c40', 'nowhere']) AS path), d1 AS (SELECT DISTINCT b AS path FROM g JOIN s ON a = path), d2 AS (SELECT DISTINCT b AS path FROM g JOIN d1 ON a = path)
SELECT path, CAST(min(distance) AS INT) AS distance FROM (SELECT path, 0 AS distance FROM s UNION ALL SELECT path, 1 FROM d1 UNION ALL SELECT path, 2 FROM d2) GROUP BY path""")
def impact_set(spark, d):
    return graph.impact_set(_refs(spark, d), ["c11", "./c25", "c40", "x/../nowhere", "", "/"])


@query("""SELECT c_custkey AS path, c_mktsegment AS language, count(o_orderkey) AS symbols, min(o_orderkey) AS first_symbol, count(DISTINCT o_orderpriority) AS imports, min(o_orderpriority) AS first_import FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def repo_index(spark, d):
    c, o = _table(spark, d, "customer"), _table(spark, d, "orders")
    f = c.select(F.lit("r").alias("repo_path"), F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("language"), F.lit("").alias("hash"))
    s = o.select(F.lit("r").alias("repo_path"), F.col("o_custkey").alias("file_path"), F.col("o_orderkey").cast("string").alias("name"), F.lit("func").alias("kind"), F.col("o_orderkey").cast("int").alias("line"))
    i = o.select(F.lit("r").alias("repo_path"), F.col("o_custkey").alias("file_path"), F.col("o_orderpriority").alias("import_path")).distinct()
    got = graph.repo_index(f, s, i)
    return got.select("path", "language", F.size("symbols").cast("long").alias("symbols"), F.get("symbols", F.lit(0)).line.cast("long").alias("first_symbol"), F.size("imports").cast("long").alias("imports"), F.get("imports", F.lit(0)).alias("first_import"))


@query("SELECT c_custkey AS path, o_orderpriority AS name, o_orderkey AS line FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def symbol_rows(spark, d):
    f = _table(spark, d, "customer").select(F.lit("r").alias("repo_path"), F.col("c_custkey").alias("path"))
    s = _table(spark, d, "orders").select(F.lit("r").alias("repo_path"), F.col("o_custkey").alias("file_path"), F.col("o_orderpriority").alias("name"), F.lit("func").alias("kind"), F.col("o_orderkey").alias("line"))
    return graph.symbol_rows(f, s).select("path", "name", "line")


@query(f"""WITH s AS (SELECT {PATH} AS path, sha256(text) AS hash FROM documents WHERE doc_id % 19 <> 0), c AS (SELECT {PATH} AS path, sha256(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 17 <> 0)
SELECT change, count(*) AS n, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS dirs FROM (SELECT coalesce(s.path, c.path) AS path, CASE WHEN c.hash IS NULL THEN 'deleted' WHEN s.hash IS NULL THEN 'added' ELSE 'changed' END AS change
FROM s FULL JOIN c ON s.path = c.path WHERE s.hash IS DISTINCT FROM c.hash) GROUP BY change""")
def stale_files(spark, d):
    docs = _table(spark, d, "documents")
    s = docs.where("doc_id % 19 <> 0").select(_path().alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    c = docs.where("doc_id % 17 <> 0").select(_path().alias("path"), F.sha2(text.cast("binary"), 256).alias("hash"))
    return sync.changed_files(s, c).groupBy("change").agg(F.count("*").alias("n"), F.count_distinct(dir_of(F.col("path"))).alias("dirs"))


@query("""WITH s AS (SELECT 'd' || (doc_id % 40) || '/' || doc_id AS path, sha256(text) AS hash FROM documents), c AS (SELECT path, CASE WHEN CAST(string_split(path, '/')[2] AS BIGINT) % 23 = 0 THEN '' ELSE hash END AS hash FROM s WHERE CAST(string_split(path, '/')[2] AS BIGINT) % 111 <> 0)
SELECT DISTINCT string_split(coalesce(s.path, c.path), '/')[1] AS dir FROM s FULL JOIN c ON s.path = c.path WHERE s.hash IS DISTINCT FROM c.hash""")
def stale_dirs(spark, d):
    path = F.concat(F.lit("d"), (F.col("doc_id") % 40).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    s = _table(spark, d, "documents").select("doc_id", path.alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    c = s.where("doc_id % 111 <> 0").withColumn("hash", F.when(F.col("doc_id") % 23 == 0, "").otherwise(F.col("hash")))
    return sync.stale_dirs(s, c)


@query("""SELECT 'c' || o_custkey AS src_file, 's' || l_suppkey AS dst_file, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3) GROUP BY ALL""")
def ref_validation(spark, d):
    e = _refs(spark, d).select(F.lit("r").alias("repo_path"), "src_file", F.lit("n").alias("src_name"), "dst_file", F.lit("n").alias("dst_name"), "kind")
    s = _table(spark, d, "supplier").where("s_suppkey % 10 <> 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_path"))
    c = _table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file_path"))
    symbols = s.union(c).select(F.lit("r").alias("repo_path"), "file_path", F.lit("n").alias("name"))
    return graph.dangling(e, symbols).groupBy("src_file", "dst_file").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, ch AS (SELECT DISTINCT source, 0 AS section, 0 AS a, '' AS b, 0 AS c, chr(10) AS chunk FROM lines
UNION ALL SELECT DISTINCT source, 1, -1, '', 0, '{context.DIFF.rstrip()}' || chr(10) FROM lines UNION ALL SELECT DISTINCT source, 1, 0, path, -1, '--- ' || path || chr(10) FROM lines
UNION ALL SELECT source, 1, 0, path, number, '+' || number || ' ' || text || chr(10) FROM lines),
cost AS (SELECT *, (strlen(chunk) + 3) // 4 AS cost FROM ch), run AS (SELECT *, sum(cost) OVER (PARTITION BY source, section ORDER BY a, b, c) AS run FROM cost)
SELECT source, count(*) AS chunks, CAST(sum(cost) AS BIGINT) AS tokens FROM run WHERE run <= 9000 - CASE section WHEN 1 THEN 1 ELSE 0 END GROUP BY source""")
def context_pack(spark, d):
    docs = _table(spark, d, "documents").select("source", _path().alias("path"), "text")
    lines = docs.select("source", "path", F.posexplode(diff.lines_of(F.col("text"))).alias("i", "text")).select("source", "path", (F.col("i") + 1).alias("number"), (F.col("i") + 1).alias("line_ord"), "text")
    shown = context.fit(context.chunks(lines, keys=["source"]), 9000, ["source"])
    return shown.groupBy("source").agg(F.count("*").alias("chunks"), F.sum("cost").alias("tokens"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '' ELSE 'f' || conv_id END AS file, CAST(turn % 4 AS INT) AS line_start, CASE WHEN role IN ('user') THEN 'error' ELSE 'warning' END AS severity,
CASE WHEN turn % 3 = 0 THEN 'llm' ELSE 'r' END AS rule_id, CAST(CASE WHEN turn % 2 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS confidence, turn % 5 <> 0 AND turn % 4 > 0 AND coalesce(text, '') <> '' AS valid FROM conversations""")
def parse_findings(spark, d):
    t = F.col("turn")
    entry = F.struct(
        F.when(t % 5 != 0, F.concat(F.lit("f"), F.col("conv_id").cast("string"))).alias("file"), (t % 4).cast("int").alias("line"), F.when(F.col("role") == "user", " ERROR ").otherwise("odd").alias("severity"),
        F.when(t % 3 != 0, "r").alias("rule_id"), F.col("text").alias("message"), F.when(t % 2 != 0, 0.25).alias("confidence"),
    )
    answers = _table(spark, d, "conversations").select("conv_id", "turn", F.lit(0).alias("ord"), F.to_json(F.array(entry)).alias("answer"))
    got = agent.candidates(answers, keep=["conv_id", "turn"])
    return got.select("conv_id", "turn", "file", "line_start", "severity", "rule_id", "confidence", "valid")


@query(f"""WITH {LINES}, n AS (SELECT doc_id, max(number) AS n FROM lines GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN quality + toxic * 3 + 1 <= n.n THEN 'error' ELSE 'info' END AS severity, CAST(CASE WHEN quality + toxic * 3 + 1 <= n.n THEN 0.6 ELSE 0.2 END AS DOUBLE) AS confidence, quality + toxic * 3 + 1 > coalesce(n.n, 0) AS demoted
FROM labels l LEFT JOIN n ON n.doc_id = l.doc_id""")
def verify_findings(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    lines = docs.select(F.col("file").alias("path"), F.posexplode(diff.lines_of(F.col("text"))).alias("i", "text")).select("path", (F.col("i") + 1).alias("number"))
    found = _table(spark, d, "labels").select(F.col("doc_id").alias("file"), (F.col("quality") + F.col("toxic") * 3 + 1).alias("line_start"), F.lit("error").alias("severity"), F.lit(0.5).alias("confidence"), F.lit(False).alias("demoted"))
    return agent.verify(found, lines).select(F.col("file").alias("doc_id"), "severity", "confidence", "demoted")


@query("""SELECT CAST(k AS BIGINT) AS k, n_name AS name FROM (SELECT n_nationkey % 3 AS k, n_name, row_number() OVER (PARTITION BY n_nationkey % 3 ORDER BY (n_regionkey = 0) DESC, n_nationkey) AS n FROM nation WHERE n_nationkey % 4 <> 1) WHERE n = 1""")
def route_provider(spark, d):
    p = _table(spark, d, "nation").select((F.col("n_nationkey") % 3).cast("long").alias("k"), F.col("n_name").alias("name"), (F.col("n_regionkey") == 0).alias("is_local"), (F.col("n_nationkey") % 4 != 1).alias("available"), F.col("n_nationkey").alias("ord"))
    return agent.choose_provider(p, ["k"]).select("k", "name")


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS system, p_type AS prompt FROM part), f AS (SELECT p_brand AS system, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS prompt, p_name || '!' AS response, p_partkey AS ord FROM part),
g AS (SELECT system, prompt, arg_min(response, ord) AS response, min(ord) AS ord FROM f GROUP BY ALL)
SELECT p.id, CASE WHEN a.ord < coalesce(b.ord, a.ord + 1) THEN a.response ELSE b.response END AS response FROM p LEFT JOIN g a ON a.system = p.system AND a.prompt = p.prompt LEFT JOIN g b ON b.system = p.system AND b.prompt = ''""")
def fixture_lookup(spark, d):
    part = _table(spark, d, "part")
    p = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("system"), F.col("p_type").alias("prompt"))
    f = part.select(F.col("p_brand").alias("system"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("prompt"), F.concat("p_name", F.lit("!")).alias("response"), F.col("p_partkey").alias("ord"))
    return agent.lookup_fixtures(p, f).select("id", "response")


@query("SELECT event_type AS key, arg_max(value, user_id * 10000000 + event_id) AS value FROM events GROUP BY event_type")
def config_merge(spark, d):
    e = _table(spark, d, "events").select(F.col("event_type").alias("key"), "value", (F.col("user_id") * 10_000_000 + F.col("event_id")).alias("scope_rank"))
    return config.merge_frame(e)


@query(f"""WITH docs AS (SELECT doc_id, {PATH} AS path, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls, doc_id % 40 AS s0, CASE WHEN doc_id % 4 <= 0 THEN 3 ELSE doc_id % 4 END AS r FROM documents),
w AS (SELECT *, greatest(s0, 1) AS s, len(ls) AS n FROM docs), b AS (SELECT *, CASE WHEN greatest(s - r, 1) > n THEN greatest(n - r, 1) ELSE greatest(s - r, 1) END AS a, CASE WHEN greatest(s - r, 1) > n THEN n ELSE least(s + r, n) END AS z FROM w)
SELECT path, CAST(unnest(range(a, z + 1)) AS INT) AS number, unnest(ls[a:z]) AS text FROM b""")
def file_window(spark, d):
    docs = _table(spark, d, "documents").select(_path().alias("path"), "text", (F.col("doc_id") % 40).alias("line_start"), F.lit(0).alias("line_end"), (F.col("doc_id") % 4).alias("radius"))
    return context.file_window(docs)


@query("""SELECT page_id, h || '/' || page_id AS clean, page_id % 3 <> 2 AS safe FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/b' WHEN 1 THEN 'b' ELSE '../b' END AS h FROM pages)""")
def clean_paths(spark, d):
    k = F.col("page_id") % 3
    raw = F.concat(F.when(k == 0, "a//./b/c/../").when(k == 1, "a\\..\\b/.//").otherwise("a/../../b/"), F.col("page_id").cast("string"), F.lit("/."))
    return _table(spark, d, "pages").select("page_id", clean_path(raw).alias("clean"), is_safe(raw).alias("safe"))


@query(f"SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM (SELECT {PATH} AS path FROM documents) WHERE path LIKE '%.go'")
def changed_dirs(spark, d):
    return detect.changed_dirs(_table(spark, d, "documents").select(_path().alias("path")))


@query("SELECT doc_id, (strlen(text) + 3) // 4 AS tokens FROM documents")
def token_estimate(spark, d):
    return _table(spark, d, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' ELSE 'error' END AS severity, CAST(CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS INT) AS weight FROM orders""")
def severity_normal(spark, d):
    k = F.col("o_orderkey") % 4
    s = normal_severity(F.when(k == 0, " Critical").when(k == 1, "INFO ").when(k == 2, F.col("o_orderpriority")).otherwise("error"))
    return _table(spark, d, "orders").select("o_orderkey", s.alias("severity"), severity_weight(s).alias("weight"))


@query("""WITH n AS (SELECT c_custkey AS k, 'n' || c_nationkey || '/c' AS f, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS x FROM customer)
SELECT f || k || '.go' AS src_file, v.src AS src_name, f || v.to_ || '.go' AS dst_file, v.dst AS dst_name, v.kind FROM n,
LATERAL (VALUES ('T' || k, x, 'T' || x, 'use'), ('T' || k || '.Go', k, 'T' || k, 'use'), ('T' || k || '.Go', k, 'C' || k, 'use'), ('T' || k || '.Go', x, 'F' || x, 'call'), ('F' || k, k, 'C' || k, 'use'),
('V' || k, k, 'F' || k, 'call'), ('G' || k, x, 'T' || x || '.Go', 'call')) v(src, to_, dst, kind) WHERE v.dst IS NOT NULL""")
def graph_index(spark, d):
    """A file for each customer, a folder for each nation: a type that holds the next one, a method, a constant, a function
    with a local of the next function's name, an initialised variable and a call of a method by its type."""
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dir"))
    c = c.withColumn("x", F.lead("k").over(W.partitionBy("dir").orderBy("k")))
    lines = [
        "package p", 'import "fmt"', "const C@ = 1", "type T@ struct {#\tnext *T$#\tsize int\n}", "func (t *T@) Go() int {\n\tfmt.Println(C@, t.size)#\tF$()\n\treturn t.size\n}",
        "func F@() int {#\tF$ := C@#\t_ = F$\n\treturn C@\n}", "var V@ = F@()", "#func G@() { T$.Go(nil); C@ := 2; _ = C@ }",
    ]
    text = F.lit("\n\n".join(lines) + "\n")
    text = F.when(F.col("x").isNull(), F.regexp_replace(text, r"#[^\n]*(?=\n)", "")).otherwise(F.replace(text, F.lit("#"), F.lit("\n")))
    text = F.replace(F.replace(text, F.lit("@"), F.col("k").cast("string")), F.lit("$"), F.coalesce(F.col("x").cast("string"), F.lit("")))
    src = c.select(F.concat("dir", F.lit("/c"), F.col("k").cast("string"), F.lit(".go")).alias("path"), text.cast("binary").alias("content"))
    rows = files.index_rows(files.source_files(src, "repo"))
    return rows.where("record = 'ref'").select(F.col("file").alias("src_file"), F.col("name").alias("src_name"), "dst_file", "dst_name", "kind")


REVIEW_SQL = f"""WITH {LINES}, {RULE_SQL}, s AS (SELECT path, number, {SEEDED} AS text FROM lines),
f AS (SELECT 0 AS stage, 0 AS k, path AS file, number, 'secret.generic-api-key' AS rule_id, 'error' AS severity FROM s WHERE regexp_matches(text, '{GENERIC}')
UNION ALL SELECT 1, r.k, path, number, r.name, r.severity FROM s, r WHERE regexp_matches(path, scope) AND regexp_matches(s.text, pattern)),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, number, rule_id ORDER BY stage, k, number) AS n FROM f) WHERE n = 1)
SELECT file, CAST(number AS INT) AS line_start, rule_id, severity, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, file, number, stage, k) AS rank FROM dd"""


@query(REVIEW_SQL)
def review(spark, d):
    lines = _seeded(_lines(spark, d))
    found, _, _ = detect.run_detectors(lines, ["secrets"])
    found = findings.union_all([*found, rules.evaluate(lines, _rules())])
    return findings.with_rank(findings.dedupe(found), parts=16).select("file", "line_start", "rule_id", "severity", "rank")


@query("""SELECT replace(p_name, ' ', '_') || '.go' AS file, CAST(p_size AS INT) AS line_start, 'go-vet' AS rule_id, 'lint' AS category, 'warning' AS severity, 'analyzer' AS source, p_type AS message, CAST(1 AS DOUBLE) AS confidence
FROM part WHERE p_partkey % 7 NOT IN (5, 6)""")
def lint_findings(spark, d):
    """Lines of a linter, some with the repository's path before the file, some with ``./``, some that say nothing."""
    p, k = _table(spark, d, "part"), F.col("p_partkey") % 7
    at = F.when(k == 5, ":x: ").when(k == 6, " ").otherwise(F.concat(F.lit(":"), F.col("p_size").cast("string"), F.when(k < 3, ":7: ").otherwise(": ")))
    lead = F.when(k % 3 == 0, "/work/tree/").when(k % 3 == 1, "./").otherwise("")
    raw = F.concat(lead, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".go"), at, F.col("p_type"))
    got = detect.lint_findings(p.select(raw.alias("raw"), F.col("p_partkey").alias("ord")), "/work/tree")
    return got.select("file", "line_start", "rule_id", "category", "severity", "source", "message", "confidence")


# An index of customers in a directory for each nation and suppliers in one of their own, of which some nations are replaced
# by rows of returned goods alone and others deleted.
STORED_SQL = """o AS (SELECT l_suppkey, l_returnflag, o_orderpriority, o_custkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
e AS (SELECT DISTINCT 'n' || c_nationkey || '/c' || o_custkey AS src_file, o_orderpriority AS src_name, 's/s' || l_suppkey AS dst_file, l_returnflag AS dst_name FROM o
WHERE c_nationkey % 5 <> 4 AND (c_nationkey % 3 <> 0 OR l_returnflag = 'R'))"""


def _stored_index(spark: SparkSession, d: str) -> Store:
    """A store of its own in the shared folder, after a replacement, a replacement of part and deletions."""
    store = Store(spark, f"{shared_dir(spark)}/mergelens/index-query-{uuid.uuid4().hex}")
    o, li, c, s = (_table(spark, d, t) for t in ("orders", "lineitem", "customer", "supplier"))
    own = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    placed = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey", "c_custkey", "o_orderpriority")
    bought = li.join(placed, li.l_orderkey == placed.o_orderkey).select("c_nationkey", "c_custkey", "o_orderpriority", "l_suppkey", "l_returnflag")
    bought = bought.repartition("c_custkey").distinct()  # a file's edges side by side
    file = F.concat(own, F.lit("/c"), F.col("c_custkey").cast("string"))
    goods = F.concat(F.lit("s/s"), F.col("s_suppkey").cast("string"))
    repo = F.lit("r").alias("repo_path")
    ends = bought.select("c_nationkey", file.alias("src_file"), F.col("o_orderpriority").alias("src_name"), F.concat(F.lit("s/s"), F.col("l_suppkey").cast("string")).alias("dst_file"), F.col("l_returnflag").alias("dst_name"))
    ends = cut(ends.sortWithinPartitions("src_file", "src_name"), "query-edges")
    edges = ends.select(repo, own.alias("dir"), "src_file", "src_name", "dst_file", "dst_name", F.lit("call").alias("kind"), "c_nationkey")
    files = c.select(repo, own.alias("dir"), file.alias("path"), "c_nationkey").union(s.select(repo, F.lit("s").alias("dir"), goods.alias("path"), F.lit(None)))
    flags = F.array(*[F.lit(r.dst_name) for r in edges.select("dst_name").distinct().collect()])  # R, A and N
    symbols = edges.select(repo, "dir", F.col("src_file").alias("file_path"), F.col("src_name").alias("name"), "c_nationkey").distinct()
    symbols = cut(symbols, "query-symbols")
    sold = s.select(repo, F.lit("s").alias("dir"), goods.alias("file_path"), F.explode(flags).alias("name"), F.lit(None).alias("c_nationkey"))

    def put(where: str, names: list[str]) -> None:
        part = {"index_files": files.where(where), "index_symbols": symbols.union(sold).where(f"c_nationkey is null or {where}"), "index_refs": edges.where(where)}
        store.replace_dirs("r", names, {
            "index_files": part["index_files"].select("repo_path", "dir", "path", F.lit("go").alias("language"), F.sha2("path", 256).alias("hash"), F.lit(None).cast("timestamp").alias("updated_at")),
            "index_symbols": part["index_symbols"].select("repo_path", "dir", "file_path", "name", F.lit("func").alias("kind"), F.lit(1).alias("line")),
            "index_refs": part["index_refs"].drop("c_nationkey"),
            "index_imports": part["index_files"].select("repo_path", "dir", F.col("path").alias("file_path"), F.lit("os").alias("import_path")),
        }, ordered=["index_refs"])

    nations = sorted(r.c_nationkey for r in c.select("c_nationkey").distinct().collect())  # a row a directory
    put("true", ["s", *[f"n{k}" for k in nations]])
    edges = cut(edges.where("dst_name = 'R' and c_nationkey % 3 = 0"), "query-returned")
    put("c_nationkey % 3 = 0", [f"n{k}" for k in nations if k % 3 == 0])
    store.delete_dirs("r", *[f"n{k}" for k in nations if k % 5 == 4])
    return store


def _customer(spark: SparkSession, d: str) -> str:
    """The file of the first customer of the nations 1 and 16."""
    first = _table(spark, d, "customer").where("c_nationkey % 15 = 1").agg(F.min_by("c_nationkey", "c_custkey").alias("n"), F.min("c_custkey").alias("c")).head()
    return f"n{first.n}/c{first.c}"


@query(f"WITH {STORED_SQL} SELECT src_file, count(*) AS n, count(DISTINCT dst_file) AS files FROM e GROUP BY src_file")
def index_store(spark, d):
    """Edges of a stored index after replacements and deletions, read from its generations once they have been compacted."""
    store = _stored_index(spark, d)
    store.index.compact()
    pairs = store.index.read("index_refs", "r").groupBy("src_file", "dst_file").agg(F.count("*").alias("n"))
    return pairs.groupBy("src_file").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


@query(f"""WITH {STORED_SQL}, i AS (SELECT DISTINCT src_file AS a, dst_file AS b FROM e), g AS (SELECT a, b FROM i UNION SELECT b, a FROM i), d1 AS (SELECT DISTINCT b AS path FROM g WHERE a = 's/s7'),
d2 AS (SELECT DISTINCT b AS path FROM g JOIN d1 ON a = path), m AS (SELECT path, min(x) AS x FROM (SELECT 's/s7' AS path, 0 AS x UNION ALL SELECT path, 1 FROM d1 UNION ALL SELECT path, 2 FROM d2) GROUP BY path)
SELECT 'caller' AS what, src_file AS file, src_name AS name FROM e WHERE dst_file = 's/s7' AND dst_name = 'R' UNION ALL SELECT 'callee', dst_file, dst_name FROM e WHERE src_name = '1-URGENT' AND src_file = (SELECT 'n' || c_nationkey || '/c' || c_custkey FROM customer WHERE c_nationkey % 15 = 1 ORDER BY c_custkey LIMIT 1)
UNION ALL SELECT 'import', 's/s7', 'os' UNION ALL SELECT 'reached', path, CAST(x AS VARCHAR) FROM m""")
def index_lookups(spark, d):
    """Lookups in a stored index of several generations: callers, callees, imports and the impact set over its links."""
    index = _stored_index(spark, d).index
    row = lambda df, what, file, name: df.select(F.lit(what).alias("what"), F.col(file).alias("file"), F.col(name).cast("string").alias("name"))
    out = row(index.callers("r", "s/s7", "R"), "caller", "file", "name").union(row(index.callees("r", _customer(spark, d), "1-URGENT"), "callee", "file", "name"))
    return out.union(row(index.imports_of("r", "s/s7").withColumn("file", F.lit("s/s7")), "import", "file", "import_path")).union(row(index.impact_set("r", ["./s/s7"]), "reached", "path", "distance"))


@query("""WITH r AS (SELECT o_orderstatus AS id, l_returnflag AS rule_id, l_linenumber AS line_start, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'P'))
SELECT id, 's' || l_suppkey AS file, CAST(NULLIF(line_start, 3) AS INT) AS line_start, rule_id, count(*) AS n, (SELECT count(*) FROM r q WHERE q.id = r.id) AS findings_count FROM r GROUP BY ALL""")
def stored_reviews(spark, d):
    """Two reviews saved with their findings and read by id."""
    store = Store(spark, f"{shared_dir(spark)}/mergelens/reviews-query-{uuid.uuid4().hex}")
    li, o = _table(spark, d, "lineitem"), _table(spark, d, "orders")
    out, at = None, datetime(2024, 1, 1)
    for status in ("F", "P"):
        rows = li.join(o.where(F.col("o_orderstatus") == status), li.l_orderkey == o.o_orderkey)
        line = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber"))
        found = rows.select(*findings.finding(rule_id=F.col("l_returnflag"), category=F.lit("rule"), severity=F.lit("info"), file=F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), line_start=line))
        store.save_review({"id": status, "repo_path": "/r", "mode": "offline", "started_at": at, "finished_at": at}, found)
        head, got = store.get_review(status, "/r")
        got = got.groupBy("file", "line_start", "rule_id").agg(F.count("*").alias("n")).select(F.lit(status).alias("id"), "file", "line_start", "rule_id", "n", F.lit(head["findings_count"]).cast("long").alias("findings_count"))
        out = got if out is None else out.union(got)
    return out


@query(f"""WITH {REFS_SQL}, p AS (SELECT DISTINCT src_file AS a, dst_file AS b FROM e), g AS (SELECT a, b FROM p UNION SELECT b, a FROM p), d1 AS (SELECT DISTINCT b AS path FROM g WHERE a = 's3'),
m AS (SELECT path, min(x) AS x FROM (SELECT 's3' AS path, 0 AS x UNION ALL SELECT path, 1 FROM d1 UNION ALL SELECT b, 2 FROM g JOIN d1 ON a = path) GROUP BY path)
SELECT path, CAST(x AS INT) AS distance, c_name AS code FROM m JOIN customer ON path = 'c' || c_custkey WHERE x > 0""")
def impact_context(spark, d):
    """What a change reaches, with the code that there is."""
    code = _table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_name").alias("code"))
    return graph.context_files(graph.impact_set(_refs(spark, d), ["s3"]), code)


@query(f"""WITH {LINES}, a AS (SELECT source, path, number, text FROM lines WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')), r AS (SELECT source, path, text FROM lines WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')),
c AS (SELECT DISTINCT source, 0 AS section, chr(10) AS chunk FROM a UNION ALL SELECT DISTINCT source, 1, '{context.DIFF.rstrip()}' || chr(10) FROM a UNION ALL SELECT DISTINCT source, 1, '--- ' || path || chr(10) FROM a
UNION ALL SELECT source, 1, '+' || number || ' ' || text || chr(10) FROM a UNION ALL SELECT DISTINCT source, 2, '{context.RELATED.rstrip()}' || chr(10) FROM r UNION ALL SELECT DISTINCT source, 2, '--- ' || path || ' (distance 1)' || chr(10) FROM r
UNION ALL SELECT source, 2, text || chr(10) FROM r WHERE text <> '')
SELECT source, CAST(section AS INT) AS section, count(*) AS chunks, CAST(sum((strlen(chunk) + 3) // 4) AS BIGINT) AS tokens FROM c GROUP BY ALL""")
def context_related(spark, d):
    """All chunks of a pack for each source: its English documents as the change, the others as related code."""
    docs = _table(spark, d, "documents").select("source", "lang", _path().alias("path"), "text")
    lines = docs.where("lang = 'en'").select("source", "path", F.posexplode(diff.lines_of(F.col("text"))).alias("i", "text")).select("source", "path", (F.col("i") + 1).alias("number"), (F.col("i") + 1).alias("line_ord"), "text")
    related = docs.where("lang <> 'en'").select("source", "path", F.lit(1).alias("distance"), F.col("text").alias("code"))
    parts = context.chunks(lines, related, ["source"])
    return parts.groupBy("source", "section").agg(F.count("*").alias("chunks"), F.sum(estimate_tokens(F.col("chunk"))).alias("tokens"))
