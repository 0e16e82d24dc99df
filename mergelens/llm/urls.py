"""URL filters: rules by host and path, and a path-template tree for what no rule decides.

The tree of a host has a level for each path segment. A segment that varies (digits, hexadecimal, long
tokens) becomes a wildcard of its class at once. At each level a literal branch whose children and labels don't differ
statistically from those of its siblings taken together is merged with them under ``*``; comparing each branch with the
rest instead of with each other keeps the work in proportion to the branches. A template is rejected by the share of
labelled bad pages under it, smoothed towards the share among all labelled pages. Where none of its pages has a label, it
goes by the branch above it or by the same template elsewhere, but only where the labels there agree among themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm._store import materialise

#: (host, path prefix, verdict); an empty path fits every path.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


#: Where a host has fewer different segments than this, they are its sections and stay as they are.
VARIANTS = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null and for a url without ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    ok = url.isNotNull() & (at > 0)
    return F.when(ok, host).otherwise(""), F.when(ok, path).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule, by host and path together, that fits, and its verdict; null where none does. A rule fits its
    host and all subdomains where the path starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def generalise(segment: Column) -> Column:
    """A varying segment as the wildcard of its class, its extension kept; a literal one as it is."""
    ext = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^(?=[^g-zG-Z]*[0-9])[0-9a-fA-F-]{8,}$"), "{h}")
        .when(stem.rlike(r"[0-9]") | (F.length(stem) > 24), "{t}")
        .otherwise(stem)
    )
    return F.concat(kind, ext)


def _common(pages: DataFrame) -> DataFrame:
    """host, up, skip, whole: how many segments the paths under each branch have in common from where they stand, and whether
    that is all they have. The least and the greatest of them have no more in common than all."""
    rest = F.slice("segs", F.col("at") + 1, F.size("segs"))
    ends = pages.groupBy("host", "up").agg(F.min(rest).alias("low"), F.max(rest).alias("high"))
    short = F.least(F.size("low"), F.size("high"))
    alike = F.transform(F.sequence(F.lit(1), short), lambda k: F.element_at("low", k) == F.element_at("high", k))
    at = F.array_position(alike, F.lit(False)).cast("int")
    whole = F.col("low") == F.col("high")
    return ends.select("host", "up", F.when(at > 0, at - 1).otherwise(short).alias("skip"), whole.alias("whole"))


def _merged(tree: DataFrame, z: float, z_labels: float, label: str) -> DataFrame:
    """host, up, seg, merged: what each branch is called after its like ones have been merged under ``*``. Their labels are
    held to be alike only within ``z_labels`` deviations: few labels would hardly ever differ by more.

    Of each branch: its rows, labels and bad labels, and how far its children lie from those of its siblings; by aggregates
    and joins, which deal out a host of many branches, where a window would hold it in one task.
    """
    kids = tree.groupBy("host", "up", "seg", "child").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    kids = materialise(kids, label)
    at = kids.groupBy("host", "up").agg(F.sum("n").alias("level"), F.sum("labelled").alias("all_l"), F.sum("bad").alias("all_b"))
    at_child = kids.groupBy("host", "up", "child").agg(F.sum("n").alias("all_child"))
    at_seg = kids.groupBy("host", "up", "seg").agg(F.sum("n").alias("own"))
    at_up = at_seg.groupBy("host", "up").agg(F.count("*").alias("branches"))
    kids = kids.join(at_child, ["host", "up", "child"]).join(at_seg, ["host", "up", "seg"]).join(at, ["host", "up"]).join(at_up, ["host", "up"])
    kids = kids.withColumn("rest", F.col("level") - F.col("own"))
    p, q = F.col("n") / F.col("own"), (F.col("all_child") - F.col("n")) / F.greatest(F.col("rest"), F.lit(1))
    both = F.col("all_child") / (F.col("own") + F.col("rest"))
    apart = F.abs(p - q) > z * F.sqrt(both * (1 - both) * (1 / F.col("own") + 1 / F.greatest(F.col("rest"), F.lit(1)))) + 1e-9
    branch = kids.groupBy("host", "up", "seg").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), *[F.max(c).alias(c) for c in ("rest", "all_l", "all_b", "branches")], F.max(apart).alias("apart"))
    l_, b_ = F.col("l"), F.col("b")
    branch = branch.withColumns({"l2": F.col("all_l") - l_, "b2": F.col("all_b") - b_})
    pool = (b_ + F.col("b2")) / F.greatest(l_ + F.col("l2"), F.lit(1))
    differs = F.abs(b_ / F.greatest(l_, F.lit(1)) - F.col("b2") / F.greatest(F.col("l2"), F.lit(1))) > z_labels * F.sqrt(pool * (1 - pool) * (1 / F.greatest(l_, F.lit(1)) + 1 / F.greatest(F.col("l2"), F.lit(1)))) + 1e-9
    unlike = (l_ > 0) & (F.col("l2") > 0) & differs
    known = (l_ > 0) != (F.col("l2") > 0)  # labels on one side alone tell nothing of the other
    keep = (F.col("branches") < VARIANTS) | F.col("apart") | unlike | known | F.col("seg").rlike(r"^(\{|$)")
    return branch.select("host", "up", "seg", F.when(keep, F.col("seg")).otherwise("*").alias("merged"))


def templates(pages: DataFrame, z: float = 2.6, z_labels: float = 1.9) -> DataFrame:
    """(host, segs, n, labelled, bad) to the same with ``up``: the tree of each host after merging.

    ``pages`` has one row for each host and generalised path (``segs``, an array of any length) with the counts n, labelled
    and bad. ``up`` is the template, each segment after a slash, and a last slash for the path's end. What all paths under
    a branch have in common is passed over at once, so the rounds are as many as a path has forks, however long it is.
    """
    # a path ends in a segment of its own, ""
    tree = pages.withColumns({"path": F.col("segs"), "segs": F.array_append("segs", F.lit("")), "up": F.lit(""), "at": F.lit(0)})
    tree, done, i = materialise(tree, "urls-tree-0"), [], 0
    while True:
        i += 1
        known = materialise(_common(tree), f"urls-common-{i}")
        tree = tree.join(known, ["host", "up"])
        passed = F.array_join(F.transform(F.slice("segs", F.col("at") + 1, F.col("skip")), lambda s: F.concat(F.lit("/"), s)), "")
        tree = tree.withColumns({"up": F.concat("up", passed), "at": F.col("at") + F.col("skip")}).drop("skip")
        tree = materialise(tree, f"urls-passed-{i}")
        done.append(tree.where("whole").select("host", "path", "n", "labelled", "bad", "up"))
        tree = tree.where("not whole").drop("whole")
        if tree.isEmpty():
            break
        tree = tree.withColumn("seg", F.get("segs", F.col("at"))).withColumn("child", F.coalesce(F.get("segs", F.col("at") + 1), F.lit("")))
        grown = tree.join(_merged(tree, z, z_labels, f"urls-kids-{i}"), ["host", "up", "seg"])
        grown = grown.withColumns({"up": F.concat_ws("/", "up", "merged"), "at": F.col("at") + 1})
        grown = materialise(grown.select("host", "segs", "path", "n", "labelled", "bad", "up", "at", (F.col("seg") == "").alias("ends")), f"urls-grown-{i}")
        done.append(grown.where("ends").select("host", "path", "n", "labelled", "bad", "up"))
        tree = grown.where("not ends").drop("ends")
        if tree.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.withColumnRenamed("path", "segs")


def _pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """l, b, squares, parts over ``keys`` of rows with labels l and bad ones b."""
    return rows.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.sum(F.col("b") * F.col("b") / F.col("l")).alias("squares"), F.count("*").alias("parts"))


def _agree(z: float) -> Column:
    """Whether the shares of bad labels that ``_pooled`` has put together are alike: by Pearson's statistic, which is about
    as large as the number of parts where they are."""
    p, free = F.col("b") / F.col("l"), F.col("parts") - 1
    spread = (F.col("squares") - F.col("b") * F.col("b") / F.col("l")) / (p * (1 - p))
    return (F.col("b") == 0) | (F.col("b") == F.col("l")) | (spread <= free + z * F.sqrt(2 * free) + 1e-9)


def domain_of(host: Column) -> Column:
    """The last two names of a host."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def scores(tree: DataFrame, prior: float, prior_weight: float, z: float = 2.6, domains: int = 3) -> DataFrame:
    """host, up, bad_share, evidence of each template that ``templates`` made.

    The share is that of the template's own labels. Without any it is that of the nearest branch above it that has some, the
    host at last, where the labelled templates of that branch agree; else that of the same template on all hosts, where it
    has labels in ``domains`` domains or more and these agree; else the prior. Each is smoothed towards the next that there is.
    """
    leaf = materialise(tree.groupBy("host", "up").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")), "urls-leaves")
    known, blank = leaf.where("l > 0"), leaf.where("l = 0").select("host", "up")
    # a branch by a hash of the names that lead to it, each made of the one before
    names = F.slice(F.split("up", "/"), F.lit(2), F.size(F.split("up", "/")))
    lead = F.aggregate(names, F.array(F.lit(0).cast("long")), lambda acc, s: F.array_append(acc, F.xxhash64(F.element_at(acc, -1), s)))
    above = lambda df: df.select("*", F.posexplode(lead).alias("depth", "branch"))
    branches = _pooled(above(known), ["host", "branch"])
    near = above(blank).join(branches, ["host", "branch"]).groupBy("host", "up").agg(F.max_by(F.struct("l", "b", "squares", "parts"), "depth").alias("x"))
    near = near.select("host", "up", "x.*").where(_agree(z)).select("host", "up", F.col("l").alias("l1"), F.col("b").alias("b1"))
    by_domain = known.groupBy("up", domain_of(F.col("host")).alias("domain")).agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    far = _pooled(by_domain, ["up"]).where((F.col("parts") >= domains) & _agree(z)).select("up", F.col("l").alias("l2"), F.col("b").alias("b2"))
    got = leaf.join(near, ["host", "up"], "left").join(far, "up", "left")
    which = F.when(F.col("l") > 0, "template").when(F.col("l1") > 0, "branch").when(F.col("l2") > 0, "pattern").otherwise("none")
    smooth = lambda l, b, towards: F.when(F.col(l) > 0, (F.col(b) + prior_weight * towards) / (F.col(l) + prior_weight)).otherwise(towards)  # noqa: E731, E741
    elsewhere = smooth("l2", "b2", F.lit(prior))
    share = F.when(F.col("l") > 0, smooth("l", "b", elsewhere)).otherwise(smooth("l1", "b1", elsewhere))
    return got.select("host", "up", share.alias("bad_share"), which.alias("evidence"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labels: DataFrame | None = None, prior_weight: float = 5.0, purity: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, template, bad_share, evidence, verdict of every row of ``pages``.

    The verdict is the rule's where one fits. Elsewhere it is ``block`` where the page's template has a smoothed share of
    bad labels of ``purity`` or more, else ``allow``; so all pages of a template that no rule decides are judged alike. What a
    template without labels goes by is said in ``scores``; without evidence (``none``) it is allowed. Labels are
    ``labels`` (page_id, bad 0/1), one row a page, or, where none are given, the rules' own verdicts on the pages that they
    decide. The prior is the share of bad labels in all pages, below ``purity``; what a share is smoothed towards counts as
    ``prior_weight`` labels more. Null and unparsable urls have an empty host and path and are allowed; repeated rows are judged alike; an
    empty table gives an empty one.
    """
    host, path = split_url(F.col(url_col))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    df = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("said", said)
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    df = df.withColumn("segs", F.transform(segments, generalise))
    if labels is None:
        df = df.withColumn("bad", (F.col("said") == "block").cast("int"))
    else:
        one = labels.groupBy(F.col(labels.columns[0]).alias("page_id")).agg(F.max(labels.columns[1]).cast("int").alias("bad"))
        df = df.join(one, "page_id", "left")
    counted = df.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counted = materialise(counted, "urls-paths")
    tree = materialise(templates(counted), "urls-templates")
    got = counted.agg(F.sum("labelled"), F.sum("bad")).head()
    prior = min((got[1] or 0) / got[0] if got[0] else 0.0, purity * 0.999)
    scored = tree.select("host", "segs", "up").join(scores(tree, prior, prior_weight), ["host", "up"])
    scored = materialise(scored.select("host", "segs", F.concat("host", F.regexp_replace("up", "/$", "")).alias("template"), "bad_share", "evidence"), "urls-scored")
    df = df.join(scored, ["host", "segs"], "left")
    verdict = F.coalesce("said", F.when((F.col("host") != "") & (F.col("bad_share") >= purity), "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", "template", "bad_share", "evidence", verdict.alias("verdict"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
    return got.select("page_id", "host", "path", "rule", "verdict", "template", "bad_share", "evidence")
