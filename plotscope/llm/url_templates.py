"""URL verdicts by rules and, where no rule fits, by a path-template tree.

Per host, the paths of all URLs form a tree of segments. Segments that vary (numbers, long
hexadecimal runs, or one of very many rare siblings) become wildcards, and siblings
whose labelled rates do not differ significantly from the others' are merged. A template is
rejected when the smoothed share of blocked URLs among its labelled ones is high; with few
labels of its own it leans on the template above it, its host, the host's domain and all
hosts, in this order.

The tree is built level by level from counts of distinct paths, so a host with most of all
URLs is a few counted rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotscope.llm.common import cut_lineage

Rule = tuple[str, str, str]

#: Where ``segments`` cuts unless told otherwise; the tree takes whole paths.
DEPTH = 6
#: With more siblings than this, those under RARE of their parent's URLs are a wildcard, but
#: not those whose labelled rate differs from the others'.
FAN_OUT = 16
RARE = 0.05
#: Two-sided 5 % point of the normal distribution.
DIFFERS = 1.96
#: Labelled URLs that the level above counts for.
PRIOR = 4.0
#: Blocked share from which a template is rejected.
REJECT = 0.7
#: Up to so many distinct paths their verdicts are broadcast; beyond, joined by shuffle.
FEW_PATHS = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A to Z lower-cased, and path up to query or fragment;
    both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule (host, path start, verdict) that fits, and its verdict; else null.
    Of rules of one length the first fits."""
    rule = verdict = F.lit(None).cast("string")
    for at, start, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.when(fits, F.lit(at + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int | None = DEPTH) -> Column:
    """Path segments as shapes: numbers, long hexadecimal runs and file endings of numbers
    are wildcards of their own already; the rest keeps its letters. What lies deeper than
    ``depth`` is one more segment, a wildcard."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def shape(s: Column) -> Column:
        stem = F.regexp_replace(s, r"^[0-9]+(?=$|\.)", "{n}")
        return F.when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$") & ~s.rlike(r"^[0-9]+$"), F.lit("{h}")).otherwise(stem)

    shapes = F.transform(parts, shape)
    if depth is None:
        return shapes
    deep = F.concat(F.slice(shapes, 1, depth), F.array(F.lit("{**}")))
    return F.when(F.size(shapes) > depth, deep).otherwise(shapes)


def template_tree(paths: DataFrame) -> DataFrame:
    """From counted paths (host, shape, n, allowed, blocked; the last two count labelled
    URLs) the template of each: adds ``template``, the segments after generalisation.

    The tree grows to the depth of the paths. A path that is alone under its template has no
    siblings further on and is done at once, so rounds go as deep as paths share templates.
    """
    grown = paths.withColumn("template", F.array().cast("array<string>"))
    columns, done, level = grown.columns, [], 0
    while True:
        level += 1
        at = grown.withColumn("segment", F.get("shape", F.lit(level - 1)))
        done.append(at.filter("segment IS NULL").select(*columns))
        inner = at.filter("segment IS NOT NULL")
        child = inner.groupBy("host", "template", "segment").agg(
            F.count("*").alias("paths"), *(F.sum(c).alias(c) for c in ("n", "allowed", "blocked"))
        )
        parent = child.groupBy("host", "template").agg(
            F.count("*").alias("siblings"),
            F.sum("paths").alias("all_paths"),
            *(F.sum(c).alias(f"all_{c}") for c in ("n", "allowed", "blocked")),
        )
        labelled, rest = "(allowed + blocked)", "(all_allowed + all_blocked - allowed - blocked)"
        pooled = "((all_blocked + 1D) / (all_allowed + all_blocked + 2D))"
        gap = f"abs((blocked + 1D) / ({labelled} + 2D) - (all_blocked - blocked + 1D) / ({rest} + 2D))"
        spread = f"sqrt({pooled} * (1 - {pooled}) * (1D / ({labelled} + 2D) + 1D / ({rest} + 2D)))"
        like = f"{gap} < {DIFFERS}D * {spread}"
        name = f"""CASE WHEN segment LIKE '{{%' THEN segment
            WHEN siblings > {FAN_OUT} AND n < {RARE}D * all_n AND ({labelled} = 0 OR {like}) THEN '{{*}}'
            WHEN siblings > 1 AND {like} THEN '{{~}}' ELSE segment END AS name"""
        named = child.join(parent, ["host", "template"]).selectExpr("host", "template", "segment", "all_paths", name)
        alone = F.col("all_paths") == 1
        rest_of = F.when(alone, F.slice("shape", level, F.size("shape"))).otherwise(F.array("name"))
        merged = inner.join(named, ["host", "template", "segment"]).withColumn("alone", alone)
        merged = cut_lineage(merged.withColumn("template", F.concat("template", rest_of)))
        done.append(merged.filter("alone").select(*columns))
        grown = merged.filter("NOT alone").select(*columns)
        if grown.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def judged_templates(tree: DataFrame) -> DataFrame:
    """Per host and shape its template and ``blocked_share``, smoothed level by level."""
    levels = [[], ["domain"], ["domain", "host"], ["domain", "host", "first"], ["domain", "host", "first", "template"]]
    rows = tree.withColumn("domain", domain(F.col("host"))).withColumn("first", F.coalesce(F.get("template", F.lit(0)), F.lit("")))
    counts = cut_lineage(rows.groupBy(*levels[-1]).agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")))
    share = counts.agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).selectExpr("(b + 0.5D) / (a + b + 1D) AS share").collect()[0][0]
    judged = counts.withColumn("share", F.lit(share or 0.5))
    for keys in levels[1:]:
        total = counts.groupBy(*keys).agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
        judged = judged.join(total, keys).withColumn("share", F.expr(f"(b + {PRIOR}D * share) / (a + b + {PRIOR}D)")).drop("a", "b")
    judged = judged.select("host", "template", F.col("share").alias("blocked_share"))
    return tree.select("host", "shape", "template").join(judged, ["host", "template"])


def judge_urls(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict per URL: the key, host, path, rule, verdict, template and blocked_share.

    The longest fitting rule decides. The URLs that rules decide are the labels of the
    template tree, and its templates decide the rest: block from a smoothed blocked share of
    ``REJECT`` on. template and blocked_share are null where a rule decides. A null URL or
    one without ``://`` has an empty host and path, and is judged as such. Repeated rows
    and null keys are kept.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("decided"), segments(F.col("path"), None).alias("shape"))
    counted = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("decided") == "allow").alias("allowed"),
        F.count_if(F.col("decided") == "block").alias("blocked"),
    )
    judged = cut_lineage(judged_templates(template_tree(cut_lineage(counted))))
    if judged.count() <= FEW_PATHS:
        judged = F.broadcast(judged)
    found = rows.join(judged, ["host", "shape"], "left")
    open_ = F.col("rule").isNull()
    own = F.when(F.col("blocked_share") >= REJECT, "block").otherwise("allow")
    return found.select(
        F.col("key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("decided", own).alias("verdict"),
        F.when(open_, F.concat(F.lit("/"), F.concat_ws("/", "template"))).alias("template"),
        F.when(open_, F.col("blocked_share")).alias("blocked_share"),
    )
