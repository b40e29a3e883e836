"""URL filters by path-template trees.

Native DataFrame functions only. The paths of a host form a tree of segments. Level by level, the children of a node
that are many and mostly seen once are generalised into a wildcard (which keeps a file extension); children that are
frequent there stay literal. A path's template is its way down that tree. Templates of a host that differ in literals
only are sibling branches; those whose labelled share of bad pages does not differ from the siblings' by a two-sided
z-test are merged. A branch's purity is its labelled share of bad pages, smoothed by the same branch over all hosts, and
that by the share over everything; branches of a high purity are rejected.

All steps are counts over (host, node, segment) and equality joins with tables of nodes that are written first, so the
planner knows their sizes; a host with many pages is spread over its paths.

Edge cases: a url that is null or without ``://`` has an empty host and path; an empty path, and a path of slashes only,
have the root template; repeated rows and urls count as often as they occur and get equal verdicts; an empty table gives
an empty result; without labels nothing is rejected. Other columns are passed through
whatever their names, but for those named like the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.rows import packed, unpacked
from tideline.session import materialise


@dataclass(frozen=True)
class TemplateSettings:
    #: Levels of the tree; what lies deeper is one wildcard.
    depth: int = 4
    #: A node with at least so many different children, at least this share of its pages, is generalised,
    min_kinds: int = 8
    min_ratio: float = 0.2
    #: but for children with at least so many pages and this share of them.
    often: int = 20
    often_share: float = 0.05
    z: float = 1.96
    #: Weight of the prior, in labelled pages.
    prior: float = 10.0
    reject: float = 0.9


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str  # host and path

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(text, pattern, 2))


def matched_rule(rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    host, path = F.col("host"), F.col("path")
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule))[::-1]:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _segments() -> Column:
    return F.filter(F.split("path", "/"), lambda x: x != "")


def templates(urls: DataFrame, settings: TemplateSettings | None = None) -> DataFrame:
    """``urls``: host, path, bad (1, 0 or null). One row per (host, path): n, labelled, bad, template, shape."""
    s = settings or TemplateSettings()
    counted = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    rows = materialise(counted.withColumn("_segments", _segments()).withColumn("template", F.lit("")).withColumn("shape", F.lit("")), "paths")
    for level in range(s.depth):
        rows = rows.withColumn("_segment", F.get("_segments", F.lit(level)))
        children = rows.where(F.col("_segment").isNotNull()).groupBy("host", "template", "_segment").agg(F.sum("n").alias("_n"))
        nodes = materialise(children.groupBy("host", "template").agg(F.sum("_n").alias("_total"), F.count("*").alias("_kinds")), "nodes")
        alike = (F.col("_kinds") < s.min_kinds) | (F.col("_kinds") < s.min_ratio * F.col("_total"))
        frequent = (F.col("_n") >= s.often) & (F.col("_n") >= s.often_share * F.col("_total"))
        literal = materialise(children.join(nodes, ["host", "template"]).where(alike | frequent).select("host", "template", "_segment", F.lit(True).alias("_literal")), "literals")
        rows = rows.join(literal, ["host", "template", "_segment"], "left")
        wild = F.concat(F.lit("/*"), F.regexp_extract("_segment", r"\.[A-Za-z]{1,5}$", 0))
        step = F.when(F.col("_segment").isNull(), "").when(F.col("_literal"), F.concat(F.lit("/"), "_segment")).otherwise(wild)
        form = F.when(F.col("_segment").isNull(), "").when(F.col("_literal"), "/?").otherwise(wild)
        rows = rows.withColumn("template", F.concat("template", step)).withColumn("shape", F.concat("shape", form)).drop("_segment", "_literal")
    deeper = F.when(F.size("_segments") > s.depth, "/**").otherwise("")
    return rows.withColumn("template", F.concat("template", deeper)).withColumn("shape", F.concat("shape", deeper)).drop("_segments")


def judged(paths: DataFrame, settings: TemplateSettings | None = None) -> DataFrame:
    """(host, template, branch, purity, reject) from the templates of paths."""
    s = settings or TemplateSettings()
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    each = materialise(paths.groupBy("host", "template", "shape").agg(*sums), "templates")
    group = each.groupBy("host", "shape").agg(F.sum("labelled").alias("_all"), F.sum("bad").alias("_all_bad"))
    share = F.try_divide("_all_bad", "_all")
    labelled = F.nullif(F.col("labelled"), F.lit(0))
    apart = F.abs(F.try_divide("bad", "labelled") - share) > s.z * F.sqrt(share * (1 - share) / labelled)
    branch = F.when((F.col("labelled") > 0) & apart, F.col("template")).otherwise(F.col("shape"))
    merged = materialise(each.join(group, ["host", "shape"]).select("host", "template", branch.alias("branch"), "labelled", "bad"), "branches")
    own = merged.groupBy("host", "branch").agg(*sums)
    # The same branch over all hosts, and everything.
    anywhere = merged.groupBy("branch").agg(F.sum("labelled").alias("_all"), F.sum("bad").alias("_all_bad"))
    total = merged.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    base = (total["bad"] + 1) / (total["n"] + 2)
    prior = (F.col("_all_bad") + s.prior * base) / (F.col("_all") + s.prior)
    purity = (F.col("bad") + s.prior * prior) / (F.col("labelled") + s.prior)
    scored = own.join(anywhere, "branch").select("host", "branch", purity.alias("purity"))
    known = merged.select("host", "template", "branch").join(scored, ["host", "branch"])
    return known.withColumn("reject", F.col("purity") >= s.reject if total["n"] else F.lit(False))


def filter_urls(pages: DataFrame, settings: TemplateSettings | None = None) -> DataFrame:
    """``pages`` (host, path, bad and others) with ``template``, ``branch``, ``purity`` and ``reject``."""
    without = ("template", "branch", "purity", "reject")
    paths = materialise(templates(pages.select("host", "path", "bad"), settings), "templated")
    verdicts = materialise(judged(paths, settings), "verdicts")
    known = paths.select("host", "path", "template").join(verdicts, ["host", "template"])
    frame = packed(pages, {"host": "host", "path": "path"}, without)
    return unpacked(frame.join(known, ["host", "path"]), pages, without, **{c: c for c in without})
