"""URL filters: host and path rules, and a path-template tree that learns which templates to reject.

All of it is DataFrame expressions. Per host, the path's segments form a tree. A segment is generalised by its shape (digits,
long hexadecimal, else its own text; a file's ending stays), and where a node has very many children each rare child becomes a
wildcard. Sibling branches whose labelled shares do not differ by more than chance from their siblings' are merged: they
share one pooled branch. A template's purity is its labelled share of bad pages, smoothed towards its parent's, the
root of a host towards the share of all labelled pages. Templates whose smoothed purity reaches the limit are rejected.

The first LEVELS levels are always grown; deeper ones as long as there are deeper segments below a node that has good and bad labelled pages:
where no node has both, none can split. What lies deeper than the tree is written `/**`.

The tree is grown level by level with aggregates, so a host with a third of all pages only ever meets in partial sums and in
joins that Spark may split. Labels: 1 bad, 0 good, null none. A null url, or one without `://`, has empty host and path and
falls under the empty host's tree. Empty tables give empty results; repeated urls count as often as they come.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

LEVELS = 3  # grown in any case
WIDE = 50  # a node with more children than this keeps only those with at least SUPPORT pages
SUPPORT = 20
SMOOTHING = 4.0
LIMIT = 0.5
SIGNIFICANT = 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, without query and fragment; both empty for a null url or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits; rules are (verdict, host/path). Of equally long ones the first in text order."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, p = split_rule(rule)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def rule_verdict(rule: Column, rules: list[tuple[str, str]]) -> Column:
    out = None
    for verdict, text in rules:
        out = F.when(rule == text, verdict) if out is None else out.when(rule == text, verdict)
    return F.lit(None).cast("string") if out is None else out


def shape(segment: Column) -> Column:
    """A segment's generalised form."""
    stem = F.regexp_extract(segment, r"\A(.*?)(\.[A-Za-z]{1,5})?\z", 1)
    end = F.regexp_extract(segment, r"\A(.*?)(\.[A-Za-z]{1,5})?\z", 2)
    kind = F.when(stem.rlike(r"\A[0-9]+\z"), F.lit("<n>")).when(stem.rlike(r"\A[0-9a-fA-F-]{8,}\z") & stem.rlike("[0-9]"), F.lit("<h>"))
    return F.concat(kind.otherwise(stem), end)


def template_tree(pages: DataFrame, work: Workspace, host: str = "host", path: str = "path", bad: str = "bad", levels: int = LEVELS) -> DataFrame:
    """pages with two more columns: template and purity (smoothed share of bad labels).

    Pages are first added up by host and shaped segments; the tree is grown on these sums, one written table a level.
    """
    parts = F.filter(F.split(F.col(path), "/"), lambda s: s != "")
    d = pages.withColumn("tt_segs", F.transform(parts, shape))
    label = F.when(F.col(bad).isNotNull(), 1).otherwise(0)
    keys = ["tt_host", "tt_segs"]
    counts = [F.count(F.lit(1)).alias("n"), F.sum(label).alias("l"), F.sum(F.when(F.col(bad) == 1, 1).otherwise(0)).alias("b")]
    t = work.table(d.withColumnRenamed(host, "tt_host").groupBy(*keys).agg(*counts), "paths", release=False)
    more = [F.sum(c).alias(c) for c in ("n", "l", "b")]
    all_l, all_b = t.agg(F.coalesce(F.sum("l"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    hosts = t.groupBy("tt_host").agg(*more).select("tt_host", smoothed(F.col("b"), F.col("l"), F.lit((all_b + 1.0) / (all_l + 2.0))).alias("p"))
    t = work.table(t.join(hosts, "tt_host").withColumn("node", F.lit("")), "level0", release=False)
    for k in count():
        seg = F.try_element_at("tt_segs", F.lit(k + 1))
        deeper = t.where(F.size("tt_segs") > k)
        if k >= levels:
            deeper = deeper.groupBy("tt_host", "node").agg(F.sum("l").alias("l"), F.sum("b").alias("b")).where("b > 0 and b < l")
        if not deeper.limit(1).count():
            break
        kids = t.where(F.size("tt_segs") > k).groupBy("tt_host", "node", seg.alias("seg")).agg(*more, F.first("p").alias("up"))
        kids = work.table(kids, f"children{k}", release=False)
        parent = kids.groupBy("tt_host", "node").agg(F.count(F.lit(1)).alias("kids"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        kids = kids.join(parent, ["tt_host", "node"])
        others = F.col("pl") - F.col("l")
        pooled = F.try_divide("pb", "pl")
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "l") + F.try_divide(F.lit(1.0), others)))
        apart = F.abs(F.try_divide("b", "l") - F.try_divide(F.col("pb") - F.col("b"), others))
        differs = F.when((F.col("l") > 0) & (others > 0) & (pooled > 0) & (pooled < 1), apart > SIGNIFICANT * spread).otherwise(F.lit(False))
        rare = (F.col("kids") > WIDE) & (F.col("n") < SUPPORT)
        kids = work.table(kids.withColumn("child", F.when(differs & ~rare, F.col("seg")).otherwise(F.lit("*"))), f"merged{k}", release=False)
        branch = kids.groupBy("tt_host", "node", "child").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("up").alias("up"))
        branch = branch.select("tt_host", "node", "child", smoothed(F.col("b"), F.col("l"), F.col("up")).alias("new"))
        step = work.table(kids.select("tt_host", "node", "seg", "child").join(branch, ["tt_host", "node", "child"]), f"branches{k}", release=False)
        step = step.select(*[F.col(c).alias(f"x_{c}") for c in step.columns])
        t = t.join(step, (F.col("tt_host") == F.col("x_tt_host")) & (F.col("node") == F.col("x_node")) & (seg == F.col("x_seg")), "left")
        t = t.withColumn("node", F.when(F.col("x_child").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), "x_child"))).withColumn("p", F.coalesce("x_new", "p"))
        t = work.table(t.select(*keys, "n", "l", "b", "p", "node"), f"level{k + 1}", release=False)
    t = t.select(*[F.col(c).alias(f"x_{c}") for c in keys], F.concat("node", F.when(F.size("tt_segs") > k, F.lit("/**")).otherwise(F.lit(""))).alias("template"), F.col("p").alias("purity"))
    d = d.join(t, (d[host] == t["x_tt_host"]) & (d["tt_segs"] == t["x_tt_segs"]), "left")
    return d.drop("tt_segs", *[f"x_{c}" for c in keys])


def smoothed(bad: Column, labelled: Column, prior: Column) -> Column:
    return (bad + SMOOTHING * prior) / (labelled + SMOOTHING)


def judge(pages: DataFrame, work: Workspace, rules: list[tuple[str, str]], url: str = "url", keep: list[str] | None = None, label: str | None = None) -> DataFrame:
    """Columns keep, host, path, rule, verdict, template and purity.

    A rule's verdict holds where a rule fits. Elsewhere the template tree decides. The tree learns from the column `label` (1 bad,
    0 good) where it is given, else from the pages that a rule judges.
    """
    keep = keep or []
    src = pages.select(*[pages[c].alias(f"k{i}") for i, c in enumerate(keep)], pages[url].alias("u"), *([pages[label].alias("bad")] if label else []))
    h, p = host_and_path(F.col("u"))
    d = src.withColumn("host", h).withColumn("path", p).drop("u")
    d = d.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    d = d.withColumn("ruled", rule_verdict(F.col("rule"), rules))
    if not label:
        d = d.withColumn("bad", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    d = template_tree(d, work)
    method = F.when(F.col("purity") >= LIMIT, "block").otherwise("allow")
    return d.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")
