"""URL filters by a path-template tree per host, in DataFrame functions only.

1. Explicit rules (host, path, verdict) decide first: a rule fits its host and all subdomains where the
   path starts with the rule's; the longest wins. What they decide serves as labels.
2. The tree of a host is generalised from the root down. Runs of digits become ``*`` at once; then, at
   each branching, children of a node become one wildcard where there are too many for a fixed part of a
   site: ``MANY`` different ones, or ``SOME`` of which most occur once or so.
3. Branches that differ in their last fixed segment are put in order of their labelled shares; neighbours
   whose shares agree (two-sample test, ``ALIKE`` standard errors) are merged. A branch joins only by labels of its
   own: ``LEAST_LABELS`` or more.
4. A branch with labels has the smoothed purity (blocked + 1) / (labelled + 2). One without has that of the
   nearest node above it with any labels below, up to the host; where the host has none, 1/2. The branch
   is rejected where its purity reaches ``REJECT``.

Only counts per (host, template) are grouped and joined; a URL is joined once, with its template. A host
with a third of all rows is thus a few counted rows. There is no limit to the depth: each round takes all groups of
paths to their next branching at once, and groups of fewer than ``SOME`` paths, in which nothing can become a
wildcard any more, are done. The number of rounds is that of such branchings on one path.

Cases: a NULL URL or one without ``://`` has an empty host and path and no rule; repeated rows are
counted and returned as often as they come; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdant.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MANY = 32
SOME = 8
LEAST_LABELS = 3
ALIKE = 2
REJECT = 0.9


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, decision) of the longest fitting rule, else NULL. ``rules``: a fixed list of (verdict, host, path)."""
    found = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        this = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("decision"))
        found = F.when(fits, this) if found is None else found.when(fits, this)
    return found


def segments(path: Column) -> Column:
    """Segments of a path with runs of digits as ``*``."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "*"), "/"), lambda s: s != "")


def _below(template: Column, parts: Column) -> Column:
    return F.concat(template, F.array_join(F.transform(parts, lambda p: F.concat(F.lit("/"), p)), ""))


def templates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (host, lex, n, labelled, blocked) with ``template``: its path after generalising, from one branching to the next."""
    node, rest = ["host", "template"], F.col("rest")
    open_ = cut_lineage(leaves.withColumn("rest", F.filter(F.split("lex", "/"), lambda s: s != "")).withColumn("template", F.lit("")))
    done = []
    while True:
        groups = open_.groupBy(node).agg(F.count(F.lit(1)).alias("leaves"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        # What the least and the greatest of some lists have in common from the start, all of them have.
        same = F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b))
        differ = F.array_position(same, F.lit(False)).cast("int")
        common = F.when(F.col("leaves") < SOME, F.lit(None)).when(differ == 0, F.size(same)).otherwise(differ - 1)
        here = open_.join(groups.select(*node, common.alias("common")), node)
        ahead = F.coalesce("common", F.size("rest"))
        here = here.select(*leaves.columns, _below(F.col("template"), F.slice("rest", F.lit(1), ahead)).alias("template"), F.slice(rest, ahead + 1, F.size("rest")).alias("rest"))
        here = cut_lineage(here)
        done.append(here.filter(F.size("rest") == 0).drop("rest"))
        here = here.filter(F.size("rest") > 0)
        if here.isEmpty():
            break
        children = here.groupBy(*node, F.get("rest", F.lit(0)).alias("part")).agg(F.sum("n").alias("n"))
        wide = children.groupBy(node).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
        wide = wide.filter((F.col("kinds") >= MANY) | ((F.col("kinds") >= SOME) & (2 * F.col("kinds") > F.col("n")))).select(*node, F.lit("*").alias("wild"))
        step = F.concat("template", F.lit("/"), F.coalesce("wild", F.get("rest", F.lit(0))))
        open_ = here.join(wide, node, "left").select(*leaves.columns, step.alias("template"), F.slice("rest", 2, F.size("rest")).alias("rest"))
        open_ = cut_lineage(open_)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def merged(stats: DataFrame) -> DataFrame:
    """``stats`` (host, template, labelled, blocked) with ``branch``: like siblings share one, all others are their own."""
    parent = F.regexp_replace("template", r"/[^/*]+((?:/[^/]*\*[^/]*)*)$", "/*$1")
    stats = stats.withColumn("parent", parent)
    able = (F.col("labelled") >= LEAST_LABELS) & (F.col("parent") != F.col("template"))
    # A node has fewer than MANY fixed children, so these windows are short.
    along = W.partitionBy("host", "parent").orderBy("share", "template")
    rows = stats.filter(able).withColumn("share", F.col("blocked") / F.col("labelled"))
    n, b, m, c = F.col("labelled"), F.col("blocked"), F.lag("labelled").over(along), F.lag("blocked").over(along)
    pooled, apart = (b + c) / (n + m), F.col("share") - F.lag("share").over(along)
    like = (pooled == 0) | (pooled == 1) | (apart * apart <= ALIKE * ALIKE * pooled * (1 - pooled) * (1 / n + 1 / m))
    runs = rows.withColumn("cut", F.when(like, 0).otherwise(1)).withColumn("run", F.sum("cut").over(along.rowsBetween(W.unboundedPreceding, 0)))
    several = F.count(F.lit(1)).over(W.partitionBy("host", "parent", "run")) > 1
    name = F.when(several, F.concat(F.lit("~"), "parent", F.lit("#"), F.col("run").cast("string"))).otherwise(F.col("template"))
    runs = runs.select("host", "template", name.alias("name"))
    return stats.join(runs, ["host", "template"], "left").select("host", "template", "labelled", "blocked", F.coalesce("name", "template").alias("branch"))


def purities(stats: DataFrame) -> DataFrame:
    """(host, template, branch, purity): of the branch's own labels, else inherited."""
    smooth = (F.col("blocked") + 1) / (F.col("labelled") + 2)
    named = cut_lineage(merged(stats))
    own = named.groupBy("host", "branch").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")).filter("labelled > 0")
    named = cut_lineage(named.select("host", "template", "branch").join(own.select("host", "branch", smooth.alias("own")), ["host", "branch"], "left"))
    parts = F.filter(F.split("template", "/"), lambda s: s != "")
    nodes = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"))))
    above = stats.filter("labelled > 0").select("host", nodes.alias("node"), "labelled", "blocked").groupBy("host", "node")
    above = above.agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")).select("host", "node", smooth.alias("purity"))
    bare = named.filter("own IS NULL").select("host", "template", nodes.alias("node"))
    given = bare.join(above, ["host", "node"]).groupBy("host", "template").agg(F.max_by("purity", "node.depth").alias("given"))
    return named.join(given, ["host", "template"], "left").select("host", "template", "branch", F.coalesce("own", "given", F.lit(0.5)).alias("purity"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and the template with its smoothed purity."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("lex", F.array_join(segments(F.col("path")), "/"))
    leaves = base.groupBy("host", "lex").agg(
        F.count(F.lit(1)).alias("n"), F.count("r").alias("labelled"), F.count(F.when(F.col("r.decision") == "block", 1)).alias("blocked")
    )
    nodes = cut_lineage(templates(leaves))
    stats = cut_lineage(nodes.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")))
    lookup = nodes.select("host", "lex", "template").join(purities(stats), ["host", "template"])
    return base.join(lookup, ["host", "lex"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.decision"), F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("branch").alias("template"),
        "purity",
    )
