"""URL filter: rules first, then a tree of path templates for every host.

The tree grows level by level until no path has segments left; segments that all
paths of a node share are taken in one step. Numbers in a segment are *variable*.
So are the infrequent children of a node, however many or few: they become one
wildcard. The others are branches; branches next to each other in their share of blocked pages are merged while a
two-proportion test cannot tell them apart. A template is a path from the root; it
is rejected if the smoothed share of blocked pages among its labelled ones is high
enough.

Each level is an aggregation by (host, node, segment), combined before its
shuffle, so a host with a third of all pages is counted in every task. Children of
a node with equal counts always merge, so the window that compares neighbours
holds one row for every different pair of counts, not for every child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import materialize, source, table

#: (verdict, host and path); a rule fits its host and all subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A merged branch of more children is named by its first one and their number.
NAMED = 16
#: Two branches differ if their shares lie this many standard errors apart.
Z = 1.96
#: Children with fewer pages are infrequent and share the wildcard: ``Z`` cannot tell all blocked from none blocked among 3 pages each, but among 4.
ENOUGH = 4
#: Weight of the prior, and the share of blocked pages from which a template is rejected.
PRIOR_PAGES, REJECT = 4.0, 0.8


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _jump(paths: DataFrame) -> DataFrame:
    """``paths`` moved on over the segments that all paths of their node share."""
    ends = paths.groupBy("host", "node").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    differ = F.array_position(F.zip_with("lo", "hi", lambda x, y: x == y), F.lit(False))
    shared = F.when(differ == 0, F.size("lo")).otherwise(differ - 1).cast("int")
    ends = ends.select("host", "node", F.slice("lo", F.lit(1), shared).alias("shared"))
    moved = F.concat("node", F.array_join(F.transform("shared", lambda x: F.concat(F.lit("/"), x)), ""))
    rest = F.slice("rest", F.size("shared") + 1, F.size("rest"))
    return paths.join(ends, ["host", "node"]).select("host", "path", moved.alias("node"), rest.alias("rest"), "pages", "blocked", "allowed")


def _branches(children: DataFrame) -> DataFrame:
    """host, node, seg and branch of the frequent ``children`` (host, node, seg, pages, blocked)."""
    pairs = children.groupBy("host", "node", "pages", "blocked").agg(F.count(F.lit(1)).alias("segs"))
    pairs = pairs.withColumn("share", (F.col("blocked") + 0.5) / (F.col("pages") + 1))
    siblings = Window.partitionBy("host", "node").orderBy("share", "pages", "blocked")
    pairs = pairs.withColumn("was", F.lag("share").over(siblings)).withColumn("size", F.lag("pages").over(siblings))
    pooled = (F.col("share") * F.col("pages") + F.col("was") * F.col("size")) / (F.col("pages") + F.col("size"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("pages") + 1 / F.col("size")))
    pairs = pairs.withColumn("new", F.coalesce(F.col("share") - F.col("was") > Z * error, F.lit(True)).cast("int"))
    pairs = pairs.withColumn("nth", F.sum("new").over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = pairs.withColumn("members", F.sum("segs").over(Window.partitionBy("host", "node", "nth")))
    named = children.join(pairs.select("host", "node", "pages", "blocked", "nth", "members"), ["host", "node", "pages", "blocked"])
    few = F.col("members") <= NAMED  # the names of a larger branch are never gathered
    groups = named.groupBy("host", "node", "nth").agg(
        F.array_sort(F.collect_list(F.when(few, F.col("seg")))).alias("names"), F.min("seg").alias("least"), F.max("members").alias("members")
    )
    listed = F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}"))
    counted = F.concat(F.lit("{"), F.col("least"), F.lit("|..."), F.col("members").cast("string"), F.lit("}"))
    name = F.when(F.col("members") == 1, F.col("least")).when(few, listed).otherwise(counted)
    return named.join(groups.select("host", "node", "nth", name.alias("branch")), ["host", "node", "nth"]).select("host", "node", "seg", "branch")


def _level(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, node, rest, pages, blocked, allowed), none at its end, down to the next nodes."""
    step = materialize(_jump(paths), "url-shared").withColumn("seg", F.get("rest", F.lit(0)))
    children = step.filter("seg IS NOT NULL").groupBy("host", "node", "seg").agg(F.sum("pages").alias("pages"), F.sum("blocked").alias("blocked"))
    children = materialize(children, "url-children")
    frequent = _branches(children.filter(F.col("pages") >= ENOUGH))
    step = step.join(frequent, ["host", "node", "seg"], "left")
    grown = F.when(F.col("seg").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.coalesce("branch", F.lit("*"))))
    rest = F.slice("rest", F.lit(2), F.size("rest"))
    return step.select("host", "path", grown.alias("node"), rest.alias("rest"), "pages", "blocked", "allowed")


def templates(judged: DataFrame) -> DataFrame:
    """host, path and template of every distinct path of ``judged`` (host, path, verdict)."""
    paths = judged.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"),
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"),
    )
    segments = F.split(F.regexp_replace("path", r"[0-9]+", "<n>"), "/")
    paths = materialize(paths.withColumn("node", F.lit("")).withColumn("rest", F.filter(segments, lambda s: s != "")), "url-paths")
    done = paths.filter(F.size("rest") == 0)
    while not (left := paths.filter(F.size("rest") > 0)).isEmpty():
        paths = materialize(_level(left), "url-paths")
        done = done.unionByName(paths.filter(F.size("rest") == 0))
    return materialize(done.drop("rest"), "url-templates")


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row.

    The rules label the pages they fit; their verdicts stand. Any other page is
    blocked if its template's share of blocked pages, smoothed by ``PRIOR_PAGES``
    pages of the overall share, is ``REJECT`` or more, and allowed otherwise, so a
    template without a labelled page is allowed. Null urls and urls without ``://``
    have an empty host and path. Repeated rows are judged alike.
    """
    rows = source(pages, page_id=page_id, url=url)
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.withColumn("rule", rule).withColumn("verdict", verdict), "url-pages")
    paths = templates(rows)
    found = paths.groupBy("host", "node").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    overall = found.agg((F.sum("b") + 1) / (F.sum("a") + F.sum("b") + 2)).first()[0]  # one row
    purity = (F.col("b") + PRIOR_PAGES * F.lit(overall if overall is not None else 0.5)) / (F.col("a") + F.col("b") + PRIOR_PAGES)
    found = found.withColumn("purity", purity).withColumn("labelled", F.col("a") + F.col("b"))
    judged = paths.select("host", "path", "node").join(found, ["host", "node"])
    out = rows.join(judged, ["host", "path"])
    own = F.when((F.col("purity") >= REJECT) & (F.col("labelled") > 0), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), F.concat("host", "node").alias("template"), "purity"
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return filter_urls(table(spark, sf_dir, "pages"))
