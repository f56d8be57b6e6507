"""URL filters by path-template trees.

Explicit rules come first: a rule (host, path prefix) fits its host and all subdomains; of those that fit, the longest
wins. Urls that no rule fits are judged by templates learnt from the others; the rules' verdicts are the labels.

Each host's paths form a tree with a level for each segment, whatever their number. A segment becomes a wildcard by its
shape (numbers, long hexadecimal strings, dates, slugs with digits), or where its place holds more than ``max_names``
different names. Places are settled from the host down: a place's names are counted after the segments above have become
wildcards, so the paths that a wildcard brings together are one place. The end of a path is a name too.

A place's labelled and blocked urls are those of all paths below it. At every level, from the host to the end of the
path, the names of a place (at most ``max_names``, a wildcard and the end) are merged into groups: in order of their
share of blocked urls, a name joins the group before it unless the two differ significantly (a two-proportion z of Z or
more). A group's purity is its share of blocked urls, smoothed towards the place's own purity with ``strength``
pseudo-counts; the host's is smoothed towards its registered suffix's, that towards the whole table's share. Names
without labels, and all names where the place has one group only, take the purity and the labels of the place. A template
is rejected if its smoothed purity is ``reject`` or more and the group that it got it from has ``min_labelled`` labelled
urls or more; else it is allowed.

All counts are grouped sums of distinct templates, combined before the shuffle; places are known by a running hash of
their segments, so a path costs its length. What is gathered in one row is the names of a settled place
and the levels of a path. Wildcards take one round for each level of nested places that are too wide, and one to see
that there are no more. Urls, narrow rows, join a template's verdict where Spark may split a large host's partition.
DataFrame functions only.

Edge cases: a null url or one without ``://`` has empty host and path, fits no rule, and falls under the empty host's
template; hosts are lower-cased in A-Z only; a path without segments is the template ``/``; without labels nothing is
rejected; repeated rows get equal verdicts; an empty table gives an empty result; only id and url are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import written

MAX_NAMES, Z, STRENGTH, REJECT, MIN_LABELLED = 50, 1.96, 4.0, 0.7, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment whose text varies: a number, a date, a long hexadecimal string or a name with three digits or more, with or without an extension.
VARIABLE = r"^(?:[0-9]+|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9a-fA-F-]{16,}|.*[0-9]{3,}.*)(?:\.[A-Za-z0-9]{1,5})?$"


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host and path of a url column; both empty for null or without ``://``."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substr(url, found + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def parse_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def matching_rule(host, path, rules: Sequence[tuple[str, str]]) -> F.Column:
    """The winning rule of (verdict, rule) pairs as a struct (verdict, rule), or null: one CASE, the longest first."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    out = None
    for verdict, rule in ordered:
        h, p = parse_rule(rule)
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _apart(b: F.Column, n: F.Column, other_b: F.Column, other_n: F.Column) -> F.Column:
    """Whether two groups' shares differ significantly: |z| of Z or more."""
    pooled = (b + other_b) / (n + other_n)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / other_n))
    return (spread > 0) & (F.abs(b / n - other_b / other_n) >= Z * spread)


def _places(rows: DataFrame, key: str) -> DataFrame:
    """The (at, name) rows of each (host, key) with ``under`` and ``place``: what stands for the segments before, and up to, ``at``.

    Both are running sums (xor) of the hashes of (at, name), so a path costs its length, however long it is.
    """
    along = Window.partitionBy("host", key).orderBy("at")
    hashed = rows.withColumn("_h", F.xxhash64("at", "name"))
    before = F.bit_xor("_h").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return hashed.withColumn("under", F.coalesce(before, F.lit(0).cast("long"))).withColumn("place", F.col("under").bitwiseXOR(F.col("_h"))).drop("_h")


def _generalised(cells: DataFrame, max_names: int) -> DataFrame:
    """``cells`` (host, cell, steps and counts) with wildcards for the names of places that hold more than ``max_names``.

    A round replaces the first such name of each path: all above it are settled, so places are too.
    """
    while True:
        at = _places(cells.select("host", "cell", F.posexplode("steps").alias("at", "name")), "cell").drop("place")
        wide = at.select("host", "under", "name").distinct().groupBy("host", "under").agg(F.count(F.lit(1)).alias("names"))
        wide = written(wide.where(F.col("names") > max_names).drop("names"), "wide-places")
        if not wide.limit(1).count():
            return cells
        first = at.join(wide, ["host", "under"]).groupBy("host", "cell").agg(F.min("at").alias("first"))
        star = F.transform("steps", lambda s, i: F.when(i == F.col("first"), "*").otherwise(s))
        joined = cells.join(first, ["host", "cell"], "left")
        cells = written(joined.withColumn("steps", F.when(F.col("first").isNull(), F.col("steps")).otherwise(star)).drop("first"), "url-cells")


def _groups(children: DataFrame) -> DataFrame:
    """(host, place, gn, gb, only) of each labelled place: the counts of the group it is merged with, and whether its parent has that group only."""
    counted = children.where("n > 0").withColumn("share", F.col("b") / F.col("n"))
    equal = counted.groupBy("host", "parent", "share").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.collect_list("place").alias("places"))
    names = equal.groupBy("host", "parent").agg(F.sort_array(F.collect_list(F.struct("share", "n", "b", "places"))).alias("names"))

    def joined(groups: F.Column, x: F.Column) -> F.Column:
        last = F.element_at(groups, -1)
        new = F.struct(x.n.alias("n"), x.b.alias("b"), x.places.alias("places"))
        both = F.struct((last.n + x.n).alias("n"), (last.b + x.b).alias("b"), F.concat(last.places, x.places).alias("places"))
        apart = _apart(last.b, last.n, x.b, x.n)
        return F.when((F.size(groups) == 0) | apart, F.concat(groups, F.array(new))).otherwise(F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(both)))

    first = F.get("names", F.lit(0))
    start = F.array(F.struct(first.n.alias("n"), first.b.alias("b"), first.places.alias("places")))
    groups = names.withColumn("groups", F.aggregate(F.slice("names", F.lit(2), F.size("names")), start, joined))
    groups = groups.select("host", (F.size("groups") == 1).alias("only"), F.explode("groups").alias("g"))
    return groups.select("host", F.explode("g.places").alias("place"), F.col("g.n").alias("gn"), F.col("g.b").alias("gb"), "only")


def judged(urls: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", reject: float = REJECT, strength: float = STRENGTH, min_labelled: int = MIN_LABELLED, max_names: int = MAX_NAMES) -> DataFrame:
    """id, host, path, rule, verdict, template, purity of each url."""
    host, path = split_url(F.col(url_col))
    parts = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    parts = parts.withColumn("steps", F.transform(segments, lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s)))
    parts = parts.withColumn("cell", F.md5(F.array_join("steps", "/")))
    blocked, labelled = F.when(F.col("match.verdict") == "block", 1).otherwise(0), F.when(F.col("match").isNotNull(), 1).otherwise(0)
    cells = parts.groupBy("host", "cell").agg(F.first("steps").alias("steps"), F.sum(labelled).cast("double").alias("n"), F.sum(blocked).cast("double").alias("b"))
    cells = _generalised(written(cells, "url-cells"), max_names)
    cells = cells.withColumn("template", F.concat(F.lit("/"), F.array_join("steps", "/"))).withColumn("own", F.md5("template"))
    leaf = cells.groupBy("host", "own").agg(F.first("steps").alias("steps"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    # every prefix of a template, and its end, is a place of the tree, with the counts of all below it
    levels = _places(leaf.select("host", "own", "n", "b", F.posexplode(F.concat("steps", F.array(F.lit("")))).alias("at", "name")), "own")
    levels = written(levels.select("host", "own", "n", "b", F.col("at").alias("level"), "place", F.col("under").alias("parent")), "url-levels")
    groups = _groups(levels.groupBy("host", "parent", "place").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    # the hosts' own purity
    suffix = F.regexp_extract("host", r"([^.]*(?:\.[^.]*)?)$", 1)
    hosts = levels.where("level = 0").groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb")).withColumn("suffix", suffix)
    suffixes = hosts.groupBy("suffix").agg(F.sum("hn").alias("sn"), F.sum("hb").alias("sb"))
    whole = suffixes.agg(F.sum("sn").alias("wn"), F.sum("sb").alias("wb"))
    smooth = lambda b, n, prior: (b + strength * prior) / (n + strength)
    # one row: the whole table's counts
    suffixes = suffixes.crossJoin(F.broadcast(whole)).withColumn("s", smooth(F.col("sb"), F.col("sn"), F.when(F.col("wn") > 0, F.col("wb") / F.col("wn")).otherwise(0.0)))
    hosts = hosts.join(suffixes.select("suffix", "s"), "suffix").withColumn("h", smooth(F.col("hb"), F.col("hn"), F.col("s")))

    def down(at: F.Column, x: F.Column) -> F.Column:
        stays = x.gn.isNull() | x.only
        purity, support = F.when(stays, at.purity).otherwise(smooth(x.gb, x.gn, at.purity)), F.when(stays, at.support).otherwise(x.gn)
        return F.struct(purity.alias("purity"), support.alias("support"))

    # from the host to the path's end, each group against its place
    chain = levels.select("host", "own", "level", "place").join(groups, ["host", "place"], "left")
    chain = chain.groupBy("host", "own").agg(F.sort_array(F.collect_list(F.struct("level", "gn", "gb", "only"))).alias("chain"))
    start = F.struct(F.col("h").alias("purity"), F.col("hn").alias("support"))
    judged_ = chain.join(hosts.select("host", "hn", "h"), "host").withColumn("at", F.aggregate("chain", start, down)).select("host", "own", "at.purity", "at.support")
    verdicts = written(cells.select("host", "cell", "template", "own").join(judged_, ["host", "own"]).drop("own"), "url-templates")
    out = parts.join(verdicts, ["host", "cell"])
    learnt = F.when((F.col("purity") >= reject) & (F.col("support") >= min_labelled), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", learnt).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
