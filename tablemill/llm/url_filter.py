"""URL filters: host and path rules, then a tree of path templates per host judged by labelled purity.

The tree is built from the root, level by level. Segments with digits are variable at once; where a node has many
children that rarely come twice, all of them become one wildcard, and the next level is read below that wildcard.

Every node takes its label counts from all pages below it. The children of a node are tested together: if their shares
of bad pages spread no more than chance would spread them, they are merged with the node and take its share; otherwise
those significantly above the node's share are one branch, those below it another, and those near it (with the
unlabelled ones) a third, and a branch's share is that of all its pages, smoothed towards the node's, up to the host
and all pages. Pages that end at a node are a child of it too. Children of one name below several nodes of the same depth, each too
small to say much, are one branch if their shares don't differ and, taken together, they differ from what their nodes' shares say.

A branch is rejected if its share reaches a limit and something on the way to it, the host or a branch, is worse than chance allows:
where half of all pages are bad, that alone blocks nothing.

DataFrame operations only. Shapes are counted before anything is shuffled, so a host with very many pages is as many
rows as it has shapes; shapes with very many pages are joined by broadcast, at most four for each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import staged

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

MIN_CHILDREN, MIN_SPREAD = 16, 0.5
#: Levels of the tree; the segments that follow are one segment of the last level.
LEVELS = 12
#: Standard errors by which children must be spread beyond chance to be told apart, and by which one is above or below.
SPREAD, APART = 3.0, 2.0
#: What a merged branch of children above, near and below their node's share is called.
ABOVE, NEAR, BELOW = "{above}", "{near}", "{below}"
#: Labelled pages that the level above counts for.
SMOOTHING = 5.0
REJECT = 0.5


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``. Nothing is decoded."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host with its subdomains, path prefix) and its verdict, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def bounded(segments: Column) -> Column:
    """LEVELS segments at most, the last of them with all that follow."""
    rest = F.array_join(F.slice(segments, LEVELS, F.greatest(F.size(segments), F.lit(1))), "/")
    return F.when(F.size(segments) > LEVELS, F.concat(F.slice(segments, 1, LEVELS - 1), F.array(rest))).otherwise(segments)


def shape(path: Column) -> Column:
    """The path's segments, those with digits as ``*`` (with their extension); from level LEVELS on all are one."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"\.[A-Za-z]{1,8}$", 0))).otherwise(s))
    return bounded(plain)


def generalise(known: DataFrame) -> DataFrame:
    """Add ``template`` to distinct (host, shape, n, ..): level by level, the children of a node with many that rarely
    repeat become ``*``, so that what follows them is counted together."""
    levels = known.agg(F.max(F.size("shape"))).first()[0] or 0
    grown = known.withColumn("template", F.lit(""))
    for level in range(1, levels + 1):
        segment = F.get("shape", F.lit(level - 1)).alias("segment")
        children = grown.where(F.size("shape") >= level).groupBy("host", "template", segment).agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("pages"))
        wild = nodes.where((F.col("kinds") >= MIN_CHILDREN) & (F.col("kinds") >= F.col("pages") * MIN_SPREAD)).select("host", "template", F.lit(True).alias("_wild"))
        named = F.when(F.col("_wild"), F.lit("*")).otherwise(F.get("shape", F.lit(level - 1)))
        longer = F.when(F.size("shape") >= level, F.concat("template", F.lit("/"), named)).otherwise(F.col("template"))
        grown = staged(grown.join(wild, ["host", "template"], "left").select(*known.columns, longer.alias("template")), "url-levels")
    return grown.withColumn("template", F.when(F.col("template") == "", F.lit("/")).otherwise(F.col("template")))


def purity(templates: DataFrame) -> DataFrame:
    """(host, template, branch, bad_share, told) of a table (host, template, labelled, bad), a row per template.

    ``branch`` is the lowest branch above the template's end that was told apart (``/`` if none was): a node, several
    siblings merged under the name of their side, or all nodes of one name at that depth, whose parents are ``*``. ``bad_share`` is its smoothed
    share of bad pages. ``told``: the host has more bad pages than chance would give it, or a branch on the way has.
    """
    totals = templates.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).first()
    base = (totals["b"] or 0) / totals["n"] if totals["n"] else 0.0
    smooth = lambda bad, n, above: (bad + above * SMOOTHING) / (n + SMOOTHING)

    # a page that ends at a node is in that node's child without a name
    segments = F.concat(bounded(F.filter(F.split("template", "/"), lambda s: s != "")), F.array(F.lit("")))
    steps = templates.withColumn("_s", segments).select("host", "template", "labelled", "bad", "_s", F.posexplode("_s").alias("_at", "segment"))
    steps = staged(steps.select("host", "template", "labelled", "bad", "segment", F.col("_at").alias("depth"), F.array_join(F.slice("_s", 1, F.col("_at")), "/").alias("node")), "url-nodes")
    children = staged(steps.groupBy("host", "depth", "node", "segment").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")), "url-children")
    seen = children.where("n > 0").select("host", "depth", "node", "segment", "n", "b")
    shares = [F.count(F.lit(1)).alias("k"), F.sum("n").alias("pn"), F.sum("b").alias("pb"), F.sum(F.lit(1.0) / F.col("n")).alias("inverse"), F.sum(F.col("b") * F.col("b") / F.col("n")).alias("squares")]
    m = F.col("pb") / F.col("pn")
    pq = m * (1 - m)
    # the chi-square statistic of shares, and its standard deviation under equal shares
    spread = (F.col("squares") - F.col("pn") * m * m) / pq - (F.col("k") - 1)
    deviation = F.sqrt(F.greatest(F.col("k") * 2 + F.col("inverse") * (1 - pq * 6) / pq, F.lit(0.0)))
    differ = (F.col("pb") > 0) & (F.col("pb") < F.col("pn")) & (spread > deviation * SPREAD)
    sums = seen.groupBy("host", "depth", "node").agg(*shares)
    apart = sums.where(differ).select("host", "depth", "node", m.alias("m"))
    # a name below several nodes, whose shares don't differ: what it has beyond what its nodes' shares say
    expected = seen.join(sums.select("host", "depth", "node", m.alias("_m")), ["host", "depth", "node"])
    over, var = F.sum("b") - F.sum(F.col("n") * F.col("_m")), F.sum(F.col("n") * F.col("_m") * (1 - F.col("_m")))
    names = expected.groupBy("host", "depth", "segment").agg(*shares, over.alias("_over"), var.alias("_var"))
    alike = names.where((F.col("k") > 1) & (F.col("_var") > 0) & ~differ & (F.abs("_over") > F.sqrt("_var") * SPREAD)).select("host", "depth", "segment", (F.col("_over") > 0).alias("_more"))
    z = (F.col("b") - F.col("n") * F.col("m")) / F.sqrt(F.col("n") * F.col("m") * (1 - F.col("m")))
    side = F.when(F.col("m").isNull() | (F.col("n") == 0), F.lit(NEAR)).when(z > APART, F.lit(ABOVE)).when(z < -APART, F.lit(BELOW)).otherwise(F.lit(NEAR))
    own = children.join(apart, ["host", "depth", "node"], "left").join(alike, ["host", "depth", "segment"], "left").withColumn("side", side)
    pooled = F.col("_more").isNotNull() & (F.col("side") != F.when(F.col("_more"), BELOW).otherwise(ABOVE))
    above = F.when(pooled, F.col("_more")).otherwise(F.col("side") == ABOVE)
    group = [F.when(pooled, "").otherwise(F.col("node")).alias("of_node"), F.when(pooled, F.col("segment")).otherwise(F.col("side")).alias("of")]
    sided = staged(own.select("host", "depth", "node", "segment", "n", "b", pooled.alias("pooled"), above.alias("above"), *group, (pooled | F.col("m").isNotNull()).alias("split")), "url-sides")
    key = ["host", "depth", "pooled", "of_node", "of"]
    merged = sided.groupBy(*key).agg(F.sum("n").alias("mn"), F.sum("b").alias("mb"), F.count(F.lit(1)).alias("like"))
    placed = sided.join(merged, key)
    last = F.when(~F.col("pooled") & (F.col("like") > 1), F.col("of")).otherwise(F.col("segment"))
    name = F.when(F.col("pooled"), F.concat(F.lit("/"), F.repeat(F.lit("*/"), F.col("depth")), last)).when(F.col("node") == "", F.concat(F.lit("/"), last)).otherwise(F.concat(F.lit("/"), F.col("node"), F.lit("/"), last))
    placed = placed.select("host", "depth", "node", "segment", "split", "above", "mn", "mb", name.alias("branch"))
    paths = steps.join(placed, ["host", "depth", "node", "segment"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("depth", "split", "above", "mn", "mb", "branch"))).alias("_path"))
    n, bad = F.sum("labelled"), F.sum("bad")
    hosts = templates.groupBy("host").agg(smooth(bad, n, F.lit(base)).cast("double").alias("_share"), (bad - n * base > F.sqrt(n * base * (1 - base)) * APART).alias("_above"))
    share = F.aggregate("_path", F.col("_share"), lambda before, x: F.when(x["split"], smooth(x["mb"], x["mn"], before)).otherwise(before))
    splits = F.filter("_path", lambda x: x["split"])
    branch = F.coalesce(F.get(splits, F.size(splits) - 1)["branch"], F.lit("/"))
    told = F.col("_above") | F.exists(splits, lambda x: x["above"])
    return paths.join(hosts, "host").select("host", "template", branch.alias("branch"), share.alias("bad_share"), told.alias("told"))


def url_filter(pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: the id, host, path, rule, verdict, template, branch, bad_share.

    ``labels`` is (label_id, bad): the documents that pages show, a page's being the last number in its path (one that
    isn't a 64-bit integer is none); without it only rules block. A page that no rule fits is blocked if its branch's
    smoothed share of bad pages reaches a half and something tells it from all pages (``purity``). A url that is null or has no ``://`` has empty host and path and is
    judged by their branch like any other. A label id that comes twice is bad if any of its rows is; a null label says
    nothing. Repeated rows count once each. No rows: none.
    """
    host, path = parse(pages[url_col].cast("string"))
    parsed = pages.select(pages[id_col].alias("_id"), host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1).try_cast("bigint")
    rows = staged(parsed.withColumn("shape", shape(F.col("path"))).withColumn("_number", number), "urls")
    counted = staged(rows.groupBy("host", "shape", "_number").agg(F.count(F.lit(1)).alias("n")), "url-numbers")
    parts = counted.select("host", "shape", "n", F.lit(0).cast("bigint").alias("labelled"), F.lit(0).cast("bigint").alias("bad"))
    if labels is not None:
        label = labels.where("bad is not null and label_id is not null").groupBy(F.col("label_id").cast("bigint").alias("_number")).agg(F.max(F.col("bad").cast("int")).alias("_bad"))
        marked = counted.where("_number is not null").join(label, "_number")
        parts = parts.unionByName(marked.select("host", "shape", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("labelled"), (F.col("n") * F.col("_bad")).alias("bad")))
    known = staged(parts.groupBy("host", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]), "url-shapes")
    named = generalise(known)
    judged = purity(named.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    shapes = staged(named.select("host", "shape", "n", "template").join(judged, ["host", "template"]), "url-branches")
    # a shape with over a quarter of a partition's share of the pages is one of few, and its pages stay where they are
    fair = (shapes.agg(F.sum("n")).first()[0] or 0) / (4.0 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = ["template", "branch", "bad_share", "told"]
    hot = shapes.where(F.col("n") > fair).select("host", "shape", *found)
    cold = shapes.where(F.col("n") <= fair).select("host", "shape", *found)
    read = rows.select("_id", "host", "path", "shape")
    both = read.join(F.broadcast(hot), ["host", "shape"]).unionByName(read.join(F.broadcast(hot.select("host", "shape")), ["host", "shape"], "left_anti").join(cold, ["host", "shape"]))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("told") & (F.col("bad_share") >= REJECT), F.lit("block")).otherwise(F.lit("allow"))
    return both.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), *found[:-1])
