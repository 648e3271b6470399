"""URL filtering by host and path rules and by per-host path-template trees, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, stored

Rule = tuple[str, str, str]  # host, path, verdict

#: Segments that vary by their form alone: numbers, long hexadecimal strings, UUIDs, dates, with any file extension kept.
NUMBER, HEX, DATE = r"^[0-9]+$", r"^(?=.*[0-9])[0-9a-fA-F]{8,}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty without one and for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without :// and for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule (host and path together) that fits, else null. A rule fits its host and subdomains, when the path starts with its path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def shape_of(path: Column) -> Column:
    """All segments of a path, those that vary by form replaced by * and their file extension."""
    parts = F.array_remove(F.split(path, "/"), "")

    def shape(s: Column) -> Column:
        ext = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        stem = F.substr(s, F.lit(1), F.char_length(s) - F.char_length(ext))
        return F.when(stem.rlike(NUMBER) | stem.rlike(HEX) | stem.rlike(DATE), F.concat(F.lit("*"), ext)).otherwise(s)

    return F.transform(parts, shape)


def unlike(k1: Column, n1: Column, k2: Column, n2: Column, errors: float) -> Column:
    """Whether two shares, k1 of n1 and k2 of n2 (halves added), lie more than errors standard errors apart; false where one has no cases."""
    p, q = (k1 + 0.5) / (n1 + 1), (k2 + 0.5) / (n2 + 1)
    apart = F.abs(p - q) > errors * F.sqrt(p * (1 - p) / F.greatest(n1, F.lit(1)) + q * (1 - q) / F.greatest(n2, F.lit(1)))
    return F.when((n1 > 0) & (n2 > 0), apart).otherwise(F.lit(False))


def named_branches(kids: DataFrame, effective: int, tail: int, errors: float) -> DataFrame:
    """kids (host, at, seg, kn, kl, kb: URLs, labelled and blocked ones) with the name that each branch gets in its tree, and merged, the name it gets beside it when like siblings are one.

    Segments vary at a node when two of its URLs, drawn at random, have the same one with a probability of 1/effective or less: a statistic that doesn't depend on how many URLs there are. They all become *, but for those whose blocked share is unlike that of their siblings.
    Elsewhere siblings are compared in the order of their blocked shares: neighbours in that order that aren't unlike are one branch, whatever their size. Those with less than 1/tail of their node's URLs are one
    branch together, if not unlike; so no more than tail are compared one by one. Branches without labels stay by themselves.
    """
    free = kids.filter(~F.col("seg").startswith("*"))
    n = F.col("kn").cast("double")
    whole = free.groupBy(F.col("host").alias("_h"), F.col("at").alias("_a")).agg(F.sum("kn").alias("t"), F.sum(n * (n - 1)).alias("same"), F.sum("kl").alias("l"), F.sum("kb").alias("b"))
    # stored, so that the join with a node of very many branches can be split
    whole = stored(whole, "nodes")
    met = kids.join(whole, (F.col("host") == F.col("_h")) & (F.col("at") == F.col("_a")), "left")
    varies = (F.col("t") >= effective) & (F.col("same") * effective <= F.col("t").cast("double") * (F.col("t") - 1))
    odd = unlike(F.col("kb"), F.col("kl"), F.col("b") - F.col("kb"), F.col("l") - F.col("kl"), errors)
    kind = F.when(F.col("seg").startswith("*"), "form").when(varies, F.when(odd, "own").otherwise("any")).when(F.col("kl") == 0, "own").when(F.col("kn") * tail < F.col("t"), F.when(odd, "own").otherwise("tail")).otherwise("big")
    met = met.select("host", "at", "seg", "kl", "kb", kind.alias("kind"))
    line = Window.partitionBy("host", "at").orderBy(F.col("kb") / F.col("kl"), "seg")
    step = unlike(F.col("kb"), F.col("kl"), F.lag("kb").over(line), F.lag("kl").over(line), errors)
    big = met.filter("kind = 'big'").withColumn("new", F.coalesce(step, F.lit(False)).cast("int"))
    big = big.withColumn("group", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.count("*").over(Window.partitionBy("host", "at", "group")) == 1
    big = big.select("host", "at", "seg", F.col("seg").alias("name"), F.when(alone, F.col("seg")).otherwise(F.concat(F.lit("+"), F.col("group").cast("string"))).alias("merged"))
    rest = met.filter("kind <> 'big'")
    name = F.when(F.col("kind") == "any", "*").otherwise(F.col("seg"))
    merged = F.when(F.col("kind") == "tail", "+").otherwise(name)
    return rest.select("host", "at", "seg", name.alias("name"), merged.alias("merged")).unionByName(big)


def template_tree(leaves: DataFrame, *, effective: int = 8, tail: int = 64, errors: float = 1.96) -> DataFrame:
    """Grow each host's tree over leaves (host, shape: array of segments, n, labelled, blocked) and return (host, shape, names, merged, n, labelled, blocked): each leaf's path down its tree, with like siblings apart and as one.

    It goes level by level, to the end of all paths, as long as a node has effective URLs or more with segments that don't vary by form alone; what lies below smaller nodes stays as it is. Each level is an aggregation over distinct leaves
    with counts, so a hot host's many URLs weigh no more than its distinct shapes.
    """
    now = leaves.select("host", "shape", "n", "labelled", "blocked", F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("merged"), F.lit(0).cast("long").alias("at"))
    depth = 0
    while True:
        depth += 1
        seg = F.try_element_at("shape", F.lit(depth))
        kids = now.withColumn("seg", seg).filter("seg is not null").groupBy("host", "at", "seg").agg(F.sum("n").alias("kn"), F.sum("labelled").alias("kl"), F.sum("blocked").alias("kb"))
        kids = stored(kids, "branches")
        sizes = kids.filter(~F.col("seg").startswith("*")).groupBy("host", "at").agg(F.sum("kn").alias("t"))
        if sizes.filter(F.col("t") >= effective).isEmpty():
            done = now.select("host", "shape", "n", "labelled", "blocked", *[F.concat(c, F.slice("shape", depth, F.greatest(F.size("shape") - depth + 1, F.lit(0)))).alias(c) for c in ("names", "merged")])
            return stored(done, "tree")
        named = stored(named_branches(kids, effective, tail, errors), "named").select(F.col("host").alias("_h"), F.col("at").alias("_a"), F.col("seg").alias("_s"), "name", F.col("merged").alias("_m"))
        joined = now.withColumn("seg", seg).join(named, (F.col("host") == F.col("_h")) & (F.col("at") == F.col("_a")) & (F.col("seg") == F.col("_s")), "left")
        grown = lambda c, x: F.when(F.col("name").isNull(), F.col(c)).otherwise(F.array_append(c, F.col(x))).alias(c)
        now = stored(joined.select("host", "shape", "n", "labelled", "blocked", grown("names", "name"), grown("merged", "_m"), F.when(F.col("name").isNull(), F.col("at")).otherwise(F.xxhash64("at", "name")).alias("at")), "tree")


def prefixes(names: Column) -> Column:
    """Hashes of the beginnings of a path of names, the shortest first; empty for an empty path."""
    chain = F.aggregate(names, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.xxhash64(F.element_at(acc, -1), x)))
    return F.slice(chain, 2, F.greatest(F.size(names), F.lit(0)))


def filter_urls(
    df: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[Rule] = (),
    label: str | None = None,
    smooth: float = 5.0,
    reject_at: float = 0.8,
    salts: int = 16,
    **tree: float,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for each row of df.

    The longest fitting rule decides. Where none fits, the URL's template does: it is blocked when its smoothed blocked share is
    reject_at or more. Labels are the verdicts of the rules, or for rows with one the value of column label (allow or block).

    The trees of template_tree are per host; above them stands one tree of all hosts' templates with like siblings apart. Down that tree the share of a node is (blocked + smooth * share of the node above) / (labelled + smooth), from the share of all labelled URLs,
    or 0 without any label. A host's template has the share (blocked + smooth * share of the same template of all hosts) / (labelled + smooth). So templates without labels of their own are judged by those of other hosts.

    Null URLs and those without :// have empty host and path and are judged like any other; repeated rows come out repeated; null labels and ids
    are no matter; an empty table gives no rows. Other columns of df are ignored. Paths are read to their end, however long. Rows meet their templates by salted keys: a hot host or template is dealt over salts
    partitions.
    """
    u = F.col(url)
    rows = df.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), (F.col(label) if label else F.lit(None)).cast("string").alias("_label"))
    rows = rows.withColumn("_m", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("_label", F.coalesce("_label", "_m.verdict"))
    rows = rows.select("page_id", "host", "path", "_label", F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("ruled"), shape_of(F.col("path")).alias("shape"))
    rows = stored(rows, "urls")
    leaves = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("_label").alias("labelled"), F.count_if(F.col("_label") == "block").alias("blocked"))
    leaves = template_tree(stored(leaves, "leaves"), **tree)
    total = leaves.agg(F.sum("labelled"), F.sum("blocked")).head()
    prior = total[1] / total[0] if total[0] else 0.0
    every = stored(leaves.groupBy("names").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "templates")
    steps = every.select("names", "labelled", "blocked", F.posexplode(prefixes(F.col("names"))).alias("i", "node"))
    nodes = stored(steps.groupBy("node").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")), "shares")
    folded = steps.select("names", "i", "node").join(nodes, "node").groupBy("names").agg(F.sort_array(F.collect_list(F.struct("i", "l", "b"))).alias("s"))
    share = F.aggregate("s", F.lit(float(prior)), lambda p, x: (x["b"] + smooth * p) / (x["l"] + smooth))
    above = stored(folded.select(F.col("names").alias("_n"), share.alias("share")), "above")
    own = stored(leaves.groupBy(F.col("host").alias("_h"), F.col("merged").alias("_m")).agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")), "own")
    judged = leaves.select("host", "shape", "names", "merged").join(above, F.col("names") == F.col("_n"), "left").join(own, (F.col("host") == F.col("_h")) & (F.col("merged") == F.col("_m")))
    purity = (F.col("b") + smooth * F.coalesce("share", F.lit(float(prior)))) / (F.col("l") + smooth)
    template = F.concat(F.lit("/"), F.array_join("merged", "/"))
    judged = stored(judged.select(F.col("host").alias("_h"), F.col("shape").alias("_s"), template.alias("template"), purity.alias("purity")), "judged")
    judged = judged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")
    out = rows.withColumn("salt", salt).join(judged, (F.col("host") == F.col("_h")) & (F.col("shape") == F.col("_s")) & (F.col("salt") == F.col("_salt")), "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= reject_at, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
