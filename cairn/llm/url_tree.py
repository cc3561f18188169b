"""URL rules and labelled path templates, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def apply_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and ruled (block or allow, else null) by rules (verdict, host, path); the longest host + path that fits wins."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return urls.withColumn("rule", rule).withColumn("ruled", ruled)


#: Smoothing of shares by the evidence one step up, and the standard errors from which on shares differ.
WEIGHT, Z = 2.0, 1.96


def path_templates(urls: DataFrame, scratch: Scratch, prior: float, many: int = 24, weight: float = WEIGHT, z: float = Z) -> DataFrame:
    """Adds template and evidence to urls (host, path, bad: 1, 0 or null as labelled, other columns of other names).

    A tree per host, grown level by level until no path has a further segment. A number is `{n}`. Under one parent, values are `*`
    if there are `many` or more and they are spread as evenly as at least half as many equal ones, so that repeated crawls of the
    same values generalise too; and labelled branches, where there are two or more, whose share of bad is within z standard errors of
    their parent's merge into `~`. A branch whose labels differ from its parent's keeps its name, however many there are.

    evidence is the smoothed share of bad of the same template over all hosts: its own counts and `weight` times the evidence
    of the template one segment shorter, down to all labelled urls and `prior`."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    now = urls.withColumn("parts", parts).withColumn("template", F.lit(""))
    total = now.agg(F.count("bad"), F.sum("bad")).first()
    top = ((total[1] or 0) + weight * prior) / (total[0] + weight)
    now = scratch.save(now.withColumn("evidence", F.lit(top)))
    done, level = [now.filter(F.size("parts") == 0)], 0
    now = now.filter(F.size("parts") > 0)
    keys = ["host", "template", "part"]
    while not now.isEmpty():
        part = F.get("parts", F.lit(level))
        now = now.withColumn("part", F.when(part.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), "{n}").otherwise(part))
        branch = now.groupBy(*keys).agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads"), F.max("evidence").alias("up"))
        named = F.col("part") != "{n}"
        parent = branch.groupBy("host", "template").agg(
            F.count(F.when(F.col("lab") > 0, 1)).alias("k"),
            F.sum("lab").alias("all_lab"),
            F.sum("bads").alias("all_bads"),
            F.count(F.when(named, 1)).alias("values"),
            F.try_divide(F.pow(F.sum(F.when(named, F.col("n"))), 2), F.sum(F.when(named, F.col("n").cast("double") * F.col("n")))).alias("spread"),
        )
        both = branch.join(parent.hint("merge"), ["host", "template"])
        share, pooled = F.try_divide("bads", "lab"), F.try_divide("all_bads", "all_lab")
        error = F.sqrt(F.greatest(F.try_divide(pooled * (1 - pooled), F.col("lab")), F.lit(1e-12)))
        alike = F.abs(share - pooled) < z * error
        variable = named & (F.col("values") >= many) & (F.col("spread") >= F.col("values") / 2) & F.coalesce(alike, F.lit(True))
        similar = named & (F.col("k") > 1) & F.coalesce(alike, F.lit(False))
        label = F.concat("template", F.lit("/"), F.when(variable, "*").when(similar, "~").otherwise(F.col("part")))
        tree = scratch.save(both.select(*keys, label.alias("grown"), "lab", "bads", "up"))
        # A template has one parent, and so one evidence above it. Branches, not pages, are dealt by template here.
        over = tree.groupBy("grown").agg(F.sum("lab").alias("lab"), F.sum("bads").alias("bads"), F.max("up").alias("up"))
        over = over.select("grown", ((F.col("bads") + weight * F.col("up")) / (F.col("lab") + weight)).alias("own"))
        known = scratch.again(tree).select(*keys, "grown").join(over.hint("merge"), "grown")
        now = now.join(known.hint("merge"), keys).select(*urls.columns, "parts", F.col("grown").alias("template"), F.col("own").alias("evidence"))
        now = scratch.save(now)  # short plans; a lost executor costs one level
        level += 1
        done.append(now.filter(F.size("parts") == level))
        now = now.filter(F.size("parts") > level)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("parts")


def judge_urls(urls: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, prior: float = 0.2, weight: float = WEIGHT, reject: float = 0.5) -> DataFrame:
    """One row per row of urls (page_id, url): host, path, rule, verdict, template, purity.

    Labelled pages are those that a rule decides, and those in labels (page_id, bad 0 or 1), where given. A host's template has the
    purity (bad + weight * evidence) / (labelled + weight) over its labelled pages, with the evidence of that template over all
    hosts (see path_templates), so that hosts without labels are judged by others' pages of the same shape; from `reject` on it
    is rejected. A rule's verdict goes first. Null urls and those without :// have an empty host and path, and so one template. Repeated
    rows and ids stay; other columns are ignored; an empty table gives an empty one. Counts are summed per branch before any shuffle,
    and joins of pages to branches are sort-merge joins at every size, which adaptive execution splits where a host is hot.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    pages = apply_rules(urls.select("page_id", host.alias("host"), path.alias("path")), rules)
    bad = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    if labels is not None:
        own = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("given"))
        pages = pages.join(own.hint("merge"), "page_id", "left")
        bad = F.coalesce(F.col("given"), bad)
    scratch = Scratch(urls.sparkSession, "urls")
    pages = path_templates(pages.withColumn("bad", bad).drop("given"), scratch, prior, weight=weight)
    counts = pages.groupBy("host", "template").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bads"), F.count("bad").alias("lab"))
    out = pages.join(counts.hint("merge"), ["host", "template"])
    purity = (F.col("bads") + weight * F.col("evidence")) / (F.col("lab") + weight)
    verdict = F.coalesce("ruled", F.when(purity >= reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round(purity, 6).alias("purity"))
