"""URL filters: host rules, and a path-template tree for the urls that no rule decides.

Each host's paths are cut into segments. Segments that look like identifiers become wildcards
at once; of the rest, a segment that few of its siblings' rows share does. Every node of the
tree counts rows and, from the rules, labelled and blocked rows. Siblings whose blocked shares
do not differ significantly merge into the wildcard. A template's purity is its blocked share,
smoothed towards its parent's purity, from the root (smoothed towards the share over all hosts,
but never above one half) down; templates that reach the threshold are rejected.

A branch with too few rows, or with all its rows in one path, is a leaf: what is below it is
one wildcard, so the tree is as deep as the urls part and no deeper.

Rules leave whole branches without a label, and labels elsewhere on the host say nothing of
those: a branch without labelled rows starts at the share over all hosts at most, and its rows
count as not blocked at the root and in a wildcard that it shares with labelled branches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut

#: (host suffix, path prefix, verdict) of the rules; the fixed values of the query's contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
RARE = 0.02  # a segment with less of its parent's rows becomes a wildcard
LEAST = 5  # and so does one with fewer rows; a node with fewer is a leaf
SIGNIFICANT = 2.58  # standard errors by which unmerged siblings' blocked shares differ from the rest's
SMOOTHING = 10.0  # labelled rows that the parent's purity counts for
REJECT = 0.9
WILD, REST = "*", "**"
#: Up to this many templates are broadcast; beyond, they are joined by shuffle.
BROADCAST_TEMPLATES = 50_000
VARIABLE = r"^(\*+|\d+|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|.*\d{3,}.*|.{48,})$"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ://."""
    rest = F.substring_index(F.col(url), "://", 1)
    after = F.substring(F.col(url), F.length(rest) + 4, F.length(url))
    has = F.contains(F.col(url), F.lit("://"))
    host = F.regexp_extract(after, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"\A([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls. Longer is more characters of host and path; ties by name."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(F.rlike(x, F.lit(VARIABLE)), F.lit(WILD)).otherwise(x))


def templates(judged: DataFrame) -> DataFrame:
    """(host, raw, template, purity) of each distinct raw path of judged (host, path, label 1 blocked, 0 allowed or null)."""
    raw = judged.select("host", _segments(F.col("path")).alias("seg"), "label").groupBy("host", "seg")
    raw = cut(raw.agg(F.count("*").alias("n"), F.count("label").alias("m"), F.sum(F.coalesce("label", F.lit(0))).alias("b")))
    total = raw.agg(F.sum("m").alias("m"), F.sum("b").alias("b")).first()
    prior = min(0.5, ((total["b"] or 0) + 1) / ((total["m"] or 0) + 2))
    smooth = lambda b, m, parent: (F.col(b) + SMOOTHING * parent) / ((F.col(m) if isinstance(m, str) else m) + SMOOTHING)
    root = raw.groupBy("host").agg(F.sum("n").alias("_n"), F.sum("b").alias("_b")).select("host", smooth("_b", "_n", F.lit(prior)).alias("purity"))
    rows = cut(raw.select("host", "seg", "n", "m", "b", F.lit("").alias("template")).join(root, "host"))
    done, level = [], 0
    while True:
        state = rows.withColumn("_s", F.get("seg", F.lit(level)))
        done.append(state.where("_s is null").select("host", "seg", "template", "purity"))
        state = state.where("_s is not null")
        if state.isEmpty():
            break
        level += 1
        sums = [F.sum(c).alias(f"_{c}") for c in ("n", "m", "b")]
        node = state.groupBy("host", "template", "_s").agg(*sums, F.count("*").alias("_paths"), F.max("purity").alias("_parent"))
        node = cut(node)
        whole = node.groupBy("host", "template").agg(*[F.sum(f"_{c}").alias(f"_all_{c}") for c in ("n", "m", "b", "paths")])
        node = node.join(whole, ["host", "template"])
        leaf = (F.col("_all_n") < LEAST) | (F.col("_all_paths") == 1)
        rest_m, rest_b = F.col("_all_m") - F.col("_m"), F.col("_all_b") - F.col("_b")
        share, other = F.try_divide("_b", "_m"), F.try_divide(rest_b, rest_m)
        pooled = F.try_divide("_all_b", "_all_m")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "_m") + F.try_divide(F.lit(1.0), rest_m)))
        differs = (F.abs(share - other) > SIGNIFICANT * error) | ((F.col("_m") > 0) != (rest_m > 0)) & (F.col("_all_m") > 0)
        frequent = (F.col("_n") >= LEAST) & (F.col("_n") >= RARE * F.col("_all_n"))
        stays = frequent & F.coalesce(differs, F.lit(False)) & (F.col("_s") != WILD)
        node = node.withColumn("_t", F.when(leaf, REST).when(stays, F.col("_s")).otherwise(WILD))
        bare = F.sum(F.when(F.col("_m") == 0, F.col("_n")).otherwise(0))  # rows of branches without a label
        merged = node.groupBy("host", "template", "_t").agg(F.sum("_m").alias("_m"), F.sum("_b").alias("_b"), bare.alias("_u"), F.max("_parent").alias("_parent"))
        parent = F.when(F.col("_m") == 0, F.least("_parent", F.lit(prior))).otherwise(F.col("_parent"))
        own = F.when(F.col("_t") == REST, F.col("_parent")).otherwise(smooth("_b", F.col("_m") + F.col("_u"), parent))
        merged = merged.select("host", "template", "_t", own.alias("_p"))
        placed = node.select("host", "template", "_s", "_t").join(merged, ["host", "template", "_t"])
        placed = state.join(placed, ["host", "template", "_s"])
        placed = cut(placed.select("host", "seg", "n", "m", "b", F.concat("template", F.lit("/"), "_t").alias("template"), F.col("_p").alias("purity"), (F.col("_t") == REST).alias("_leaf")))
        done.append(placed.where("_leaf").select("host", "seg", "template", "purity"))
        rows = placed.where("not _leaf").drop("_leaf")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("host", F.col("seg").alias("raw"), "template", "purity")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, reject: float = REJECT, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    A rule that fits decides; elsewhere the template's purity does. Null urls have an empty
    host and path, which is a host like any other. Repeated rows are judged alike.
    """
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", name.alias("rule"), verdict.alias("_v"))
    labelled = rows.select("host", "path", F.when(F.col("_v") == "block", 1).when(F.col("_v") == "allow", 0).alias("label"))
    tree = templates(labelled).select("host", F.array_join("raw", "/").alias("_raw"), "template", "purity")
    tree = F.broadcast(tree) if tree.count() <= BROADCAST_TEMPLATES else tree
    out = rows.withColumn("_raw", F.array_join(_segments(F.col("path")), "/")).join(tree, ["host", "_raw"], "left")
    judged = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("_v", judged).alias("verdict"), "template", "purity")
