"""Counts, degrees, roll-ups and the payloads of the graph's views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.identity import js_round
from weftline.operators.traversal import Graph, induced


def graph_stats(g: Graph) -> DataFrame:
    """(nodes, edges) totals."""
    return g.nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(g.edges.agg(F.count("*").alias("edges"))))  # one row each


def counts(df: DataFrame, column: str, alias: str, none: str | None = None) -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(none)) if none else F.col(column)
    return df.groupBy(value.alias(alias)).agg(F.count("*").alias("n"))


def confidence_shares(edges: DataFrame) -> DataFrame:
    """(confidence, n, percent) with the percentage rounded half up."""
    by = counts(edges, "confidence", "confidence")
    total = by.agg(F.greatest(F.sum("n"), F.lit(1)).alias("t"))
    return by.join(F.broadcast(total)).select("confidence", "n", js_round(F.col("n") / F.col("t") * 100).cast("long").alias("percent"))


def degrees(edges: DataFrame, structural: bool = True) -> DataFrame:
    """(id, degree): incident edge rows, a self-loop counting twice; `contains` left out unless structural."""
    rows = edges if structural else edges.where("relation <> 'contains'")
    return rows.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def layer(file: Column) -> Column:
    """src/<x>/... is x, a file right in src is shared, else the first segment; other if there is none."""
    parts = F.split(file, "/")
    inside = F.when(F.size(parts) > 2, parts[1]).otherwise("shared")
    first = F.when((parts[0] == "src") & (F.size(parts) > 1), inside).otherwise(parts[0])
    return F.when(F.coalesce(first, F.lit("")) == "", "other").otherwise(first)


def short_label(label: Column, kind: Column) -> Column:
    return F.when(kind == "module", F.element_at(F.split(label, "/"), -1)).otherwise(label)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def signature_text(sig: Column) -> Column:
    """modifiers (name?: type, ...) => result"""
    params = F.transform(sig["parameters"], lambda p: F.concat(p["name"], F.when(p["optional"], "?").otherwise(""), F.when(p["type"].isNull(), "").otherwise(F.concat(F.lit(": "), p["type"]))))
    mods = F.concat_ws(" ", sig["accessModifier"], F.when(sig["isAsync"], "async"), F.when(sig["isGenerator"], "*"))
    head = F.when(mods == "", "").otherwise(F.concat(mods, F.lit(" ")))
    return F.concat(head, F.lit("("), F.array_join(params, ", "), F.lit(") => "), F.coalesce(sig["returnType"]["text"], F.lit("void")))


def folder_matches(file: Column, folder: str) -> Column:
    """Files right in the folder or below it."""
    dir_of = F.regexp_extract(file, r"^(.*)/[^/]*$", 1)
    return (dir_of == folder) | F.startswith(dir_of, F.lit(folder + "/"))


def folder_tree(nodes: DataFrame) -> DataFrame:
    """(folder, depth, files): distinct files below each folder."""
    files = nodes.where("source_file <> ''").select("source_file").distinct()
    parts = F.split("source_file", "/")
    up = files.select("source_file", parts.alias("p")).where(F.size("p") > 1)
    rows = up.select("source_file", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("depth"), "p")
    rows = rows.select(F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("folder"), "depth")
    return rows.groupBy("folder", "depth").agg(F.count("*").alias("files"))


def top_nodes(g: Graph, n: int, structural: bool = False, deg: DataFrame | None = None) -> DataFrame:
    """The n nodes of highest degree, ties by id, with degree 0 where none; deg has the degrees if they are there already."""
    deg = degrees(g.edges, structural) if deg is None else deg
    return g.nodes.join(deg, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))).orderBy(F.desc("degree"), "id").limit(n)


def graph_payload(g: Graph, max_nodes: int = 6000, deg: DataFrame | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes with degree, the edges among them, and whether nodes were cut off."""
    shown = top_nodes(g, max_nodes, deg=deg)
    return shown, induced(g.edges, shown), g.nodes.limit(max_nodes + 1).count() > max_nodes


def node_detail(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, direction, relation, other, role) of each edge at ids (id) whose other end is a node."""
    names = g.nodes.select(F.col("id").alias("other"))
    out = g.edges.join(ids.withColumnRenamed("id", "source"), "source").select(F.col("source").alias("id"), F.lit("out").alias("direction"), "relation", F.col("target").alias("other"))
    back = g.edges.join(ids.withColumnRenamed("id", "target"), "target").select(F.col("target").alias("id"), F.lit("in").alias("direction"), "relation", F.col("source").alias("other"))
    role = F.when((F.col("direction") == "in") & F.col("relation").isin("contains", "method"), "declared_by").when((F.col("direction") == "in") & (F.col("relation") == "calls"), "invoked_by").otherwise("neighbor")
    return out.unionByName(back).join(names, "other", "left_semi").select("id", "direction", "relation", "other", role.alias("role"))


def edge_repos(g: Graph) -> DataFrame:
    """Edges with the repositories of their ends; null repo is `unknown`, ends without a node have a null one."""
    repo = g.nodes.select("id", F.coalesce("repo", F.lit("unknown")).alias("r"))
    out = g.edges.join(repo.select(F.col("id").alias("source"), F.col("r").alias("source_repo")), "source", "left")
    return out.join(repo.select(F.col("id").alias("target"), F.col("r").alias("target_repo")), "target", "left")


def catalog(g: Graph) -> DataFrame:
    """(repo, nodes, edges, cross_edges): edges by their source's repository; cross edges end in another."""
    rows = edge_repos(g).where("source_repo is not null").groupBy(F.col("source_repo").alias("repo")).agg(F.count("*").alias("edges"), F.count_if(F.col("target_repo") != F.col("source_repo")).alias("cross_edges"))
    nodes = counts(g.nodes, "repo", "repo", "unknown").withColumnRenamed("n", "nodes")
    zero = F.lit(0).cast("long")
    return nodes.join(rows, "repo", "left").select("repo", "nodes", F.coalesce("edges", zero).alias("edges"), F.coalesce("cross_edges", zero).alias("cross_edges"))


def repo_sums(g: Graph) -> DataFrame:
    """(source_repo, target_repo, n, first): the edges between and inside repositories, and the first one's weight."""
    first = F.min_by("weight", F.struct("source", "target", "relation", "context"))
    return edge_repos(g).groupBy("source_repo", "target_repo").agg(F.count("*").alias("n"), first.alias("first"))


def constellation(g: Graph, sums: DataFrame | None = None) -> DataFrame:
    """(repo, nodes, edges, size): nodes and edges inside each repository, size clamped to 20..60; sums are repo_sums if they are there already."""
    inside = edge_repos(g).where("source_repo = target_repo").groupBy(F.col("source_repo").alias("repo")).agg(F.count("*").alias("edges")) if sums is None else sums.where("source_repo = target_repo").select(F.col("source_repo").alias("repo"), F.col("n").alias("edges"))
    nodes = counts(g.nodes, "repo", "repo", "unknown").withColumnRenamed("n", "nodes")
    out = nodes.join(inside, "repo", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))
    return out.withColumn("size", F.least(F.lit(60.0), F.greatest(F.lit(20.0), F.lit(20.0) + F.col("nodes") / 10)))


def constellation_layout(repos: DataFrame, radius: float = 300.0) -> DataFrame:
    """repos on a circle, in order of name; the table has one row a repository."""
    n, i = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.orderBy("repo")) - 1
    angle = 2 * F.pi() * i / n
    return repos.select("*", F.round(radius * F.cos(angle), 6).alias("x"), F.round(radius * F.sin(angle), 6).alias("y"))


def repo_pairs(g: Graph, sums: DataFrame | None = None) -> DataFrame:
    """(source_repo, target_repo, n, weight) of edges between repositories: the first edge's weight, and one for each other."""
    sums = repo_sums(g) if sums is None else sums
    return sums.where("source_repo <> target_repo").select("source_repo", "target_repo", "n", (F.col("first") + F.col("n") - 1).alias("weight"))


def vis_edges(edges: DataFrame) -> DataFrame:
    """One row for each (from, to, relation), dashed if the first is INFERRED."""
    first = F.min_by("confidence", F.col("context"))
    return edges.groupBy(F.col("source").alias("from"), F.col("target").alias("to"), "relation").agg((first == "INFERRED").alias("dashed"))


def vis_nodes(g: Graph, gods: int = 12, deg: DataFrame | None = None) -> DataFrame:
    """(id, label, group, size, is_god): labels only for modules and the most connected nodes."""
    deg = degrees(g.edges, False) if deg is None else deg
    top = top_nodes(g, gods, deg=deg).select("id", F.lit(True).alias("is_god"))
    rows = g.nodes.join(deg, "id", "left").join(F.broadcast(top), "id", "left")
    god = F.coalesce("is_god", F.lit(False))
    label = F.when(god | (F.col("kind") == "module"), short_label(F.col("label"), F.col("kind"))).otherwise("")
    return rows.select("id", label.alias("label"), layer(F.col("source_file")).alias("group"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), god.alias("is_god"))


def weighted_adjacency(g: Graph) -> DataFrame:
    """(a, b, weight), both ways: parallel edges summed, weights not above 0 counted as 1, loops and dangling ends dropped."""
    rows = induced(g.edges.where("source <> target"), g.nodes).select("source", "target", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("w"))
    both = rows.select(F.col("source").alias("a"), F.col("target").alias("b"), "w").unionByName(rows.select(F.col("target").alias("a"), F.col("source").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("weight"))
