"""Several repositories: namespaced merge, cross-repository links, project keys, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.identity import normalize_label, normalize_remote, parse_remote, prefix_id, project_key
from weftline.operators.traversal import Graph


def namespaced(g: Graph, repo: Column) -> Graph:
    """Ids and both ends of edges under the repository's key, dangling ends too; rows are stamped with it."""
    nodes = g.nodes.withColumns({"id": prefix_id(repo, F.col("id")), "repo": repo})
    return Graph(nodes, g.edges.withColumns({"source": prefix_id(repo, F.col("source")), "target": prefix_id(repo, F.col("target")), "repo": repo}))


def merged(graphs: list[tuple[str, Graph]]) -> Graph:
    parts = [namespaced(g, F.lit(key)) for key, g in graphs]
    nodes, edges = parts[0].nodes, parts[0].edges
    for p in parts[1:]:
        nodes, edges = nodes.unionByName(p.nodes, True), edges.unionByName(p.edges, True)
    return Graph(nodes, edges)


def match_packages(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """imports (repo, file, module, names, ...) with the packages (package, target_repo) they may mean, in other repositories.

    A module is the package or lies below it: EXTRACTED. Its last segment is the package's, case
    apart: INFERRED. A package that several repositories publish is AMBIGUOUS. Modules that begin
    with ./ or ../ mean none. Prefixes are matched by exploding a module's ancestors, so both
    are equi-joins. Of a repository's packages that match, the surest stays.
    """
    published = packages.groupBy("package").agg(F.count("*").alias("publishers"))
    packages = packages.join(published, "package")
    ok = imports.where(~F.startswith("module", F.lit("./")) & ~F.startswith("module", F.lit("../")) & (F.col("module") != ""))
    parts = F.split("module", "/")
    up = ok.withColumn("package", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    exact = up.join(packages, "package").withColumn("confidence", F.lit("EXTRACTED"))
    last = lambda c, by: F.lower(F.element_at(F.split(c, by), -1))
    seg = ok.withColumn("seg", last("module", "/")).where("seg <> ''").join(packages.withColumn("seg", last("package", "[:/]")), "seg").drop("seg")
    seg = seg.withColumn("confidence", F.lit("INFERRED")).select(*exact.columns)
    every = exact.unionByName(seg).where("repo <> target_repo")
    key = [*imports.columns, "target_repo"]
    best = F.min_by(F.struct("package", "confidence", "publishers"), F.struct("confidence", "package"))
    every = every.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")
    return every.withColumn("confidence", F.when(F.col("publishers") > 1, "AMBIGUOUS").otherwise(F.col("confidence"))).drop("publishers")


def graph_imports(g: Graph) -> DataFrame:
    """(repo, file, module, names, source) of the import edges of a merged graph.

    A module node's label names the module, else the edge's target does; the edge's own
    repository counts before its source's. No names are known, and the source is the anchor.
    """
    module = g.nodes.where("kind = 'module'").select(F.col("id").alias("target"), F.col("label").alias("_module"))
    owner = g.nodes.select(F.col("id").alias("source"), F.col("repo").alias("_repo"), F.col("source_file").alias("_file"))
    rows = g.edges.where("relation in ('imports', 'imports_from')").join(module, "target", "left").join(owner, "source", "left")
    own = [F.col("repo")] if "repo" in g.edges.columns else []
    return rows.select(
        F.coalesce(*own, "_repo", F.lit("")).alias("repo"), F.coalesce("_file", "source_file").alias("file"), F.coalesce("_module", "target").alias("module"),
        F.array().cast("array<string>").alias("names"), "source",
    )


def link_repos(matches: DataFrame, nodes: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """imports_from edges of matches between namespaced nodes.

    The source is the match's own (source), where it has one; else the functions and methods in
    which its names are used (sites: repo, file, module, names, label), else the file's module
    node, else any of its nodes, else an id made for the file. The target is the first imported
    name that the other repository has, else its first node, else its key. One edge stays for
    each (source, target), the surest.
    """
    key = ["repo", "file", "module", "names"]
    if "source" not in matches.columns:
        matches = matches.withColumn("source", F.lit(None).cast("string"))
    rows = matches.withColumnRenamed("source", "given")
    if sites is not None:
        code = nodes.where("kind in ('function', 'method')").groupBy("repo", F.col("source_file").alias("file"), normalize_label(F.col("label")).alias("name")).agg(F.min("id").alias("site"))
        used = sites.select(*key, normalize_label(F.col("label")).alias("name")).distinct().join(code, ["repo", "file", "name"]).select(*key, "site")
        rows = rows.join(used, key, "left")
    else:
        rows = rows.withColumn("site", F.lit(None).cast("string"))
    by_file = nodes.groupBy("repo", F.col("source_file").alias("file")).agg(F.coalesce(F.min(F.when(F.col("kind") == "module", F.col("id"))), F.min("id")).alias("by_file"))
    by_repo = nodes.groupBy(F.col("repo").alias("target_repo")).agg(F.min("id").alias("any"))
    wanted = matches.select("names", "target_repo").distinct().select("names", "target_repo", F.posexplode("names").alias("pos", "label")).withColumn("name", normalize_label(F.col("label")))
    named = wanted.join(nodes.select(F.col("repo").alias("target_repo"), normalize_label(F.col("label")).alias("name"), "id"), ["target_repo", "name"])
    named = named.groupBy("names", "target_repo").agg(F.min(F.struct("pos", "id")).getField("id").alias("named"))
    rows = rows.join(by_file, ["repo", "file"], "left").join(named, ["names", "target_repo"], "left").join(by_repo, "target_repo", "left")
    made = F.concat(project_key(F.col("repo")), F.lit("::"), normalize_label(F.col("file")))
    rows = rows.select(F.coalesce("given", "site", "by_file", made).alias("source"), F.coalesce("named", "any", "target_repo").alias("target"), F.lit("imports_from").alias("relation"), "confidence", F.col("file").alias("source_file"))
    rank = F.when(F.col("confidence") == "EXTRACTED", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    return rows.where("source <> target").groupBy("source", "target", "relation").agg(F.min_by(F.struct("confidence", "source_file"), F.struct(rank, "source_file")).alias("b")).select("source", "target", "relation", "b.*")


def link_workspace(g: Graph, imports: DataFrame, packages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Links of a merged graph: of its import edges, and of imports (repo, file, module, names) scanned from sources."""
    scanned = imports.withColumn("source", F.lit(None).cast("string"))
    return link_repos(match_packages(graph_imports(g).unionByName(scanned.select("repo", "file", "module", "names", "source")), packages), g.nodes, sites)


def derive_key(candidates: DataFrame) -> DataFrame:
    """(root, key, method) of candidates (root, config, remote, git_root, children array, basename): the first that is there.

    Several children without anything better are ambiguous.
    """
    remote = parse_remote(F.col("remote"))[0]
    base = lambda c: F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    many = F.size("children") > 1
    method = F.when(F.col("config").isNotNull(), "config").when(F.col("remote").isNotNull(), "git_remote").when(F.col("git_root").isNotNull(), "git_root").when(F.size("children") == 1, "git_child").when(many, "ambiguous").otherwise("dir_basename")
    key = F.when(F.col("config").isNotNull(), F.col("config")).when(F.col("remote").isNotNull(), remote).when(F.col("git_root").isNotNull(), base(F.col("git_root"))).when(F.size("children") == 1, base(F.col("children")[0])).when(~many, F.col("basename"))
    return candidates.select("root", F.when(key.isNotNull(), project_key(key)).alias("key"), method.alias("method"))


def identity_of(candidates: DataFrame) -> DataFrame:
    """(root, remote, confidence): a remote identifies a repository with high confidence, its root with medium, a name with low."""
    confidence = F.when(F.col("remote").isNotNull(), "high").when(F.col("git_root").isNotNull(), "medium").otherwise("low")
    return candidates.select("root", normalize_remote(F.col("remote")).alias("remote"), confidence.alias("confidence"))


def workspace_mode(flag: str | None, declared: bool, child_repos: int) -> str:
    """workspace or single: a flag decides, then the declaration, then two or more child repositories."""
    return flag or ("workspace" if declared or child_repos >= 2 else "single")


def registry_upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries (root, project_key, last_build) with new's; a root's last build wins."""
    return entries.unionByName(new).groupBy("root").agg(F.max_by("project_key", "last_build").alias("project_key"), F.max("last_build").alias("last_build"))


def registry_available(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return entries.join(roots.select("root", F.lit(True).alias("available")).distinct(), "root", "left").withColumn("available", F.coalesce("available", F.lit(False)))
