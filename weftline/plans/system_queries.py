"""Queries over stores, sinks, feeds and gates. They write to the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.operators import audit, freshness, postings
from weftline.operators import memory as m
from weftline.operators.traversal import Graph, source_sink_paths
from weftline.plans.graph_queries import paths_sql
from weftline.plans.lineage import shared_dir
from weftline.plans.memory_queries import INDEXED, bm25_sql, indexed
from weftline.plans.registry import graph, ids, query
from weftline.plans.workload import key, with_tables
from weftline.sources import ingest, store
from weftline.streaming import outbox


def folder(w) -> str:
    return f"{shared_dir(w.spark)}/{uuid.uuid4().hex}"


@query("K3_atomic_swap", with_tables("edges") + "SELECT source, target FROM edges WHERE relation = 'contains'")
def _(w):
    root, edges = folder(w), w.edges.select("source", "target", "relation")
    store.replace({"edges": edges.where("relation = 'imports'")}, root)
    store.replace({"edges": edges.where("relation = 'contains'")}, root)
    return store.load(w.spark, root, "edges")[0].select("source", "target")


@query("K4_clear", with_tables("edges") + "SELECT source, target FROM edges WHERE false")
def _(w):
    root = folder(w)
    store.clear({"edges": w.edges.select("source", "target")}, root)
    return store.load(w.spark, root, "edges")[0]


@query("K9_append_events", "SELECT 'event:' || event_id AS id, event_type AS type FROM events")
def _(w):
    path = folder(w)
    rows = w.outbox.withColumnRenamed("schema_version", "schemaVersion")
    outbox.append(rows.where("ts % 2 = 0"), path)
    outbox.append(rows.where("ts % 2 = 1"), path)
    return outbox.read(w.spark, path).select("id", "type")


@query("E2_fail_open_emit", "SELECT 'nowhere' AS c, false AS written, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'folder', true, count(*) FROM events")
def _(w):
    path = folder(w)
    failed, written = outbox.append(w.outbox, "/proc/none/events"), outbox.append(w.outbox.withColumnRenamed("schema_version", "schemaVersion"), path)
    back = outbox.read(w.spark, path).agg(F.count("id").alias("n")).select(F.lit("folder").alias("c"), F.lit(written).alias("written"), "n")
    return w.outbox.where("false").agg(F.count("*").alias("n")).select(F.lit("nowhere").alias("c"), F.lit(failed).alias("written"), "n").unionByName(back)


@query("E5_outbox_switch", "SELECT event_type AS type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1")
def _(w):
    path, rows = folder(w), w.outbox.withColumnRenamed("schema_version", "schemaVersion")
    odd = F.substring("id", 7, 20).cast("long") % 2 == 1
    outbox.append(rows.where(~odd), path, enabled=False)  # leaves nothing
    outbox.append(rows.where(odd), path)
    return outbox.read(w.spark, path).groupBy("type").agg(F.count("*").alias("n"))


@query("E7_streamed_outbox", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def _(w):
    path, out = folder(w), folder(w)
    outbox.append(w.outbox.withColumnRenamed("schema_version", "schemaVersion"), path)
    run = outbox.stream(w.spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(w)).trigger(availableNow=True).start()
    run.awaitTermination()
    return w.spark.read.parquet(out).groupBy("type").agg(F.count("*").alias("n"))


@query("S6_extractor_payloads", "SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'contains' AS relation, '' AS context FROM nation WHERE n_nationkey % 4 <> 0")
def _(w):
    version = F.when(F.col("n_nationkey") % 4 == 0, 2).otherwise(1).alias("schemaVersion")
    source, target = key("region", "n_regionkey"), key("nation", "n_nationkey")
    nodes = F.array(F.struct(target.alias("id"), F.col("n_name").alias("label"))).alias("nodes")
    edges = F.array(F.struct(source.alias("source"), target.alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"))).alias("edges")
    docs = w.table("nation").select(F.to_json(F.struct(version, F.struct(F.lit("x").alias("id"), F.lit("1").alias("version")).alias("extractor"), nodes, edges)).alias("value"))
    return ingest.payload_edges(ingest.parse_payloads(docs)).select("source", "target", "relation", "context")


@query("D8_freshness_gate", "SELECT * FROM (VALUES ('fresh', 'v1', 0), ('stale', 'v2', 1), ('missing', 'v2', 1), ('refused', NULL, 0)) v(c, graph, rebuilds)")
def _(w):
    rows = w.spark.createDataFrame([("/a", 1.0, "x", 1)], "path string, mtime double, hash string, ord int")
    more = w.spark.createDataFrame([("/b", 1.0, "x", 1)], "path string, mtime double, hash string, ord int")
    out = []
    for case, start, current in (("fresh", "v1", rows), ("stale", "v1", more), ("missing", None, rows), ("refused", "v1", more)):
        state = {"v": start, "n": 0}

        def rebuild(state=state) -> None:
            state["v"], state["n"] = "v2", state["n"] + 1

        mode = freshness.posture("refuse" if case == "refused" else None, None)
        try:
            got = freshness.open_fresh(lambda s=state: s["v"], rebuild, lambda c=current: m.staleness(c, rows), mode, build_if_missing=True)
        except RuntimeError:
            got = None
        out.append((case, got, state["n"]))
    return w.spark.createDataFrame(out, "c string, graph string, rebuilds int")


@query("J1_search_join", INDEXED + bm25_sql(["the"]) + "SELECT id, title, topic_key, score FROM hits")
def _(w):
    index, notes = indexed(w)
    asked = postings.phrases("the", index.analyzer)
    hits = postings.scored(index.read(asked), asked, *index.totals())
    return notes.where("superseded_by is null").join(hits, "id").select("id", "title", "topic_key", F.round("score", 6).alias("score"))


def _sources(w):
    return w.nodes.where("kind = 'config'").select("id")


def _whole(w) -> Graph:
    return w.graph


@query("U3_audit_paths", paths_sql("SELECT id AS seed FROM nodes WHERE kind = 'config'", ("part:5", "part:7")) + "SELECT source, sink, CAST(hops AS INTEGER) AS hops, weakest FROM ways_in")
def _(w):
    return source_sink_paths(_whole(w), _sources(w), ids(w, "part:5", "part:7", name="id")).select("source", "sink", "hops", "weakest")


@query("K10_render_audit")
def _(w):
    sinks = w.spark.createDataFrame([("part:5", "sql"), ("part:7", "path-traversal")], "id string, category string")
    g = _whole(w)
    found = audit.findings(source_sink_paths(g, _sources(w), sinks.select("id")), sinks)
    pack = audit.build_pack(found, g)
    return w.spark.createDataFrame([("markdown", audit.render_markdown(pack)), ("html", audit.render_html(pack)), ("json", audit.serialised(pack))], "format string, text string")


@query("W11_greedy_budget")
def _(w):
    sinks = w.spark.createDataFrame([("part:5", "sql"), ("part:7", "path-traversal")], "id string, category string")
    g = _whole(w)
    found = audit.findings(source_sink_paths(g, _sources(w), sinks.select("id")), sinks)
    pack = audit.build_pack(found, g, 2048)
    return w.spark.createDataFrame([(len(pack["paths"]), pack["prunedPaths"], len(audit.serialised(pack).encode()) <= 2048)], "kept int, pruned int, fits boolean")


@query("S7_symbol_index")
def _(w):
    from weftline.sources.index import document

    occurrence = bytes([0x0A, 3, 1, 2, 5, 0x12, 1, 0x73, 0x18, 1])
    data = bytes([0x0A, 1, 0x61, 0x12, len(occurrence)]) + occurrence + bytes([0x22, 2, 0x74, 0x73])
    return w.spark.createDataFrame([document(data)], "path string, language string, occurrences string")
