"""Pages that draw a graph: its best connected nodes, one repository among them, or repositories as a whole.

A page holds at most a given number of nodes and the edges among them, so what comes to the
driver is bounded; the drawing library's text is the caller's to give.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import stats
from weftline.operators.traversal import Graph, induced
from weftline.plans.lineage import cut

PAGE = """<!doctype html>
<html><head><meta charset="utf-8"><title>{title}</title><style>body{{margin:0;font:14px sans-serif}}#graph{{height:90vh}}header{{padding:8px}}</style></head>
<body><header><b>{title}</b> <span id="totals"></span> <input id="find" placeholder="find"></header><div id="graph"></div>
<script>{script}</script>
<script type="application/json" id="data">{data}</script>
<script>
const data = JSON.parse(document.getElementById("data").textContent);
document.getElementById("totals").textContent = data.totals.nodes + " nodes, " + data.totals.edges + " edges" + (data.truncated ? " (best connected shown)" : "");
if (window.vis) {{
  const nodes = new vis.DataSet(data.nodes), edges = new vis.DataSet(data.edges);
  const net = new vis.Network(document.getElementById("graph"), {{nodes, edges}}, {{nodes: {{shape: "dot"}}}});
  document.getElementById("find").onchange = e => {{
    const hit = data.nodes.find(n => n.id === e.target.value || n.label === e.target.value);
    if (hit) net.focus(hit.id, {{scale: 1}});
  }};
}}
</script></body></html>
"""


def embedded(value: object) -> str:
    """JSON that no script element is closed by."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True).replace("</", "<\\/")


def page(title: str, data: dict, script: str = "") -> str:
    return PAGE.format(title=html.escape(title), script=script, data=embedded(data))


def data_of(text: str) -> dict:
    """The data that a page holds."""
    return json.loads(text.split('id="data">', 1)[1].split("</script>", 1)[0])


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict() for r in df.orderBy(*order).collect()]


def graph_page(g: Graph, title: str, max_nodes: int = 6000, repo: str | None = None, script: str = "", deg: DataFrame | None = None) -> str:
    """The max_nodes best connected nodes and the edges among them; with repo, nodes of other repositories are dimmed.

    deg has the degrees (stats.degrees, not structural) if several pages need them; else they are stored for this one.
    """
    deg = cut(stats.degrees(g.edges, False), "zstd") if deg is None else deg
    shown, _, truncated = stats.graph_payload(g, max_nodes, deg)
    shown = cut(shown)
    edges = induced(g.edges, shown)
    ids = F.broadcast(shown.select("id").limit(max_nodes))
    nodes = stats.vis_nodes(g, deg=deg).join(ids, "id").join(g.nodes.select("id", F.coalesce("repo", F.lit("unknown")).alias("repo"), "kind", "source_file"), "id")
    nodes = nodes.withColumn("value", F.sqrt(F.col("degree") + 1))
    if repo is not None:
        nodes = nodes.withColumn("opacity", F.when(F.col("repo") == repo, 1.0).otherwise(0.2))
    drawn = _rows(nodes, "id")
    groups: dict[str, int] = {}
    for n in drawn:
        groups[n["group"]] = groups.get(n["group"], 0) + 1
    totals = {"nodes": g.nodes.count(), "edges": g.edges.count()}
    return page(title, {"mode": "drilldown" if repo else "single", "repo": repo, "nodes": drawn, "edges": _rows(stats.vis_edges(edges), "from", "to", "relation"), "layers": groups, "totals": totals, "truncated": truncated}, script)


def constellation_page(g: Graph, title: str, script: str = "") -> str:
    """A node a repository, sized by its nodes, and an edge for each pair that depends on one another."""
    sums = cut(stats.repo_sums(g))  # a row a pair of repositories, for the nodes and for the links
    nodes = stats.constellation(g, sums)
    spots = nodes.join(stats.constellation_layout(nodes.select("repo")), "repo").withColumn("id", F.col("repo")).withColumn("label", F.col("repo"))
    pairs = stats.repo_pairs(g, sums).select(F.col("source_repo").alias("from"), F.col("target_repo").alias("to"), F.col("weight").alias("value"))
    drawn, links = _rows(spots, "id"), _rows(pairs, "from", "to")
    return page(title, {"mode": "constellation", "nodes": drawn, "edges": links, "totals": {"nodes": len(drawn), "edges": len(links)}, "truncated": False}, script)
