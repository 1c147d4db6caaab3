"""Node-link documents on disk."""

import gzip
import json
import os

from weftline.sources import store


def test_document_is_compressed_and_whole(spark, tmp_path):
    """compressed parts are the same document, with keys that are null or not text, and equal keys."""
    nodes = spark.createDataFrame([(i, f"label {i}") for i in range(2000)], "id long, label string")
    rows = [(f"a{i}", f"b{i}", "calls", None if i % 2 else "", float(i)) for i in range(2000)] + [("a1", "b1", "calls", None, 0.5)]
    edges, path = spark.createDataFrame(rows, "source string, target string, relation string, context string, weight double"), str(tmp_path / "d")
    store.write_node_link(nodes, edges, path, "gzip")
    parts = sorted(x for x in os.listdir(path) if x.startswith("part-"))
    text = "".join(gzip.open(f"{path}/{x}", "rt").read() for x in parts)
    doc = json.loads(text)
    assert [x["id"] for x in doc["nodes"]] == sorted(range(2000), key=str) and len(doc["links"]) == 2001
    assert sum(os.path.getsize(f"{path}/{x}") for x in parts) < len(text) / 4
    back = store.read_node_link(spark, path, nodes.schema, edges.schema)
    assert back[0].exceptAll(nodes).isEmpty() and back[0].count() == 2000 and back[1].exceptAll(edges).isEmpty() and back[1].count() == 2001
