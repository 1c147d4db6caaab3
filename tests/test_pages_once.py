"""Pages share what they count."""

from weftline.operators import stats
from weftline.plans.all_queries import QUERIES


def test_pages_count_edges_once(spark, sf_dir, monkeypatch):
    """F8: degrees and the sums between repositories are found once for three pages, not once a use."""
    asked = []
    for name in ("degrees", "edge_repos"):
        monkeypatch.setattr(stats, name, lambda *a, _f=getattr(stats, name), _n=name, **k: (asked.append(_n), _f(*a, **k))[1])
    rows = {r["mode"]: r["nodes"] for r in QUERIES["K11_graph_pages"](spark, sf_dir).collect()}
    assert rows["single"] == rows["drilldown"] > 0 and sorted(asked) == ["degrees", "edge_repos"]
