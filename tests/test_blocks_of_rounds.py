"""rounds over blocks, whose links are not shuffled again, give the moves that the definition gives."""

import random

from pyspark.sql import functions as F

from weftline.operators import community, stats
from weftline.operators.traversal import Graph


def plain_rounds(weights, half, rounds):
    """Root of each node by the definition: the halves move in turn, each node to the best (gain, staying, largest root)."""
    near, two_m = {}, sum(weights.values())
    for (a, b), w in weights.items():
        near.setdefault(a, {})[b] = w
    k, root, idle = {a: sum(x.values()) for a, x in near.items()}, {a: a for a in near}, 0
    for r in range(rounds):
        total, moves = {}, {}
        for a, c in root.items():
            total[c] = total.get(c, 0.0) + k[a]
        for a in near:
            if half[a] == r % 2:
                links = {}
                for b, w in near[a].items():
                    links[root[b]] = links.get(root[b], 0.0) + w
                gain, stay, best = max((round(w - (total[c] - (k[a] if c == root[a] else 0.0)) * k[a] / two_m, 9), c == root[a], c) for c, w in links.items())
                if not stay and gain > 0:
                    moves[a] = best
        idle = 0 if moves else idle + 1
        if idle == 2:
            break
        root |= moves
    return root


def test_blocks_move_as_defined(spark):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(90)]
    edges = [(rng.choice(ids[:80]), rng.choice(ids[:80]), "calls", float(rng.randint(0, 3))) for _ in range(300)] + [("n1", "gone", "calls", 1.0)]
    g = Graph(spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(edges, "source string, target string, relation string, weight double"))
    weights = {(r["a"], r["b"]): r["weight"] for r in stats.weighted_adjacency(g).collect()}
    half = {r["id"]: r["h"] for r in g.nodes.select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("h")).collect()}
    for rounds, block in ((1, 1000), (5, 60)):  # 4 blocks of some 150 entries, and 12
        root = {x: x for x in ids} | plain_rounds(weights, half, rounds)
        first, number = {}, {}
        for x in sorted(ids):
            number[x] = first.setdefault(root[x], len(first))
        assert {r["id"]: r["community"] for r in community.communities_in_rounds(g, rounds, block).collect()} == number


def test_no_edges_no_rounds(spark):
    g = Graph(spark.createDataFrame([("b",), ("a",)], "id string"), spark.createDataFrame([("a", "a", "calls", 1.0)], "source string, target string, relation string, weight double"))
    assert sorted(map(tuple, community.communities_in_rounds(g).collect())) == [("a", 0), ("b", 1)]
