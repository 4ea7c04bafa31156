"""Components: what all rounds write together, against the first."""

from __future__ import annotations

from lodestone.operators import graph


def test_rounds_shrink(spark, monkeypatch):
    """Chains of 2000 nodes, each linked with the next four, and a star, hold together; rounds write a small multiple of the edges."""
    chain = [(c * 2000 + i, c * 2000 + i + k) for c in range(2) for i in range(1996) for k in range(1, 5)]
    edges = spark.createDataFrame(chain + [(9000, 9000 + i) for i in range(1, 900)] + [(20_000, 20_000), (7, None)], "src long, dst long")
    plain, sizes = graph.stored, []

    def counted(rows, *schema):
        out = plain(rows, *schema)
        sizes.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(graph, "stored", counted)
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    want = {i: i // 2000 * 2000 for i in range(4000) if i % 2000 < 2000} | {9000 + i: 9000 for i in range(900)} | {20_000: 20_000}
    assert got == want
    pairs = [n for columns, n in sizes if columns == ["src", "dst"]]
    nodes = [n for columns, n in sizes if columns == ["node", "least", "to"]]
    assert pairs[0] == len(chain) + 900 and sum(pairs) < 2 * pairs[0] and sum(nodes) < 3 * nodes[0]
