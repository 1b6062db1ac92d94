"""Recall of the vector search where few queries have links in a shard, and links counted without the row itself."""

import numpy as np
import pandas as pd

from clickweave.llm import vector_dedup


def unit(v):
    return v / np.linalg.norm(v, axis=1)[:, None]


def islands(rng, groups, size, width=24):
    """Tight groups larger than a neighbour list, so that no neighbour lies in another group."""
    centers = unit(rng.normal(size=(groups, width)))
    return centers, unit(np.repeat(centers, size, axis=0) + rng.normal(size=(groups * size, width)) * 0.03)


def test_audit_sees_queries_with_links():
    rng = np.random.default_rng(3)
    centers, x = islands(rng, 150, 14)
    q = unit(rng.normal(size=(512, 24)))
    # None of the queries taken as they come has a link.
    linked = np.setdiff1d(np.arange(512), np.linspace(0, 511, 16).astype(int))[::4]
    q[linked] = unit(centers[: len(linked)] + rng.normal(size=(len(linked), 24)) * 0.03)
    graph = vector_dedup.Graph(x)
    beam = vector_dedup.settled_beam(graph, 0.9)
    found, _ = vector_dedup.links_of(graph, q, 0.9, beam)
    truth = [np.flatnonzero(row >= 0.9) for row in q @ x.T]
    assert sum(map(len, truth)) > 1000
    assert vector_dedup.recall(truth, found) >= vector_dedup.RECALL


def test_many_shards_against_brute_force(spark):
    rng = np.random.default_rng(5)
    _, x = islands(rng, 200, 15)
    x = np.concatenate([x, x[:40], unit(rng.normal(size=(500, 24)))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df, 0.9, 600).collect()}
    linked = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(linked, False)
    truth, found = linked.sum(axis=1), np.array([got[i].n_links for i in range(len(x))])
    assert (found >= 0).all() and (found <= truth).all()
    assert found.sum() >= vector_dedup.RECALL * truth.sum()
    first = [min(np.flatnonzero(linked[i]).tolist() + [i]) for i in range(len(x))]
    assert [got[i].component_id for i in range(len(x))] == first


def test_loose_groups_need_no_wide_beam():
    rng = np.random.default_rng(7)
    centers = unit(rng.normal(size=(160, 64)))
    x = unit(np.repeat(centers, 25, axis=0) + rng.normal(size=(4000, 64)) * 0.05)
    graph = vector_dedup.Graph(x)
    assert vector_dedup.settled_beam(graph, 0.9) < 256
    q = x[rng.permutation(4000)[:512]]
    found, beam = vector_dedup.links_of(graph, q, 0.9)
    truth = [np.flatnonzero(row >= 0.9) for row in q @ x.T]
    assert beam < 256 and sum(map(len, truth)) > 1000
    assert vector_dedup.recall(truth, found) >= vector_dedup.RECALL


def test_every_row_can_be_reached():
    rng = np.random.default_rng(8)
    _, x = islands(rng, 40, 60)
    graph = vector_dedup.Graph(x)
    draw = np.random.default_rng(0)
    draw.random(len(x))
    order = draw.permutation(len(x))
    for members, (ends, lists) in graph.layers:
        first = int(order[members].argmin())
        met, ahead = {first}, [first]
        while ahead:
            a = ahead.pop()
            new = set(lists[ends[a] : ends[a + 1]].tolist()) - met
            met |= new
            ahead += new
        assert len(met) == len(members)


def test_graphs_of_one_and_two_rows():
    for n in (1, 2):
        graph = vector_dedup.Graph(np.eye(4)[:n])
        found, _ = vector_dedup.links_of(graph, np.eye(4)[:n], 0.9)
        assert [h.tolist() for h in found] == [[i] for i in range(n)]


def test_vectors_search_few_cells_and_lose_no_links_between_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    # A large group in one cell, loose groups across cells, and single vectors, repeated ones among them.
    x = np.concatenate([unit(rng.normal(size=(1, 24)) + rng.normal(size=(500, 24)) * 0.02), islands(rng, 150, 10)[1]])
    x = np.concatenate([x, unit(rng.normal(size=(1000, 24))), x[490:520]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = []
    asking = vector_dedup._asking
    monkeypatch.setattr(vector_dedup, "_asking", lambda *a: asked.append(asking(*a)) or asked[-1])
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df, 0.9, 400).collect()}
    linked = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(linked, False)
    truth, found = linked.sum(axis=1), np.array([got[i].n_links for i in range(len(x))])
    assert (found <= truth).all() and found.sum() >= 0.995 * truth.sum()
    rows = asked[0].collect()
    cells = len({r.home for r in rows})
    assert cells > 20 and all(r.home in r.asked for r in rows)
    # Before, every vector searched every shard.
    assert sum(len(r.asked) for r in rows) < cells * len(rows) / 3


def test_the_gap_finds_the_links_of_audited_queries():
    assert vector_dedup.gap_for(pd.DataFrame(columns=["query", "step", "links"])) == 0.0
    needed = pd.DataFrame({"query": [1, 1, 2], "step": [0, 7, 3], "links": [900, 100, 50]})
    assert vector_dedup.gap_for(needed) == 7 * vector_dedup.BIN
    to = np.array([[0.9, 0.8, 0.1], [0.5, 0.6, 0.2]])
    gaps = vector_dedup.gaps_of_links(to, to, np.array([0, 0]), np.array([1, 0]))
    assert np.allclose(gaps, [0.1, 0.0])


def test_links_to_cells_that_are_not_asked_are_found(spark, monkeypatch):
    # Vectors all over a low sphere: many cells have links across their borders, farther off than the gap.
    x = unit(np.random.default_rng(11).normal(size=(2000, 5)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = []
    asking = vector_dedup._asking
    monkeypatch.setattr(vector_dedup, "_asking", lambda *a: asked.append(asking(*a)) or asked[-1])
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df, 0.9, 300).collect()}
    linked = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(linked, False)
    # Before, links across borders were missing.
    assert [got[i].n_links for i in range(len(x))] == linked.sum(axis=1).tolist()
    component = np.arange(len(x))
    while (component != (least := np.minimum(component, np.where(linked, component, len(x)).min(axis=1)))).any():
        component = least
    assert [got[i].component_id for i in range(len(x))] == component.tolist()
    rows = asked[0].collect()
    cells = len({r.home for r in rows})
    assert cells > 20 and any(r.far for r in rows) and all(not set(r.far) & set(r.asked) for r in rows)


def test_cells_that_are_ruled_out_hold_no_links():
    rng = np.random.default_rng(12)
    for x, most in ((islands(rng, 40, 25)[1], 0.5), (unit(rng.normal(size=(1000, 4))), 0.9), (unit(rng.normal(size=(1000, 64))), 1.0)):
        centres = vector_dedup.centres_of(x, 30)
        s = x @ centres.T
        may = vector_dedup.may_link(s, centres, 0.9)
        # Vectors at the very border of a link, too.
        beside = unit(0.9 * x + np.sqrt(1 - 0.81) * unit((side := rng.normal(size=x.shape)) - (side * x).sum(axis=1)[:, None] * x))
        home = s.argmax(axis=1)
        a, b = np.nonzero(x @ x.T >= 0.9)
        assert may[a, home[b]].all() and may[np.arange(len(x)), (beside @ centres.T).argmax(axis=1)].all()
        assert may.mean() <= most
    assert vector_dedup.may_link(s, centres, -0.1).all()


def test_blocks_are_compared_whole():
    rng = np.random.default_rng(13)
    x = np.concatenate([islands(rng, 60, 30)[1], unit(rng.normal(size=(1000, 24)))])[rng.permutation(2800)]
    for q, other in ((x, x), (x[:700], x[700:])):
        truth = q @ other.T >= 0.9
        pairs = [p for a, b in vector_dedup.pairs_within(q, other, 0.9) for p in zip(a.tolist(), b.tolist(), strict=True)]
        expected = np.argwhere(np.triu(truth, 1) if q is other else truth)
        assert sorted(pairs) == [tuple(p) for p in expected.tolist()]
    # Cosines that single precision can't tell from the least one.
    least = 0.9
    x = np.array([[1.0, 0.0], [least, np.sqrt(1 - least**2)], [least - 1e-9, np.sqrt(1 - (least - 1e-9) ** 2)]])
    assert [(a.tolist(), b.tolist()) for a, b in vector_dedup.pairs_within(x[:1], x[1:], least)] == [([0], [0])]


def test_components_of_links():
    label = vector_dedup.joined(np.arange(8), np.array([5, 3, 7, 7]), np.array([3, 1, 6, 7]))
    assert label.tolist() == [0, 1, 2, 1, 4, 1, 6, 6]
    assert vector_dedup.joined(label, np.array([6, 4]), np.array([5, 0])).tolist() == [0, 1, 2, 1, 0, 1, 1, 1]
