"""Operators on hand-made graphs, and what must hold on any graph."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratagraph.config import Config
from stratagraph.operators import coarsen, graph, matching, vectors, walks
from stratagraph.plans import base, evaluate, linear, refine
from stratagraph.plans.multilevel import multilevel_embed
from stratagraph.sources import text

PATH6 = [(i, i + 1) for i in range(5)]
STAR4 = [(0, 1), (0, 2), (0, 3)]
BARBELL8 = [(a, b) for k in (0, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(3, 4)]
SMALL = Config(embed_dim=4, coarsen_m=1, walks=2, walk_length=6, window=2, epochs=1, rank=6, eigen_rounds=8, refine_epochs=8, samples=6, runs=2, sdne_units=(8, 8), sdne_epochs=2)


def make(spark, pairs, vertices=None):
    rows = [(*p, 1.0) if len(p) == 2 else p for p in pairs]
    nodes = spark.createDataFrame([(v,) for v in vertices], "node_id long") if vertices is not None else None
    return graph.from_pairs(spark.createDataFrame(rows, "u long, v long, wgt double"), nodes)


def ring(spark, n=24):
    return make(spark, [(i, (i + 1) % n) for i in range(n)] + [(i, (i + 5) % n) for i in range(n)])


def triples(df):
    return sorted(map(tuple, df.select("src", "dst", "wgt").collect()))


def test_pairs_loops_and_repeats(spark):
    g = make(spark, [(1, 2, 2.0), (2, 1, 3.0), (3, 3, 4.0)], [1, 9])
    assert triples(g.edges) == [(1, 2, 5.0), (2, 1, 5.0), (3, 3, 4.0)]
    assert sorted(map(tuple, g.nodes.collect())) == [(1, 1.0, 5.0, 1), (9, 1.0, 0.0, 0)]
    assert triples(graph.canonical(g.edges)) == [(1, 2, 5.0), (3, 3, 4.0)]
    assert triples(graph.adjacency(make(spark, [(0, 1), (1, 1)]), identity=True)) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0)]


@pytest.mark.parametrize(
    ("pairs", "groups", "edges"),
    [
        (PATH6, {0: [0, 1], 2: [2, 3], 4: [4, 5]}, [(0, 0, 2.0), (0, 2, 1.0), (2, 0, 1.0), (2, 2, 2.0), (2, 4, 1.0), (4, 2, 1.0), (4, 4, 2.0)]),
        (STAR4, {0: [0], 1: [1, 2, 3]}, [(0, 1, 3.0), (1, 0, 3.0)]),
        (BARBELL8, {0: [0, 1], 2: [2, 3], 4: [4, 7], 5: [5, 6]}, None),
    ],
)
def test_one_level(spark, pairs, groups, edges):
    g = make(spark, pairs)
    cmap, coarse = coarsen.coarsen_once(g, 100.0, parallel=False)
    found: dict[int, list[int]] = {}
    for r in cmap.orderBy("node_id").collect():
        found.setdefault(r.coarse_id, []).append(r.node_id)
    assert found == groups
    if edges:
        assert triples(coarse.edges) == edges
    for column, frame in (("wgt", "edges"), ("node_wgt", "nodes"), ("degree", "nodes")):
        total = lambda x: getattr(x, frame).agg({column: "sum"}).first()[0]  # noqa: E731, B023
        assert total(g) == total(coarse)


def test_equivalence(spark):
    g = make(spark, [(0, 2), (1, 2), (0, 3), (1, 3), (4, 5)])
    exact = {r.node_id: r.group_id for r in matching.equivalent_exact(g).collect()}
    assert exact == {0: 0, 1: 0, 2: 2, 3: 2}
    # Equal neighbour sets have equal signatures.
    loose = {r.node_id: r.group_id for r in matching.equivalent_minhash(g).collect()}
    assert exact.items() <= loose.items()
    alone = make(spark, [(0, 1)], [0, 1, 7, 8])
    assert {r.node_id for r in matching.equivalent_exact(alone, isolated=True).collect()} == {7, 8}


edges_strategy = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges_strategy)
def test_matchings(spark, pairs):
    g = make(spark, pairs)
    free = g.nodes.select("node_id")
    linked = {(r.src, r.dst) for r in g.edges.collect()}
    for found in (matching.heavy_sequential(g, free, 2.0), matching.heavy_rounds(g, free, 2.0, tail=0)):
        rows = found.collect()
        used = [x for r in rows for x in (r.a, r.b)]
        assert len(used) == len(set(used))  # no node twice
        assert all((r.a, r.b) in linked and r.a != r.b for r in rows)
        assert not [(a, b) for a, b in linked if a != b and a not in used and b not in used]  # none can be added
    assert matching.heavy_sequential(g, free, 1.5).count() == 0  # too heavy together


def test_greedy_order():
    edges = np.array([(0, 1), (1, 0), (1, 2), (2, 1)])
    a, b = matching.greedy(edges[:, 0], edges[:, 1], np.array([0.5, 0.5, 0.9, 0.9]), np.array([0, 1, 2]), np.array([1, 2, 1]))
    assert (a.tolist(), b.tolist()) == ([0], [1])
    rng = np.random.default_rng(1)
    for _ in range(50):  # against visiting node by node
        n = int(rng.integers(1, 12))
        pairs = {(a, b): float(rng.integers(1, 4)) for a in range(n) for b in range(a + 1, n) if rng.uniform() < 0.4}
        both = np.array([(a, b) for a, b in pairs] + [(b, a) for a, b in pairs], int).reshape(-1, 2)
        nw = np.array([*pairs.values()] * 2)
        n_adj = rng.integers(0, 3, n)
        taken, wanted = set(), []
        for node in sorted(range(n), key=lambda i: (n_adj[i], i)):
            free = sorted((-pairs[min(node, m), max(node, m)], m) for m in range(n) if (min(node, m), max(node, m)) in pairs and m not in taken and m != node)
            if node not in taken and free:
                wanted.append((node, free[0][1]))
                taken |= {node, free[0][1]}
        a, b = matching.greedy(both[:, 0], both[:, 1], nw, np.arange(n), n_adj)
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == wanted


def test_greedy_edges_pass_through(spark, monkeypatch):
    """The matching by edges that pass through is that on arrays, with loops, heavy pairs and nodes that are not free; no task holds
    all edges."""
    rng = np.random.default_rng(2)
    g = make(spark, [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(1, 4, 400), strict=True)])
    g = graph.Graph(g.nodes.withColumn("node_wgt", 1.0 + F.col("node_id") % 3), g.edges)
    free = g.nodes.filter("node_id % 7 <> 0").select("node_id")
    edges = matching._eligible(matching._among(graph.normalised_weights(g), free), g.nodes, 4.0)
    wanted = sorted(map(tuple, matching._in_order(edges, g.nodes.join(free, "node_id", "left_semi")).collect()))
    monkeypatch.setattr(matching, "_in_order", None)
    assert sorted(map(tuple, matching.heavy_sequential(g, free, 4.0).collect())) == wanted
    assert 15 < len(wanted) < 30
    batches = [[(0, 2), (0, 3)], [], [(0, 5), (1, 2), (1, 3)], [(2, 0)], [(3, 1), (4, 5)]]
    import pyarrow as pa

    parts = [pa.RecordBatch.from_pydict({"src": pa.array([x for x, _ in b], pa.int64()), "dst": pa.array([y for _, y in b], pa.int64())}) for b in batches]
    assert [(r["a"], r["b"]) for p in matching._visited(iter(parts)) for r in p.to_pylist()] == [(0, 2), (1, 3), (4, 5)]


def test_rounds_above_the_threshold_whatever_the_flag(spark, monkeypatch):
    """A large graph is never matched in one task unless asked for."""
    monkeypatch.setattr(coarsen, "heavy_sequential", None)
    g = ring(spark, 40)
    for parallel in (True, False):
        cmap, coarse = coarsen.coarsen_once(g, 20.0, parallel, threshold=10)
        assert cmap.count() == 40 and coarse.nodes.count() < 40
    with pytest.raises(TypeError):
        coarsen.coarsen_once(g, 20.0, False, threshold=10, exact_order=True)


def test_rounds_without_the_greedy_end(spark):
    g = ring(spark, 60)
    linked = {(r.src, r.dst) for r in g.edges.collect()}
    rows = matching.heavy_rounds(g, g.nodes.select("node_id"), 20.0, tail=0).collect()
    used = [x for r in rows for x in (r.a, r.b)]
    assert len(used) == len(set(used)) and all((r.a, r.b) in linked for r in rows)
    assert not [(a, b) for a, b in linked if a != b and a not in used and b not in used]


def test_granted_pairs_are_apart(spark):
    g = ring(spark)
    for turn in range(4):
        rows = matching.granted_pairs(graph.normalised_weights(g), turn).collect()
        used = [x for r in rows for x in (r.a, r.b)]
        assert len(used) == len(set(used))


def test_hierarchy(spark):
    g = ring(spark, 40)
    levels = coarsen.hierarchy(g, 2, 4, parallel=False)
    assert levels[-1].size <= 10 and levels[0].size == 40
    report = coarsen.report(levels).orderBy("level").collect()
    assert len({r.wgt for r in report}) == 1 and len({r.node_wgt for r in report}) == 1
    with pytest.raises(ValueError, match="dimension"):
        coarsen.hierarchy(make(spark, STAR4), 1, 128, parallel=False)
    # Nothing to match: it ends.
    lonely = make(spark, [(i, i) for i in range(6)])
    assert len(coarsen.hierarchy(lonely, 2, 2, parallel=False)) == 1


def test_components(spark):
    g = make(spark, [(1, 2), (2, 3), (5, 6), (9, 9), (20, 3), (21, 20)])
    assert {r.node_id: r.component for r in graph.components(g.edges, g.nodes).collect()} == {1: 1, 2: 1, 3: 1, 20: 1, 21: 1, 5: 5, 6: 5, 9: 9}
    assert not graph.is_connected(g.edges, g.nodes)
    line = make(spark, [(i, i + 1) for i in range(17)])
    assert graph.is_connected(line.edges, line.nodes)


def test_dense_index(spark):
    ids = spark.createDataFrame([(x,) for x in (30, 7, 7, 100, -2)], "id long")
    assert sorted(map(tuple, graph.dense_index(ids, "id").collect())) == [(-2, 0), (7, 1), (30, 2), (100, 3)]


def test_edge_list(spark, tmp_path):
    (tmp_path / "a.edgelist").write_text("0 1\n1 2 2.5\n\n2 2 3\n")
    g, index = text.read_graph(spark, str(tmp_path / "a.edgelist"), "edgelist")
    assert index is None
    assert triples(g.edges) == [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 2.5), (2, 1, 2.5), (2, 2, 3.0)]
    (tmp_path / "b.edgelist").write_text("5 100\n5 7\n")
    g, index = text.read_graph(spark, str(tmp_path / "b.edgelist"), "edgelist")
    assert sorted(map(tuple, index.collect())) == [(5, 0), (7, 1), (100, 2)]
    assert triples(g.edges) == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (2, 0, 1.0)]
    (tmp_path / "c.edgelist").write_text("2 1\n")
    with pytest.raises(ValueError, match="first id"):
        text.read_graph(spark, str(tmp_path / "c.edgelist"), "edgelist")
    with pytest.raises(ValueError, match="format"):
        text.read_graph(spark, "x", "gml")
    assert text.data_path("ppi", "metis") == "./dataset/ppi.metis"


def test_metis(spark, tmp_path):
    (tmp_path / "a.metis").write_text("% a comment\n4 3\n2 3\n1\n1 3\n\n")
    g, _ = text.read_graph(spark, str(tmp_path / "a.metis"), "metis")
    assert triples(g.edges) == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (2, 0, 1.0), (2, 2, 1.0)]
    assert sorted((r.node_id, r.n_adj) for r in g.nodes.collect()) == [(0, 2), (1, 1), (2, 2), (3, 0)]
    (tmp_path / "b.metis").write_text("2 1 1\n2 5\n1 5\n")
    assert triples(text.read_graph(spark, str(tmp_path / "b.metis"), "metis")[0].edges) == [(0, 1, 5.0), (1, 0, 5.0)]


def test_lines_are_counted_over_blocks(spark, tmp_path):
    lines = [str(i * i) for i in range(2000)]
    (tmp_path / "long.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        counted = text.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert spark.read.text(str(tmp_path / "long.txt")).select(F.input_file_block_start()).distinct().count() > 1
        assert [tuple(r) for r in counted.orderBy("line").collect()] == list(enumerate(lines))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_truth_and_embeddings(spark, tmp_path):
    (tmp_path / "x.truth").write_text("1 0 1\n3 1 1\n")
    assert sorted((r.node_id, list(r.y)) for r in text.read_truth(spark, str(tmp_path / "x.truth"), first=1).collect()) == [(0, [0, 1]), (2, [1, 1])]
    index = spark.createDataFrame([(1, 10), (3, 30)], "ext_id long, node_id long")
    assert sorted(r.node_id for r in text.read_truth(spark, str(tmp_path / "x.truth"), index).collect()) == [10, 30]
    e = spark.createDataFrame([(0, [1.0, -0.25]), (1, [1e-7, 2.0])], "node_id long, vec array<double>")
    text.write_embeddings(e, str(tmp_path / "out"), first=1)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1 1.000000 -0.250000", "2 0.000000 2.000000"]


def test_digits_of_lines(spark):
    """Ties go to the even digit of the binary value; what is no number, and empty places, as the SQL writes them."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(0, [2.0**-7, 3 * 2.0**-7, -(2.0**-7)]), (1, [0.0000005, 1.0000005, 2.5e-7]), (2, [float("nan"), float("inf"), -float("inf"), -0.0]), (3, [None, 1.5]), (4, None), (5, []), (6, [1e20, -1e-9])]
    found = {r.ext_id: r.line for r in text.embedding_lines(spark.createDataFrame(rows, "node_id long, vec array<double>")).collect()}
    assert found[0] == "0 0.007812 0.023438 -0.007812"
    for i, vec in rows:
        assert found[i] == duckdb.execute("SELECT ? || ' ' || array_to_string(list_transform(?::DOUBLE[], lambda x: format('{:.6f}', x)), ' ')", [str(i), vec]).fetchone()[0], i


def test_vectors(spark):
    e = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [6.0, 4.0])], "node_id long, vec array<double>")
    unit = {r.node_id: r.vec for r in vectors.l2_normalise(e).collect()}
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1] == [0.0, 0.0]
    scaled = {r.node_id: r.vec for r in vectors.minmax_scale(e).collect()}
    assert scaled == {0: [0.5, 1.0], 1: [0.0, 0.0], 2: [1.0, 1.0]}
    op = spark.createDataFrame([(0, 0, 2.0), (0, 2, 1.0)], "src long, dst long, wgt double")
    assert [list(r.vec) for r in vectors.propagate(op, e).collect()] == [[12.0, 12.0]]
    samples = spark.createDataFrame([(9, 0), (9, 2), (9, 2)], "node_id long, neighbor long")
    assert [list(r.vec) for r in vectors.pooled(samples, e).collect()] == [[6.0, 4.0]]


def test_walks(spark):
    g = ring(spark)
    linked = {(r.src, r.dst) for r in g.edges.collect()}
    starts = walks.starts_of(g.nodes, 2)
    paths = walks.random_walks(g.edges, starts, 18).collect()
    assert len(paths) == 48 and all(len(r.path) == 19 for r in paths)
    assert all(s in linked for r in paths for s in zip(r.path, r.path[1:], strict=False))
    again = {r.walk_id: r.path for r in walks.random_walks(g.edges.repartition(7), starts, 18).collect()}
    assert {r.walk_id: r.path for r in paths} == again
    dead = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, wgt double")
    assert walks.random_walks(dead, spark.createDataFrame([(5, 0)], "walk_id long, node_id long"), 4).first().path == [0, 1]


def test_no_walk_carries_a_hub(spark):
    """Lists of a hub come in bins, and what is drawn from them is what the whole list gives."""
    g = make(spark, [(0, i, float(i % 4 + 1) if i != 50 else 400.0) for i in range(1, 200)] + [(3, 4, 0.5)])
    bins = walks.binned_lists(g.edges).filter("src = 0").collect()
    assert len(bins) == 7 and max(len(r.dsts) for r in bins) < 120
    whole = {r.src: (r.dsts, r.sums) for r in walks.running_lists(g.edges).collect()}
    paths = walks.random_walks(g.edges, walks.starts_of(g.nodes, 2), 4).withColumn("u", F.array(*[walks.uniform(123, F.col("walk_id"), k) for k in range(1, 5)])).collect()
    for r in paths:
        for k in range(4):
            dsts, sums = whole[r.path[k]]
            assert r.path[k + 1] == dsts[min(int(np.searchsorted(sums, r.u[k] * sums[-1], "right")), len(dsts) - 1)]
    assert len(paths) == 400


def test_samples_follow_weights(spark):
    g = make(spark, [(0, 1, 1.0), (0, 2, 9.0)])
    drawn = walks.neighbour_samples(g.edges, g.nodes.filter("node_id = 0").select("node_id"), 2000).groupBy("neighbor").count().collect()
    assert {r.neighbor: r["count"] for r in drawn}[2] == pytest.approx(1800, abs=60)
    even = walks.neighbour_samples(g.edges, g.nodes.filter("node_id = 0").select("node_id"), 2000, uniform_draw=True).filter("neighbor = 1").count()
    assert even == pytest.approx(1000, abs=80)


@pytest.mark.parametrize("name", sorted(base.METHODS))
def test_base_embeddings(spark, name):
    g = ring(spark)
    rows = base.base_embedding(name)(g, SMALL).collect()
    assert sorted(r.node_id for r in rows) == list(range(24))
    assert {len(r.vec) for r in rows} == {4}


def test_sdne_spells_out_no_matrix(spark, monkeypatch):
    """The adjacency of 3,000 nodes would be 72 MB; and blocks of columns give the same codes as all columns at once."""
    import tracemalloc

    star = make(spark, [(0, i, float(i % 5 + 1)) for i in range(1, 3000)])
    tracemalloc.start()
    assert base.sdne(star, SMALL).count() == 3000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    whole = sorted(base.sdne(ring(spark), SMALL).collect())
    monkeypatch.setattr(base, "COLUMNS", 7)
    parts = sorted(base.sdne(ring(spark), SMALL).collect())
    assert np.allclose([r.vec for r in whole], [r.vec for r in parts], rtol=0, atol=1e-12)


@pytest.mark.parametrize("name", ["netmf_small", "grarep"])
def test_powers_by_rows_are_powers_by_joins(spark, monkeypatch, name):
    """With nodes that are alike, a loop, and a node without edges; the matrix of all pairs is made of no joined table."""
    pairs = [(2 * i, 2 * k + 1, float((i % 3) * (k + 1) % 4 + 1)) for i in range(12) for k in range(3)] + [(5, 5, 2.0), (40, 41, 1.0)]
    g = make(spark, pairs, [*range(0, 24, 2), 1, 3, 5, 40, 41, 50])
    assert len(base.alike(g).size) < 15
    with monkeypatch.context() as m:
        m.setattr(base, "power_sum", None)
        m.setattr(base, "_log_transitions", lambda *_: None)
        rows = np.array([r.vec for r in sorted(base.base_embedding(name)(g, SMALL).collect())])
        wide = np.array([r.vec for r in sorted(base.base_embedding(name)(g, Config(embed_dim=36, window=2, eigen_rounds=8)).collect())])
    monkeypatch.setattr(base, "BROADCAST_LIMIT", 0)
    joins = np.array([r.vec for r in sorted(base.base_embedding(name)(g, SMALL).collect())])
    assert rows.shape == joins.shape == (18, 4)
    assert np.allclose(rows @ rows.T, joins @ joins.T, atol=1e-3)
    assert wide.shape[0] == 18


def test_rows_times_rows():
    """Dense and by entries, beside the plain product."""
    rng = np.random.default_rng(5)
    for share in (0.03, 0.6):
        a = rng.random((40, 40)) * (rng.random((40, 40)) < share)
        at, cols = np.nonzero(a)
        rows = base.Rows(np.arange(40), np.searchsorted(at, np.arange(41)), cols, a[at, cols])
        x, seen = rows.dense(np.array([3, 1, 7])), {}
        assert np.array_equal(x, a[[3, 1, 7]])
        for _ in range(2):
            assert np.allclose(rows.times(x, seen), x @ a)
        assert np.allclose(rows.times(np.ones((300, 40)), seen), np.ones((300, 40)) @ a)


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="base"):
        base.base_embedding("none")
    with pytest.raises(ValueError, match="refinement"):
        refine.refine_model(Config(refine="other"))


@pytest.mark.parametrize("joins", [False, True])
def test_the_window_matrix_is_squared_without_its_factorisation(spark, monkeypatch, joins):
    """Block by block, by joins, from the matrix itself and from an embedding of all parts: with nodes alike, and one without edges."""
    from dataclasses import replace

    g = make(spark, [(i, (i + k) % 12, float(k)) for i in range(12) for k in (1, 5)] + [(0, 20), (0, 21), (3, 3)], [*range(12), 20, 21, 30])
    ids, own = linear.matrix(base.netmf_small(g, replace(SMALL, embed_dim=15)))
    whole = np.zeros((15, 15))
    for a, b, w in triples(base.window_matrix(g, SMALL.window)):
        whole[np.searchsorted(ids, a), np.searchsorted(ids, b)] = w
    monkeypatch.setattr(base, "SQUARE_BYTES", 0)
    monkeypatch.setattr(base, "leading_here", None)
    if joins:
        monkeypatch.setattr(base, "BROADCAST_LIMIT", 0)
    found = triples(base.window_squared(g, SMALL))
    assert [x[:2] for x in found] == [(a, b) for a in ids for b in ids]
    square = np.array([x[2] for x in found]).reshape(15, 15)
    assert np.allclose(square, whole @ whole) and np.allclose(square, (own @ own.T) @ (own @ own.T))


@pytest.mark.parametrize("changes", [{"base": "netmf_small"}, {"refine": "gcn", "base": "netmf_small"}, {"refine": "none", "base": "netmf_small", "only_coarse": True}, {"base": "netmf_small", "double_base": True}])
def test_multilevel(spark, changes):
    from dataclasses import replace

    rows = multilevel_embed(ring(spark), replace(SMALL, **changes)).collect()
    assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-6 for r in rows)
    if not changes.get("only_coarse"):
        assert sorted(r.node_id for r in rows) == list(range(24))


def test_training_lowers_the_loss(spark):
    from dataclasses import replace

    g = ring(spark)
    target = vectors.l2_normalise(base.netmf_small(g, SMALL)).cache()
    for kind in ("gcn", "graphsage"):
        model = refine.refine_model(replace(SMALL, refine=kind, refine_epochs=40, learning_rate=0.01)).train(g, target, target)
        assert model.losses[-1] < model.losses[0]


@pytest.mark.parametrize("concat", [True, False])
def test_gradients_of_layers(concat):
    """Against differences of the loss, with two layers."""
    from dataclasses import replace

    rng, c = np.random.default_rng(3), replace(SMALL, depth=2, concat=concat)
    model = refine.GraphSage.create(c)
    assert len(model.weights) == 2 * (8 if concat else 6)
    for w in model.weights:
        w += rng.normal(size=w.shape) * 0.1
    h, wanted = rng.normal(size=(9, 4)), rng.normal(size=(9, 4))
    lines = []
    for _ in range(2):
        pairs = np.unique(rng.integers(0, 9, (20, 2)), axis=0)
        pairs = pairs[pairs[:, 0] != 4]  # a node that drew nobody
        lines.append((pairs[:, 0], pairs[:, 1]))
    batch = np.array([1, 2, 4, 8])
    block = refine._around(h, lines, wanted, batch)
    loss = lambda: model.gradients(block, 4)[0] / 4
    _, found = model.gradients(block, 4)
    for w, g in zip(model.weights, found, strict=True):
        for _ in range(6):
            i = tuple(int(rng.integers(0, k)) for k in w.shape)
            was = w[i]
            w[i] = was + 1e-6
            up = loss()
            w[i] = was - 1e-6
            down = loss()
            w[i] = was
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


@pytest.mark.parametrize("changes", [{"refine": "gcn"}, {"refine": "graphsage"}, {"refine": "graphsage", "depth": 2, "concat": False}])
def test_training_apart_is_training_in_one_process(spark, changes):
    """Gradients added up over tasks and blocks give the same model."""
    from dataclasses import replace

    g = ring(spark)
    start, target = (linear.random_rows(g.nodes, 4, seed).transform(vectors.l2_normalise).cache() for seed in (1, 2))
    c = replace(SMALL, refine_epochs=3, learning_rate=0.01, **changes)
    near = refine.refine_model(c).train(g, start, target)
    far = refine.refine_model(replace(c, train_nodes=5, block_nodes=7)).train(g, start, target)
    assert np.allclose(near.losses, far.losses)
    assert all(np.allclose(a, b) for a, b in zip(near.weights, far.weights, strict=True))
    out = near.apply(g, start).collect()
    assert len(out) == 24 and all(abs(sum(x * x for x in r.vec) - 1) < 1e-9 for r in out)
    batches = refine.refine_model(replace(c, batch_size=10)).train(g, start, target) if changes["refine"] == "graphsage" else near
    assert len(batches.losses) == 3


def test_gcn_training_moves_no_vectors(spark, monkeypatch):
    """Steps by packed rows are those in one process and those by joins, with a node without edges."""
    from dataclasses import replace

    g = make(spark, [(i, (i + k) % 12, float(k)) for i in range(12) for k in (1, 5)] + [(3, 3)], range(13))
    start, target = (linear.random_rows(g.nodes, 4, seed).transform(vectors.l2_normalise).cache() for seed in (1, 2))
    c = replace(SMALL, refine="gcn", refine_epochs=3, learning_rate=0.01)
    near, far = refine.refine_model(c).train(g, start, target), replace(c, train_nodes=5)
    joins = refine.propagate
    calls = []
    monkeypatch.setattr(refine, "propagate", lambda *a: calls.append(1) or joins(*a))
    sent = refine.refine_model(far).train(g, start, target)
    assert len(calls) == 1
    monkeypatch.setattr(refine, "SENT_LIMIT", 0)
    apart = refine.refine_model(far).train(g, start, target)
    for other in (sent, apart):
        assert np.allclose(near.losses, other.losses)
        assert all(np.allclose(a, b) for a, b in zip(near.weights, other.weights, strict=True))


@pytest.mark.parametrize("per_value", [16, 6])
def test_gcn_training_and_application_join_no_vectors(spark, monkeypatch, per_value):
    """By packed groups, in double and in single precision: with weights other than 1, long runs, a loop, and nodes without edges."""
    from dataclasses import replace

    pairs = [(i, (i + k) % 40, 1.0 if i % 3 else 0.5 * k) for i in range(40) for k in (1, 5)] + [(7, i) for i in range(20, 40)] + [(3, 3)]
    g = make(spark, pairs, range(43))
    start, target = (linear.random_rows(g.nodes, 4, seed).transform(vectors.l2_normalise).cache() for seed in (1, 2))
    c = replace(SMALL, refine="gcn", refine_epochs=3, learning_rate=0.01)
    monkeypatch.setattr(refine, "SENT_LIMIT", 0)
    near = refine.refine_model(c).train(g, start, target)
    plain = sorted(near.apply(g, start).collect())
    monkeypatch.setattr(refine, "SENT_LIMIT", per_value * 43 * 4)
    monkeypatch.setattr(refine, "JOINED_ENTRIES", 0)
    monkeypatch.setattr(refine, "GROUP_ENTRIES", 20)
    monkeypatch.setattr(refine, "propagate", None)
    close = {"rtol": 0, "atol": 1e-10 if per_value == 16 else 1e-5}
    for own in (g, graph.kept(g)):
        sent = refine.refine_model(replace(c, train_nodes=5)).train(own, start, target)
        assert np.allclose(near.losses, sent.losses, **close)
        assert all(np.allclose(a, b, **close) for a, b in zip(near.weights, sent.weights, strict=True))
        found = sorted(near.apply(own, start).collect())
        assert [r.node_id for r in found] == [r.node_id for r in plain]
        assert np.allclose([r.vec for r in found], [r.vec for r in plain], **close)


@pytest.mark.parametrize("layers", [1, 2])
def test_drawn_lists_are_the_samples(spark, layers):
    """The same draws as by joins, where a node's edges come in several batches."""
    g = make(spark, [(0, i, 0.1 * i) for i in range(1, 30)] + [(i, (i * 7) % 30, 1.0 / i) for i in range(1, 30)] + [(3, 3, 2.0)], range(40))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
        for even, loops in ((False, True), (True, False)):
            rows = walks.drawn_lists(g.edges, 9, layers, 5, even, loops).collect()
            wanted = walks.neighbour_samples(g.edges, g.nodes.select("node_id"), 9, layers, 5, even, loops).select("layer", "node_id", "neighbor").distinct()
            assert sorted((r.layer, r.node_id, x) for r in rows for x in r.drawn) == sorted(map(tuple, wanted.collect()))
            assert len({(r.layer, r.node_id) for r in rows}) == len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("depth", [1, 2])
def test_sampling_model_moves_no_vectors(spark, monkeypatch, depth):
    """Training and application by places among all nodes are those in one process and those by joins, with nodes without edges."""
    from dataclasses import replace

    g = make(spark, [(i, (i + k) % 12, float(k)) for i in range(12) for k in (1, 5)] + [(3, 3)], range(14))
    start, target = (linear.random_rows(g.nodes, 4, seed).transform(vectors.l2_normalise).cache() for seed in (1, 2))
    c = replace(SMALL, refine="graphsage", refine_epochs=3, learning_rate=0.01, depth=depth)
    far, calls, joins, packs = replace(c, train_nodes=5, block_nodes=4), [], refine.pooled, refine.GraphSage.blocks
    monkeypatch.setattr(refine, "pooled", lambda *a: calls.append(1) or joins(*a))
    monkeypatch.setattr(refine.GraphSage, "blocks", lambda *a: calls.append(1) or packs(*a))
    for goal in (start, target):
        monkeypatch.setattr(refine, "SAMPLED_LIMIT", 1 << 20)
        near, sent = refine.refine_model(c).train(g, start, goal), refine.refine_model(far).train(g, start, goal)
        held = sorted(sent.apply(g, start).collect())
        assert not calls
        monkeypatch.setattr(refine, "SAMPLED_LIMIT", 0)
        apart = refine.refine_model(far).train(g, start, goal)
        joined = sorted(sent.apply(g, start).collect())
        assert len(calls) == 1 + depth and len(held) == 14
        assert all(a.node_id == b.node_id and np.allclose(a.vec, b.vec) for a, b in zip(held, joined, strict=True))
        for other in (sent, apart):
            assert np.allclose(near.losses, other.losses)
            assert all(np.allclose(a, b) for a, b in zip(near.weights, other.weights, strict=True))
        calls.clear()


def test_kept_graph_is_the_graph(spark):
    """Edges made once and dealt by node are the same, and so are the pairs and the coarse graph made of them."""
    from stratagraph.sources import tables

    folder = "/root/testdata/sf0.001"
    plain, kept = tables.copurchase(spark, folder), tables.copurchase_kept(spark, folder)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    for part, columns in (("nodes", ("node_id", "node_wgt", "degree", "n_adj")), ("edges", ("src", "dst", "wgt"))):
        assert rows(getattr(plain, part), *columns) == rows(getattr(kept, part), *columns)
    pairs = matching.mutual_pairs(matching.best_of_runs(graph.normalised_weights(kept)))
    assert rows(pairs, "a", "b") == rows(matching.mutual_pairs(graph.normalised_weights(plain)), "a", "b")
    none = kept.nodes.select("node_id", F.col("node_id").alias("group_id")).limit(0)
    cmap = coarsen.coarse_map(kept.nodes, none, pairs)
    near, far = (coarsen.coarse_graph(g, cmap) for g in (plain, kept))
    assert rows(near.edges, "src", "dst", "wgt") == rows(far.edges, "src", "dst", "wgt") and rows(near.nodes, *near.nodes.columns) == rows(far.nodes, *near.nodes.columns)


def test_netmf_moves_no_vectors(spark, monkeypatch):
    """Products by packed edges are those by joins, and a product in single precision is near that in double; an edge list is cut over batches."""
    from dataclasses import replace

    g = make(spark, [(i, (i * k + 1) % 17, 1.0 + i / k) for i in range(17) for k in (2, 3, 5)], range(17))
    c = replace(SMALL, base="netmf", rank=6, embed_dim=3)
    joins = linear.propagate

    def product():
        v = np.array([r.vec for r in sorted(base.netmf(g, c).collect())])
        return v @ v.T

    monkeypatch.setattr(linear, "propagate", lambda *a: pytest.fail("vectors are joined"))
    sent = product()
    monkeypatch.setattr(base, "DOUBLE_NODES", 0)
    assert np.allclose(sent, product(), atol=1e-4)
    monkeypatch.setattr(base, "DOUBLE_NODES", 20_000)
    monkeypatch.setattr(linear, "propagate", joins)
    monkeypatch.setattr(base, "BASIS_LIMIT", 0)
    assert np.allclose(sent, product(), atol=1e-6)


def test_rounds_of_a_kept_graph(spark):
    """Rounds give the same pairs where a node's edges stand together and nodes are sent."""
    g = make(spark, [(i, (i * k + 1) % 40, 1.0 + i % k) for i in range(40) for k in (2, 3, 5, 7)], range(42))
    free = g.nodes.filter("node_id % 9 <> 4").select("node_id")
    found = [sorted(map(tuple, matching.heavy_rounds(x, free, 2.0, tail=20).collect())) for x in (g, graph.kept(g))]
    assert found[0] == found[1] and len(found[0]) > 5


def test_layers_applied_as_trained(spark):
    """What the DataFrames give is what the gradients' forward pass gives."""
    from dataclasses import replace

    g = ring(spark)
    start = vectors.l2_normalise(linear.random_rows(g.nodes, 4, 1)).cache()
    model = refine.GraphSage.create(replace(SMALL, depth=2))
    rows = sorted(model.apply(g, start).collect())
    goal = spark.createDataFrame([(r.node_id, r.vec) for r in rows], "node_id long, vec array<double>")
    drawn = model.samples(g).toPandas().sort_values(["layer", "node_id", "neighbor"])
    lines = [(drawn[drawn.layer == k].node_id.to_numpy(), drawn[drawn.layer == k].neighbor.to_numpy()) for k in range(2)]
    h = np.array([r.vec for r in sorted(start.collect())])
    total, _ = model.gradients(refine._around(h, lines, np.array([r.vec for r in sorted(goal.collect())]), np.arange(24)), 24)
    assert total < 1e-18


def test_communities_are_found(spark):
    """Two dense halves: embeddings tell them apart far better than chance."""
    from dataclasses import replace

    pairs = [(a, b) for half in (0, 12) for a in range(half, half + 12) for b in range(a + 1, half + 12)] + [(0, 12)]
    g = make(spark, pairs)
    e = multilevel_embed(g, replace(SMALL, base="netmf_small", refine="gcn", embed_dim=2))
    truth = spark.createDataFrame([(i, i // 12) for i in range(24)], "node_id long, label int")
    assert evaluate.clustering(e, truth, 2).first().ari > 0.8
    y = spark.createDataFrame([(i, [1 - i // 12, i // 12]) for i in range(24)], "node_id long, y array<int>")
    assert evaluate.multilabel(e, y, replace(SMALL, test_share=0.4)).first().micro > 0.8
    assert evaluate.one_class(e, y, replace(SMALL, test_share=0.4)).first().accuracy > 0.8


def test_scores_by_hand(spark):
    truth = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, label int")
    predicted = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, label int")
    r = evaluate.f1_scores(truth, predicted).first()
    assert (r.micro, r.macro, r.weighted, r.samples) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 2 / 3))
    pairs = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "truth int, predicted int")
    assert tuple(evaluate.agreement(pairs).first()) == (1.0, 1.0)


def test_command_line(spark, tmp_path, monkeypatch):
    from stratagraph import cli

    (tmp_path / "toy.edgelist").write_text("".join(f"{min(a, b)} {max(a, b)}\n" for a, b in {(i, (i + d) % 24) for i in range(24) for d in (1, 5)}))
    (tmp_path / "toy.edgelist.truth").write_text("".join(f"{i} {int(i < 12)} {int(i >= 12)}\n" for i in range(24)))
    cli.main(["--data", "toy", "--format", "edgelist", "--root", str(tmp_path), "--embed-dim", "4", "--coarsen-m", "1", "--basic-embed", "netmf_small", "--refine-epochs", "5", "--runs", "1", "--store-embed"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "toy.embeddings")).collect()]
    assert len(lines) == 24 and all(len(x.split()) == 5 for x in lines)
