"""Golden values, invariants and engine equivalence of the graph operators."""

import random
import struct

import pytest

from graphloom import Graph
from graphloom.operators import components, packing, pagerank, traversal
from graphloom.plans.direction import Direction
from graphloom.sources import edge_list

EDGES = [(0, 1), (0, 2), (1, 3), (1, 3), (2, 3), (3, 0), (3, 4), (5, 6), (6, 5), (6, 6)]
RANKS = {
    1: "9.76562e-02 9.76562e-02 9.76562e-02 2.61719e-01 9.76562e-02 9.76562e-02 2.07031e-01 4.29688e-02",
    2: "1.45508e-01 7.37305e-02 7.37305e-02 2.01904e-01 1.45508e-01 1.21582e-01 2.07031e-01 3.10059e-02",
    10: "1.02238e-01 7.68631e-02 7.68631e-02 1.68240e-01 1.02238e-01 1.54699e-01 2.88283e-01 3.05760e-02",
}


def made(spark, n, edges):
    return Graph.dense(spark, n, spark.createDataFrame(edges, "src long, dst long"))


@pytest.fixture(scope="module")
def tiny(spark):
    return made(spark, 8, EDGES)


def column(rows, name):
    return [r[name] for r in rows.orderBy("id").collect()]


@pytest.mark.parametrize("iterations", RANKS)
def test_ranks_are_golden_and_sum_to_one(tiny, iterations):
    ranks = pagerank.pagerank(tiny, iterations)
    lines = [line.split(" ")[1] for line in column(edge_list.rank_lines(ranks), "line")]
    assert lines == RANKS[iterations].split()
    assert abs(pagerank.rank_sum(ranks).first()[0] - 1) < 1e-10


def test_rank_options(tiny):
    assert column(pagerank.pagerank(tiny, 3, vertex_phase=False), "rank") == pytest.approx([1 / 8] * 8)
    assert column(pagerank.pagerank(tiny, 3, edge_phase=False), "rank") == pytest.approx([1 / 8] * 8)
    assert pagerank.rank_sum(pagerank.pagerank(tiny, 5, damping=0.85, redistribute=False)).first()[0] < 1
    for wrong in ({"iterations": 0}, {"engine": "sideways"}):
        with pytest.raises(ValueError):
            pagerank.pagerank(tiny, **wrong)


@pytest.mark.parametrize("engine", ["auto", "pull", "push"])
def test_components_and_search(tiny, engine):
    done = components.directed_components(tiny, Direction(engine), stats=True)
    assert column(done.state, "value") == [0, 0, 0, 0, 0, 5, 5, 7]
    levels, run = traversal.bfs(tiny, direction=Direction(engine))
    assert column(levels, "level") == [0, 1, 1, 2, 3, None, None, None]
    assert column(levels, "parent") == [None, 0, 0, 2, 3, None, None, None]
    assert len(run.iterations) == 4
    assert traversal.reachable(levels).first()[0] == 5
    assert column(edge_list.value_lines(levels, "parent"), "line")[:2] == ["0 -1", "1 0"]


def test_votes_and_parents(tiny):
    levels, run = traversal.bfs(tiny, parent="min", direction=Direction(count_vertices=False))
    assert column(levels, "parent") == [None, 0, 0, 1, 3, None, None, None]
    assert len(run.iterations) == 3
    assert len(traversal.bfs(tiny, direction=Direction(count_degrees=False))[1].iterations) == 4
    with pytest.raises(ValueError):
        Direction(count_vertices=False, count_degrees=False)


def test_weak_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((30, 20), (60, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 2, n - 1)]
        parent = list(range(n))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        graph = made(spark, n, edges)
        assert column(components.undirected_components(graph), "label") == [root(i) for i in range(n)]
        # the directed labels of a graph that has every edge both ways are the same
        assert column(components.directed_components(graph.symmetrize()).state, "value") == [root(i) for i in range(n)]


def test_a_round_of_components_reads_its_links_four_times(spark, tmp_path):
    spark.createDataFrame([(2, 1), (3, 2), (4, 2)], "u long, v long").write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    step = components._small_star(components._large_star(links))
    # the driver holds the plan, and its text anew whenever a stage ends
    assert step.distinct()._jdf.queryExecution().sparkPlan().toString().count("FileScan") <= 4
    assert sorted(step.distinct().collect()) == [(2, 1), (3, 1), (4, 1)]


def test_no_edges(spark):
    empty = made(spark, 4, [])
    assert column(pagerank.pagerank(empty, 2), "rank") == pytest.approx([0.25] * 4)
    assert column(components.directed_components(empty).state, "value") == [0, 1, 2, 3]
    assert column(components.undirected_components(empty), "label") == [0, 1, 2, 3]
    assert column(traversal.bfs(empty)[0], "level") == [0, None, None, None]
    assert packing.pack_stats(empty).first()["vectors"] == 0


@pytest.mark.parametrize(("by", "vectors"), [("dst", 7), ("src", 6)])
def test_packing(tiny, by, vectors):
    for lanes in (4, 8, 16):
        row = packing.pack_stats(tiny, by, lanes).first()
        assert (row["vectors"], row["vectors_model"]) == (vectors, vectors - (lanes > 4))
    packed = {(r["key"], r["slot"]): r["neighbours"] for r in packing.pack(tiny, by).collect()}
    assert len(packed) == vectors
    assert packed[(3, 0)] == ([1, 1, 2] if by == "dst" else [0, 4])
    index = {r["id"]: r["first_vector"] for r in packing.vertex_index(tiny, by).collect()}
    assert index[0] == 0 and index[6] == vectors - 1
    units = [(r["first_vector"], r["end_vector"]) for r in packing.work_units(tiny, 3, by).orderBy("unit").collect()]
    assert units[0][0] == 0 and units[-1][1] == vectors and all(a[1] == b[0] for a, b in zip(units, units[1:], strict=False))
    ranges = packing.vertex_ranges(tiny, 3, by).orderBy("part").collect()
    assert sum(r["n_vertices"] for r in ranges) == 8


def test_packing_of_a_key_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "_BLOCK", 8)
    rng = random.Random(5)
    edges = [(rng.randrange(40), 7 if i % 3 else rng.randrange(40)) for i in range(200)]
    packed = {(r["key"], r["slot"]): r["neighbours"] for r in packing.pack(made(spark, 40, edges)).collect()}
    expected = {}
    for key in {d for _, d in edges}:
        sources = sorted(s for s, d in edges if d == key)
        expected |= {(key, at // 4): sources[at : at + 4] for at in range(0, len(sources), 4)}
    assert packed == expected


def test_edge_list_files(spark, tiny, tmp_path):
    edge_list.write(tiny, str(tmp_path / "g"))
    raw = (tmp_path / "g-pull").read_bytes()
    assert struct.unpack("<4Q", raw[:32]) == (8, 10, 3, 0)
    by_source = struct.unpack("<22Q", (tmp_path / "g-push").read_bytes())
    assert list(zip(by_source[2::2], by_source[3::2], strict=True)) == sorted(EDGES)
    far = Graph.dense(spark, 1 << 47, spark.createDataFrame([((1 << 47) - 1, 200), (128, (1 << 47) - 1)], "src long, dst long"))
    edge_list.write(Graph(far.vertices.limit(0), far.edges), str(tmp_path / "far"))
    assert struct.unpack("<4Q", (tmp_path / "far-push").read_bytes()[16:]) == (128, (1 << 47) - 1, (1 << 47) - 1, 200)
    back = edge_list.read(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, back.edges.collect())) == sorted(EDGES)
    (tmp_path / "bad-pull").write_bytes(struct.pack("<2Q", 8, 11) + raw[16:])
    with pytest.raises(ValueError):
        edge_list.read(spark, str(tmp_path / "bad"))
    with pytest.raises(FileNotFoundError):
        edge_list.read(spark, str(tmp_path / "none"))
    lines = [r["line"] for r in edge_list.edge_lines(tiny).orderBy("line_no").collect()]
    assert lines[:4] == ["8", "10", "3 0", "0 1"] and len(lines) == 12


def test_validation(spark):
    with pytest.raises(ValueError):
        made(spark, 2, [(0, 5)]).validate()
    with pytest.raises(ValueError):
        Graph.of(spark.createDataFrame([(1,), (1,)], "id long"), spark.createDataFrame([], "src long, dst long")).validate()
