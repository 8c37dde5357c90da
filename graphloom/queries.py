"""The registered graph queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .lineage import new_path
from .operators import components, packing, pagerank, traversal
from .plans.direction import Direction
from .plans.superstep import advance, messages, start
from .sources import derived, edge_list

ROUND = 10
PARTS = 4
UNITS = 32
ROOT = 7

# --- graphs -----------------------------------------------------------------------------------------

GRAPHS: dict[str, Callable[[SparkSession, str], Graph]] = {
    "copurchase": derived.copurchase,
    "sparse": derived.sparse,
    "users": derived.users,
    "trade": derived.trade,
}

_STEPS = """SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_quantity FROM lineitem"""
GRAPH_SQL = {
    "copurchase": f"verts AS MATERIALIZED (SELECT p_partkey AS id FROM part), edges AS MATERIALIZED (SELECT src, dst FROM ({_STEPS}) WHERE dst IS NOT NULL)",
    "sparse": f"verts AS MATERIALIZED (SELECT p_partkey AS id FROM part), edges AS MATERIALIZED (SELECT src, dst FROM ({_STEPS}) WHERE dst IS NOT NULL AND l_quantity >= 48)",
    "users": """verts AS MATERIALIZED (SELECT DISTINCT user_id AS id FROM events), edges AS MATERIALIZED (SELECT src, dst FROM
        (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)""",
    "trade": """verts AS MATERIALIZED (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation), edges AS MATERIALIZED (
        SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)""",
}


def _with(graph: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join((GRAPH_SQL[graph], *more))} "


# --- pieces of SQL ----------------------------------------------------------------------------------

_DEGREES = """vd AS MATERIALIZED (SELECT id, od, CASE WHEN od = 0 THEN n ELSE od END AS deg, n FROM (
    SELECT v.id, coalesce(d.od, 0) AS od, (SELECT count(*) FROM verts) AS n
    FROM verts v LEFT JOIN (SELECT src, count(*) AS od FROM edges GROUP BY src) d ON v.id = d.src))"""


def _rank_ctes(iterations: int, damping: float = 0.875, redistribute: bool = True) -> list[str]:
    ctes = [_DEGREES, "p0 AS MATERIALIZED (SELECT id, (1.0::DOUBLE / n) / deg AS prop FROM vd)"]
    for i in range(iterations):
        lost = f"(1 - (SELECT coalesce(sum(a), 0) FROM a{i})) / n" if redistribute else "0"
        ctes += [
            f"a{i} AS MATERIALIZED (SELECT dst AS id, sum(prop) AS a FROM edges JOIN p{i} ON src = id GROUP BY dst)",
            f"p{i + 1} AS MATERIALIZED (SELECT vd.id, ((coalesce(a, 0) + {lost}) * {damping}::DOUBLE + (1 - {damping}::DOUBLE) / n) / deg AS prop FROM vd LEFT JOIN a{i} ON vd.id = a{i}.id)",
        ]
    return ctes


def _ranks(iterations: int, **options) -> tuple[list[str], str]:
    return _rank_ctes(iterations, **options), f"SELECT vd.id, round(prop * deg, {ROUND}) AS rank FROM vd JOIN p{iterations} p ON vd.id = p.id"


_CC = """cc(id, label) USING KEY (id) AS (SELECT id, id FROM verts UNION
    SELECT e.dst, min(f.label) FROM cc f JOIN {edges} e ON e.src = f.id JOIN recurring.cc r ON r.id = e.dst WHERE f.label < r.label GROUP BY e.dst)"""
_BOTH = "both_ways AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
_BFS = """b(id, level) USING KEY (id) AS (SELECT 0::BIGINT, 0 UNION
    SELECT e.dst, min(b.level + 1) FROM b JOIN edges e ON e.src = b.id LEFT JOIN recurring.b r ON r.id = e.dst WHERE r.id IS NULL GROUP BY e.dst)"""
_CC_ROUNDS = """st(it, id, label, changed) AS (SELECT 0, id, id, true FROM verts UNION ALL
    SELECT s.it + 1, s.id, least(s.label, coalesce(min(f.label), s.label)), coalesce(min(f.label), s.label) < s.label
    FROM st s LEFT JOIN edges e ON e.dst = s.id LEFT JOIN st f ON f.id = e.src WHERE (SELECT bool_or(changed) FROM st) GROUP BY s.it, s.id, s.label)"""
_CC_PROFILE = """, lv AS (SELECT it, count(*) FILTER (changed) AS n, CAST(coalesce(sum(1 + od) FILTER (changed), 0) AS BIGINT) AS vote FROM st JOIN vd USING (id) GROUP BY it)
    SELECT z.it AS iteration, CASE WHEN a.vote > (SELECT count(*) FROM edges) // 5 THEN 'Pull' ELSE 'Push' END AS engine,
           a.vote AS vote_before, a.n AS n_active, z.n AS n_changed, z.vote FROM lv z JOIN lv a ON a.it = z.it - 1"""
_PARENTS = """parents AS (SELECT d.id, {pick}(s.id) AS parent FROM edges JOIN b s ON s.id = src JOIN b d ON d.id = dst WHERE d.level = s.level + 1 GROUP BY d.id)"""


def _parent_sql(pick: str) -> str:
    ctes = (_BFS, _PARENTS.format(pick=pick))
    return _with("sparse", *ctes, recursive=True) + "SELECT v.id, coalesce(p.parent, -1) AS parent FROM verts v LEFT JOIN parents p ON v.id = p.id"


_PARTS_SQL = """packed AS MATERIALIZED (SELECT {key} AS id, count(*) AS cnt FROM edges GROUP BY {key})"""
_INDEX = """idx AS MATERIALIZED (SELECT id, coalesce(CAST(sum(nv) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS first_vector, nv AS n_vectors
    FROM (SELECT id, (cnt + 3) // 4 AS nv FROM packed))"""


def _stats_sql(key: str, lanes: int) -> str:
    vectors = f"CAST(coalesce(sum((cnt + {lanes - 1}) // {lanes}), 0) AS BIGINT)"
    model = f"{vectors} - 1" if lanes > 4 else vectors
    return _with("sparse", _PARTS_SQL.format(key=key)) + (
        f"SELECT {lanes} AS lanes, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS edges, {vectors} AS vectors, {model} AS vectors_model, "
        f"round(sum(cnt) * 100.0::DOUBLE / ({vectors} * {lanes}), 6) AS efficiency FROM packed"
    )


def _index_sql(key: str) -> str:
    return _with("sparse", _PARTS_SQL.format(key=key), _INDEX) + "SELECT * FROM idx"


_RANGES = f"""total AS (SELECT CAST(sum(n_vectors) AS BIGINT) AS n FROM idx),
    ranges AS (SELECT i AS part, n * i // {PARTS} AS first_vector, n * (i + 1) // {PARTS} - 1 AS last_vector, n * (i + 1) // {PARTS} - n * i // {PARTS} AS n_vectors
    FROM total, range({PARTS}) t(i))"""

# --- single supersteps ------------------------------------------------------------------------------


def _gather_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = derived.sparse(spark, sf_dir)
    return pagerank.gather(graph.edges, pagerank.initial(graph)).select("id", F.round("acc", ROUND).alias("acc"))


def _gather_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, program = derived.sparse(spark, sf_dir), components.min_label_program()
    return messages(graph.edges, start(graph, program), program, "pull", graph.n_vertices).select("id", F.col("msg").alias("label"))


def _frontier(engine: str) -> Callable[[SparkSession, str], DataFrame]:
    def step(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = derived.sparse(spark, sf_dir)
        program = traversal.program(0, "max")
        state = start(graph, program)
        after = advance(state, messages(graph.edges, state, program, engine, 1), program, 1)
        return after.where("active").select("id", F.col("value").alias("parent"))

    return step


# --- queries ----------------------------------------------------------------------------------------


def _rounded(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.round("rank", ROUND).alias("rank"))


def _pagerank(graph: str = "copurchase", iterations: int = 10, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(pagerank.pagerank(GRAPHS[graph](spark, sf_dir), iterations, **options))


def _rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank.rank_sum(pagerank.pagerank(derived.sparse(spark, sf_dir), 10)).select(F.round("rank_sum", 8).alias("rank_sum"))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank.top(_rounded(pagerank.pagerank(derived.sparse(spark, sf_dir), 10)), 20)


def _rank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_list.rank_lines(pagerank.pagerank(derived.sparse(spark, sf_dir), 1))


def _directed(direction: Direction | None = None, graph: str = "sparse") -> Callable[[SparkSession, str], DataFrame]:
    def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
        return components.directed_components(GRAPHS[graph](spark, sf_dir), direction).state.select("id", F.col("value").alias("label"))

    return labels


def _undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.undirected_components(derived.sparse(spark, sf_dir))


def _bfs(columns: list[str], parent: str = "max", direction: Direction | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: traversal.bfs(derived.sparse(spark, sf_dir), parent=parent, direction=direction)[0].selectExpr(*columns)


def _bfs_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.bfs(derived.copurchase(spark, sf_dir))[1].profile()


def _cc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.directed_components(derived.sparse(spark, sf_dir)).profile()


def _bfs_profile_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.bfs(derived.copurchase(spark, sf_dir), direction=Direction(edge_share=20))[1].profile()


def _bfs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.bfs(derived.copurchase(spark, sf_dir))[1].summary().drop("ms", "million_edges_per_sec")


def _bfs_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = traversal.bfs(derived.copurchase(spark, sf_dir), stats=True)[1].stats()
    return done.select("iteration", "vectors", "edges", F.round("efficiency", 6).alias("efficiency"), F.round("frontier_ratio", 8).alias("frontier_ratio"))


def _bfs_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = traversal.bfs(derived.sparse(spark, sf_dir), root=ROOT, root_parent=True)
    return found.selectExpr("id", _missing_as_minus_one("level"), _missing_as_minus_one("parent"))


def _rank_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "rank-text")
    edge_list.write_lines(_rank_text(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _binary_round_trip(spark: SparkSession, sf_dir: str, name: str = "sparse") -> DataFrame:
    graph = GRAPHS[name](spark, sf_dir)
    path = new_path(spark, "edge-list")
    edge_list.write(Graph.dense(spark, graph.n_vertices, graph.edges), path)
    return edge_list.read(spark, path).edges


def _missing_as_minus_one(column: str) -> str:
    return f"CAST(coalesce({column}, -1) AS BIGINT) AS {column}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    sparse, full = derived.sparse, derived.copurchase
    made = {
        "out_degree": lambda s, d: sparse(s, d).out_degrees(),
        "in_degree": lambda s, d: sparse(s, d).in_degrees(),
        "sinks": lambda s, d: sparse(s, d).out_degrees().where("degree = 0").select("id"),
        "sources": lambda s, d: sparse(s, d).in_degrees().where("degree = 0").select("id"),
        "isolated": lambda s, d: sparse(s, d).out_degrees().where("degree = 0").join(sparse(s, d).in_degrees().where("degree = 0"), "id").select("id"),
        "trade_degree": lambda s, d: derived.trade(s, d).out_degrees(),
        "packed_vectors": lambda s, d: packing.pack(sparse(s, d)),
        "vertex_index_in": lambda s, d: packing.vertex_index(sparse(s, d), "dst"),
        "vertex_index_out": lambda s, d: packing.vertex_index(sparse(s, d), "src"),
        "edge_ranges": lambda s, d: packing.edge_ranges(sparse(s, d), PARTS),
        "vertex_ranges": lambda s, d: packing.vertex_ranges(sparse(s, d), PARTS),
        "vertex_ranges_by_src": lambda s, d: packing.vertex_ranges(sparse(s, d), PARTS, "src"),
        "work_units": lambda s, d: packing.work_units(sparse(s, d), UNITS),
        "gather_sum_step": _gather_sum,
        "gather_min_step": _gather_min,
        "frontier_push_step": _frontier("push"),
        "frontier_pull_step": _frontier("pull"),
        "pagerank_init": lambda s, d: pagerank.initial(sparse(s, d)).select("id", "outdeg", F.round("prop", 12).alias("prop")),
        "pagerank_1": _pagerank(iterations=1),
        "pagerank_10": _pagerank(),
        "pagerank_10_push": _pagerank(engine="push"),
        "pagerank_sparse": _pagerank("sparse"),
        "pagerank_users": _pagerank("users"),
        "pagerank_sum": _rank_sum,
        "pagerank_top": _top,
        "pagerank_edge_only": _pagerank("sparse", vertex_phase=False),
        "pagerank_vertex_only": _pagerank("sparse", edge_phase=False),
        "pagerank_text": _rank_text,
        "pagerank_085_nosink": _pagerank("sparse", damping=0.85, redistribute=False),
        "cc_directed": _directed(),
        "cc_directed_pull": _directed(Direction("pull")),
        "cc_directed_push": _directed(Direction("push")),
        "cc_dense": _directed(graph="users"),
        "cc_undirected": _undirected,
        "cc_sizes": lambda s, d: components.sizes(_undirected(s, d)),
        "cc_text": lambda s, d: edge_list.value_lines(_directed()(s, d), "label"),
        "cc_profile": _cc_profile,
        "bfs_level": _bfs(["id", _missing_as_minus_one("level")]),
        "bfs_level_vertex_votes": _bfs(["id", _missing_as_minus_one("level")], direction=Direction(count_degrees=False)),
        "bfs_parent_max": _bfs(["id", _missing_as_minus_one("parent")]),
        "bfs_parent_min": _bfs(["id", _missing_as_minus_one("parent")], parent="min"),
        "bfs_reachable": lambda s, d: traversal.reachable(_bfs(["level"])(s, d)),
        "bfs_text": lambda s, d: edge_list.value_lines(_bfs(["id", "parent"])(s, d), "parent"),
        "bfs_profile": _bfs_profile,
        "edge_text_export": lambda s, d: edge_list.edge_lines(sparse(s, d)),
        "edge_binary_roundtrip": _binary_round_trip,
        "cc_weak_pull": _directed(Direction("pull", weak_pull=True)),
        "cc_nostrong_push": _directed(Direction("push", strong_push=False)),
        "bfs_profile_20": _bfs_profile_20,
        "bfs_summary": _bfs_summary,
        "bfs_stats": _bfs_stats,
        "bfs_root": _bfs_root,
        "pagerank_file": _rank_file,
        # the whole co-purchase graph, where the others see its sparse part
        "out_degree_full": lambda s, d: full(s, d).out_degrees(),
        "in_degree_full": lambda s, d: full(s, d).in_degrees(),
        "packed_vectors_full": lambda s, d: packing.pack(full(s, d)),
        "pack_in_4_full": lambda s, d: packing.pack_stats(full(s, d), "dst", 4),
        "pack_out_16_full": lambda s, d: packing.pack_stats(full(s, d), "src", 16),
        "vertex_index_in_full": lambda s, d: packing.vertex_index(full(s, d), "dst"),
        "edge_ranges_full": lambda s, d: packing.edge_ranges(full(s, d), PARTS),
        "vertex_ranges_full": lambda s, d: packing.vertex_ranges(full(s, d), PARTS),
        "work_units_full": lambda s, d: packing.work_units(full(s, d), UNITS),
        "edge_text_export_full": lambda s, d: edge_list.edge_lines(full(s, d)),
        "edge_binary_roundtrip_full": lambda s, d: _binary_round_trip(s, d, "copurchase"),
        "cc_directed_full": _directed(graph="copurchase"),
        "cc_undirected_full": lambda s, d: components.undirected_components(full(s, d)),
        "bfs_level_full": lambda s, d: traversal.bfs(full(s, d))[0].selectExpr("id", _missing_as_minus_one("level")),
    }
    for lanes in (4, 8, 16):
        for name, by in (("in", "dst"), ("out", "src")):
            made[f"pack_{name}_{lanes}"] = lambda s, d, by=by, lanes=lanes: packing.pack_stats(sparse(s, d), by, lanes)
    return made


def oracle_sql() -> dict[str, str]:
    degree = "SELECT v.id, coalesce(c, 0) AS degree FROM verts v LEFT JOIN (SELECT {0}, count(*) AS c FROM edges GROUP BY {0}) d ON v.id = d.{0}"
    none = "SELECT id FROM verts WHERE id NOT IN (SELECT {} FROM edges)"

    def ranks(graph: str, iterations: int, **options) -> str:
        ctes, body = _ranks(iterations, **options)
        return _with(graph, *ctes) + body

    directed = _with("sparse", _CC.format(edges="edges"), recursive=True)
    undirected = _with("sparse", _BOTH, _CC.format(edges="both_ways"), recursive=True)
    levels = _with("sparse", _BFS, recursive=True) + "SELECT v.id, CAST(coalesce(level, -1) AS BIGINT) AS level FROM verts v LEFT JOIN b ON v.id = b.id"
    frontier = _with("sparse") + "SELECT dst AS id, max(src) AS parent FROM edges WHERE src = 0 AND dst <> 0 GROUP BY dst"
    index = lambda key: (_PARTS_SQL.format(key=key), _INDEX, _RANGES)
    vertex_ranges = f"""SELECT part, coalesce(lag(last_id) OVER (ORDER BY part) + 1, 0) AS first_id, last_id, last_id - coalesce(lag(last_id) OVER (ORDER BY part), -1) AS n_vertices FROM (
        SELECT part, max(last_id) OVER (ORDER BY part) AS last_id FROM (
          SELECT part, CASE WHEN part = {PARTS - 1} THEN nv - 1 ELSE least(id - id % 512 + 511, nv - 1) END AS last_id
          FROM ranges r JOIN idx x ON x.first_vector <= r.last_vector AND r.last_vector < x.first_vector + x.n_vectors, (SELECT count(*) AS nv FROM verts)))"""
    sum_ctes, sum_body = _ranks(10)
    one, _ = _ranks(1)
    sql = {
        "out_degree": _with("sparse") + degree.format("src"),
        "in_degree": _with("sparse") + degree.format("dst"),
        "trade_degree": _with("trade") + degree.format("src"),
        "sinks": _with("sparse") + none.format("src"),
        "sources": _with("sparse") + none.format("dst"),
        "isolated": _with("sparse") + none.format("src") + " AND id NOT IN (SELECT dst FROM edges)",
        "packed_vectors": _with("sparse") + """SELECT key, slot, list(neighbour ORDER BY neighbour) AS neighbours FROM (
            SELECT dst AS key, src AS neighbour, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 4 AS slot FROM edges) GROUP BY key, slot""",
        "vertex_index_in": _index_sql("dst"),
        "vertex_index_out": _index_sql("src"),
        "edge_ranges": _with("sparse", *index("dst")) + "SELECT * FROM ranges",
        "vertex_ranges": _with("sparse", *index("dst")) + vertex_ranges,
        "vertex_ranges_by_src": _with("sparse", *index("src")) + vertex_ranges,
        "work_units": _with("sparse", *index("dst"))
        + f"SELECT u AS unit, (n // {UNITS}) * u + least(u, n % {UNITS}) AS first_vector, (n // {UNITS}) * (u + 1) + least(u + 1, n % {UNITS}) AS end_vector FROM total, range({UNITS}) t(u)",
        "gather_sum_step": _with("sparse", *one[:3]) + f"SELECT id, round(a, {ROUND}) AS acc FROM a0",
        "gather_min_step": _with("sparse") + "SELECT dst AS id, min(src) AS label FROM edges GROUP BY dst",
        "frontier_push_step": frontier,
        "frontier_pull_step": frontier,
        "pagerank_init": _with("sparse", _DEGREES) + "SELECT id, od AS outdeg, round((1.0::DOUBLE / n) / deg, 12) AS prop FROM vd",
        "pagerank_1": ranks("copurchase", 1),
        "pagerank_10": ranks("copurchase", 10),
        "pagerank_10_push": ranks("copurchase", 10),
        "pagerank_sparse": ranks("sparse", 10),
        "pagerank_users": ranks("users", 10),
        "pagerank_sum": _with("sparse", *sum_ctes) + f"SELECT round(sum(prop * deg), 8) AS rank_sum FROM vd JOIN p10 p ON vd.id = p.id",
        "pagerank_top": _with("sparse", *sum_ctes) + sum_body + " ORDER BY rank DESC, vd.id LIMIT 20",
        "pagerank_edge_only": _with("sparse", _DEGREES) + f"SELECT id, round(1.0::DOUBLE / n, {ROUND}) AS rank FROM vd",
        "pagerank_vertex_only": _with("sparse", _DEGREES) + f"SELECT id, round(1.0::DOUBLE / n, {ROUND}) AS rank FROM vd",
        "pagerank_text": _with("sparse", *one) + "SELECT vd.id, vd.id || ' ' || format('{:.5e}', prop * deg) AS line FROM vd JOIN p1 p ON vd.id = p.id",
        "pagerank_085_nosink": ranks("sparse", 10, damping=0.85, redistribute=False),
        "cc_directed": directed + "SELECT id, label FROM cc",
        "cc_directed_pull": directed + "SELECT id, label FROM cc",
        "cc_directed_push": directed + "SELECT id, label FROM cc",
        "cc_dense": _with("users", _CC.format(edges="edges"), recursive=True) + "SELECT id, label FROM cc",
        "cc_undirected": undirected + "SELECT id, label FROM cc",
        "cc_sizes": undirected + "SELECT label, count(*) AS size FROM cc GROUP BY label",
        "cc_text": directed + "SELECT id, id || ' ' || label AS line FROM cc",
        "bfs_level": levels,
        "bfs_level_vertex_votes": levels,
        "bfs_parent_max": _parent_sql("max"),
        "bfs_parent_min": _parent_sql("min"),
        "bfs_reachable": _with("sparse", _BFS, recursive=True) + "SELECT count(*) AS reachable FROM b",
        "bfs_text": f"SELECT id, id || ' ' || parent AS line FROM ({_parent_sql('max')})",
        "bfs_profile": _with("copurchase", _BFS, _DEGREES, recursive=True)
        + """, lv AS (SELECT level, count(*) AS n, CAST(sum(1 + od) AS BIGINT) AS vote FROM b JOIN vd USING (id) GROUP BY level)
            SELECT CAST(a.level + 1 AS INT) AS iteration, CASE WHEN a.vote > (SELECT count(*) FROM edges) // 5 THEN 'Pull' ELSE 'Push' END AS engine,
                   a.vote AS vote_before, a.n AS n_active, coalesce(z.n, 0) AS n_changed, coalesce(z.vote, 0) AS vote
            FROM lv a LEFT JOIN lv z ON z.level = a.level + 1""",
        "edge_text_export": _with("sparse") + """SELECT 0 AS line_no, CAST(count(*) AS VARCHAR) AS line FROM verts UNION ALL SELECT 1, CAST(count(*) AS VARCHAR) FROM edges
            UNION ALL SELECT row_number() OVER (ORDER BY dst, src) + 1, src || ' ' || dst FROM edges""",
        "edge_binary_roundtrip": _with("sparse") + "SELECT src, dst FROM edges",
    }
    profile, levels_of_run = sql["bfs_profile"], _with("copurchase", _BFS, _DEGREES, recursive=True)
    sql |= {
        "cc_weak_pull": sql["cc_directed"],
        "cc_nostrong_push": sql["cc_directed"],
        "cc_profile": _with("sparse", _DEGREES, _CC_ROUNDS, recursive=True) + _CC_PROFILE,
        "bfs_profile_20": profile.replace("// 5", "// 20"),
        "bfs_summary": f"""SELECT (SELECT count(*) FROM part) AS n_vertices, (SELECT count(*) FROM ({_STEPS}) WHERE dst IS NOT NULL) AS n_edges, CAST(count(*) AS INT) AS iterations,
            CAST(count(*) FILTER (engine = 'Pull') AS INT) AS pulls, CAST(count(*) FILTER (engine = 'Push') AS INT) AS pushes FROM ({profile})""",
        "bfs_stats": levels_of_run
        + """, lv AS (SELECT level, count(*) AS n, CAST(sum(1 + od) AS BIGINT) AS vote, CAST(sum((od + 3) // 4) AS BIGINT) AS vectors, CAST(sum(od) AS BIGINT) AS edges FROM b JOIN vd USING (id) GROUP BY level),
            pulled AS (SELECT CAST(sum((c + 3) // 4) AS BIGINT) AS vectors, CAST(sum(c) AS BIGINT) AS edges FROM (SELECT count(*) AS c FROM edges GROUP BY dst)),
            met AS (SELECT level, n, CASE WHEN vote > pulled.edges // 5 THEN pulled.vectors ELSE lv.vectors END AS vectors, CASE WHEN vote > pulled.edges // 5 THEN pulled.edges ELSE lv.edges END AS edges FROM lv, pulled)
            SELECT CAST(level + 1 AS INT) AS iteration, vectors, edges, round(CASE WHEN vectors = 0 THEN 0 ELSE 100.0::DOUBLE * edges / (vectors * 4) END, 6) AS efficiency,
                   round(n::DOUBLE / (SELECT count(*) FROM verts), 8) AS frontier_ratio FROM met""",
        "bfs_root": _with("sparse", _BFS.replace("0::BIGINT", f"{ROOT}::BIGINT"), _PARENTS.format(pick="max"), recursive=True)
        + f"""SELECT v.id, CAST(coalesce(b.level, -1) AS BIGINT) AS level, CASE WHEN v.id = {ROOT} THEN {ROOT} ELSE coalesce(p.parent, -1) END AS parent
            FROM verts v LEFT JOIN b ON v.id = b.id LEFT JOIN parents p ON v.id = p.id""",
        "pagerank_file": f"SELECT line FROM ({sql['pagerank_text']})",
        "pack_in_4_full": _stats_sql("dst", 4),
        "pack_out_16_full": _stats_sql("src", 16),
    }
    whole = ["out_degree", "in_degree", "packed_vectors", "vertex_index_in", "edge_ranges", "vertex_ranges", "work_units", "edge_text_export", "edge_binary_roundtrip", "cc_directed", "cc_undirected", "bfs_level"]
    sql |= {f"{name}_full": sql[name] for name in whole}
    sql |= {name: text.replace(GRAPH_SQL["sparse"], GRAPH_SQL["copurchase"]) for name, text in sql.items() if name.endswith("_full")}
    for lanes in (4, 8, 16):
        sql |= {f"pack_in_{lanes}": _stats_sql("dst", lanes), f"pack_out_{lanes}": _stats_sql("src", lanes)}
    return sql
