"""Connected components.

``weak_components`` ignores direction and works on ids of any orderable type by
alternating large-star and small-star rounds: every round replaces the edges by
links to smaller ids, so a path of length d shrinks to a star in O(log d) rounds
where label propagation needs d. Links are kept with u > v, so that a round is two
grouped minima (combined before the shuffle, so a hub is one number a task) and two
equi-joins, which adaptive execution splits where a hub makes them uneven. Nothing
reaches the driver but two numbers a round and a plan of four scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import Rounds
from ..plans.direction import Direction
from ..plans.superstep import Result, VertexProgram, run

MAX_ROUNDS = 200


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger end to the least neighbour of its smaller one; as u > v, that is the least of the links that leave v, or v itself."""
    least = links.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return links.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours (u > v) to the least of them, which the vertex itself takes in its own place."""
    down = links.distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def weak_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, component): for every id on an edge the smallest id it is connected to.

    Self-loops and repeated edges change nothing; rows with a null end are no edges.
    """
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = links.where("u = v").select(F.col("u").alias("id")).distinct()
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # their number and an order-free digest tell if a round has changed the links
    numbers = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")
    with Rounds(edges.sparkSession, "links") as rounds:
        links, seen = rounds.store(links.distinct(), *numbers)
        for _ in range(max_rounds):
            if not seen["n"]:
                break
            links, now = rounds.store(_small_star(_large_star(links)).distinct(), *numbers)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    stars = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    found = stars.union(roots)
    alone = loops.join(found, "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.union(alone)


def min_label_program() -> VertexProgram:
    return VertexProgram(
        init=F.col("id"),
        active=F.lit(True),
        message=F.col("value"),
        reduce=F.min,
        accept=F.col("msg") < F.col("value"),
        update=F.col("msg"),
    )


def directed_components(graph: Graph, direction: Direction | None = None, stats: bool = False) -> Result:
    """Smallest id among the vertices that can reach each vertex (itself included), by supersteps.

    That is the weak component only where every edge has its reverse; see ``weak_components``.
    """
    return run(graph, min_label_program(), direction, stats=stats)


def undirected_components(graph: Graph) -> DataFrame:
    """(id, label): smallest id of each vertex's weakly connected component, for all vertices."""
    found = weak_components(graph.edges)
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label"))


def sizes(labels: DataFrame) -> DataFrame:
    """(label, size) of each component."""
    return labels.groupBy("label").agg(F.count("*").alias("size"))
