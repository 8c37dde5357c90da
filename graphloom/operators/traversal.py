"""Breadth-first search from one root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.direction import Direction
from ..plans.superstep import Result, VertexProgram, run


def program(root: int, parent: str) -> VertexProgram:
    """Every vertex takes one message, the id of a vertex one level up."""
    return VertexProgram(
        init=F.lit(None).cast("long"),
        active=F.col("id") == root,
        message=F.col("src"),
        reduce=F.max if parent == "max" else F.min,
        accept=F.lit(True),
        update=F.col("msg"),
        receptive=F.col("id") != root,
        once=True,
    )


def bfs(graph: Graph, root: int = 0, parent: str = "max", direction: Direction | None = None, stats: bool = False, root_parent: bool = False) -> tuple[DataFrame, Result]:
    """(id, level, parent) of all vertices, and the run.

    Of several parents one level up, the largest (or smallest, ``parent="min"``) is
    taken. The root has level 0 and no parent (itself with ``root_parent``); an unreached
    vertex has neither.
    """
    if parent not in ("max", "min"):
        raise ValueError(f"no such choice of parent: {parent}")
    done = run(graph, program(root, parent), direction, stats=stats)
    level = F.when(F.col("id") == root, F.lit(0)).when(F.col("changed_at") > 0, F.col("changed_at"))
    parents = F.when(F.col("id") == root, F.lit(root)).otherwise(F.col("value")) if root_parent else F.col("value")
    return done.state.select("id", level.alias("level"), parents.cast("long").alias("parent")), done


def reachable(levels: DataFrame) -> DataFrame:
    """(reachable): how many vertices the search reached, its root included."""
    return levels.agg(F.count("level").alias("reachable"))
