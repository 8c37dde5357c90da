"""Which way an iteration walks the edges, and when it stops.

A vote sums, over the vertices that changed, one for the vertex and its out-degree
(either part can be left out). A vote above a fraction of the edges means that
most edges matter: the iteration pulls (joins all edges with all state). Below, it
pushes: only edges that leave changed vertices are read, and the changed vertices
are broadcast if they are few. The results are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Changed vertices (16 bytes each) that a push may broadcast.
BROADCAST_FRONTIER = 1_000_000


@dataclass(frozen=True)
class Direction:
    engine: str = "auto"  # "auto", "pull" or "push"
    count_vertices: bool = True
    count_degrees: bool = True
    edge_share: int = 5  # pull above 1/5 of the edges
    vertex_share: int = 2  # without degrees: above 1/2 of the vertices
    weak_pull: bool = False  # pulling takes messages of changed vertices only
    strong_push: bool = True  # pushing starts from changed vertices only

    def __post_init__(self):
        if self.engine not in ("auto", "pull", "push"):
            raise ValueError(f"no such engine: {self.engine}")
        if not (self.count_vertices or self.count_degrees):
            raise ValueError("a vote of nothing is always 0")

    def vote(self, degree: Column) -> Column:
        return (F.lit(int(self.count_vertices)) + (degree if self.count_degrees else F.lit(0))).cast("long")

    def first_vote(self, n_vertices: int, degrees: int) -> int:
        return n_vertices * self.count_vertices + degrees * self.count_degrees

    def choose(self, vote: int, n_vertices: int, n_edges: int) -> str:
        if self.engine != "auto":
            return self.engine
        limit = n_edges // self.edge_share if self.count_degrees else n_vertices // self.vertex_share
        return "pull" if vote > limit else "push"


def near(frontier: DataFrame, size: int) -> DataFrame:
    """The frontier, broadcast if it is known to be small."""
    return F.broadcast(frontier) if size <= BROADCAST_FRONTIER else frontier


@dataclass(frozen=True)
class Iteration:
    """What one superstep did."""

    iteration: int
    engine: str
    vote_before: int
    n_active: int
    n_changed: int
    vote: int
    vectors: int | None = None
    edges: int | None = None
    ms: int = 0
