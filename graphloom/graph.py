"""A directed, unweighted graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to here fit the 48 bits of the edge-list format.
MAX_ID = (1 << 48) - 1


@dataclass(frozen=True)
class Graph:
    """``vertices(id)`` and ``edges(src, dst)``; multi-edges and self-loops are kept.

    The vertex table is explicit, so vertices without edges exist.
    """

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame) -> Graph:
        return cls(
            vertices.select(F.col("id").cast("long").alias("id")),
            edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")),
        )

    @classmethod
    def dense(cls, spark: SparkSession, n: int, edges: DataFrame) -> Graph:
        """Vertices 0 .. n - 1."""
        return cls.of(spark.range(n), edges)

    @cached_property
    def n_vertices(self) -> int:
        return self.vertices.count()

    @cached_property
    def n_edges(self) -> int:
        return self.edges.count()

    def validate(self) -> Graph:
        """Raise ValueError for null, repeated, negative or too large ids and for edges that leave the graph."""
        bad = self.vertices.where(F.col("id").isNull() | (F.col("id") < 0) | (F.col("id") > MAX_ID)).limit(1).count()
        repeated = self.vertices.groupBy("id").count().where("count > 1").limit(1).count()
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        outside = ends.where("id is null").limit(1).count() or ends.join(self.vertices, "id", "left_anti").limit(1).count()
        for found, what in ((bad, "a vertex id is null or out of range"), (repeated, "a vertex id occurs twice"), (outside, "an edge ends at no vertex")):
            if found:
                raise ValueError(what)
        return self

    def reverse(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def symmetrize(self) -> Graph:
        """Every edge in both directions (repeated edges once)."""
        return Graph(self.vertices, self.edges.union(self.reverse().edges).distinct())

    def degrees(self, by: str) -> DataFrame:
        """(id, degree) of all vertices; ``by`` is ``src`` for out-degrees, ``dst`` for in-degrees."""
        counted = self.edges.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def out_degrees(self) -> DataFrame:
        return self.degrees("src")

    def in_degrees(self) -> DataFrame:
        return self.degrees("dst")


def divisor(degree: Column, n: int) -> Column:
    """A rank's divisor: the out-degree, or the number of vertices for a sink."""
    return F.when(degree == 0, F.lit(float(n))).otherwise(degree.cast("double"))
