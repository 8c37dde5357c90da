"""How edges pack into vectors of a few lanes, and how packed edges and vertices split into ranges.

A vector holds up to ``lanes`` neighbours of one vertex (the key); positions count
vectors in order of (key, slot). Everything here follows from degrees, so large
vertices cost no more than small ones, except ``pack`` and ``slots``, which list neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..sources.edge_list import ranked


#: Rows that a step takes together where it works in global order.
_BLOCK = 65_536


def _keys(by: str) -> tuple[str, str]:
    return ("dst", "src") if by == "dst" else ("src", "dst")


def pack(graph: Graph, by: str = "dst", lanes: int = 4) -> DataFrame:
    """(key, slot, neighbours): the edges of each vertex in sorted order, ``lanes`` a row."""
    key, neighbour = _keys(by)
    placed = ranked(graph.edges.select(F.col(key).alias("key"), F.col(neighbour).alias("neighbour")), ["key", "neighbour"])
    placed = placed.withColumn("block", F.floor(F.col("position") / _BLOCK).cast("long"))
    # where each key starts, handed to the blocks it spans: a large key's edges meet a block at a time
    starts = placed.groupBy("key").agg(F.min("position").alias("start"))
    spans = placed.select("key", "block").distinct().join(starts, "key")
    slot = F.floor((F.col("position") - F.col("start")) / lanes).cast("long")
    packed = placed.join(spans, ["key", "block"]).groupBy("key", slot.alias("slot"))
    return packed.agg(F.array_sort(F.collect_list("neighbour")).alias("neighbours"))


def pack_stats(graph: Graph, by: str = "dst", lanes: int = 4) -> DataFrame:
    """(lanes, edges, vectors, vectors_model, efficiency): vectors that a packing needs, and lanes filled, in percent.

    ``vectors_model`` leaves the last open vector out where there are more than four lanes.
    """
    key, _ = _keys(by)
    vectors = F.coalesce(F.sum(F.ceil(F.col("count") / lanes)), F.lit(0)).cast("long")
    edges = F.coalesce(F.sum("count"), F.lit(0)).cast("long")
    total = graph.edges.groupBy(key).count().agg(edges.alias("edges"), vectors.alias("vectors"))
    model = F.when(F.lit(lanes > 4) & (F.col("vectors") > 0), F.col("vectors") - 1).otherwise(F.col("vectors"))
    efficiency = F.when(F.col("vectors") > 0, F.round(F.col("edges") * 100.0 / (F.col("vectors") * lanes), 6)).otherwise(F.lit(0.0))
    return total.select(F.lit(lanes).alias("lanes"), "edges", "vectors", model.alias("vectors_model"), efficiency.alias("efficiency"))


def vertex_index(graph: Graph, by: str = "dst", lanes: int = 4) -> DataFrame:
    """(id, first_vector, n_vectors) of each vertex that has edges: where its vectors start."""
    key, _ = _keys(by)
    sized = graph.edges.groupBy(F.col(key).alias("id")).agg(F.ceil(F.count("*") / lanes).cast("long").alias("n_vectors"))
    placed = ranked(sized, ["id"])
    # sums within blocks of consecutive keys, then over blocks: no window spans all keys
    block = F.floor(F.col("position") / _BLOCK).cast("long")
    placed = placed.withColumn("block", block)
    blocks = placed.groupBy("block").agg(F.sum("n_vectors").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("n_vectors").over(inside), F.lit(0))
    return placed.join(blocks, "block").select("id", first.alias("first_vector"), "n_vectors")


def edge_ranges(graph: Graph, parts: int, by: str = "dst", lanes: int = 4) -> DataFrame:
    """(part, first_vector, last_vector, n_vectors): vectors [n*i/k, n*(i+1)/k) for part i of k."""
    total = pack_stats(graph, by, lanes).select("vectors")
    i, n = F.col("part"), F.col("vectors")
    ranges = graph.edges.sparkSession.range(parts).select(F.col("id").alias("part")).join(total)
    first, stop = F.floor(n * i / parts), F.floor(n * (i + 1) / parts)
    return ranges.select("part", first.alias("first_vector"), (stop - 1).alias("last_vector"), (stop - first).alias("n_vectors"))


def vertex_ranges(graph: Graph, parts: int, by: str = "dst", lanes: int = 4, block: int = 512) -> DataFrame:
    """(part, first_id, last_id, n_vertices): each part ends with the block that its last vector's vertex is in.

    The last part takes the rest; where a small graph is used up early, later parts are empty.
    """
    n = graph.n_vertices
    index = vertex_index(graph, by, lanes)
    ranges = edge_ranges(graph, parts, by, lanes)
    hit = (F.col("first_vector") <= F.col("last_vector")) & (F.col("last_vector") < F.col("first_vector") + F.col("n_vectors"))
    ends = ranges.select("part", "last_vector").join(index, hit, "left")
    last = F.least(F.coalesce(F.col("id"), F.lit(-1)) - F.pmod(F.coalesce(F.col("id"), F.lit(-1)), F.lit(block)) + block - 1, F.lit(n - 1))
    last = F.when(F.col("part") == parts - 1, F.lit(n - 1)).when(F.col("id").isNull(), F.lit(-1)).otherwise(last)
    # one row a part
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    bounds = ends.select("part", last.alias("last_id"))
    bounds = bounds.withColumn("last_id", F.max("last_id").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.coalesce(F.lag("last_id").over(order) + 1, F.lit(0))
    return bounds.select("part", first.alias("first_id"), "last_id", (F.col("last_id") - first + 1).alias("n_vertices"))


def work_units(graph: Graph, units: int, by: str = "dst", lanes: int = 4) -> DataFrame:
    """(unit, first_vector, end_vector): an even split; the first ``n mod units`` units get one vector more."""
    total = pack_stats(graph, by, lanes).select("vectors")
    u, n = F.col("unit"), F.col("vectors")
    each, spare = F.floor(n / units), n % units
    rows = graph.edges.sparkSession.range(units).select(F.col("id").alias("unit")).join(total)
    return rows.select("unit", (each * u + F.least(u, spare)).alias("first_vector"), (each * (u + 1) + F.least(u + 1, spare)).alias("end_vector"))
