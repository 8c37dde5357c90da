"""PageRank with uniform redistribution of what sinks hold.

State is a vertex's message, rank over divisor (the out-degree, or V for a sink). An
iteration gathers the messages along the edges, gives every vertex its share of what
was not gathered, and damps:

    rank = d * (gathered + (1 - sum gathered) / V) + (1 - d) / V

The sum of the gathered ranks is that of all vertices with out-edges, so it is read
off the state when that is written: no second pass over edges, no scalar join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, divisor
from ..lineage import Rounds, stored_edges

DAMPING = 0.875


def initial(graph: Graph) -> DataFrame:
    """(id, outdeg, prop) before the first iteration: rank 1/V everywhere."""
    n = graph.n_vertices
    degrees = graph.out_degrees().withColumnRenamed("degree", "outdeg")
    return degrees.select("id", "outdeg", (F.lit(1.0 / n if n else 0.0) / divisor(F.col("outdeg"), n)).alias("prop"))


def gather(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(id, acc): messages summed by destination."""
    senders = state.where("outdeg > 0").select(F.col("id").alias("src"), "prop")
    return edges.join(senders, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("prop").alias("acc"))


def scatter(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(id, acc): each source sends its message along its own edges, one row a source and destination, and sums meet there.

    Edges are grouped by source first (a source's repeated edges to a destination become one
    message with a multiplicity), where gathering joins every edge with its source's message.
    """
    senders = state.where("outdeg > 0").select(F.col("id").alias("src"), "prop")
    sent = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")).join(senders, "src")
    return sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("prop") * F.col("times")).alias("acc"))


def apply(state: DataFrame, acc: DataFrame, gathered: float, n: int, damping: float = DAMPING, redistribute: bool = True) -> DataFrame:
    """The vertex phase: state after an iteration that gathered ``acc`` (in sum ``gathered``)."""
    lost = (1.0 - gathered) / n if redistribute else 0.0
    rank = (F.coalesce("acc", F.lit(0.0)) + F.lit(lost)) * F.lit(damping) + F.lit((1.0 - damping) / n)
    return state.join(acc, "id", "left").select("id", "outdeg", (rank / divisor(F.col("outdeg"), n)).alias("prop"))


def _stored(rounds: Rounds, state: DataFrame) -> tuple[DataFrame, float]:
    """State in shared storage, and the rank on vertices with out-edges (what the next gathering will collect); one job."""
    kept = F.sum(F.when(F.col("outdeg") > 0, F.col("prop") * F.col("outdeg")))
    state, seen = rounds.store(state, F.coalesce(kept, F.lit(0.0)).alias("gathered"))
    return state, float(seen["gathered"])


def pagerank(
    graph: Graph,
    iterations: int = 1,
    damping: float = DAMPING,
    redistribute: bool = True,
    edge_phase: bool = True,
    vertex_phase: bool = True,
    engine: str = "pull",
) -> DataFrame:
    """(id, rank) after a fixed number of iterations.

    ``redistribute=False`` lets sinks lose their rank. Without its edge phase an iteration gathers
    nothing (every rank becomes 1/V); without its vertex phase messages are gathered and state stays.
    ``engine="push"`` scatters: see :func:`scatter`.
    """
    if iterations < 1:
        raise ValueError("at least one iteration")
    if engine not in ("pull", "push"):
        raise ValueError(f"no such engine: {engine}")
    n = graph.n_vertices
    state = initial(graph)
    if n:
        phase = scatter if engine == "push" else gather
        with stored_edges(graph) as edges, Rounds(graph.edges.sparkSession, "ranks") as rounds:
            state, gathered = _stored(rounds, initial(Graph(graph.vertices, edges)))
            for _ in range(iterations):
                if not edge_phase:
                    gathered, acc = 0.0, state.limit(0).select("id", F.col("prop").alias("acc"))
                else:
                    acc = phase(edges, state)
                if vertex_phase:
                    state, gathered = _stored(rounds, apply(state, acc, gathered, n, damping, redistribute))
                elif edge_phase:
                    # the edge phase by itself: its sums are formed and go nowhere
                    acc.write.format("noop").mode("overwrite").save()
    return state.select("id", (F.col("prop") * divisor(F.col("outdeg"), n)).alias("rank"))


def rank_sum(ranks: DataFrame) -> DataFrame:
    """(rank_sum): should be 1 where what sinks hold is redistributed."""
    return ranks.agg(F.sum("rank").alias("rank_sum"))


def top(ranks: DataFrame, k: int) -> DataFrame:
    """The k highest ranks."""
    return ranks.orderBy(F.desc("rank"), "id").limit(k)
