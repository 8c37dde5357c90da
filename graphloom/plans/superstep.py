"""Vertex programs: messages along edges, one reduction a vertex, one update a superstep.

Every superstep is one join and one grouped reduction with map-side combining; the
new state goes to shared storage together with the numbers that the driver decides
by. State never reaches the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import Rounds, release, stored_edges
from .direction import Direction, Iteration, near


@dataclass(frozen=True)
class VertexProgram:
    """``value`` of a vertex, changed by reduced messages until nothing changes.

    init and active see ``id``; message sees ``src`` and ``value``; accept sees the
    old ``value`` and the reduced ``msg`` and tells if the vertex changes (to
    ``update``); with ``once`` a vertex that has changed takes no more messages, and
    ``receptive`` tells which may take any.
    """

    init: Column
    active: Column
    message: Column
    reduce: Callable[[Column], Column]
    accept: Column
    update: Column
    receptive: Column = field(default_factory=lambda: F.lit(True))
    once: bool = False


@dataclass(frozen=True)
class Result:
    """(id, value, changed_at) of all vertices, and a row for each superstep."""

    state: DataFrame
    iterations: list[Iteration]
    n_vertices: int = 0
    n_edges: int = 0
    paths: tuple[str, ...] = ()

    def summary(self) -> DataFrame:
        """One row: sizes, iterations by engine, milliseconds and millions of edges a second (all edges counted each iteration)."""
        ms = sum(i.ms for i in self.iterations)
        pulls = sum(i.engine == "pull" for i in self.iterations)
        rate = self.n_edges * len(self.iterations) / ms / 1000 if ms else 0.0
        row = (self.n_vertices, self.n_edges, len(self.iterations), pulls, len(self.iterations) - pulls, ms, rate)
        return self.state.sparkSession.createDataFrame([row], "n_vertices long, n_edges long, iterations int, pulls int, pushes int, ms long, million_edges_per_sec double")

    def stats(self, lanes: int = 4) -> DataFrame:
        """Edge vectors and edges that each iteration looked at, and how full the vectors were; for runs with ``stats``."""
        rows = [(i.iteration, i.vectors, i.edges, 100.0 * i.edges / (i.vectors * lanes) if i.vectors else 0.0, i.ms, i.n_active / max(1, self.n_vertices)) for i in self.iterations if i.vectors is not None]
        return self.state.sparkSession.createDataFrame(rows, "iteration int, vectors long, edges long, efficiency double, ms long, frontier_ratio double")

    def release(self) -> None:
        """Delete the state of the run (as a context manager does at its end)."""
        for path in self.paths:
            release(self.state.sparkSession, path)

    def __enter__(self) -> Result:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def profile(self) -> DataFrame:
        rows = [(i.iteration, i.engine.capitalize(), i.vote_before, i.n_active, i.n_changed, i.vote) for i in self.iterations]
        return self.state.sparkSession.createDataFrame(rows, "iteration int, engine string, vote_before long, n_active long, n_changed long, vote long")


def start(graph: Graph, program: VertexProgram) -> DataFrame:
    """State before the first superstep."""
    return graph.out_degrees().select(
        "id",
        F.col("degree").alias("outdeg"),
        program.init.alias("value"),
        program.active.alias("active"),
        program.receptive.alias("receptive"),
        F.lit(0).alias("changed_at"),
    )


def messages(edges: DataFrame, state: DataFrame, program: VertexProgram, engine: str, n_active: int, weak_pull: bool = False, strong_push: bool = True) -> DataFrame:
    """(id, msg): reduced messages. Pulling reads all edges; pushing those that leave active vertices.

    ``weak_pull`` leaves out the messages of vertices that haven't changed, ``strong_push=False``
    sends them along; what a vertex makes of its messages is the same.
    """
    only_active = program.once or (strong_push if engine == "push" else weak_pull)
    senders = state.where("active") if only_active else state
    senders = senders.select(F.col("id").alias("src"), "value")
    if engine == "push" and only_active:
        senders = near(senders, n_active)
    sent = edges.join(senders, "src")
    if program.once and engine == "pull":
        # pulling visits only vertices that still want something
        sent = sent.join(state.where("receptive").select(F.col("id").alias("dst")), "dst", "left_semi")
    return sent.groupBy(F.col("dst").alias("id")).agg(program.reduce(program.message).alias("msg"))


def advance(state: DataFrame, msgs: DataFrame, program: VertexProgram, iteration: int) -> DataFrame:
    """State after a superstep; exactly the vertices that changed are active."""
    changes = F.coalesce(F.col("receptive") & F.col("msg").isNotNull() & program.accept, F.lit(False))
    met = state.join(msgs, "id", "left").withColumn("changes", changes)
    return met.select(
        "id",
        "outdeg",
        F.when(F.col("changes"), program.update).otherwise(F.col("value")).alias("value"),
        F.col("changes").alias("active"),
        (F.col("receptive") & ~F.col("changes") if program.once else F.col("receptive")).alias("receptive"),
        F.when(F.col("changes"), F.lit(iteration)).otherwise(F.col("changed_at")).alias("changed_at"),
    )


def _stored(rounds: Rounds, state: DataFrame, weight: Column) -> tuple[DataFrame, int, int]:
    """State in shared storage, how many vertices are active, and the sum of their weights; one job."""
    active = F.col("active")
    state, seen = rounds.store(state, F.count_if(active).alias("n"), F.coalesce(F.sum(F.when(active, weight)), F.lit(0)).alias("vote"))
    return state, int(seen["n"]), int(seen["vote"])


def run(graph: Graph, program: VertexProgram, direction: Direction | None = None, max_iterations: int = 10_000, stats: bool = False) -> Result:
    """Supersteps until the vote is zero (the superstep that finds nothing counts too).

    State that a later superstep has replaced, and the stored edges, are deleted; the last state stays.
    """
    direction = direction or Direction()
    spark = graph.edges.sparkSession
    done: list[Iteration] = []
    with stored_edges(graph) as edges, Rounds(spark, "state") as rounds:
        n, m = graph.n_vertices, edges.count()
        state, n_active, degrees = _stored(rounds, start(Graph(graph.vertices, edges), program), F.col("outdeg"))
        vote = direction.first_vote(n_active, degrees)
        for iteration in range(1, max_iterations + 1):
            began = time.perf_counter()
            engine = direction.choose(vote, n, m)
            vectors, touched = packing_touched(edges, state, engine) if stats else (None, None)
            after = advance(state, messages(edges, state, program, engine, n_active, direction.weak_pull, direction.strong_push), program, iteration)
            state, changed, now = _stored(rounds, after, direction.vote(F.col("outdeg")))
            ms = round(1000 * (time.perf_counter() - began))
            done.append(Iteration(iteration, engine, vote, n_active, changed, now, vectors, touched, ms))
            n_active, vote = changed, now
            if not vote:
                break
        else:
            raise RuntimeError(f"not done after {max_iterations} iterations")
    return Result(state.select("id", "value", "changed_at"), done, n, m, tuple(rounds.paths))


def packing_touched(edges: DataFrame, state: DataFrame, engine: str, lanes: int = 4) -> tuple[int, int]:
    """Edge vectors and edges that a superstep looks at: all by destination, or the active ones by source."""
    if engine == "push":
        counted = edges.join(state.where("active").select(F.col("id").alias("src")), "src", "left_semi").groupBy("src").count()
    else:
        counted = edges.groupBy("dst").count()
    row = counted.agg(F.coalesce(F.sum(F.ceil(F.col("count") / lanes)), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    return int(row[0]), int(row[1])
