"""The binary edge-list format, and text results.

A file is little-endian 64-bit words: the numbers of vertices and edges, then
(source, destination) pairs. Spark reads it in splits of whole 16-byte records from
any store it knows; a name stands for two files, grouped by destination
(``-pull``) and by source (``-push``), and either will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import cut, new_path, release

SUFFIXES = ("-pull", "-push")
_RECORD = 16
_CHUNK = 1 << 16


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def resolve(spark: SparkSession, name: str) -> str:
    """The file that ``name`` stands for: itself, or itself with a suffix."""
    for path in (name, *(name + s for s in SUFFIXES)):
        if _exists(spark, path):
            return path
    raise FileNotFoundError(name)


def header(spark: SparkSession, path: str) -> tuple[int, int]:
    first = spark.sparkContext.binaryRecords(path, _RECORD).first()
    return struct.unpack("<QQ", first)


def _chunks(index: int, records: Iterator[bytes]) -> Iterator[tuple[bytes]]:
    """Records gathered into large pieces, without the header that opens the file."""
    if index == 0:
        next(records, None)
    part: list[bytes] = []
    for record in records:
        part.append(record)
        if len(part) == _CHUNK:
            yield (b"".join(part),)
            part = []
    if part:
        yield (b"".join(part),)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in batch.column(0).to_pylist():
            pairs = np.frombuffer(piece, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["src", "dst"])


def read(spark: SparkSession, name: str, check: bool = True) -> Graph:
    """The graph of an edge-list file; with ``check``, the header must tell the truth."""
    path = resolve(spark, name)
    n, m = header(spark, path)
    pieces = spark.sparkContext.binaryRecords(path, _RECORD).mapPartitionsWithIndex(_chunks)
    graph = Graph.dense(spark, n, spark.createDataFrame(pieces, "piece binary").mapInArrow(_decode, "src long, dst long"))
    if check:
        if graph.n_edges != m:
            raise ValueError(f"{path} announces {m} edges and holds {graph.n_edges}")
        if graph.edges.where((F.col("src") < 0) | (F.col("dst") < 0) | (F.col("src") >= n) | (F.col("dst") >= n)).limit(1).count():
            raise ValueError(f"{path} has an edge beyond its {n} vertices")
    return graph


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a batch without the last byte, which is 0 for every vertex below 2**56: the line separator stands in for it."""
    for batch in batches:
        if batch.num_rows:
            pairs = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("<i8")
            if pairs[-1, 1] >> 56:
                raise ValueError(f"no vertex number: {pairs[-1, 1]}")
            yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()[:-1]], pa.binary())], ["piece"])


def write(graph: Graph, name: str) -> None:
    """Both files of a graph.

    Tasks sort, encode and write the records as parts, through the text sink with a NUL as line separator.
    The format is one file with one header, so the store's API then puts the parts' bytes behind the header.
    """
    spark = graph.edges.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    n, m = graph.n_vertices, graph.n_edges
    for suffix, order in zip(SUFFIXES, (("dst", "src"), ("src", "dst")), strict=True):
        parts = new_path(spark, "records")
        try:
            pieces = graph.edges.orderBy(*order).select("src", "dst").mapInArrow(_encode, "piece binary")
            pieces.select(F.col("piece").cast("string").alias("value")).write.option("lineSep", "\0").text(parts)
            folder, path = hadoop.fs.Path(parts), hadoop.fs.Path(name + suffix)
            store = folder.getFileSystem(conf)
            names = sorted(f.getPath().getName() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
            out = path.getFileSystem(conf).create(path, True)
            try:
                out.write(struct.pack("<QQ", n, m))
                for part in names:
                    records = store.open(hadoop.fs.Path(folder, part))
                    try:
                        hadoop.io.IOUtils.copyBytes(records, out, 1 << 20, False)
                    finally:
                        records.close()
            finally:
                out.close()
        finally:
            release(spark, parts)


def edge_lines(graph: Graph) -> DataFrame:
    """The text form: number of vertices, number of edges, then ``src dst`` by destination; (line_no, line)."""
    spark = graph.edges.sparkSession
    head = spark.createDataFrame([(0, str(graph.n_vertices)), (1, str(graph.n_edges))], "line_no long, line string")
    ordered = ranked(graph.edges, ["dst", "src"], 2)
    return head.union(ordered.select(F.col("position").alias("line_no"), F.concat_ws(" ", "src", "dst").alias("line")))


def ranked(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """``rows`` with their position in the global order, without bringing them into one task.

    Rows are range-partitioned and sorted; partition sizes (a number a task) give
    each partition its first position. The sorted rows are written, so that both uses
    see the same partitions.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at")))
    split = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(split.alias("p")).agg(F.count("*").alias("n")).collect()}
    first, firsts = start, {}
    for p in sorted(sizes):
        firsts[p], first = first, first + sizes[p]
    if not firsts:
        return placed.withColumn("position", F.col("_at")).drop("_at")
    base = F.broadcast(spark.createDataFrame([(p, f) for p, f in firsts.items()], "_p long, _first long"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_p", split).join(base, "_p").withColumn("position", F.col("_first") + within).drop("_p", "_first", "_at")


def _exponential(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id %.5e`` as C prints it: exact ties go to the even digit, where Java's formatter rounds them up."""
    for batch in batches:
        lines = [f"{i} {r:.5e}" for i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["id", "line"])


def rank_lines(ranks: DataFrame) -> DataFrame:
    """(id, line): ``id rank``, the rank in the form 1.66667e-01."""
    return ranks.select("id", "rank").mapInArrow(_exponential, "id long, line string")


def value_lines(values: DataFrame, value: str) -> DataFrame:
    """(id, line): ``id value``, a missing value as -1."""
    return values.select("id", F.concat_ws(" ", F.col("id").cast("string"), F.coalesce(F.col(value), F.lit(-1)).cast("string")).alias("line"))


def write_lines(lines: DataFrame, path: str, by: str = "id") -> None:
    """Lines as text files whose names sort in the order of ``by``."""
    lines.repartitionByRange(by).sortWithinPartitions(by).select("line").write.text(path)
