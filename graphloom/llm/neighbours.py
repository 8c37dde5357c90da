"""Approximate nearest neighbours by cross-polytope hashing (operator 9).

A vector's bucket in a table is the signed axis nearest to its pseudo-rotation
(three rounds of random signs and a fast Hadamard transform). Inner product
becomes angle by one more coordinate: data vectors are scaled by the largest
norm of their band and completed to unit length, queries get a zero there; for
vectors of one length that changes nothing. A band holds norms within a factor of
``_BAND`` and has its own buckets, so that an outlier's norm doesn't turn all others
towards the added coordinate. The index holds every vector once a table; a query
probes, in every band and table, the ``probes`` axes nearest to its own rotation.
Found candidates are reranked by the exact inner product in double precision.
A query whose probes find fewer than ``k`` is scored against all vectors of its length.

Work is cut into blocks of a (table, bucket): ``block`` rows and ``BLOCK_BYTES`` bound
the vectors and the queries that meet in a task at any size of table, so a bucket holding a third of all vectors is just
more blocks. Nothing is capped: every vector of a probed bucket is scored, and
a block returns its ``k`` best for each query with ties by vec_id.

With one hash a table a query sees a fixed share of the vectors (about
``tables * probes / (2 * padded dimension)``, less overlaps): that is what high
recall costs on vectors that are nearly random, as measured in the README.
Fewer probes buy speed on clustered data.

Cases: vectors that are null, zero or hold null or non-finite components take no
part, neither as query nor as candidate; vectors only meet vectors of their own
length; a query with fewer candidates than k gets all of them; rows of a query's
own vec_id are the query's own row, and so no candidates of it; rows that repeat
another vec_id are candidates once per distinct score; finite vectors of any length
take part, and a product beyond a double is infinite; a table without usable vectors
gives no rows; unknown columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written

TABLES = 8
PROBES = 32
#: Rows of a block's side at most, and their bytes (in doubles): what a task holds doesn't grow with the table.
BLOCK = 2048
BLOCK_BYTES = 16 << 20
_SLICE = 256
#: Ratio of the norms of a band; bands are counted from the largest norm of a length of vector.
_BAND = 2**0.5


def padded(dim: int) -> int:
    return 1 << dim.bit_length()


@lru_cache(maxsize=256)
def _signs(size: int, table: int) -> np.ndarray:
    return np.random.default_rng([size, table, 7]).choice([-1.0, 1.0], (3, size))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def rotated(unit: np.ndarray, table: int) -> np.ndarray:
    for signs in _signs(unit.shape[1], table):
        unit = _hadamard(unit * signs)
    return unit


def axes(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first; axis j and j + size are opposite."""
    y = rotated(unit, table)
    y = np.concatenate([y, -y], axis=1)
    if probes == 1:
        return y.argmax(axis=1)[:, None]
    probes = min(probes, y.shape[1])
    best = np.argpartition(-y, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(y, best, 1), axis=1, kind="stable"), 1)


def _completed(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    """Unit vectors of one more coordinate; ``largest`` is log2 of the norm that data vectors are scaled by."""
    out = np.zeros((len(x), padded(x.shape[1])))
    if query:
        # by the largest component first: squares can't over- or underflow then
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    else:
        whole = math.floor(largest)
        scaled = np.ldexp(x, -whole) / 2.0 ** (largest - whole)
        out[:, : x.shape[1]] = scaled
        out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
    return out


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, dim, norm) of the vectors that take part; norm is log2 of the length, which no finite vector exceeds a double by."""
    v = F.col(vector).cast("array<double>")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))
    return (
        vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"))
        .where("id is not null and v is not null and size(v) > 0")
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .withColumn("most", F.array_max(F.transform("v", lambda x: F.abs(x))))
        .where("most > 0")
        .select("id", "v", F.size("v").alias("dim"), (F.log2("most") + F.log2(squares) / 2).alias("norm"))
    )


def band_of(norm: np.ndarray, largest: float) -> np.ndarray:
    """Which band a norm is in (both as log2): 0 holds the largest norm of its length of vector."""
    return np.maximum(0, np.floor((largest - norm) / np.log2(_BAND) + 1e-6)).astype(np.int32)


def _banded(base: DataFrame, norms: dict[int, float]) -> DataFrame:
    """``base`` with the band of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, norm = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            band = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at = dims == dim
                band[at] = band_of(norm[at], norms[int(dim)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band, pa.int32())], ["id", "v", "dim", "norm", "band"])

    return base.select("id", "v", "dim", "norm").mapInArrow(run, "id long, v array<double>, dim int, norm double, band int")


def _buckets(rows: DataFrame, norms: dict[tuple[int, int], float], tables: int, probes: int, query: bool) -> DataFrame:
    """(dim, band, hash table, bucket, id, v) of each vector and table (and probe); queries have one band for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, bands = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
            for dim, band in np.unique(np.stack([dims, bands], axis=1), axis=0).tolist():
                at = np.flatnonzero((dims == dim) & (bands == band))
                part = batch.column(1).take(pa.array(at))
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                unit = _completed(x, norms.get((dim, band), 0.0), query)
                for table in range(tables):
                    found = axes(unit, table, probes)
                    each = np.repeat(np.arange(len(at)), found.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(each), dim), pa.int32()),
                            pa.array(np.full(len(each), band), pa.int32()),
                            pa.array(np.full(len(each), table), pa.int32()),
                            pa.array(found.ravel(), pa.int32()),
                            pa.array(ids[at][each], pa.int64()),
                            part.take(pa.array(each)),
                        ],
                        ["dim", "band", "hash_table", "bucket", "id", "v"],
                    )

    return rows.select("id", "v", "dim", "band").mapInArrow(run, "dim int, band int, hash_table int, bucket int, id long, v array<double>")


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    q_ids, v_ids = queries["id"].to_numpy(), vectors["id"].to_numpy()
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], np.stack(vectors["v"].to_numpy())[order]
    # how far a fast product can be off; what lies so close to a query's k-th best is scored exactly
    off = 1e-15 * v.shape[1] ** 2 * np.abs(v).max()
    with np.errstate(over="ignore", invalid="ignore"):
        for start in range(0, len(q_ids), _SLICE):
            ids, q = q_ids[start : start + _SLICE], np.stack(queries["v"].to_numpy()[start : start + _SLICE])
            other = ids[:, None] != v_ids[None, :]
            fast = q @ v.T
            # overflows of both signs cancel to no number: last of all
            fast[np.isnan(fast) | ~other] = -np.inf
            floor = np.full(len(ids), -np.inf)
            if len(v_ids) > k:
                floor = np.partition(fast, len(v_ids) - k, axis=1)[:, len(v_ids) - k] - off * np.abs(q).max(axis=1)
                floor = np.where(np.isnan(floor), -np.inf, floor)
            rows, cols = np.nonzero((fast >= floor[:, None]) & other)
            # one fixed order of additions for a pair, wherever it is met
            exact = (q[rows] * v[cols]).sum(axis=1)
            exact[np.isnan(exact)] = -np.inf
            order = np.lexsort((v_ids[cols], -exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = place < k
            yield pd.DataFrame({"query_id": ids[rows[kept]], "vec_id": v_ids[cols[kept]], "score": exact[kept]})


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    tables: int = TABLES,
    probes: int = PROBES,
    block: int = BLOCK,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries`` among ``vectors``."""
    spark = vectors.sparkSession
    base, asked = usable(vectors, key, vector), usable(queries, key, vector)
    # one row a length of vector
    norms = {r["dim"]: float(r["m"]) for r in base.groupBy("dim").agg(F.max("norm").alias("m")).collect()}
    if not norms:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.where(F.col("dim").isin(list(norms)))
    banded = _banded(base, norms)
    # one row a band of norms
    largest = {(r["dim"], r["band"]): float(r["m"]) for r in banded.groupBy("dim", "band").agg(F.max("norm").alias("m")).collect()}
    index = _buckets(banded, largest, tables, 1, query=False)
    probed = _buckets(asked.withColumn("band", F.lit(0)), {}, tables, probes, query=True).drop("band")
    found = _ranked(_meeting(index, probed, ["dim", "hash_table", "bucket"], ["band"], k, block), k)
    found = written(found, "neighbours")
    # probes may see fewer than k where there are more: such queries meet all vectors of their length
    full = found.groupBy("query_id", "dim").agg(F.count("*").alias("found")).where(F.col("found") >= k)
    short = asked.join(full.select(F.col("query_id").alias("id"), "dim"), ["id", "dim"], "left_anti").select("id", "v", "dim")
    short = written(short, "short")
    if not short.isEmpty():
        found = found.drop("rank").union(_meeting(base.select("dim", "id", "v"), short, ["dim"], [], k, block))
    return _ranked(found.drop("dim", "rank"), k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query (and length of vector); a pair met in several cells has one score, so its rows share one dense rank."""
    of = [c for c in ("query_id", "dim") if c in found.columns]
    best = Window.partitionBy(*of).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k).distinct()


def _meeting(index: DataFrame, probed: DataFrame, place: list[str], more: list[str], k: int, block: int) -> DataFrame:
    """(query_id, dim, vec_id, score): the k best of each query in each block of a place; ``more`` parts only the index."""
    spark = index.sparkSession
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    # as many rows as places: sizes of buckets, never rows
    slots = index.groupBy(*place, *more).agg(F.ceil(F.count("*") / size).cast("int").alias("slots"))
    asked = probed.groupBy(*place).agg(F.ceil(F.count("*") / size).cast("int").alias("rows"))
    layout = slots.join(asked, place).select(*place, *more, "slots", "rows")
    layout = F.broadcast(spark.createDataFrame(layout.collect(), layout.schema))
    cell = [*place, *more, "slot", "row"]
    stored = index.join(layout, place + more).select(
        *place, *more, "id", "v", F.pmod(F.xxhash64("id"), F.col("slots").cast("long")).alias("slot"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")
    )
    sought = probed.join(layout, place).select(
        *place, *more, "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots").cast("long") - 1)).alias("slot"), F.pmod(F.xxhash64("id"), F.col("rows")).cast("int").alias("row")
    )

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "dim": pd.Series(dtype="int32"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        out = pd.concat(list(_best(q, v, k)))
        out.insert(1, "dim", q["dim"].iloc[0])
        return out

    return sought.groupBy(*cell).cogroup(stored.groupBy(*cell)).applyInPandas(meet, "query_id long, dim int, vec_id long, score double")
