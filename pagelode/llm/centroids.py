"""Clustering around centroids with exact integers and tables of squared differences.

Vectors are turned into integers once and stored in blocks: for each dimension the integers that occur in the
block, and for each vector the place of its integer among them. In a round every block tabulates the squared
difference of each occurring integer to each centroid; a distance is then a sum of table entries, gathered by
place. Blocks sum up counts of occurring integers for each cluster, and Spark sums those of all blocks. The
driver sees ``k`` vectors and ``k`` sums of each dimension, whatever the number of vectors.

Vectors of another length, or with a null, NaN or infinite component, are left out. Integers are limited to
those of a long, as Spark's ``floor`` does. Arithmetic is exact: integers of 2^27 and more go through
Python's integers; a distance or sum that is no long is null. Equal distances go to the smaller number. Vectors
with equal ids are vectors of their own; of equal start keys the smaller vector comes first. A null id is the
empty text in a start key. With fewer than ``k`` vectors there are as many clusters as vectors, without any the
result is empty. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.tables import written

#: Vectors of a block; a place among its integers fits in 16 bits.
BLOCK = 4096
#: Below this, 1024 squared differences of integers sum up to less than a long.
SMALL = 1 << 27

_LONG = (1 << 63) - 1


def kept(vector: Column, dimensions: int) -> Column:
    """Whether a vector counts: of the right length, all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as long integers; beyond these, the nearest long."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    inside = np.abs(scaled) < 2.0 ** 63
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64),
                    np.where(scaled > 0, np.int64(_LONG), np.int64(-_LONG - 1)))


def blocks_of(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """Vectors (id, vector) as blocks: ids, distinct integers by dimension, where those begin, places of vectors."""
    id_type = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("integers", T.BinaryType()),
                           T.StructField("starts", T.BinaryType()), T.StructField("places", T.BinaryType())])

    def block(ids: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
        values = integers(flat.reshape(-1, dimensions), scale)
        found = [np.unique(values[:, d], return_inverse=True) for d in range(dimensions)]
        starts = np.concatenate(([0], np.cumsum([len(u) for u, _ in found]))).astype(np.int64)
        places = np.stack([p for _, p in found]).astype(np.uint16)
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays(
            [listed, *(pa.array([x.tobytes()], pa.binary())
                       for x in (np.concatenate([u for u, _ in found]), starts, places))],
            names=["ids", "integers", "starts", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                whole = pa.Table.from_batches(waiting).combine_chunks()
                full = rows - rows % BLOCK
                yield from made(whole.slice(0, full))
                waiting, rows = whole.slice(full).to_batches(), rows - full
        if rows:
            yield from made(pa.Table.from_batches(waiting).combine_chunks())

    def made(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        for start in range(0, whole.num_rows, BLOCK):
            part = whole.slice(start, BLOCK).combine_chunks()
            yield block(part.column("id").combine_chunks(), part.column("vector").combine_chunks().flatten().to_numpy())

    return vectors.mapInArrow(run, schema)


def tabulated(row_integers: bytes, starts: bytes, places: bytes, centroids: np.ndarray):
    """Distances of a block's vectors to all centroids, with the block's arrays.

    The table has a row for each occurring integer of each dimension and a column for each centroid.
    """
    values = np.frombuffer(row_integers, np.int64)
    begins = np.frombuffer(starts, np.int64)
    at = np.frombuffer(places, np.uint16).reshape(len(begins) - 1, -1)
    dimension = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    if not _is_small(values) or not _is_small(centroids):
        values, centroids = values.astype(object), centroids.astype(object)
    table = (values[:, None] - centroids.T[dimension]) ** 2
    distances = np.zeros((at.shape[1], centroids.shape[0]), dtype=table.dtype)
    for d in range(len(at)):
        distances += table[begins[d] + at[d]]
    return distances, values, begins, at


def _is_small(x: np.ndarray) -> bool:
    return x.dtype != object and (x.size == 0 or (int(x.max()) < SMALL and int(x.min()) > -SMALL))


def cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each non-empty cluster the number of its vectors and the exact sum of each dimension."""
    k, dimensions = centroids.shape
    names = ["cluster", "dimension", "n", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * dimensions for _ in range(k)], np.zeros(k, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                distances, values, begins, at = tabulated(row["integers"], row["starts"], row["places"], centroids)
                # argmin over objects is slow but exact, and takes the first of equal ones as well.
                own = distances.argmin(axis=1).astype(np.int64)
                counts += np.bincount(own, minlength=k)
                for d in range(dimensions):
                    column = values[begins[d]:begins[d + 1]]
                    seen = np.bincount(own * len(column) + at[d], minlength=k * len(column)).reshape(k, -1)
                    for c, total in enumerate(seen.astype(column.dtype).dot(column).tolist()):
                        sums[c][d] += total
        used = np.flatnonzero(counts).tolist()
        flat = [(c, d, int(counts[c]), Decimal(sums[c][d])) for c in used for d in range(dimensions)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(
                zip(*flat) if flat else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))],
            names=names)

    rows = blocks.select("integers", "starts", "places").mapInArrow(
        run, "cluster int, dimension int, n long, total decimal(38,0)").groupBy("cluster", "dimension").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # k * dimensions rows
    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        found.setdefault(r.cluster, (r.n, [0] * dimensions))[1][r.dimension] = int(r.total)
    return found


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Every centroid with vectors at the floor of their mean; the others where they are."""
    new = centroids.copy()
    for c, (n, totals) in sums.items():
        new[c] = [t // n for t in totals]
    return new


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id``, ``cluster`` and ``distance`` of each vector."""
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                distances, *_ = tabulated(row["integers"], row["starts"], row["places"], centroids)
                own = distances.argmin(axis=1)
                least = distances[np.arange(len(own)), own]
                if least.dtype == object:
                    least = [x if x <= _LONG else None for x in least.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(i, 1).flatten(), pa.array(own.astype(np.int32)), pa.array(least, pa.int64())],
                    names=["id", "cluster", "distance"])

    return blocks.mapInArrow(run, schema)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024,
                    seed: int = 3, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row for each vector that counts: its id, ``cluster``, ``distance`` (squared), ``cluster_inertia``,
    ``inertia`` and ``centroid``, the integers of its cluster's centroid.

    The ``k`` vectors with the smallest SHA-256 of seed and id start the clusters.
    """
    wide = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    wide = wide.where(kept(F.col("vector"), dimensions))
    blocks = written(blocks_of(wide, dimensions, scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = wide.orderBy(key, "vector").limit(k).collect()
    centroids = integers(np.array([r.vector for r in first], np.float64).reshape(-1, dimensions), scale)
    empty = F.lit(None).cast("long")
    if not first:
        none = blocks.select(F.explode("ids").alias(id_column))
        return none.select(id_column, empty.cast("int").alias("cluster"), empty.alias("distance"),
                           empty.alias("cluster_inertia"), empty.alias("inertia"), F.array(empty).alias("centroid"))
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(blocks, centroids))
    found = written(assigned(blocks, centroids))
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.when(F.count("distance") == F.count("*"), exact)  # null where a distance is
    totals = {r.cluster: r.total for r in found.groupBy("cluster").agg(whole.alias("total")).collect()}  # k rows
    everything = None if None in totals.values() else sum(int(t) for t in totals.values())

    def long_of(x) -> Column:
        return F.lit(int(x) if x is not None and int(x) <= _LONG else None).cast("long")

    def of_cluster(value) -> Column:
        return F.element_at(F.array(*[value(c) for c in range(len(centroids))]), F.col("cluster") + 1)

    return found.select(
        F.col("id").alias(id_column), "cluster", "distance",
        of_cluster(lambda c: long_of(totals.get(c))).alias("cluster_inertia"), long_of(everything).alias("inertia"),
        of_cluster(lambda c: F.array(*[F.lit(int(x)).cast("long") for x in centroids[c]])).alias("centroid"))
