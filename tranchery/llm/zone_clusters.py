"""Exact k-means over blocks of vectors in Hilbert order, pruned by the blocks' zone maps.

Vectors are put in the order of a Hilbert curve over all their dimensions (Skilling's transform, 2**BITS cells a
dimension, two standard deviations to each side of its mean) and cut into blocks of neighbours.  A block is one row: its
ids, its matrix, the box of its least and greatest components, its sum.  In a round each block compares its box with
the centroids: one that another beats everywhere in the box, by the bounds of their distances, can be nearest to none of
its vectors.  The vectors are compared exactly, by matrix products, with the candidates left; a block with one
candidate adds its stored sum.  Only sums per centroid and task leave a round.

Components are the integers floor(scale * x).  Products are exact: in doubles below 2**52, in 64-bit integers beyond.

Defined cases: vectors that are null, of another length, or with null or non-finite components are left out; a
component of 2**27 or more in size after scaling raises, as a squared distance might not fit a long.  Repeated rows
count as often as they occur; among the seeds ties of the hash go by components.  A null id is kept, and a seed only
where too few others are.  Fewer vectors than centroids give as many centroids as vectors, an empty table an empty one.
Ties of distance go to the smaller number; an empty centroid stays where it is.  Only the id and the vector are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranchery.llm.shared import discard, in_batches, staged

SCALE = 256
BITS = 4
BLOCK = 256
LARGEST = 1 << 27


def valid(df: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """(id, v) of the vectors with exactly ``dims`` components, all of them numbers; as doubles."""
    given = df.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return given.where(F.expr(f"size(v) = {dims} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"))


def scaled(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * scale)
    if values.size and np.abs(values).max() >= LARGEST:
        raise ValueError(f"a component beyond {LARGEST // scale} in size: squared distances might not fit a long")
    return values.astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) with coordinates below 2**bits: dims * bits bits each, as bytes
    whose order is that of the curve."""
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for axis in x:
            turned = (axis >> np.uint32(level)) & np.uint32(1) != 0
            swap = np.where(turned, np.uint32(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1) != 0, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    planes = ((x.T[:, None, :] >> shifts[None, :, None]) & np.uint32(1)).astype(np.uint8)
    return np.packbits(planes.reshape(len(planes), -1), axis=1)


def _moments(vectors: DataFrame, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and standard deviation of each scaled component; None where there is no vector."""

    def run(batches):
        n, s, s2 = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = scaled(batch.column("v"), dims, scale).astype(float)
            n, s, s2 = n + len(x), s + x.sum(0), s2 + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([s2.tolist()])], ["n", "s", "s2"])

    parts = in_batches(vectors.select("v")).mapInArrow(run, "n long, s array<double>, s2 array<double>")
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("s", "s2") for i in range(dims)]
    row = parts.agg(F.sum("n").alias("n"), *sums).first()
    if not row["n"]:
        return None
    mean = np.array(row[1 : dims + 1]) / row["n"]
    spread = np.sqrt(np.maximum(np.array(row[dims + 1 :]) / row["n"] - mean * mean, 0))
    return mean, np.where(spread > 0, spread, 1.0)


_BLOCK = "ids array<long>, x binary, width int, low binary, high binary, total binary"


def blocks(vectors: DataFrame, dims: int, scale: int = SCALE, bits: int = BITS, size: int = BLOCK) -> DataFrame | None:
    """One row per block of ``size`` neighbours on the curve (_BLOCK), staged; None without vectors."""
    known = _moments(vectors, dims, scale)
    if known is None:
        return None
    mean, spread = known

    def keyed(batches):
        for batch in batches:
            x = scaled(batch.column("v"), dims, scale)
            cells = np.clip(np.floor(((x - mean) / spread + 2) * (1 << bits) / 4), 0, (1 << bits) - 1)
            keys = hilbert_keys(cells, bits)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary())], ["id", "key", "x"])

    def cut(batches):
        left: list = []
        for batch in batches:
            have = pa.Table.from_batches([*left, batch])
            whole = have.num_rows // size * size
            for i in range(0, whole, size):
                yield _block(have.slice(i, size), dims)
            left = have.slice(whole).combine_chunks().to_batches() if whole < have.num_rows else []
        if left:
            yield _block(pa.Table.from_batches(left), dims)

    rows = in_batches(vectors).mapInArrow(keyed, "id long, key binary, x binary")
    placed = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id").select("id", "x")
    return staged(placed.mapInArrow(cut, _BLOCK), "vector-blocks")


def _block(rows: pa.Table, dims: int) -> pa.RecordBatch:
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
    low, high = x.min(0), x.max(0)
    width = 2 if max(-low.min(), high.max()) < 1 << 15 else 4
    bytes_ = [x.astype(f"<i{width}").tobytes(), low.tobytes(), high.tobytes(), x.sum(0).tobytes()]
    ids = rows.column("id").combine_chunks()
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b], pa.binary()) for b in bytes_)]
    return pa.RecordBatch.from_arrays([*arrays[:2], pa.array([width], pa.int32()), *arrays[2:]], ["ids", "x", "width", "low", "high", "total"])


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box, ascending.

    First by distances: the least one to the box against the greatest of any other.  Then against the centroid nearest
    to the middle: the difference of two squared distances is linear, so its bound over the box is exact."""
    under, over = low - centroids, centroids - high
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(1)
    most = (np.maximum(np.abs(centroids - low), np.abs(over)) ** 2).sum(1)
    some = np.flatnonzero(least <= most.min())
    left = centroids[some]
    middle = left[((left - (low + high) // 2) ** 2).sum(1).argmin()]
    apart = 2 * (left - middle)
    most_nearer = np.maximum(apart * low, apart * high).sum(1) + (middle**2).sum() - (left**2).sum(1)
    return some[most_nearer >= 0]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``centroids``, squared distance) of the nearest one of each row, the first where several are."""
    span = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if x.shape[1] * span * span < 1 << 52:
        f, c = x.astype(float), centroids.astype(float)
        away = ((f * f).sum(1)[:, None] - 2 * (f @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        away = np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    at = away.argmin(1)
    return at, away[np.arange(len(x)), at]


def _rows_of(batch: pa.RecordBatch, dims: int):
    """(box low, box high, sum, n, a function that gives the matrix) of each block of a batch."""
    width, x = batch.column("width").to_pylist(), batch.column("x")
    ints = lambda name, i: np.frombuffer(batch.column(name)[i].as_buffer(), np.int64)
    for i in range(batch.num_rows):
        matrix = lambda i=i: np.frombuffer(x[i].as_buffer(), f"<i{width[i]}").reshape(-1, dims).astype(np.int64)
        yield ints("low", i), ints("high", i), ints("total", i), len(x[i].as_buffer()) // (width[i] * dims), matrix


def _moved(given: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of what is nearest to each."""
    k, dims = centroids.shape

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for low, high, total, rows, matrix in _rows_of(batch, dims):
                some = candidates(low, high, centroids)
                if len(some) == 1:
                    n[some] += rows
                    sums[some] += total
                    continue
                x = matrix()
                at = some[nearest(x, centroids[some])[0]]
                n += np.bincount(at, minlength=k)
                np.add.at(sums, at, x)
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(n[have]), pa.array(sums[have].tolist(), pa.list_(pa.int64()))], ["c", "n", "s"])

    parts = in_batches(given.select("x", "width", "low", "high", "total")).mapInArrow(run, "c int, n long, s array<long>")
    out = centroids.copy()
    # sums as decimals: those of very many vectors may pass a long; whole floors are taken of Python's integers
    for row in parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(20,0)")) for i in range(dims)]).collect():
        out[row["c"]] = [int(s) // row["n"] for s in row[2:]]
    return out


def _assigned(given: DataFrame, centroids: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches):
        for batch in batches:
            cluster, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high, _, _, matrix in _rows_of(batch, dims):
                some = candidates(low, high, centroids)
                at, away = nearest(matrix(), centroids[some])
                cluster.append(some[at])
                distance.append(away)
            yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), pa.array(np.concatenate(cluster), pa.int32()), pa.array(np.concatenate(distance))], ["id", "cluster", "distance"])

    return in_batches(given).mapInArrow(run, "id long, cluster int, distance long")


def seeds(vectors: DataFrame, k: int, salt: str, dims: int, scale: int) -> np.ndarray:
    """The scaled vectors with the least SHA-256 of ``salt:id``, ascending."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("id", "v", order.alias("hash")).orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()
    return np.floor(np.array([r["v"] for r in rows]).reshape(len(rows), dims) * scale).astype(np.int64)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2", scale: int = SCALE, size: int = BLOCK, bits: int = BITS, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(assignment, centroids): id, ``cluster`` and squared ``distance`` of every valid vector, staged, after ``rounds``
    rounds, and the final centroids (k rows of integers at most)."""
    vectors = valid(df, vec_id, vector, dims)
    given = blocks(vectors, dims, scale, bits, size)
    if given is None:
        empty = df.sparkSession.createDataFrame([], f"{vec_id} long, cluster int, distance long")
        return empty, np.zeros((0, dims), np.int64)
    centroids = seeds(vectors, k, salt, dims, scale)
    for _ in range(rounds):
        centroids = _moved(given, centroids)
    out = staged(_assigned(given, centroids), "assigned")
    discard(given)
    return out.withColumnRenamed("id", vec_id), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of its cluster (k rows, broadcast)."""
    spark = assigned.sparkSession
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    total = sum(r["s"] for r in sums)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    rows = [(r["cluster"], r["s"], total, digest(r["cluster"])) for r in sums]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(*assigned.columns, "cluster_inertia", "inertia", "centroid_sha256")
