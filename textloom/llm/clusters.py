"""Centroid clustering of integer vectors by bit planes.

A vector of 64 whole numbers is as many 64-bit words as its numbers have
bits in two's complement: word b holds bit b of every component. The dot
product of two vectors is the sum, over pairs of planes, of how many bits both
have, weighted by the planes' values, so distances are exact. Sums of vectors
are counts of bits by plane, which tasks add up before anything is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, read

#: Components of a vector, one for each bit of a plane.
SIZE = 64
#: Centroids, rounds, factor of the components, and what is put before an id to draw the first centroids.
CENTROIDS, ROUNDS, FACTOR, SALT = 40, 5, 256, "2:"
#: Vectors that are compared with the centroids at once.
BLOCK = 2048
LONG = (1 << 63) - 1


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(FACTOR * x) of doubles; Python numbers where one of a vector's is too large for 61 bits."""
    if not vectors.size or np.abs(vectors).max() < 2.0**52:
        return np.floor(vectors * FACTOR).astype(np.int64)
    # from 2**52 on, doubles are whole numbers
    return np.array([[int(x) * FACTOR if abs(x) >= 2.0**52 else math.floor(x * FACTOR) for x in v] for v in vectors.tolist()], object)


def planes_of(numbers: np.ndarray) -> np.ndarray:
    """Rows of uint64 planes; the last has the negative weight, and all rows the width of the widest."""
    width = max((int(x) if x >= 0 else ~int(x)).bit_length() for x in (numbers.min(), numbers.max())) + 1
    out = np.empty((len(numbers), width), np.uint64)
    for b in range(width):
        bits = ((numbers >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _weights(width: int) -> list[int]:
    return [1 << b for b in range(width - 1)] + [-(1 << (width - 1))]


def dot_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products of all rows of planes ``x`` with all of ``c``."""
    # 64 products below 2**(a + b - 2); sums of a few of them must fit too
    wide = x.shape[1] + c.shape[1] > 52
    total = np.zeros((len(x), len(c)), object if wide else np.int64)
    for i, wi in enumerate(_weights(x.shape[1])):
        part = np.zeros(total.shape, object if wide else np.int32 if c.shape[1] <= 24 else np.int64)
        for j, wj in enumerate(_weights(c.shape[1])):
            part += np.bitwise_count(x[:, i, None] & c[None, :, j]).astype(part.dtype) * wj
        total += part.astype(total.dtype) * wi
    return total


def square_norms(x: np.ndarray) -> np.ndarray:
    """Exact dot product of each row of planes with itself."""
    wide = 2 * x.shape[1] > 52
    total = np.zeros(len(x), object if wide else np.int64)
    weights = _weights(x.shape[1])
    for i, wi in enumerate(weights):
        for j, wj in enumerate(weights[i:], i):
            total += np.bitwise_count(x[:, i] & x[:, j]).astype(total.dtype) * (wi * wj * (1 if i == j else 2))
    return total


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of the centroids ``c`` to each row of planes, the first of equally near ones, and the squared distance."""
    own = square_norms(c)
    cluster, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(x), BLOCK):
        part = x[s : s + BLOCK]
        # without the vector's own norm, which all its distances share
        apart = own[None, :] - 2 * dot_products(part, c)
        best = apart.argmin(axis=1)
        cluster.append(best.astype(np.int64))
        distance.append(apart[np.arange(len(part)), best] + square_norms(part))
    return np.concatenate(cluster), np.concatenate(distance)


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of the vectors of each width in a list column."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    widths = np.diff(offsets)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, values[offsets[at][:, None] + np.arange(width)]


def _usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where((F.size("embedding") == SIZE) & ~bad)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def pack(vectors: DataFrame) -> DataFrame:
    """``vec_id, planes`` of the vectors of 64 finite components in ``vec_id, embedding``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, SIZE)
            # few numbers need more than 61 bits; they do not make the others wide
            large = np.abs(x).max(axis=1, initial=0) >= 2.0**19
            for at in (np.flatnonzero(~large), *np.flatnonzero(large)[:, None]):
                if len(at):
                    planes = planes_of(whole_numbers(x[at]))
                    width = planes.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, planes.size + 1, width, dtype=np.int32)), pa.array(planes.reshape(-1).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), lists], names=["vec_id", "planes"])

    return _usable(vectors).mapInArrow(go, "vec_id long, planes array<long>")


def _sums(packed: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Size of each cluster that is not empty and the sum of its vectors' components.

    A task hands on one row of bit counts for each cluster and plane.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        sizes = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, planes in _groups(batch.column(0)):
                cluster, _ = nearest(planes, centroids)
                sizes += np.bincount(cluster, minlength=len(centroids))
                order = np.argsort(cluster, kind="stable")
                present, first = np.unique(cluster[order], return_index=True)
                width = planes.shape[1]
                for b in range(width):
                    bits = np.unpackbits(np.ascontiguousarray(planes[order, b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    sign = -1 if b == width - 1 else 1
                    for k, n in zip(present, np.add.reduceat(bits, first, axis=0, dtype=np.int64) * sign, strict=True):
                        held = counts.setdefault((int(k), b), np.zeros(SIZE, np.int64))
                        held += n
        rows = [(k, b, n, int(sizes[k]) if b == 0 else 0) for (k, b), n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["cluster", "plane", "counts", "n"])

    parts = packed.select("planes").mapInArrow(go, "cluster int, plane int, counts array<long>, n long")
    added = parts.groupBy("cluster", "plane").agg(F.array(*(F.sum(F.col("counts")[i]) for i in range(SIZE))).alias("counts"), F.sum("n").alias("n"))
    out: dict[int, tuple[int, list[int]]] = {}
    # clusters times planes
    for r in added.collect():
        n, sums = out.get(r["cluster"], (0, [0] * SIZE))
        out[r["cluster"]] = n + r["n"], [s + (c << r["plane"]) for s, c in zip(sums, r["counts"], strict=True)]
    return out


def cluster(vectors: DataFrame, scratch: Scratch, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of 64 finite components.

    Components are floor(256 * x). The first centroids are the ``k`` vectors
    of least SHA-256 of ``salt`` and id (of equal ones, by their components), or
    all if fewer; a null id counts as empty there. Repeated ids and equal
    vectors are vectors each. Every round assigns all vectors, the first of
    equally near centroids winning, and moves each centroid to the floor of
    its vectors' mean; one without vectors stays. Arithmetic is exact at any
    size; a distance or sum beyond a long is null. Other vectors and other
    columns are left out, no vectors give no rows.
    """
    packed = scratch.save(pack(vectors), "planes")
    drawn = _usable(vectors).orderBy(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "embedding").limit(k).collect()

    def matrix(rows: list[list[int]]) -> np.ndarray:
        fits = all(-LONG <= x <= LONG for row in rows for x in row)
        return planes_of(np.array(rows, np.int64 if fits else object))

    centroids = [whole_numbers(np.array([r["embedding"]])).tolist()[0] for r in drawn]
    for _ in range(rounds if centroids else 0):
        for number, (n, sums) in _sums(packed, matrix(centroids)).items():
            centroids[number] = [s // n for s in sums]
    final = matrix(centroids) if centroids else np.zeros((0, 1), np.uint64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, planes in _groups(batch.column(1)):
                number, distance = nearest(planes, final)
                far = [d if d <= LONG else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(number, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = scratch.save(packed.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("unknown")).collect()
    sums = {r["cluster"]: None if r["unknown"] else int(r["s"]) for r in totals}
    total = None if None in sums.values() else sum(sums.values())

    def stored(n: int | None) -> int | None:
        return n if n is not None and n <= LONG else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = [(number, stored(n), stored(total), digests[number]) for number, n in sums.items()]
    per_cluster = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row for each centroid
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 40 clusters after 5 rounds."""
    return cluster(read(spark, sf_dir, "embeddings"), Scratch(spark, "op13"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> str:
    """The rounds one by one, in whole numbers; rows are told apart by number, ids may repeat."""
    steps = [f"""v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{salt}' || coalesce(CAST(vec_id AS VARCHAR), '')), x) AS row, e FROM (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {FACTOR}) AS BIGINT)) AS e FROM embeddings
    WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), c0 AS MATERIALIZED (SELECT row - 1 AS c, e FROM v WHERE row <= {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT row, c, list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (v.e[i] - z.e[i]) * (v.e[i] - z.e[i]))) AS d FROM v, c{i} z
), a{i} AS MATERIALIZED (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY row)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(1, {SIZE + 1})) AS i FROM a{i} JOIN v USING (row)) GROUP BY c, i
), m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{i} GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.e, z.e) AS e FROM c{i} z LEFT JOIN m{i} m USING (c))""")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (row) JOIN c{rounds} z USING (c)"""


OP13_SQL = _sql()
