"""Centroid clustering in integers, with block norms that screen centroids before exact distances."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import bounded_batches, materialized

DIM, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Components of a segment, whose norm stands for them in the compressed vector.
SEGMENT = 8
#: Components beyond this leave 64-bit arithmetic: DIM * (2 * SMALL) ** 2 stays below 2 ** 63.
SMALL = 1 << 27
#: Bits of a limb, in which sums of components of any size are carried.
LIMB = 30
#: What floating point may take from a lower bound, as a share of the squared norms.
SLACK = 1e-9


def quantised(x: np.ndarray, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of finite doubles and floor(scale * x) of them: as 64-bit integers, and rows of large components apart, as
    Python integers. The scale is a power of two, so that products are exact."""
    small = np.abs(x).max(axis=1, initial=0) < SMALL / scale
    if small.any():
        yield np.flatnonzero(small), np.floor(x[small] * scale).astype(np.int64)
    if not small.all():
        # A double of 2 ** 53 or more is an integer.
        whole = lambda v: int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale)
        yield np.flatnonzero(~small), np.array([[whole(v) for v in row] for row in x[~small].tolist()], object)


def _real(v: int) -> float:
    return float(v) if abs(v) < 1 << 1000 else math.inf


@dataclass
class Compressed:
    """Integer vectors with the norms of their segments and their squared norms, from which bounds are made."""

    exact: np.ndarray
    blocks: np.ndarray
    square: np.ndarray

    @classmethod
    def of(cls, exact: np.ndarray, segment: int = SEGMENT) -> Compressed:
        real = exact.astype(np.float64) if exact.dtype != object else np.array([[_real(v) for v in row] for row in exact.tolist()])
        with np.errstate(over="ignore"):
            squares = np.add.reduceat(real * real, np.arange(0, real.shape[1], segment), axis=1)
        return cls(exact, np.sqrt(squares), squares.sum(axis=1))

    def lower_bounds(self, other: Compressed) -> np.ndarray:
        """Lower bounds of the squared distances of all vectors to all of other: |x|^2 + |c|^2 less twice the product of the
        segment norms, which by Cauchy and Schwarz is no less than the inner product."""
        with np.errstate(over="ignore", invalid="ignore"):
            both = self.square[:, None] + other.square
            bounds = both - 2 * (self.blocks @ other.blocks.T) - SLACK * both - 1
        return np.where(np.isnan(bounds), -np.inf, bounds)  # beyond what doubles hold nothing is known


def nearest(rows: Compressed, centroids: Compressed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the number of the nearest centroid (the smaller of equals), the exact squared distance, and how many centroids
    needed one: centroids are tried in the order of their bounds until a bound exceeds the best distance."""
    n, bounds = len(rows.exact), rows.lower_bounds(centroids)
    order = np.argsort(bounds, axis=1, kind="stable")
    wide = rows.exact.dtype == object or centroids.exact.dtype == object
    best = np.full(n, 1 << 4096 if wide else np.iinfo(np.int64).max, object if wide else np.int64)
    cluster, tried, live = np.full(n, len(centroids.exact)), np.zeros(n, np.int64), np.arange(n)
    for k in range(order.shape[1]):
        c = order[live, k]
        if k:
            # A Python float is compared with a Python integer exactly.
            near = np.array([b <= d for b, d in zip(bounds[live, c].tolist(), best[live].tolist())], bool) if wide else bounds[live, c] <= best[live]
            live, c = live[near], c[near]
        if not len(live):
            break
        gap = rows.exact[live] - centroids.exact[c]
        d = (gap * gap).sum(axis=1)
        tried[live] += 1
        better = (d < best[live]) | ((d == best[live]) & (c < cluster[live]))
        best[live[better]], cluster[live[better]] = d[better], c[better]
    return cluster, best, tried


def _rows(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, Compressed]]:
    """Places in a batch of (id, vector, blocks, square) and its rows; large ones apart."""
    if not len(batch):
        return
    column = lambda k: np.frombuffer(b"".join(batch.column(k).to_pylist()), np.float64).reshape(len(batch), -1)
    blocks, square = column(2), batch.column(3).to_numpy()
    for at, exact in quantised(column(1), scale):
        yield at, Compressed(exact, blocks[at], square[at])


def _compressed(vectors: DataFrame, dim: int, segment: int, scale: int) -> DataFrame:
    """vec_id, vector (doubles), blocks (norms of its segments), square of the vectors that are kept."""
    bounded_batches(vectors.sparkSession, 8192)
    kept = F.coalesce((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), dim)
            for at, exact in quantised(x, scale):
                c = Compressed.of(exact, segment)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in x[at]], pa.binary()), pa.array([r.tobytes() for r in c.blocks], pa.binary()), pa.array(c.square)], names=["vec_id", "vector", "blocks", "square"])

    read = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v")).where(kept)
    return read.mapInArrow(run, "vec_id bigint, vector binary, blocks binary, square double")


def _sums(table: DataFrame, centroids: Compressed, dim: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Of each non-empty cluster the number of its vectors and their summed components, exact: tasks sum limbs, Spark sums tasks.

    What comes to the driver is a row a cluster, component and limb, whatever the number of vectors.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.exact)
        count, small, large = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros((k, dim), object)
        out: dict[tuple[int, int, int], int] = {}

        def put(total: np.ndarray) -> None:
            for c, p in np.argwhere(total != 0).tolist():
                left, limb = int(total[c, p]), 0
                while left:
                    digit = (abs(left) & ((1 << LIMB) - 1)) * (1 if left > 0 else -1)
                    out[c, p, limb] = out.get((c, p, limb), 0) + digit
                    left, limb = (left - digit) // (1 << LIMB), limb + 1

        held = 0
        for batch in batches:
            for _, rows in _rows(batch, scale):
                cluster, _, _ = nearest(rows, centroids)
                count += np.bincount(cluster, minlength=k)
                if rows.exact.dtype == object:
                    np.add.at(large, cluster, rows.exact)
                    continue
                if held + len(cluster) > 1 << 34:
                    put(small)
                    small, held = np.zeros((k, dim), np.int64), 0
                held += len(cluster)
                order = np.argsort(cluster, kind="stable")
                begin = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                small[cluster[order][begin]] += np.add.reduceat(rows.exact[order], begin, axis=0)
        put(small)
        put(large)
        for c in np.flatnonzero(count).tolist():
            out[c, -1, 0] = int(count[c])
        keys = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in keys], pa.int32()) for i in range(3)] + [pa.array([out[x] for x in keys], pa.int64())], names=["cluster", "place", "limb", "n"])

    parts = table.mapInArrow(run, "cluster int, place int, limb int, n bigint")
    found: dict[int, tuple[int, list[int]]] = {}
    for c, p, limb, n in parts.groupBy("cluster", "place", "limb").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        count, sums = found.get(c, (0, [0] * dim))
        if p < 0:
            count = int(n)
        else:
            sums[p] += int(n) << (LIMB * limb)
        found[c] = count, sums
    return found


def _centroids(rows: list[list[int]], segment: int) -> Compressed:
    small = all(abs(v) < SMALL for r in rows for v in r)
    return Compressed.of(np.array(rows, np.int64 if small else object).reshape(len(rows), -1), segment)


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact: k-means in integers floor(scale * x).

    Centroids start as the k vectors of smallest SHA-256 of "1:<vec_id>". Each of `rounds` rounds assigns every vector to the
    nearest centroid (ties: the smaller number) and replaces every centroid that has vectors by the floor of their mean; then vectors
    are assigned once more. Each vector is stored with the norms of its segments; by Cauchy and Schwarz these
    give lower bounds of its distances, and only centroids whose bound doesn't exceed the best distance found get an exact
    one (n_exact says how many). A round is one pass without a shuffle of vectors: tasks sum components, and a
    row a cluster, component and limb comes to the driver, however many vectors there are.

    Vectors of another length than dim, or null, or with null or non-finite components are left out. Components may be of any size:
    large ones are handled as Python integers, and a distance or inertia beyond 64 bits is null. Rows that share a vec_id are
    vectors of their own, the smaller components first where one begins as a centroid; rows with a null vec_id are clustered but never begin as one. Fewer than k
    vectors make as many centroids. An empty table gives no rows. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    table = materialized(_compressed(vectors, dim, segment, scale), "compressed")
    seeds = table.where("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    starts = seeds.orderBy("h", "vector").select("vector").limit(k).collect()
    now = [[int(v) for v in next(quantised(np.frombuffer(r.vector, np.float64).reshape(1, -1), scale))[1][0]] for r in starts]
    schema = "vec_id bigint, cluster int, distance bigint, n_exact int"
    if not now:
        return spark.createDataFrame([], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        for c, (n, sums) in _sums(table, _centroids(now, segment), dim, scale).items():
            now[c] = [s // n for s in sums]
    final = _centroids(now, segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _rows(batch, scale):
                cluster, distance, tried = nearest(rows, final)
                fits = [int(d) if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cluster, pa.int32()), pa.array(fits, pa.int64()), pa.array(tried, pa.int32())], names=["vec_id", "cluster", "distance", "n_exact"])

    assigned = materialized(table.mapInArrow(run, schema), "assigned")
    whole = lambda c: F.when(F.count("*") == F.count(c), F.sum(F.col(c).cast("decimal(38,0)")))  # noqa: E731  null if a part is beyond 64 bits
    inertia = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(whole("distance").alias("d")).collect()}  # a row a centroid
    fits = lambda d: int(d) if d is not None and d < 1 << 63 else None
    total = fits(None if None in inertia.values() else sum(inertia.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    ends = spark.createDataFrame([(c, fits(inertia.get(c)), total, digest[c]) for c in range(len(now))], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "n_exact", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same in SQL, with one common table a step."""
    steps = [f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, unnest(range({DIM})) AS i, unnest(v) AS x FROM kept),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""q{n} AS (SELECT c, unnest(range({DIM})) AS i, unnest(v) AS y FROM c{n}),
d{n} AS (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM p JOIN q{n} USING (i) GROUP BY r, c),
a{n} AS (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{n} JOIN p USING (r) GROUP BY c, i),
m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{n} GROUP BY c),
c{n + 1} AS (SELECT c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(list_aggregate(c{rounds}.v, 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)"""
