"""Integer k-means against brute force with Python integers, and its bounds."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from busline.llm import clusters, queries

SF = "/root/testdata/sf0.001"


def brute(rows, k=16, rounds=3):
    kept = [(i, [int(v) * 64 if abs(v) >= 2.0**53 else math.floor(v * 64) for v in x], x) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    named = [(hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(x).tobytes(), v) for i, v, x in kept if i is not None]
    now = [v for _, _, v in sorted(named)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(now))
    for _ in range(rounds):
        own = {}
        for _, v, _ in kept:
            own.setdefault(near(v)[1], []).append(v)
        now = [[sum(p) // len(own[n]) for p in zip(*own[n])] if n in own else c for n, c in enumerate(now)]
    got = [(i, *near(v)) for i, v, _ in kept]
    fits = lambda d: d if d is not None and d < 1 << 63 else None
    of = lambda d: None if any(fits(x) is None for x in d) else fits(sum(d))
    total = of([of([d for _, d, c in got if c == n]) if any(c == n for *_, c in got) else 0 for n in range(len(now))]) if got else None
    return [(i, c, fits(d), of([x for _, x, n in got if n == c]), total, hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, d, c in got]


def shown(out):
    return sorted(map(str, ((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())))


def vectors(n, seed=2):
    rnd = random.Random(seed)
    heads = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [v + rnd.gauss(0, 0.3) for v in rnd.choice(heads)]) for i in range(n)]


ODD = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 65), (1004, [None] + [1.0] * 63), (1005, [math.nan] * 64), (1006, [math.inf] + [0.0] * 63), (1007, [0.0] * 64), (1008, [-0.0] * 64), (1009, [0.0] * 64), (None, [0.5] * 64)]


@pytest.mark.parametrize("more", [[], [(1010, [1e15] * 64), (1011, [-3e200] + [1.0] * 63), (1012, [1.7e308] * 64), (1013, [1.7e308] * 64), (1014, [2.0**21] * 64)]])
def test_against_brute_force(spark, more):
    rows = [*vectors(300), *ODD, *vectors(5), *more]  # rows that stand twice
    df = spark.createDataFrame([(i, x, "x", "y") for i, x in rows], "vec_id bigint, embedding array<double>, cluster string, vector string")
    assert shown(clusters.cluster_vectors(df.repartition(5))) == sorted(map(str, brute(rows)))


def test_few_vectors_and_none(spark):
    rows = vectors(5)
    assert shown(clusters.cluster_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))) == sorted(map(str, brute([(i, np.float32(x).astype(float).tolist()) for i, x in rows])))
    empty = clusters.cluster_vectors(spark.createDataFrame(ODD[:3], "vec_id bigint, embedding array<double>"))
    assert not empty.collect() and set(empty.columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact"}


def test_bounds_hold_and_spare_work(spark):
    x = np.random.default_rng(4).integers(-500, 500, (200, 64)) + np.repeat(np.arange(8), 25)[:, None] * 900
    rows, heads = clusters.Compressed.of(x), clusters.Compressed.of(x[::25])
    exact = ((x[:, None] - x[::25]) ** 2).sum(axis=2)
    assert (rows.lower_bounds(heads) <= exact).all()
    cluster, distance, tried = clusters.nearest(rows, heads)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and tried.mean() < 4


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    out = queries.op11_centroid_clusters(spark, SF)
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(f"SELECT {', '.join(out.columns)} FROM ({clusters.oracle()})").fetchall())
