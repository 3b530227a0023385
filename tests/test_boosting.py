"""Softmax boosting against a plain second-order booster, over partitions, missing values and engines."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from busline.operators import boosting
from busline.plans import models
from busline.plans import queries as q

SF, NAMES = "/root/testdata/sf0.001", ["a", "b", "c"]
SCHEMA = "id int, a double, b double, c double, y int"


def table(n=400, seed=3):
    """Few distinct values, so that every value is a threshold; some missing; four classes."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        a, b, c = (rnd.choice([None, float("nan"), float("inf")]) if rnd.random() < 0.08 else rnd.randrange(20) / 4 for _ in NAMES)
        right = (a is not None and a > 2) + 2 * (b is not None and b > 3)
        out.append((i, a, b, c, right if rnd.random() < 0.9 else rnd.randrange(4)))
    return out


def value(x):
    """Null goes where NaN and infinity go: right of all thresholds."""
    return math.inf if x is None or math.isnan(x) else x


def plain(rows, rounds, depth, eta=0.3, l2=1.0, least=1.0):
    """Probabilities by row from trees that try each value of each feature as a threshold, node by node."""
    x = [[value(v) for v in r[1:4]] for r in rows]
    m = [[0.0] * 4 for _ in rows]

    def soft(v):
        e = [math.exp(a - max(v)) for a in v]
        return [a / sum(e) for a in e]

    for _ in range(rounds):
        p, steps = [soft(v) for v in m], []
        for k in range(4):
            g = [p[i][k] - (r[4] == k) for i, r in enumerate(rows)]
            h = [2 * p[i][k] * (1 - p[i][k]) for i in range(len(rows))]
            total = lambda w, ids: math.fsum(w[i] for i in ids)
            worth = lambda ids: total(g, ids) ** 2 / (total(h, ids) + l2)

            def grow(ids, left_depth):
                best = None
                if left_depth:
                    for f in range(3):
                        for t in sorted({x[i][f] for i in range(len(rows)) if x[i][f] < math.inf}):
                            parts = [i for i in ids if x[i][f] <= t], [i for i in ids if x[i][f] > t]
                            if min(total(h, s) for s in parts) >= least:
                                gain = sum(map(worth, parts)) - worth(ids)
                                if gain > 1e-6 and (best is None or gain > best[0] + 1e-7):
                                    best = gain, parts
                if best:
                    for s in best[1]:
                        grow(s, left_depth - 1)
                    return
                for i in ids:
                    steps.append((i, k, -eta * total(g, ids) / (total(h, ids) + l2)))

            grow(list(range(len(rows))), depth)
        for i, k, s in steps:
            m[i][k] += s
    return [soft(v) for v in m]


def scored(rows, nodes, count=4):
    made = rows.withColumn("p", boosting.probabilities(nodes.collect(), NAMES, count))
    return {r.id: r.p for r in made.collect()}


def test_against_plain_booster(spark):
    rows = table()
    made = spark.createDataFrame(rows, SCHEMA)
    nodes = boosting.fit_softmax(made, "y", NAMES, 4, rounds=7, depth=3)
    got = scored(made, nodes)
    for i, want in enumerate(plain(rows, 7, 3)):
        assert got[i] == pytest.approx(want, abs=1e-5) and sum(got[i]) == pytest.approx(1)
    right = sum(max(range(4), key=got[r[0]].__getitem__) == r[4] for r in rows)
    assert right > 0.85 * len(rows)


def test_partitions_change_nothing(spark, monkeypatch):
    made = spark.createDataFrame(table(600, 4), SCHEMA)
    ordered = lambda nodes: sorted(map(tuple, nodes.collect()), key=str)
    want = ordered(boosting.fit_softmax(made, "y", NAMES, 4, rounds=6, depth=4))
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 60)
    assert ordered(boosting.fit_softmax(made.repartition(11, "b"), "y", NAMES, 4, rounds=6, depth=4)) == want


def test_nodes_in_sql(spark, tmp_path):
    """Nodes as SQL expressions give the same margins here and in another engine, missing values included."""
    made = spark.createDataFrame(table(300, 5), SCHEMA)
    nodes = boosting.fit_softmax(made, "y", NAMES, 4, rounds=3, depth=3)
    want, margins = scored(made, nodes), models.margins_sql(nodes.collect(), NAMES)
    made.write.parquet(f"{tmp_path}/rows")
    texts = ", ".join(f"{margins[k]} AS m{k}" for k in range(4))
    here = {r[0]: r[1:] for r in made.selectExpr("id", *texts.split(", ")).collect()}
    there = {r[0]: r[1:] for r in duckdb.sql(f"SELECT id, {texts} FROM '{tmp_path}/rows/*.parquet'").fetchall()}
    for i, p in want.items():
        for m in (here[i], there[i]):
            e = [math.exp(v) for v in m]
            assert [v / sum(e) for v in e] == pytest.approx(p)


def test_edges(spark):
    """No rows: equal margins. Rows without a class don't count. A feature of one value, of none, or of extra columns of any name, splits nothing."""
    none = boosting.fit_softmax(spark.createDataFrame([], SCHEMA), "y", NAMES, 4, rounds=2, depth=2)
    assert {(r.node, r.feature, r.prediction) for r in none.collect()} == {(0, -1, 0.0)} and none.count() == 8
    rows = [(i, i % 2 * 1.0, 7.0, None, i % 2) for i in range(40)]
    lost = [(100 + i, 0.0, 0.0, 0.0, y) for i, y in enumerate([None, -1, 9] * 5)]
    one, two = (boosting.fit_softmax(spark.createDataFrame(r, SCHEMA).withColumns({"x0": F.lit("z"), "slot": F.lit("z"), "m": F.lit(None)}), "y", NAMES, 2, rounds=6, depth=2) for r in (rows, rows + lost))
    assert {r.feature for r in one.collect()} == {-1, 0}
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    p = scored(spark.createDataFrame(rows, SCHEMA), one, 2)
    assert all(p[i][i % 2] > 0.8 for i in p)


@pytest.mark.parametrize("name", ["softmax_predictions", "softmax_importances"])
def test_queries(spark, monkeypatch, name):
    asked, fit = [], boosting.fit_softmax

    def small(rows, label, features, classes, rounds, depth):
        asked.append((classes, rounds, depth))
        return fit(rows, label, features, classes, 2, 3)

    monkeypatch.setattr(boosting, "fit_softmax", small)
    rows = q.QUERIES[name](spark, SF).collect()
    assert asked == [(4, 100, 6)]
    if name == "softmax_predictions":
        assert len({(r.pcap_file, r.frame_no) for r in rows}) == len(rows) > 400
        for r in rows:
            p = [r.p_normal, r.p_dos, r.p_fuzzy, r.p_mitm]
            assert sum(p) == pytest.approx(1) and p[r.pred_class] == max(p)
        assert sum(r.pred_class == r.class_id for r in rows) > 0.6 * len(rows)
    else:
        assert len(rows) == 18 and sum(r.importance for r in rows) == pytest.approx(1) and [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
