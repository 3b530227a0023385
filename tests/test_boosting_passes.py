"""What a level of softmax boosting passes over, and blocks of several batches."""

import random

import numpy as np

from busline.operators import boosting

NAMES = ["a", "b", "c"]


def rows(spark, n=700):
    rnd = random.Random(8)
    return spark.createDataFrame([(rnd.random(), rnd.choice([None, rnd.random()]), rnd.random(), rnd.randrange(3)) for _ in range(n)], "a double, b double, c double, y int").repartition(9)


def test_levels_read_gradients_and_few_tasks_add_up(spark, monkeypatch):
    """A level reads bins and this round's gradients alone, from no more partitions and for no more tasks than go with the cores."""
    seen, grow, cores = [], boosting._grow, spark.sparkContext.defaultParallelism

    def watched(blocks, parts, *rest):
        seen.append((blocks.columns, parts, blocks.rdd.getNumPartitions()))
        return grow(blocks, parts, *rest)

    made = rows(spark)
    want = sorted(map(tuple, boosting.fit_softmax(made, "y", NAMES, 3, rounds=3, depth=3).collect()), key=str)
    monkeypatch.setattr(boosting, "_grow", watched)
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 1)
    monkeypatch.setattr(boosting, "PARTITIONS_A_CORE", 1)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = sorted(map(tuple, boosting.fit_softmax(made, "y", NAMES, 3, rounds=3, depth=3).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert len(seen) == 3 and all(c == ["x", "w"] and p <= cores and n <= cores for c, p, n in seen)


def test_places(monkeypatch):
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 256, (4, 500)).astype(np.uint8)
    for open_share in (0.0, 0.5, 1.0):
        tree = boosting.Tree.of_depth(4)
        for node in range(15):
            if node == 0 or tree.feature[(node - 1) // 2] >= 0:
                tree.feature[node] = rnd.integers(0, 4) if rnd.random() < open_share else -1
                tree.bin[node] = rnd.integers(0, 256)

        def walk(i):
            at = 0
            while tree.feature[at] >= 0:
                at = 2 * at + 1 + int(x[tree.feature[at], i] > tree.bin[at])
            return at

        assert tree.place(x).tolist() == [walk(i) for i in range(500)]
