"""Features whose bins occur in few combinations are added up as one code, and the trees are those of each feature alone."""

import random

import numpy as np

from busline.operators import boosting

NAMES = list("abcdef")


def rows(spark, n=900):
    """b and c follow from a, d and e have few values, f has many; later rows have combinations that the first ones lack."""
    rnd, out = random.Random(12), []
    for i in range(n):
        a = rnd.randrange(40)
        out.append((a / 3, a % 5 * 1.0 if i < n // 2 else rnd.randrange(6) * 1.0, None if a % 7 == 0 else a // 7 * 1.0, rnd.randrange(3) * 1.0, rnd.randrange(4) * 1.0, rnd.random(), (a > 20) + 2 * (rnd.random() < 0.3)))
    return spark.createDataFrame(out, ", ".join([*(f"{c} double" for c in NAMES), "y int"])).coalesce(1)


def test_bundles_change_no_tree(spark, monkeypatch):
    made, seen, grow = rows(spark), [], boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda blocks, parts, together, *rest: seen.append(together) or grow(blocks, parts, together, *rest))
    monkeypatch.setattr(boosting, "WRITTEN_ROUNDS", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    fit = lambda: sorted(map(tuple, boosting.fit_softmax(made, "y", NAMES, 4, rounds=5, depth=4).collect()), key=str)
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    got = fit()
    assert len(seen[-1]) < len(NAMES) and sorted(f for one in seen[-1] for f in one.features) == list(range(6))
    monkeypatch.setattr(boosting, "tried", lambda x: [[f] for f in range(len(x))])
    assert fit() == got and len(seen[-1]) == 6 and any(r[6] >= 0 for r in got)
    monkeypatch.setattr(boosting, "tried", lambda x: [list(range(6))])  # too many combinations: each feature stays alone
    assert fit() == got and len(seen[-1]) == 6
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_combinations_of_all_rows(spark):
    """The first block says what is tried; combinations come from all blocks."""
    rnd = np.random.default_rng(2)
    x = [np.stack([v := rnd.integers(0, most, 50).astype(np.uint8), v // 2, rnd.integers(0, 200, 50).astype(np.uint8)]) for most in (10, 30, 90)]
    blocks = spark.createDataFrame([(bytearray(v.tobytes()),) for v in x], "x binary").coalesce(1)
    whole, made = np.concatenate(x, axis=1), boosting.bundles(blocks, 3)
    assert sorted(f for one in made for f in one.features) == [0, 1, 2] and len(made) < 3
    for one in made:
        code = one.codes(whole)
        for i, f in enumerate(one.features):
            assert (one.bins[i][code] == whole[f]).all()
            by_code = np.bincount(code, minlength=256)
            assert (one.sums(i, by_code[None])[0] == np.bincount(whole[f], minlength=256)).all()


def test_small_batches_only_inside(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    boosting.fit_softmax(rows(spark, 50), "y", NAMES, 4, rounds=1, depth=1)
    assert spark.conf.get(name) == before
