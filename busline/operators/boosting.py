"""Boosted trees for several classes by softmax, with second-order gains, from histograms that tasks add up.

Each round grows a tree a class, all classes at once, a level a job. A task adds up gradients and hessians of its rows by
(class, node, feature, bin); what tasks found is shuffled by (class, node, feature) and added again, so the driver sees one
candidate split a class, node and feature, however many rows there are. Gradients are rounded to 2^-30 and added as integers:
sums, and with them the trees, don't depend on partitions or on their order. Features of which few combinations of bins occur are
kept and added up together as one code, from whose sums those of each feature follow exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from busline.sources.store import delete, new_folder

#: Bins of a feature. The last one is for null, which like NaN is in no order with a threshold and goes right.
BINS = 256
#: Gradients and hessians in whole units.
UNITS = 1 << 30
#: Rows that a partition of the training table holds at least: small tables in many partitions would spend each level on starting tasks.
PARTITION_ROWS = 50_000
#: Partitions of the training table for each core at most, as each sends sums of all open nodes, and rows from which it takes more of them.
PARTITIONS_A_CORE, MOST_ROWS = 2, 2_000_000
#: Rows that are kept and added up together; sums of as many gradients are exact in doubles.
BLOCK_ROWS = 65_536
#: Codes of a bundle of features at most, those that it may have in the first block, and its features at most, whose bins fill 64 bits.
CODES, FIRST_CODES, BUNDLED = 256, 240, 8
#: Bytes of blocks that are handed to Python together, so that one is added up while the next is on its way.
BATCH_BYTES = 4 << 20
#: Rounds after which margins are written; up to then they are kept with the rows, and a lost executor makes its part again from there.
WRITTEN_ROUNDS = 10
SPLITS = "slot int, feature int, bin int, gain double, gl double, hl double, g double, h double"
NODES = "class int, tree int, weight double, node int, left int, right int, feature int, threshold double, prediction double, gain double, cover double"


@dataclass
class Bundle:
    """Features that are kept as one byte a row, its code: keys has the combinations of their bins that occur, in order, bins those bins by feature and code."""

    features: list[int]
    keys: np.ndarray | None
    bins: np.ndarray

    @classmethod
    def of(cls, features: list[int], keys: np.ndarray) -> Bundle:
        return cls(features, keys, np.stack([(keys >> np.uint64(8 * i) & np.uint64(255)).astype(np.uint8) for i in range(len(features))]))

    @classmethod
    def alone(cls, feature: int) -> Bundle:
        """One feature, whose bins are the codes."""
        return cls([feature], None, np.arange(BINS, dtype=np.uint8)[None])

    def codes(self, x: np.ndarray) -> np.ndarray:
        return x[self.features[0]] if self.keys is None else np.searchsorted(self.keys, joined(x, self.features)).astype(np.uint8)

    def sums(self, i: int, sums: np.ndarray) -> np.ndarray:
        """Of sums by code (last axis) those by bin of the i-th feature."""
        if self.keys is None:
            return sums
        order = np.argsort(self.bins[i], kind="stable")
        bins, first = np.unique(self.bins[i][order], return_index=True)
        out = np.zeros_like(sums)
        out[..., bins] = np.add.reduceat(sums[..., order], first, axis=-1)
        return out


def joined(x: np.ndarray, features: list[int]) -> np.ndarray:
    """The bins of some features of each column of x as one number."""
    key = np.zeros(x.shape[1], np.uint64)
    for i, f in enumerate(features):
        key |= x[f].astype(np.uint64) << np.uint64(8 * i)
    return key


@dataclass
class Tree:
    """A tree in heap order: the children of node i are 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.uint8), *(np.zeros(n) for _ in range(3)))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node where each column of x, the bins of a row, ends."""
        return self.walk([Bundle.alone(f) for f in range(len(x))])(x)

    def walk(self, bundles: list[Bundle]) -> Callable[[np.ndarray], np.ndarray]:
        """A function that gives the node where each column of x, the codes of a row by bundle, ends."""
        inner, where = self.feature >= 0, {f: (b, one.bins[i]) for b, one in enumerate(bundles) for i, f in enumerate(one.features)}
        # Leaves lead to themselves.
        of, right, child = np.zeros(len(inner), np.int64), np.zeros((len(inner), BINS), np.uint8), np.arange(len(inner))
        for node in np.flatnonzero(inner):
            of[node], bins = where[int(self.feature[node])]
            right[node, : len(bins)], child[node] = bins > self.bin[node], 2 * node + 1
        right = right.reshape(-1)

        def place(x: np.ndarray) -> np.ndarray:
            begin, at, row, flat = of * x.shape[1], np.zeros(x.shape[1], np.int64), np.arange(x.shape[1]), x.reshape(-1)
            reached = np.array([0])
            while inner[reached].any():
                at = child.take(at) + right.take((at << 8) + flat.take(begin.take(at) + row))
                reached = np.concatenate([2 * reached[inner[reached]] + 1, 2 * reached[inner[reached]] + 2])
            return at

        return place


def cut_points(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Up to BINS - 2 ascending thresholds of each feature, at equal shares of its finite values."""
    shares = ", ".join(f"{i}e0 / {BINS - 1}" for i in range(1, BINS - 1))
    finite = [F.when(F.abs(F.col(c).cast("double")) < math.inf, F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(features)]  # NaN is above infinity
    found = rows.select(*finite).agg(*[F.expr(f"percentile_approx(x{i}, array({shares}), {20 * BINS})") for i in range(len(features))]).first()
    return [np.unique(np.array(many or [], np.float64)) for many in found]


def _blocks(rows: DataFrame, features: list[str], label: str, cuts: list[np.ndarray], classes: int) -> DataFrame:
    """A row for each BLOCK_ROWS rows of a partition: x the bins by feature, y the classes, m the margins by class."""

    def pack(many: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(many)
        x = np.empty((len(features), b.num_rows), np.uint8)
        for i, cut in enumerate(cuts):
            value = b.column(i).to_numpy().astype(np.float64)
            x[i] = np.where(np.isnan(value), BINS - 1, np.searchsorted(cut, value))
        y = b.column(len(features)).to_numpy().astype(np.uint8)
        m = np.zeros((classes, b.num_rows))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, m)], ["x", "y", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= BLOCK_ROWS:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    chosen = rows.where(F.col(label).between(0, classes - 1)).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("int").alias("y"))
    return chosen.mapInArrow(run, "x binary, y binary, m binary")


def tried(x: np.ndarray) -> list[list[int]]:
    """Features that may go together, by the combinations of bins in x: each joins those whose combinations it makes fewest more of."""
    many, out = [len(np.unique(v)) for v in x], []
    for f in sorted(range(len(x)), key=lambda f: -many[f]):
        best = None
        for one in out:
            if len(one[0]) < BUNDLED and one[1] <= FIRST_CODES and max(one[1], many[f]) <= FIRST_CODES:
                n = len(np.unique(joined(x, [*one[0], f])))
                if n <= FIRST_CODES and (best is None or n * best[1][1] < best[0] * one[1]):
                    best = n, one
        if best is None:
            out.append([[f], many[f]])
        else:
            best[1][0].append(f)
            best[1][1] = best[0]
    return [sorted(features) for features, _ in out]


def _combinations(features: int, groups: list[list[int]]) -> Callable:
    """Of each group the combinations of bins that a task's rows have, null if they are more than CODES."""

    def run(batches):
        seen: list[np.ndarray | None] = [np.zeros(0, np.uint64) for _ in groups]
        for b in batches:
            for blob in b.column("x"):
                x = np.frombuffer(blob.as_buffer(), np.uint8).reshape(features, -1)
                for i, group in enumerate(groups):
                    if seen[i] is not None:
                        seen[i] = np.union1d(seen[i], joined(x, group))
                        if len(seen[i]) > CODES:
                            seen[i] = None
        yield pa.RecordBatch.from_arrays([pa.array(range(len(groups)), pa.int32()), pa.array([None if k is None else k.tobytes() for k in seen], pa.binary())], ["i", "keys"])

    return run


def bundles(blocks: DataFrame, features: int) -> list[Bundle]:
    """Bundles of all features. The first block says what may go together; all rows are then looked through for their combinations, and what has too many is kept apart."""
    first = blocks.select("x").head()
    groups = tried(np.frombuffer(first.x, np.uint8).reshape(features, -1)) if first else [[f] for f in range(features)]
    several = [g for g in groups if len(g) > 1]
    found: list[set[int] | None] = [set() for _ in several]
    for r in blocks.select("x").mapInArrow(_combinations(features, several), "i int, keys binary").collect() if several else []:  # CODES numbers a task and group at most
        found[r.i] = None if found[r.i] is None or r.keys is None else found[r.i] | set(np.frombuffer(r.keys, np.uint64).tolist())
    out = [Bundle.alone(f) for g in groups if len(g) == 1 for f in g]
    for g, keys in zip(several, found):
        out += [Bundle.of(g, np.array(sorted(keys), np.uint64))] if keys is not None and len(keys) <= CODES else [Bundle.alone(f) for f in g]
    return out


def _coded(features: int, together: list[Bundle]) -> Callable:
    """Blocks with codes by bundle instead of bins by feature."""

    def run(batches):
        for b in batches:
            made = [np.stack([one.codes(x) for one in together]).tobytes() for x in (np.frombuffer(v.as_buffer(), np.uint8).reshape(features, -1) for v in b.column("x"))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), b.column("y"), b.column("m")], ["x", "y", "m"])

    return run


def softmax(m: np.ndarray) -> np.ndarray:
    """Probabilities of margins that have classes along the first axis."""
    p = np.exp(m - m.max(axis=0))
    return p / p.sum(axis=0)


def _advanced(together: list[Bundle], classes: int, last: list[Tree]) -> Callable:
    """Blocks with the last trees, a class each, in their margins, and w, gradients and hessians by class in whole units."""

    def run(batches):
        walks = [tree.walk(together) for tree in last]
        for b in batches:
            for x, y, m in zip(*(b.column(c) for c in ("x", "y", "m"))):
                y = np.frombuffer(y.as_buffer(), np.uint8)
                x, m = np.frombuffer(x.as_buffer(), np.uint8).reshape(len(together), len(y)), np.frombuffer(m.as_buffer()).reshape(classes, len(y)).copy()
                for k, tree in enumerate(last):
                    m[k] += tree.value[walks[k](x)]
                p, w = softmax(m), np.empty((classes, 2, len(y)), np.int32)
                for k in range(classes):
                    w[k, 0] = np.rint((p[k] - (y == k)) * UNITS)
                    w[k, 1] = np.rint(2 * p[k] * (1 - p[k]) * UNITS)  # twice the diagonal, as the classes step together
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, m, w)], ["x", "y", "m", "w"])

    return run


def _histograms(together: list[Bundle], classes: int, grown: list[Tree], slots: list[np.ndarray]) -> Callable:
    """slot, bundle and the sums by code of a task's rows; slots gives each class's open nodes their number, and -1 to others."""

    def run(batches):
        sums = np.zeros((1 + max(s.max() for s in slots), len(together), 2, BINS), np.int64)
        walks = [tree.walk(together) for tree in grown]
        for b in batches:
            for x, w in zip(*(b.column(c) for c in ("x", "w"))):
                w = np.frombuffer(w.as_buffer(), np.int32).reshape(classes, 2, -1)
                x = np.frombuffer(x.as_buffer(), np.uint8).reshape(len(together), w.shape[2])
                for k, place in enumerate(walks):
                    if slots[k].max() < 0:
                        continue
                    slot = slots[k][place(x)]
                    kept = np.flatnonzero(slot >= 0)
                    if not len(kept):
                        continue
                    bins, both = x, w[k]
                    if len(kept) < len(slot):
                        slot, bins, both = slot[kept], x[:, kept], both[:, kept]
                    low = slots[k][slots[k] >= 0].min()
                    n = slots[k].max() - low + 1
                    base, (g, h) = (slot - low) * BINS, both.astype(np.float64)
                    for i in range(len(together)):
                        at = base + bins[i]
                        for part, of in enumerate((g, h)):
                            sums[low : low + n, i, part] += np.bincount(at, of, n * BINS).astype(np.int64).reshape(n, BINS)
        some = np.argwhere(sums.any(axis=(2, 3)))
        if len(some):
            blobs = pa.array([sums[s, i].tobytes() for s, i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some[:, 0], pa.int32()), pa.array(some[:, 1], pa.int32()), blobs], ["slot", "bundle", "sums"])

    return run


def _splits(together: list[Bundle], cuts: list[int], l2: float, least_cover: float) -> Callable:
    """The best bin of each slot and feature, -1 if none has two children of least_cover, with the sums of the left child and of the node."""

    def run(batches):
        added: dict[int, dict[int, np.ndarray]] = {}
        for b in batches:
            for slot, bundle, blob in zip(*(b.column(c).to_pylist() for c in ("slot", "bundle", "sums"))):
                of, found = added.setdefault(bundle, {}), np.frombuffer(blob, np.int64)
                of[slot] = of[slot] + found if slot in of else found
        for bundle, of in added.items():
            slots, by_code = np.array(list(of)), np.stack(list(of.values())).reshape(len(of), 2, BINS)
            for i, f in enumerate(together[bundle].features):
                sums = together[bundle].sums(i, by_code)
                left, whole = sums.cumsum(axis=2) / UNITS, sums.sum(axis=2, keepdims=True) / UNITS
                right, worth = whole - left, lambda s: s[:, 0] ** 2 / (s[:, 1] + l2)
                gain = worth(left) + worth(right) - worth(whole)
                fits = (left[:, 1] >= least_cover) & (right[:, 1] >= least_cover) & (np.arange(BINS) < cuts[f])
                gain = np.where(fits, gain, -np.inf)
                at, row = gain.argmax(axis=1), np.arange(len(slots))
                at = np.where(np.isfinite(gain[row, at]), at, -1)
                columns = [slots, np.full(len(slots), f), at, gain[row, at], left[row, 0, at], left[row, 1, at], whole[:, 0, 0], whole[:, 1, 0]]
                types = [pa.int32()] * 3 + [pa.float64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["slot", "feature", "bin", "gain", "gl", "hl", "g", "h"])

    return run


def _grow(blocks: DataFrame, parts: int, together: list[Bundle], cuts: list[np.ndarray], classes: int, depth: int, eta: float, l2: float, least_cover: float, least_gain: float) -> list[Tree]:
    """One round: a tree a class."""
    grown = [Tree.of_depth(depth) for _ in range(classes)]
    opened = [(k, 0) for k in range(classes)]
    for _ in range(depth):
        if not opened:
            break
        slots = [np.full(len(t.feature), -1, np.int64) for t in grown]
        for i, (k, node) in enumerate(opened):
            slots[k][node] = i
        add, choose = _histograms(together, classes, grown, slots), _splits(together, [len(c) for c in cuts], l2, least_cover)
        if parts > 1:
            found = blocks.mapInArrow(add, "slot int, bundle int, sums binary").repartition(parts, "slot", "bundle").mapInArrow(choose, SPLITS)
        else:  # nothing to shuffle
            found = blocks.mapInArrow(lambda batches: choose(add(batches)), SPLITS)
        best: dict[int, Row] = {}
        for r in found.collect():
            # Equal gains: the first feature.
            if r.slot not in best or (r.gain, -r.feature) > (best[r.slot].gain, -best[r.slot].feature):
                best[r.slot] = r
        leaf = lambda g, h: -eta * g / (h + l2)
        following = []
        for i, (k, node) in enumerate(opened):
            r, tree = best.get(i), grown[k]
            if r is None:  # no rows
                continue
            tree.value[node], tree.cover[node] = leaf(r.g, r.h), r.h
            if r.bin < 0 or r.gain <= least_gain:
                continue
            tree.feature[node], tree.bin[node], tree.gain[node] = r.feature, r.bin, r.gain
            for child, g, h in ((2 * node + 1, r.gl, r.hl), (2 * node + 2, r.g - r.gl, r.h - r.hl)):
                tree.value[child], tree.cover[child] = leaf(g, h), h
                if h >= 2 * least_cover:  # less can't be split
                    following.append((k, child))
        opened = following
    return grown


@contextmanager
def _handed_over(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of about `size` bytes inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _written(blocks: DataFrame) -> tuple[str, DataFrame]:
    """Blocks in a folder of their own, and read from there."""
    path = new_folder(blocks.sparkSession, "boosting")
    blocks.write.parquet(path)
    return path, blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def fit_softmax(
    rows: DataFrame, label: str, features: list[str], classes: int, rounds: int = 100, depth: int = 6, eta: float = 0.3, l2: float = 1.0, least_cover: float = 1.0, least_gain: float = 1e-6,
) -> DataFrame:
    """The nodes of the trees fitted to label, a class from 0 to classes - 1, as a table of NODES.

    A row goes left where its feature is at most the threshold; null and NaN go right. Rows of another or no class are left
    out; from no rows at all come trees of one leaf that give all classes the same margin. Each round passes over the rows once a level; they are
    kept by Spark in codes, a byte a bundle of features, with margins and the round's gradients, and written to the shared folder every WRITTEN_ROUNDS.
    """
    spark = rows.sparkSession
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    parts = max(1, min(math.ceil(n / PARTITION_ROWS), max(PARTITIONS_A_CORE * cores, math.ceil(n / MOST_ROWS))))
    rows = rows.coalesce(parts)
    cuts = cut_points(rows, features)  # one task adds up what the partitions found
    columns, (written, kept) = "x binary, y binary, m binary", _written(_blocks(rows, features, label, cuts, classes))
    together, forest, before = bundles(kept, len(features)), [], None
    kept = kept.mapInArrow(_coded(len(features), together), columns)
    with _handed_over(spark, BATCH_BYTES):
        for r in range(rounds):
            state = kept.mapInArrow(_advanced(together, classes, forest[-1] if forest else []), f"{columns}, w binary").persist(StorageLevel.MEMORY_AND_DISK)
            # What tasks send is bounded by open nodes, so no more tasks than cores add it up.
            forest.append(_grow(state.select("x", "w"), min(parts, cores), together, cuts, classes, depth, eta, l2, least_cover, least_gain))
            if before is not None:
                before.unpersist()
            kept, before = state.select("x", "y", "m"), state
            if (r + 1) % WRITTEN_ROUNDS == 0:
                path, kept = _written(kept)
                state.unpersist()
                delete(spark, written)
                written, before = path, None
    if before is not None:
        before.unpersist()
    delete(spark, written)
    return spark.createDataFrame([n for t, trees in enumerate(forest) for k, tree in enumerate(trees) for n in _nodes(k, t, tree, cuts)], NODES)


def _nodes(k: int, t: int, tree: Tree, cuts: list[np.ndarray]) -> Iterator[tuple]:
    """The nodes of a tree, as rows of NODES."""
    reached = [0]
    for node in reached:
        f = int(tree.feature[node])
        children = (2 * node + 1, 2 * node + 2) if f >= 0 else (-1, -1)
        reached += [c for c in children if c >= 0]
        yield (k, t, 1.0, node, *children, f, float(cuts[f][tree.bin[node]]) if f >= 0 else None, float(tree.value[node]), float(tree.gain[node]), float(tree.cover[node]))


def probabilities(nodes: list[Row], features: list[str], classes: int) -> F.Column:
    """The probability of each class by the nodes of fit_softmax(), an array of doubles that sum to 1."""
    trees: dict[tuple[int, int], list[Row]] = {}
    for r in nodes:
        trees.setdefault((r["tree"], r["class"]), []).append(r)
    walked = []
    for (_, k), many in sorted(trees.items()):
        size = 1 + max(r["node"] for r in many)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        for r in many:
            feature[r["node"]], threshold[r["node"]], value[r["node"]] = r["feature"], r["threshold"] or 0.0, r["prediction"]
        walked.append((k, feature, threshold, value))

    @F.pandas_udf("array<double>")
    def given(x: pd.DataFrame) -> pd.Series:
        values, row, m = x.to_numpy(np.float64).T, np.arange(len(x)), np.zeros((classes, len(x)))
        for k, feature, threshold, value in walked:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                at = np.where(inner, 2 * at + 2 - (values[np.maximum(feature[at], 0), row] <= threshold[at]), at)
            m[k] += value[at]
        return pd.Series(list(softmax(m).T))

    return given(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]))
