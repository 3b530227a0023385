"""Embedding near-dedup: randomised-rotation binary codes decide which pairs need exact recomputation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import LINKS, block_links, block_pairs, blocks, bounded_batches, copies_of, group_bounds, join_roots, linked_classes, map_groups, materialized, mixed

#: Standard deviations of the estimate that a confidence bound spans.
SIGMAS = 4.0
#: Bits of a level, in which the rotated components of the other vector are stored.
LEVELS = 6


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation of dim dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([dim, seed]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def code_plan(rows: int, threshold: float, recall: float, held: int = 16) -> tuple[int, int]:
    """(bands, bits): bits so that a bucket of unrelated vectors holds about `held` of rows, and the fewest bands with
    which a pair at the threshold shares one with probability `recall`. A bit of two codes is equal with probability
    1 - angle / pi."""
    bits = min(max(math.ceil(math.log2(max(rows, 1) / held)), 6), 30) if rows > held * 64 else 6
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - same)), bits


@dataclass
class Codes:
    """Binary codes of vectors of one dimension: what is stored of each vector instead of it.

    bits are the signs of its rotated components, packed into 64-bit words; planes the rotated components themselves in
    LEVELS bits each, rounded up or down at random so that the mean is right, as one packed word row a bit; low
    and step say which value a level stands for, total is the sum of the levels. factor is the correction, the inner
    product of the rotated unit vector with its code (signs over the root of the dimension).
    """

    dim: int
    bits: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    factor: np.ndarray

    def estimate(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Unbiased estimates of the inner products of the unit vectors i and j, from the signs of i and the levels of j."""
        mine, ones = self.bits[i], np.zeros(len(i), np.int64)
        for k in range(LEVELS):
            ones += np.bitwise_count(mine & self.planes[j, k]).sum(axis=1, dtype=np.int64) << k
        signs = 2 * np.bitwise_count(mine).sum(axis=1, dtype=np.int64) - self.dim
        inner = self.low[j] * signs + self.step[j] * (2 * ones - self.total[j])
        return inner / (math.sqrt(self.dim) * self.factor[i])

    def least(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """The lower end of the confidence interval of the estimate for a pair whose inner product is the threshold.

        The code's error is in the part of j that is perpendicular to i, the rounding's at most half a step a component;
        both shrink with the root of the dimension. It rises with the inner product, so no pair above the threshold is
        expected below it.
        """
        f = self.factor[i]
        spread = (1 - threshold**2) * np.maximum(1 - f**2, 0) / max(self.dim - 1, 1) + self.step[j] ** 2 / 4
        return threshold - SIGMAS * np.sqrt(spread) / f - 1e-9


def _packed(on: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-on.shape[-1] // 64)
    out = np.zeros((*on.shape[:-1], words * 8), np.uint8)
    raw = np.packbits(on, axis=-1, bitorder="little")
    out[..., : raw.shape[-1]] = raw
    return out.view(np.uint64)


def encode(unit: np.ndarray, turn: np.ndarray, seed: int = 0) -> Codes:
    """The codes of unit vectors under a rotation; equal vectors round alike."""
    dim = unit.shape[1]
    turned = unit @ turn.T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << LEVELS) - 1), 1e-12)
    # Where a component is rounded up depends on the vector's own digits, so that reruns agree.
    own = np.frombuffer(np.ascontiguousarray(unit).tobytes(), np.uint64).reshape(unit.shape)
    draw = mixed(own + np.arange(dim, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1)) >> np.uint64(11)
    level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + draw / 2.0**53), 0, (1 << LEVELS) - 1).astype(np.uint8)
    planes = np.stack([_packed((level >> k & 1).astype(bool)) for k in range(LEVELS)], axis=1)
    return Codes(dim, _packed(turned >= 0), planes, low, step, level.sum(axis=1, dtype=np.int64), np.abs(turned).sum(axis=1) / math.sqrt(dim))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors scaled by a power of two so that their largest component is near 1, None for those that link with nothing.

    Such a factor changes no digit and no cosine, but squares neither overflow nor vanish.
    """
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        if v is None or not v or None in v:
            out.append(None)
            continue
        x = np.array(v, np.float64) + 0.0
        out.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0 if np.isfinite(x).all() and x.any() else None)
    return out


def _prepared(vectors: DataFrame) -> DataFrame:
    """doc_id, label, vector (binary of scaled doubles, null if it links with nothing), same (digest of the scaled vector), dim."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_pylist()
            got = [v if y is not None else None for v, y in zip(_vectors(batch.column(2)), label)]
            raw = [None if v is None else v.astype("<f8").tobytes() for v in got]
            same = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.int64()), pa.array(raw, pa.binary()), pa.array(same, pa.binary()), pa.array([None if v is None else len(v) for v in got], pa.int32())], names=["doc_id", "label", "vector", "same", "dim"])

    chosen = vectors.select(F.col("vec_id").cast("bigint").alias("doc_id"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>"))
    return chosen.mapInArrow(run, "doc_id bigint, label bigint, vector binary, same binary, dim int")


_BLOCK = ["label", "dim", "band", "key", "block_i", "block_j"]
_CODES = "signs binary, bits binary, planes binary, low double, step double, total bigint, factor double"


def _coded(reps: DataFrame, bands: int, bits: int) -> DataFrame:
    """doc_id, label, dim, copies, keys and the stored codes: signs of as many rotations as the bands take, the first being that of the codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            raw, dims = batch.column(4).to_pylist(), batch.column(2).to_numpy()
            rows: list = [None] * len(raw)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(raw[i] for i in at), "<f8").reshape(len(at), d)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                turn = turns.setdefault(d, [rotation(d, k) for k in range(math.ceil(bands * bits / d))])
                signs = np.concatenate([unit @ t.T >= 0 for t in turn], axis=1)[:, : bands * bits]
                c, packed = encode(unit, turn[0]), _packed(signs)
                keys = band_keys(packed, bands, bits).view(np.int64)
                for r, i in enumerate(at.tolist()):
                    rows[i] = (keys[r], packed[r].tobytes(), c.bits[r].tobytes(), c.planes[r].tobytes(), c.low[r], c.step[r], c.total[r], c.factor[r])
            made = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], names=["doc_id", "label", "dim", "copies", "keys", *(f.split()[0] for f in _CODES.split(", "))])

    return reps.select("doc_id", "label", "dim", "copies", "vector").mapInArrow(run, f"doc_id bigint, label bigint, dim int, copies bigint, keys array<bigint>, {_CODES}")


def band_keys(signs: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """The bits of each band of packed signs, as one integer a band."""
    on = np.unpackbits(signs.view(np.uint8), axis=1, bitorder="little")[:, : bands * bits].reshape(len(signs), bands, bits)
    return (on * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def _near(pdf: pd.DataFrame, threshold: float, bands: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the blocks of a frame, in chunks, that share no earlier band and whose estimate reaches the bound."""
    at = group_bounds(pdf, _BLOCK)
    column = lambda c, t: np.frombuffer(b"".join(pdf[c]), t).reshape(len(pdf), -1)
    band, dims, same = pdf["band"].to_numpy(), pdf["dim"].to_numpy(), (pdf["block_i"] == pdf["block_j"]).to_numpy()
    keys = band_keys(column("signs", np.uint64), bands, bits)
    numbers = [pdf[c].to_numpy() for c in ("low", "step", "total", "factor")]
    by_dim: dict[int, tuple[Codes, np.ndarray]] = {}
    for d in np.unique(dims).tolist():  # rows of one dimension stand together in a block
        rows, words = np.flatnonzero(dims == d), -(-d // 64)
        place = np.zeros(len(pdf), np.int64)
        place[rows] = np.arange(len(rows))
        one = lambda c: np.frombuffer(b"".join(pdf[c].iloc[rows]), np.uint64)
        by_dim[d] = Codes(d, one("bits").reshape(len(rows), words), one("planes").reshape(len(rows), LEVELS, words), *(x[rows] for x in numbers)), place
    for i, j in block_pairs(at, same, pdf["side"].to_numpy()):
        fresh = np.ones(len(i), bool)
        for c in range(int(band.max(initial=0))):
            fresh &= (band[i] <= c) | (keys[i, c] != keys[j, c])
        i, j = i[fresh], j[fresh]
        for d, (codes, place) in by_dim.items():
            x, y = (i, j) if len(by_dim) == 1 else (i[dims[i] == d], j[dims[i] == d])
            near = codes.estimate(place[x], place[y]) >= codes.least(place[x], place[y], threshold)
            yield x[near], y[near]


def _chooser(threshold: float, bands: int, bits: int):
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of each block that have a partner whose estimate reaches the bound, from codes alone."""
        mask = np.zeros(len(pdf), bool)
        for i, j in _near(pdf, threshold, bands, bits):
            mask[i] = mask[j] = True
        return pdf.loc[mask, ["doc_id", *_BLOCK, "side"]]

    return choose


def _linker(threshold: float, bands: int, bits: int):
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of each block as counts per vector, and as edges that join what is linked; cosines in double precision."""
        raw, docs, copies = pdf["vector"].tolist(), pdf["doc_id"].to_numpy(), pdf["copies"].to_numpy()
        size = pdf["dim"].to_numpy().astype(np.int64)
        flat, begin = np.frombuffer(b"".join(raw), "<f8"), np.cumsum(size) - size
        norm = np.sqrt(np.add.reduceat(flat * flat, begin)) if len(flat) else np.zeros(0)
        links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        most = max(1, (1 << 20) // int(size.max(initial=1)))
        for i, j in _near(pdf, threshold, bands, bits):
            for a in range(0, len(i), most):
                x, y = i[a : a + most], j[a : a + most]
                n = size[x]
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                inner = np.add.reduceat(flat[np.repeat(begin[x], n) + inside] * flat[np.repeat(begin[y], n) + inside], np.cumsum(n) - n)
                linked = inner / (norm[x] * norm[y]) >= threshold
                x, y = x[linked], y[linked]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                join_roots(root, x, y)
        return block_links(docs, links, root)

    return link


def vector_classes(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors of equal label whose cosine is threshold or more are linked.

    Vectors of a label that are equal, or equal after scaling by a power of two, are one representative with a number of copies. Of each representative a binary code
    under a random rotation, its levels and its correction factor are stored. The signs give bands of bits; those that
    share a band, label and dimension meet in a block of bounded size, as codes: estimates of their inner products
    come from counting bits, and only rows with a partner whose estimate reaches the confidence bound take
    their vectors along to a second round, which recomputes such pairs in double precision. That alone decides. Pairs that
    share an earlier band are left to it. Blocks return counts and spanning edges, never all pairs.

    A null label, and a vector that is null, empty, zero or holds null or non-finite components, links with nothing; vectors of different
    length are never compared. Rows that share a vec_id are one vector; of different ones the smallest digest stands
    for it. Rows with a null vec_id are left out. An empty table gives no rows. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 8192)
    rows = _prepared(vectors.where("vec_id IS NOT NULL")).groupBy("doc_id").agg(F.min(F.struct("same", "label", "dim", "vector")).alias("s")).select("doc_id", "s.*")
    rows = materialized(rows, "vectors")
    valid = rows.where("vector IS NOT NULL")
    members = copies_of(valid.select("doc_id", "label", "same"), ["label", "same"], ["label"])
    largest = members.where("doc_id = rep").groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bands, bits = code_plan(largest, threshold, recall)
    reps = valid.join(members.where("doc_id = rep").select("doc_id", "copies"), "doc_id")
    codes = materialized(_coded(reps, bands, bits), "codes")
    banded = codes.select("doc_id", "label", "dim", F.posexplode("keys").alias("band", "key"))
    codes = codes.drop("keys", "label", "dim")
    met = blocks(banded, ["label", "dim", "band", "key"]).join(codes.drop("copies"), "doc_id")
    chosen = materialized(map_groups(met, _BLOCK, _chooser(threshold, bands, bits), "doc_id bigint, label bigint, dim int, band int, key bigint, block_i int, block_j int, side int", also=["side"]), "chosen")
    taken = codes.join(valid.select("doc_id", "vector"), "doc_id")
    # Rows of a block share all but doc_id, so files of chosen are a small part of its rows: it is shuffled, too.
    links = materialized(map_groups(chosen.join(taken.hint("merge"), "doc_id"), _BLOCK, _linker(threshold, bands, bits), LINKS, also=["side"]), "links")
    out = linked_classes(rows.select("doc_id"), members.drop("label"), links)
    return out.select(F.col("doc_id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"), "kept")


#: All pairs of a label; within reach of SQL for some thousands of vectors.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
