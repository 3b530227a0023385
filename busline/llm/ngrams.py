"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import LINKS, Words, block_links, block_pairs, blocks, bounded_batches, copies_of, group_bounds, join_roots, linked_classes, map_groups, materialized, mixed, slices


def band_plan(threshold: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands of `rows` minima with which a pair at the threshold shares a band with
    probability `recall` at least; pairs above it do so more often."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def gram_sets(texts: list, n: int) -> Iterator[np.ndarray]:
    """Each text's set of hashed word n-grams, sorted; a shorter text has one n-gram of all its words, one without
    words has none."""
    words = Words(texts)
    gram = words.grams(n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(gram[a : b - n + 1])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = mixed(h * np.uint64(31) + words.hash[k])
            yield h + np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def set_digest(s: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    return mixed(s).sum(dtype=np.uint64).tobytes() + mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).tobytes()


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set (binary: digest of the n-gram set, null without words), size (of the set), bands (array<bigint>)."""
    rng = np.random.default_rng(7)
    mult = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            digest, sizes, keys = [], [], []
            for a, b in slices(texts, 1 << 20):
                for s in gram_sets(texts[a:b], n):
                    sizes.append(len(s))
                    if not len(s):
                        digest.append(None)
                        keys.append(None)
                        continue
                    least = np.array([(s * m + c).min() for m, c in zip(mult, add)]) if len(s) < 8 else np.concatenate([(s[None, :] * mult[i : i + 8, None] + add[i : i + 8, None]).min(axis=1) for i in range(0, len(mult), 8)])
                    least = mixed(least).reshape(bands, rows)
                    key = np.zeros(bands, np.uint64)
                    for k in range(rows):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
                    digest.append(set_digest(s))
                    keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "set", "size", "bands"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, set binary, size bigint, bands array<bigint>")


_BLOCK = ["band", "key", "block_i", "block_j"]
#: Pairs of rows that share a word n-gram, summed over n-grams, up to which they are counted one by one.
LISTED = 1 << 22


def _candidates(pdf: pd.DataFrame, at: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the blocks of a frame, in chunks, whose first common band is the block's and whose sizes allow the similarity."""
    keys, band, size = np.stack(pdf["bands"].to_numpy()), pdf["band"].to_numpy(), pdf["size"].to_numpy()
    same = (pdf["block_i"] == pdf["block_j"]).to_numpy()
    for i, j in block_pairs(at, same, pdf["side"].to_numpy()):
        # No pair above the threshold differs more in size than this.
        close = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[close], j[close]
        for c in range(int(band.max())):
            fresh = (band[i] <= c) | (keys[i, c] != keys[j, c])
            i, j = i[fresh], j[fresh]
        if len(i):
            yield i, j


def _chooser(threshold: float):
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of each block that have a candidate partner there."""
        mask = np.zeros(len(pdf), bool)
        for i, j in _candidates(pdf, group_bounds(pdf, _BLOCK), threshold):
            mask[i] = mask[j] = True
        return pdf.loc[mask, ["doc_id", *_BLOCK, "side"]]

    return choose


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many entries each two of the sets share, as a matrix.

    Where few do, the pairs of sets that hold an entry are listed and counted; else entries are columns of a 0-1 matrix, and
    its product with itself, taken some columns at a time, counts them.
    """
    m, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    _, entry, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[entry] > 1
    row, entry = np.repeat(np.arange(m), size)[shared], np.unique(entry[shared], return_inverse=True)[1]
    order = np.argsort(entry, kind="stable")
    row, entry = row[order], entry[order]
    bounds = np.append(np.flatnonzero(np.diff(entry, prepend=-1)), len(entry))
    held = np.diff(bounds)
    if int((held * (held - 1) // 2).sum()) <= max(LISTED, m * m * len(held) // 64):
        out = np.zeros(m * m, np.int64)
        for i, j in block_pairs(bounds, np.ones(len(row), bool), np.zeros(len(row), np.int64)):
            out += np.bincount(row[i] * m + row[j], minlength=m * m)
        out = out.reshape(m, m)
        return out + out.T
    out, step = np.zeros((m, m), np.float32), max(1, (1 << 23) // m)
    for a in range(0, len(held), step):
        lo, hi = bounds[a], bounds[min(a + step, len(held))]
        on = np.zeros((m, min(step, len(held) - a)), np.float32)
        on[row[lo:hi], entry[lo:hi] - a] = 1
        out += on @ on.T
    return out.astype(np.int64)


def _verifier(n: int, threshold: float):
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of each block as counts per document, and as edges that join what is linked."""
        at = group_bounds(pdf, _BLOCK)
        docs, copies, size, texts = pdf["doc_id"].to_numpy(), pdf["copies"].to_numpy(), pdf["size"].to_numpy(), pdf["text"].tolist()
        links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a < 2:
                continue
            part = pdf.iloc[a:b]
            sets = [s for x, y in slices(texts[a:b], 1 << 20) for s in gram_sets(texts[a + x : a + y], n)]
            sole = np.ones(b - a, bool)
            if len(np.unique(docs[a:b])) < b - a:  # other texts or other rows of the same doc_id
                sole[:] = False
                sole[list({docs[a + i]: i for i, (s, d) in enumerate(zip(sets, part["set"])) if set_digest(s) == d}.values())] = True
            counts = None
            for i, j in _candidates(part, np.array([0, b - a]), threshold):
                i, j = i[sole[i] & sole[j]], j[sole[i] & sole[j]]
                counts = common_counts(sets) if counts is None else counts
                linked = counts[i, j] >= threshold * (size[a + i] + size[a + j] - counts[i, j]) - 1e-9
                i, j = a + i[linked], a + j[linked]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                join_roots(root, i, j)
        return block_links(docs, links, root)

    return verify


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, kept: documents whose sets of word n-grams have a Jaccard similarity of threshold or more.

    n_links counts the documents linked directly, copies included; class_id is the smallest doc_id reachable by
    links, and kept is true for it alone. Documents with equal sets are one representative (the smallest doc_id) with a number of copies, so
    exact copies never form pairs. Representatives that share a band of MinHash values meet in a block of a bounded number
    of rows and of n-grams; pairs that share an earlier band are left to that band, so every pair is looked at once. Only documents with
    such a partner take their text along, and blocks compare full n-gram sets. Blocks return counts and
    spanning edges, never all pairs.

    Null and empty texts and those without a word have no n-gram: they link with nothing and are kept. A text of fewer
    than n words has one n-gram, all its words. Rows that share a doc_id are one document; if their sets differ, the set with
    the smallest digest stands for it. Rows with a null doc_id cannot be named in a link and are left out. An empty table
    gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    bands, rows = band_plan(threshold, recall)
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    signed = signatures(docs, n, bands, rows).groupBy("doc_id").agg(F.min(F.struct("set", "size", "bands")).alias("s")).select("doc_id", "s.*")
    signed = materialized(signed, "signatures")
    members = copies_of(signed.select("doc_id", "set"), ["set"])
    reps = signed.join(members.where("doc_id = rep").select("doc_id", "copies"), "doc_id")
    banded = reps.select("doc_id", "size", F.posexplode("bands").alias("band", "key"))
    block = ", ".join(f"{c} {t}" for c, t in zip([*_BLOCK, "side"], ("int", "bigint", "int", "int", "int")))
    met = blocks(banded, ["band", "key"], F.col("size")).join(signed.select("doc_id", "bands"), "doc_id")
    chosen = map_groups(met, _BLOCK, _chooser(threshold), f"doc_id bigint, {block}", also=["side"])
    per = chosen.groupBy("doc_id").agg(F.collect_list(F.struct(*_BLOCK, "side")).alias("at")).join(reps, "doc_id")
    laid = docs.join(per, "doc_id").select("doc_id", "text", "set", "size", "copies", "bands", F.explode("at").alias("at")).select("doc_id", "text", "set", "size", "copies", "bands", "at.*")
    verified = materialized(map_groups(laid, _BLOCK, _verifier(n, threshold), LINKS, also=["side"]), "links")
    return linked_classes(signed.select("doc_id"), members, verified)


#: All pairs that share an n-gram; within reach of SQL for some thousands of documents.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(greatest(len(w) - 4, 1))) AS i, w FROM t WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM p),
s AS (SELECT doc_id, count(*) AS n, list(g ORDER BY g) AS gs FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
d AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 10 * c.n >= 8 * (x.n + y.n - c.n)),
l AS (SELECT a, b FROM d UNION ALL SELECT b, a FROM d),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS m FROM r GROUP BY a), e AS (SELECT gs, count(*) AS n FROM s GROUP BY gs)
SELECT t.doc_id, least(t.doc_id, coalesce(m, t.doc_id)) AS class_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(e.n, 1)::BIGINT AS n_copies, t.doc_id <= coalesce(m, t.doc_id) AS kept
FROM t LEFT JOIN n ON n.a = t.doc_id LEFT JOIN m ON m.a = t.doc_id LEFT JOIN s ON s.doc_id = t.doc_id LEFT JOIN e ON e.gs = s.gs
"""
