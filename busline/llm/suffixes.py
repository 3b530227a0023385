"""Suffix-array dedup over bytes: longest previous factors find what also starts earlier, and the first copy stays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.llm.common import bounded_batches, map_groups, materialized, mixed

#: Bytes of a string that counts as repeated, and lengths of the pieces of a string by whose least hash suffixes are dealt to groups: the
#: first, and the one that replaces it where too many bytes share one. Powers of two of 8 or more.
WINDOW = 100
PIECES = (32, 64)
#: Bytes of different contexts that one group's suffixes are sorted from, and windows that a context has at most.
GROUP_BYTES, RUN = 2 << 20, 4096
#: Bytes of text that are hashed at a time, bytes of text a bucket of hashes stands for, and leaders a task holds before it sorts them.
SLICE, BUCKET, HELD = 256 << 10, 16 << 20, 400_000
#: A place is a document and a byte in it: doc_id times this, plus the byte.
STEP = 1 << 33

_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)


def piece_hashes(data: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each byte on: eight bytes as they are, mixed, then doubled."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    h, width = mixed(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) + _MIX), 8
    while width < size:
        h = h[:-width] * _MIX ^ np.roll(h, -width)[:-width] + (h[:-width] >> _U(32))
        h ^= h >> _U(29)
        width *= 2
    return mixed(h)[:n]


def _spread(v: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """The least (or largest) of each `span` values side by side, by doubling."""
    width = 1
    while width < span:
        step = min(width, span - width)
        v = pick(v[: len(v) - step], v[step:])
        width += step
    return v


class Windows:
    """The windows of parts of texts, side by side in `data`; part i has the bytes begin[i] to begin[i + 1].

    least has the least piece hash of each window, 0 where a window would cross the end of its part. Equal windows
    have equal ones, so they bring all equal windows together.
    """

    def __init__(self, parts: list[bytes], window: int, size: int):
        self.data, self.span = b"".join(parts), window - size + 1
        self.begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.hashes = np.maximum(piece_hashes(self.data, size), _U(1))
        self.least = _spread(self.hashes, self.span, np.minimum) if len(self.data) >= window else np.zeros(0, _U)
        for end in self.begin[1:].tolist():
            self.least[max(end - window + 1, 0) : end] = 0

    def leaders(self) -> np.ndarray:
        """Bytes at which a piece begins that is the least of some window: two equal windows have one each, at different bytes."""
        rim = np.zeros(self.span - 1, _U)
        return np.flatnonzero((_spread(np.concatenate([rim, self.least, rim]), self.span, np.maximum) == self.hashes)) if len(self.least) else np.zeros(0, np.int64)

    def runs(self, most: int = RUN) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and numbers of windows side by side that have one least hash, `most` at most."""
        new = np.ones(len(self.least), bool)
        new[1:] = self.least[1:] != self.least[:-1]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(self.least)))
        at, count = at[self.least[at] > 0], count[self.least[at] > 0]
        if len(count) and count.max() > most:
            cuts = -(-count // most)
            k = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            at, count = np.repeat(at, cuts) + k * most, np.minimum(np.repeat(count, cuts) - k * most, most)
        return at, count


def parted(texts: list[bytes | None], window: int, most: int = SLICE) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Parts of texts, about `most` bytes at a time, with the text and the byte that each begins at.

    A long text is cut into parts that overlap by a window less a byte, so that each of its windows is in one part.
    """
    parts, owner, offset, held = [], [], [], 0
    for i, raw in enumerate(texts):
        for at in range(0, len(raw or b"") - window + 1, most):
            part = raw[at : at + most + window - 1]
            if held and held + len(part) > most:
                yield parts, owner, offset
                parts, owner, offset, held = [], [], [], 0
            parts.append(part)
            owner.append(i)
            offset.append(at)
            held += len(part)
    if parts:
        yield parts, owner, offset


def longest_previous(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix: the longest prefix that it has in common with a suffix at an earlier place.

    Suffixes stand in lexical order; place says where each stands in the text, common how long a prefix each shares with
    the one before it (0 for the first). The nearest suffixes before and after with a smaller place have the longest; both are found by
    halving steps over blocks whose smallest place and shortest common prefix are known, in a logarithmic number of rounds.
    """
    n = len(place)
    longest = np.zeros(n, np.int64)
    for turned in (False, True):
        # Backwards the prefix shared with the next suffix takes the place of that shared with the one before.
        p = place[::-1] if turned else place
        c = np.concatenate([[0], common[:0:-1]]) if turned and n else common
        least, shared = [p], [c]  # of 2 ** k suffixes that end at each: smallest place, and shortest prefix shared with the one before
        while 2 << (len(least) - 1) <= n:
            w = 1 << (len(least) - 1)
            for rows in (least, shared):
                rows.append(np.concatenate([rows[-1][:w], np.minimum(rows[-1][w:], rows[-1][:-w])]))
        # Walk to the nearest smaller place: over a block whose places are all larger, the prefix shrinks to the block's shortest.
        at, length = np.arange(n) - 1, c.copy()
        for k in range(len(least) - 1, -1, -1):
            w = 1 << k
            go = np.flatnonzero(at >= w - 1)
            go = go[least[k][at[go]] > p[go]]
            length[go] = np.minimum(length[go], shared[k][at[go]])
            at[go] -= w
        found = np.where(at >= 0, length, 0)
        longest = np.maximum(longest, found[::-1] if turned else found)
    return longest


def suffix_order(data: bytes, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that begin at `start`, as far as `depth` bytes tell, and what each has in common with the one before it."""
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), depth)[start]
    order = np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")
    rows = rows[order]
    apart = rows[1:] != rows[:-1]
    same = np.where(apart.any(axis=1), apart.argmax(axis=1), depth) if len(rows) else np.zeros(0, np.int64)
    return order, np.concatenate([[0], same]).astype(np.int64)[: len(rows)]


def earlier(contexts: list[bytes], doc: np.ndarray, start: np.ndarray, window: int) -> list[np.ndarray]:
    """Of each context which of its windows also start at an earlier place, by (doc, start), in some of the contexts."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    n = size - window + 1
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + inside
    order, common = suffix_order(b"".join(contexts), at, window)
    place = np.empty(len(at), np.int64)
    place[np.lexsort((np.repeat(start, n) + inside, np.repeat(doc, n)))] = np.arange(len(at))
    again = np.empty(len(at), bool)
    again[order] = longest_previous(place[order], common) >= window
    return np.split(again, np.cumsum(n)[:-1])


def ranges(on: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]]))).reshape(-1, 2)


def _key(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


_FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("sha", T.BinaryType()),
    T.StructField("bucket", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("known", T.BinaryType()),
])


def _packed(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"doc_id": pa.int64(), "key": pa.int64(), "n_bytes": pa.int64(), "sha": pa.binary(), "bucket": pa.int32(), "hashes": pa.binary(), "docs": pa.binary(), "known": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), kinds[c]) for c in kinds], names=list(kinds))


def _by_doc(docs: np.ndarray, hashes: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The hashes of each document, packed."""
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    begin = np.flatnonzero(np.diff(docs, prepend=docs[:1] - 1)) if len(docs) else np.zeros(0, np.int64)
    return docs[begin].tolist(), [h.tobytes() for h in np.split(hashes, begin[1:])] if len(docs) else []


def _scan(docs: DataFrame, window: int, size: int, buckets: int) -> DataFrame:
    """Rows of _FOUND of three kinds from one pass over the texts, without a shuffle.

    With sha: a document's key (64 bits of its SHA-256), length and SHA-256. With doc_id and hashes alone: hashes of leaders that the document shares
    with others of the same task. With bucket: hashes of leaders packed by bucket, each once a task, with a document that has it
    and whether it is known to be shared; what is shared between tasks is found where buckets meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: dict[bytes, int] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            h, d = np.concatenate(hashes), np.concatenate(owners)
            hashes.clear(), owners.clear(), seen.clear()
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            begin = np.flatnonzero(first)
            many = np.diff(np.append(begin, len(h))) > 1
            shared = np.repeat(many, np.diff(np.append(begin, len(h))))
            names, packs = _by_doc(d[shared], h[shared])
            if names:
                yield _packed({"doc_id": names, "hashes": packs})
            h, d = h[begin], d[begin]
            # Sorted hashes fall into ascending buckets by their upper bits.
            bucket = ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            packs = [[x.tobytes() for x in np.split(v, cut[1:])] for v in (h, d, many)]
            yield _packed({"bucket": bucket[cut].tolist(), "hashes": packs[0], "docs": packs[1], "known": packs[2]})

        for batch in batches:
            doc, texts = batch.column(0).to_pylist(), [v.as_py() or b"" for v in batch.column(1)]
            sha = [hashlib.sha256(t).digest() for t in texts]
            yield _packed({"doc_id": doc, "key": list(map(_key, sha)), "n_bytes": list(map(len, texts)), "sha": sha})
            # Of equal texts the one of smallest doc_id stands for all, so within a task others need no leaders.
            for i in sorted(range(len(doc)), key=lambda i: (doc[i] is None, doc[i])):
                if doc[i] is None or seen.get(sha[i], doc[i] + 1) <= doc[i]:
                    texts[i] = b""
                else:
                    seen[sha[i]] = doc[i]
            for parts, owner, _ in parted(texts, window):
                w = Windows(parts, window, size)
                at = w.leaders()
                hashes.append(w.hashes[at])
                owners.append(np.array([doc[i] for i in owner], np.int64)[np.searchsorted(w.begin, at, "right") - 1])
            if sum(map(len, hashes)) > HELD:
                yield from handed()
        if hashes:
            yield from handed()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, _FOUND)


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of whole buckets (bucket, hashes, docs, known) the hashes that stand in several rows or are known, for documents that don't know."""
    h = np.frombuffer(b"".join(pdf["hashes"]), _U)
    d, known = np.frombuffer(b"".join(pdf["docs"]), np.int64), np.frombuffer(b"".join(pdf["known"]), bool)
    order = np.argsort(h, kind="stable")
    h, d, known = h[order], d[order], known[order]
    begin = np.flatnonzero(np.diff(h, prepend=h[:1] ^ _U(1)))
    size = np.diff(np.append(begin, len(h)))
    told = np.repeat((size > 1) | np.logical_or.reduceat(known, begin), size) & ~known
    docs, packs = _by_doc(d[told], h[told])
    return pd.DataFrame({"doc_id": docs, "hashes": packs})


_CONTEXT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("context", T.BinaryType())])


def _contexts(chosen: DataFrame, window: int, size: int) -> DataFrame:
    """Rows of _CONTEXT: n windows side by side from byte start on that have the least piece h, and a digest of the bytes that they cover.

    The bytes themselves stand in the first of equal rows alone, by place, among those that a task has at hand. chosen has doc_id, text, keys (of the texts that
    count) and hashes (packed, of which at least one document else has each).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, texts, keys, hashes = batch.column(0).to_pylist(), [v.as_py() or b"" for v in batch.column(1)], batch.column(2).to_pylist(), batch.column(3).to_pylist()
            key = [_key(hashlib.sha256(t).digest()) for t in texts]
            texts = [t if k in own else b"" for t, k, own in zip(texts, key, keys)]
            made: list[list] = [[] for _ in _CONTEXT]
            for parts, owner, offset in parted(texts, window):
                w = Windows(parts, window, size)
                wanted = np.unique(np.concatenate([np.frombuffer(b"".join(hashes[i]), _U) for i in dict.fromkeys(owner)]))
                at, count = w.runs()
                h = w.least[at]
                near = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                at, count, h = (x[wanted[near] == h] for x in (at, count, h))
                part = np.searchsorted(w.begin, at, "right") - 1
                context = [w.data[a : a + n + window - 1] for a, n in zip(at.tolist(), count.tolist())]
                of = np.array(owner)[part].tolist()
                for held, more in zip(made, ([doc[i] for i in of], [key[i] for i in of], (at - w.begin[part] + np.array(offset)[part]).tolist(), count.tolist(), h.view(np.int64).tolist(), map(_digest, context), context)):
                    held.extend(more)
            order = sorted(range(len(made[0])), key=list(zip(made[0], made[2])).__getitem__)
            first: set[bytes] = set()
            for i in order:
                if made[5][i] in first:
                    made[6][i] = None
                first.add(made[5][i])
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=_CONTEXT.fieldNames())

    return chosen.select("doc_id", F.col("text").cast("binary"), "keys", "hashes").mapInArrow(run, _CONTEXT)


_GONE = "h bigint, same binary, place decimal(38,0), gone array<struct<at: int, n: int>>"


def _solver(window: int, most: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each context its first place, and which windows there also start earlier. Groups of a frame are handled together up to `most` bytes."""
        places = [int(p) for p in pdf["place"]]
        doc, start = np.array([p // STEP for p in places], np.int64), np.array([p % STEP for p in places], np.int64)
        order = np.lexsort((start, doc))
        order = order[~pdf["same"].iloc[order].duplicated().to_numpy()]
        order = order[np.argsort(pdf["h"].to_numpy()[order], kind="stable")]
        pdf, doc, start = pdf.iloc[order], doc[order], start[order]
        context, gone, h = pdf["context"].tolist(), [], pdf["h"].to_numpy()
        held, at = np.cumsum(np.fromiter(map(len, context), np.int64, len(context))), 0
        while at < len(context):
            to = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + most)))
            while to < len(context) and h[to] == h[to - 1]:
                to += 1
            for on in earlier(context[at:to], doc[at:to], start[at:to], window):
                gone.append([{"at": a, "n": b - a} for a, b in ranges(on).tolist()])
            at = to
        return pdf[["h", "same", "place"]].assign(gone=gone)

    return solve


_SUB = T.StructType([T.StructField("up", T.LongType()), T.StructField("up_same", T.BinaryType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("place", T.DecimalType(38, 0)), T.StructField("h", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("context", T.BinaryType())])


def _dealt_anew(contexts: DataFrame, window: int, size: int) -> DataFrame:
    """Contexts cut by the least of their longer pieces: rows of _SUB; up and up_same name what they were cut from, at their windows' place in it.

    With size 0 each window is a row of its own, named by its digest, without context.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up, up_same, place, context = (batch.column(i).to_pylist() for i in range(4))
            begin = 0
            while begin < len(context):
                rows, held, end = [], 0, begin
                while end < len(context) and held < SLICE:
                    held, end = held + len(context[end]), end + 1
                if size:
                    w = Windows(context[begin:end], window, size)
                    at, count = w.runs()
                    owner = np.searchsorted(w.begin, at, "right") - 1
                    for i, a, n, h in zip((begin + owner).tolist(), at.tolist(), count.tolist(), w.least[at].view(np.int64).tolist()):
                        own, part = a - int(w.begin[i - begin]), w.data[a : a + n + window - 1]
                        rows.append((up[i], up_same[i], own, n, place[i] + own, h, _digest(part), part))
                else:
                    for i in range(begin, end):
                        for a in range(len(context[i]) - window + 1):
                            rows.append((up[i], up_same[i], a, 1, place[i] + a, 0, _digest(context[i][a : a + window]), None))
                begin = end
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_SUB.fieldNames())

    return contexts.select("h", "same", F.col("place").cast("decimal(38,0)"), "context").mapInArrow(run, _SUB)


def _gone(contexts: DataFrame, window: int, sizes: tuple[int, ...], group_bytes: int) -> DataFrame:
    """Rows of _GONE: of each of different contexts (h, same, place, context) its first place and the windows there that also start at an earlier place.

    Equal contexts may stand in several rows, a row a task. The suffixes of an h are sorted in one group. Where its different contexts take more than group_bytes they
    are cut by the least of longer pieces and dealt anew, up to whole windows, of which the first place alone is asked.
    """
    sized = contexts.groupBy("h", "same").agg(F.max(F.length("context")).alias("bytes")).groupBy("h").agg(F.sum("bytes").alias("bytes"))
    heavy = materialized(sized.where(F.col("bytes") > group_bytes).select("h"), "heavy")
    none = heavy.isEmpty()
    light = contexts if none else contexts.join(heavy, "h", "left_anti")
    # The smaller a frame the better it fits caches; a group of more bytes is handled whole.
    solved = map_groups(light.select("h", "same", F.col("place").cast("decimal(38,0)"), "context"), ["h"], _solver(window, min(group_bytes, 256 << 10)), _GONE)
    if none:
        return solved
    size = sizes[0] if sizes else 0
    crowded = contexts.join(heavy, "h").groupBy("h", "same", "context").agg(F.min("place").alias("place"))
    parts = materialized(_dealt_anew(crowded, window, size), "dealt", "zstd")
    if size:
        deeper = _gone(parts.groupBy("h", "same", "context").agg(F.min("place").alias("place")), window, sizes[1:], group_bytes)
    else:
        deeper = parts.groupBy("h", "same").agg(F.min("place").alias("place")).withColumn("gone", F.array().cast("array<struct<at: int, n: int>>"))
    deeper = materialized(deeper.withColumnRenamed("place", "first"), "deeper", "zstd")
    whole = F.array(F.struct(F.col("at").alias("at"), F.col("n").alias("n")))
    moved = F.transform("gone", lambda g: F.struct((g["at"] + F.col("at")).alias("at"), g["n"].alias("n")))
    joined = parts.drop("context").join(deeper, ["h", "same"]).select("up", "up_same", (F.col("place") - F.col("at")).alias("place"), F.when(F.col("place") == F.col("first"), moved).otherwise(whole).alias("gone"))
    joined = joined.groupBy(F.col("up").alias("h"), F.col("up_same").alias("same")).agg(F.min("place").cast("decimal(38,0)").alias("place"), F.flatten(F.collect_list("gone")).alias("gone"))
    return solved.unionByName(joined)


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_REMOVED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", _SPAN)])


def _removed(docs: DataFrame, window: int) -> DataFrame:
    """Rows of _REMOVED: documents (doc_id, text, key, hits) without the bytes of the windows that hits (first, n) names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, text, key, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                raw = text.as_py() or b""
                if _key(hashlib.sha256(raw).digest()) != key:
                    continue  # another text under the same doc_id
                at, n = (hits.values.field(c).to_numpy() for c in ("at", "n"))
                cover = np.zeros(len(raw) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.subtract.at(cover, at + n + window - 1, 1)
                gone = ranges(np.cumsum(cover[:-1]) > 0)
                kept, end = hashlib.sha256(), 0
                for a, b in gone.tolist():
                    kept.update(memoryview(raw)[end:a])
                    end = b
                kept.update(memoryview(raw)[end:])
                rows.append((d, key, int((gone[:, 1] - gone[:, 0]).sum()), kept.hexdigest(), [{"start": a, "end": b} for a, b in gone.tolist()]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=_REMOVED.fieldNames())

    return docs.select("doc_id", F.col("text").cast("binary"), "key", "hits").mapInArrow(run, _REMOVED)


def remove_earlier(docs: DataFrame, window: int = WINDOW, sizes: tuple[int, ...] = PIECES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: bytes covered by a string of `window` bytes that also starts earlier.

    Earlier is a smaller doc_id, or the same document and an earlier byte; copies may overlap, and all are judged on the input. Texts are bytes
    of UTF-8. Suffixes are dealt to groups by the least hash among the pieces of sizes[0] bytes in their first `window` bytes, so
    that suffixes with equal windows meet and neighbours travel together, as a context. Only leaders that stand at two bytes or more are
    followed; tasks hand on each hash once. Equal contexts are one with its first place, and a task sends the bytes of one alone. In a group the suffixes of the
    different contexts are sorted, and the previous and next smaller places in that order give each one's longest previous factor: where that is
    `window` bytes or more, the window goes. Groups whose contexts take more than group_bytes are dealt anew by longer pieces, at last by whole
    windows, so no group grows with the input. A document whose text equals an earlier one's goes whole.

    Null texts are empty; texts shorter than a window lose nothing. Rows with a null doc_id lose nothing and nothing is lost to them. Different texts that
    share a doc_id count as one document: of equal strings in them the smallest byte stays, and equal bytes stay both; rows equal in both are treated alike. An empty table gives no
    rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 2000, 8 << 20)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = materialized(_scan(docs, window, sizes[0], max(1, math.ceil(total / BUCKET))), "found", "zstd")
    every = found.where("sha IS NOT NULL").select("doc_id", "key", "n_bytes", "sha")
    repeated = every.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    every = every.join(materialized(repeated, "repeated"), "sha", "left")
    reps = every.where("doc_id IS NOT NULL AND n_bytes >= {} AND (first IS NULL OR doc_id = first)".format(window)).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    met = map_groups(found.where("bucket IS NOT NULL").select("bucket", "hashes", "docs", "known"), ["bucket"], _shared, "doc_id bigint, hashes binary")
    told = met.unionByName(found.where("bucket IS NULL AND sha IS NULL").select("doc_id", "hashes"))
    wanted = told.groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes")).join(reps, "doc_id")
    named = docs.where("doc_id IS NOT NULL")
    contexts = materialized(_contexts(named.join(wanted, "doc_id"), window, sizes[0]), "contexts", "zstd")

    place = (F.col("doc_id").cast("decimal(20,0)") * F.lit(STEP) + F.col("start")).cast("decimal(38,0)")
    gone = _gone(contexts.where("context IS NOT NULL").select("h", "same", place.alias("place"), "context"), window, sizes[1:], group_bytes)
    gone = materialized(gone.withColumnRenamed("place", "first"), "gone", "zstd")
    hits = contexts.select("doc_id", "key", "start", "n", "h", "same").join(gone, ["h", "same"])
    own = F.transform("gone", lambda g: F.struct((g["at"] + F.col("start")).alias("at"), g["n"].cast("bigint").alias("n")))
    whole = F.array(F.struct(F.col("start").alias("at"), F.col("n").cast("bigint").alias("n")))
    hits = hits.select("doc_id", "key", F.when(place == F.col("first"), own).otherwise(whole).alias("hit")).where(F.size("hit") > 0)
    hits = hits.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("hit")).alias("hits"))
    removed = _removed(named.join(hits, "doc_id"), window).dropDuplicates(["doc_id", "key"])

    out = every.join(removed, ["doc_id", "key"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= window)
    spans = F.when(copy, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast(_SPAN)))
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"), F.size(spans).cast("bigint").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"), spans.alias("spans"),
    )


#: Every window of the corpus by its own bytes; within reach of SQL for a corpus of some megabytes.
ORACLE = rf"""
WITH x AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT r, doc_id, unnest(range(n - {WINDOW - 1})) AS i, b FROM x WHERE n >= {WINDOW}),
k AS (SELECT r, doc_id, i, b[i + 1:i + {WINDOW}] AS h FROM w),
f AS (SELECT h, min((doc_id, i)) AS f FROM k GROUP BY h HAVING count(*) > 1),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM k JOIN f USING (h) WHERE f < (doc_id, i)),
s AS (SELECT r, i, sum((p IS NULL OR i - p > {WINDOW})::INT) OVER (PARTITION BY r ORDER BY i) AS s FROM g),
m AS (SELECT r, s, min(i) AS a, max(i) + {WINDOW} AS z FROM s GROUP BY r, s),
c AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM m),
j AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS head, max(z) AS z FROM c JOIN x USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(head || hex(b[z + 1:n])) END) AS kept_sha256 FROM x LEFT JOIN j USING (r)
"""
