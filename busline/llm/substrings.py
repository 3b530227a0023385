"""Substring dedup over word sequences with prefix-partitioned suffix subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.llm.common import Words, append_from_text, bounded_batches, map_groups, materialized, mixed, slices

#: Words of a window, and the lengths of the prefixes by which suffixes are dealt to subtrees: the first, and those that
#: replace it where too many bytes share one.
WINDOW = 50
PREFIXES = (16, 24, 32, 40)
#: Bytes of different contexts that one subtree may be built from.
GROUP_BYTES = 2 << 20

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))


def leaders(gram: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` entries the index of its least one, the leftmost of equals, by doubling."""
    at, width = np.arange(len(gram)), 1
    while width < span:
        step = min(width, span - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(gram[left] <= gram[right], left, right)
        width += step
    return at


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, _U), np.full(max(n - 1, 0), base)]))[:n]


class Suffixes:
    """The windows of texts, cut into runs that are dealt out together.

    The leader of a window is the place of the least hash among the prefixes of `k` words inside it. Windows with equal words have
    their leader at the same place and with the same prefix, so dealing windows out by their leader's prefix brings all equal
    windows together; windows with one leader stand side by side and are a run. For k = window each window is a run.
    """

    def __init__(self, texts: list, window: int):
        self.words, self.window, self.gram = Words(texts), window, {}
        self.long = np.flatnonzero(np.diff(self.words.first) >= window).tolist()
        h = mixed(self.words.hash ^ _U(0x5851F42D4C957F2D))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(h * powers(_STEP, len(h)))])
        self.back = powers(_BACK, len(h) + 1)

    def runs(self, i: int, k: int, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of text i's windows (those active): first words, numbers of windows, leaders and their prefixes, and each window's prefix."""
        if k not in self.gram:
            self.gram[k] = self.words.grams(k)
        a, b = int(self.words.first[i]), int(self.words.first[i + 1])
        lead = a + leaders(self.gram[k][a : b - k + 1], self.window - k + 1)
        new = np.concatenate([[True], lead[1:] != lead[:-1]])
        if active is not None:
            new[1:] |= active[1:] != active[:-1]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(lead)))
        if active is not None:
            at, count = at[active[at]], count[active[at]]
        prefix = self.gram[k][lead].view(np.int64)
        return a + at, count, lead[at], prefix[at], prefix

    def spans(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Second, independent hashes of the words that runs cover, and how many bytes these take."""
        last = start + count + self.window - 1
        return mixed((self.sums[last] - self.sums[start]) * self.back[start] + (last - start).astype(_U)), self.words.end[last - 1] - self.words.start[start]

    def active(self, i: int, ks: list[int], heavy: np.ndarray) -> np.ndarray:
        """Which of text i's windows have a heavy prefix at every length of ks."""
        on = np.ones(int(self.words.first[i + 1] - self.words.first[i]) - self.window + 1, bool)
        for k in ks:
            if on.any():
                on &= np.isin(self.runs(i, k)[4], heavy)
        return on


def identity(raw: bytes) -> tuple[int, int, bytes, bytes]:
    """Of a text's words joined by one space: 64 bits of their SHA-256, how many they are, the joined words, the SHA-256."""
    parts = raw.split()
    whole = b" ".join(parts)
    sha = hashlib.sha256(whole).digest()
    return int.from_bytes(sha[:8], "little", signed=True), len(parts), whole, sha


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _profiles(docs: DataFrame) -> DataFrame:
    """docs with words (64 bits of whole, to tell texts of one doc_id apart), n_words and whole (SHA-256 of the joined words)."""
    fields = T.StructType([T.StructField("words", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("whole", T.BinaryType())])

    def start():
        def run(texts: list) -> list[list]:
            got = [identity(_raw(t)) for t in texts]
            return [[g[k] for g in got] for k in (0, 1, 3)]

        return run

    return append_from_text(docs, start, fields).drop("text")


_PREFIX_ROWS = "prefix bigint, doc_id bigint, words bigint, same bigint, bytes bigint"


def _prefixes(docs: DataFrame, window: int, ks: list[int]) -> DataFrame:
    """The runs of documents at the prefix length ks[-1], where earlier lengths are heavy: rows of _PREFIX_ROWS.

    docs has doc_id and text and, beyond the first length, words and heavy (prefixes of earlier lengths).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            wanted, heavy = (batch.column(k).to_pylist() for k in (2, 3)) if batch.num_columns > 2 else (None, None)
            for a, b in slices(texts):
                s, parts = Suffixes(texts[a:b], window), []
                for i in s.long:
                    key = identity(_raw(texts[a + i]))[0]
                    if wanted and wanted[a + i] != key:
                        continue  # another text under the same doc_id
                    active = s.active(i, ks[:-1], np.array(heavy[a + i], np.int64)) if wanted else None
                    start, count, _, prefix, _ = s.runs(i, ks[-1], active)
                    same, size = s.spans(start, count)
                    n = len(start)
                    parts.append((prefix, np.full(n, doc[a + i]), np.full(n, key), same.view(np.int64), size))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)], names=[f.split()[0] for f in _PREFIX_ROWS.split(", ")])

    return docs.mapInArrow(run, _PREFIX_ROWS)


_CONTEXTS = "doc_id bigint, words bigint, start bigint, prefix bigint, lead int, count int, context string"


def _contexts(docs: DataFrame, window: int, ks: list[int]) -> DataFrame:
    """The suffixes of documents under shared prefixes: rows of _CONTEXTS.

    A row stands for `count` windows side by side from word `start` on, context being the words they cover and lead
    where in it the leader's prefix begins. Windows that are heavy at every length have a row each, whose prefix is the
    hash of all their words (lead -1) and whose context is a second hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, texts, key, light, heavy = (batch.column(i).to_pylist() for i in range(5))
            for a, b in slices(texts):
                s, rows = Suffixes(texts[a:b], window), []
                words = s.words
                for i in s.long:
                    if identity(_raw(texts[a + i]))[0] != key[a + i]:
                        continue  # another text under the same doc_id
                    base, d, w = int(words.first[i]), doc[a + i], key[a + i]
                    shared, deep, active = np.array(light[a + i], np.int64), np.array(heavy[a + i], np.int64), None
                    for k in ks:
                        start, count, lead, prefix, each = s.runs(i, k, active)
                        for j in np.flatnonzero(np.isin(prefix, shared)).tolist():
                            x, n = int(start[j]), int(count[j])
                            covered = b" ".join(words.data[words.start[x] : words.end[x + n + window - 2]].split())
                            rows.append((d, w, x - base, int(prefix[j]), int(lead[j]) - x, n, covered.decode("utf-8", "surrogatepass")))
                        on = np.isin(each, deep)
                        active = on if active is None else active & on
                        if not active.any():
                            break
                    else:
                        start, count, _, prefix, _ = s.runs(i, window, active)
                        second, _ = s.spans(start, count)
                        rows += [(d, w, x - base, p, -1, 1, str(h)) for x, p, h in zip(start.tolist(), prefix.tolist(), second.tolist())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _CONTEXTS.split(", ")])

    return docs.select("doc_id", "text", "words", "light", "heavy").mapInArrow(run, _CONTEXTS)


class Subtree:
    """The suffixes at some places of texts as a suffix tree: in lexical order, with what neighbours have in common.

    Ranks of the first 1, 2, 4 ... words of every suffix come from doubling; a suffix that ends sooner comes first. The order
    sorts by the longest, and a common prefix is read off by comparing ranks from the longest down, so that its length is exact up
    to twice the depth asked for.
    """

    def __init__(self, words: Words, places: np.ndarray, depth: int):
        n = len(words.hash)
        end = np.repeat(words.first[1:], np.diff(words.first))
        ranks, width = [np.unique(words.hash, return_inverse=True)[1].astype(np.int64) + 1], 1
        while width < depth:
            ahead = np.arange(n) + width
            second = np.where(ahead < end, ranks[-1][np.minimum(ahead, n - 1)], 0)
            ranks.append(np.unique(ranks[-1] * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1)
            width *= 2
        self.order = places[np.argsort(ranks[-1][places], kind="stable")]
        a, b = self.order[:-1], self.order[1:]
        common = np.zeros(len(a), np.int64)
        for r in reversed(ranks):
            x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
            common += width * ((r[x] == r[y]) & (a + common + width <= end[a]) & (b + common + width <= end[b]))
            width //= 2
        #: Common words of each suffix in order with the one before it.
        self.common = np.concatenate([[0], common]) if len(self.order) else common

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix in order the number of the topmost node `depth` words deep or more that it hangs from: suffixes
        under one node repeat at least that many words, and no others do."""
        return np.cumsum(self.common < depth) - 1


def _earliest(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each context the smallest doc_id that each of its windows starts in, from the nodes of its prefix's subtree."""
        out: list = [None] * len(pdf)
        doc, lead, count, prefix, text = pdf["doc"].to_numpy(), pdf["lead"].to_numpy(), pdf["count"].to_numpy(), pdf["prefix"].to_numpy(), pdf["context"].tolist()
        for i in np.flatnonzero(lead < 0).tolist():
            out[i] = [int(doc[i])]
        # One subtree a prefix. A frame's small groups are handled as one, as their suffixes part before depth 50 anyway.
        deep, at = np.flatnonzero(lead >= 0), 0
        while at < len(deep):
            held = np.cumsum(np.fromiter((len(text[i]) for i in deep[at : at + 65536]), np.int64))
            to = at + max(1, int(np.searchsorted(held, GROUP_BYTES)))
            while to < len(deep) and prefix[deep[to]] == prefix[deep[to - 1]]:
                to += 1
            part, at = deep[at:to], to
            words = Words([text[i] for i in part])
            n = count[part]
            place = np.repeat(words.first[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            tree = Subtree(words, place, window)
            owner = np.zeros(len(words.hash), np.int64)
            owner[place] = np.repeat(doc[part], n)
            node, docs = tree.nodes(window), owner[tree.order]
            least = np.minimum.reduceat(docs, np.flatnonzero(np.diff(node, prepend=-1)))
            owner[tree.order] = least[node]
            for i, found in zip(part.tolist(), np.split(owner[place], np.cumsum(n)[:-1])):
                out[i] = found
        return pd.DataFrame({c: pdf[c] for c in ("prefix", "lead", "count", "same", "also")} | {"earliest": out})

    return run


def _removed(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, words, n_removed, kept_sha256, spans (start, end of removed runs of words) of documents with removed windows."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, texts, keys, hits = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for d, t, k, h in zip(doc, texts, keys, hits):
                key, n, whole, _ = identity(_raw(t))
                if key != k:
                    continue
                cover = np.zeros(n + 1, np.int64)
                for hit in h:
                    gone = hit["start"] + np.flatnonzero(np.array(hit["earliest"], np.int64) < d)
                    cover[gone] += 1
                    np.subtract.at(cover, gone + window, 1)
                gone = np.cumsum(cover[:n]) > 0
                parts = whole.split(b" ")
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                rows.append((d, k, int(gone.sum()), hashlib.sha256(b" ".join([p for p, g in zip(parts, gone.tolist()) if not g])).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in turn]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields.fieldNames())

    return docs.select("doc_id", "text", "words", "hits").mapInArrow(run, fields)


def _dealt(docs: DataFrame, reps: DataFrame, window: int, ks: list[int], group_bytes: int) -> DataFrame:
    """doc_id, words, light, heavy of the documents with a shared prefix: the prefixes whose subtrees they take part in,
    and those that longer ones replace."""
    rows, parts = materialized(_prefixes(docs, window, ks[:1]), "prefixes"), []
    for n in range(1, len(ks) + 1):
        shared = rows.groupBy("prefix").agg(F.min("words").alias("a"), F.max("words").alias("b")).where("a <> b").select("prefix")
        found = rows.join(materialized(shared, "shared"), "prefix")
        found = materialized(found.join(reps, ["doc_id", "words"]) if n == 1 else found, "found")
        # Equal contexts are joined before a subtree is built, so they count once.
        size = found.groupBy("prefix", "same").agg(F.max("bytes").alias("bytes")).groupBy("prefix").agg(F.sum("bytes").alias("bytes"))
        heavy = materialized(size.where(F.col("bytes") > group_bytes).select("prefix", F.lit(True).alias("heavy")), "heavy")
        parts.append(found.join(heavy, "prefix", "left").select("doc_id", "words", "prefix", F.coalesce("heavy", F.lit(False)).alias("heavy")))
        if n == len(ks) or heavy.isEmpty():
            break
        deep = parts[0]
        for p in parts[1:]:
            deep = deep.unionByName(p)
        deep = deep.where("heavy").groupBy("doc_id", "words").agg(F.collect_set("prefix").alias("heavy"))
        longer = docs.join(deep, "doc_id").select("doc_id", "text", "words", "heavy")
        rows = materialized(_prefixes(longer, window, ks[: n + 1]), "prefixes")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    either = lambda on: F.collect_set(F.when(on, F.col("prefix")))
    return every.groupBy("doc_id", "words").agg(either(~F.col("heavy")).alias("light"), either(F.col("heavy")).alias("heavy"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans: words covered by a window that also starts in a smaller doc_id.

    Suffixes (word positions) are dealt out by prefixes of variable length: those of a window by the least of its
    prefixes of prefixes[0] words, and where the different contexts under one take more than group_bytes, by the least of
    the next length, up to all words of the window. Only prefixes that stand in documents with different words are followed. Equal
    contexts are joined before they are shuffled. The suffixes of a prefix are sorted into a subtree, of which the
    topmost nodes `window` words deep or more are the repeats: each takes the smallest doc_id among its leaves. A document whose
    words all equal an earlier one's (by SHA-256) is removed whole and needs no suffixes.

    Null and empty texts have no words; texts shorter than a window lose nothing. Rows with a null doc_id are neither
    earlier nor later than others: they lose nothing and nothing is lost to them. Rows that share a doc_id don't take from
    each other. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    every = materialized(_profiles(docs), "profiles")
    repeated = every.where("doc_id IS NOT NULL").groupBy("whole").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    every = every.join(materialized(repeated.drop("n"), "repeated"), "whole", "left")
    reps = every.where("doc_id IS NOT NULL AND (first IS NULL OR doc_id = first)").select("doc_id", "words").distinct()

    named = docs.where("doc_id IS NOT NULL")
    dealt = _dealt(named, reps, window, list(prefixes), group_bytes)
    chosen = materialized(named.join(dealt, "doc_id"), "candidates")
    contexts = _contexts(chosen, window, list(prefixes)).withColumns({"same": F.xxhash64("context"), "also": F.xxhash64(F.lit(1), "context")})
    contexts = materialized(contexts, "contexts")
    key = ["prefix", "lead", "count", "same", "also"]
    distinct = contexts.groupBy(*key, "context").agg(F.min("doc_id").alias("doc"))
    earliest = map_groups(distinct, ["prefix"], _earliest(window), "prefix bigint, lead int, count int, same bigint, also bigint, earliest array<bigint>")
    hits = contexts.select("doc_id", "words", "start", *key).join(materialized(earliest, "earliest"), key).where(F.exists("earliest", lambda d: d < F.col("doc_id")))
    per_doc = hits.groupBy("doc_id", "words").agg(F.collect_list(F.struct("start", "earliest")).alias("hits"))
    removed = _removed(chosen.select("doc_id", "text", "words").join(per_doc, ["doc_id", "words"]), window).dropDuplicates(["doc_id", "words"])

    out = every.join(removed, ["doc_id", "words"], "left")
    whole = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= window)
    span = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, none).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("whole")))).alias("kept_sha256"),
        F.when(whole, span).otherwise(F.col("spans")).alias("spans"),
    )


#: Every window of the corpus by its own words; within reach of SQL for some thousands of documents.
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT r, doc_id, unnest(range(len(w) - {WINDOW - 1})) AS i, w FROM t WHERE len(w) >= {WINDOW}),
h AS (SELECT r, doc_id, i, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS h FROM k),
f AS (SELECT h, min(doc_id) AS f FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM h JOIN f USING (h) WHERE f < doc_id)),
x AS (SELECT r, unnest(range(len(w))) AS p, unnest(w) AS word FROM t),
o AS (SELECT x.r, count(*) AS n_words, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN g ON x.r = g.r AND x.p = g.p GROUP BY x.r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN o USING (r)
"""
