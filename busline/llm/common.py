"""What several operators of this subpackage share: shared storage, word arrays, grouped maps, components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from busline.sources import store

#: What counts as a word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64


#: The folder that driver and executors share, tables kept there between steps, and small tables dealt to all cores.
shared_dir, materialized, spread = store.shared_folder, store.stored, store.spread


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small table inside an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound what one Arrow batch holds, so that a run of very long texts does not arrive at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def slices(texts: list, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters each; one long text stands alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = _U(0x9E3779B97F4A7C15)
#: Bytes of a word that are mixed eight at a time; longer words are digested.
_SHORT = 16


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: multiply and xor-shift."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words:
    """The words of a list of texts as arrays: byte ranges in `data`, 64-bit hashes, and where each text's words start.

    Text i has the words first[i] to first[i + 1]. Null and empty texts have none. Words of up to 8 bytes and of one length have different hashes;
    up to 16 the first and last eight bytes are mixed in turn, which is not linear; longer ones have 64 bits of their BLAKE2b digest.
    """

    def __init__(self, texts: list):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.data = b"\n".join([*raw, b"\n" * 8])  # eight bytes may be read from each byte of a text
        buf = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        solid = np.ones(len(buf) + 2, np.int8)
        solid[0] = solid[-1] = 0
        np.logical_not(_SPACE[buf], out=solid[1:-1].view(bool))
        turn = np.diff(solid)
        self.start, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.first = np.searchsorted(self.start, begins)
        self.begins = begins
        size = self.end - self.start
        eight = np.ndarray((len(buf) - 7,), "<u8", self.data, strides=(1,))
        held = np.where(size < 8, (_U(1) << (_U(8) * np.minimum(size, 7).astype(_U))) - _U(1), ~_U(0))
        h = mixed(eight[self.start] & held ^ mixed(size.astype(_U)))
        more = np.flatnonzero(size > 8)
        h[more] = mixed(h[more] * _BASE ^ eight[self.end[more] - 8])
        for i in np.flatnonzero(size > _SHORT).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        self.size, self.hash = size, h

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; the last n - 1 entries mean nothing, nor do those that cross a text's end."""
        h, total = self.hash, np.zeros(len(self.hash), np.uint64)
        for k in range(n):
            total[: len(h) - k] = total[: len(h) - k] * _BASE + h[k:]
        return mixed(total)

    def text(self, a: int, b: int) -> str:
        """The words a to b - 1 with what stands between them."""
        return self.data[self.start[a] : self.end[b - 1]].decode("utf-8", "surrogatepass")


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, parts: int | None = None, also: list[str] | None = None) -> DataFrame:
    """Bring equal keys together and hand fn frames that hold whole groups only, many groups at a time.

    The rows of a group stand together, sorted by keys and `also`. For groups of bounded size: a task holds one Arrow
    batch and the group that its end cuts.
    """
    order = [*keys, *(also or [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf[keys].iloc[-1]
            same = np.ones(len(pdf), bool)
            for k in keys:
                same &= (pdf[k] == last[k]).to_numpy()
            if same.all():
                if held and not (held[-1][keys].iloc[-1] == last).all():
                    out = fn(pd.concat(held, ignore_index=True))
                    held = []
                    if out is not None and len(out):
                        yield out
                held.append(pdf)
                continue
            cut_at = len(pdf) - int(same.sum())
            out = fn(pd.concat([*held, pdf.iloc[:cut_at]], ignore_index=True))
            held = [pdf.iloc[cut_at:]]
            if out is not None and len(out):
                yield out
        if held:
            out = fn(pd.concat(held, ignore_index=True))
            if out is not None and len(out):
                yield out

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*order).mapInPandas(run, schema)


def group_bounds(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the groups of a frame sorted by keys start, and its length at the end."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(pdf))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: bigint) as rows (node, component), component being the smallest node.

    Alternates large-star and small-star steps, which keep the number of edges and need a logarithmic number of
    rounds; each round is cut by a reliable checkpoint. Nodes without an edge to another node are left out.
    """
    def star(e: DataFrame, both: bool) -> DataFrame:
        pairs = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if both else e
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = pairs.join(least, "a")
        if both:
            made = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            made = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return made.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = cut(star(star(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.sum("b")).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()


def append_from_text(df: DataFrame, start: Callable[[], Callable[[list], list[list]]], fields: T.StructType, text: str = "text") -> DataFrame:
    """df with the fields computed from a text column, in Arrow batches and without a shuffle.

    `start` is called once a task and returns the function from a list of texts (None for null) to one list a field.
    Columns of df that have the name of a field are replaced; all others pass unchanged, whatever they are.
    """
    bounded_batches(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c not in fields.fieldNames()])
    at, arrow = kept.columns.index(text), to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in batches:
            made = fn(batch.column(at).to_pylist())
            columns = [pa.array(x, f.type) for x, f in zip(made, arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *arrow.names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields.fields]))


#: Rows, and their summed weight, of a bucket that one block of pairs takes from each side.
CHUNK = 1024
MOST_WEIGHT = 1 << 21


def blocks(rows: DataFrame, key: list[str], weight: Column | None = None, chunk: int | None = None, most_weight: int | None = None) -> DataFrame:
    """rows of buckets with two rows or more, dealt to blocks (block_i, block_j, side): all pairs of a bucket meet in some block.

    A bucket is divided by a hash of doc_id into parts of about `chunk` rows and `most_weight` summed weight at most (a
    row that weighs more stands for itself); each pair of parts is a block, so that no task takes a whole bucket. A bucket of
    one part is a block of its own. Bucket sizes come from a grouped count that is summed before the shuffle. Rows and sizes are
    both shuffled, whatever Spark takes their size to be: exploded rows count as the table they come from, many times too small to be sent to the driver.
    """
    rows = rows.withColumn("__w", F.lit(0) if weight is None else weight)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"), F.sum("__w").alias("__all")).where("__n > 1")
    parts = F.least(F.col("__n"), F.ceil(F.greatest(F.col("__n") / (chunk or CHUNK), F.col("__all") / (most_weight or MOST_WEIGHT)))).cast("int")
    sized = rows.join(sizes.hint("merge"), key).withColumn("__parts", parts)
    mine = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.col("__parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    dealt = sized.withColumn("__mine", mine).withColumn("__other", other)
    dealt = dealt.withColumn("block_i", F.least("__mine", "__other")).withColumn("block_j", F.greatest("__mine", "__other"))
    return dealt.withColumn("side", F.when(F.col("__mine") <= F.col("__other"), 0).otherwise(1)).drop("__n", "__all", "__w", "__parts", "__mine", "__other")


def block_pairs(bounds: np.ndarray, same: np.ndarray, side: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i, j) of all blocks of a frame, in chunks of about `most`; rows stand sorted by block and side.

    `same` says for each row whether its block is one part, whose rows are all paired; else sides are paired with each other.
    """
    size = np.diff(bounds)
    if not len(size):
        return
    row, end = np.arange(bounds[-1]), np.repeat(bounds[1:], size)
    ones = np.repeat(np.add.reduceat(side, bounds[:-1]), size)
    first = np.where(same, row + 1, end - ones)
    count = np.where(same, end - row - 1, np.where(side == 0, ones, 0))
    upto, at = np.concatenate([[0], np.cumsum(count)]), 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        c = count[at:to]
        if c.any():
            yield np.repeat(row[at:to], c), np.arange(int(c.sum())) + np.repeat(first[at:to] - (upto[at:to] - upto[at]), c)
        at = to


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of linked rows in place; afterwards each row names the least row that it is linked with."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


#: What blocks return: counts (a, n, null) of what is linked with a, and edges (a, 0, b) that join what is linked.
LINKS = "a bigint, n bigint, b bigint"


def block_links(docs: np.ndarray, links: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    got, below = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
    a, n = np.concatenate([docs[got], docs[below]]), np.concatenate([links[got], np.zeros(len(below), np.int64)])
    b = pd.array(np.concatenate([np.zeros(len(got), np.int64), docs[root[below]]]), "Int64")
    b[: len(got)] = pd.NA
    return pd.DataFrame({"a": a, "n": n, "b": b})


def copies_of(rows: DataFrame, same: list[str], also: list[str] | None = None) -> DataFrame:
    """doc_id, rep, copies and `also`: of rows that agree in `same`, the smallest doc_id represents all. rows hold each doc_id once.

    Only what stands twice or more is joined, from a stored table, so that Spark may split the rows of one text with very
    many copies.
    """
    repeated = materialized(rows.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "repeated")
    joined = rows.join(repeated, same, "left")
    return materialized(joined.select("doc_id", *(also or []), F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "members")


def linked_classes(every: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, kept of `every` doc_id.

    members (doc_id, rep, copies) names each document's representative among its exact copies; links holds counts
    (a, n, null) of what is linked with a representative and edges (a, 0, b) that join what is linked.
    """
    counts = links.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    classes = components(links.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    linked = members.join(counts, "rep", "left").join(classes, "rep", "left")
    linked = linked.select("doc_id", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "copies")
    out = every.join(linked, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
