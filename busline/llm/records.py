"""Token ids in length-delimited binary records with masked checksums, and an offset index for shuffled reads.

File format. A file is a row of blocks. A block is a header frame, its record frames and one byte 0x0A. A frame is

    length    8 bytes, little-endian: bytes of the payload
    check     4 bytes: masked CRC-32 of the 8 length bytes
    payload
    check     4 bytes: masked CRC-32 of the payload

The payload of a header frame is b"BLK1", the number of the block's records, the block's range of doc_ids and the block's
number in its range (4 bytes each). The payload of a record is one flag byte (1: doc_id is null, 2: ids take four bytes instead of two), the
doc_id (8 bytes) and the ids. A masked checksum is the checksum rotated right by 15 bits plus 0xA282EAD8, so that checksums
of data that hold checksums stay useful. Ranges ascend with doc_id, and so do the records of a range.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from busline.llm.bpe import PieceEncoder, vocabulary as read_vocabulary
from busline.llm.common import bounded_batches

END = 2
BLOCK_BYTES = 2 << 20
BLOCKS_PER_FILE = 16
#: Pieces that the library gets as one text.
JOINED = 256


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))])


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the frame at `at` and where the next begins; raises ValueError if a checksum differs."""
    if at + 12 > len(data):
        raise ValueError(f"frame cut off at byte {at}")
    size, check = struct.unpack_from("<QI", data, at)
    if check != masked(data[at : at + 8]):
        raise ValueError(f"length checksum differs at byte {at}")
    payload = data[at + 12 : at + 12 + size]
    if len(payload) != size or at + 16 + size > len(data) or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"payload checksum differs at byte {at}")
    return payload, at + 16 + size


def record(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return frame(struct.pack("<Bq", (doc_id is None) | wide << 1, doc_id or 0) + ids)


def read_record(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return (None if flags & 1 else doc_id), np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


def read_file(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(range, block, offset, end, payload) of the records of a file."""
    at = 0
    while at < len(data):
        head, at = unframe(data, at)
        if head[:4] != b"BLK1":
            raise ValueError(f"no block at byte {at}")
        count, part, block = struct.unpack_from("<III", head, 4)
        for _ in range(count):
            payload, end = unframe(data, at)
            yield part, block, at, end, payload
            at = end
        if data[at : at + 1] != b"\n":
            raise ValueError(f"block not closed at byte {at}")
        at += 1


@functools.lru_cache(2)
def library_encoder(path: str, kind: str = "<u4") -> PieceEncoder:
    """Texts to ids (as kind) by the tokenizers library, repeated pieces being looked up.

    A Python worker loads the library once and keeps it for all its tasks; pieces are remembered within a task.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    def load() -> Tokenizer:
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        return made

    library, plain, bpe = load(), load(), read_vocabulary(path)
    # The same vocabulary for words of letters with a space before each: splitting at spaces is all they need.
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def joined(tokenizer: Tokenizer, names: list[str]) -> list[bytes]:
        texts = [" " + " ".join(names[at : at + JOINED]) for at in range(0, len(names), JOINED)]
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return bpe.divided(np.fromiter(itertools.chain.from_iterable(ids), np.int64), "".join(texts), kind) if texts else []

    def spaced(names: list[str]) -> list[bytes]:
        letters = [*map(str.isalpha, names)]
        parts = iter(joined(plain, [*itertools.compress(names, letters)])), iter(joined(library, [n for n, x in zip(names, letters) if not x]))
        return [next(parts[not x]) for x in letters]

    return PieceEncoder(spaced, lambda texts: [np.array(e.ids, kind).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)])


def range_cuts(docs: DataFrame, range_bytes: int, most_ranges: int) -> np.ndarray:
    """The doc_ids at which ranges of about range_bytes of text begin, after the first range; one pass over docs.

    A document counts once for each 4 KB that it begins, so that cuts are quantiles of bytes and not of rows. A document
    is never divided, so one that is longer than a range makes its range as long.
    """
    unit, grid = 4096, max(1, min(most_ranges, docs.count()))
    weight = (1 + F.octet_length("text") / unit).cast("int")
    units = docs.select("doc_id", F.explode(F.array_repeat(F.lit(0), F.coalesce(weight, F.lit(1)))))
    found = units.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / grid for i in range(1, grid)], 20 * grid).alias("q")).first()
    step = grid / max(1, min(grid, found["n"] * unit // range_bytes + 1))
    cuts = found["q"] or []
    return np.array(sorted({cuts[round(i * step) - 1] for i in range(1, round(grid / step))} if cuts else ()), np.int64)


def write_records(docs: DataFrame, out: str, vocabulary: str, end: int = END, range_bytes: int = 16 << 20, most_ranges: int = 20_000) -> None:
    """Encode docs and write out/data (binary files) and out/index (Parquet: doc_id, part, file, offset, length, ...).

    doc_ids are cut into ranges of about range_bytes of text; where that would be more than most_ranges, ranges are longer, and
    what a task has to order spills. Tasks encode the texts where they are read; only ids are shuffled, each range to the task
    of its number, which writes it in ascending doc_id, so that files ascend as their names do. Spark's text writer and its
    commit protocol write the files, so any store that Spark reaches will do and a lost executor leaves no half file.

    Null texts count as empty: such a record holds `end` alone. Rows with a null doc_id come first; rows that share a
    doc_id stand together, ordered by their ids. An empty table gives no record. Extra columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 500, 4 << 20)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    bounds = range_cuts(docs, range_bytes, most_ranges)
    wide = max(read_vocabulary(vocabulary).token_size.size, end + 1) > 1 << 16
    kind = "<u4" if wide else "<u2"
    closing = np.array([end], kind).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary, kind)
        for batch in batches:
            doc = batch.column(0)
            part = np.searchsorted(bounds, doc.fill_null(-(2**63)).to_numpy(), "right").astype(np.int32)
            ids = pa.array([x + closing for x in encoder(batch.column(1).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part), doc, ids], names=["part", "doc_id", "ids"])
        encoder.forget()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, at, number = 0, 0, 0

        def block() -> pa.RecordBatch:
            head = frame(b"BLK1" + struct.pack("<III", len(held), at, number))
            return pa.RecordBatch.from_arrays([pa.array([b"".join([head, *held])], pa.binary())], names=["block"])

        for batch in batches:
            for part, doc_id, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and size >= BLOCK_BYTES:
                    yield block()
                    held, size, number = [], 0, number + 1
                at = part
                held.append(record(doc_id, ids, wide))
                size += len(held[-1])
        if held:
            yield block()

    encoded = docs.mapInArrow(encode, "part int, doc_id bigint, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("doc_id", "ids")
    blocks = dealt.mapInArrow(pack, "block binary")
    # The writer puts the bytes of a value as they are and 0x0A after it.
    blocks.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", BLOCKS_PER_FILE).text(f"{out}/data")
    index_files(spark, out).write.parquet(f"{out}/index")


INDEX = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def _files(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{out}/data").where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def index_files(spark: SparkSession, out: str) -> DataFrame:
    """The index of the files under out/data, read back and checked: one row a record. Raises if a checksum differs."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[list] = [[] for _ in INDEX]
                for part, block, at, to, payload in read_file(data.as_py()):
                    doc_id, ids = read_record(payload)
                    for column, value in zip(rows, (doc_id, part, block, name, at, to - at, len(ids), zlib.crc32(ids.astype("<u4")))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, to_arrow_schema(INDEX))], names=INDEX.fieldNames())

    return _files(spark, out).mapInArrow(scan, INDEX)


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """The written index with start, the number of ids in all records before each.

    Ids are summed by range, then in each range; the sum over ranges has as many rows as write_records() made ranges.
    """
    index = spark.read.schema(INDEX).parquet(f"{out}/index")
    per = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = per.select(F.col("part").alias("__part"), (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("block", "offset").rowsBetween(Window.unboundedPreceding, 0)
    joined = index.join(ahead, F.col("part") == F.col("__part"))
    return joined.select(*INDEX.fieldNames(), (F.col("ahead") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"))


def read_shuffled(spark: SparkSession, out: str, seed: int) -> DataFrame:
    """(doc_id, ids array<int>) of all records in an order drawn by seed, fetched by the offsets of the index."""
    index = spark.read.schema(INDEX).parquet(f"{out}/index").withColumn("key", F.xxhash64(F.lit(seed), "file", "offset"))
    wanted = index.groupBy("file").agg(F.collect_list(F.struct("key", "offset")).alias("want"))  # a file has a bounded number of bytes
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, want in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = data.as_py()
                got = [(w["key"], *read_record(unframe(raw, w["offset"])[0])) for w in want]
                columns = [[g[0] for g in got], [g[1] for g in got], [g[2].astype(np.int32) for g in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))], names=schema.fieldNames())

    return _files(spark, out).join(wanted, "file").select("content", "want").mapInArrow(fetch, schema).orderBy("key").drop("key")
