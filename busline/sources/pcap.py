"""Packet captures as a Spark source: decoding in Python, message headers as columns.

Three ways in. scan_captures() reads files through Spark's binaryFile source, so from any store that Spark reaches, one
whole file in a task. stream_captures() reads spans of files, for captures larger than memory, at paths that executors can open or in stores that
Arrow reaches by URI. The Python data source "pcap" gives frames of such files: as a table, of which filters by file skip files, and
as a stream that follows a folder of growing captures.
"""

from __future__ import annotations

import io
import itertools
import os
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from busline.functions.columns import header_fields, is_discovery, is_valid_message, kept_hex, message_type_name
from busline.schema import CAPTURES, HEADER_BYTES, PACKETS
from busline.sources.packets import labelled
from busline.sources.store import stored

#: Magic numbers as they stand in a file -> byte order and fractions of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
ETHERNET, IPV4, VLAN = 1, 0x0800, (0x8100, 0x88A8, 0x9100)
TCP, UDP = 6, 17

_I, _L, _S = T.IntegerType(), T.LongType(), T.StringType()
FRAMES = T.StructType([
    T.StructField("pcap_file", _S), T.StructField("frame_no", _L), T.StructField("timestamp", T.DoubleType()), T.StructField("src_ip", _S), T.StructField("dst_ip", _S),
    T.StructField("ip_proto", _I), T.StructField("ip_ttl", _I), T.StructField("ip_len", _I), T.StructField("ip_id", _I), T.StructField("ip_flags", _I),
    T.StructField("transport", _S), T.StructField("src_port", _I), T.StructField("dst_port", _I), T.StructField("transport_len", _I),
    T.StructField("tcp_seq", _L), T.StructField("tcp_ack", _L), T.StructField("tcp_flags", _I), T.StructField("payload", T.BinaryType()),
])
#: Why and at which byte a capture can't be read on; such a row has no frame.
BROKEN = T.StructType([T.StructField("broken", _S), T.StructField("broken_at", _L)])


class BrokenCapture(ValueError):
    def __init__(self, reason: str, at: int):
        super().__init__(f"{reason} at byte {at}")
        self.reason, self.at = reason, at


def open_capture(path: str) -> BinaryIO:
    """A capture at a local path or in a store that Arrow reaches by URI, in buffered reads."""
    if re.match(r"[a-z][a-z0-9+.-]*:/", path) and not path.startswith("file:"):
        store, at = fs.FileSystem.from_uri(path)
        return io.BufferedReader(store.open_input_file(at), 1 << 20)
    return open(path.removeprefix("file://").removeprefix("file:"), "rb", buffering=1 << 20)


def list_captures(path: str) -> list[str]:
    """The *.pcap files in a folder, or the file itself, in order."""
    scheme = re.match(r"([a-z][a-z0-9+.-]*:)/", path)
    if scheme and not path.startswith("file:"):
        store, at = fs.FileSystem.from_uri(path)
        kind = store.get_file_info(at).type
        found = store.get_file_info(fs.FileSelector(at)) if kind == fs.FileType.Directory else []
        head = path[: len(path) - len(at)]
        return [path] if kind == fs.FileType.File else sorted(head + f.path for f in found if f.path.endswith(".pcap"))
    at = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(at):
        return sorted(os.path.join(at, n) for n in os.listdir(at) if n.endswith(".pcap"))
    return [at] if os.path.exists(at) else []


def opened(stream: BinaryIO) -> tuple[str, float]:
    """Byte order and fractions of a second of a capture, whose file header is read."""
    head = stream.read(24)
    if len(head) < 24 or head[:4] not in MAGIC:
        raise BrokenCapture("not a capture file", 0)
    order, fraction = MAGIC[head[:4]]
    if struct.unpack_from(order + "I", head, 20)[0] & 0x0FFFFFFF != ETHERNET:
        raise BrokenCapture("not an Ethernet capture", 0)
    return order, fraction


def records(stream: BinaryIO, kind: tuple[str, float] | None = None, end: int | None = None) -> Iterator[tuple[float, bytes]]:
    """(seconds, frame) of each record of a capture; BrokenCapture where the file is no capture or is cut off.

    With kind, as opened() gives it, the stream stands at a record already; records are read up to byte `end`.
    """
    order, fraction = kind or opened(stream)
    at = stream.tell()
    while (end is None or at < end) and (record := stream.read(16)):
        if len(record) < 16:
            raise BrokenCapture("record header cut off", at)
        sec, sub, size, _ = struct.unpack(order + "IIII", record)
        frame = stream.read(size)
        if len(frame) < size:
            raise BrokenCapture("record cut off", at)
        at += 16 + size
        yield sec + sub / fraction, frame


def decode(frame: bytes) -> tuple | None:
    """The IP and transport fields and payload of an Ethernet frame; None unless it is IPv4 with a whole TCP or UDP header."""
    at = 14
    if len(frame) < at:
        return None
    kind = int.from_bytes(frame[12:14], "big")
    while kind in VLAN and len(frame) >= at + 4:
        kind = int.from_bytes(frame[at + 2 : at + 4], "big")
        at += 4
    if kind != IPV4 or len(frame) < at + 20:
        return None
    first, _, total, ident, fragment, ttl, proto, _, src, dst = struct.unpack_from(">BBHHHBBH4s4s", frame, at)
    header = (first & 15) * 4
    if first >> 4 != 4 or header < 20 or fragment & 0x1FFF:
        return None
    segment = frame[at + header : at + total]
    ip = (".".join(map(str, src)), ".".join(map(str, dst)), proto, ttl, total, ident, fragment >> 13)
    if proto == UDP and len(segment) >= 8:
        sport, dport, size, _ = struct.unpack_from(">HHHH", segment)
        return *ip, "UDP", sport, dport, size, None, None, None, segment[8:]
    if proto == TCP and len(segment) >= 20:
        sport, dport, seq, ack, off, flags = struct.unpack_from(">HHIIBB", segment)
        return *ip, "TCP", sport, dport, total - header, seq, ack, flags | (off & 1) << 8, segment[(off >> 4) * 4 :]
    return None


#: What a frame of another protocol has in FRAMES, besides its place and time.
_NOTHING = (None,) * (len(FRAMES) - 3)


def rows_of(found: Iterator[tuple[float, bytes]], name: str, strict: bool = False, first: int = 1) -> Iterator[tuple]:
    """Rows of FRAMES and BROKEN, frames numbered from first; frames of other protocols have no transport.

    Where a file is broken a row says why and at which byte, and the file ends there; strict raises instead.
    """
    try:
        for n, (when, frame) in enumerate(found, first):
            yield name, n, when, *(decode(frame) or _NOTHING), None, None
    except BrokenCapture as e:
        if strict:
            raise
        yield name, None, None, *_NOTHING, e.reason, e.at


def frames(stream: BinaryIO, name: str, strict: bool = False, first: int = 1) -> Iterator[tuple]:
    """rows_of() the records of a capture file, which may turn out to be none."""
    yield from rows_of(records(stream), name, strict, first)


#: What decoding gives.
DECODED = T.StructType([*FRAMES.fields, *BROKEN.fields])


def in_batches(rows: Iterator[tuple], columns: list[str] | None = None, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of DECODED as Arrow batches, of these columns only if they are named."""
    schema = to_arrow_schema(DECODED)
    at = [schema.get_field_index(c) for c in columns or schema.names]
    for held in itertools.batched(rows, most):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], schema.field(i).type) for i in at], names=[schema.field(i).name for i in at])


def to_packets(rows: DataFrame) -> DataFrame:
    """The packet table from FRAMES, with BROKEN if they have it: message header, hex of the first bytes, label and class, as built-in expressions."""
    raw = F.col("payload")
    rows = rows.withColumn("payload", F.when(F.length(raw) > 0, raw))
    rows = rows.withColumn("someip_valid", is_valid_message(raw))
    rows = rows.withColumns({c: v for c, v in zip(("service_id", "method_id", "someip_len", "client_id", "session_id", "proto_ver", "iface_ver", "msg_type", "return_code"), header_fields(raw, F.col("someip_valid")))})
    rows = rows.withColumns({
        "msg_type_name": message_type_name(F.col("msg_type")), "is_sd": is_discovery(F.col("service_id")), "transport_payload_hex": kept_hex(raw),
        "someip_payload_hex": F.when(F.col("someip_valid"), kept_hex(raw, HEADER_BYTES + 1)), "someip_payload_len": F.when(F.col("someip_valid"), F.length(raw) - HEADER_BYTES),
    })
    return labelled(rows).select(*[F.col(f.name).cast(f.dataType) for f in PACKETS], *[c for c in BROKEN.fieldNames() if c in rows.columns])


def _packets(found: DataFrame, dropped: bool, broken: bool) -> DataFrame:
    """The packet table of what was decoded, with the rows of other frames and of broken files if asked for."""
    if not broken:
        found = found.where("broken IS NULL").drop(*BROKEN.fieldNames())
    if not dropped:
        found = found.where(F.col("transport").isNotNull() | F.col("broken").isNotNull() if broken else F.col("transport").isNotNull())
    return to_packets(found)


def decode_captures(files: DataFrame, strict: bool = False, dropped: bool = False, broken: bool = False) -> DataFrame:
    """The packet table from rows (pcap_file, content), or (pcap_file, content, first_frame) where a capture stands in pieces.

    Frames of other protocols are left out; with `dropped` they stay, as rows without transport, to be counted. With `broken` there are columns of BROKEN and
    a row for each file that can't be read to its end.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, first in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                yield from in_batches(frames(io.BytesIO(content.as_py()), name, strict, first))

    first = F.col("first_frame") if "first_frame" in files.columns else F.lit(1).cast("bigint")
    found = files.select("pcap_file", "content", first.alias("first_frame")).mapInArrow(run, DECODED)
    return _packets(found, dropped, broken)


def scan_captures(spark: SparkSession, path: str, strict: bool = False, dropped: bool = False, broken: bool = False) -> DataFrame:
    """The packet table of all *.pcap files under path, labelled by file name; files of unknown name are left out by the labels."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(path)
    return decode_captures(files.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("pcap_file"), "content"), strict, dropped, broken)


def walk_records(stream: BinaryIO, order: str, at: int, first: int) -> Iterator[tuple[int, int]]:
    """(end, number) of each whole record from byte `at` on, the first of which has the number `first`, from record headers alone."""
    stream.seek(at)
    while len(record := stream.read(16)) == 16:
        to = at + 16 + struct.unpack_from(order + "I", record, 8)[0]
        if to > at + 16:
            stream.seek(to - 1)
            if not stream.read(1):
                return
        yield to, first
        at, first = to, first + 1


def record_spans(stream: BinaryIO, size: int, strict: bool = False) -> Iterator[tuple[int, int, int]]:
    """(first byte, end, first frame number) of spans of whole records of about `size` bytes, from record headers alone.

    What can't be read is a last span of its own, without an end (-1), in which decoding finds what is broken; strict raises.
    """
    try:
        order, _ = opened(stream)
    except BrokenCapture:
        if strict:
            raise
        yield 0, -1, 1
        return
    begin, at, first, number = 24, 24, 1, 1
    for at, n in walk_records(stream, order, 24, 1):
        number = n + 1
        if at - begin >= size:
            yield begin, at, first
            begin, first = at, number
    if at > begin:
        yield begin, at, first
    stream.seek(at)
    if stream.read(1):
        if strict:
            raise BrokenCapture("record cut off", at)
        yield at, -1, number


def read_span(path: str, begin: int, end: int, first: int, strict: bool = False) -> Iterator[tuple]:
    """Rows of DECODED of the records in a span of a capture; to its end where `end` is -1, from the file's own begin where `begin` is 0."""
    with open_capture(path) as stream:
        if not begin:
            yield from frames(stream, os.path.basename(path), strict, first)
            return
        kind = opened(stream)
        stream.seek(begin)
        yield from rows_of(records(stream, kind, None if end < 0 else end), os.path.basename(path), strict, first)


class PcapPartition(InputPartition):
    def __init__(self, path: str, begin: int = 0, end: int = -1, first: int = 1):
        self.path, self.begin, self.end, self.first = path, begin, end, first


class _Pcap:
    """Options of both readers: path, mode (PERMISSIVE or FAILFAST), and the columns of the schema that was asked for."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.strict, self.columns = options["path"], options.get("mode", "PERMISSIVE").upper() == "FAILFAST", schema.names

    def rows(self, part: PcapPartition) -> Iterator[pa.RecordBatch]:
        if part.path:
            found = read_span(part.path, part.begin, part.end, part.first, self.strict)
            yield from in_batches((r for r in found if r[1] is not None) if "broken" not in self.columns else found, self.columns)


class PcapReader(_Pcap, DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        super().__init__(options, schema)
        self.span, self.names = int(options.get("spanBytes", "0")), None

    def partitions(self) -> list[PcapPartition]:
        parts = []
        for path in list_captures(self.path):
            if self.names is not None and os.path.basename(path) not in self.names:
                continue
            if not self.span:
                parts.append(PcapPartition(path))
                continue
            with open_capture(path) as stream:
                parts += [PcapPartition(path, *s) for s in record_spans(stream, self.span, self.strict)]
        return parts or [PcapPartition("")]

    def read(self, partition: PcapPartition) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class FilteredPcapReader(PcapReader):
    """Spark refuses readers with this method unless spark.sql.python.filterPushdown.enabled is set, so it is asked for by an option."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters by pcap_file choose the files that are opened at all; Spark applies all others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("pcap_file",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            else:
                yield f


class PcapStreamReader(_Pcap, DataSourceStreamReader):
    """Follows a folder of captures: an offset has the bytes and frames of each file up to its last whole record.

    Records that are still being written wait for the next batch; a file whose head isn't whole yet is looked at again.
    """

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        known = self.__dict__.setdefault("known", {})
        for path in list_captures(self.path):
            with open_capture(path) as stream:
                try:
                    order, _ = opened(stream)
                except BrokenCapture:
                    if self.strict and stream.tell() >= 24:
                        raise
                    continue
                at, frames = known.get(path, (24, 0))
                for at, frames in walk_records(stream, order, at, frames + 1):
                    pass
                known[path] = at, frames
        return {path: list(v) for path, v in known.items()}

    def partitions(self, start: dict, end: dict) -> list[PcapPartition]:
        parts = []
        for path, (to, _) in end.items():
            begin, frames = start.get(path, (24, 0))
            if to > begin:
                parts.append(PcapPartition(path, begin, to, frames + 1))
        return parts or [PcapPartition("")]

    def read(self, partition: PcapPartition) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PcapSource(DataSource):
    """format("pcap"): frames of the captures at `path`, as a table or a stream.

    Options: mode PERMISSIVE (default) or FAILFAST; spanBytes cuts files into partitions of about as many bytes. The schema is FRAMES, or what of DECODED
    is asked for: columns that are left out are not handed to Spark, and rows of broken files come only with the column broken. With filters true and
    spark.sql.python.filterPushdown.enabled, filters by pcap_file open only these files.
    """

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> T.StructType:
        return FRAMES

    def reader(self, schema: T.StructType) -> PcapReader:
        kind = FilteredPcapReader if self.options.get("filters", "false").lower() == "true" else PcapReader
        return kind(self.options, schema)

    def streamReader(self, schema: T.StructType) -> PcapStreamReader:
        return PcapStreamReader(self.options, schema)


def stream_captures(spark: SparkSession, path: str, strict: bool = False, dropped: bool = False, span_bytes: int = 64 << 20, broken: bool = False) -> DataFrame:
    """The packet table of captures of any size at a path that executors can open, or in a store that Arrow reaches.

    One task a file walks its record headers and lists spans of whole records; then one task a span decodes.
    """
    names = list_captures(path)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                with open_capture(name) as stream:
                    yield pd.DataFrame([(name, *x) for x in record_spans(stream, span_bytes, strict)], columns=["path", "begin", "end", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in zip(*(c.to_pylist() for c in batch.columns)):
                yield from in_batches(read_span(*span, strict))

    files = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names)), "path")
    spans = stored(files.mapInPandas(walk, "path string, begin bigint, end bigint, first bigint"), "spans")
    found = spans.repartition(max(1, spans.count())).mapInArrow(run, DECODED)
    return _packets(found, dropped, broken)


_COUNTED = ("read", "written", "dropped", "attacks")


def capture_counters() -> list[Column]:
    """Aggregates for observe() on packets with `dropped` and `broken` rows: for each capture its counts, and where and why it is broken.

    So one pass that writes packets also counts them; captures are seven, whatever their size.
    """
    kept, frame = F.col("transport").isNotNull(), F.col("broken").isNull()
    counted = {"read": frame, "written": kept, "dropped": frame & ~kept, "attacks": kept & (F.col("label") == 1)}
    return [
        *[F.count(F.when((F.col("pcap_file") == name) & counted[c], 1)).alias(f"{c}_{i}") for i, (name, _, _) in enumerate(CAPTURES) for c in _COUNTED],
        *[F.max(F.when((F.col("pcap_file") == name) & ~frame, F.struct("broken_at", "broken"))).alias(f"broken_{i}") for i, (name, _, _) in enumerate(CAPTURES)],
    ]


def capture_report(found: dict) -> tuple[list[Row], list[Row]]:
    """From what capture_counters() observed: pcap_file, read, written, dropped, attacks, share of captures with frames; pcap_file, byte, reason of broken ones."""
    counts = [Row(pcap_file=name, **{c: found[f"{c}_{i}"] for c in _COUNTED}, share=found[f"attacks_{i}"] / max(found[f"written_{i}"], 1)) for i, (name, _, _) in enumerate(CAPTURES) if found[f"read_{i}"]]
    rejects = [Row(pcap_file=name, byte=b[0], reason=b[1]) for i, (name, _, _) in enumerate(CAPTURES) if (b := found[f"broken_{i}"])]
    return sorted(counts), sorted(rejects)


def capture_bytes(packets: list[tuple[float, bytes]], magic: bytes = b"\xd4\xc3\xb2\xa1") -> bytes:
    """A capture file holding the frames (seconds, bytes)."""
    order, fraction = MAGIC[magic]
    out = [magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, ETHERNET)]
    for when, frame in packets:
        sec = int(when)
        out.append(struct.pack(order + "IIII", sec, min(round((when - sec) * fraction), int(fraction) - 1), len(frame), len(frame)) + frame)
    return b"".join(out)


def ethernet_frame(src: str, dst: str, sport: int, dport: int, transport: str, payload: bytes) -> bytes:
    """An Ethernet frame with IPv4 and a TCP or UDP segment."""
    if transport == "UDP":
        segment = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    else:
        segment = struct.pack(">HHIIBBHHH", sport, dport, 1, 1, 5 << 4, 0x18, 1024, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(segment), 1, 0x4000, 64, UDP if transport == "UDP" else TCP, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return b"\x02\0\0\0\0\x01\x02\0\0\0\0\x02\x08\x00" + ip + segment


def written_captures(rows: DataFrame, piece: int = 20_000, other: int = 0) -> DataFrame:
    """(pcap_file, content, first_frame): packets (as of packets_raw) written as capture files of frames up to `piece` numbers apart.

    A piece's first frame number is one more than the frames of its capture in earlier pieces, so that numbers don't repeat. After
    each packet whose number `other` divides stands a frame of another protocol.
    """
    names = [name for name, _, _ in CAPTURES]

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple[float, bytes]] = []
        for r in pdf.sort_values("frame_no").itertuples():
            made.append((r.timestamp, ethernet_frame(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.transport, bytes.fromhex(r.raw_hex or ""))))
            if other and r.frame_no % other == 0:
                made.append((r.timestamp, made[-1][1][:12] + b"\x08\x06" + bytes(28)))
        return pd.DataFrame({"pcap_file": [names[int(pdf["cap_id"].iloc[0])]], "content": [capture_bytes(made)], "first_frame": [int(pdf["__first"].iloc[0])]})

    rows = rows.withColumn("__piece", F.floor(F.col("frame_no") / piece))
    more = F.when(F.col("frame_no") % other == 0, 2).otherwise(1) if other else F.lit(1)
    sizes = rows.groupBy("cap_id", "__piece").agg(F.sum(more).alias("__n"))  # a row a piece
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("cap_id").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("cap_id", "__piece", (before + 1).alias("__first"))
    return rows.join(firsts, ["cap_id", "__piece"]).groupBy("cap_id", "__piece").applyInPandas(write, "pcap_file string, content binary, first_frame bigint")
