"""Packet features on a stream: keyed state by flow, by payload and by source, one after another in one query.

State is as the batch windows define it, given packets in order within and between micro-batches; inside a micro-batch each
key's packets are sorted. With a life time, time is the packets' own: a key unseen for longer starts anew, its state is dropped by a
timer when the watermark has passed, and packets that come behind the watermark are left out and counted (late_rows).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from busline.operators.windows import RECENT, SOURCE_WINDOW
from busline.schema import FLOW, KEY, ORDER
from busline.sources.store import exists, make, move, new_folder, stored

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The order of packets by time alone, as a stream with a life time reads them, and the column of event time.
TIME_ORDER = ["timestamp", "pcap_file", "frame_no"]
EVENT_TIME = "event_time"


def bits_apart(a: str | None, b: str | None) -> float:
    """Share of differing bits over the shorter of two hex payloads."""
    try:
        x, y = bytes.fromhex(a or ""), bytes.fromhex(b or "")
    except ValueError:
        return 0.0
    n = min(len(x), len(y))
    return (int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_count() / (8 * n) if n else 0.0


def _texts(values: pd.Series) -> list[str | None]:
    return [v or None if isinstance(v, str) else None for v in values]


class _Keyed(StatefulProcessor):
    """Sorts a key's new packets, cuts them where the key starts anew, and keeps the timer that drops its state.

    Subclasses have `names` of features and packets(part, fresh), which gives these for packets side by side, `fresh` saying whether the key
    starts anew with the first of them, and brings the state up to date.
    """

    names: list[str] = []

    def __init__(self, kept: list[str], life: float | None = None):
        self.kept, self.life = kept, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "timestamp double")
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.keeps(key):
            for part in rows:
                yield part[self.kept].assign(**{n: 0.0 for n in self.names})
            return
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(TIME_ORDER if self.life else ORDER, ignore_index=True)
        before = self.seen.get()[0] if self.seen.exists() else None
        time = pdf["timestamp"].to_numpy(np.float64)
        fresh = np.zeros(len(time), bool)
        if self.life:
            fresh[1:] = np.diff(time) > self.life
        fresh[0] = before is None or bool(self.life and time[0] - before > self.life)
        cut = np.unique(np.append(np.flatnonzero(fresh), 0))
        parts = [pdf.iloc[a:b] for a, b in zip(cut, [*cut[1:], len(pdf)])]
        made = [pd.DataFrame(self.packets(p, bool(fresh[a])), index=p.index, columns=self.names) for p, a in zip(parts, cut)]
        last = float(time[-1]) if before is None else max(float(time[-1]), before)
        self.seen.update((last,))
        if self.life and before is None:
            self.handle.registerTimer(self.expiry(last))
        yield pd.concat([pdf[self.kept], pd.concat(made)], axis=1)

    def expiry(self, last: float) -> int:
        """The millisecond from which a key that was seen last at `last` is dropped; a packet of any later time starts anew."""
        return math.ceil((last + self.life) * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """One timer a key: if packets have come since it was set, it is set anew, else the state goes."""
        if self.seen.exists():
            due = self.expiry(self.seen.get()[0])
            if due > expiredTimerInfo.getExpiryTimeInMs():
                self.handle.registerTimer(due)
            else:
                self.seen.clear()
                self.drop()
        yield from ()

    def keeps(self, key) -> bool:
        """Whether a key has state; packets of one that has none get 0."""
        return True

    def close(self) -> None:
        pass


class FlowState(_Keyed):
    """Previous values and last payloads of a flow: f01 and f08 to f13."""

    names = ["f01", "f08", "f09", "f10", "f11", "f12", "f13"]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ts double, ip double, tl double, tu string, plain string, sd string, recent array<string>")

    def drop(self) -> None:
        self.held.clear()

    def packets(self, part: pd.DataFrame, fresh: bool) -> dict[str, object]:
        ts, ip, tl, tu, plain, sd, recent = (math.nan, math.nan, math.nan, None, None, None, []) if fresh else self.held.get()
        values = {"ts": (part["timestamp"], ts), "ip": (part["ip_len"], ip), "tl": (part["transport_len"], tl)}
        values = {k: np.append(math.nan if first is None else first, now.to_numpy(np.float64, na_value=math.nan)) for k, (now, first) in values.items()}
        gap = {k: np.nan_to_num(np.abs(np.diff(v))) for k, v in values.items()}
        last, recent, rows = {False: plain, True: sd}, deque(recent or [], RECENT), []
        for si, now, is_sd in zip(_texts(part["someip_payload_hex"]), _texts(part["transport_payload_hex"]), part["is_sd"].tolist()):
            kind = bool(is_sd)
            apart = bits_apart(last[kind], si)
            rows.append((0.0 if kind else apart, apart if kind else 0.0, bits_apart(tu, now), sum(p == si for p in recent) / len(recent) if si and recent else 0.0))
            last[kind], tu = si, now
            recent.append(si)
        ends = [None if math.isnan(v[-1]) else float(v[-1]) for v in values.values()]
        self.held.update((*ends, tu, last[False], last[True], list(recent)))
        f08, f09, f10, f13 = zip(*rows)
        return {"f01": gap["ts"], "f08": f08, "f09": f09, "f10": f10, "f11": gap["ip"], "f12": gap["tl"], "f13": f13}


class PayloadState(_Keyed):
    """Last source of a payload: f14. Packets without payload have keys that begin with "-", and no state."""

    names = ["f14"]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "src string")

    def drop(self) -> None:
        self.held.clear()

    def keeps(self, key) -> bool:
        return not str(key[0]).startswith("-")

    def packets(self, part: pd.DataFrame, fresh: bool) -> dict[str, object]:
        source = part["src_ip"].tolist()
        before = [source[0] if fresh else self.held.get()[0], *source[:-1]]
        self.held.update((source[-1],))
        return {"f14": [float(a is not None and b is not None and a != b) for a, b in zip(before, source)]}


class SourceState(_Keyed):
    """Last times and payloads of a source: f17 and f18.

    Each is a ring of segments, one a micro-batch, under the number of its first entry: a batch writes its own entries and
    removes segments that the window has left, so what is written grows with new packets and not with the window.
    """

    names = ["f17", "f18"]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n bigint, m bigint")
        self.times = handle.getMapState("times", "at bigint", "seconds array<double>")
        self.payloads = handle.getMapState("payloads", "at bigint", "hex array<string>")

    def drop(self) -> None:
        for state in (self.total, self.times, self.payloads):
            state.clear()

    @staticmethod
    def _read(state, fresh: bool) -> dict[int, list]:
        return {} if fresh else {int(k[0]): list(v[0]) for k, v in sorted(state.iterator(), key=lambda x: x[0])}

    @staticmethod
    def _write(state, held: dict[int, list], n: int, new: list) -> int:
        """Add the newest entries as a segment, remove what has left the window; the number of entries from now on."""
        if new:
            first = max(0, len(new) - SOURCE_WINDOW)
            state.updateValue((n + first,), (new[first:],))
        for at, values in held.items():
            if at + len(values) <= n + len(new) - SOURCE_WINDOW:
                state.removeKey((at,))
        return n + len(new)

    def packets(self, part: pd.DataFrame, fresh: bool) -> dict[str, object]:
        if fresh:
            self.drop()
        n, m = (0, 0) if fresh else self.total.get()
        times, payloads = self._read(self.times, fresh), self._read(self.payloads, fresh)
        time, said = part["timestamp"].astype(float).tolist(), _texts(part["someip_payload_hex"])
        new = [p for p in said if p]
        f17 = packet_rates([t for x in times.values() for t in x][-SOURCE_WINDOW:], time)
        shares = np.append(0.0, payload_shares([*[p for x in payloads.values() for p in x][-SOURCE_WINDOW:], *new]))
        at = len(shares) - 1 - len(new) + np.cumsum([p is not None for p in said])
        self.total.update((self._write(self.times, times, n, time), self._write(self.payloads, payloads, m, new)))
        return {"f17": f17, "f18": shares[at]}


def packet_rates(before: list[float], now: list[float], window: int = SOURCE_WINDOW) -> np.ndarray:
    """Packets a second over the last `window` of times, for each of `now`; the number of packets where no time passed."""
    time = np.array([*before, *now])
    at = np.arange(len(before), len(time))
    first = np.maximum(at - window + 1, 0)
    count, passed = at - first + 1, time[at] - time[first]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count < 2, 0.0, np.where(passed > 0, (count - 1) / passed, count))


def payload_shares(payloads: list[str], window: int = SOURCE_WINDOW) -> np.ndarray:
    """Distinct share of the last `window` of payloads, for each; 0 for a single one. A place counts until its payload comes again or leaves the window."""
    n = len(payloads)
    if not n:
        return np.zeros(0)
    _, code = np.unique(np.array(payloads, object), return_inverse=True)
    order = np.argsort(code, kind="stable")
    again = np.full(n, n)
    same = code[order[1:]] == code[order[:-1]]
    again[order[:-1][same]] = order[1:][same]
    ended = np.cumsum(np.bincount(np.minimum(again, np.arange(n) + window), minlength=n)[:n])
    size = np.minimum(np.arange(n) + 1, window)
    return np.where(size > 1, (np.arange(n) + 1 - ended) / size, 0.0)


#: What the states read of a packet, besides their keys.
_READ = [*KEY, "timestamp", "is_sd", "ip_len", "transport_len", "transport_payload_hex", "someip_payload_hex", "src_ip"]
_TYPES = {"pcap_file": "string", "frame_no": "bigint", "timestamp": "double", "someip_payload_hex": "string", "src_ip": "string", EVENT_TIME: "timestamp"}


def event_time(packets: DataFrame, late: str = "0 seconds") -> DataFrame:
    """packets with their time as event time and a watermark that waits for packets as late as `late`."""
    return packets.withColumn(EVENT_TIME, F.timestamp_micros(F.round(F.col("timestamp") * 1_000_000).cast("bigint"))).withWatermark(EVENT_TIME, late)


def _stream(rows: DataFrame, keys: list[str], processor: type[_Keyed], kept: list[str], life: float | None) -> DataFrame:
    kept = [*kept, *([EVENT_TIME] if life else [])]
    schema = ", ".join([*(f"{c} {_TYPES.get(c, 'double')}" for c in kept), *(f"{n} double" for n in processor.names)])
    timed = {"timeMode": "EventTime", "eventTimeColumnName": EVENT_TIME} if life else {"timeMode": "None"}
    return rows.groupBy(*keys).transformWithStateInPandas(processor(kept, life), outputStructType=schema, outputMode="Append", **timed)


def _begun(packets: DataFrame, columns: list[str], life: float | None, late: str) -> DataFrame:
    read = packets.select(*dict.fromkeys([*columns, *_READ]))
    return event_time(read, late) if life else read


def _by_payload(rows: DataFrame) -> DataFrame:
    """rows with their payload as a key; those without one are dealt to 64 keys that no payload has, as each key of a batch is a call."""
    return rows.withColumn("payload", F.coalesce(F.nullif("someip_payload_hex", F.lit("")), F.concat(F.lit("-"), F.pmod("frame_no", F.lit(64)).cast("string"))))


def _made(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, *[c for c in rows.columns if c[0] == "f" and c[1:].isdigit()])


def flow_stream(packets: DataFrame, life: float | None = None, late: str = "0 seconds") -> DataFrame:
    return _made(_stream(_begun(packets, FLOW, life, late), FLOW, FlowState, KEY, life))


def payload_stream(packets: DataFrame, life: float | None = None, late: str = "0 seconds") -> DataFrame:
    return _made(_stream(_by_payload(_begun(packets, [], life, late)), ["payload"], PayloadState, KEY, life))


def source_stream(packets: DataFrame, life: float | None = None, late: str = "0 seconds") -> DataFrame:
    return _made(_stream(_begun(packets, [], life, late), ["src_ip"], SourceState, KEY, life))


def all_stream(packets: DataFrame, life: float | None = None, late: str = "0 seconds") -> DataFrame:
    """Row key and f01, f08 to f14, f17 and f18 of each packet, from three keyed states in one query under one checkpoint.

    Each state hands on what the next ones read with the features so far. With life (seconds) a key unseen for longer starts anew, state is dropped
    in event time, and packets later than `late` are left out.
    """
    rows, kept, features = _begun(packets, FLOW, life, late), [*KEY, "timestamp", "src_ip", "someip_payload_hex"], []
    for keys, processor in ((FLOW, FlowState), (["payload"], PayloadState), (["src_ip"], SourceState)):
        rows = _stream(_by_payload(rows), keys, processor, [*kept, *features], life)
        features += processor.names
    return _made(rows)


def late_rows(query: StreamingQuery) -> int:
    """Packets that the query's states have left out because they came behind the watermark, of the batches that the query remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


@contextmanager
def _settings(spark: SparkSession, most: int) -> Iterator[None]:
    """For streams that start inside: at most so many partitions a state, which a stream keeps in its checkpoint, and no batch that has timers alone."""
    partitions, empty, provider = "spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.streaming.stateStore.providerClass"
    before = {partitions: spark.conf.get(partitions), empty: spark.conf.get(empty)}
    spark.conf.set(provider, PROVIDER)
    spark.conf.set(partitions, min(int(before[partitions]), most))
    spark.conf.set(empty, False)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_available(packets: DataFrame, features: Callable[[DataFrame], DataFrame], batch_rows: int = 1_000_000, least_batches: int = 1, order: list[str] | None = None) -> DataFrame:
    """Hand packets to a stream in micro-batches and return what the stream has written.

    Packets are cut in order into batches of about batch_rows, least_batches at least. A batch, however many files it has, is moved
    into the stream's folder when the one before has been processed, so that batches arrive in order; moving a folder must be one step there, as it is
    in file systems. One query takes all batches, so states stay open from one to the next. batch_rows bounds what a key can hold in memory at once. A batch has a
    file a core, and each state a partition a core: opening and committing a state's partition takes the same time for few keys as for many, and comes
    again with each batch. Timers run with the next batch. All files are in the shared folder that spark.checkpoint.dir names.
    """
    spark = packets.sparkSession
    at, kept = new_folder(spark, "stream"), stored(packets, "packets")
    batches, cores = max(least_batches, math.ceil(kept.count() / batch_rows)), spark.sparkContext.defaultParallelism
    # Cut into more pieces than batches; a piece's number is its place in the order.
    pieces = batches * cores
    cut = kept.repartitionByRange(pieces, *(order or ORDER)).withColumn("batch", F.floor(F.spark_partition_id() * F.lit(batches) / F.lit(pieces)).cast("int"))
    cut.write.partitionBy("batch").parquet(f"{at}/all")
    schema = StructType([*packets.schema.fields, StructField("batch", IntegerType())])
    make(spark, f"{at}/in")
    made = features(spark.readStream.schema(schema).parquet(f"{at}/in"))
    query = None
    with _settings(spark, cores):
        try:
            for k in range(batches):
                if not move(spark, f"{at}/all/batch={k}", f"{at}/in/batch={k}"):
                    continue  # no packet
                query = query or made.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(processingTime="0 seconds").start()
                query.processAllAvailable()
        finally:
            if query:
                query.stop()
    return spark.read.schema(made.schema).parquet(f"{at}/out") if exists(spark, f"{at}/out") else spark.createDataFrame([], made.schema)
