"""Streams against the batch windows, over restarts, life times and late packets."""

import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from busline.operators import windows
from busline.plans import queries as q
from busline.streaming import flows

SF = "/root/testdata/sf0.001"
PACKET = "pcap_file string, src_ip string, dst_ip string, src_port int, dst_port int, transport string, frame_no bigint, timestamp double, is_sd boolean, ip_len int, transport_len int, transport_payload_hex string, someip_payload_hex string, batch int"


@pytest.mark.parametrize("batches", [1, 4])
def test_streams_equal_batch(spark, batches):
    """All states in one query, which starts anew from its checkpoint for each batch, against the windows."""
    rows = q._all(spark, SF)
    want = windows.payload_diversity(windows.source_rate(windows.duplicate_source(windows.flow_features(rows)))).collect()
    names = {c[:3]: c for c in want[0].asDict()}
    want = {(r.pcap_file, r.frame_no): r for r in want}
    made = flows.run_available(rows, flows.all_stream, batch_rows=-(-len(want) // batches)).collect()
    assert len(made) == len({(r.pcap_file, r.frame_no) for r in made}) == len(want)
    for r in made:
        for name in (*flows.FlowState.names, *flows.PayloadState.names, *flows.SourceState.names):
            assert r[name] == pytest.approx(want[r.pcap_file, r.frame_no][names[name]], abs=1e-9)


def test_states_have_few_partitions_and_stay_open(spark, monkeypatch):
    """As many partitions a state as cores, however many a shuffle has, one query for all batches, and no batch without packets."""
    folders, new = [], flows.new_folder
    monkeypatch.setattr(flows, "new_folder", lambda *a: folders.append(new(*a)) or folders[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        made = flows.run_available(q._all(spark, SF), lambda p: flows.all_stream(p, 7200.0), least_batches=3, order=flows.TIME_ORDER)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    at = Path(folders[0].removeprefix("file:")) / "checkpoint"
    for state in range(3):
        assert len([p for p in (at / "state" / str(state)).iterdir() if p.name.isdigit()]) == spark.sparkContext.defaultParallelism
    assert len([p for p in (at / "commits").iterdir() if p.name.isdigit()]) == 3
    assert made.count() == q._all(spark, SF).count()


def test_no_packet(spark):
    rows = q._all(spark, SF).limit(0)
    for stream in (flows.flow_stream, flows.payload_stream, flows.source_stream, flows.all_stream):
        assert flows.run_available(rows, stream).count() == 0


def packet(frame, when, src="a", payload="ff", length=10):
    return ("c", src, "d", 1, 2, "UDP", frame, 1e9 + when, False, length, length, payload, payload)


class Fed:
    """A stream that is fed one batch after another and starts anew for each."""

    def __init__(self, spark, folder, stream):
        self.spark, self.folder, self.count = spark, str(folder), 0
        (folder / "in").mkdir()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", flows.PROVIDER)
        self.made = stream(spark.readStream.schema(PACKET).parquet(f"{self.folder}/in"))

    def batch(self, *packets):
        self.count += 1
        schema = PACKET.removesuffix(", batch int")
        self.spark.createDataFrame(list(packets), schema).coalesce(1).write.parquet(f"{self.folder}/in/batch={self.count}")
        query = self.made.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/checkpoint").option("path", f"{self.folder}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def rows(self):
        return {r.frame_no: r for r in self.spark.read.parquet(f"{self.folder}/out").collect()}


def held(query):
    return [s["numRowsTotal"] for s in query.recentProgress[-1]["stateOperators"]]


def test_keys_start_anew_and_state_goes(spark, tmp_path):
    fed = Fed(spark, tmp_path, lambda p: flows.all_stream(p, 100.0))
    first = held(fed.batch(packet(1, 0), packet(2, 90, length=14), packet(3, 95, "b")))
    fed.batch(packet(4, 150, length=15), packet(5, 151, "b", None))
    # b and its flow are seen last at 151 and the payload at 150; a comes again after its life time, within one batch.
    query = fed.batch(packet(6, 400, length=30), packet(7, 450, length=31), packet(8, 600, length=40))
    got = fed.rows()
    assert [got[n].f01 for n in (1, 2, 4, 6, 7, 8)] == [0, 90, 60, 0, 50, 0]
    assert [got[n].f11 for n in (1, 2, 4, 6, 7, 8)] == [0, 4, 1, 0, 1, 0]
    assert [got[n].f13 for n in (1, 2, 4, 6, 7, 8)] == [0, 1, 1, 0, 1, 0]
    assert [got[n].f14 for n in (1, 2, 3, 4, 5, 6, 7, 8)] == [0, 0, 1, 1, 0, 0, 0, 0]
    assert [got[n].f17 for n in (1, 2, 4, 6, 7, 8)] == [0, 1 / 90, 2 / 150, 0, 1 / 50, 0]
    last = fed.batch(packet(9, 10_000, "z", "00"))
    # Of what the four batches have held only keys of the last one are left: flow, payload and source of z.
    assert sum(held(last)) < sum(first) and sum(held(last)) < sum(held(query)) + 9
    more = fed.batch(packet(10, 10_001, "z", "00"))
    # Two more rows: the segments of the new batch.
    assert sum(held(more)) == sum(held(last)) + 2 and fed.rows()[10].f01 == 1


def test_late_packets_are_left_out_and_counted(spark, tmp_path):
    fed = Fed(spark, tmp_path, lambda p: flows.all_stream(p, 1000.0, "50 seconds"))
    assert flows.late_rows(fed.batch(packet(1, 100), packet(2, 200))) == 0
    query = fed.batch(packet(3, 160), packet(4, 149), packet(5, 210))
    assert flows.late_rows(query) == 1 and sorted(fed.rows()) == [1, 2, 3, 5]


class Values:
    """A map state in memory that counts what is written."""

    def __init__(self):
        self.map, self.written = {}, 0

    def iterator(self):
        return iter(self.map.items())

    def updateValue(self, key, value):
        self.map[key] = value
        self.written += len(value[0])

    def removeKey(self, key):
        del self.map[key]

    def clear(self):
        self.map.clear()


class Value:
    def __init__(self):
        self.now = None

    def get(self):
        return self.now

    def update(self, now):
        self.now = now

    def clear(self):
        self.now = None


def test_source_state_writes_new_packets_only():
    rnd = random.Random(2)
    state = flows.SourceState([])
    state.total, state.times, state.payloads = Value(), Values(), Values()
    rows, made = [], []
    for k, n in enumerate([3, 1500, 1, 2, 700, 700, 5, 1000, 1]):
        new = [(len(rows) + i + rnd.random(), rnd.choice([None, "", *(f"{x:02x}" for x in range(200))])) for i in range(n)]
        rows += new
        before = state.times.written, state.payloads.written
        out = state.packets(pd.DataFrame({"timestamp": [t for t, _ in new], "someip_payload_hex": [p for _, p in new]}), k == 0)
        assert state.times.written - before[0] <= n and state.payloads.written - before[1] <= n
        assert sum(len(v[0]) for v in state.times.map.values()) <= 2000 + n
        made += list(zip(out["f17"], out["f18"]))
    for i, (rate, share) in enumerate(made):
        times = [t for t, _ in rows[max(0, i - 999) : i + 1]]
        said = [p for _, p in rows[: i + 1] if p][-1000:]
        assert rate == pytest.approx(0 if len(times) < 2 else (len(times) - 1) / (times[-1] - times[0]))
        assert share == pytest.approx(len(set(said)) / len(said) if len(said) > 1 else 0)


def test_equal_times():
    assert flows.packet_rates([], [1.0, 1.0, 1.0]).tolist() == [0, 2, 3]
    assert flows.packet_rates([0.0, 0.0], [2.0], 2).tolist() == [0.5]
    assert flows.payload_shares([]).tolist() == [] and flows.payload_shares(["a", "b", "a", "a"], 2).tolist() == [0, 1, 1, 0.5]
