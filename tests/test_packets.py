"""Packet engine against literal cases, a sequential pass and DuckDB."""

import collections
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from busline.functions.columns import bit_distance, is_hex, message_type_name
from busline.operators import bytemodel, metrics, prepare, windows
from busline.plans import queries as q
from busline.sources import pcap
from busline.streaming import flows

SF = "/root/testdata/sf0.001"
SCHEMA = "pcap_file string, frame_no bigint, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, transport string, transport_len int, ip_len int, is_sd boolean, transport_payload_hex string, someip_payload_hex string, someip_payload_len int, label int, attack_type string"


def packets(spark, rows):
    """rows: (pcap, frame, ts, src, si, is_sd)."""
    full = [(p, n, float(t), s, "d", 1, 2, "UDP", 8 + n, 28 + n, sd, si, si, len(si) // 2 if si else None, 0, "normal") for p, n, t, s, si, sd in rows]
    return spark.createDataFrame(full, SCHEMA)


def by_frame(df, column):
    return [r[0] for r in df.orderBy("pcap_file", "frame_no").select(F.round(column, 9)).collect()]


def test_bit_distance(spark):
    rows = spark.createDataFrame([("ff00", "0f01"), (None, "00"), ("", "00"), ("ffff", "00"), ("zz", "00"), ("abc", "abc"), ("ab" * 64, "54" * 64)], "a string, b string")
    got = [r[0] for r in rows.select(bit_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [0.3125, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0]
    assert [r[0] for r in rows.select(is_hex(F.col("a"))).collect()] == [True, False, False, True, False, False, True]


def test_names(spark):
    rows = spark.createDataFrame([(0,), (129,), (192,), (None,)], "t int")
    assert [r[0] for r in rows.select(message_type_name(F.col("t"))).collect()] == ["REQUEST", "ERROR", "0xC0", None]


def test_literal_windows(spark):
    one = packets(spark, [("a", i, i, "s", si, False) for i, si in enumerate(["aa", "aa", None, "aa"])])
    assert by_frame(windows.flow_features(one), "f13_payload_repeat_rate") == [0.0, 1.0, 0.0, round(2 / 3, 9)]
    two = packets(spark, [("a", i, i, s, "aa", False) for i, s in enumerate(["x", "y", "y", "x"])])
    assert by_frame(windows.duplicate_source(two), "f14_duplicate_source") == [0.0, 1.0, 0.0, 1.0]
    three = packets(spark, [("a", 0, 5, "x", None, False), ("a", 1, 1, "y", None, False), ("a", 2, 1, "y", None, False), ("a", 3, 1, "z", None, False), ("a", 4, 1.5, "z", None, False)])
    assert by_frame(windows.source_rate(three), "f17_src_packet_rate") == [0.0, 0.0, 2.0, 0.0, 2.0]
    four = packets(spark, [("a", i, i, "s", si, False) for i, si in enumerate(["aa", None, "bb", "aa"])])
    assert by_frame(windows.payload_diversity(four), "f18_src_payload_diversity") == [0.0, 0.0, 1.0, round(2 / 3, 9)]


@pytest.mark.parametrize("seconds,most", [(3600, 1 << 18), (60, 1 << 18), (1 << 20, 5)])
def test_sequential_pass(spark, monkeypatch, seconds, most):
    monkeypatch.setattr(windows, "SLICE_SECONDS", seconds)  # one slice holds most of a flow, or hardly a packet
    monkeypatch.setattr(windows, "SLICE_ROWS", most)  # or slices are cut by counted rows
    monkeypatch.setattr(windows, "PART", 16)
    rnd, window = random.Random(3), 7
    rows = [(rnd.choice("ab"), n, rnd.randrange(0, 9000, 50), rnd.choice("xyz"), rnd.choice([None, "", "aa", "bb", "ccdd", "0f"]), rnd.random() < 0.3) for n in range(400)]
    df = packets(spark, rows)
    out = windows.payload_diversity(windows.source_rate(windows.duplicate_source(windows.flow_features(df)), window), window)
    got = {r.frame_no: r for r in out.collect()}
    last, recent, seen, times, payloads = {}, collections.defaultdict(list), {}, collections.defaultdict(list), collections.defaultdict(list)
    for p, n, t, s, si, sd in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        si = si or None
        flow = (p, s)
        r = got[n]
        assert r.f01_ip_time_interval == pytest.approx(abs(t - last.get((flow, "t"), t)))
        assert r.f08_someip_payload_changes == pytest.approx(0 if sd else flows.bits_apart(last.get((flow, False)), si))
        assert r.f09_someipsd_payload_changes == pytest.approx(flows.bits_apart(last.get((flow, True)), si) if sd else 0)
        h = recent[flow][-5:]
        assert r.f13_payload_repeat_rate == pytest.approx(sum(x == si for x in h) / len(h) if si and h else 0)
        assert r.f14_duplicate_source == float(si is not None and seen.get(si, s) != s)
        last[flow, "t"], last[flow, sd] = t, si
        recent[flow].append(si)
        if si:
            seen[si] = s
            payloads[s].append(si)
        times[s].append(t)
        w, pl = times[s][-window:], payloads[s][-window:]
        rate = 0 if len(w) < 2 else (len(w) - 1) / (w[-1] - w[0]) if w[-1] > w[0] else len(w)
        assert r.f17_src_packet_rate == pytest.approx(rate)
        assert r.f18_src_payload_diversity == pytest.approx(len(set(pl)) / len(pl) if len(pl) > 1 else 0)


def test_scaling_and_split(spark):
    rows = spark.createDataFrame([("a", i, float(i), 5.0, i % 2) for i in range(10)], "pcap_file string, frame_no bigint, x double, c double, label int")
    out = prepare.split(rows)
    assert out.where("is_train").groupBy("label").count().orderBy("label").collect() == [(0, 2), (1, 2)]
    marked = rows.withColumn("is_train", F.col("x").between(2, 6))
    got = prepare.minmax_scaled(marked, ["x", "c"]).orderBy("frame_no").collect()
    assert [r.x for r in got] == [0, 0, 0, 0.25, 0.5, 0.75, 1, 1, 1, 1] and {r.c for r in got} == {0.0}


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (0, 0.9, 1), (1, 0.4, 0), (0, 0.1, 0)], "label int, score double, prediction int")
    assert metrics.auc(rows).first()[0] == pytest.approx(0.625)
    assert metrics.confusion(rows).first() == (1, 1, 1, 1)
    empty = rows.limit(0)
    assert metrics.binary_metrics(empty).first() == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("magic", list(pcap.MAGIC))
def test_captures(spark, tmp_path, magic):
    body = bytes.fromhex("1000800100000008000000010101020000")[:16] + b"\xab"
    ok = pcap.ethernet_frame("172.18.0.11", "172.18.0.2", 7, 8, "UDP", body)
    tcp = pcap.ethernet_frame("172.18.0.12", "172.18.0.2", 7, 8, "TCP", b"")
    vlan = ok[:12] + b"\x81\x00\x00\x01" + ok[12:]
    frames = [(1.5, ok), (2.0, ok[:12] + b"\x86\xdd" + ok[14:]), (2.5, tcp), (3.0, vlan), (4.0, ok[:12] + b"\x08\x06" + ok[14:]), (5.0, ok[:23] + b"\x01" + ok[24:])]
    data = pcap.capture_bytes(frames, magic)
    (tmp_path / "dos_noti_flood.pcap").write_bytes(data + b"\0" * 5)
    for rows in (pcap.scan_captures(spark, str(tmp_path)), pcap.stream_captures(spark, str(tmp_path))):
        got = rows.orderBy("frame_no").collect()
        assert [(r.frame_no, r.transport, r.label, r.attack_type) for r in got] == [(1, "UDP", 1, "dos"), (3, "TCP", 0, "dos"), (4, "UDP", 1, "dos")]
        assert got[0].someip_valid and got[0].service_id == 0x1000 and got[0].someip_payload_hex == "ab" and got[0].msg_type_name == "NOTIFICATION" and got[0].timestamp == 1.5
        assert not got[1].someip_valid and got[1].transport_payload_hex is None and got[1].transport_len == 20
    with pytest.raises(Exception, match="cut off"):
        pcap.scan_captures(spark, str(tmp_path), strict=True).collect()


def test_long_payloads(spark):
    """Beyond 64 and beyond 256 bytes, by hand."""
    rnd = random.Random(4)
    texts = [rnd.randbytes(n).hex() for n in (1, 64, 65, 100, 255, 256, 257, 300)] + ["", None, "abc", "zz" * 80]
    rows = spark.createDataFrame([("a", i, float(i), t, t, False, 0, "normal") for i, t in enumerate(texts)], "pcap_file string, frame_no bigint, timestamp double, someip_payload_hex string, transport_payload_hex string, is_sd boolean, label int, attack_type string")
    got = {r.frame_no: r for r in bytemodel.byte_features(rows).collect()}
    counts = collections.Counter((p, b) for t in texts[:8] for p, b in enumerate(bytes.fromhex(t)))
    reach = collections.Counter(p for t in texts[:8] for p in range(len(t) // 2))
    for i, t in enumerate(texts):
        raw = bytes.fromhex(t) if i < 8 else b""
        want = sum(math.log((counts[p, b] + 1) / (reach[p] + 256) + 1e-12) for p, b in enumerate(raw[:256]))
        assert got[i].f02_someip_likelihood == pytest.approx(want) and got[i].f05_someip_entropy == pytest.approx(-want / len(raw) if raw else 0)
        assert got[i].f03_someipsd_likelihood == pytest.approx(min(len(raw), 256) * math.log(1 / 256 + 1e-12))
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((x, y) for x in texts for y in texts)], "i int, a string, b string")
    for r in pairs.withColumn("d", bit_distance(F.col("a"), F.col("b"))).collect():
        assert r.d == pytest.approx(flows.bits_apart(r.a, r.b))


def test_pieces_of_large_captures(spark, tmp_path):
    frames = [(float(i), pcap.ethernet_frame("172.18.0.11", "172.18.0.2", 7, i, "UDP", bytes(i % 50))) for i in range(200)]
    whole = pcap.capture_bytes(frames)
    (tmp_path / "dos_noti_flood.pcap").write_bytes(whole)
    (tmp_path / "benign_traffic.pcap").write_bytes(whole[:-3])
    (tmp_path / "mitm_single_attacker.pcap").write_bytes(b"no capture")
    shown = ["pcap_file", "frame_no", "timestamp", "dst_port"]
    want = sorted(map(tuple, pcap.scan_captures(spark, str(tmp_path)).select(*shown).collect()))
    assert len(want) == 399
    for size in (100, 1000, 1 << 30):
        assert sorted(map(tuple, pcap.stream_captures(spark, str(tmp_path), span_bytes=size).select(*shown).collect())) == want
    with pytest.raises(Exception, match="cut off|not a capture"):
        pcap.stream_captures(spark, str(tmp_path), strict=True).collect()
    spark.dataSource.register(pcap.PcapSource)
    assert spark.read.format("pcap").load(str(tmp_path)).count() == 399


@pytest.mark.parametrize("name", ["scan_packets", "header_decode", "someip_valid", "features_all", "split", "byte_logp", "byte_scores_long", "hamming_long", "auc", "roc_curve", "multi_metrics", "topk_sources", "capture_union", "capture_counts", "pcap_scan", "stream_features", "stream_payloads", "stream_sources", "stream_all", "stream_lifetime", "headers_in_sql"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(q.ORACLES[name]).df()
    got = q.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda d: sorted(tuple(repr(round(float(v), 5)) if isinstance(v, float) else str(v) for v in r) for r in d.itertuples(index=False))
    assert key(got) == key(want)
