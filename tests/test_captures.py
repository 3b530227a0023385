"""The capture source: files by filter, columns, spans, growing folders, and what is broken."""

import os

import pytest
from pyspark.sql import Observation

from busline.sources import pcap

NAMES = ["benign_traffic.pcap", "dos_noti_flood.pcap", "mitm_single_attacker.pcap"]


def made(n, first=0):
    return [(float(i), pcap.ethernet_frame("172.18.0.11", "172.18.0.2", 7, i, "UDP", bytes(i % 50))) for i in range(first, first + n)]


@pytest.fixture
def folder(tmp_path, spark):
    spark.dataSource.register(pcap.PcapSource)
    (tmp_path / "in").mkdir()
    for k, name in enumerate(NAMES):
        (tmp_path / "in" / name).write_bytes(pcap.capture_bytes(made(50 + k)))
    return tmp_path / "in"


def test_filters_choose_files(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    (folder / NAMES[0]).write_bytes(b"no capture")
    load = lambda: spark.read.format("pcap").option("mode", "FAILFAST").option("filters", "true").load(str(folder))
    with pytest.raises(Exception, match="not a capture"):
        load().count()
    # Another file would raise if it were opened.
    assert load().where(f"pcap_file = '{NAMES[1]}' AND dst_port < 10").count() == 10
    assert load().where(f"pcap_file IN ('{NAMES[1]}', '{NAMES[2]}')").count() == 103
    assert load().where(f"pcap_file IN ('{NAMES[0]}', '{NAMES[2]}') AND pcap_file = '{NAMES[2]}'").count() == 52
    assert load().where("pcap_file = 'none.pcap'").count() == 0
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_columns_and_spans(spark, folder):
    want = sorted(map(tuple, spark.read.format("pcap").load(str(folder)).select("pcap_file", "frame_no", "dst_port").collect()))
    assert len(want) == 153
    for size in ("1", "500", "100000"):
        few = spark.read.format("pcap").schema("dst_port int, frame_no bigint, pcap_file string").option("spanBytes", size).load(f"file://{folder}")
        assert few.columns == ["dst_port", "frame_no", "pcap_file"] and sorted((r[2], r[1], r[0]) for r in few.collect()) == want
    assert spark.read.format("pcap").option("spanBytes", "500").load(str(folder)).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("spans", [None, 300, 1 << 20])
def test_counts_and_rejects_in_one_pass(spark, folder, spans):
    whole = pcap.capture_bytes([*made(20), (9.0, made(1)[0][1][:12] + b"\x08\x06" + bytes(28))])
    (folder / NAMES[0]).write_bytes(whole[:-3])
    (folder / NAMES[1]).write_bytes(whole + b"\0" * 5)
    (folder / NAMES[2]).write_bytes(b"no capture")
    (folder / "fuzzy_sd_offer_rand_noti(1).pcap").write_bytes(whole)
    if spans:
        rows = pcap.stream_captures(spark, str(folder), dropped=True, broken=True, span_bytes=spans)
    else:
        rows = pcap.scan_captures(spark, str(folder), dropped=True, broken=True)
    seen = Observation("captures")
    rows.observe(seen, *pcap.capture_counters()).where("transport IS NOT NULL").write.format("noop").mode("overwrite").save()
    counts, rejects = pcap.capture_report(seen.get)
    assert [tuple(r) for r in counts] == [(NAMES[0], 20, 20, 0, 0, 0.0), (NAMES[1], 21, 20, 1, 20, 1.0), ("fuzzy_sd_offer_rand_noti(1).pcap", 21, 20, 1, 0, 0.0)]
    last = len(whole) - 16 - 42
    assert [tuple(r) for r in rejects] == [(NAMES[0], last, "record cut off"), (NAMES[1], len(whole), "record header cut off"), (NAMES[2], 0, "not a capture file")]


def test_growing_folder(spark, folder, tmp_path):
    frames = spark.readStream.format("pcap").schema("pcap_file string, frame_no bigint, dst_port int").load(str(folder))

    def batch():
        query = frames.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out").start()
        query.processAllAvailable()
        query.stop()
        rows = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
        assert len(rows) == len({r[:2] for r in rows})
        return rows

    assert len(batch()) == 153
    more = pcap.capture_bytes(made(60))
    (folder / NAMES[0]).write_bytes(more[:-7])  # ten more frames, the last of which is still being written
    (folder / "new.pcap").write_bytes(more[:10])
    got = batch()
    assert len(got) == 162 and [(n, p) for f, n, p in got if f == NAMES[0]] == [(i + 1, i) for i in range(59)]
    with open(folder / NAMES[0], "ab") as f:
        f.write(more[-7:])
    (folder / "new.pcap").write_bytes(more)
    got = batch()
    assert len(got) == 223 and [(n, p) for f, n, p in got if f == NAMES[0]] == [(i + 1, i) for i in range(60)]
    assert batch() == got and os.path.isdir(f"{tmp_path}/checkpoint")
