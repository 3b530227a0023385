"""Order and history of packets that crowd in one flow, one source or one moment."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from busline.operators import bytemodel, metrics, running, windows
from busline.sources import store

PACKET = "pcap_file string, frame_no bigint, timestamp double, label int, attack_type string, is_sd boolean, someip_payload_hex string, transport_payload_hex string"


def crowd(n, seed=1):
    """Packets of which two thirds stand in one second and a third in one microsecond of one capture."""
    rnd = random.Random(seed)
    when = lambda i: 7200.5 if i % 3 == 0 else 7200 + rnd.random() if i % 3 == 1 else rnd.random() * 200_000
    rows = [(rnd.choice(["a", "b", "b", "b", None]), i, when(i), rnd.choice([0, 0, 1]), rnd.choice(["normal", "normal", "dos"]), rnd.random() < 0.3, rnd.choice([f"{i:08x}", None, ""]), f"{i + 10**6:08x}") for i in range(n)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [0, 1, 57, 400, 100_000])
def test_first_payloads_of_each_model(spark, most):
    rows = crowd(3000)
    df = spark.createDataFrame(rows, PACKET).repartition(5)
    want = []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[2], r[1])):
        _, _, _, label, kind, sd, si, tu = r
        for name, fits, text in (("someip", label == 0 and kind == "normal" and not sd, si), ("someipsd", label == 0 and sd, si), ("tcpudp", label == 0 and kind == "normal" and not sd, tu)):
            if fits and text and sum(m == name for m, _ in want) < most:
                want.append((name, text))
    for step_rows in (1, 20, bytemodel.STEP_ROWS):
        assert sorted(map(tuple, bytemodel.samples(df, most, step_rows).collect())) == sorted(want)


def test_no_task_orders_more_than_a_step(spark):
    df = spark.createDataFrame(crowd(3000), PACKET).repartition(5)
    crowded = df.where("pcap_file = 'b' AND timestamp = 7200.5").count()
    for most in (500, 1507, 2000, 2303):
        before, within, left = bytemodel.first_rows(df, {"all": F.lit(True)}, most, 40)["all"]
        assert df.where(before).count() + left == most
        assert left == 0 if within is None else left < df.where(within).count() <= max(40, crowded)
    plan = bytemodel.samples(df, 100_000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Window" not in plan


@pytest.mark.parametrize("most", [7, 100, 1 << 20])
def test_slices_ascend_and_are_bounded(spark, most):
    rows = [(f, i, 1.7e9 + t) for f, i, t, *_ in crowd(3000)] + [("b", 5000 + i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "pcap_file string, frame_no bigint, timestamp double").repartition(5)
    out = running.sliced(df, ["pcap_file"], F.col("timestamp"), 1 << 30, 3600 << 30, F.col("frame_no"), most)
    assert out.columns == [*df.columns, *running.SLICED]
    got = sorted(map(tuple, out.collect()), key=lambda r: (r[0] is not None, r[0], r[2] is not None, r[2], r[1]))
    assert len(got) == len(rows) and max(collections.Counter((r[0], r[3], r[4]) for r in got).values()) <= most
    for a, b in zip(got, got[1:]):
        assert a[0] != b[0] or a[3:] <= b[3:]


def test_one_flow_in_one_second_is_many_slices(spark, monkeypatch):
    """A flow with all packets in a second, half of them at one time: the same features, whatever the slices."""
    rnd = random.Random(9)
    rows = [("a", "s", "d", 1, 2, "UDP", i, 1.7e9 + (0.5 if i % 2 else rnd.random()), bool(rnd.random() < 0.2), rnd.randrange(99), rnd.randrange(99), rnd.choice(["aa", "bb", None]), rnd.choice(["aa", "0f", "", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "pcap_file string, src_ip string, dst_ip string, src_port int, dst_port int, transport string, frame_no bigint, timestamp double, is_sd boolean, ip_len int, transport_len int, transport_payload_hex string, someip_payload_hex string").repartition(4)
    every = lambda: sorted(map(tuple, windows.payload_diversity(windows.source_rate(windows.duplicate_source(windows.flow_features(df)), 9), 9).collect()), key=lambda r: r[6])
    want = every()
    monkeypatch.setattr(windows, "SLICE_ROWS", 10)
    assert windows.sliced(df).select(*windows.SLICE).distinct().count() >= 60
    assert [[round(v, 9) if isinstance(v, float) else v for v in r] for r in every()] == [[round(v, 9) if isinstance(v, float) else v for v in r] for r in want]
    some = windows.flow_features(df, names=["f01_ip_time_interval", "f11_ip_length_changes"])
    assert set(some.columns) == {*df.columns, "f01_ip_time_interval", "f11_ip_length_changes"}


def test_curve_in_slices(spark, monkeypatch):
    rnd = random.Random(4)
    rows = spark.createDataFrame([(rnd.randrange(2), rnd.choice([0.25, 0.5, rnd.random(), 0.5 + rnd.random() / 1000, 1e300, -1e300])) for _ in range(800)], "label int, score double")
    want = metrics.auc(rows).first().auc, sorted(map(tuple, metrics.roc_curve(rows).collect()))
    monkeypatch.setattr(metrics, "sliced", lambda *a: running.sliced(*a, most=11))
    assert metrics.auc(rows).first().auc == pytest.approx(want[0]) and sorted(map(tuple, metrics.roc_curve(rows).collect())) == want[1]


def test_only_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = spark.read.parquet(f"{tmp_path}/one")
    assert store.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(store, "SPREAD_BYTES", 100)
    assert store.spread(rows).rdd.getNumPartitions() == 1
