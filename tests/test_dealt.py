"""Packets of one row group are shared by all cores; bit distances in batches of any size."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from busline.functions import columns
from busline.plans import queries as q
from busline.sources import packets
from busline.streaming import flows


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    duckdb.sql(f"COPY (SELECT event_id + 1000 * g AS event_id, ts, user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet', range(20) r(g)) TO '{folder}/events.parquet' (FORMAT parquet, ROW_GROUP_SIZE 1000000)")
    return str(folder)


@pytest.mark.parametrize("made", [packets.packets, packets.packets_raw, q.hex_guard])
def test_one_row_group_in_many_pieces(spark, one_group, made):
    """A file of one row group that is cut into as many pieces as there are cores: only one of these pieces has rows."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        read = spark.read.parquet(f"{one_group}/events.parquet")
        assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert read.groupBy(F.spark_partition_id()).count().count() == 1
        sizes = [r["count"] for r in made(spark, one_group).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_bits_apart_in_batches(monkeypatch):
    rnd = random.Random(6)
    texts = lambda: [rnd.choice([None, "", "abc", "zz" * 9, "0a\n", "é1", rnd.randbytes(rnd.randrange(40)).hex(), rnd.randbytes(20).hex().upper()]) for _ in range(300)]
    a, b = texts(), texts()
    plain = lambda x, y: 0.0 if any("\n" in (t or "") for t in (x, y)) else flows.bits_apart(x, y)  # noqa: E731  bytes.fromhex() skips white space
    want = [plain(*p) for p in zip(a, b)]
    for most in (1, 7, 100, 1 << 22):
        monkeypatch.setattr(columns, "_DIGITS_AT_ONCE", most)
        assert columns.bits_apart(pa.array(a, pa.string()), pa.array(b, pa.string())).tolist() == want
        assert columns.bits_apart(pa.array([None, *a], pa.string())[1:], pa.array([None, *b], pa.string())[1:]).tolist() == want
    assert columns.bits_apart(pa.array([], pa.string()), pa.array([], pa.string())).tolist() == []
