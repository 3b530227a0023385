"""Packet tables: the view over an event stream, dimension tables, and packets written by this engine or as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.schema import CAPTURES, FLOW, PACKETS, VALID_MESSAGE_TYPES
from busline.sources.store import dealt


def captures(spark: SparkSession) -> DataFrame:
    """pcap_file, attack_type; seven rows."""
    return spark.createDataFrame([(i, f, t) for i, (f, t, _) in enumerate(CAPTURES)], "cap_id int, pcap_file string, attack_type string")


def attackers(spark: SparkSession) -> DataFrame:
    """pcap_file, attacker_ip; seven rows."""
    return spark.createDataFrame([(i, f, ip) for i, (f, _, ips) in enumerate(CAPTURES) for ip in ips], "cap_id int, pcap_file string, attacker_ip string")


def labelled(rows: DataFrame) -> DataFrame:
    """rows (pcap_file, src_ip) with label (the source attacks in this capture) and attack_type (the capture's class).

    Both dimension tables have seven rows, so both joins are broadcast.
    """
    spark = rows.sparkSession
    known = F.broadcast(captures(spark).drop("cap_id"))
    bad = F.broadcast(attackers(spark).select("pcap_file", F.col("attacker_ip").alias("src_ip"), F.lit(1).alias("__bad")))
    joined = rows.join(known, "pcap_file").join(bad, ["pcap_file", "src_ip"], "left")
    return joined.withColumn("label", F.coalesce("__bad", F.lit(0))).drop("__bad")


def packets_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that the events of sf_dir stand for, with their transport payload as raw_hex."""
    e = dealt(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props"), "event_id")
    body = F.lower(F.when(F.expr("event_id % 5 = 0"), F.repeat(F.hex("props"), 10)).otherwise(F.hex("props")))
    two = lambda c: F.lower(F.lpad(F.hex(c), 4, "0"))
    kind = F.when(F.col("event_type") == "view", "00").when(F.col("event_type") == "purchase", "c0").when(F.col("event_type") == "error", "81").otherwise("02")
    sd = F.col("event_type") == "signup"
    head = F.concat(
        F.when(sd, "ffff").otherwise(two(F.expr("4096 + user_id % 4"))), F.when(sd, "8100").otherwise("8001"),
        F.lower(F.lpad(F.hex((F.length("body") / 2 + 8).cast("bigint")), 8, "0")), F.lit("0000"), two(F.expr("event_id % 65536")),
        F.when(F.expr("event_id % 13 = 0"), "02").otherwise("01"), F.lit("01"), kind, F.lit("00"), F.col("body"),
    )
    raw = F.when(F.expr("event_id % 11 = 0"), F.lit(None)).when(F.expr("event_id % 17 = 0"), "deadbeef").otherwise(head)
    named = e.select(
        F.col("event_id").alias("frame_no"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"),
        F.expr("concat('172.18.0.', cast(10 + user_id % 8 AS string))").alias("src_ip"), F.expr("concat('172.18.0.', cast(2 + user_id % 3 AS string))").alias("dst_ip"),
        F.expr("cast(30490 + user_id % 2 AS int)").alias("src_port"), F.lit(30490).alias("dst_port"), F.expr("if(event_id % 3 = 0, 'TCP', 'UDP')").alias("transport"),
        F.expr("cast((day(ts) - 1) % 7 AS int)").alias("cap_id"), body.alias("body"), "event_id", "user_id", "event_type",
    )
    return named.withColumn("raw_hex", raw).drop("body", "event_id", "user_id", "event_type")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet view over the events of sf_dir."""
    r = packets_raw(spark, sf_dir)
    types = [f"{t:02x}" for t in VALID_MESSAGE_TYPES]
    hex_at = lambda a, n: F.col("raw_hex").substr(a, n)
    valid = F.coalesce((F.length("raw_hex") >= 32) & (hex_at(25, 2) == "01") & hex_at(29, 2).isin(types), F.lit(False))
    header = F.when(F.col("transport") == "UDP", 8).otherwise(20)
    size = F.coalesce(F.length("raw_hex"), F.lit(0)) / 2
    v = r.withColumn("someip_valid", valid)
    v = v.select(
        "frame_no", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "transport", (header + size).cast("int").alias("transport_len"),
        (20 + header + size).cast("int").alias("ip_len"), "someip_valid", F.coalesce(F.col("someip_valid") & (hex_at(1, 4) == "ffff"), F.lit(False)).alias("is_sd"),
        hex_at(1, 128).alias("transport_payload_hex"), F.when(F.col("someip_valid"), hex_at(33, 128)).alias("someip_payload_hex"),
        F.when(F.col("someip_valid"), (F.length("raw_hex") / 2 - 16).cast("int")).alias("someip_payload_len"), "cap_id",
    )
    spark = r.sparkSession
    v = v.join(F.broadcast(captures(spark)), "cap_id")
    return labelled(v.drop("cap_id", "attack_type"))


def _read_as(name: str, kind: T.DataType) -> Column:
    """A text column as kind: numbers also where they stand with a fraction, true for "true" and "1" in any case, null where nothing can be read."""
    text = F.nullif(F.trim(F.col(name)), F.lit(""))
    if isinstance(kind, T.StringType):
        return F.nullif(F.col(name), F.lit("")).alias(name)
    if isinstance(kind, T.BooleanType):
        return F.lower(text).isin("true", "1", "1.0").alias(name)
    number = text.try_cast("double")
    return (number if isinstance(kind, T.DoubleType) else F.coalesce(text.try_cast("bigint"), number.try_cast("bigint")).try_cast(kind)).alias(name)


def read_packets(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A packet table with the fixed schema; CSV as written by write_packets() or by hand, empty text being null."""
    if kind != "csv":
        return spark.read.schema(PACKETS).parquet(path)
    # Without a schema all is text and columns go by the names in the header, in whatever order they stand.
    return spark.read.option("header", True).csv(path).select(*[_read_as(f.name, f.dataType) for f in PACKETS])


def write_packets(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "ignore") -> None:
    """Write packets by capture; mode "ignore" leaves a finished table alone, and Spark's commit leaves no half table."""
    if kind == "csv":
        rows.select(*[f.name for f in PACKETS]).write.mode(mode).option("header", True).csv(path)
    else:
        rows.repartition(*FLOW).write.mode(mode).partitionBy("pcap_file").parquet(path)
