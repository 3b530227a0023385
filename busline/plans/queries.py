"""The queries of the packet engine for the driver; each has SQL in busline.plans.oracle, except trained models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.functions.columns import bit_distance, class_index, header_fields, is_discovery, is_hex, is_valid_message, kept_hex, message_type_name, ratio, uint_at
from busline.functions import sql as functions
from busline.operators import bytemodel, metrics, prepare, windows
from busline.plans import models
from busline.plans.oracle import LIFE_SECONDS, ORACLES
from busline.schema import CLASSES, FEATURES, FLOW, HEADER_BYTES, KEY
from busline.sources import packets as sources
from busline.sources import pcap
from busline.sources.store import dealt, stored
from busline.streaming import flows

_all = sources.packets


def _rounded(rows: DataFrame, names: list[str], digits: int = 6) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in names]


def _features(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*KEY, *_rounded(rows, names))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return sources.packets_raw(spark, d).withColumn("raw", F.unhex("raw_hex"))


def scan_packets(spark, d):
    return _all(spark, d).select("frame_no", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "transport", "transport_len", "ip_len", "someip_valid", "is_sd", "transport_payload_hex", "someip_payload_hex", F.coalesce("someip_payload_len", F.lit(-1)).alias("someip_payload_len"), "label", "attack_type", "pcap_file")


def scan_pruned(spark, d):
    """Two columns and a filter, which reach the scan."""
    return _all(spark, d).where("transport = 'TCP'").select("pcap_file", "label")


def missing_captures(spark, d):
    """Captures without an attacker's packet: expected less present."""
    return sources.captures(spark).select("pcap_file").join(_all(spark, d).where("label = 1").select("pcap_file"), "pcap_file", "left_anti")


def capture_union(spark, d):
    """The rows of all captures that are listed, in one scan: what putting them together again gives."""
    return _all(spark, d).join(F.broadcast(sources.captures(spark).select("pcap_file")), "pcap_file", "left_semi").select("pcap_file", "frame_no", "src_ip")


def header_decode(spark, d):
    raw = _raw(spark, d)
    raw = raw.where(F.length("raw") >= HEADER_BYTES)
    return raw.select("frame_no", *header_fields(F.col("raw")), is_discovery(uint_at(F.col("raw"), 0, 2)).alias("is_sd"), (F.length("raw") - HEADER_BYTES).alias("body_len"))


def msg_type_name(spark, d):
    return _raw(spark, d).where(F.length("raw") >= HEADER_BYTES).select("frame_no", message_type_name(uint_at(F.col("raw"), 14, 1)).alias("msg_type_name"))


def someip_valid(spark, d):
    return _raw(spark, d).select("frame_no", is_valid_message(F.col("raw")).alias("someip_valid"))


def payload_hex(spark, d):
    return _raw(spark, d).select("frame_no", kept_hex(F.col("raw")).alias("payload_hex"), F.coalesce(F.length("raw"), F.lit(0)).alias("n_bytes"))


def hex_guard(spark, d):
    """Valid hex, an odd number of digits, a letter that is no digit, and empty text."""
    body = F.lower(F.when(F.expr("event_id % 5 = 0"), F.repeat(F.hex("props"), 10)).otherwise(F.hex("props")))
    rows = dealt(spark.read.parquet(f"{d}/events.parquet").select("event_id", "props"), "event_id").select(F.col("event_id").alias("frame_no"), body.alias("body"), F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    h = F.when(F.col("k") == 0, F.col("body")).when(F.col("k") == 1, F.substring("body", 2, 1 << 30)).when(F.col("k") == 2, F.replace("body", F.lit("2"), F.lit("g"))).otherwise("")
    return rows.select("frame_no", "k", is_hex(h).alias("is_hex"))


#: A query in SQL text alone, with the functions of busline.functions.sql.
HEADERS_SQL = """
WITH frames AS (SELECT frame_no, raw_hex, unhex(raw_hex) AS raw FROM {packets}),
heads AS (SELECT *, header_of(raw) AS head, is_message(raw) AS valid FROM frames)
SELECT frame_no, valid, head.service_id, head.session_id, head.someip_len, message_name(head.msg_type) AS msg_type_name, is_discovery(head.service_id) AS is_sd, kept_hex(raw) AS payload_hex,
  is_hex(raw_hex) AS is_hex, bit_distance(raw_hex, kept_hex(substring(raw, 17))) AS distance FROM heads WHERE head IS NOT NULL
"""


def headers_in_sql(spark, d):
    functions.register(spark)
    return spark.sql(HEADERS_SQL, packets=sources.packets_raw(spark, d))


def sd_share(spark, d):
    per = _all(spark, d).groupBy("pcap_file").agg(F.sum(F.coalesce("is_sd", F.lit(False)).cast("bigint")).alias("n_sd"), F.count("*").alias("n"))
    return per.withColumn("share", ratio(F.col("n_sd"), F.col("n")))


def label_join(spark, d):
    return _all(spark, d).select("pcap_file", "frame_no", "label", "attack_type")


def capture_summary(spark, d):
    return metrics.capture_summary(_all(spark, d))


def class_balance(spark, d):
    return metrics.class_balance(_all(spark, d))


def class_ids(spark, d):
    return _all(spark, d).select("frame_no", class_index(F.col("attack_type")).alias("class_id"))


def attack_types(spark, d):
    return _all(spark, d).select("attack_type").distinct().orderBy("attack_type")


def hamming_pairs(spark, d):
    return _all(spark, d).select("frame_no", bit_distance(windows.payload("transport_payload_hex"), windows.payload("someip_payload_hex")).alias("distance"))


def model_sample_sizes(spark, d):
    return bytemodel.samples(_all(spark, d)).groupBy("model").agg(F.count("*").alias("n"))


def _counts(spark, d):
    return bytemodel.byte_counts(bytemodel.samples(_all(spark, d)))


def byte_totals(spark, d):
    return bytemodel.byte_totals(_counts(spark, d))


def byte_logp(spark, d):
    return bytemodel.byte_logp(_counts(spark, d)).withColumn("logp", F.round("logp", 9))


_PAYLOADS = ["someip_payload_hex", "transport_payload_hex"]


def _byte_features(rows, names):
    """Byte features of rows, of which what fitting and scoring read is stored, as it is read four times."""
    rows = stored(rows.select(*KEY, "timestamp", "label", "attack_type", "is_sd", *_PAYLOADS), "payloads")
    return _features(bytemodel.byte_features(rows.select(*KEY, *_PAYLOADS), fit_on=rows), names)


def byte_loglik(spark, d):
    return _byte_features(_all(spark, d), FEATURES[1:4])


def byte_xent(spark, d):
    return _byte_features(_all(spark, d), FEATURES[4:7])


def _long(spark, d):
    """Packets with payloads five times as long, beyond what captures keep and what the models know."""
    return _all(spark, d).withColumns({c: F.repeat(c, 5) for c in ("someip_payload_hex", "transport_payload_hex")})


def byte_scores_long(spark, d):
    return _byte_features(_long(spark, d), FEATURES[1:7])


def hamming_long(spark, d):
    return _long(spark, d).select("frame_no", bit_distance(windows.payload("transport_payload_hex"), windows.payload("someip_payload_hex")).alias("distance"))


#: What the features of a flow look at besides its keys and time.
_LOOKED_AT = {FEATURES[7]: ["is_sd", "someip_payload_hex"], FEATURES[8]: ["is_sd", "someip_payload_hex"], FEATURES[9]: ["transport_payload_hex"], FEATURES[10]: ["ip_len"], FEATURES[11]: ["transport_len"], FEATURES[12]: ["someip_payload_hex"]}


def _flow(names):
    def query(spark, d):
        rows = _all(spark, d).select(*dict.fromkeys([*FLOW, *KEY, "timestamp", *(c for f in names for c in _LOOKED_AT.get(f, []))]))
        return _features(windows.flow_features(stored(windows.sliced(rows), "flows"), names=names), names)

    return query


def _narrow(spark, d, *columns):
    return _all(spark, d).select(*KEY, "timestamp", "src_ip", *columns)


def f14(spark, d):
    return windows.duplicate_source(_narrow(spark, d, "someip_payload_hex")).select(*KEY, FEATURES[13])


def f15_f16(spark, d):
    return windows.lengths(_all(spark, d)).select(*KEY, *FEATURES[14:16])


def f17(spark, d):
    return _features(windows.source_rate(_narrow(spark, d)), FEATURES[16:17])


def f18(spark, d):
    return _features(windows.payload_diversity(_narrow(spark, d, "someip_payload_hex")), FEATURES[17:])


def features_all(spark, d):
    rows = prepare.features(_all(spark, d))
    return rows.select(*KEY, *_rounded(rows, FEATURES), "label", "attack_type")


def split(spark, d):
    return prepare.split(_all(spark, d).select(*KEY, "label"))


def _prepared(spark, d, sample=None):
    return stored(prepare.split(prepare.features(_all(spark, d), sample=sample)), "split")


def minmax_stats(spark, d):
    stats = prepare.minmax_stats(prepare.split(prepare.features(_all(spark, d), sample=bytemodel.SAMPLE)))  # read once, so the split is not stored
    return stats.select(*_rounded(stats, stats.columns))


def minmax_scaled(spark, d):
    rows = prepare.minmax_scaled(_prepared(spark, d, bytemodel.SAMPLE))
    return rows.select(*KEY, "label", "is_train", *_rounded(rows, FEATURES))


def predictions(spark, d):
    """Rows that the metrics need no trained model for: the scaled source rate as score of the held-out half."""
    rate = windows.source_rate(_all(spark, d).select(*KEY, "timestamp", "src_ip", "label", "attack_type"))
    rate = stored(rate.select(*KEY, FEATURES[16], "label", "attack_type"), "rate")
    rows = prepare.minmax_scaled(stored(prepare.split(rate), "split"), [FEATURES[16]]).where("NOT is_train")
    rows = rows.select(*KEY, "label", "attack_type", F.col(FEATURES[16]).alias("score"))
    return metrics.with_classes(rows).withColumns({"prediction": (F.col("score") >= 0.5).cast("int"), "pred_class": F.least(F.floor(F.col("score") * 4), F.lit(3)).cast("int")})


def confusion(spark, d):
    return metrics.confusion(predictions(spark, d))


def binary_metrics(spark, d):
    m = metrics.binary_metrics(predictions(spark, d))
    return m.select(*_rounded(m, m.columns, 9))


def auc(spark, d):
    m = metrics.auc(predictions(spark, d))
    return m.select(*_rounded(m, m.columns, 9))


def roc_curve(spark, d):
    m = metrics.roc_curve(predictions(spark, d))
    return m.select(*_rounded(m, m.columns, 9))


def recall_by_type(spark, d):
    return metrics.recall_by_type(predictions(spark, d)).withColumn("recall", F.round("recall", 9))


def multi_metrics(spark, d):
    m = metrics.multi_metrics(predictions(spark, d))
    return m.withColumns({c: F.round(c, 9) for c in ("recall", "precision")})


def topk_sources(spark, d):
    """The ten packets of highest source rate; the limit is the feature."""
    rows = windows.source_rate(_narrow(spark, d, "label", "attack_type"))
    rows = rows.select(*KEY, "src_ip", "label", "attack_type", F.round(FEATURES[16], 6).alias(FEATURES[16]))
    return rows.orderBy(F.desc(FEATURES[16]), *KEY).limit(10)


def _scaled(spark, d):
    return stored(prepare.minmax_scaled(_prepared(spark, d)), "scaled")


def gbt_predictions(spark, d):
    rows = _scaled(spark, d)
    model = models.fit_binary(rows.where("is_train"))
    return models.predict_binary(model, rows.where("NOT is_train")).select(*KEY, "label", "attack_type", "prediction", "score")


def ovr_predictions(spark, d):
    rows = _scaled(spark, d)
    model = models.fit_multi(rows.where("is_train"))
    return models.predict_multi(model, rows.where("NOT is_train")).select(*KEY, "attack_type", "class_id", "pred_class")


def softmax_predictions(spark, d):
    """Class and probabilities of the test half by one softmax model of all classes."""
    rows = _scaled(spark, d)
    out = models.predict_softmax(models.fit_softmax(rows.where("is_train")), rows.where("NOT is_train"))
    return out.select(*KEY, "attack_type", "class_id", "pred_class", *[F.col("probabilities")[i].alias(f"p_{c}") for i, c in enumerate(CLASSES)])


def softmax_importances(spark, d):
    """Mean gain by feature in the softmax model."""
    return models.gain_importances(models.fit_softmax(_scaled(spark, d).where("is_train")))


def importances(spark, d):
    return models.importances(models.fit_binary(_scaled(spark, d).where("is_train")))


def _captured(spark, d):
    """Captures, in pieces, of the packets with a frame of another protocol after each seventh."""
    rows = sources.packets_raw(spark, d).select("src_ip", "dst_ip", "src_port", "dst_port", "transport", "raw_hex", "timestamp", "frame_no", "cap_id")
    return pcap.written_captures(rows, other=7)


def pcap_scan(spark, d):
    """Captures decoded to the packet table; frame numbers run on from piece to piece, and -1 stands for no value."""
    rows = pcap.decode_captures(_captured(spark, d))
    absent = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("service_id", "method_id", "someip_len", "session_id", "msg_type", "return_code", "someip_payload_len", "tcp_flags")]
    shown = ["pcap_file", "frame_no", F.round("timestamp", 6).alias("timestamp"), "src_ip", "dst_ip", "ip_proto", "ip_ttl", "ip_len", "transport", "src_port", "dst_port", "transport_len", "someip_valid", "transport_payload_hex", "someip_payload_hex", "label", "attack_type"]
    return rows.select(*shown, *absent, F.coalesce("is_sd", F.lit(False)).alias("is_sd"))


def capture_counts(spark, d):
    """Frames read, written and dropped of each capture."""
    return metrics.capture_summary(pcap.decode_captures(_captured(spark, d), dropped=True))


def _streamed(spark, d, stream, names, order=None):
    """Features that a stream in three micro-batches makes of all packets."""
    made = flows.run_available(_all(spark, d), stream, least_batches=3, order=order)
    return made.select(*KEY, *[F.round(n[:3], 6).alias(n) for n in names])


def stream_features(spark, d):
    """Flow features of the packets read as a stream, with state kept by flow."""
    return _streamed(spark, d, flows.flow_stream, [FEATURES[0], *FEATURES[7:13]])


def stream_payloads(spark, d):
    """f14 of the packets read as a stream, with state kept by payload."""
    return _streamed(spark, d, flows.payload_stream, [FEATURES[13]])


def stream_sources(spark, d):
    """f17 and f18 of the packets read as a stream, with state kept by source."""
    return _streamed(spark, d, flows.source_stream, FEATURES[16:18])


#: Features from a packet's history.
HISTORY = [FEATURES[0], *FEATURES[7:14], *FEATURES[16:18]]


def stream_all(spark, d):
    """All features from history of the packets read as one stream: states by flow, payload and source in one query."""
    return _streamed(spark, d, flows.all_stream, HISTORY)


def stream_lifetime(spark, d):
    """The same in order of time, where a flow, payload or source unseen for two hours starts anew and its state is dropped in event time."""
    return _streamed(spark, d, lambda packets: flows.all_stream(packets, LIFE_SECONDS), HISTORY, flows.TIME_ORDER)


QUERIES = {
    "scan_packets": scan_packets, "scan_pruned": scan_pruned, "missing_captures": missing_captures, "capture_union": capture_union, "header_decode": header_decode,
    "msg_type_name": msg_type_name, "someip_valid": someip_valid, "payload_hex": payload_hex, "hex_guard": hex_guard, "headers_in_sql": headers_in_sql, "sd_share": sd_share, "label_join": label_join,
    "capture_summary": capture_summary, "class_balance": class_balance, "class_index": class_ids, "attack_types": attack_types, "hamming_pairs": hamming_pairs,
    "model_sample_sizes": model_sample_sizes, "byte_counts": _counts, "byte_totals": byte_totals, "byte_logp": byte_logp, "byte_loglik": byte_loglik, "byte_xent": byte_xent,
    "byte_scores_long": byte_scores_long, "hamming_long": hamming_long,
    "f01": _flow(FEATURES[:1]), "f08_f09": _flow(FEATURES[7:9]), "f10": _flow(FEATURES[9:10]), "f11_f12": _flow(FEATURES[10:12]), "f13": _flow(FEATURES[12:13]),
    "f14": f14, "f15_f16": f15_f16, "f17": f17, "f18": f18, "features_all": features_all, "split": split, "minmax_stats": minmax_stats, "minmax_scaled": minmax_scaled,
    "confusion": confusion, "binary_metrics": binary_metrics, "auc": auc, "roc_curve": roc_curve, "recall_by_type": recall_by_type, "multi_metrics": multi_metrics,
    "topk_sources": topk_sources, "gbt_predictions": gbt_predictions, "ovr_predictions": ovr_predictions, "importances": importances,
    "softmax_predictions": softmax_predictions, "softmax_importances": softmax_importances, "pcap_scan": pcap_scan, "capture_counts": capture_counts,
    "stream_features": stream_features, "stream_payloads": stream_payloads, "stream_sources": stream_sources, "stream_all": stream_all, "stream_lifetime": stream_lifetime,
}
__all__ = ["ORACLES", "QUERIES"]
