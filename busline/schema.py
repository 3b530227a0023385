"""Column names, types and fixed tables of the packet engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: The directed flow of a packet, the order of packets, and the row key.
FLOW = ["pcap_file", "src_ip", "dst_ip", "src_port", "dst_port", "transport"]
ORDER = ["pcap_file", "timestamp", "frame_no"]
KEY = ["pcap_file", "frame_no"]

# Columns of the packet table in order (frame_no, the position in the capture, is this engine's own), names of the
# features in order, captures with their class and attackers, message types, classes.
PACKETS = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("ip_proto", T.IntegerType()),
    T.StructField("ip_ttl", T.IntegerType()),
    T.StructField("ip_len", T.IntegerType()),
    T.StructField("ip_id", T.IntegerType()),
    T.StructField("ip_flags", T.IntegerType()),
    T.StructField("transport", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("transport_len", T.IntegerType()),
    T.StructField("tcp_seq", T.LongType()),
    T.StructField("tcp_ack", T.LongType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("someip_valid", T.BooleanType()),
    T.StructField("service_id", T.IntegerType()),
    T.StructField("method_id", T.IntegerType()),
    T.StructField("someip_len", T.LongType()),
    T.StructField("client_id", T.IntegerType()),
    T.StructField("session_id", T.IntegerType()),
    T.StructField("proto_ver", T.IntegerType()),
    T.StructField("iface_ver", T.IntegerType()),
    T.StructField("msg_type", T.IntegerType()),
    T.StructField("msg_type_name", T.StringType()),
    T.StructField("return_code", T.IntegerType()),
    T.StructField("is_sd", T.BooleanType()),
    T.StructField("transport_payload_hex", T.StringType()),
    T.StructField("someip_payload_hex", T.StringType()),
    T.StructField("someip_payload_len", T.IntegerType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("pcap_file", T.StringType()),
    T.StructField("frame_no", T.LongType()),
])
FEATURES = [
    "f01_ip_time_interval", "f02_someip_likelihood", "f03_someipsd_likelihood", "f04_tcpudp_likelihood", "f05_someip_entropy", "f06_someipsd_entropy",
    "f07_tcpudp_entropy", "f08_someip_payload_changes", "f09_someipsd_payload_changes", "f10_tcpudp_payload_changes", "f11_ip_length_changes",
    "f12_tcpudp_length_changes", "f13_payload_repeat_rate", "f14_duplicate_source", "f15_someip_payload_length", "f16_tcpudp_payload_length",
    "f17_src_packet_rate", "f18_src_payload_diversity",
]
CAPTURES = [
    ("benign_traffic.pcap", "normal", []),
    ("dos_noti_flood.pcap", "dos", ["172.18.0.11"]),
    ("fuzzy_sd_offer_rand_noti(1).pcap", "fuzzy", ["172.18.0.17"]),
    ("fuzzy_sd_offer_rand_noti(2).pcap", "fuzzy", ["172.18.0.12"]),
    ("fuzzy_sd_offer_rand_noti(3).pcap", "fuzzy", ["172.18.0.12"]),
    ("mitm_multi_attacker.pcap", "mitm", ["172.18.0.14", "172.18.0.15"]),
    ("mitm_single_attacker.pcap", "mitm", ["172.18.0.13"]),
]
MESSAGE_TYPES = {0x00: "REQUEST", 0x01: "REQUEST_NO_RETURN", 0x02: "NOTIFICATION", 0x80: "RESPONSE", 0x81: "ERROR"}
VALID_MESSAGE_TYPES = [0x00, 0x01, 0x02, 0x40, 0x41, 0x42, 0x80, 0x81, 0xC0, 0xC1]
PROTOCOL_VERSION = 1
HEADER_BYTES = 16
DISCOVERY_SERVICE = 0xFFFF
CLASSES = ["normal", "dos", "fuzzy", "mitm"]
KEPT_PAYLOAD_BYTES = 64
