"""The column functions for SQL text: temporary functions whose bodies are SQL, so that queries with them stay in the JVM and are optimised as a whole."""

from __future__ import annotations

from pyspark.sql import SparkSession

from busline.schema import CLASSES, DISCOVERY_SERVICE, HEADER_BYTES, KEPT_PAYLOAD_BYTES, MESSAGE_TYPES, PROTOCOL_VERSION, VALID_MESSAGE_TYPES

_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in MESSAGE_TYPES.items())
_CLASSES = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES))

#: name(parameters) RETURNS type: body. Later ones use earlier ones.
FUNCTIONS = {
    "uint_at(raw BINARY, at INT, size INT) RETURNS BIGINT": "CAST(conv(hex(substring(raw, at + 1, size)), 16, 10) AS BIGINT)",
    "is_message(raw BINARY) RETURNS BOOLEAN": f"coalesce(length(raw) >= {HEADER_BYTES} AND uint_at(raw, 12, 1) = {PROTOCOL_VERSION} AND uint_at(raw, 14, 1) IN ({', '.join(map(str, VALID_MESSAGE_TYPES))}) AND uint_at(raw, 4, 4) >= 8, false)",
    "header_of(raw BINARY) RETURNS STRUCT<service_id: INT, method_id: INT, someip_len: BIGINT, client_id: INT, session_id: INT, proto_ver: INT, iface_ver: INT, msg_type: INT, return_code: INT>": f"""CASE WHEN length(raw) >= {HEADER_BYTES} THEN named_struct('service_id', CAST(uint_at(raw, 0, 2) AS INT), 'method_id', CAST(uint_at(raw, 2, 2) AS INT), 'someip_len', uint_at(raw, 4, 4),
  'client_id', CAST(uint_at(raw, 8, 2) AS INT), 'session_id', CAST(uint_at(raw, 10, 2) AS INT), 'proto_ver', CAST(uint_at(raw, 12, 1) AS INT), 'iface_ver', CAST(uint_at(raw, 13, 1) AS INT),
  'msg_type', CAST(uint_at(raw, 14, 1) AS INT), 'return_code', CAST(uint_at(raw, 15, 1) AS INT)) END""",
    "message_name(code INT) RETURNS STRING": f"CASE code {_NAMES} ELSE concat('0x', lpad(hex(code), 2, '0')) END",
    "is_discovery(service_id INT) RETURNS BOOLEAN": f"service_id = {DISCOVERY_SERVICE}",
    "kept_hex(raw BINARY) RETURNS STRING": f"lower(hex(substring(raw, 1, {KEPT_PAYLOAD_BYTES})))",
    "is_hex(text STRING) RETURNS BOOLEAN": "coalesce(rlike(text, '^([0-9a-fA-F]{2})+$'), false)",
    "bit_distance(a STRING, b STRING) RETURNS DOUBLE": """CASE WHEN is_hex(a) AND is_hex(b) THEN aggregate(sequence(0, least(length(a), length(b)) - 1, 15), 0,
  (bits, at) -> bits + bit_count(coalesce(CAST(conv(substring(a, at + 1, least(15, least(length(a), length(b)) - at)), 16, 10) AS BIGINT), 0) ^ coalesce(CAST(conv(substring(b, at + 1, least(15, least(length(a), length(b)) - at)), 16, 10) AS BIGINT), 0))) / CAST(4 * least(length(a), length(b)) AS DOUBLE) ELSE 0.0D END""",
    "class_index(attack_type STRING) RETURNS INT": f"CASE attack_type {_CLASSES} ELSE 0 END",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, replacing those of the same name, and name them."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
