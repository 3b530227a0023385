"""DuckDB SQL for the queries of busline.plans.queries, over the driver's tables."""

from __future__ import annotations

import re

from busline.schema import FEATURES

_VIEW = """cap(cap_id, pcap_file, attack_type) AS (VALUES (0,'benign_traffic.pcap','normal'),(1,'dos_noti_flood.pcap','dos'),
  (2,'fuzzy_sd_offer_rand_noti(1).pcap','fuzzy'),(3,'fuzzy_sd_offer_rand_noti(2).pcap','fuzzy'),(4,'fuzzy_sd_offer_rand_noti(3).pcap','fuzzy'),
  (5,'mitm_multi_attacker.pcap','mitm'),(6,'mitm_single_attacker.pcap','mitm')),
atk(cap_id, attacker_ip) AS (VALUES (1,'172.18.0.11'),(2,'172.18.0.17'),(3,'172.18.0.12'),(4,'172.18.0.12'),(5,'172.18.0.14'),(5,'172.18.0.15'),(6,'172.18.0.13')),
b AS (SELECT event_id AS frame_no, epoch_us(ts) / 1e6 AS timestamp,
  concat('172.18.0.', CAST(10 + user_id % 8 AS string)) AS src_ip, concat('172.18.0.', CAST(2 + user_id % 3 AS string)) AS dst_ip,
  CAST(30490 + user_id % 2 AS int) AS src_port, 30490 AS dst_port,
  CASE WHEN event_id % 3 = 0 THEN 'TCP' ELSE 'UDP' END AS transport, CAST((day(ts) - 1) % 7 AS int) AS cap_id,
  lower(CASE WHEN event_id % 5 = 0 THEN repeat(hex(props), 10) ELSE hex(props) END) AS body, event_id, user_id, event_type FROM events),
raw AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'deadbeef' ELSE concat(
   CASE WHEN event_type = 'signup' THEN 'ffff' ELSE lower(lpad(hex(4096 + user_id % 4), 4, '0')) END, CASE WHEN event_type = 'signup' THEN '8100' ELSE '8001' END,
   lower(lpad(hex(CAST(8 + length(body) / 2 AS bigint)), 8, '0')), '0000', lower(lpad(hex(event_id % 65536), 4, '0')),
   CASE WHEN event_id % 13 = 0 THEN '02' ELSE '01' END, '01',
   CASE event_type WHEN 'view' THEN '00' WHEN 'purchase' THEN 'c0' WHEN 'error' THEN '81' ELSE '02' END, '00', body) END AS raw_hex FROM b),
v AS (SELECT *, coalesce(length(raw_hex) >= 32 AND substr(raw_hex, 25, 2) = '01'
   AND substr(raw_hex, 29, 2) IN ('00','01','02','40','41','42','80','81','c0','c1'), false) AS someip_valid FROM raw),
pk AS (SELECT frame_no, timestamp, src_ip, dst_ip, src_port, dst_port, transport,
  CAST((CASE transport WHEN 'UDP' THEN 8 ELSE 20 END) + coalesce(length(raw_hex), 0) / 2 AS int) AS transport_len,
  CAST(20 + (CASE transport WHEN 'UDP' THEN 8 ELSE 20 END) + coalesce(length(raw_hex), 0) / 2 AS int) AS ip_len,
  someip_valid, coalesce(someip_valid AND substr(raw_hex, 1, 4) = 'ffff', false) AS is_sd, substr(raw_hex, 1, 128) AS transport_payload_hex,
  CASE WHEN someip_valid THEN substr(raw_hex, 33, 128) END AS someip_payload_hex, CASE WHEN someip_valid THEN CAST(length(raw_hex) / 2 - 16 AS int) END AS someip_payload_len,
  CASE WHEN a.attacker_ip IS NOT NULL THEN 1 ELSE 0 END AS label, cap.attack_type, cap.pcap_file
FROM v JOIN cap ON v.cap_id = cap.cap_id LEFT JOIN atk a ON v.cap_id = a.cap_id AND v.src_ip = a.attacker_ip)"""
_FLOW = "pcap_file, src_ip, dst_ip, src_port, dst_port, transport"
_BITS = "CASE WHEN length({a}) > 0 AND length({b}) > 0 THEN bit_count(xor(unhex(substr({a}, 1, least(length({a}), length({b}))))::BIT, unhex(substr({b}, 1, least(length({a}), length({b}))))::BIT)) / (4.0::DOUBLE * least(length({a}), length({b}))) ELSE 0.0::DOUBLE END"


def _bits(a: str, b: str) -> str:
    return _BITS.format(a=a, b=b)


def _hex(column: str, at: int, n: int) -> str:
    """The integer of n bytes at byte `at` of hex text."""
    return f"CAST('0x' || substr({column}, {2 * at + 1}, {2 * n}) AS BIGINT)"


_PARTS = {
    "fl": f"""fl AS (SELECT *, nullif(someip_payload_hex, '') AS si, nullif(transport_payload_hex, '') AS tu, lag(timestamp) OVER f AS pts, lag(ip_len) OVER f AS pip,
  lag(transport_len) OVER f AS ptl, lag(nullif(transport_payload_hex, '')) OVER f AS ptu, lag(nullif(someip_payload_hex, '')) OVER k AS psi, row_number() OVER f AS rn,
  {', '.join(f"lag(nullif(someip_payload_hex, ''), {k}) OVER f AS s{k}" for k in range(1, 6))} FROM pk
  WINDOW f AS (PARTITION BY {_FLOW} ORDER BY timestamp, frame_no), k AS (PARTITION BY {_FLOW}, is_sd ORDER BY timestamp, frame_no))""",
    "flow": f"""flow AS (SELECT pcap_file, frame_no, coalesce(abs(timestamp - pts), 0.0::DOUBLE) AS f01_ip_time_interval,
  CASE WHEN NOT is_sd THEN {_bits('psi', 'si')} ELSE 0.0::DOUBLE END AS f08_someip_payload_changes, CASE WHEN is_sd THEN {_bits('psi', 'si')} ELSE 0.0::DOUBLE END AS f09_someipsd_payload_changes,
  {_bits('ptu', 'tu')} AS f10_tcpudp_payload_changes, coalesce(abs(ip_len - pip), 0)::DOUBLE AS f11_ip_length_changes, coalesce(abs(transport_len - ptl), 0)::DOUBLE AS f12_tcpudp_length_changes,
  CASE WHEN si IS NULL OR rn = 1 THEN 0.0::DOUBLE ELSE ({' + '.join(f'coalesce((s{k} = si)::INT, 0)' for k in range(1, 6))}) / least(5, rn - 1)::DOUBLE END AS f13_payload_repeat_rate FROM fl)""",
    "dup": """dup AS (SELECT pcap_file, frame_no, CASE WHEN nullif(someip_payload_hex, '') IS NOT NULL AND lag(src_ip) OVER (PARTITION BY someip_payload_hex ORDER BY pcap_file, timestamp, frame_no) <> src_ip
  THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f14_duplicate_source FROM pk)""",
    "len": """len AS (SELECT pcap_file, frame_no, coalesce(someip_payload_len, 0)::DOUBLE AS f15_someip_payload_length, coalesce(transport_len, 0)::DOUBLE AS f16_tcpudp_payload_length FROM pk)""",
    "rate": """rt AS (SELECT pcap_file, frame_no, count(*) OVER w AS n, timestamp - first_value(timestamp) OVER w AS dt FROM pk
  WINDOW w AS (PARTITION BY src_ip ORDER BY pcap_file, timestamp, frame_no ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
rate AS (SELECT pcap_file, frame_no, CASE WHEN n < 2 THEN 0.0::DOUBLE WHEN dt > 0 THEN (n - 1) / dt ELSE n::DOUBLE END AS f17_src_packet_rate FROM rt)""",
    "div": """dn AS (SELECT *, count(nullif(someip_payload_hex, '')) OVER (PARTITION BY src_ip ORDER BY pcap_file, timestamp, frame_no ROWS UNBOUNDED PRECEDING) AS nn FROM pk),
du AS (SELECT src_ip, nn, count(DISTINCT someip_payload_hex) OVER w AS d, count(*) OVER w AS k FROM dn WHERE nullif(someip_payload_hex, '') IS NOT NULL
  WINDOW w AS (PARTITION BY src_ip ORDER BY nn ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
div AS (SELECT dn.pcap_file, dn.frame_no, CASE WHEN du.k > 1 THEN du.d / du.k::DOUBLE ELSE 0.0::DOUBLE END AS f18_src_payload_diversity FROM dn LEFT JOIN du USING (src_ip, nn))""",
    "sam": """sam AS (SELECT 'someip' AS model, payload FROM (SELECT someip_payload_hex AS payload FROM pk WHERE label = 0 AND attack_type = 'normal' AND NOT is_sd AND someip_payload_hex <> '' ORDER BY pcap_file, timestamp, frame_no LIMIT 50000)
 UNION ALL SELECT 'someipsd', payload FROM (SELECT someip_payload_hex AS payload FROM pk WHERE label = 0 AND is_sd AND someip_payload_hex <> '' ORDER BY pcap_file, timestamp, frame_no LIMIT 50000)
 UNION ALL SELECT 'tcpudp', payload FROM (SELECT transport_payload_hex AS payload FROM pk WHERE label = 0 AND attack_type = 'normal' AND NOT is_sd AND transport_payload_hex <> '' ORDER BY pcap_file, timestamp, frame_no LIMIT 50000))""",
    "cnt": """cx AS (SELECT model, payload, unnest(range(length(payload) // 2)) AS pos FROM sam),
cnt AS (SELECT model, pos::INT AS pos, ('0x' || substr(payload, 2 * pos + 1, 2))::INT AS byte, count(*) AS n FROM cx WHERE pos < 256 GROUP BY ALL),
tot AS (SELECT model, pos, sum(n)::BIGINT AS pos_total FROM cnt GROUP BY ALL)""",
    "byt": """bx AS (SELECT pcap_file, frame_no, 'si' AS which, someip_payload_hex AS h, unnest(range(length(someip_payload_hex) // 2)) AS pos FROM pk WHERE someip_payload_hex <> ''
 UNION ALL SELECT pcap_file, frame_no, 'tu', transport_payload_hex, unnest(range(length(transport_payload_hex) // 2)) FROM pk WHERE transport_payload_hex <> ''),
bm AS (SELECT x.*, m.model, ln((coalesce(c.n, 0) + 1.0::DOUBLE) / (coalesce(t.pos_total, 0) + 256.0::DOUBLE) + 1e-12::DOUBLE) AS lp
  FROM (SELECT *, ('0x' || substr(h, 2 * pos + 1, 2))::INT AS byte FROM bx WHERE pos < 256) x JOIN (VALUES ('someip', 'si'), ('someipsd', 'si'), ('tcpudp', 'tu')) m(model, w) ON x.which = m.w
  LEFT JOIN cnt c ON c.model = m.model AND c.pos = x.pos AND c.byte = x.byte LEFT JOIN tot t ON t.model = m.model AND t.pos = x.pos),
bs AS (SELECT pcap_file, frame_no, sum(CASE WHEN model = 'someip' THEN lp END) AS a, sum(CASE WHEN model = 'someipsd' THEN lp END) AS b, sum(CASE WHEN model = 'tcpudp' THEN lp END) AS c FROM bm GROUP BY ALL),
byt AS (SELECT pk.pcap_file, pk.frame_no, coalesce(a, 0.0::DOUBLE) AS f02_someip_likelihood, coalesce(b, 0.0::DOUBLE) AS f03_someipsd_likelihood, coalesce(c, 0.0::DOUBLE) AS f04_tcpudp_likelihood,
  coalesce(-a / (length(someip_payload_hex) / 2), 0.0::DOUBLE) AS f05_someip_entropy, coalesce(-b / (length(someip_payload_hex) / 2), 0.0::DOUBLE) AS f06_someipsd_entropy,
  coalesce(-c / (length(transport_payload_hex) / 2), 0.0::DOUBLE) AS f07_tcpudp_entropy FROM pk LEFT JOIN bs ON pk.pcap_file = bs.pcap_file AND pk.frame_no = bs.frame_no)""",
    "spl": """so AS (SELECT pcap_file, frame_no, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || pcap_file || ':' || frame_no), pcap_file, frame_no) AS n, count(*) OVER (PARTITION BY label) AS total FROM pk),
spl AS (SELECT pcap_file, frame_no, label, n <= total // 2 AS is_train FROM so)""",
}
_ALL = ["fl", "flow", "dup", "len", "rate", "div", "sam", "cnt", "byt", "spl"]
# All payloads that fit the byte models.
_PARTS["fit"] = re.sub(r" ORDER BY [a-z_, ]+ LIMIT 50000", "", _PARTS["sam"])
_JOINED = "flow JOIN dup USING (pcap_file, frame_no) JOIN len USING (pcap_file, frame_no) JOIN rate USING (pcap_file, frame_no) JOIN div USING (pcap_file, frame_no) JOIN byt USING (pcap_file, frame_no)"
# The scored half that the metrics work on: scaled f17 as score, class 1 from 0.5 on, the quarter of the score as class.
_PARTS["prd"] = """sc AS (SELECT min(f17_src_packet_rate) AS lo, max(f17_src_packet_rate) AS hi FROM rate JOIN spl USING (pcap_file, frame_no) WHERE is_train),
pr AS (SELECT pk.pcap_file, pk.frame_no, pk.label, pk.attack_type, CASE WHEN hi > lo THEN least(greatest((f17_src_packet_rate - lo) / (hi - lo), 0.0::DOUBLE), 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS score
  FROM pk JOIN rate USING (pcap_file, frame_no) JOIN spl USING (pcap_file, frame_no), sc WHERE NOT is_train),
prd AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction, CASE attack_type WHEN 'dos' THEN 1 WHEN 'fuzzy' THEN 2 WHEN 'mitm' THEN 3 ELSE 0 END AS class_id,
  least(floor(score * 4), 3)::INT AS pred_class FROM pr)"""
_PRD = ["rate", "spl", "prd"]


# Packets with payloads five times as long.
_PACKETS = re.compile(r"\bpk\b")
_PARTS["lp"] = "lp AS (SELECT * REPLACE (repeat(someip_payload_hex, 5) AS someip_payload_hex, repeat(transport_payload_hex, 5) AS transport_payload_hex) FROM pk)"


def _sql(body: str, *parts: str) -> str:
    return f"WITH {', '.join([_VIEW, *(_PARTS[p] for p in parts)])} {body}"


def _of_long(body: str, *parts: str) -> str:
    """_sql() over the long payloads."""
    return f"WITH {', '.join([_VIEW, _PARTS['lp'], *(_PACKETS.sub('lp', _PARTS[p]) for p in parts)])} {body}"


#: Seconds after which a key of a stream with a life time starts anew.
LIFE_SECONDS = 7200.0
# Packets with the number of times that their flow and their source have started anew, in order of time, and the time since their payload was seen.
_TIME = "timestamp, pcap_file, frame_no"
_PARTS["life"] = f"""l0 AS (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY {_FLOW} ORDER BY timestamp, frame_no) AS gf, timestamp - lag(timestamp) OVER (PARTITION BY src_ip ORDER BY {_TIME}) AS gs FROM pk),
pl AS (SELECT *, sum(coalesce((gf > {LIFE_SECONDS})::INT, 0)) OVER (PARTITION BY {_FLOW} ORDER BY timestamp, frame_no) AS nf, sum(coalesce((gs > {LIFE_SECONDS})::INT, 0)) OVER (PARTITION BY src_ip ORDER BY {_TIME}) AS ns FROM l0)"""


def _of_lives(part: str) -> str:
    """A part over packets in order of time whose flows and sources start anew."""
    part = _PACKETS.sub("pl", _PARTS[part]).replace("ORDER BY pcap_file, timestamp, frame_no", f"ORDER BY {_TIME}")
    return part.replace(f"PARTITION BY {_FLOW}", f"PARTITION BY {_FLOW}, nf").replace("PARTITION BY src_ip", "PARTITION BY src_ip, ns").replace("src_ip, nn", "src_ip, ns, nn")


_PARTS["life_dup"] = f"""dup AS (SELECT pcap_file, frame_no, CASE WHEN nullif(someip_payload_hex, '') IS NOT NULL AND lag(src_ip) OVER p <> src_ip AND timestamp - lag(timestamp) OVER p <= {LIFE_SECONDS}
  THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f14_duplicate_source FROM pl WINDOW p AS (PARTITION BY someip_payload_hex ORDER BY {_TIME}))"""
_PARTS |= {f"life_{p}": _of_lives(p) for p in ("fl", "rate", "div")}
_HISTORY = [FEATURES[0], *FEATURES[7:14], *FEATURES[16:18]]
_HELD = "flow JOIN dup USING (pcap_file, frame_no) JOIN rate USING (pcap_file, frame_no) JOIN div USING (pcap_file, frame_no)"

_R6 = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
_HEADER = [("service_id", 0, 2), ("method_id", 2, 2), ("someip_len", 4, 4), ("client_id", 8, 2), ("session_id", 10, 2), ("proto_ver", 12, 1), ("iface_ver", 13, 1), ("msg_type", 14, 1), ("return_code", 15, 1)]

ORACLES = {
    "scan_packets": _sql("SELECT * REPLACE (coalesce(someip_payload_len, -1) AS someip_payload_len) FROM pk"),
    "scan_pruned": _sql("SELECT pcap_file, label FROM pk WHERE transport = 'TCP'"),
    "missing_captures": _sql("SELECT pcap_file FROM cap WHERE pcap_file NOT IN (SELECT pcap_file FROM pk WHERE label = 1)"),
    "capture_union": _sql("SELECT pcap_file, frame_no, src_ip FROM pk"),
    "header_decode": _sql("SELECT frame_no, " + ", ".join(f"{_hex('raw_hex', a, n)}{'::INT' if n < 4 else ''} AS {c}" for c, a, n in _HEADER)
                          + ", substr(raw_hex, 1, 4) = 'ffff' AS is_sd, CAST(length(raw_hex) // 2 - 16 AS INT) AS body_len FROM raw WHERE length(raw_hex) >= 32"),
    "msg_type_name": _sql(f"SELECT frame_no, CASE {_hex('raw_hex', 14, 1)} WHEN 0 THEN 'REQUEST' WHEN 1 THEN 'REQUEST_NO_RETURN' WHEN 2 THEN 'NOTIFICATION' WHEN 128 THEN 'RESPONSE' WHEN 129 THEN 'ERROR' ELSE '0x' || upper(substr(raw_hex, 29, 2)) END AS msg_type_name FROM raw WHERE length(raw_hex) >= 32"),
    "someip_valid": _sql(f"SELECT frame_no, CASE WHEN length(raw_hex) >= 32 THEN substr(raw_hex, 25, 2) = '01' AND substr(raw_hex, 29, 2) IN ('00','01','02','40','41','42','80','81','c0','c1') AND {_hex('raw_hex', 4, 4)} >= 8 ELSE false END AS someip_valid FROM raw"),
    "payload_hex": _sql("SELECT frame_no, CASE WHEN length(raw_hex) > 0 THEN substr(raw_hex, 1, 128) END AS payload_hex, coalesce(CAST(length(raw_hex) // 2 AS INT), 0) AS n_bytes FROM raw"),
    "hex_guard": _sql("SELECT frame_no, k, regexp_full_match(h, '([0-9a-fA-F]{2})+') AS is_hex FROM (SELECT frame_no, k, CASE k WHEN 0 THEN body WHEN 1 THEN substr(body, 2) WHEN 2 THEN replace(body, '2', 'g') ELSE '' END AS h FROM raw, (VALUES (0), (1), (2), (3)) t(k))"),
    "headers_in_sql": _sql(f"""SELECT frame_no, someip_valid AND {_hex('raw_hex', 4, 4)} >= 8 AS valid, {_hex('raw_hex', 0, 2)}::INT AS service_id, {_hex('raw_hex', 10, 2)}::INT AS session_id, {_hex('raw_hex', 4, 4)} AS someip_len,
  CASE {_hex('raw_hex', 14, 1)} WHEN 0 THEN 'REQUEST' WHEN 1 THEN 'REQUEST_NO_RETURN' WHEN 2 THEN 'NOTIFICATION' WHEN 128 THEN 'RESPONSE' WHEN 129 THEN 'ERROR' ELSE '0x' || upper(substr(raw_hex, 29, 2)) END AS msg_type_name,
  substr(raw_hex, 1, 4) = 'ffff' AS is_sd, substr(raw_hex, 1, 128) AS payload_hex, true AS is_hex, {_bits('raw_hex', 'substr(raw_hex, 33, 128)')} AS distance FROM v WHERE length(raw_hex) >= 32"""),
    "sd_share": _sql("SELECT pcap_file, sum(is_sd::INT)::BIGINT AS n_sd, count(*) AS n, sum(is_sd::INT) / count(*)::DOUBLE AS share FROM pk GROUP BY pcap_file"),
    "label_join": _sql("SELECT pcap_file, frame_no, label, attack_type FROM pk"),
    "capture_counts": _sql("SELECT pcap_file, count(*) + count(*) FILTER (frame_no % 7 = 0) AS read, count(*) AS written, count(*) FILTER (frame_no % 7 = 0) AS dropped, sum(label)::BIGINT AS attacks, sum(label) / count(*)::DOUBLE AS share FROM pk GROUP BY pcap_file"),
    "pcap_scan": _sql(f"""SELECT pk.pcap_file, row_number() OVER c + coalesce(sum((pk.frame_no % 7 = 0)::INT) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS frame_no, round(pk.timestamp, 6) AS timestamp, pk.src_ip, pk.dst_ip,
  CASE pk.transport WHEN 'UDP' THEN 17 ELSE 6 END AS ip_proto, 64 AS ip_ttl, ip_len, pk.transport, pk.src_port, pk.dst_port, transport_len, pk.someip_valid, nullif(transport_payload_hex, '') AS transport_payload_hex, someip_payload_hex, label, attack_type,
  {', '.join(f"CASE WHEN pk.someip_valid THEN {_hex('raw_hex', a, n)}{'::INT' if n < 4 else ''} ELSE -1 END AS {c}" for c, a, n in _HEADER if c in ('service_id', 'method_id', 'someip_len', 'session_id', 'msg_type', 'return_code'))},
  coalesce(someip_payload_len, -1) AS someip_payload_len, CASE pk.transport WHEN 'TCP' THEN 24 ELSE -1 END AS tcp_flags, is_sd FROM pk JOIN v ON pk.frame_no = v.frame_no WINDOW c AS (PARTITION BY pk.pcap_file ORDER BY pk.frame_no)"""),
    "capture_summary": _sql("SELECT pcap_file, count(*) AS read, count(*) AS written, 0::BIGINT AS dropped, sum(label)::BIGINT AS attacks, sum(label) / count(*)::DOUBLE AS share FROM pk GROUP BY pcap_file"),
    "class_balance": _sql("SELECT label, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM pk GROUP BY label"),
    "class_index": _sql("SELECT frame_no, CASE attack_type WHEN 'dos' THEN 1 WHEN 'fuzzy' THEN 2 WHEN 'mitm' THEN 3 ELSE 0 END AS class_id FROM pk"),
    "attack_types": _sql("SELECT DISTINCT attack_type FROM pk ORDER BY 1"),
    "hamming_pairs": _sql(f"SELECT frame_no, {_bits('tu', 'si')} AS distance FROM (SELECT frame_no, nullif(transport_payload_hex, '') AS tu, nullif(someip_payload_hex, '') AS si FROM pk)"),
    "model_sample_sizes": _sql("SELECT model, count(*) AS n FROM sam GROUP BY model", "sam"),
    "byte_counts": _sql("SELECT * FROM cnt", "sam", "cnt"),
    "byte_totals": _sql("SELECT * FROM tot", "sam", "cnt"),
    "byte_logp": _sql("SELECT model, pos, byte, n, pos_total, round(ln((n + 1.0::DOUBLE) / (pos_total + 256.0::DOUBLE) + 1e-12::DOUBLE), 9) AS logp FROM cnt JOIN tot USING (model, pos)", "sam", "cnt"),
    "byte_loglik": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES[1:4])} FROM byt", "sam", "cnt", "byt"),
    "byte_xent": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES[4:7])} FROM byt", "sam", "cnt", "byt"),
    "byte_scores_long": _of_long(f"SELECT pcap_file, frame_no, {_R6(FEATURES[1:7])} FROM byt", "sam", "cnt", "byt"),
    "hamming_long": _of_long(f"SELECT frame_no, {_bits('tu', 'si')} AS distance FROM (SELECT frame_no, nullif(transport_payload_hex, '') AS tu, nullif(someip_payload_hex, '') AS si FROM lp)"),
    "f01": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES[:1])} FROM flow", "fl", "flow"),
    "f08_f09": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES[7:9])} FROM flow", "fl", "flow"),
    "f10": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES[9:10])} FROM flow", "fl", "flow"),
    "f11_f12": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES[10:12])} FROM flow", "fl", "flow"),
    "f13": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES[12:13])} FROM flow", "fl", "flow"),
    "stream_features": _sql(f"SELECT pcap_file, frame_no, {_R6([FEATURES[0], *FEATURES[7:13]])} FROM flow", "fl", "flow"),
    "stream_payloads": _sql("SELECT * FROM dup", "dup"),
    "stream_sources": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES[16:])} FROM rate JOIN div USING (pcap_file, frame_no)", "rate", "div"),
    "stream_all": _sql(f"SELECT pcap_file, frame_no, {_R6(_HISTORY)} FROM {_HELD}", "fl", "flow", "dup", "rate", "div"),
    "stream_lifetime": _sql(f"SELECT pcap_file, frame_no, {_R6(_HISTORY)} FROM {_HELD}", "life", "life_fl", "flow", "life_dup", "life_rate", "life_div"),
    "f14": _sql("SELECT * FROM dup", "dup"),
    "f15_f16": _sql("SELECT * FROM len", "len"),
    "f17": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES[16:17])} FROM rate", "rate"),
    "f18": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES[17:])} FROM div", "div"),
    "features_all": _sql(f"SELECT pcap_file, frame_no, {_R6(FEATURES)}, label, attack_type FROM pk JOIN ({_JOINED}) USING (pcap_file, frame_no)", *["fit" if p == "sam" else p for p in _ALL[:-1]]),
    "split": _sql("SELECT * FROM spl", "spl"),
    "minmax_stats": _sql("SELECT " + ", ".join(f"round(min({c}), 6) AS lo_{c}, round(max({c}), 6) AS hi_{c}" for c in FEATURES) + f" FROM spl JOIN ({_JOINED}) USING (pcap_file, frame_no) WHERE is_train", *_ALL),
    "minmax_scaled": _sql("SELECT pcap_file, frame_no, label, is_train, " + ", ".join(f"round(CASE WHEN hi_{c} > lo_{c} THEN least(greatest(({c} - lo_{c}) / (hi_{c} - lo_{c}), 0.0::DOUBLE), 1.0::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS {c}" for c in FEATURES)
                          + f" FROM spl JOIN ({_JOINED}) USING (pcap_file, frame_no), (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURES) + f" FROM spl JOIN ({_JOINED}) USING (pcap_file, frame_no) WHERE is_train)", *_ALL),
    "confusion": _sql("SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM prd", *_PRD),
    "binary_metrics": _sql("""SELECT round((tp + tn) / n::DOUBLE, 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1 FROM (SELECT count(*) AS n, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM prd)""", *_PRD),
    "auc": _sql("""SELECT round((sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p))::DOUBLE, 9) AS auc FROM (SELECT label, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) AS r,
  sum(label) OVER () AS p, count(*) OVER () AS n FROM prd) GROUP BY p, n""", *_PRD),
    "roc_curve": _sql("""SELECT DISTINCT round(score, 9) AS threshold, round(sum(1 - label) OVER w / (sum(1 - label) OVER ())::DOUBLE, 9) AS fpr, round(sum(label) OVER w / (sum(label) OVER ())::DOUBLE, 9) AS tpr FROM prd
  WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", *_PRD),
    "recall_by_type": _sql("""SELECT attack_type, count(*) AS total, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  round(coalesce(count(*) FILTER (label = 1 AND prediction = 1) / nullif(sum(label), 0)::DOUBLE, 0), 9) AS recall FROM prd GROUP BY attack_type""", *_PRD),
    "multi_metrics": _sql("""SELECT class, count(*) FILTER (class_id = k)::BIGINT AS support, count(*) FILTER (pred_class = k)::BIGINT AS predicted, count(*) FILTER (class_id = k AND pred_class = k)::BIGINT AS tp,
  round(coalesce(count(*) FILTER (class_id = k AND pred_class = k) / nullif(count(*) FILTER (class_id = k), 0)::DOUBLE, 0), 9) AS recall, round(coalesce(count(*) FILTER (class_id = k AND pred_class = k) / nullif(count(*) FILTER (pred_class = k), 0)::DOUBLE, 0), 9) AS precision
  FROM (VALUES (0, 'normal'), (1, 'dos'), (2, 'fuzzy'), (3, 'mitm')) c(k, class), prd GROUP BY class""", *_PRD),
    "topk_sources": _sql("SELECT pcap_file, frame_no, src_ip, label, attack_type, round(f17_src_packet_rate, 6) AS f17_src_packet_rate FROM pk JOIN rate USING (pcap_file, frame_no) ORDER BY round(f17_src_packet_rate, 6) DESC, pcap_file, frame_no LIMIT 10", "rate"),
}
