"""The same questions in DuckDB SQL over the given tables, to check the Spark answers against."""

from __future__ import annotations

# Packets derived from events, by the formula of wirelark.sources.derived.
PACKETS = """
e AS (
  SELECT *, (epoch_us(ts) - 1704067200000000) // 10000 AS off_us, CAST(floor(value * 10 + 0.5) AS BIGINT) AS pl,
         CAST(json_extract_string(props, '$.k') AS INT) + 1 AS k,
         CASE event_type WHEN 'purchase' THEN 17 WHEN 'signup' THEN 1 ELSE 6 END AS ip_protocol
  FROM events),
packets AS (
  SELECT event_id AS seq, 1704067200000000 + off_us AS t, make_timestamp(1704067200000000 + off_us) AS ts,
         CAST(ip_protocol AS INT) AS ip_protocol,
         CASE ip_protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS protocol,
         pl AS payload_length,
         pl + 34 + CASE ip_protocol WHEN 6 THEN 20 WHEN 17 THEN 8 ELSE 0 END AS length,
         34 + least(pl, 64) + CASE ip_protocol WHEN 6 THEN 20 WHEN 17 THEN 8 ELSE 0 END AS caplen,
         '10.0.0.' || (user_id % 8) AS source_ip, '192.168.1.' || (user_id % 4) AS destination_ip,
         CAST(CASE WHEN ip_protocol = 1 THEN 0 ELSE 1024 + user_id END AS INT) AS source_port,
         CAST(CASE WHEN ip_protocol = 1 THEN 0 ELSE k END AS INT) AS destination_port,
         CAST(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 18 WHEN 'view' THEN 16 END AS INT) AS tcp_flags,
         CAST(CASE WHEN ip_protocol = 6 THEN 8192 END AS INT) AS tcp_window,
         CAST(64 AS INT) AS ttl
  FROM e)"""

# The same packets as decoded from frames, of which at most 64 payload bytes were captured.
DECODED = PACKETS.replace("packets AS (", "whole AS (") + """,
packets AS (SELECT * REPLACE (least(payload_length, 64) AS payload_length) FROM whole)"""


def _features(columns: str = "length payload_length ttl ip_protocol source_port destination_port tcp_flags tcp_window") -> list[str]:
    scaled = "CAST(least(1, greatest(0, CAST(CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE) / 65535 AS FLOAT))) AS DOUBLE)"
    return [scaled.format(c=c) for c in columns.split()]


_WEIGHTS = (200.0, 150.0, -40.0, 300.0, -12.0, 8.0, 500.0, 2.0)
_LINEAR = "CAST(-8 AS DOUBLE) + " + " + ".join(
    f"CAST({w} AS DOUBLE) * {f}" for w, f in zip(_WEIGHTS, _features(), strict=True)
)
SCORE = f"(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-({_LINEAR}))))"

SIZES = """
totals AS (
  SELECT *, CAST(count(*) OVER w AS BIGINT) AS n, CAST(sum(length) OVER w AS DOUBLE) AS s,
         CAST(sum(length * length) OVER w AS DOUBLE) AS q
  FROM packets
  WINDOW w AS (PARTITION BY source_ip ORDER BY t, seq ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
moments AS (
  SELECT *, s / n AS mean, CASE WHEN n <= 1 THEN 0 ELSE greatest(0, q / n - (s / n) * (s / n)) END AS variance
  FROM totals),
sizes AS (
  SELECT *, sqrt(variance) AS stddev,
         CASE WHEN sqrt(variance) = 0 THEN 0 ELSE (CAST(length AS DOUBLE) - mean) / sqrt(variance) END AS z_score
  FROM moments)"""

# Trackers of a source, each starting where the one before has expired.
TRACKERS = """
tcp AS (SELECT *, tcp_flags & 2 <> 0 AS is_syn FROM packets WHERE protocol = 'TCP'),
syn AS (SELECT * FROM tcp WHERE is_syn),
carrying AS (SELECT * FROM packets WHERE protocol IN ('TCP', 'UDP')),
connections AS (
  SELECT s.source_ip, s.t0, coalesce(
    (SELECT min(y.t) FROM syn y WHERE y.source_ip = s.source_ip AND y.t >= s.t0 AND y.t < s.t0 + 301000000), s.t0) AS anchor
  FROM (SELECT source_ip, min(t) AS t0 FROM tcp GROUP BY 1) s
  UNION ALL
  SELECT s.source_ip, s.t0, coalesce(
    (SELECT min(y.t) FROM syn y WHERE y.source_ip = s.source_ip AND y.t >= s.t0 AND y.t < s.t0 + 301000000), s.t0) AS anchor
  FROM (SELECT c.source_ip, (SELECT min(x.t) FROM tcp x WHERE x.source_ip = c.source_ip AND x.t >= c.anchor + 301000000) AS t0
        FROM connections c) s
  WHERE s.t0 IS NOT NULL),
scans AS (
  SELECT source_ip, min(t) AS t0 FROM carrying GROUP BY 1
  UNION ALL
  SELECT s.source_ip, s.t0
  FROM (SELECT c.source_ip, (SELECT min(x.t) FROM carrying x WHERE x.source_ip = c.source_ip AND x.t >= c.t0 + 61000000) AS t0
        FROM scans c) s
  WHERE s.t0 IS NOT NULL),
counted AS (
  SELECT p.*, c.t0, c.anchor,
         sum(CASE WHEN is_syn THEN 1 ELSE 0 END) OVER w AS syns, count(*) OVER w AS tcp_packets
  FROM tcp p JOIN connections c ON p.source_ip = c.source_ip AND p.t >= c.t0 AND p.t < c.anchor + 301000000
  WINDOW w AS (PARTITION BY p.source_ip, c.t0 ORDER BY p.t, p.seq ROWS UNBOUNDED PRECEDING)),
anchored AS (SELECT *, CASE WHEN syns > 0 THEN anchor ELSE t0 END AS since FROM counted),
fresh AS (
  SELECT p.*, c.t0,
         row_number() OVER (PARTITION BY p.source_ip, c.t0, p.destination_port ORDER BY p.t, p.seq) = 1 AS is_new
  FROM carrying p JOIN scans c ON p.source_ip = c.source_ip AND p.t >= c.t0 AND p.t < c.t0 + 61000000),
scanned AS (
  SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (
    PARTITION BY source_ip, t0 ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS ports
  FROM fresh)"""


def _alert(kind: str, order: int, severity: int, text: str, source: str, where: str, confidence: str = "1") -> str:
    return f"""
  SELECT ts, seq, CAST({order} AS INT) AS detector_ord, '{kind}' AS type, CAST({severity} AS INT) AS severity,
         {text} AS description, source_ip, destination_ip, source_port, destination_port,
         CAST({confidence} AS DOUBLE) AS confidence_score
  FROM {source} WHERE {where}"""


# With the thresholds that the checks use: 20 SYN in 30 s, 40 TCP packets in 30 s, the rest as by default.
SYN = _alert("SYN_FLOOD", 1, 3, "'SYN flood detected from ' || source_ip", "anchored",
             "is_syn AND syns >= 20 AND t - since < 31000000")
SCAN = _alert("PORT_SCAN", 2, 2, "'Port scan detected from ' || source_ip || ' (' || ports || ' ports)'", "scanned",
              "ports >= 50")
FLOOD = _alert("RATE_LIMIT_EXCEEDED", 3, 3, "'Connection flood detected from ' || source_ip", "anchored",
               "tcp_packets >= 40 AND t - since < 31000000")
PAYLOAD = _alert("SUSPICIOUS_PAYLOAD", 4, 2,
                 "'Large payload detected from ' || source_ip || ' (' || payload_length || ' bytes)'", "packets",
                 "payload_length > 1500")
ZSCORE = _alert("ANOMALOUS_TRAFFIC", 5, 2,
                "'Anomalous packet size from ' || source_ip || ' (z-score: ' || printf('%.6f', z_score) || ')'", "sizes",
                "n > 10 AND abs(z_score) > 3")
ML = _alert("ML_ANOMALY", 6, 3,
            f"'ML anomaly detected from ' || source_ip || ' (confidence: ' || printf('%.6f', {SCORE}) || ')'", "packets",
            f"{SCORE} > 0.8", f"round({SCORE}, 9)")

ALERTS = "alerts AS (" + " UNION ALL ".join([SYN, SCAN, FLOOD, PAYLOAD, ZSCORE, ML]) + ")"
DETECTED = f"WITH RECURSIVE {PACKETS}, {SIZES}, {TRACKERS}, {ALERTS}"

# At most 50 alerts per second, then the first of each signature in 300 s.
CHAIN = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('second', ts) ORDER BY ts, seq, detector_ord) AS rn FROM alerts),
kept AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn <= 50),
signed AS (
  SELECT *, row_number() OVER (
    PARTITION BY type, source_ip, destination_ip, source_port, destination_port, epoch_us(ts) // 300000000
    ORDER BY ts, seq, detector_ord) AS rn FROM kept),
processed AS (SELECT * EXCLUDE (rn) FROM signed WHERE rn = 1)"""
SEVERITY = "CASE severity WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'UNKNOWN' END"
JSON = f"""('{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","type":"' || type || '","severity":"' || {SEVERITY}
  || '","description":"' || description || '","source_ip":"' || source_ip || '","destination_ip":"' || destination_ip
  || '","source_port":' || source_port || ',"destination_port":' || destination_port
  || ',"confidence_score":' || printf('%.3f', confidence_score) || '}}')"""
ALERT_COLUMNS = (
    "ts, seq, detector_ord, type, severity, description, source_ip, destination_ip, source_port, destination_port, "
    "confidence_score"
)
TOTALS = f"""
totals_ AS (
  SELECT (SELECT count(*) FROM alerts) AS received, (SELECT count(*) FROM kept) AS limited,
         (SELECT count(*) FROM processed) AS done,
         (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 FROM alerts) AS span),
statistics AS (
  SELECT received AS total_alerts_received, done AS alerts_processed, received - limited AS alerts_dropped,
         limited - done AS alerts_deduplicated,
         CASE WHEN span > 0 THEN CAST(done AS DOUBLE) / span ELSE 0 END AS processing_rate_aps
  FROM totals_)"""

# How damaged_frames damages frame number seq, and what becomes of it.
DAMAGED = f"""{PACKETS},
damaged AS (
  SELECT *, seq % 16 AS kind, CASE seq % 16
    WHEN 1 THEN 13 WHEN 3 THEN least(caplen, 33) WHEN 6 THEN least(caplen, 54) WHEN 8 THEN least(caplen, 41)
    WHEN 9 THEN 34 WHEN 14 THEN 0 ELSE caplen END AS cap
  FROM packets),
judged AS (
  SELECT *, CASE
    WHEN kind IN (1, 14) THEN 'short ethernet header'
    WHEN kind = 3 THEN 'short ip header'
    WHEN kind = 4 THEN 'ip version'
    WHEN kind = 5 THEN 'ip header length'
    WHEN kind = 6 THEN 'ip header beyond capture'
    WHEN kind IN (8, 9) AND protocol = 'TCP' THEN 'short tcp header'
    WHEN kind IN (8, 9) AND protocol = 'UDP' AND cap < 42 THEN 'short udp header'
    WHEN kind = 10 AND protocol = 'TCP' THEN 'tcp data offset' END AS reason,
    CASE WHEN kind IN (2, 7) THEN 'UNKNOWN' ELSE protocol END AS seen,
    CASE kind WHEN 12 THEN cap - 1 WHEN 13 THEN 0 ELSE length END AS wire
  FROM damaged)"""

FRAME_COLUMNS = "seq, ts, CAST(caplen AS INT) AS caplen, CAST(length AS INT) AS length, CAST(0 AS INT) AS interface_index, 'eth0' AS interface_name"
PACKET_COLUMNS = """seq, ts, CAST(length AS BIGINT) AS length, CAST(caplen AS BIGINT) AS captured_length,
  'eth0' AS interface_name, '02:5a:10:7e:88:06' AS src_mac, '02:5a:10:7e:c4:31' AS dst_mac, CAST(2048 AS INT) AS ether_type,
  source_ip, destination_ip, ttl, ip_protocol, protocol, source_port, destination_port, tcp_flags, tcp_window,
  CAST(payload_length AS BIGINT) AS payload_length"""
FLAGS = " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS shown, '{name}' AS flag, count(*) AS packets FROM packets WHERE tcp_flags & {bit} <> 0 HAVING count(*) > 0"
    for i, (name, bit) in enumerate([("SYN", 2), ("ACK", 16), ("FIN", 1), ("RST", 4), ("PSH", 8), ("URG", 32)], start=1)
)
SUMMARY = """'Packet: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '  Ethernet: 02:5a:10:7e:88:06 -> 02:5a:10:7e:c4:31  IP: '
  || source_ip || ' -> ' || destination_ip || ' (TTL: 64)  ' || CASE protocol
    WHEN 'TCP' THEN 'TCP: ' || source_port || ' -> ' || destination_port
      || CASE WHEN tcp_flags & 2 <> 0 THEN ' [SYN]' ELSE '' END || CASE WHEN tcp_flags & 16 <> 0 THEN ' [ACK]' ELSE '' END
    WHEN 'UDP' THEN 'UDP: ' || source_port || ' -> ' || destination_port ELSE 'ICMP' END
  || ' (Size: ' || length || ' bytes)'"""


def _window(seconds: int) -> str:
    return f"make_timestamp((t // {seconds * 1000000}) * {seconds * 1000000})"


def _with(select: str, tables: str = PACKETS) -> str:
    return f"WITH RECURSIVE {tables} {select}"


def _detected(select: str) -> str:
    return f"{DETECTED} {select}"


def _chained(select: str) -> str:
    return f"{DETECTED}, {CHAIN}, {TOTALS} {select}"


RATES = f"""{PACKETS},
rates AS (SELECT source_ip, {_window(1)} AS ts, count(*) AS packets FROM packets GROUP BY ALL),
totals AS (
  SELECT *, count(*) OVER w AS samples, CAST(sum(packets) OVER w AS DOUBLE) AS s, CAST(sum(packets * packets) OVER w AS DOUBLE) AS q
  FROM rates WINDOW w AS (PARTITION BY source_ip ORDER BY ts ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
moments AS (
  SELECT *, s / samples AS mean,
         CASE WHEN samples <= 1 THEN 0 ELSE greatest(0, q / samples - (s / samples) * (s / samples)) END AS variance
  FROM totals)"""

END_TO_END = f"WITH RECURSIVE {DECODED}, {SIZES}, {TRACKERS}, {ALERTS}, {CHAIN}"
JSON_PARTS = f"""SELECT second, part, count(*) AS alerts, '[' || string_agg({JSON}, ',' ORDER BY ts, seq, detector_ord) || ']' AS json
  FROM (SELECT *, date_trunc('second', ts) AS second, (row_number() OVER (
        PARTITION BY date_trunc('second', ts) ORDER BY ts, seq, detector_ord) - 1) // 40 AS part FROM alerts) GROUP BY 1, 2"""
# The bytes of a frame by the rule that made them, without the two checksums.
_SOURCE, _TARGET = "CAST(split_part(source_ip, '.', 4) AS INT)", "CAST(split_part(destination_ip, '.', 4) AS INT)"
_WORD = lambda x, n: f"lpad(lower(hex(CAST({x} AS BIGINT))), {n}, '0')"
_PORTS = f"{_WORD('source_port', 4)} || {_WORD('destination_port', 4)}"
FRAME_DIGEST = f"""md5(unhex(
    '025a107ec431025a107e88060800' || '4500' || {_WORD('caplen - 14', 4)} || '7a2c400040' || {_WORD('ip_protocol', 2)}
    || '0a0000' || {_WORD(_SOURCE, 2)} || 'c0a801' || {_WORD(_TARGET, 2)}
    || CASE ip_protocol
       WHEN 6 THEN {_PORTS} || {_WORD('seq', 8)} || '0000000050' || {_WORD('tcp_flags', 2)} || '2000' || '0000' || repeat('00', CAST(caplen - 54 AS INT))
       WHEN 17 THEN {_PORTS} || {_WORD('caplen - 34', 4)} || '0000' || repeat('00', CAST(caplen - 42 AS INT))
       ELSE repeat('00', CAST(caplen - 34 AS INT)) END))"""
_IP_SUM = f"(17664 + caplen - 14 + 31276 + 16384 + 16384 + ip_protocol + 2560 + {_SOURCE} + 49320 + 256 + {_TARGET})"
HEADERS = f"""SELECT seq, '02:5a:10:7e:c4:31' AS ethernet_dst_mac, '02:5a:10:7e:88:06' AS ethernet_src_mac, CAST(2048 AS INT) AS ethernet_ether_type,
  CAST(4 AS INT) AS ip_version, CAST(5 AS INT) AS ip_ihl, CAST(0 AS INT) AS ip_tos, CAST(caplen - 14 AS INT) AS ip_total_length,
  CAST(31276 AS INT) AS ip_identification, CAST(2 AS INT) AS ip_flags, CAST(0 AS INT) AS ip_fragment_offset, CAST(64 AS INT) AS ip_ttl,
  CAST(ip_protocol AS INT) AS ip_protocol,
  CAST(xor(65535 - ({_IP_SUM} % 65536 + {_IP_SUM} // 65536), CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END) AS INT) AS ip_checksum,
  source_ip AS ip_source_ip, destination_ip AS ip_destination_ip,
  CAST(CASE ip_protocol WHEN 6 THEN source_port END AS INT) AS tcp_source_port, CAST(CASE ip_protocol WHEN 6 THEN destination_port END AS INT) AS tcp_destination_port,
  CAST(CASE ip_protocol WHEN 6 THEN seq END AS BIGINT) AS tcp_sequence_number, CAST(CASE ip_protocol WHEN 6 THEN 0 END AS BIGINT) AS tcp_acknowledgment_number,
  CAST(CASE ip_protocol WHEN 6 THEN 5 END AS INT) AS tcp_data_offset, CAST(CASE ip_protocol WHEN 6 THEN tcp_flags END AS INT) AS tcp_flags,
  CAST(CASE ip_protocol WHEN 6 THEN 8192 END AS INT) AS tcp_window_size, CAST(CASE ip_protocol WHEN 6 THEN 0 END AS INT) AS tcp_urgent_pointer,
  CAST(CASE ip_protocol WHEN 17 THEN source_port END AS INT) AS udp_source_port, CAST(CASE ip_protocol WHEN 17 THEN destination_port END AS INT) AS udp_destination_port,
  CAST(CASE ip_protocol WHEN 17 THEN caplen - 34 END AS INT) AS udp_length, CAST(CASE ip_protocol WHEN 17 THEN 0 END AS INT) AS udp_checksum FROM packets"""
SCAN_WINDOWS = f"""SELECT {_window(60)} AS window_start, source_ip, count(DISTINCT destination_port) AS ports FROM packets
  WHERE protocol IN ('TCP', 'UDP') GROUP BY ALL HAVING count(DISTINCT destination_port) >= 50"""
CAPTURE_RATES = """SELECT 'eth0' AS interface_name, make_timestamp(slot * 10000000) AS window_start, make_timestamp((slot + 1) * 10000000) AS sampled_at,
  count(*) AS packets_captured, CAST(count(*) AS DOUBLE) / 10 AS capture_rate_pps,
  CAST(sum(count(*) FILTER (tcp_flags = 2)) OVER (ORDER BY slot) AS BIGINT) AS packets_dropped,
  CAST(sum(count(*) FILTER (protocol = 'ICMP')) OVER (ORDER BY slot) AS BIGINT) AS packets_if_dropped
  FROM (SELECT *, t // 10000000 AS slot FROM packets) GROUP BY slot"""
STAGE_STATISTICS = (
    "SELECT CAST(1 AS INT) AS position, 'needs_ports' AS stage, count(*) FILTER (protocol <> 'ICMP') AS packets_processed, "
    "count(*) FILTER (protocol = 'ICMP') AS errors FROM packets UNION ALL SELECT CAST(2 AS INT), 'any', count(*), CAST(0 AS BIGINT) FROM packets"
)
SYN_WINDOWS = f"SELECT {_window(1)} AS window_start, source_ip, count(*) AS syn_packets FROM packets WHERE tcp_flags & 2 <> 0 GROUP BY ALL"


def _by_time(steps: list[tuple[int, float]], base: float) -> str:
    """The value of a setting for a packet: each of ``steps`` holds from so many seconds after the first packet on."""
    cases = " ".join(f"WHEN t >= 1704067200000000 + {after} * 1000000 THEN {value}" for after, value in reversed(steps))
    return f"CASE {cases} ELSE {base} END"


# The settings of the query of this name, which change while packets come.
_SYN_LIMIT = _by_time([(60, 10), (210, 25)], 20)
_TCP_LIMIT = _by_time([(60, 60), (130, 30)], 40)
_PORT_LIMIT = _by_time([(60, 40)], 50)
_Z_LIMIT = _by_time([(130, 2.5)], 3)
_SAMPLE_LIMIT = _by_time([(200, 200)], 10)
_PAYLOAD_LIMIT = _by_time([(130, 4000)], 1500)
_ML_LIMIT = _by_time([(210, 0.9)], 0.8)
_OFF = lambda start, stop: f"(t >= 1704067200000000 + {start} * 1000000 AND t < 1704067200000000 + {stop} * 1000000)"
VERSIONED = f"""WITH RECURSIVE {PACKETS}, ruled AS (SELECT * FROM packets WHERE NOT {_OFF(100, 130)}),
measured AS (SELECT * FROM packets WHERE NOT {_OFF(180, 200)}), scored AS (SELECT * FROM packets WHERE NOT {_OFF(170, 210)}),
{SIZES.replace("FROM packets", "FROM measured")}, {TRACKERS.replace("FROM packets", "FROM ruled")}, alerts AS ("""
VERSIONED += " UNION ALL ".join(
    [
        _alert("SYN_FLOOD", 1, 3, "'SYN flood detected from ' || source_ip", "anchored", f"is_syn AND syns >= {_SYN_LIMIT} AND t - since < 31000000"),
        _alert("PORT_SCAN", 2, 2, "'Port scan detected from ' || source_ip || ' (' || ports || ' ports)'", "scanned", f"ports >= {_PORT_LIMIT}"),
        _alert("RATE_LIMIT_EXCEEDED", 3, 3, "'Connection flood detected from ' || source_ip", "anchored", f"tcp_packets >= {_TCP_LIMIT} AND t - since < 31000000"),
        _alert("SUSPICIOUS_PAYLOAD", 4, 2, "'Large payload detected from ' || source_ip || ' (' || payload_length || ' bytes)'", "ruled", f"payload_length > {_PAYLOAD_LIMIT}"),
        _alert("ANOMALOUS_TRAFFIC", 5, 2, "'Anomalous packet size from ' || source_ip || ' (z-score: ' || printf('%.6f', z_score) || ')'", "sizes",
               f"n > {_SAMPLE_LIMIT} AND abs(z_score) > {_Z_LIMIT}"),
        _alert("ML_ANOMALY", 6, 3, f"'ML anomaly detected from ' || source_ip || ' (confidence: ' || printf('%.6f', {SCORE}) || ')'", "scored",
               f"{SCORE} > {_ML_LIMIT}", f"round({SCORE}, 9)"),
    ]
)
VERSIONED += f") SELECT {ALERT_COLUMNS} FROM alerts"
EXTERNAL = "external AS (SELECT * REPLACE (CAST(5 + seq % 6 AS DOUBLE) / 10 AS confidence_score, CAST(1 AS INT) AS severity) FROM alerts)"
RATED = """CAST(CASE WHEN type IN ('SYN_FLOOD', 'ML_ANOMALY') THEN 3 WHEN type IN ('PORT_SCAN', 'RATE_LIMIT_EXCEEDED') THEN 2
  WHEN confidence_score > 0.8 THEN 2 ELSE 1 END AS INT)"""


def oracle_sql() -> dict[str, str]:
    return {
        "read_frames": _with(f"SELECT {FRAME_COLUMNS}, {FRAME_DIGEST} AS frame FROM packets"),
        "stream_frames": _with(f"SELECT {FRAME_COLUMNS}, {FRAME_DIGEST} AS frame FROM packets"),
        "decode_headers": _with(HEADERS),
        "capture_predicate": _with(
            "SELECT source_ip, destination_port, count(*) AS packets FROM packets "
            "WHERE protocol = 'TCP' AND destination_port < 1024 AND tcp_flags & 2 <> 0 GROUP BY ALL"
        ),
        "snap_truncate": _with(
            "SELECT seq, ts, CAST(least(caplen, 60) AS INT) AS caplen, CAST(length AS INT) AS length, "
            "CAST(least(caplen, 60) AS INT) AS frame_bytes FROM packets"
        ),
        "capture_filter": f"WITH {DAMAGED} SELECT seen AS protocol, count(*) AS packets FROM judged "
        "WHERE reason IS NULL AND kind <> 2 GROUP BY 1",
        "alert_json_sink": _detected(f"SELECT CAST(ts AS DATE) AS date, {JSON} AS json FROM alerts"),
        "alert_fanout": _detected(
            "SELECT 'archive' AS output, count(*) AS alerts FROM alerts UNION ALL "
            "SELECT 'severe', count(*) FROM alerts WHERE severity >= 3"
        ),
        "decode_frames": _with(f"SELECT {PACKET_COLUMNS} FROM packets", DECODED),
        "decode_failures": f"WITH {DAMAGED} SELECT 'eth0' AS interface_name, reason, count(*) AS frames FROM judged "
        "WHERE reason IS NOT NULL GROUP BY ALL",
        "protocol_mix": _with(
            "SELECT protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, "
            "CAST(sum(payload_length) AS BIGINT) AS payload_bytes FROM packets GROUP BY 1"
        ),
        "tcp_flag_counts": _with(FLAGS),
        "packet_summary": _with(f"SELECT seq, ts, {SUMMARY} AS summary FROM packets"),
        "validate_packets": f"""WITH {DAMAGED} SELECT 'eth0' AS interface_name, CASE WHEN reason IS NULL THEN seen ELSE 'INVALID' END AS protocol,
            count(*) AS packets, count(*) FILTER (reason IS NULL AND kind NOT IN (12, 13)) AS valid_packets,
            count(*) FILTER (kind = 13) AS no_length, count(*) FILTER (kind = 14) AS no_capture,
            count(*) FILTER (cap > wire) AS capture_over_length, count(*) FILTER (kind = 4) AS bad_ip_version,
            count(*) FILTER (kind = 5) AS bad_ip_header, count(*) FILTER (kind = 10 AND protocol = 'TCP') AS bad_tcp_offset
            FROM judged GROUP BY ALL""",
        "ip_checksum_audit": _with(
            "SELECT source_ip, count(*) AS audited, count(*) FILTER (seq % 7 = 0) AS mismatches FROM packets GROUP BY 1"
        ),
        "tcp_checksum_audit": _with(
            "SELECT source_ip, count(*) AS audited, count(*) FILTER (seq % 7 = 0) AS mismatches FROM packets "
            "WHERE protocol = 'TCP' GROUP BY 1"
        ),
        "feature_vector": _with(
            "SELECT seq, ts, " + ", ".join(f"{f} AS f{i}" for i, f in enumerate(_features(), start=1)) + " FROM packets"
        ),
        "suspicious_payload": _with(PAYLOAD),
        "packet_statistics": _with(f"""SELECT {_window(60)} AS window_start, count(*) AS total_packets,
            count(*) FILTER (protocol = 'TCP') AS tcp_packets, count(*) FILTER (protocol = 'UDP') AS udp_packets,
            count(*) FILTER (protocol = 'ICMP') AS icmp_packets, CAST(sum(length) AS BIGINT) AS total_bytes,
            CAST(count(*) AS DOUBLE) / 60 AS packets_per_second, CAST(sum(length) AS DOUBLE) / 60 AS bytes_per_second,
            CAST(sum(length) AS DOUBLE) / count(*) AS average_packet_size FROM packets GROUP BY 1"""),
        "capture_statistics": _with("""SELECT 'eth0' AS interface_name, count(*) AS packets_captured,
            count(*) FILTER (tcp_flags = 2) AS packets_dropped, count(*) FILTER (protocol = 'ICMP') AS packets_if_dropped,
            count(*) / ((max(t) - min(t)) / 1e6) AS capture_rate_pps,
            CAST(count(*) FILTER (tcp_flags = 2) AS DOUBLE) / (count(*) + count(*) FILTER (tcp_flags = 2)) * 100
              AS drop_rate_percent FROM packets"""),
        "syn_rate_windows": _with(f"{SYN_WINDOWS} HAVING count(*) >= 5"),
        "port_scan_windows": _with(
            f"SELECT {_window(60)} AS window_start, source_ip, count(DISTINCT destination_port) AS ports FROM packets "
            "WHERE protocol IN ('TCP', 'UDP') GROUP BY ALL HAVING count(DISTINCT destination_port) >= 50"
        ),
        "connection_rate_windows": _with(
            f"SELECT {_window(1)} AS window_start, source_ip, count(*) AS tcp_packets FROM packets "
            "WHERE protocol = 'TCP' GROUP BY ALL HAVING count(*) >= 6"
        ),
        "packet_rate_series": _with(
            "SELECT source_ip, ts, packets, samples, mean, variance, sqrt(variance) AS stddev FROM moments", RATES
        ),
        "detection_statistics": _detected("""SELECT (SELECT count(*) FROM packets) AS total_packets_analyzed,
            count(*) AS anomalies_detected, count(*) FILTER (detector_ord <= 4) AS rule_based_alerts,
            count(*) FILTER (detector_ord = 5) AS statistical_alerts, count(*) FILTER (detector_ord = 6) AS ml_alerts,
            CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM packets) AS detection_rate FROM alerts"""),
        "detect_syn_flood": _with(SYN, f"{PACKETS}, {TRACKERS}"),
        "detect_port_scan": _with(SCAN, f"{PACKETS}, {TRACKERS}"),
        "detect_connection_flood": _with(FLOOD, f"{PACKETS}, {TRACKERS}"),
        "rolling_size_stats": _with(
            "SELECT seq, ts, source_ip, destination_ip, source_port, destination_port, length, n AS samples, mean, "
            "variance, stddev, z_score FROM sizes", f"{PACKETS}, {SIZES}"
        ),
        "size_zscore_alerts": _with(ZSCORE, f"{PACKETS}, {SIZES}"),
        "ml_score": _with(f"SELECT seq, ts, round({SCORE}, 9) AS score FROM packets"),
        "ml_anomaly_alerts": _with(ML),
        "state_expiry": _with("""SELECT 'connection' AS tracker, c.source_ip, make_timestamp(c.anchor) AS first_seen,
              count(*) FILTER (is_syn) AS syn_count, count(*) AS connection_count, CAST(NULL AS BIGINT) AS ports
            FROM (SELECT source_ip, max(t0) AS t0, max(anchor) AS anchor FROM connections GROUP BY 1) c
            JOIN tcp p ON p.source_ip = c.source_ip AND p.t >= c.t0
            WHERE (SELECT max(t) FROM packets) - c.anchor < 301000000 GROUP BY ALL
            UNION ALL
            SELECT 'port scan', c.source_ip, make_timestamp(c.t0), NULL, NULL, count(DISTINCT destination_port)
            FROM (SELECT source_ip, max(t0) AS t0 FROM scans GROUP BY 1) c
            JOIN carrying p ON p.source_ip = c.source_ip AND p.t >= c.t0
            WHERE (SELECT max(t) FROM packets) - c.t0 < 61000000 GROUP BY ALL""", f"{PACKETS}, {TRACKERS}"),
        "detect_all": _detected(f"SELECT {ALERT_COLUMNS} FROM alerts"),
        "alert_rate_limit": _chained(f"SELECT {ALERT_COLUMNS} FROM kept"),
        "alert_dedup": _chained(f"SELECT {ALERT_COLUMNS} FROM processed"),
        "alert_severity": f"{DETECTED}, {EXTERNAL} SELECT ts, seq, detector_ord, type, confidence_score, {RATED} AS severity FROM external",
        "alert_risk_score": _detected(
            "SELECT ts, seq, detector_ord, CAST(severity AS DOUBLE) * CAST(25 AS DOUBLE) * confidence_score AS risk_score FROM alerts"
        ),
        "recent_alerts": _detected(f"SELECT {ALERT_COLUMNS} FROM alerts ORDER BY ts DESC, seq DESC, detector_ord DESC LIMIT 100"),
        "alert_retention": _detected(f"SELECT {ALERT_COLUMNS} FROM alerts WHERE ts >= (SELECT max(ts) FROM alerts) - INTERVAL 60 SECOND"),
        "alert_json": _detected(f"SELECT ts, seq, detector_ord, {JSON} AS json FROM alerts"),
        "alert_json_array": _detected(JSON_PARTS),
        "alert_statistics": _chained("SELECT * FROM statistics"),
        "alert_severity_counts": _detected("""SELECT CAST(l.severity AS INT) AS severity, l.severity_name, count(a.seq) AS alerts
            FROM (VALUES (1, 'LOW'), (2, 'MEDIUM'), (3, 'HIGH'), (4, 'CRITICAL')) l(severity, severity_name)
            LEFT JOIN alerts a USING (severity) GROUP BY ALL"""),
        "alert_statistics_json": _chained("""SELECT '{"total_alerts_received":' || total_alerts_received || ',"alerts_processed":'
            || alerts_processed || ',"alerts_dropped":' || alerts_dropped || ',"alerts_deduplicated":' || alerts_deduplicated
            || ',"processing_rate_aps":' || printf('%.2f', processing_rate_aps) || ',"severity_counts":[' ||
            (SELECT count(*) FILTER (severity = 1) || ',' || count(*) FILTER (severity = 2) || ',' ||
                    count(*) FILTER (severity = 3) || ',' || count(*) FILTER (severity = 4) FROM processed) || ']}' AS json
            FROM statistics"""),
        "stage_pipeline": _with(
            "SELECT 'protocols' AS stage, protocol AS key, count(*) AS packets FROM packets GROUP BY ALL UNION ALL "
            "SELECT 'talkers', source_ip, count(*) FROM packets GROUP BY ALL UNION ALL "
            "SELECT 'large', source_ip, count(*) FROM packets WHERE payload_length > 1500 GROUP BY ALL"
        ),
        "stage_statistics": _with(STAGE_STATISTICS),
        "threshold_config": _with(
            f"SELECT window_start, source_ip, syn_packets, CAST(5 AS DOUBLE) AS threshold, syn_packets >= 5 AS over FROM ({SYN_WINDOWS})"
        ),
        "end_to_end": f"{END_TO_END} SELECT ts, seq, detector_ord, {JSON} AS json FROM processed",
        "stream_connection_rate_windows": _with(
            f"SELECT {_window(1)} AS window_start, source_ip, count(*) AS tcp_packets FROM packets "
            "WHERE protocol = 'TCP' GROUP BY ALL HAVING count(*) >= 6"
        ),
        "stream_syn_rate_windows": _with(f"{SYN_WINDOWS} HAVING count(*) >= 5"),
        "stream_port_scan_windows": _with(
            f"SELECT {_window(60)} AS window_start, source_ip, count(DISTINCT destination_port) AS ports FROM packets "
            "WHERE protocol IN ('TCP', 'UDP') GROUP BY ALL HAVING count(DISTINCT destination_port) >= 50"
        ),
        "stream_alert_dedup": f"{DETECTED}, kept AS (SELECT * FROM alerts), " + CHAIN.split("kept AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn <= 50),")[1]
        + f" SELECT {ALERT_COLUMNS} FROM processed",
        "stream_alert_chain": _chained(f"SELECT {ALERT_COLUMNS} FROM processed"),
        "versioned_settings": VERSIONED,
        "stage_live_statistics": _with(STAGE_STATISTICS),
        "stage_emitted_rows": _with(
            " UNION ALL ".join(
                f"SELECT source_ip, '{name}' AS flag, CAST({bit} AS INT) AS bit, count(*) AS packets FROM packets WHERE tcp_flags & {bit} <> 0 GROUP BY source_ip"
                for name, bit in (("SYN", 2), ("ACK", 16))
            )
        ),
        "ml_pipeline_score": _with(
            f"SELECT seq, ts, round((x - least_x) * (CAST(1 AS DOUBLE) / (most_x - least_x)), 9) AS score FROM "
            f"(SELECT seq, ts, {_features('payload_length')[0]} AS x FROM packets), "
            f"(SELECT min({_features('payload_length')[0]}) AS least_x, max({_features('payload_length')[0]}) AS most_x FROM packets)"
        ),
        "capture_rates": _with(CAPTURE_RATES),
        "stream_capture_rates": _with(CAPTURE_RATES),
        "clustered_predicate": _with(
            "SELECT destination_port, protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets "
            "WHERE source_ip = '10.0.0.3' AND destination_ip = '192.168.1.3' AND destination_port BETWEEN 1 AND 20 GROUP BY ALL"
        ),
        "alert_store": f"""{DETECTED}, moved AS (SELECT * REPLACE (ts - to_days(CAST(seq % 8 AS INT)) AS ts) FROM alerts)
            SELECT {ALERT_COLUMNS} FROM moved WHERE ts >= (SELECT max(ts) FROM moved) - INTERVAL 3 DAY""",
        "stream_recent_alerts": _detected(f"SELECT {ALERT_COLUMNS} FROM alerts ORDER BY ts DESC, seq DESC, detector_ord DESC LIMIT 100"),
        "stream_versioned_settings": VERSIONED,
        "sketched_port_scans": _with(SCAN_WINDOWS),
        "stream_sketched_port_scans": _with(SCAN_WINDOWS),
        "stream_end_to_end": f"{END_TO_END} SELECT ts, seq, detector_ord, {JSON} AS json FROM processed",
    }
