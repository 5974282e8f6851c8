"""Column layouts shared by the operators, and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Ethernet types, IP protocol numbers, header sizes.
ETHER_IPV4 = 0x0800
ETHER_IPV6 = 0x86DD
ETHER_ARP = 0x0806
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP"}
UNKNOWN_PROTOCOL = "UNKNOWN"
ETHERNET_HEADER = 14
IP_HEADER = 20
TCP_HEADER = 20
UDP_HEADER = 8

# TCP flag bits.
TCP_FLAGS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32}
# Fixed order in which flags are shown.
SHOWN_FLAGS = ("SYN", "ACK", "FIN", "RST", "PSH")

# Severity levels and alert types.
SEVERITIES = {1: "LOW", 2: "MEDIUM", 3: "HIGH", 4: "CRITICAL"}
LOW, MEDIUM, HIGH, CRITICAL = 1, 2, 3, 4
SYN_FLOOD = "SYN_FLOOD"
PORT_SCAN = "PORT_SCAN"
ANOMALOUS_TRAFFIC = "ANOMALOUS_TRAFFIC"
SUSPICIOUS_PAYLOAD = "SUSPICIOUS_PAYLOAD"
RATE_LIMIT_EXCEEDED = "RATE_LIMIT_EXCEEDED"
ML_ANOMALY = "ML_ANOMALY"

# Order in which the detectors look at one packet; breaks ties between alerts of the same packet.
DETECTOR_ORDER = {
    SYN_FLOOD: 1,
    PORT_SCAN: 2,
    RATE_LIMIT_EXCEEDED: 3,
    SUSPICIOUS_PAYLOAD: 4,
    ANOMALOUS_TRAFFIC: 5,
    ML_ANOMALY: 6,
}

FRAMES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("caplen", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("interface_index", T.IntegerType()),
        T.StructField("interface_name", T.StringType()),
        T.StructField("frame", T.BinaryType()),
    ]
)

PACKETS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("captured_length", T.LongType()),
        T.StructField("interface_name", T.StringType()),
        T.StructField("src_mac", T.StringType()),
        T.StructField("dst_mac", T.StringType()),
        T.StructField("ether_type", T.IntegerType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("ip_protocol", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("destination_port", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("payload_length", T.LongType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("detector_ord", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("destination_port", T.IntegerType()),
        T.StructField("confidence_score", T.DoubleType()),
    ]
)

# The columns of a packet that an alert about it needs.
ALERT_SUBJECT = ["seq", "ts", "source_ip", "destination_ip", "source_port", "destination_port"]
# Total order of alerts.
ALERT_ORDER = ["ts", "seq", "detector_ord"]
