"""Frames to packets: header decode, rejected frames, validation, readable summaries.

Everything is built-in column expressions over the bytes of one frame, so a decode is a narrow scan
without a shuffle. Only the first 74 bytes of a frame (Ethernet, longest IPv4 header, TCP header) are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.functions.bytes import colon_hex, unsigned
from wirelark.schema import (
    ETHER_IPV4,
    ETHERNET_HEADER,
    IP_HEADER,
    PACKETS,
    PROTOCOLS,
    SHOWN_FLAGS,
    TCP_FLAGS,
    TCP_HEADER,
    UDP_HEADER,
    UNKNOWN_PROTOCOL,
)


def protocol_name(number: Column) -> Column:
    name = F.lit(UNKNOWN_PROTOCOL)
    for value, text in PROTOCOLS.items():
        name = F.when(number == value, text).otherwise(name)
    return name


def _once(frames: DataFrame, words: dict[str, Column]) -> DataFrame:
    """``frames`` with the columns ``words``, computed once per frame.

    Plain columns would be worked out again in each place that uses them when a filter on them is moved
    below the projection, and reading bytes is what decoding spends its time on. A generated row stays.
    """
    row = F.struct(*[value.alias(name) for name, value in words.items()])
    return frames.select("*", F.inline(F.array(row)))


def _judged(frames: DataFrame) -> DataFrame:
    """``frames`` with the numbers that decide about validity, and ``reject``: why the frame is invalid, or null.

    The fixed part of the headers is read in four pieces, of which the fields are then taken by shifting.
    """
    raw = F.col("frame")
    start = F.rpad(F.hex(F.substring(raw, 13, 6)), 12, "0")
    pieces = _once(
        frames,
        {
            "_h12": F.conv(start, 16, 10).cast("long"),
            "_h18": unsigned(raw, 18, 6),
            "_h24": unsigned(raw, 24, 6),
            "_h30": unsigned(raw, 30, 4),
        },
    )
    placed = pieces.select(
        "*",
        F.least(F.length("frame"), F.col("caplen")).alias("_n"),
        _bits("_h12", 32, 16).alias("_type"),
        _bits("_h12", 28, 4).alias("_version"),
        _bits("_h12", 24, 4).alias("_ihl"),
        _bits("_h18", 0, 8).alias("_proto"),
        (F.shiftright("_h12", 22).bitwiseAND(60) + ETHERNET_HEADER).cast("int").alias("_at"),
    )
    # Of the transport header: the ports; TCP sequence number or UDP length and checksum; TCP control bits
    # and window; TCP checksum and urgent pointer.
    placed = placed.withColumns({f"_t{i}": unsigned(raw, F.col("_at") + i, 4) for i in (0, 4, 12, 16)})
    n, proto = F.col("_n"), F.col("_proto")
    left = n - F.col("_at")
    carried = proto.isin(list(PROTOCOLS))
    reject = (
        F.when(n < ETHERNET_HEADER, "short ethernet header")
        .when(F.col("_type") != ETHER_IPV4, None)
        .when(n < ETHERNET_HEADER + IP_HEADER, "short ip header")
        .when(F.col("_version") != 4, "ip version")
        .when(F.col("_at") < ETHERNET_HEADER + IP_HEADER, "ip header length")
        .when(~carried, None)
        .when(left < 0, "ip header beyond capture")
        .when((proto == 6) & (left < TCP_HEADER), "short tcp header")
        .when((proto == 6) & (_tcp()["data_offset"] < 5), "tcp data offset")
        .when((proto == 17) & (left < UDP_HEADER), "short udp header")
    )
    return placed.withColumn("reject", reject)


def _bits(piece: str, from_right: int, size: int) -> Column:
    """Some bits of a piece, as a long: a checked cast for each would take more code than the decoding."""
    shifted = F.shiftright(piece, from_right) if from_right else F.col(piece)
    return shifted.bitwiseAND((1 << size) - 1)


def _address(piece: str) -> Column:
    """The text of the IPv4 address in the last four bytes of a piece."""
    return F.concat_ws(".", *[_bits(piece, 8 * i, 8).cast("string") for i in (3, 2, 1, 0)])


# The header fields by name. The fields of a transport header start at byte ``_at`` of the frame.


def _ethernet() -> dict[str, Column]:
    raw = F.col("frame")
    return {"dst_mac": colon_hex(raw, 0, 6), "src_mac": colon_hex(raw, 6, 6), "ether_type": F.col("_type")}


def _ip() -> dict[str, Column]:
    return {
        "version": F.col("_version"),
        "ihl": F.col("_ihl"),
        "tos": _bits("_h12", 16, 8),
        "total_length": _bits("_h12", 0, 16),
        "identification": _bits("_h18", 32, 16),
        "flags": _bits("_h18", 29, 3),
        "fragment_offset": _bits("_h18", 16, 13),
        "ttl": _bits("_h18", 8, 8),
        "protocol": F.col("_proto"),
        "checksum": _bits("_h24", 32, 16),
        "source_ip": _address("_h24"),
        "destination_ip": _address("_h30"),
    }


def _tcp() -> dict[str, Column]:
    return {
        "source_port": _bits("_t0", 16, 16),
        "destination_port": _bits("_t0", 0, 16),
        "sequence_number": F.col("_t4"),
        "acknowledgment_number": unsigned(F.col("frame"), F.col("_at") + 8, 4),
        "data_offset": _bits("_t12", 28, 4),
        "flags": _bits("_t12", 16, 10),
        "window_size": _bits("_t12", 0, 16),
        "checksum": _bits("_t16", 16, 16),
        "urgent_pointer": _bits("_t16", 0, 16),
    }


def _udp() -> dict[str, Column]:
    return {
        "source_port": _bits("_t0", 16, 16),
        "destination_port": _bits("_t0", 0, 16),
        "length": _bits("_t4", 16, 16),
        "checksum": _bits("_t4", 0, 16),
    }


def _kinds() -> tuple[Column, Column, Column]:
    """Of a valid frame: is it IPv4, TCP, UDP."""
    is_ip = F.col("_type") == ETHER_IPV4
    return is_ip, is_ip & (F.col("_proto") == 6), is_ip & (F.col("_proto") == 17)


def _protocol_and_payload() -> dict[str, Column]:
    is_ip, is_tcp, is_udp = _kinds()
    left = F.col("_n") - F.col("_at")
    payload = (
        F.when(is_tcp, F.greatest(left - _tcp()["data_offset"] * 4, F.lit(0)))
        .when(is_udp, left - UDP_HEADER)
        .when(is_ip & (F.col("_proto") == 1), left)
        .otherwise(0)
    )
    name = F.when(is_ip, protocol_name(F.col("_proto"))).otherwise(UNKNOWN_PROTOCOL)
    return {"protocol": name, "payload_length": payload.cast("long")}


def header_fields(frames: DataFrame, protocol: str, names: list[str]) -> DataFrame:
    """Valid frames that have a header of ``protocol`` (ip, tcp, udp), with the source address and the numbers
    ``protocol.name`` of their headers as flat columns ``protocol_name``. Nothing else is read."""
    is_ip, is_tcp, is_udp = _kinds()
    present = {"ip": is_ip, "tcp": is_tcp, "udp": is_udp}[protocol]
    fields = {"ip": _ip(), "tcp": _tcp(), "udp": _udp()}
    picked = [fields[kind][name].cast("int").alias(f"{kind}_{name}") for kind, name in (n.split(".") for n in names)]
    valid = _judged(frames).where(F.col("reject").isNull() & present)
    return valid.select(*frames.columns, fields["ip"]["source_ip"].alias("source_ip"), *picked)


def with_headers(frames: DataFrame) -> DataFrame:
    """``frames`` with the structs ``ethernet``, ``ip``, ``tcp``, ``udp`` (null where absent), ``protocol``,
    ``payload_length`` and ``reject``: why the frame is invalid, or null.

    The payload is counted from the captured bytes, so link-layer padding counts. Frames of other
    Ethernet types and IPv4 packets of other protocols are valid and have protocol UNKNOWN.
    """
    valid = F.col("reject").isNull()
    is_ip, is_tcp, is_udp = _kinds()

    def struct(fields: dict[str, Column]) -> Column:
        texts, longs = ("dst_mac", "src_mac", "source_ip", "destination_ip"), ("sequence_number", "acknowledgment_number")
        return F.struct(
            *[(value if name in texts + longs else value.cast("int")).alias(name) for name, value in fields.items()]
        )

    return _judged(frames).select(
        *frames.columns,
        "reject",
        F.when(valid, struct(_ethernet())).alias("ethernet"),
        F.when(valid & is_ip, struct(_ip())).alias("ip"),
        F.when(valid & is_tcp, struct(_tcp())).alias("tcp"),
        F.when(valid & is_udp, struct(_udp())).alias("udp"),
        *[F.when(valid, value).alias(name) for name, value in _protocol_and_payload().items()],
    )


def decode_frames(frames: DataFrame) -> DataFrame:
    """Valid frames as flat packets; invalid ones are left out. Reads only the header fields packets have."""
    is_ip, is_tcp, is_udp = _kinds()
    ethernet, ip, tcp = _ethernet(), _ip(), _tcp()
    # TCP and UDP ports are in the same place.
    ported = is_tcp | is_udp
    values = {
        "captured_length": F.col("caplen"),
        **ethernet,
        "source_ip": F.when(is_ip, ip["source_ip"]),
        "destination_ip": F.when(is_ip, ip["destination_ip"]),
        "ttl": F.when(is_ip, ip["ttl"]),
        "ip_protocol": F.when(is_ip, ip["protocol"]),
        "source_port": F.when(ported, tcp["source_port"]).otherwise(0),
        "destination_port": F.when(ported, tcp["destination_port"]).otherwise(0),
        "tcp_flags": F.when(is_tcp, tcp["flags"]),
        "tcp_window": F.when(is_tcp, tcp["window_size"]),
        **_protocol_and_payload(),
    }
    return (
        _judged(frames)
        .where(F.col("reject").isNull())
        .select([values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PACKETS])
    )


def decode_failures(frames: DataFrame) -> DataFrame:
    """How many frames each interface delivered that cannot be decoded, by reason."""
    return (
        _judged(frames)
        .where(F.col("reject").isNotNull())
        .groupBy("interface_name", F.col("reject").alias("reason"))
        .agg(F.count("*").alias("frames"))
    )


def checks(frames: DataFrame) -> DataFrame:
    """All frames with ``protocol`` (INVALID if it cannot be decoded), one boolean per validation rule, and ``valid``:
    it can be decoded and all rules hold. A rule about bytes that were not captured holds."""
    is_ip, is_tcp, _ = _kinds()
    has_ip = is_ip & (F.col("_n") >= ETHERNET_HEADER + IP_HEADER)
    has_tcp = has_ip & is_tcp & (F.col("_version") == 4) & (F.col("_ihl") * 4 >= IP_HEADER) & (F.col("_n") - F.col("_at") >= TCP_HEADER)
    rules = {
        "has_length": F.col("length") > 0,
        "has_capture": F.col("caplen") > 0,
        "capture_within_length": F.col("caplen") <= F.col("length"),
        "ip_version_ok": F.when(has_ip, F.col("_version") == 4),
        "ip_header_ok": F.when(has_ip, F.col("_ihl") * 4 >= IP_HEADER),
        "tcp_offset_ok": F.when(has_tcp, _tcp()["data_offset"] >= 5),
    }
    every = F.col("reject").isNull()
    for name in rules:
        every = every & F.col(name)
    judged = _judged(frames)
    protocol = F.when(F.col("reject").isNull(), _protocol_and_payload()["protocol"]).otherwise(F.lit("INVALID"))
    told = judged.select(
        *frames.columns, "reject", protocol.alias("protocol"), *[F.coalesce(r, F.lit(True)).alias(n) for n, r in rules.items()]
    )
    return told.withColumn("valid", every).drop("reject")


def validate_packets(frames: DataFrame) -> DataFrame:
    """Per interface and protocol: frames, valid frames, and the frames that break each rule."""
    return checks(frames).groupBy("interface_name", "protocol").agg(
        F.count("*").alias("packets"),
        F.count_if("valid").alias("valid_packets"),
        F.count_if(~F.col("has_length")).alias("no_length"),
        F.count_if(~F.col("has_capture")).alias("no_capture"),
        F.count_if(~F.col("capture_within_length")).alias("capture_over_length"),
        F.count_if(~F.col("ip_version_ok")).alias("bad_ip_version"),
        F.count_if(~F.col("ip_header_ok")).alias("bad_ip_header"),
        F.count_if(~F.col("tcp_offset_ok")).alias("bad_tcp_offset"),
    )


def packet_summary(packets: DataFrame) -> DataFrame:
    """One readable line per packet."""
    flags = F.concat_ws(
        "",
        *[
            F.when(F.col("tcp_flags").bitwiseAND(TCP_FLAGS[name]) != 0, f" [{name}]")
            for name in SHOWN_FLAGS
        ],
    )
    ports = F.concat_ws(" -> ", F.col("source_port").cast("string"), F.col("destination_port").cast("string"))
    transport = (
        F.when(F.col("protocol") == "TCP", F.concat(F.lit("TCP: "), ports, flags))
        .when(F.col("protocol") == "UDP", F.concat(F.lit("UDP: "), ports))
        .when(F.col("protocol") == "ICMP", F.lit("ICMP"))
        .otherwise(F.concat(F.lit("Protocol: "), F.col("ip_protocol").cast("string")))
    )
    network = F.when(
        F.col("ether_type") == ETHER_IPV4,
        F.concat(
            F.lit("  IP: "), F.col("source_ip"), F.lit(" -> "), F.col("destination_ip"),
            F.lit(" (TTL: "), F.col("ttl").cast("string"), F.lit(")  "), transport,
            F.lit(" (Size: "), F.col("length").cast("string"), F.lit(" bytes)"),
        ),
    )
    line = F.concat(
        F.lit("Packet: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.lit("  Ethernet: "), F.col("src_mac"), F.lit(" -> "), F.col("dst_mac"),
        F.coalesce(network, F.lit("")),
    )
    return packets.select("seq", "ts", line.alias("summary"))
