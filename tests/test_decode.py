"""Hand-made frames, one per rule of the decoder."""

import datetime

import pytest

from wirelark.operators import audit, decode
from wirelark.schema import FRAMES, PACKETS

MACS = "025a107ec431" + "025a107e8806"
SYN = MACS + "0800" + "450000287a2c40004006" + "0000" + "0a141e29" + "0a141e2a" + "9c4501bb0000002a000000005002200000000000"


def ip(proto: int, first: str = "45", length: int = 40) -> str:
    return f"{MACS}0800{first}00{length:04x}7a2c400040{proto:02x}00000a141e290a141e2a"


TCP = "9c4501bb0000002a0000000050022000" + "00000000"
CASES = {
    # name: (hex, reject reason or None, expected packet fields)
    "syn": (SYN, None, dict(protocol="TCP", source_ip="10.20.30.41", destination_ip="10.20.30.42", source_port=40005,
                            destination_port=443, ttl=64, tcp_flags=2, tcp_window=8192, payload_length=0,
                            dst_mac="02:5a:10:7e:c4:31", src_mac="02:5a:10:7e:88:06", ether_type=0x0800)),
    "ten bytes": (SYN[:20], "short ethernet header", None),
    "thirteen bytes": (SYN[:26], "short ethernet header", None),
    "empty": ("", "short ethernet header", None),
    "arp": (MACS + "0806" + "00" * 28, None, dict(protocol="UNKNOWN", source_ip=None, payload_length=0, source_port=0)),
    "ipv6": (MACS + "86dd" + "60" + "00" * 39, None, dict(protocol="UNKNOWN", destination_ip=None)),
    "bare ethernet": (MACS + "0806", None, dict(protocol="UNKNOWN")),
    "33 bytes": (SYN[:66], "short ip header", None),
    "version 6 in ipv4": (ip(6, "65") + TCP, "ip version", None),
    "ihl 4": (ip(6, "44") + TCP, "ip header length", None),
    "ihl 15 with 20 bytes": (ip(6, "4f"), "ip header beyond capture", None),
    "icmp ihl 15 with 20 bytes": (ip(1, "4f"), "ip header beyond capture", None),
    "gre": (ip(47) + "00" * 10, None, dict(protocol="UNKNOWN", ip_protocol=47, source_ip="10.20.30.41", payload_length=0,
                                          source_port=0, destination_port=0)),
    "tcp 19 bytes": (ip(6) + TCP[:38], "short tcp header", None),
    "tcp offset 4": (ip(6) + TCP.replace("5002", "4002"), "tcp data offset", None),
    "tcp offset 15": (ip(6) + TCP.replace("5002", "f002"), None, dict(protocol="TCP", payload_length=0)),
    "tcp flags": (ip(6) + TCP.replace("5002", "53ff"), None, dict(tcp_flags=0x3FF)),
    "tcp after options": (ip(6, "46") + "01010101" + TCP + "aabb", None,
                          dict(protocol="TCP", source_port=40005, payload_length=2, tcp_flags=2)),
    "udp 7 bytes": (ip(17) + "d431003500080", "short udp header", None),
    "udp": (ip(17) + "d431003500080000", None, dict(protocol="UDP", source_port=54321, destination_port=53,
                                                    payload_length=0, tcp_flags=None, tcp_window=None)),
    "icmp 0 bytes": (ip(1), None, dict(protocol="ICMP", payload_length=0, source_port=0)),
    "icmp 8 bytes": (ip(1) + "08" * 8, None, dict(protocol="ICMP", payload_length=8)),
    "padded": (SYN + "00" * 6, None, dict(protocol="TCP", payload_length=6, captured_length=60)),
}
NAMES = list(CASES)


@pytest.fixture(scope="module")
def frames(spark):
    rows = []
    for seq, (text, _, _) in enumerate(CASES.values()):
        raw = bytes.fromhex(text[: len(text) // 2 * 2])
        rows.append((seq, datetime.datetime(2024, 1, 1), len(raw), len(raw), 0, "eth0", raw))
    return spark.createDataFrame(rows, FRAMES).cache()


def test_rejects(frames):
    got = {NAMES[r.seq]: r.reject for r in decode.with_headers(frames).collect()}
    assert got == {name: reason for name, (_, reason, _) in CASES.items()}


def test_packets(frames):
    df = decode.decode_frames(frames)
    assert df.schema.names == PACKETS.names
    assert [f.dataType for f in df.schema] == [f.dataType for f in PACKETS]
    got = {NAMES[r.seq]: r.asDict() for r in df.collect()}
    want = {name: fields for name, (_, reason, fields) in CASES.items() if reason is None}
    assert set(got) == set(want)
    for name, fields in want.items():
        assert {k: got[name][k] for k in fields} == fields, name


def test_headers(frames):
    row = decode.with_headers(frames).where(f"seq = {NAMES.index('syn')}").first()
    assert row.ip.asDict() == dict(version=4, ihl=5, tos=0, total_length=40, identification=0x7A2C, flags=2,
                                   fragment_offset=0, ttl=64, protocol=6, checksum=0, source_ip="10.20.30.41",
                                   destination_ip="10.20.30.42")
    assert (row.tcp.sequence_number, row.tcp.data_offset, row.tcp.flags, row.tcp.urgent_pointer) == (42, 5, 2, 0)
    assert row.udp is None
    udp = decode.with_headers(frames).where(f"seq = {NAMES.index('udp')}").first()
    assert udp.udp.asDict() == dict(source_port=54321, destination_port=53, length=8, checksum=0) and udp.tcp is None


def test_short_mac_bytes_have_two_digits(frames):
    assert decode.decode_frames(frames).where(f"seq = {NAMES.index('syn')}").first().dst_mac.startswith("02:5a")


def test_summary(frames):
    lines = {NAMES[r.seq]: r.summary for r in decode.packet_summary(decode.decode_frames(frames)).collect()}
    assert lines["syn"] == (
        "Packet: 2024-01-01 00:00:00  Ethernet: 02:5a:10:7e:88:06 -> 02:5a:10:7e:c4:31"
        "  IP: 10.20.30.41 -> 10.20.30.42 (TTL: 64)  TCP: 40005 -> 443 [SYN] (Size: 54 bytes)"
    )
    assert lines["tcp flags"].count("[") == 5 and "[SYN] [ACK] [FIN] [RST] [PSH]" in lines["tcp flags"]
    assert "Protocol: 47" in lines["gre"]
    assert lines["arp"].endswith("02:5a:10:7e:c4:31")


def test_validation(spark, frames):
    row = frames.where(f"seq = {NAMES.index('syn')}")
    for length, valid in ((54, True), (53, False), (0, False), (1500, True)):
        checked = decode.checks(row.withColumn("length", row.caplen * 0 + length))
        assert checked.first().valid is valid


def _checksum(data: bytes) -> int:
    data += b"\0" * (len(data) % 2)
    total = sum(int.from_bytes(data[i : i + 2]) for i in range(0, len(data), 2))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def _datagram(payload: bytes, options: bytes) -> bytes:
    first = 0x40 + 5 + len(options) // 4
    total = 20 + len(options) + 20 + len(payload)
    header = bytes([first, 0]) + total.to_bytes(2) + bytes.fromhex("7a2c4000400600000a141e290a141e2a") + options
    header = header[:10] + _checksum(header).to_bytes(2) + header[12:]
    segment = bytes.fromhex(TCP) + payload
    pseudo = header[12:20] + b"\0\x06" + len(segment).to_bytes(2)
    segment = segment[:16] + _checksum(pseudo + segment).to_bytes(2) + segment[18:]
    return bytes.fromhex(MACS + "0800") + header + segment


def test_checksums(spark):
    """Right and wrong checksums over payloads and options of many lengths, padding left out."""
    rows, ips_ok, tcps_ok = [], {}, {}
    for payload in (b"", b"a", b"odd", b"\xff" * 300, bytes(range(256)) * 5 + b"x"):
        for options in (b"", b"\x01" * 8, b"\xff" * 40):
            raw = _datagram(payload, options)
            for frame, ip_ok, tcp_ok in (
                (raw, True, True),
                (raw[:-1] + bytes([raw[-1] ^ 4]), True, False),
                (raw + b"\0\0\0", True, True),
                (raw[:15] + b"\x08" + raw[16:], False, True),
            ):
                seq = len(rows)
                rows.append((seq, datetime.datetime(2024, 1, 1), len(frame), len(frame), 0, "eth0", frame))
                ips_ok[seq], tcps_ok[seq] = ip_ok, tcp_ok
    frames = spark.createDataFrame(rows, FRAMES)
    assert {r.seq: r.stored == r.computed for r in audit.ip_checksums(frames).collect()} == ips_ok
    assert {r.seq: r.stored == r.computed for r in audit.tcp_checksums(frames).collect()} == tcps_ok
