"""The tracker rules in plain Python, packet by packet: a second witness for small inputs."""

from __future__ import annotations

from wirelark.config import DetectionConfig

SECOND = 1_000_000


def tracker_alerts(packets: list[dict], config: DetectionConfig) -> list[tuple]:
    """``(seq, type, ports or None)`` of every SYN flood, port scan and connection flood alert."""
    connections: dict[str, list] = {}
    scans: dict[str, list] = {}
    found = []
    for p in sorted(packets, key=lambda p: (p["t"], p["seq"])):
        source, t = p["source_ip"], p["t"]
        if source in connections and (t - connections[source][0]) // SECOND > config.statistics_window:
            del connections[source]
        if source in scans and (t - scans[source][0]) // SECOND > config.port_scan_window:
            del scans[source]
        tcp = p["protocol"] == "TCP"
        if tcp and p["tcp_flags"] & 2:
            state = connections.setdefault(source, [t, 0, 0])
            if state[1] == 0:
                state[0] = t
            state[1] += 1
            if (t - state[0]) // SECOND <= config.syn_flood_window and state[1] >= config.syn_flood_threshold:
                found.append((p["seq"], "SYN_FLOOD", None))
        if p["protocol"] in ("TCP", "UDP"):
            state = scans.setdefault(source, [t, set()])
            state[1].add(p["destination_port"])
            if (t - state[0]) // SECOND <= config.port_scan_window and len(state[1]) >= config.port_scan_threshold:
                found.append((p["seq"], "PORT_SCAN", len(state[1])))
        if tcp:
            state = connections.setdefault(source, [t, 0, 0])
            if state[2] == 0:
                state[0] = t
            state[2] += 1
            if (t - state[0]) // SECOND <= config.connection_window and state[2] >= config.connection_rate_threshold:
                found.append((p["seq"], "RATE_LIMIT_EXCEEDED", None))
    return sorted(found)


def rolling(values: list[int], rows: int) -> list[tuple]:
    """``(count, sum, sum of squares)`` over the last ``rows`` values up to each one."""
    out = []
    for i in range(len(values)):
        part = values[max(0, i + 1 - rows) : i + 1]
        out.append((len(part), sum(part), sum(v * v for v in part)))
    return out
