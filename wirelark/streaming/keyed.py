"""What a stream remembers of each source, in Spark's keyed state.

The packets of a micro-batch are summed up on the map side first: per source, task and stretch of packets one row with the distinct
times (and how many packets and SYNs each has), the last time of each destination port, and the last packet lengths. Times
are whole microseconds and there are 65,536 ports, so however many packets a source sends, a row stands for at most ``FLUSH_ROWS``
of them and what its task holds is bounded by the time that the micro-batch covers.

``SourceTrackers`` (``transformWithState``) walks a source's times from the state it finds, replies with the trackers that the
micro-batch needs, and leaves the new state: start, first SYN and counts of the connection tracker, start and ports of the port
tracker, and a ring of the last lengths. Only sources in the micro-batch are read or written. The state of a source ends by its
own packets (a tracker found expired is replaced) or when nothing has come from it for the time to live, in processing time; no
clock of one source is applied to another, so there is no watermark to run ahead.

Late packets, from before the source's tracker, form trackers of their own up to that one's start and leave it as it is; their
lengths come after those that arrived before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wirelark.config import DetectionConfig
from wirelark.operators.anchored import SECOND

FLUSH_ROWS = 1 << 18
#: Name of the local property that tells the tasks of a micro-batch its settings.
SETTINGS = "wirelark.streaming.settings"
#: Later than any packet.
NEVER = (1 << 63) - 1

SUMMARY = "source_ip string, tcp binary, carrying binary, ports binary, lengths binary"
REPLY = (
    "source_ip string, connections array<struct<t: bigint, anchor: bigint, stop: bigint>>, "
    "connection_before struct<t: bigint, anchor: bigint, syn_count: bigint, connection_count: bigint>, "
    "scans array<struct<t: bigint, stop: bigint>>, scan_before bigint, ports_before array<int>, lengths_before array<bigint>"
)
STATE = "connection binary, scan bigint, ports binary, lengths binary"


def announce(spark, config: DetectionConfig) -> None:
    """Tell the tasks of the jobs started from here on which settings hold."""
    settings = {
        "no_trackers": config.pauses("rule_based_enabled"), "no_lengths": config.pauses("statistical_enabled"),
        "connection_hop": (config.statistics_window + 1) * SECOND, "scan_hop": (config.port_scan_window + 1) * SECOND,
        "ring": config.moving_average_window - 1,
    }
    spark.sparkContext.setLocalProperty(SETTINGS, json.dumps(settings))


def _settings() -> dict:
    return json.loads(TaskContext.get().getLocalProperty(SETTINGS))


def _blob(*columns: np.ndarray) -> bytes:
    return np.stack(columns, axis=1).astype(np.int64).tobytes()


def _table(blobs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(b) for b in blobs if b), np.int64).reshape(-1, width)


def _at_any(t: np.ndarray, stretches: list[list[int]]) -> np.ndarray:
    found = np.zeros(len(t), bool)
    for start, stop in stretches:
        found |= (t >= start) & (t < stop)
    return found


def summary_of(packets: pa.Table, settings: dict) -> pa.RecordBatch:
    """One row per source of ``packets`` (``source_ip``, ``t``, ``seq``, ``kind``: 0 other, 1 UDP, 2 TCP, 3 SYN, ``port``, ``length``).
    Packets of times in which a family is off are not there for it."""
    codes = packets["source_ip"].combine_chunks().dictionary_encode()
    number = codes.indices.to_numpy()
    t, seq, kind, port, length = (packets[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("t", "seq", "kind", "port", "length"))
    kind = np.where(_at_any(t, settings["no_trackers"]), 0, kind)
    measured, ring = ~_at_any(t, settings["no_lengths"]), settings["ring"]
    order = np.lexsort((seq, t, number))
    bounds = np.r_[np.flatnonzero(np.diff(number[order], prepend=-1)), len(order)]
    rows = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        mine = order[a:b]
        tcp, carrying = mine[kind[mine] >= 2], mine[kind[mine] >= 1]
        times, first, counts = np.unique(t[tcp], return_index=True, return_counts=True)
        syns = np.add.reduceat((kind[tcp] == 3).astype(np.int64), first) if len(first) else counts
        ports, last = np.unique(port[carrying][::-1], return_index=True)
        newest = mine[measured[mine]]
        newest = newest[len(newest) - min(ring, len(newest)) :]
        rows.append(
            (
                codes.dictionary[int(number[mine[0]])].as_py(), _blob(times, counts, syns), _blob(np.unique(t[carrying])),
                _blob(ports, t[carrying][::-1][last]), _blob(t[newest], seq[newest], length[newest]),
            )
        )
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    types = [pa.string()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=names)


def summaries(packets: DataFrame) -> DataFrame:
    """The packets of each micro-batch in few rows per source."""
    tcp, syn = F.col("protocol") == "TCP", F.col("tcp_flags").bitwiseAND(2) != 0
    kind = F.when(tcp & syn, 3).when(tcp, 2).when(F.col("protocol") == "UDP", 1).otherwise(0)
    narrow = packets.where(F.col("source_ip").isNotNull()).select(
        "source_ip", F.unix_micros("ts").alias("t"), "seq", kind.alias("kind"), F.coalesce("destination_port", F.lit(0)).alias("port"),
        F.coalesce("length", F.lit(0).cast("long")).alias("length"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settings, held, rows = _settings(), [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= FLUSH_ROWS:
                yield summary_of(pa.Table.from_batches(held), settings)
                held, rows = [], 0
        if rows:
            yield summary_of(pa.Table.from_batches(held), settings)

    return narrow.mapInArrow(run, SUMMARY)


Connection = tuple[int, int, int, int]


def connection_chain(events: np.ndarray, state: Connection | None, hop: int) -> tuple[list[list[int]], Connection | None]:
    """Trackers ``[start, anchor, stop]`` of one source's TCP times (rows of time, packets, SYNs; sorted), and the last one's
    ``(start, anchor, SYNs, packets)``. A tracker's anchor is its start or, from then on, its first SYN."""
    times, counts, syns = events.T if len(events) else (np.zeros(0, np.int64),) * 3
    at, trackers = 0, []
    if state and len(times) and times[0] < state[0]:
        at = int(np.searchsorted(times, state[0]))
        late, _ = connection_chain(events[:at], None, hop)
        trackers = late[:-1] + [[*late[-1][:2], state[0]]]
    first_syns = np.flatnonzero(syns)
    while at < len(times):
        if state is None or times[at] >= state[1] + hop:
            if state:
                trackers.append([state[0], state[1], int(times[at])])
            state = (int(times[at]), int(times[at]), 0, 0)
        start, anchor, n_syn, n = state
        if n_syn == 0:
            following = first_syns[np.searchsorted(first_syns, at) :][:1]
            if len(following) and times[following[0]] < anchor + hop:
                anchor = int(times[following[0]])
        end = int(np.searchsorted(times, anchor + hop))
        state = (start, anchor, n_syn + int(syns[at:end].sum()), n + int(counts[at:end].sum()))
        at = end
    return trackers + ([[state[0], state[1], NEVER]] if state else []), state


def scan_chain(times: np.ndarray, start: int | None, hop: int) -> tuple[list[list[int]], int | None]:
    """Port trackers ``[start, stop]`` of one source's distinct times, and the start of the last one."""
    at, trackers = 0, []
    if start is not None and len(times) and times[0] < start:
        at = int(np.searchsorted(times, start))
        late, _ = scan_chain(times[:at], None, hop)
        trackers = late[:-1] + [[late[-1][0], start]]
    while at < len(times):
        if start is None or times[at] >= start + hop:
            if start is not None:
                trackers.append([start, int(times[at])])
            start = int(times[at])
        at = int(np.searchsorted(times, start + hop))
    return trackers + ([[start, NEVER]] if start is not None else []), start


class SourceTrackers(StatefulProcessor):
    """Keeps the state of each source; replies with one row per source and micro-batch."""

    def __init__(self, time_to_live: int) -> None:
        self._time_to_live = time_to_live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("source", STATE, ttlDurationMs=self._time_to_live * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        settings, parts = _settings(), list(rows)
        kept = self._state.get() if self._state.exists() else (None, None, None, None)
        before = tuple(int(x) for x in np.frombuffer(kept[0], np.int64)) if kept[0] else None
        scan, ports, lengths = kept[1], *(np.frombuffer(b, np.int64) if b else np.zeros(0, np.int64) for b in kept[2:])
        events = _table([p["tcp"] for p in parts], 3)
        times, place = np.unique(events[:, 0], return_inverse=True)
        merged = np.zeros((len(times), 3), np.int64)
        np.add.at(merged, place, events)
        merged[:, 0] = times
        connections, connection = connection_chain(merged, before, settings["connection_hop"])
        scans, new_scan = scan_chain(np.unique(_table([p["carrying"] for p in parts], 1)), scan, settings["scan_hop"])
        seen = _table([p["ports"] for p in parts], 2)
        here = seen[seen[:, 1] >= new_scan, 0] if new_scan is not None else seen[:0, 0]
        new_ports = np.union1d(ports, here) if new_scan == scan else np.unique(here)
        newest = _table([p["lengths"] for p in parts], 3)
        both = np.concatenate([lengths, newest[np.lexsort((newest[:, 1], newest[:, 0])), 2]])
        new_lengths = both[len(both) - min(len(both), settings["ring"]) :]
        blob = np.array(connection, np.int64).tobytes() if connection else None
        self._state.update((blob, new_scan, new_ports.tobytes(), new_lengths.tobytes()))
        yield Row(
            source_ip=key[0], connections=[tuple(t) for t in connections], connection_before=before, scans=[tuple(t) for t in scans],
            scan_before=scan, ports_before=ports.tolist(), lengths_before=lengths.tolist(),
        )

    def close(self) -> None:
        pass


def source_states(packets: DataFrame, time_to_live: int) -> DataFrame:
    """One row per source and micro-batch of the stream ``packets``: its trackers, and its state before."""
    return summaries(packets).groupBy("source_ip").transformWithState(SourceTrackers(time_to_live), REPLY, "append", "processingTime")
