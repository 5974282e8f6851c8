"""Detectors whose window starts with a source's own traffic: SYN flood, connection flood, port scan.

A tracker of a source starts with its first packet, counts from there, and is dropped ``hop`` seconds after
its anchor; the next packet starts a new one. The connection tracker moves its anchor once, to the first
SYN it sees. Where the trackers of a source start is a chain, each start depending on the one before.

Following that chain packet by packet would put a flooding source, which may send a third of all
packets, into one task. Here the chain is contracted instead, as in parallel list ranking. Time is cut
into cells of one hop; a cell can hold at most one start. Pointers from each possible start to the next
are composed pairwise, which halves the table, until one cell is left; then the actual starts are read
off on the way back. All steps are joins on (source, time), whose keys are distinct, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelark.config import DetectionConfig
from wirelark.operators.alerts import alert
from wirelark.operators.ordered import running_totals
from wirelark.operators.traffic import is_port_carrier, is_syn, is_tcp
from wirelark.schema import (
    ALERT_SUBJECT,
    DETECTOR_ORDER,
    HIGH,
    MEDIUM,
    PORT_SCAN,
    RATE_LIMIT_EXCEEDED,
    SYN_FLOOD,
)
from wirelark.session import cut, store

SECOND = 1_000_000  # microseconds; times in this module are microseconds since 1970
# Sequence number of rows that stand for what came before the first packet.
BEFORE_ALL = -(2**63)
# More than there are ports.
MANY_PORTS = 1 << 17


def _slot(time: Column) -> Column:
    return F.floor(time / SECOND)


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join many ``rows`` with a smaller ``table``, which must be stored.

    The size of its files tells the planner whether it is small enough to be broadcast (``spark.sql.autoBroadcastJoinThreshold``). If it is
    not, both sides are shuffled, and adaptive execution splits the partition of a hot key (``spark.sql.adaptive.skewJoin``).
    """
    return rows.join(table, on, how)


def _busy_sources(packets: DataFrame, rules: list[tuple[Column, int, int]]) -> DataFrame:
    """Sources that can raise an alert; the rest need no chain.

    A rule ``(counted, threshold, span)`` can fire only where a source has ``threshold`` counted packets in
    some stretch of ``span`` whole seconds. One row per source and second is sorted, so the work per source
    is bounded by the time covered, not by its packets.
    """
    counts = [F.count_if(counted).alias(f"c{i}") for i, (counted, _, _) in enumerate(rules)]
    per_second = packets.groupBy("source_ip", _slot(F.col("t")).alias("slot")).agg(*counts)
    by_time = Window.partitionBy("source_ip").orderBy("slot")
    reached = F.lit(False)
    for i, (_, threshold, span) in enumerate(rules):
        in_stretch = F.sum(f"c{i}").over(by_time.rangeBetween(-(span - 1), 0))
        per_second = per_second.withColumn(f"s{i}", in_stretch)
        reached = reached | (F.col(f"s{i}") >= threshold)
    return store(per_second.where(reached).select("source_ip").distinct(), "busy-sources")


def _next_point(rows: DataFrame, at: str, point: Column, points: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``_next``: the first time ``point`` of the same source not before ``at``.

    The points are those of ``points``, or else those that ``rows`` themselves have where ``point`` is not
    null. Rows meet in one-second slots. Times are distinct microseconds, so a slot holds a bounded number
    of them whatever the traffic; if the slot holds none after ``at``, the next non-empty slot's first one is
    taken from a table with one row per source and slot.
    """
    names = rows.columns
    if points is None:
        both = rows.withColumns({"_at": F.col(at), "_point": point, "_asked": F.lit(True)})
    else:
        offered = points.select("source_ip", point.alias("_at"), point.alias("_point"), F.lit(False).alias("_asked"))
        both = rows.withColumns(
            {"_at": F.col(at), "_point": F.lit(None).cast("long"), "_asked": F.lit(True)}
        ).unionByName(offered, allowMissingColumns=True)
    both = both.withColumn("_slot", _slot(F.col("_at")))
    in_slot = Window.partitionBy("source_ip", "_slot").orderBy(F.col("_at").desc())
    later = Window.partitionBy("source_ip").orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        both.groupBy("source_ip", "_slot")
        .agg(F.min("_point").alias("_first"))
        .select("source_ip", "_slot", F.min("_first").over(later).alias("_later"))
    )
    here = both.withColumn("_here", F.min("_point").over(in_slot.rangeBetween(Window.unboundedPreceding, 0)))
    return (
        here.where("_asked")
        .join(slots, ["source_ip", "_slot"])
        .select(*names, F.coalesce("_here", "_later").alias("_next"))
    )


def _chain(starts: DataFrame, hop: int, stretch: int) -> DataFrame:
    """The rows of ``starts(source_ip, t, nxt, ...)`` that are reached from the first ``t`` of each source.

    ``nxt`` is where the chain goes on if it comes to ``t``: the first time of the source that is not before
    some instant ``hop`` to ``stretch * hop`` microseconds after ``t`` (``stretch`` is 1 or 2).
    """
    starts = cut(starts.withColumn("cell", F.floor(F.col("t") / hop)))
    first = starts.groupBy("source_ip").agg(F.min("t").alias("t"))
    cells = starts.agg(F.min("cell"), F.max("cell")).first()
    if cells[0] is None:
        return starts.drop("cell")
    origin, levels = cells[0], (cells[1] - cells[0]).bit_length()

    table = starts.select(
        "source_ip", "t", "nxt", (F.col("cell") - origin).alias("cell"), (F.floor(F.col("nxt") / hop) - origin).alias("to")
    )
    if levels > 1:
        # The chain enters a block of cells in one of the block's first ``stretch`` cells, or, after a gap, at
        # some cell's first time (its head). The other times of a block's second half can be left out, once
        # the first half is at least ``stretch`` cells long.
        heads = starts.groupBy("source_ip", "cell").agg(F.min("t").alias("t")).select("source_ip", "t", F.lit(True).alias("head"))
        table = table.join(heads, ["source_ip", "t"], "left").withColumn("head", F.col("head").isNotNull())

    composed = [table]
    for level in range(levels - 1):
        table = composed[-1] = cut(table)
        odd = F.shiftright("cell", level) % 2 == 1
        sibling = F.shiftright("cell", level + 1) == F.shiftright("to", level + 1)
        onward = table.where(odd).select(
            "source_ip", F.col("t").alias("nxt"), F.col("nxt").alias("_nxt"), F.col("to").alias("_to")
        )
        kept = table.where(~odd | F.col("head")) if 1 << level >= stretch else table
        within = kept.where(sibling).join(onward, ["source_ip", "nxt"])
        within = within.select("source_ip", "t", F.col("_nxt").alias("nxt"), "cell", F.col("_to").alias("to"), "head")
        table = within.unionByName(kept.where(sibling.isNull() | ~sibling))
        composed.append(table)

    reached = first
    for level in reversed(range(levels)):
        sibling = F.shiftright("cell", level + 1) == F.shiftright("to", level + 1)
        steps = composed[level].where(sibling).select("source_ip", "t", "nxt")
        reached = reached.join(steps, ["source_ip", "t"], "left").select(
            "source_ip", F.explode(F.array_compact(F.array("t", "nxt"))).alias("t")
        )
    return starts.drop("cell").join(reached, ["source_ip", "t"], "left_semi")


def _timed(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("source_ip").isNotNull()).withColumn("t", F.unix_micros("ts"))


def connection_trackers(
    packets: DataFrame, config: DetectionConfig, sources: DataFrame | None = None, carried: DataFrame | None = None
) -> DataFrame:
    """Connection trackers as ``(source_ip, t, anchor)``: start, and first SYN or else the start.

    ``packets`` are TCP packets with ``t`` in microseconds, ``sources`` those to look at (default all),
    ``carried`` the trackers that were active when the packets began (see ``carry_connections``).
    """
    hop = (config.statistics_window + 1) * SECOND
    times = packets.select("source_ip", "t", is_syn().alias("syn"))
    if carried is not None:
        first_syn = carried.where("syn_count > 0").select("source_ip", F.col("anchor").alias("t"), F.lit(True).alias("syn"))
        times = times.unionByName(carried.select("source_ip", "t", F.lit(False).alias("syn"))).unionByName(first_syn)
    times = times.groupBy("source_ip", "t").agg(F.max("syn").alias("syn"))
    if sources is not None:
        times = lookup_join(times, sources, ["source_ip"], "left_semi")
    times = cut(times)
    near = F.col("_next") < F.col("t") + hop
    anchor = F.when(near, F.col("_next")).otherwise(F.col("t"))
    asked = cut(
        _next_point(times, "t", F.when(F.col("syn"), F.col("t"))).select(
            "source_ip", "t", anchor.alias("anchor"), (anchor + hop).alias("_expiry")
        )
    )
    pointed = _next_point(asked, "_expiry", F.col("t"), times)
    return _chain(pointed.withColumnRenamed("_next", "nxt"), hop, 2).select("source_ip", "t", "anchor")


def port_trackers(
    packets: DataFrame, config: DetectionConfig, sources: DataFrame | None = None, carried: DataFrame | None = None
) -> DataFrame:
    """Port trackers as ``(source_ip, t, anchor)``; the start is the anchor."""
    hop = (config.port_scan_window + 1) * SECOND
    times = packets.select("source_ip", "t")
    if carried is not None:
        times = times.unionByName(carried.select("source_ip", "t"))
    times = times.distinct()
    if sources is not None:
        times = lookup_join(times, sources, ["source_ip"], "left_semi")
    times = cut(times)
    asked = times.withColumn("_expiry", F.col("t") + hop)
    pointed = _next_point(asked, "_expiry", F.col("t"), times)
    starts = _chain(pointed.withColumnRenamed("_next", "nxt"), hop, 1)
    return starts.select("source_ip", "t", F.col("t").alias("anchor"))


def _in_trackers(packets: DataFrame, trackers: DataFrame, until: Column, width: int) -> DataFrame:
    """``packets`` with the columns of the tracker they fall into; ``until`` is the tracker's (open) end.

    Trackers are laid out over cells of ``width`` microseconds, of which each covers at most a few, and
    joined on source and cell.
    """
    spans = trackers.withColumn("_until", until).withColumnRenamed("t", "start")
    covered = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("_until") - 1) / width)))
    spread = store(spans.withColumn("_cell", covered), "tracker-cells")
    cells = packets.withColumn("_cell", F.floor(F.col("t") / width))
    met = lookup_join(cells, spread, ["source_ip", "_cell"])
    return met.where("t >= start and t < _until").drop("_cell", "_until")


def _before_stop(trackers: DataFrame, until: Column) -> Column:
    """``until``, or the tracker's ``stop`` if it is known and earlier."""
    return F.least(until, F.col("stop")) if "stop" in trackers.columns else until


def _elapsed_within(since: Column, seconds: int) -> Column:
    """Whole seconds elapsed are at most ``seconds``: less than ``seconds + 1`` in exact time."""
    return F.col("t") - since < (seconds + 1) * SECOND


def tcp_times(packets: DataFrame) -> DataFrame:
    return _timed(packets.select(*ALERT_SUBJECT, "protocol", "tcp_flags")).where(is_tcp())


def port_times(packets: DataFrame) -> DataFrame:
    return _timed(packets.where(is_port_carrier()).select(*ALERT_SUBJECT))


def flood_alerts(packets: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """SYN flood and connection flood alerts, which share one tracker per source."""
    tcp = tcp_times(packets)
    reach = config.statistics_window + max(config.syn_flood_window, config.connection_window) + 3
    flooding = (is_syn(), config.syn_flood_threshold, config.syn_flood_window + 2)
    connecting = (is_tcp(), config.connection_rate_threshold, reach)
    sources = _busy_sources(tcp, [flooding, connecting])
    return flood_alerts_in(tcp, connection_trackers(tcp, config, sources), config)


def flood_alerts_in(
    tcp: DataFrame, trackers: DataFrame, config: DetectionConfig, carried: DataFrame | None = None
) -> DataFrame:
    """Flood alerts of TCP packets whose trackers are known.

    From the threshold-th SYN (TCP packet) of a tracker on, every one within the window of the anchor
    raises an alert. Packets later than the window after the anchor cannot, and are left out before the
    rows are sorted and counted. A carried tracker brings its counts as one row ahead of the packets.
    """
    keep = (config.statistics_window + 1) * SECOND
    widest = (max(config.syn_flood_window, config.connection_window) + 1) * SECOND
    rows = tcp.select(
        *ALERT_SUBJECT, "t", is_syn().alias("is_syn"), is_syn().cast("long").alias("syns"),
        F.lit(1).cast("long").alias("packets"), F.lit(True).alias("is_packet"),
    )
    if carried is not None:
        ahead = carried.select(
            "source_ip", "t", F.timestamp_micros("t").alias("ts"), F.lit(BEFORE_ALL).alias("seq"),
            F.lit(False).alias("is_syn"), F.col("syn_count").alias("syns"), F.col("connection_count").alias("packets"),
            F.lit(False).alias("is_packet"),
        )
        rows = rows.unionByName(ahead, allowMissingColumns=True)
    rows = _in_trackers(rows, trackers, _before_stop(trackers, F.col("anchor") + min(widest, keep)), keep)
    counted = running_totals(rows, ["source_ip", "start"], ["ts", "seq"], ["syns", "packets"])
    # The anchor moves to the first SYN when that SYN is counted.
    since = F.when(F.col("syns") > 0, F.col("anchor")).otherwise(F.col("start"))
    syn_hit = (
        F.col("is_syn")
        & (F.col("syns") >= config.limit("syn_flood_threshold"))
        & _elapsed_within(since, config.syn_flood_window)
    )
    connection_hit = (F.col("packets") >= config.limit("connection_rate_threshold")) & _elapsed_within(
        since, config.connection_window
    )
    kinds = F.array_compact(F.array(F.when(syn_hit, SYN_FLOOD), F.when(connection_hit, RATE_LIMIT_EXCEEDED)))
    hits = counted.where("is_packet").select("*", F.explode(kinds).alias("hit"))
    is_flood = F.col("hit") == SYN_FLOOD
    text = F.format_string(
        "%s flood detected from %s", F.when(is_flood, "SYN").otherwise("Connection"), F.col("source_ip")
    )
    alerts = alert(hits.withColumn("_text", text), SYN_FLOOD, HIGH, F.col("_text"), extra=["hit"])
    order = F.when(is_flood, DETECTOR_ORDER[SYN_FLOOD]).otherwise(DETECTOR_ORDER[RATE_LIMIT_EXCEEDED])
    return alerts.withColumns({"type": F.col("hit"), "detector_ord": order}).drop("hit")


def detect_syn_flood(packets: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    return flood_alerts(packets, config).where(F.col("type") == SYN_FLOOD)


def detect_connection_flood(packets: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    return flood_alerts(packets, config).where(F.col("type") == RATE_LIMIT_EXCEEDED)


def detect_port_scan(packets: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Port scan alerts: every packet of a tracker that has seen the threshold of destination ports."""
    carrying = port_times(packets)
    sources = _busy_sources(carrying, [(F.lit(True), config.port_scan_threshold, config.port_scan_window + 2)])
    return scan_alerts_in(carrying, port_trackers(carrying, config, sources), config)


def scan_alerts_in(
    carrying: DataFrame, trackers: DataFrame, config: DetectionConfig, carried: DataFrame | None = None
) -> DataFrame:
    """Port scan alerts of packets whose trackers are known.

    Each port's first packet is found by a grouping that combines on the map side; a tracker has at most
    65,536 of them. Only trackers that reach the threshold have their later packets sorted and counted.
    """
    threshold, hop = config.port_scan_threshold, (config.port_scan_window + 1) * SECOND
    seen = carrying.select("source_ip", "t", "seq", "destination_port")
    if carried is not None:
        seen = seen.unionByName(carried.withColumn("seq", F.lit(BEFORE_ALL)))
    rows = _in_trackers(seen, trackers, _before_stop(trackers, F.col("t") + hop), hop)
    stop = ["stop"] if "stop" in trackers.columns else []
    firsts = rows.groupBy("source_ip", "start", *stop, "destination_port").agg(F.min(F.struct("t", "seq")).alias("first"))
    in_tracker = Window.partitionBy("source_ip", "start").orderBy("first", "destination_port")
    steps = cut(firsts.withColumn("k", F.row_number().over(in_tracker)).where(F.col("k") >= threshold))
    reached = steps.where(F.col("k") == threshold).select("source_ip", F.col("start").alias("t"), "first", *stop)
    reaching = _in_trackers(carrying, reached, _before_stop(reached, F.col("t") + hop), hop)
    scanning = reaching.where(F.struct("t", "seq") >= F.col("first")).drop("stop")
    # New ports add to the count just before the packet that brought them.
    events = scanning.drop("first").withColumns({"ports": F.lit(0).cast("long"), "position": F.lit(threshold + MANY_PORTS)})
    news = steps.select(
        "source_ip", "start", F.col("first.t").alias("t"), F.col("first.seq").alias("seq"),
        F.when(F.col("k") == threshold, threshold).otherwise(1).cast("long").alias("ports"),
        F.col("k").alias("position"),
    )
    counted = running_totals(
        events.unionByName(news, allowMissingColumns=True),
        ["source_ip", "start"], ["t", "seq", "position"], ["ports"],
    )
    text = F.format_string("Port scan detected from %s (%d ports)", "source_ip", "ports")
    scans = counted.where((F.col("position") == threshold + MANY_PORTS) & (F.col("ports") >= config.limit("port_scan_threshold")))
    return alert(scans, PORT_SCAN, MEDIUM, text)


def _last(trackers: DataFrame, now: DataFrame, keep: int) -> DataFrame:
    """The last tracker of each source, if not expired at ``now`` (one row, null if there were no packets): one
    row per source at most."""
    newest = trackers.groupBy("source_ip").agg(F.max(F.struct("t", "anchor")).alias("m"))
    alive = newest.select("source_ip", F.col("m.t").alias("start"), F.col("m.anchor").alias("anchor"))
    return store(alive.where(F.coalesce(now.scalar() - F.col("anchor") < (keep + 1) * SECOND, F.lit(True))), "last-trackers")


def carry_connections(
    tcp: DataFrame, trackers: DataFrame, now: DataFrame, config: DetectionConfig, carried: DataFrame | None = None
) -> DataFrame:
    """Active connection trackers as ``(source_ip, t, anchor, syn_count, connection_count)``."""
    last = _last(trackers, now, config.statistics_window)
    rows = tcp.select("source_ip", "t", is_syn().cast("long").alias("syns"), F.lit(1).cast("long").alias("packets"))
    if carried is not None:
        rows = rows.unionByName(
            carried.select("source_ip", "t", F.col("syn_count").alias("syns"), F.col("connection_count").alias("packets"))
        )
    return (
        lookup_join(rows, last, ["source_ip"])
        .where("t >= start")
        .groupBy("source_ip", F.col("start").alias("t"), "anchor")
        .agg(F.sum("syns").alias("syn_count"), F.sum("packets").alias("connection_count"))
    )


def carry_ports(
    carrying: DataFrame, trackers: DataFrame, now: DataFrame, config: DetectionConfig, carried: DataFrame | None = None
) -> DataFrame:
    """The ports of active port trackers as ``(source_ip, t, destination_port)``."""
    last = _last(trackers, now, config.port_scan_window)
    rows = carrying.select("source_ip", "t", "destination_port")
    if carried is not None:
        rows = rows.unionByName(carried)
    return (
        lookup_join(rows, last, ["source_ip"])
        .where("t >= start")
        .select("source_ip", F.col("start").alias("t"), "destination_port")
        .distinct()
    )


def active_trackers(
    packets: DataFrame, config: DetectionConfig = DetectionConfig(), as_of: Column | None = None
) -> DataFrame:
    """Trackers not yet expired at ``as_of`` (default: the last packet), with their counts.

    The last tracker of each source is the only one that can be active, so one row per source is joined
    back to the packets, and those are counted with map-side combining.
    """
    tcp, carrying = tcp_times(packets), port_times(packets)
    newest = F.max("ts") if as_of is None else F.any_value(as_of)
    now = packets.agg(F.unix_micros(newest).alias("now"))
    connections = carry_connections(tcp, connection_trackers(tcp, config), now, config)
    ports = carry_ports(carrying, port_trackers(carrying, config), now, config)
    nothing = F.lit(None).cast("long")
    return connections.select(
        F.lit("connection").alias("tracker"), "source_ip", F.timestamp_micros("anchor").alias("first_seen"),
        "syn_count", "connection_count", nothing.alias("ports"),
    ).unionByName(
        ports.groupBy("source_ip", "t").agg(F.count("*").alias("ports")).select(
            F.lit("port scan").alias("tracker"), "source_ip", F.timestamp_micros("t").alias("first_seen"),
            nothing.alias("syn_count"), nothing.alias("connection_count"), "ports",
        )
    )
