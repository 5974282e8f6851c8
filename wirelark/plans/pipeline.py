"""User stages over packets, and the whole way from frames to alert documents."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wirelark.config import AlertConfig, CaptureConfig, DetectionConfig
from wirelark.operators.alerts import alert_json, process
from wirelark.operators.decode import decode_frames
from wirelark.operators.scoring import Model
from wirelark.plans.detect import detect_all
from wirelark.session import store
from wirelark.sources.frames import capture_filter, snap_truncate

Branch = Callable[[DataFrame], DataFrame]
PacketFunction = Callable[[tuple], None]
BatchFunction = Callable[..., pa.Array | None]


class Pipeline:
    """Named stages that all see every packet, in the order in which they were added.

    A stage is a DataFrame transformation (``add_stage``), or, for what expressions cannot say, a Python function of Arrow columns
    (``add_batch_function``), of one packet (``add_packet_function``), or a table function that emits rows (``add_emitter``).
    """

    def __init__(self) -> None:
        self._batched: dict[str, tuple[BatchFunction, tuple[str, ...]]] = {}
        self._emitters: dict[str, tuple[Callable, tuple[str, ...]]] = {}
        self._branches: dict[str, Branch] = {}
        self._functions: dict[str, PacketFunction] = {}

    def add_stage(self, name: str, branch: Branch) -> Pipeline:
        self._branches[name] = branch
        return self

    def add_packet_function(self, name: str, function: PacketFunction) -> Pipeline:
        """``function`` gets each packet as a named tuple. If it raises, the packet counts as an error of
        this stage and goes on to the next one."""
        self._functions[name] = function
        return self

    def add_batch_function(self, name: str, function: BatchFunction, columns: Sequence[str]) -> Pipeline:
        """``function`` gets the named ``columns`` of many packets as Arrow arrays and returns which packets are errors (a boolean
        array), or None if none is. If it raises, all packets of that batch are errors of this stage; the next stages go on."""
        self._batched[name] = (function, tuple(columns))
        return self

    def add_emitter(self, name: str, table_function: Callable, columns: Sequence[str]) -> Pipeline:
        """``table_function``, made with ``pyspark.sql.functions.udtf``, is called with the named ``columns`` of each packet and emits
        any number of rows."""
        self._emitters[name] = (table_function, tuple(columns))
        return self

    def emitted(self, packets: DataFrame, keep: Sequence[str] = ("seq",)) -> dict[str, DataFrame]:
        """The rows of each table function, beside the columns ``keep`` of the packet they come from."""
        found = {}
        for name, (function, columns) in self._emitters.items():
            narrow = packets.select(*dict.fromkeys([*keep, *columns]))
            rows = narrow.lateralJoin(function(*[F.col(c).outer() for c in columns]))
            found[name] = rows.drop(*[c for c in columns if c not in keep])
        return found

    def _marks(self) -> Column:
        """``errors``, bit i for batch function i, and the ``ms`` each took, in the first row of a batch of packets."""
        functions = list(self._batched.values())
        columns = list(dict.fromkeys(c for _, names in functions for c in names))
        result = pa.struct([("errors", pa.int64()), ("ms", pa.list_(pa.float64()))])

        def run(*arrays: pa.Array) -> pa.Array:
            by_name, n = dict(zip(columns, arrays, strict=True)), len(arrays[0])
            errors, spent = pa.array([0] * n, pa.int64()), []
            for bit, (function, names) in enumerate(functions):
                began = time.perf_counter()
                try:
                    bad = function(*[by_name[c] for c in names])
                except Exception:  # noqa: BLE001 - counted, whatever it is
                    bad = pa.array([True] * n, pa.bool_())
                if bad is not None:
                    errors = pc.bit_wise_or(errors, pc.multiply(pc.fill_null(bad, False).cast(pa.int64()), 1 << bit))
                spent.append((time.perf_counter() - began) * 1000)
            times = pa.array([spent, *[None] * (n - 1)] if n else [], pa.list_(pa.float64()))
            return pa.StructArray.from_arrays([errors, times], fields=list(result))

        # Arrow arrays in and out; not deterministic, so that the optimizer will not run it twice.
        marked = F.arrow_udf(run, "errors bigint, ms array<double>").asNondeterministic()
        return marked(*[F.col(c) for c in columns])

    def observed(self, packets: DataFrame, metrics: Observation) -> DataFrame:
        """``packets`` with ``errors`` (bit i: the i-th batch function called the packet an error), whatever is then done with them.

        The job that does it counts on its way: afterwards ``metrics`` (see ``live_statistics``) has the exact numbers of all batch
        functions, without another pass.
        """
        marked = packets.withColumn("_marks", self._marks())
        counts = [F.count("*").alias("packets")]
        for bit in range(len(self._batched)):
            counts.append(F.count_if(F.col("_marks.errors").bitwiseAND(1 << bit) != 0).alias(f"errors_{bit}"))
            counts.append(F.sum(F.get("_marks.ms", F.lit(bit))).alias(f"ms_{bit}"))
        return marked.observe(metrics, *counts).withColumn("errors", F.col("_marks.errors")).drop("_marks")

    def live_statistics(self, packets: DataFrame, metrics: Observation) -> DataFrame:
        """What ``metrics`` counted in the job over ``observed``: the columns of ``statistics``, one row per batch function."""
        seen, rows = metrics.get, []
        for bit, name in enumerate(self._batched):
            done = seen["packets"] - seen[f"errors_{bit}"]
            rows.append((bit + 1, name, done, seen[f"errors_{bit}"], (seen[f"ms_{bit}"] or 0.0) / max(1, done)))
        schema = "position int, stage string, packets_processed long, errors long, average_processing_time_ms double"
        return packets.sparkSession.createDataFrame(rows, schema)

    def outputs(self, packets: DataFrame) -> dict[str, DataFrame]:
        """What each DataFrame stage makes of the packets. Those of a batch are written once, to a table in the shared folder that
        every stage scans for its columns; nothing stays in the executors."""
        shared = packets if packets.isStreaming else store(packets, "stage-input")
        return {name: branch(shared) for name, branch in self._branches.items()}

    def statistics(self, packets: DataFrame) -> DataFrame:
        """Per packet function: packets processed, errors, mean milliseconds.

        All functions run in one pass; a worker sends one row per function and Arrow batch.
        """
        functions = dict(self._functions)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for position, (name, function) in enumerate(functions.items(), start=1):
                    errors, began = 0, time.perf_counter()
                    for packet in batch.itertuples(index=False, name="Packet"):
                        try:
                            function(packet)
                        except Exception:  # noqa: BLE001 - counted, whatever it is
                            errors += 1
                    spent = (time.perf_counter() - began) * 1000
                    rows.append((position, name, len(batch) - errors, errors, spent))
                yield pd.DataFrame(rows, columns=["position", "stage", "ok", "bad", "ms"])

        partial = packets.mapInPandas(run, "position int, stage string, ok long, bad long, ms double")
        done = F.sum("ok")
        return partial.groupBy("position", "stage").agg(
            done.alias("packets_processed"),
            F.sum("bad").alias("errors"),
            (F.sum("ms") / F.greatest(F.lit(1), done)).alias("average_processing_time_ms"),
        )


def packets_of(frames: DataFrame, capture: CaptureConfig = CaptureConfig()) -> DataFrame:
    """Frames to the packets that the capture filter lets through."""
    return capture_filter(decode_frames(snap_truncate(frames, capture)), capture)


def end_to_end(
    frames: DataFrame,
    detection: DetectionConfig = DetectionConfig(),
    alerting: AlertConfig = AlertConfig(),
    capture: CaptureConfig = CaptureConfig(),
    model: Model | None = None,
) -> DataFrame:
    """Frames to alert documents: decode, filter, detect, limit, deduplicate, rate, format.

    Decoding happens once; the packets are stored as a table that each detector scans for its columns.
    """
    packets = store(packets_of(frames, capture), "packets")
    return alert_json(process(detect_all(packets, detection, model), alerting))
