"""Feature vectors of packets and scores from a model over them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.config import DetectionConfig
from wirelark.operators.alerts import alert
from wirelark.schema import HIGH, ML_ANOMALY

# Fixed order of the features.
FEATURES = (
    "length", "payload_length", "ttl", "ip_protocol",
    "source_port", "destination_port", "tcp_flags", "tcp_window",
)
# Weights of the logistic example model, one per feature, and its bias.
EXAMPLE_WEIGHTS = (200.0, 150.0, -40.0, 300.0, -12.0, 8.0, 500.0, 2.0)
EXAMPLE_BIAS = -8.0

Model = Callable[[Column], Column]

log = logging.getLogger(__name__)


def features() -> Column:
    """The eight features as an array of floats between 0 and 1, null fields as 0."""
    scaled = [
        F.least(
            F.lit(1.0).cast("float"),
            F.greatest(F.lit(0.0).cast("float"), (F.coalesce(F.col(c), F.lit(0)).cast("float") / 65535).cast("float")),
        )
        for c in FEATURES
    ]
    return F.array(*scaled)


def feature_vector(packets: DataFrame) -> DataFrame:
    return packets.select("seq", "ts", features().alias("features"))


def logistic(weights: tuple[float, ...] = EXAMPLE_WEIGHTS, bias: float = EXAMPLE_BIAS) -> Model:
    """A logistic score as a column expression: no Python in the workers."""

    def score(vector: Column) -> Column:
        total = F.lit(bias)
        for i, weight in enumerate(weights):
            total = total + F.lit(weight) * vector[i].cast("double")
        return 1.0 / (1.0 + F.exp(-total))

    return score


def _open_session(model_path: str):
    import onnxruntime

    try:
        return onnxruntime.InferenceSession(model_path)
    except Exception:  # not a path here: a file sent with addFile
        return onnxruntime.InferenceSession(SparkFiles.get(model_path))


def onnx(model_path: str) -> Model:
    """The first output of an ONNX model, run on whole Arrow batches with one session per worker.

    ``model_path`` is a path that every executor can read, or the name of a file sent with
    ``SparkContext.addFile``.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        session = _open_session(model_path)
        name = session.get_inputs()[0].name
        for batch in batches:
            rows = np.stack(batch.to_numpy()).astype(np.float32) if len(batch) else np.zeros((0, 8), np.float32)
            output = np.asarray(session.run(None, {name: rows})[0], dtype=np.float64)
            yield pd.Series(output.reshape(len(batch), -1)[:, 0])

    # Called so, the optimizer will not run it once for a filter and again for a column.
    return run.asNondeterministic()


def load_model(model_path: str) -> Model | None:
    """The ONNX model at ``model_path``, or None, with a message in the log, if it cannot be loaded."""
    try:
        _open_session(model_path)
    except Exception as error:  # noqa: BLE001 - a missing model must not stop detection
        log.error("cannot load model %s: %s", model_path, error)
        return None
    return onnx(model_path)


class PipelineScore:
    """A fitted MLlib ``PipelineModel`` (or any transformer) as a model: it runs in the JVM. It should be one that was saved and loaded: a model
    just fitted may hold a summary of its training with the session in it, which cannot be sent to tasks once that session has observed metrics.

    It gets the features as columns of doubles named ``feature_<name>`` (see ``FEATURES``, ``feature_columns``), say for a ``VectorAssembler``,
    and leaves its score in the column ``output``; of a vector, such as a probability, the entry number ``entry`` counts (default: the last).
    """

    def __init__(self, model, output: str = "score", entry: int = -1) -> None:
        self._model, self._output, self._entry = model, output, entry

    def scored(self, packets: DataFrame) -> DataFrame:
        vector = features()
        named = {f"feature_{name}": vector[i].cast("double") for i, name in enumerate(FEATURES)}
        found = self._model.transform(packets.withColumns(named))
        score = F.col(self._output)
        if isinstance(found.schema[self._output].dataType, VectorUDT):
            score = F.element_at(vector_to_array(score), self._entry if self._entry < 0 else self._entry + 1)
        return found.select(*packets.columns, score.cast("double").alias("score"))


def feature_columns() -> list[str]:
    """The names of the feature columns that a pipeline model finds."""
    return [f"feature_{name}" for name in FEATURES]


def ml_score(packets: DataFrame, model: Model | PipelineScore) -> DataFrame:
    """``packets`` with ``score``, the model's output for the packet's features."""
    return model.scored(packets) if isinstance(model, PipelineScore) else packets.withColumn("score", model(features()))


def ml_anomaly_alerts(packets: DataFrame, model: Model, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    scored = ml_score(packets.where(F.col("source_ip").isNotNull()), model)
    unusual = scored.where(F.col("score") > config.limit("anomaly_confidence_threshold"))
    text = F.format_string("ML anomaly detected from %s (confidence: %.6f)", "source_ip", "score")
    return alert(unusual, ML_ANOMALY, HIGH, text, F.col("score"))
