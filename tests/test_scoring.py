"""Features and scores, also from an ONNX model."""

import struct

import pytest

from wirelark.config import DetectionConfig
from wirelark.operators import scoring
from wirelark.plans.detect import detect_all
from wirelark.sources import derived


def _field(number: int, value) -> bytes:
    """One protocol buffer field: a whole number, or bytes."""
    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _port(name: str, width: int) -> bytes:
    shape = _field(1, _field(2, "n")) + _field(1, _field(1, width))
    return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))


def write_logistic_onnx(path, weights, bias) -> str:
    """A model file: sigmoid(x @ w + b)."""
    def node(op, inputs, output):
        return _field(1, b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, op))

    def tensor(name, dims, values):
        return _field(5, b"".join(_field(1, d) for d in dims) + _field(2, 1) + _field(8, name)
                      + _field(9, struct.pack(f"<{len(values)}f", *values)))

    graph = (
        node("MatMul", ["x", "w"], "m") + node("Add", ["m", "b"], "a") + node("Sigmoid", ["a"], "y") + _field(2, "g")
        + tensor("w", [len(weights), 1], weights) + tensor("b", [1], [bias])
        + _field(11, _port("x", len(weights))) + _field(12, _port("y", 1))
    )
    path.write_bytes(_field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13)))
    return str(path)


@pytest.fixture(scope="module")
def packets(spark, sf_dir):
    return derived.packets(spark, sf_dir).cache()


def test_features(spark, packets):
    row = scoring.feature_vector(packets.where("protocol = 'ICMP'")).first()
    assert len(row.features) == 8 and row.features[4:] == [0.0] * 4
    assert all(0 <= f <= 1 for f in row.features)
    huge = packets.limit(1).selectExpr("*", "9999999L as big").drop("length").withColumnRenamed("big", "length")
    assert scoring.feature_vector(huge).first().features[0] == 1.0


def test_onnx_agrees_with_the_expression(spark, packets, tmp_path):
    path = write_logistic_onnx(tmp_path / "m.onnx", scoring.EXAMPLE_WEIGHTS, scoring.EXAMPLE_BIAS)
    model = scoring.load_model(path)
    by_file = {r.seq: r.score for r in scoring.ml_score(packets, model).select("seq", "score").collect()}
    by_column = {r.seq: r.score for r in scoring.ml_score(packets, scoring.logistic()).select("seq", "score").collect()}
    assert by_file == pytest.approx(by_column, abs=1e-4) and len(by_file) == 1000


def test_missing_model_gives_no_alerts(spark, packets):
    config = DetectionConfig(rule_based_enabled=False, statistical_enabled=False, enable_ml_inference=True)
    assert scoring.load_model("/no/such/model.onnx") is None
    assert detect_all(packets, config, scoring.load_model("/no/such/model.onnx")).count() == 0
    assert detect_all(packets, config, scoring.logistic()).count() > 0


def test_families_can_be_switched_off(spark, packets):
    off = DetectionConfig(rule_based_enabled=False, statistical_enabled=False)
    assert detect_all(packets, off).count() == 0
    kinds = {r.type for r in detect_all(packets, off.updated(statistical_enabled=True)).collect()}
    assert kinds == {"ANOMALOUS_TRAFFIC"}
