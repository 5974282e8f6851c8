"""User stages: functions of Arrow columns, table functions, metrics of the running job; MLlib pipelines as models."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.ml import Pipeline as MlPipeline
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wirelark.config import DetectionConfig
from wirelark.operators import scoring
from wirelark.plans.detect import detect_all
from wirelark.plans.pipeline import Pipeline


@pytest.fixture(scope="module")
def ports(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ports") / "t")
    rows = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).cast("int").alias("destination_port"))
    rows.repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def broken(column):
    raise RuntimeError("no")


def test_metrics_come_from_the_job_that_writes(spark, ports, tmp_path):
    pipeline = (
        Pipeline()
        .add_batch_function("zero", lambda p: pc.equal(p, 0), ["destination_port"])
        .add_batch_function("none", lambda seq, p: None, ["seq", "destination_port"])
        .add_batch_function("broken", broken, ["seq"])
        .add_batch_function("odd", lambda seq: pa.array([s % 2 == 1 for s in seq.to_pylist()]), ["seq"])
    )
    metrics = Observation()
    marked = pipeline.observed(ports, metrics)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1
    marked.write.parquet(str(tmp_path / "out"))
    got = [(r.stage, r.packets_processed, r.errors) for r in pipeline.live_statistics(ports, metrics).orderBy("position").collect()]
    zero = ports.where("destination_port = 0").count()
    assert got == [("zero", 5000 - zero, zero), ("none", 5000, 0), ("broken", 0, 5000), ("odd", 2500, 2500)]
    # The same marks in the rows, and nothing lost.
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 5000 and out.where("errors & 2 <> 0").count() == 0 and out.where("errors & 8 <> 0").count() == 2500
    # The same numbers as of functions that see one packet at a time.
    slow = Pipeline().add_packet_function("zero", lambda p: 1 / p.destination_port if p.destination_port is not None and p.destination_port == p.destination_port else 0)
    row = slow.statistics(ports).first()
    assert (row.packets_processed, row.errors) == (5000 - zero, zero)


def test_metrics_of_no_packets(spark, ports, tmp_path):
    pipeline, metrics = Pipeline().add_batch_function("zero", lambda p: pc.equal(p, 0), ["destination_port"]), Observation()
    pipeline.observed(ports.where("seq < 0"), metrics).write.parquet(str(tmp_path / "out"))
    assert [(r.packets_processed, r.errors) for r in pipeline.live_statistics(ports, metrics).collect()] == [(0, 0)]


@F.udtf(returnType="k int")
class CountDown:
    def eval(self, port: int):
        for k in range(port or 0):
            yield (k,)


def test_table_functions_emit_rows(spark, ports):
    found = Pipeline().add_emitter("down", CountDown, ["destination_port"]).emitted(ports)["down"]
    assert found.columns == ["seq", "k"] and found.count() == ports.agg(F.sum("destination_port")).first()[0]


def test_stage_outputs_leave_nothing_in_the_executors(spark, ports):
    out = Pipeline().add_stage("a", lambda df: df.where("seq < 10")).add_stage("b", lambda df: df.groupBy().count()).outputs(ports)
    assert out["a"].count() == 10 and out["b"].first()[0] == 5000
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty() or not out["a"].storageLevel.useMemory


def test_a_pipeline_model_runs_in_the_jvm(spark, sf_dir, tmp_path):
    from wirelark.sources import derived

    packets = derived.packets(spark, sf_dir).cache()
    names, vector = scoring.feature_columns(), scoring.features()
    taught = packets.select(*[vector[i].cast("double").alias(n) for i, n in enumerate(names)], (F.col("payload_length") > 3000).cast("double").alias("label"))
    stages = [VectorAssembler(inputCols=names, outputCol="features"), LogisticRegression(featuresCol="features")]
    MlPipeline(stages=stages).fit(taught).write().save(str(tmp_path / "model"))
    model = scoring.PipelineScore(PipelineModel.load(str(tmp_path / "model")), "probability")
    scored = scoring.ml_score(packets, model)
    assert scored.columns == [*packets.columns, "score"]
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    wrong = scored.where((F.col("score") > 0.5) != (F.col("payload_length") > 3000)).count()
    assert wrong < 0.05 * packets.count()
    config = DetectionConfig(rule_based_enabled=False, statistical_enabled=False, enable_ml_inference=True)
    found = detect_all(packets, config, model)
    assert 0 < found.count() == scored.where("score > 0.8").count()
    none = scoring.ml_score(packets.where("false"), model)
    assert none.count() == 0
