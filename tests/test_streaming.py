import numpy as np
import pytest
from helpers import frame, kernel_table

from marginwise.functions.kernels import GaussianKernel
from marginwise.plans import evaluation, streaming

KERNEL, EPSILON = GaussianKernel(0.5), 0.05
SCHEMA = "id bigint, label int, x array<double>"


def test_files_are_scored_once_across_restarts(spark, tmp_path):
    rng = np.random.default_rng(3)
    S, X = rng.normal(size=(20, 3)), rng.normal(size=(90, 3))
    z = rng.normal(size=20)
    rows = [(k, [float(v) for v in x], float(c)) for k, (x, c) in enumerate(zip(S, z))]
    support = spark.createDataFrame(rows, "id bigint, x array<double>, z double")
    source, output, checkpoint = (str(tmp_path / name) for name in ("in", "out", "offsets"))

    def arrive(part):
        frame(spark, X[part], ids=range(part.start, part.stop)).repartition(3).write.mode("append").parquet(source)

    def run():
        query = streaming.score_stream(
            spark, source, SCHEMA, support, KERNEL, EPSILON, output, checkpoint, bias=0.25, files_per_batch=1
        )
        query.awaitTermination()
        return len([p for p in query.recentProgress if p["numInputRows"]])

    arrive(slice(0, 60))
    assert run() == 3
    assert spark.read.parquet(output).count() == 60
    assert run() == 0
    arrive(slice(60, 90))
    spark.createDataFrame([(900, 1, None), (901, 1, [None, 1.0, 2.0])], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run() == 4
    found = {r["id"]: r["score"] for r in spark.read.parquet(output).collect()}
    K = kernel_table(KERNEL, X, S)
    want = np.where(K > EPSILON, K, 0.0) @ z + 0.25
    assert len(found) == 92 and spark.read.parquet(output).count() == 92
    assert all(found[k] == pytest.approx(want[k]) for k in range(90)) and found[900] == found[901] == 0.25
    whole = evaluation.score_rows(frame(spark, X), support, KERNEL, EPSILON, 0.25).collect()
    assert all(found[r["id"]] == pytest.approx(r["score"]) for r in whole)


def test_a_large_model_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evaluation, "MODEL_BYTES", 10)
    support = spark.createDataFrame([(1, [1.0, 2.0], 1.0)], "id bigint, x array<double>, z double")
    with pytest.raises(ValueError, match="MODEL_BYTES"):
        streaming.score_stream(spark, str(tmp_path), SCHEMA, support, KERNEL, EPSILON, str(tmp_path / "o"), str(tmp_path / "c"))
