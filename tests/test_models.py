"""The approximate kernel machines against an exact one, and every kind of model through a file."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from clausewise.operators import models as M
from clausewise.operators import topics as T
from clausewise.sources import io

GAMMA, C = 0.7, 5.0


def kernel(x, y):
    return np.exp(-GAMMA * ((x[:, None] - y[None]) ** 2).sum(axis=2))


def exact_machine(x, y):
    """Dual of the hinge-loss machine with an unpenalised bias, by steps on the most violating pair."""
    k, a, g = kernel(x, x), np.zeros(len(x)), -np.ones(len(x))
    while True:
        up = ((y > 0) & (a < C)) | ((y < 0) & (a > 0))
        low = ((y < 0) & (a < C)) | ((y > 0) & (a > 0))
        i, j = np.argmax(np.where(up, -y * g, -np.inf)), np.argmin(np.where(low, -y * g, np.inf))
        gap = -y[i] * g[i] + y[j] * g[j]
        if gap < 1e-5:
            return a, (-y[i] * g[i] - y[j] * g[j]) / 2
        step = min(gap / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), C - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else C - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += y * step * (k[:, i] - k[:, j])


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(3)
    x = draw.uniform(-2, 2, size=(560, 3))
    y = np.where(np.sin(2 * x[:, 0]) + x[:, 1] ** 2 - 0.8 * x[:, 2] + draw.normal(size=560) * 0.25 > 1, 1.0, -1.0)
    rows = spark.createDataFrame([(i, Vectors.dense(v.tolist()), float(s > 0)) for i, (v, s) in enumerate(zip(x, y, strict=True))], ["id", "features", "y"])
    return x, y, rows.repartition(4)


def decisions(model, rows):
    got = model.transform(rows).select("id", vector_to_array("rawPrediction").alias("r")).collect()
    return np.array([r.r[1] for r in sorted(got, key=lambda r: r.id)])


def test_agreement_with_the_exact_kernel_machine(data):
    x, y, rows = data
    a, bias = exact_machine(x[:200], y[:200])
    want = kernel(x, x[:200]) @ (a * y[:200]) + bias
    train = rows.filter("id < 200")
    agree = {}
    for name, kw in {"fourier 512": {"n_components": 512}, "nystroem 60": {"n_components": 60, "kernel": "nystroem"},
                     "nystroem 200": {"n_components": 200, "kernel": "nystroem"}}.items():
        got = decisions(M.fit_rbf_svm(train, C=C, gamma=GAMMA, max_iter=400, **kw), rows)
        agree[name] = (np.mean((got[200:] > 0) == (want[200:] > 0)), np.corrcoef(got[200:], want[200:])[0, 1])
    print({k: tuple(round(float(v), 3) for v in x) for k, x in agree.items()})
    assert agree["nystroem 200"][0] > 0.97 and agree["nystroem 60"][0] > 0.93 and agree["fourier 512"][0] > 0.88
    assert agree["nystroem 200"][1] > 0.99
    with pytest.raises(ValueError):
        M.fit_rbf_svm(train, kernel="other")


def test_every_kind_of_model_is_saved_and_loaded(spark, data, tmp_path):
    _, _, rows = data
    vectors = rows.select("id", vector_to_array("features").alias("embedding"))
    pca, _ = T.reduce_dims(vectors, k=2)
    kmeans, placed = T.cluster_kmeans(vectors, k=3)
    small = rows.filter("id < 60")
    models = {"svm": M.fit_rbf_svm(small, gamma=GAMMA, n_components=32), "nystroem": M.fit_rbf_svm(small, gamma=GAMMA, n_components=32, kernel="nystroem"),
              "logreg": M.fit_logreg(small, reg=0.1), "forest": M.fit_random_forest(small, trees=5, depth=3), "pca": pca, "kmeans": kmeans}
    for name, model in models.items():
        path = os.path.join(tmp_path, name)
        io.save_model(model, path)
        again = io.load_model(path)
        assert type(again) is type(model)
        if name in ("svm", "nystroem", "logreg", "forest"):
            assert np.allclose(decisions(again, rows), decisions(model, rows))
    want = {r.id: r.topic for r in placed.collect()}
    got = io.load_model(os.path.join(tmp_path, "kmeans")).transform(placed.drop("topic").withColumn("_v", F.udf(Vectors.dense, rows.schema["features"].dataType)("embedding")))
    assert {r.id: r.topic for r in got.collect()} == want


def test_plain_delimited_files_are_split(spark, tmp_path):
    path = str(tmp_path / "plain.csv")
    with open(path, "w") as f:
        f.write("VIM id|Sentence identifier|Chunk identifier|Chunk\n" + "".join(f"{i}|{i}-1|{i}-1-1|words of clause {i}\n" for i in range(20_000)))
    size = os.path.getsize(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size // 5)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        one, many = io.read_clauses(spark, path), io.read_clauses(spark, path, multi_line=False)
        assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() >= 5
        assert sorted(one.collect()) == sorted(many.collect()) and many.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
