"""Stored vectors meet rows in blocks: only ids travel with the rows."""

import numpy as np

from clausewise.operators import embeddings as E
from clausewise.operators import similarity as Q


def test_means_of_stored_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (2, [5.0, 7.0]), (3, None), (4, [1.0]), (5, [None, 4.0]), (None, [9.0, 9.0])],
                                    "vec_id bigint, embedding array<float>")
    rows = spark.createDataFrame([("a", [1, 1, 2]), ("b", [3, 1]), ("c", [3]), ("d", [7, None]), ("e", []), ("f", None), ("g", [4, 1]), ("h", [5, 1])],
                                 "k string, ids array<bigint>")
    got = {r.k: (r.v, r.n) for r in E.attach_means(rows, vectors, {"v": "ids"}, {"n": "ids"}, needed=False).collect()}
    assert got == {"a": ([2.5, 4.25], 4), "b": ([1.0, 2.0], 1), "c": (None, 0), "d": (None, None), "e": (None, None), "f": (None, None),
                   "g": ([1.0, None], 2), "h": ([None, 3.0], 2)}
    assert {r.k for r in E.attach_means(rows, vectors, {"v": "ids"}).collect()} == {"a", "b", "c", "g", "h"}
    assert E.attach_means(rows.withColumnRenamed("k", "_block"), vectors, {"v": "ids"}).columns == ["_block", "ids", "v"]


def test_means_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_IDS", 50)
    draw = np.random.default_rng(1)
    stored = draw.normal(size=(40, 5))
    lists = [[int(i) for i in draw.integers(44, size=draw.integers(1, 30))] for _ in range(300)]  # ids from 40 on are unknown
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(stored)], "vec_id bigint, embedding array<double>")
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, ids array<bigint>")
    got = {r.k: r.ids for r in E.attach_means(rows, vectors, {"ids": "ids"}).collect()}
    want = {k: stored[[i for i in ids if i < 40]].mean(axis=0) for k, ids in enumerate(lists) if any(i < 40 for i in ids)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_cosines_of_references(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    refs = spark.createDataFrame([("a", [1]), ("b", [1, 2]), ("c", [8])], "id string, embedding array<bigint>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "z")], "id_a string, id_b string")
    got = Q.pairwise_cosine(pairs, refs, resolve=lambda df, *cols: E.attach_means(df, vectors, {c: c for c in cols})).collect()
    assert [(r.id_a, r.id_b, round(r.cosine, 6)) for r in got] == [("a", "b", 0.707107)]
