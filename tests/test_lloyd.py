"""k-means without chance and the agreement of runs, against plain numpy."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from clausewise.operators import topics as T


def brute(ids, x, k, start, steps):
    order = np.argsort(ids)
    square = lambda c: np.round(((x[:, None] - c[None]) ** 2).sum(axis=2), T.DIGITS)
    centres = x[order[start]][None]
    while len(centres) < k:
        far = square(centres).min(axis=1)
        best = min(range(len(x)), key=lambda i: (-far[i], ids[i]))
        if far[best] == 0:
            break
        centres = np.vstack([centres, x[best]])
    for _ in range(steps):
        topic = square(centres).argmin(axis=1)
        new = np.array([np.round(x[topic == i].mean(axis=0), T.DIGITS) if (topic == i).any() else c for i, c in enumerate(centres)])
        if (new == centres).all():
            break
        centres = new
    return centres, dict(zip(ids.tolist(), square(centres).argmin(axis=1).tolist(), strict=True))


def agreement(a, b):
    pairs = list(itertools.combinations(sorted(a), 2))
    one, two = ({p for p in pairs if r[p[0]] == r[p[1]]} for r in (a, b))
    chance = len(one) * len(two) / len(pairs)
    top = (len(one) + len(two)) / 2
    return 1.0 if one == two else (len(one & two) - chance) / (top - chance)


def test_lloyd_steps_and_agreement(spark):
    draw = np.random.default_rng(6)
    ids = draw.permutation(90)
    x = draw.normal(size=(90, 4)) + draw.integers(0, 3, size=90)[:, None] * 3
    x[5] = x[9]
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").withColumns({c: F.lit("extra") for c in ("id", "vec", "topic", "far")}).repartition(3)
    runs = {}
    for start, k, steps in ((0, 3, 20), (40, 5, 2), (89, 8, 20)):
        want_centres, want = brute(ids, x, k, start, steps)
        centres, out = T.cluster_lloyd(df, "vec_id", "embedding", k, start, steps)
        runs[start] = {r.vec_id: r.topic for r in out.collect()}
        assert runs[start] == want and np.allclose(centres, want_centres)
    stacked = [(s, i, t) for s, r in runs.items() for i, t in r.items()] + [(99, i, 7) for i in runs[0]] + [(100, i, 1) for i in runs[0]] + [(0, 500, None)]
    got = {(r.run_a, r.run_b): (r.n, r.agreement) for r in T.run_agreement(spark.createDataFrame(stacked, "run int, vec_id int, topic bigint"), "vec_id").collect()}
    assert len(got) == 10 and all(n == 90 for n, _ in got.values()) and got[99, 100][1] == 1.0
    for a, b in itertools.combinations(runs, 2):
        assert math.isclose(got[a, b][1], agreement(runs[a], runs[b]), abs_tol=1e-9)


def test_lloyd_of_little(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    centres, out = T.cluster_lloyd(df, "vec_id", "embedding", 4)
    assert len(centres) == 1 and {r.vec_id: r.topic for r in out.collect()} == {1: 0, 2: None, 3: 0}
    centres, out = T.cluster_lloyd(df.limit(0), "vec_id", "embedding", 4)
    assert len(centres) == 0 and out.collect() == []
