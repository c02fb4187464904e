"""Density clustering against all pairs."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.operators import neighbours as N
from clausewise.operators import topics as T


def brute(rows, eps, least):
    """Topic by id: rows (id, vector or None); ids are unique."""
    known = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None]
    near = {i: {j for j, y in known if ((x - y) ** 2).sum() <= eps * eps} for i, x in known}
    core = {i for i in near if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            label[i] = i
            while todo:
                new = [j for j in near[todo.pop()] & core if j not in label]
                label.update(dict.fromkeys(new, i))
                todo += new
    for i in near:
        if i not in core and near[i] & core:
            label[i] = min(label[j] for j in near[i] & core)
    order = sorted(collections.Counter(label.values()).items(), key=lambda x: (-x[1], x[0]))
    number = {k: n for n, (k, _) in enumerate(order)}
    return {i: number[label[i]] if i in label else -1 for i, _ in rows}


def topics_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>").withColumns({c: F.lit("extra") for c in ("vec", "vid", "w", "cell", "bid")})
    got = T.cluster_density(df.repartition(3), **kw).collect()
    assert len(got) == len(rows)
    return {r.id: r.topic for r in got}


@pytest.mark.parametrize("block", [4, 1024])
def test_density_equals_all_pairs(spark, block):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(4, 5)) * 3
    rows = [(int(i), [float(x) for x in centres[i % 4] + draw.normal(size=5) * 0.4]) for i in range(120)]
    rows += [(200 + i, [float(x) for x in draw.normal(size=5) * 5]) for i in range(25)]      # scattered
    rows += [(300 + i, list(rows[0][1])) for i in range(30)]                                 # one vector often
    rows += [(400, None), (401, None), (402, [0.0] * 5)]
    for eps, least in ((1.0, 5), (0.5, 3), (2.5, 8)):
        want = brute(rows, eps, least)
        assert len(set(want.values())) > 2
        assert topics_of(spark, rows, eps=eps, min_pts=least, block=block) == want


def test_equal_sums_do_not_make_one_topic(spark):
    """Two far-apart groups whose vectors have the same coordinate sums, signed in any way that pairs coordinates."""
    draw = np.random.default_rng(7)
    rows = []
    for i in range(24):
        v = np.zeros(64)
        v[[0, 7, 14, 21] if i % 2 else [28, 35, 42, 49]] = 1 + draw.normal(size=4) * 0.02
        rows.append((i, [float(x) for x in v]))
    got = topics_of(spark, rows, eps=0.5, min_pts=4)
    assert got == brute(rows, 0.5, 4) and {got[i] for i in range(0, 24, 2)} != {got[i] for i in range(1, 24, 2)} and set(got.values()) == {0, 1}


def test_no_group_holds_a_hot_cell(spark):
    draw = np.random.default_rng(2)
    vectors = spark.createDataFrame([([float(x) for x in draw.normal(size=3) * 1e-3],) for _ in range(900)], "vec array<double>")
    points, pairs = N.blocked(vectors, eps=1.0, block=50)
    sizes = [r["n"] for r in points.join(pairs, "bid").groupBy("pair").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 18 * 19 // 2 and max(sizes) <= 200
    # every unordered pair of vectors meets in one group
    met = collections.Counter()
    for r in points.join(pairs, "bid").groupBy("pair").agg(F.collect_list(F.struct("side", F.hash("vec").alias("h"))).alias("m")).collect():
        if r.m[0].side == 2:
            met.update(tuple(sorted((a.h, b.h))) for i, a in enumerate(r.m) for b in r.m[:i])
        else:
            met.update(tuple(sorted((a.h, b.h))) for a in r.m if a.side == 0 for b in r.m if b.side == 1)
    assert len(met) == 900 * 899 // 2 and set(met.values()) == {1}


def test_density_of_nothing(spark):
    assert topics_of(spark, []) == {}
    assert topics_of(spark, [(1, None)]) == {1: -1}
    assert topics_of(spark, [(1, [1.0]), (2, [1.0])], eps=0.1, min_pts=2) == {1: 0, 2: 0}
