"""The quality fit: sums over bins are sums over all pairs, ranks are exact."""

import numpy as np

from clausewise.llm import quality


def test_a_step_takes_every_pair():
    draw = np.random.default_rng(3)
    z, y = draw.normal(size=(90, 3)), np.arange(90) % 3 // 2
    w = np.array([0.4, -0.2, 0.1])
    d = (z[y == 1][:, None] - z[y == 0][None, :]).reshape(-1, 3)
    p = 1 / (1 + np.exp(d @ w))
    want = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(3), d.T @ p / len(d) - quality.RIDGE * w)
    assert np.allclose(quality.newton_step(quality.pair_sums(z, w, y), w), want, atol=2e-3)


def test_ranks_are_exact(spark):
    values = [float(v) for v in np.random.default_rng(5).normal(size=400) ** 3] + [0.5] * 60
    df = spark.createDataFrame([(v,) for v in values], "s double")
    for rank in (0, 200, 459):
        assert quality.at_rank(df, rank, few=40) == sorted(values)[rank]
