"""Drift of vectors against plain numpy: frequent equal vectors, ties at the border, many partitions."""

import numpy as np
import pytest

from driftlake.operators import drift


def table(spark, seq, x, parts=3):
    rows = [(int(i), v.tolist()) for i, v in zip(seq, x)] + [(5, [float("nan")] * x.shape[1]), (6, None)]
    return spark.createDataFrame(rows, "seq long, features array<double>").repartition(parts)


def plain(seq, x, method):
    order = np.argsort(seq, kind="stable")
    seq, x = seq[order], x[order]
    edge = seq[max(8, round(0.4 * len(x))) - 1]
    a, b = x[seq <= edge], x[seq > edge]
    mean, cov, p = a.mean(0), np.cov(a.T), x.shape[1]
    if method == "mahalanobis":
        d = (b - mean) @ np.linalg.inv(cov + 1e-6 * np.eye(p))
        return np.sqrt(np.maximum((d * (b - mean)).sum(1), 0)).mean() / np.sqrt(p)
    if method == "pca":
        values, vectors = np.linalg.eigh(cov)
        top = np.argsort(values)[::-1][:3]
        score = (b - mean) @ vectors[:, top]
        return ((score @ np.linalg.inv(np.diag(values[top]) + 1e-6 * np.eye(len(top)))) * score).sum(1).mean()
    if method == "covariance":
        return np.linalg.norm(np.corrcoef(a.T) - np.corrcoef(b.T)) / p
    far = lambda u, v: np.sqrt(((u[:, None] - v[None]) ** 2).sum(-1)).mean()
    return 2 * far(a, b) - far(a, a) - far(b, b)


@pytest.mark.parametrize("method", ["mahalanobis", "pca", "covariance", "energy"])
def test_figures_are_those_of_numpy(spark, method):
    rng = np.random.default_rng(1)
    for seq, x, parts in (
        (np.arange(300), rng.normal(size=(300, 5)), 3), (np.repeat(np.arange(60), 5), rng.normal(size=(300, 4)) + np.repeat([[0.0], [1.0]], 150, 0), 40),
        (np.arange(200), np.where(rng.random((200, 1)) < 0.6, 1.0, rng.normal(size=(200, 3))), 3),
    ):
        got = drift.multivariate(table(spark, seq, x, parts), method).first()
        assert got.magnitude == pytest.approx(plain(seq, x, method), rel=1e-7)
