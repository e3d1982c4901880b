"""Repeated ids, full blocks and large components in top-k search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.llm import topk_search
from driftlake.llm.common import prepare


def test_top_k_of_repeated_ids(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(topk_search, "CANDIDATES", 10)
    monkeypatch.setattr(topk_search, "QUERIES", 2)
    x = np.random.default_rng(8).integers(-9, 9, (40, 4)).astype(float)
    rows = [(int(i) // 2 if i < 20 else int(i), v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 2
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") < 3, 6, 1.0).collect()
    want = []
    for a, (i, q) in enumerate(rows):
        if i < 3:
            best = sorted((-int(np.dot(q, v)), j) for b, (j, v) in enumerate(rows) if b != a)[:6]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_proof_stops_early_and_overflow_raises(spark):
    prepare(spark)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32)) * np.where(np.arange(32) < 6, 9.0, 0.03)  # few dimensions decide
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got = topk_search.top_k(df, F.col("vec_id") % 100 == 0, 5, proof=True).collect()
    whole = np.floor(64 * x).astype(np.int64)
    for i in range(0, 3000, 100):
        score = whole @ whole[i]
        best = [j for j in np.lexsort((np.arange(3000), -score)) if j != i][:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [(j, score[j]) for j in best]
    assert sum(r.rescored for r in got) < 0.2 * 3000 * len(got) and all(r.processed < np.count_nonzero(whole) for r in got)
    for big in (1e300, 3e9):
        rows = spark.createDataFrame([(i, [big, big]) for i in range(30)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk_search.top_k(rows, F.col("vec_id") == 0, 3).collect()


def test_rows_of_several_batches_keep_numbers_of_their_own(spark):
    """Batches of 1000 rows do not end where blocks do; each vector's best candidate is its copy 976 rows further on."""
    prepare(spark)
    base = np.random.default_rng(10).normal(size=(976, 8))
    x = np.floor(64 * base)[np.arange(4200) % 976].astype(np.int64)
    rows = [(i, (x[i] / 64).tolist() + [0.0] * (i % 3 == 0)) for i in range(4200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    blocks = topk_search.packed_blocks(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding", 64.0).selectExpr("octet_length(ids) / 8 AS n").collect()
    assert max(r.n for r in blocks) <= topk_search.BLOCK_ROWS and sum(r.n for r in blocks) == 4200
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0).collect()
    want = []
    for i in range(0, 4200, 20):
        score = x @ x[i]
        best = [j for j in np.lexsort((np.arange(4200), -score)).tolist() if j != i][:20]
        want += [(i, n + 1, j, int(score[j])) for n, j in enumerate(best)]
    assert sorted(tuple(r) for r in got) == want


def test_scores_that_fit_though_their_parts_do_not(spark):
    prepare(spark)
    rows = [(0, [2.0**40, 2.0**40])] + [(i, [2.0**40, -(2.0**40) + i]) for i in range(1, 9)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3, 1.0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i * 2**40) for i in (8, 7, 6)]
