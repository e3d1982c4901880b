"""Hard negatives against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.llm import hard_negatives as hn
from driftlake.llm.common import prepare

SCHEMA = "vec_id long, label int, embedding array<double>"


def by_hand(rows, anchor, positives, negatives, scale):
    held = [(i, y, np.floor(scale * np.asarray(v)).astype(int)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in held), default=0)
    x = np.array([np.pad(v, (0, width - len(v))) for _, _, v in held], int).reshape(len(held), width)
    out = []
    for a, (i, y, _) in enumerate(held):
        if not anchor(i):
            continue
        score = (x @ x[a]).tolist()
        order = sorted((b for b in range(len(held)) if b != a), key=lambda b: (-score[b], held[b][0]))
        for p in [b for b in order if held[b][1] == y][:positives]:
            inside = [b for b in order if held[b][1] != y and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out += [(i, held[p][0], n + 1, held[b][0], score[p], score[b]) for n, b in enumerate(inside[:negatives])]
    return sorted(out)


def mined(spark, rows, anchor, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("p", F.lit("clash")).withColumn("rank", F.lit(0)).repartition(3)
    got = hn.hard_negatives(df, anchor, F.col("label"), **more)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    """Clusters, where bounds settle most, and scattered directions; repeated rows, ids and ties; odd rows."""
    prepare(spark)
    monkeypatch.setattr(hn, "CANDIDATES", 60)
    monkeypatch.setattr(hn, "ANCHORS", 7)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(5, 6))
    rows = [(i, int(i % 4), (middle[i % 5] + spread * rng.normal(size=6)).round(2).tolist()) for i in range(150)]
    rows += [(3, 3, rows[3][2])] * 2 + [(6, 1, rows[6][2])] + [(200 + i, 1, rows[9][2]) for i in range(40)]
    rows += [(300, None, [1.0] * 6), (None, 1, [1.0] * 6), (303, 1, None), (306, 1, [1.0, None]), (309, 1, [float("nan")] * 6), (312, 2, [float("inf")]), (315, 2, []), (318, 2, [2.0, 3.0]), (321, 9, [9.0] * 6)]
    got = mined(spark, rows, F.col("vec_id") % 3 == 0, positives=4, negatives=3, scale=8.0)
    assert got == by_hand(rows, lambda i: i % 3 == 0, 4, 3, 8.0) and len(got) > 100


def test_bounds_settle_candidates_of_clusters(spark):
    prepare(spark)
    rng = np.random.default_rng(5)
    middle = 4 * rng.normal(size=(8, 16))
    rows = [(i, int(i % 8 // 2 if i % 5 else 7), (rng.uniform(0.93, 1.03) * middle[i % 8] + 0.02 * rng.normal(size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = hn.hard_negatives(df, F.col("vec_id") % 41 == 0, F.col("label"), proof=True).collect()
    assert sorted(tuple(r)[:6] for r in got) == by_hand(rows, lambda i: i % 41 == 0, 5, 3, 256.0)
    print(len(got), np.mean([r.rescored for r in got]))
    assert np.mean([r.rescored for r in got]) < 0.5 * len(rows)


def test_empty_and_large(spark):
    prepare(spark)
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") >= 0, F.col("label")).collect() == []
    assert mined(spark, [(0, 1, [1.0])], F.col("vec_id") >= 0) == []
    big = [(i, i % 2, [2.0**20 * (1 + i), 1.0]) for i in range(8)]  # scores beyond 2^51
    assert mined(spark, big, F.col("vec_id") < 3) == by_hand(big, lambda i: i < 3, 5, 3, 256.0)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(i, i % 2, [3e9]) for i in range(9)], F.col("vec_id") < 3)


def test_sql(spark):
    from tests.llm.conftest import SF

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = [tuple(r) for r in hn.op11_hard_negatives(spark, SF).collect()]
    assert sorted(got) == sorted(con.sql(hn.ORACLE_SQL).fetchall()) and got
