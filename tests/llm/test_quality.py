"""Quality of documents: held-out labels, gradients, passages and odd rows."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftlake.llm import quality
from driftlake.llm.common import prepare
from tests.llm.conftest import ODD_TEXTS


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_held_out_labels(spark, sf):
    got = quality.op12_attention_quality(spark, sf).toArrow().to_pandas()
    docs = pq.read_table(f"{sf}/documents.parquet").num_rows
    assert len(got) == docs and got.score.between(0, 1).all()
    m = got.merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    m = m[m.held_out]
    good, bad = m[m.quality == 1], m[m.quality == 0]
    auc = (good.score.to_numpy()[:, None] > bad.score.to_numpy()).mean()
    assert auc > 0.98 and (bad.predicted == 0).mean() > 0.9 and (good.predicted == 1).mean() > 0.97


def test_passages_of_any_size(monkeypatch):
    """Features do not depend on how a text is cut into chunks, and each passage has its own words only."""
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("abcDE é|1."), rng.integers(1, 9))) for _ in range(n)) for n in (0, 1, 63, 64, 65, 500)] + [None, "x" * 3000, "\n \n"]
    whole = [(r, x) for r, x in quality.encoded(pa.array(texts))]
    row, x = np.concatenate([r for r, _ in whole]), np.concatenate([x for _, x in whole])
    words = [len((t or "").split(" ")) if (t or "").strip() else 0 for t in texts]
    assert set(row.tolist()) == set(range(len(texts)))
    assert row.tolist().count(7) == 1 and row.tolist().count(6) == 1 and words[0] == 0
    monkeypatch.setattr(quality, "CHUNK", 700)
    again = np.concatenate([x for _, x in quality.encoded(pa.array(texts))])
    assert again.shape == x.shape and np.abs(again[:, quality.BINS :] - x[:, quality.BINS :]).max() < 1e-6
    for k, t in enumerate(texts):  # a text's passages are the same beside others and alone
        alone = np.concatenate([x for _, x in quality.encoded(pa.array([t], pa.string()))])
        assert np.abs(alone - again[row == k])[:, quality.BINS :].max(initial=0) < 1e-6


def test_attention_finds_the_passage():
    """Bags whose label hangs on one passage of many; the attention goes to that one."""
    rng = np.random.default_rng(1)
    bags, label = [], []
    for i in range(400):
        x = rng.normal(size=(rng.integers(3, 12), quality.WIDTH)).astype(np.float32)
        x[:, quality.BINS + 5] = np.log1p(64)
        if i % 3 == 0:
            x[rng.integers(len(x)), :6] += 6
        bags.append(x)
        label.append(float(i % 3 == 0))
    label = np.array(label, np.float32)
    model = quality.fit(bags[:300], label[:300], np.ones(300, np.float32))
    right, found = 0, []
    for x, y in zip(bags[300:], label[300:]):
        e, v = model.passages(x)
        a = np.exp(e - e.max())
        right += ((a * v).sum() / a.sum() + model.bias > 0) == (y == 1)
        if y:
            found.append(a.argmax() == x[:, :6].sum(1).argmax())
    assert right > 92 and np.mean(found) > 0.9


def test_odd_rows(spark, odd_docs):
    prepare(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(12)] + [(None, 1, "x"), (3, None, "x"), (3, 0, "x")], "doc_id long, quality int, score string")
    model = quality.learn(odd_docs, labels, F.col("doc_id") >= 0)
    got = {r.doc_id: r.score for r in quality.scored(odd_docs, model).collect()}
    assert set(got) == set(range(len(ODD_TEXTS))) and all(0 <= s <= 1 for s in got.values()) and got[10] == got[11] and got[0] == got[1]
    again = quality.learn(odd_docs.repartition(3), labels, F.col("doc_id") >= 0)
    assert {r.doc_id: r.score for r in quality.scored(odd_docs, again).collect()} == pytest.approx(got, abs=1e-6)
    for rows in ([], [(1, 1, "x"), (2, 1, "x")]):
        flat = quality.learn(odd_docs, spark.createDataFrame(rows, labels.schema), F.col("doc_id") >= 0)
        assert len({r.score for r in quality.scored(odd_docs, flat).collect()}) == 1
    assert quality.scored(odd_docs.limit(0), model).collect() == []
