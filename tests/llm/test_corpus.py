"""Operators over whole tables: archives, top-k search, toxicity, and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftlake.llm import secret_scan, topk_search, toxicity, warc
from driftlake.llm.common import prepare, shared_folder, table
from tests.llm.test_near_sets import brute_groups
from tests.llm.test_packing import check as check_packing
from tests.llm.test_substring_dedup import brute as brute_dedup

SF = "/root/testdata/sf0.001"


def check_archives(pages, rows):
    """pages: {page_id: payload}."""
    last = {}
    for i, p in pages.items():
        last[p] = max(i, last.get(p, i))
    want = {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if last[p] == i else "revisit", None if last[p] == i else last[p]) for i, p in pages.items()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want and len(rows) == len(want)


def test_archives(spark):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, SF, "pages").collect()}
    check_archives(pages, warc.op2_warc(spark, SF).collect())


@pytest.mark.parametrize("step", [97, 1000, 1 << 20])
def test_ranges_of_any_size_find_each_record_once(spark, step):
    prepare(spark)
    rng = np.random.default_rng(2)
    magic = "\x1f\x8b\x08"
    payloads = ["", None, "same", "same", magic * 50, "WARC/1.1\r\n\r\n", *("".join(map(chr, rng.integers(1, 2000, 400))) for _ in range(12))]
    rows = spark.createDataFrame([(i, f"http://x/{i}", p, "x") for i, p in enumerate(payloads)], "page_id long, url string, html string, record_type string")
    files = warc.write_archives(rows.coalesce(1), shared_folder(spark, "warc"))
    got = warc.read_archives(files, range_bytes=step).collect()
    assert sorted(int(r.record_id) for r in got) == list(range(len(payloads)))
    last = {p or "": i for i, p in enumerate(payloads)}
    for r in got:
        p = payloads[int(r.record_id)] or ""
        assert (r.record_type == "response") == (last[p] == int(r.record_id))
        assert r.payload_bytes == len(p.encode()) and (r.payload is None or bytes(r.payload).decode() == p)
    assert warc.read_archives(warc.write_archives(rows.where("false"), shared_folder(spark, "warc"))).count() == 0


def plain_top(vectors, queries, k):
    ids = [i for i, _ in vectors]
    out = {}
    for i, q in vectors:
        if i in queries:
            scores = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    assert len(ids) == len(set(ids))
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_top_k(spark, monkeypatch):
    prepare(spark)
    rng = np.random.default_rng(5)
    monkeypatch.setattr(topk_search, "CANDIDATES", 50)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    x = rng.normal(size=(300, 8)).round(2)
    x[100:140] = x[100]
    rows = [(int(i), v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (901, [1.0, None], "x"), (902, [float("nan")] * 8, "x"), (903, [float("inf")] * 8, "x"), (904, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    vectors = [(i, np.floor(64 * np.array(v)).astype(int).tolist()) for i, v, _ in rows if i < 900 or i == 904]
    want = plain_top(vectors, {i for i, _ in vectors if i % 20 == 0}, 20)
    assert grouped(topk_search.top_k(df, F.col("vec_id") % 20 == 0).collect()) == want
    big = spark.createDataFrame([(i, [i * 2e6, 3e6]) for i in range(30)], "vec_id long, embedding array<double>")
    vectors = [(i, [64 * i * 2 * 10**6, 64 * 3 * 10**6]) for i in range(30)]
    assert grouped(topk_search.top_k(big, F.col("vec_id") < 5, 3).collect()) == plain_top(vectors, set(range(5)), 3)
    assert topk_search.top_k(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_toxicity_on_rows_not_learned_from(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.op6_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    rank = found.score.rank()
    n1 = int((found.toxic == 1).sum())
    auc = (rank[found.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(found) - n1))
    assert auc > 0.93
    hit = found[found.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.9 and (hit.toxic == 1).sum() / n1 > 0.75


def test_toxicity_odd_tables(spark, odd_docs):
    prepare(spark)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, None), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false")):
        model = toxicity.learn(odd_docs, some, ~toxicity.held_out())
        rows = toxicity.scored(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(odd_docs.where("false"), model).count() == 0


def test_pipeline_is_its_stages(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    model = toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels"), ~toxicity.held_out())
    scores = {r.doc_id: r.score for r in toxicity.scored(table(spark, SF, "documents"), model).collect()}
    kept = {i: r.text for i, r in docs.items() if scores[i] < toxicity.CUTOFF}
    groups = brute_groups(kept)  # 5-word Jaccard of 0.8 or more
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    order = sorted(kept)
    for i, (_, gone, text) in zip(order, brute_dedup([(i, kept[i]) for i in order])):
        kept[i] = text if gone else kept[i]
    kept = {i: secret_scan.redacted(t, secret_scan.all_spans(t)[1], corpus_pipeline.SECRET_MARK) for i, t in kept.items()}
    check_packing(corpus_pipeline.run(spark, SF).collect(), kept)


def test_stages_of_empty_tables(spark, odd_docs):
    docs = odd_docs.where("false").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_sample_is_bounded_in_bytes(spark):
    prepare(spark)
    rows = [(i, ("awful nasty " if i % 10 == 0 else "nice day ") * 5 + f"word{i}") for i in range(300)] + [(900, "awful nasty " * 100_000)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 10 == 0)) for i in [*range(300), 900]], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels, ~toxicity.held_out(), sample_bytes=12_000)
    assert len(model.words)
    assert toxicity.learn(docs, labels, ~toxicity.held_out(), sample_bytes=10).words.size == 0


def test_stages_keep_the_columns(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
    assert docs.count() >= 5
