import hashlib
import re

import numpy as np
import pytest

import driftlake.llm.substring_dedup as sd
from driftlake.llm.common import prepare, table


def brute(docs, window=20):
    """docs: (id, text) in order; returns per row (n_words, n_removed, kept)."""
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    seen, out = set(), []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, m, k) in zip(docs, brute(docs))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.op1_substring_dedup(spark, sf).collect()}
    assert got == want and sum(m for _, m, _ in want.values()) > 0


@pytest.mark.parametrize("most", [3, 200])
def test_many_buckets_and_groups(spark, monkeypatch, most):
    """Small buckets, groups and windows: prefixes of both lengths and shards decide, passages cross buckets, texts repeat themselves."""
    prepare(spark)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(sd, "MOST_BUCKET_BYTES", 3000)
    monkeypatch.setattr(sd, "GROUP_STRETCHES", most)
    monkeypatch.setattr(sd, "PART_ANCHORS", 100)
    rnd = np.random.default_rng(4)
    passage = " ".join(map(str, rnd.integers(0, 50, 40)))
    docs = []
    for i in range(150):
        text = " ".join(map(str, rnd.integers(0, 3 if i % 5 == 0 else 1000, int(rnd.integers(0, 80)))))
        if i % 3 == 0:
            text += " " + passage + " tail"
        if i % 7 == 0:
            text += " x" * 50 + " y z" * 20
        docs.append((i, text))
    docs += [(200 + i, docs[3][1]) for i in range(30)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sd.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == dict(zip((i for i, _ in docs), brute(docs)))


def test_odd_rows(spark, odd_docs):
    prepare(spark)
    docs = [(r.doc_id, r.text) for r in odd_docs.orderBy("doc_id").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sd.without_repeats(odd_docs).collect()}
    assert got == dict(zip((i for i, _ in docs), brute(docs)))
    assert sd.without_repeats(odd_docs.where("false")).count() == 0


def test_repeated_and_missing_ids(spark):
    prepare(spark)
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (1, text), (None, text), (0, text + " 30")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 0, 0), (False, 1, 30), (False, 1, 30), (True, 0, 30)]


@pytest.mark.parametrize("n", range(1, 13))
def test_sliding_least(n):
    x = np.random.default_rng(n).integers(0, 99, 60)
    assert sd.sliding_least(x, n).tolist() == [x[i : i + n].min() for i in range(60 - n + 1)]


def test_ranks_are_lexicographic():
    rng = np.random.default_rng(2)
    for depth in (1, 2, 5, 20):
        codes = rng.integers(0, 3, 300)
        rank = sd.ranks_at(codes, depth)[: 300 - depth + 1]
        runs = [tuple(codes[i : i + depth]) for i in range(300 - depth + 1)]
        order = {r: k for k, r in enumerate(sorted(set(runs)))}
        assert (np.argsort(rank, kind="stable") == sorted(range(len(runs)), key=lambda i: (order[runs[i]], i))).all()
        assert len(set(rank.tolist())) == len(order)


def test_words_of_equal_hash_are_told_apart(spark):
    """The Thue-Morse word and its complement agree in polynomial hashes modulo a power of two."""
    prepare(spark)
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    pair = sd.word_hashes(*(np.frombuffer(f"{word} {other}".encode(), np.uint8), np.array([0, 2049]), np.array([2048, 4097])))
    assert pair[0] == pair[1]
    common = " ".join(map(str, range(19)))
    rows = [(1, f"{word} {common}"), (2, f"{other} {common}"), (3, f"{word} {common}")]
    got = {r.doc_id: r.n_removed for r in sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_one_id_or_none_in_all_rows(spark, monkeypatch):
    """Rows of one id and rows without id are dealt out by their texts; one copy of each text is kept."""
    prepare(spark)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(sd, "MOST_BUCKET_BYTES", 2000)
    texts = [" ".join(f"w{i}x{k}" for k in range(25)) for i in range(20)]
    rows = [(i, t) for i in (None, 7) for t in texts for _ in range(2)]
    got = sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got if r.doc_id) == [(7, 0)] * 20 + [(7, 25)] * 20
    assert {r.n_removed for r in got if r.doc_id is None} == {25} and len(got) == 80
