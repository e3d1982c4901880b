import random
import re

import numpy as np
import pytest
import xxhash

from driftlake.llm.common import prepare, table
from driftlake.llm.simhash import chains, components, linked, near_duplicates, op7_simhash, segments, stars


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget=4):
    ids = list(prints)
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i: root(i) for i in ids}


def check(rows, texts):
    prints = {i: brute_print(t) for i, t in texts.items()}
    groups = brute_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(op7_simhash(spark, "/root/testdata/sf0.001").collect(), {r.doc_id: r.text for r in docs.collect()})


def test_odd_rows(spark, odd_docs):
    prepare(spark)
    check(near_duplicates(odd_docs).collect(), {r.doc_id: r.text for r in odd_docs.collect()})
    assert near_duplicates(odd_docs.where("false")).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_some_key_holds_every_link(depth):
    rnd = random.Random(depth)
    keys = chains(4, depth)
    assert sum(n for _, n in segments(4)) == 64
    for _ in range(3000):
        x = 0
        for _ in range(rnd.randint(0, 4)):
            x |= 1 << rnd.randrange(64)
        assert any(x & mask == 0 for _, mask in keys)


@pytest.mark.parametrize("members", [4, 4096])
def test_links_join_the_groups_of_all_pairs(spark, members):
    rnd = random.Random(3)
    prints = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(15):
        center = rnd.getrandbits(64)
        for _ in range(20):
            x = center
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints = dict(enumerate(sorted(prints)))
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints.values()], "print long")
    place = {int(np.uint64(p).view(np.int64)): i for i, p in prints.items()}
    got = [tuple(r) for r in linked(nodes, 4, members).collect()]
    groups = brute_components(prints)
    assert len(got) == len(set(got)) and all(a < b and groups[place[a]] == groups[place[b]] for a, b in got)
    found = {place[r.node]: r.component for r in components(spark.createDataFrame(got, "a long, b long")).collect()}
    assert {(i, j) for i in prints for j in prints if groups[i] == groups[j]} == {
        (i, j) for i in prints for j in prints if found.get(i, ("alone", i)) == found.get(j, ("alone", j)) or i in found and place[found[i]] == j or j in found and place[found[j]] == i
    }


def test_stars_give_the_least_reachable():
    a, b = stars(np.array([5, 1, 9, 7, 5]), np.array([3, 5, 8, 9, 1]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 3), (1, 5), (7, 8), (7, 9)]
    chain = np.arange(500)
    a, b = stars(chain[1:], chain[:-1])
    assert (a == 0).all() and b.tolist() == list(range(1, 500))


def test_rows_without_id_join_and_bridge(spark, monkeypatch):
    """0 and 6 bits are too far apart, the text without id lies between them; a group of rows without id has no name."""
    import driftlake.llm.simhash as own

    fixed = {"a": 0, "b": 0b111, "c": 0b111111, "far": 2**63 - 1}
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (None, "far")], "doc_id long, text string").coalesce(1)
    prepare(spark)

    def prints(data, offsets, shingle):
        table = {ord("a"): 0, ord("b"): 0b111, ord("c"): 0b111111, ord("f"): 2**63 - 1}
        return np.array([table[data[k]] for k in offsets[:-1]], np.uint64)

    monkeypatch.setattr(own, "fingerprints", prints)
    got = {int(r.fingerprint, 16): r.component_id for r in near_duplicates(docs).collect()}
    assert got == {fixed["a"]: 1, fixed["b"]: 1, fixed["c"]: 1, fixed["far"]: None}
