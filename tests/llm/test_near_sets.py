import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftlake.llm import near_sets
from driftlake.llm.common import prepare, table
from driftlake.llm.near_sets import late_shingles, near_copies, without_near_copies
from tests.llm.test_simhash import brute_print

SF = "/root/testdata/sf0.001"


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    sets, group = {i: brute_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            both = len(sets[i] & sets[j])
            if group[i] != group[j] and (sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    return group


def copies():
    """A text, copies of it with some words changed - far more than 4 bits and up to 0.8 apart - and a common passage."""
    rnd = random.Random(3)
    passage = " ".join(f"common{k}" for k in range(30))
    texts = {i: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) + " " + passage for i in range(40)}
    for base in (0, 1, 2):
        words = " ".join(f"b{base}x{k}" for k in range(120)).split()
        for i in range(30):
            own = list(words)
            for k in rnd.sample(range(120), rnd.randrange(4)):
                own[k] = f"new{base}x{i}x{k}"
            texts[100 * (base + 1) + i] = " ".join(own)
    return texts


def check(rows, texts):
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted(brute_groups(texts).items())


def test_groups_are_those_of_all_pairs(spark, odd_docs):
    prepare(spark)
    check(near_copies(table(spark, SF, "documents")).collect(), {r.doc_id: r.text for r in table(spark, SF, "documents").collect()})
    check(near_copies(odd_docs).collect(), {r.doc_id: r.text for r in odd_docs.collect()})
    check(near_copies(spark.createDataFrame(list(copies().items()), "doc_id long, text string").repartition(5)).collect(), copies())
    assert near_copies(odd_docs.where("false")).count() == 0


def test_stage_drops_near_copies_beyond_four_bits(spark):
    texts = copies()
    a, b = next((i, j) for i in texts for j in texts if i < j and brute_groups({i: texts[i], j: texts[j]})[j] == i and (brute_print(texts[i]) ^ brute_print(texts[j])).bit_count() > 4)
    docs = spark.createDataFrame([(a, texts[a]), (b, texts[b])], "doc_id long, text string")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    assert [r.doc_id for r in corpus_pipeline.simhash(spark, docs, SF).collect()] == [a]


def test_list_of_late_shingles_is_bounded(spark):
    counted = spark.createDataFrame([(-k, 4 + k) for k in range(60)], "key long, n long")
    assert late_shingles(counted).tolist() == sorted((-k) % 2**64 for k in range(60))
    assert late_shingles(counted, most=50).tolist() == sorted((-k) % 2**64 for k in range(12, 60))
    assert late_shingles(counted, most=3).tolist() == []
    assert late_shingles(counted.where("false")).tolist() == []


def rows_of(spark, texts):
    """A table of (id, text) pairs with the pipeline's columns."""
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, n_chars long")
    return df.repartition(3).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), "n_chars")


def test_rows_of_one_id_are_rows_of_their_own(spark):
    prepare(spark)
    near = lambda k: " ".join([*(f"w{i}" for i in range(60)), *(f"x{k}y{i}" for i in range(2))])
    other = " ".join(f"o{i}" for i in range(60))
    docs = rows_of(spark, [(1, near(1)), (5, near(2)), (5, other), (6, near(3)), (6, near(3)), (7, other), (7, other)])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.simhash(spark, docs, SF).collect()) == [(1, near(1)), (5, other)]
    assert sorted((r.doc_id, r.component_id) for r in near_copies(docs).collect()) == [(1, 1), (5, 1), (5, 5), (6, 1), (6, 1), (7, 5), (7, 5)]


def test_rows_without_id_link_and_bridge(spark):
    prepare(spark)
    words = [f"w{i}" for i in range(100)]
    ends = [[f"a{i}" for i in range(15)], [f"b{i}" for i in range(15)]]
    one, middle, three = " ".join(words + ends[0]), " ".join(words), " ".join(words + ends[1])
    pair = lambda a, b: len(brute_set(a) & brute_set(b)) / len(brute_set(a) | brute_set(b))
    assert pair(one, middle) >= 0.8 and pair(middle, three) >= 0.8 > pair(one, three)
    alone = " ".join(f"z{i}" for i in range(30))
    docs = rows_of(spark, [(1, one), (None, middle), (3, three), (None, alone), (None, alone)])
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_copies(docs).collect()) == [(0, 0), (0, 0), (0, 1), (1, 1), (3, 1)]
    assert sorted(r.text for r in corpus_pipeline.simhash(spark, docs, SF).collect()) == sorted([one, alone])


def test_words_that_a_running_sum_cannot_tell_apart(spark):
    prepare(spark)
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [" ".join(["one", "two", "three", w, "four", "five", "six", "seven"]) for w in (thue, thue.translate(str.maketrans("ab", "ba")))]
    assert [r.component_id for r in near_copies(rows_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()] == [0, 1]


def templates(pages, shared, own):
    common = " ".join(f"t{i}" for i in range(shared + 4))
    return {k: " ".join(f"p{k}x{i}" for i in range(own)) + " " + common for k in range(pages)}


def test_pages_of_one_template_make_few_pairs(spark, monkeypatch):
    """2,000 pages with 400 shared shingles and some 84 own: too little to be linked, and no pairs of all of them."""
    prepare(spark)
    made = []
    plain = near_sets._meeting
    monkeypatch.setattr(near_sets, "_meeting", lambda met, far: made.append(plain(met, far)) or made[-1])
    docs = spark.createDataFrame(list(templates(2000, 400, 80).items()), "doc_id long, text string").repartition(8)
    assert near_copies(docs).where("doc_id <> component_id").count() == 0
    assert sum(p.count() for p in made) < 50 * 2000


def test_frequent_shingles_meet_block_by_block(spark, monkeypatch):
    """Blocks of a few rows: the groups are those of all pairs."""
    prepare(spark)
    monkeypatch.setattr(near_sets, "MEMBERS", 5)
    monkeypatch.setattr(near_sets, "OFTEN", 1000)  # nothing is late, so every text meets by what is common
    texts = copies() | {1000 + k: t for k, t in templates(40, 30, 6).items()} | {2000 + k: t for k, t in templates(40, 40, 9).items()}
    check(near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect(), texts)
    docs = rows_of(spark, list(texts.items()))
    groups = brute_groups(texts)
    assert sorted(r.doc_id for r in without_near_copies(docs, ("doc_id", "lang")).collect()) == sorted(set(groups.values()))


def test_large_groups_of_near_copies_make_few_pairs(spark, monkeypatch):
    """1,000 copies of 150 words with one to five changed, of which some 640 are one group: pairs that the group has brought
    together are not made, and the groups are those of all pairs."""
    prepare(spark)
    made, plain = [], near_sets._meeting
    monkeypatch.setattr(near_sets, "_meeting", lambda met, far: made.append(plain(met, far)) or made[-1])
    rnd, texts = random.Random(5), {}
    for i in range(1000):
        own = [f"w{k}" for k in range(150)]
        for k in rnd.sample(range(150), 1 + i % 5):
            own[k] = f"x{i}y{k}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    check(near_copies(docs).collect(), texts)
    assert sum(p.count() for p in made) < 100 * len(texts)


def test_steps_and_blocks_lose_no_link(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(near_sets, "MEMBERS", 12)
    monkeypatch.setattr(near_sets, "FAR", (2, 6))
    monkeypatch.setattr(near_sets, "OFTEN", 1000)
    texts = copies() | {1000 + k: t for k, t in templates(40, 40, 9).items()}
    check(near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect(), texts)


def test_pairs_are_those_of_different_components():
    rnd = random.Random(7)
    for far in (None, 1, 3):
        rows = [(rnd.randrange(-3, 3), rnd.randrange(5, 12), rep, rnd.randrange(4, 15), rnd.choice([1, 1, 1, 2, 3]), rnd.choice([0, 1, 2])) for rep in range(200)]
        rows = sorted((key, n, rep, most, component, side if key % 2 else 0) for key, n, rep, most, component, side in rows)
        made = pa.table(dict(zip(("key", "n", "rep", "most", "component", "side"), map(np.array, zip(*rows)))))
        pairs = sorted(p for batch in near_sets._pairs(made, far) for p in zip(*(c.to_pylist() for c in batch.columns)))
        met = lambda x, y: x[0] == y[0] and x[4] != y[4] and x[3] >= y[1] and y[3] >= x[1] and 5 * x[1] >= 4 * y[1] and (x[5] == 0 or x[5] != y[5])
        assert pairs == sorted(tuple(sorted((x[2], y[2]))) for i, x in enumerate(rows) for j, y in enumerate(rows) if 0 < j - i <= (far or 200) and met(x, y))


def test_simhash_groups_make_links(spark, monkeypatch):
    """Pages of one line a hundred times and ten words of their own: sets far apart, nearly all of the text the same."""
    prepare(spark)
    line = " ".join(f"line{i}" for i in range(11))
    page = lambda k, times=100: " ".join([line] * times + [f"own{k}x{i}" for i in range(10)])
    other = " ".join(f"o{i}" for i in range(60))
    texts = [(1, page(1)), (2, page(2)), (2, other), (3, page(3)), (4, page(4, 10)), (5, page(1, 90)), (None, page(6)), (7, ""), (8, None)]
    sets = [brute_set(page(k)) for k in (1, 2)]
    assert len(sets[0] & sets[1]) < 0.5 * len(sets[0] | sets[1]) and (brute_print(page(1)) ^ brute_print(page(2))).bit_count() <= 4
    docs = rows_of(spark, texts)
    kept = lambda: sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.simhash(spark, docs, SF).collect())
    assert kept() == [(1, page(1)), (2, other), (4, page(4, 10)), (7, "")]
    monkeypatch.setattr(corpus_pipeline, "near_duplicates", lambda rows, *a, **b: rows.withColumn("component_id", F.col("row")))
    assert len(kept()) == 7  # without the groups by fingerprints the pages 2, 3 and 6 stay
