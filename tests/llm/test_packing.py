import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import zlib
from tokenizers import Tokenizer

from driftlake.llm.common import prepare, table
from driftlake.llm.packing import END_ID, op10_packing, pack, packing_plan, tokenizer_of

PATH = str(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("capacity", [64, 1024])
@pytest.mark.parametrize("kind", ["uniform", "middle", "one", "halves", "none"])
def test_plan_places_each_piece_once(capacity, kind):
    rnd = random.Random(7)
    lengths = {
        "uniform": [rnd.randint(1, capacity) for _ in range(500)], "middle": [rnd.randint(capacity // 3, 2 * capacity // 3) for _ in range(300)],
        "one": [5] * 33, "halves": [capacity // 2] * 7 + [capacity // 2 + 1] * 3, "none": [],
    }[kind]
    got, bins = Counter(), 0
    for n, own in packing_plan(dict(Counter(lengths)), capacity, 16):
        assert sum(own) <= capacity and n > 0
        bins += n
        for k in own:
            got[k] += n
    assert got == Counter(lengths)
    # never worse than best fit in descending order by more than one in a hundred
    rooms: list[int] = []
    for k in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= k]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= k
        else:
            rooms.append(capacity - k)
    assert bins <= len(rooms) * 1.01 + 1


def test_same_ids_as_the_tokenizers_library():
    rnd = random.Random(1)
    odd = [0x20, 0x3000, 0xA0, 0x85, 0x1C, 0x0A]
    texts = ["".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), rnd.randint(0x20, 0x7E), rnd.choice(odd), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(120)) for _ in range(300)]
    theirs = Tokenizer.from_file(PATH)
    own = tokenizer_of(PATH, P.PATTERN)
    for t in [*texts, "<|endoftext|> x", "a" * 3000]:
        assert own.encode(t, allowed_special="all") == theirs.encode(t, add_special_tokens=False).ids


def check(rows, texts):
    theirs = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = [*theirs.encode(texts[doc] or "", add_special_tokens=False).ids, END_ID]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        assert sum(r.length for r in own) == len(ids)
        at = 0
        for r in own:
            assert r.start == at and (r.length == 1024 or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(op10_packing(spark, "/root/testdata/sf0.001").collect(), {r.doc_id: r.text for r in docs.collect()})


def test_odd_rows(spark, odd_docs):
    prepare(spark)
    check(pack(odd_docs, PATH, P.PATTERN).collect(), {r.doc_id: r.text for r in odd_docs.collect()})
    assert pack(odd_docs.where("false"), PATH, P.PATTERN).count() == 0


def test_the_file_is_a_byte_level_one():
    with open(PATH) as f:
        assert json.load(f)["model"]["type"] == "BPE"
