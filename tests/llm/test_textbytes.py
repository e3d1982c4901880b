"""Memory of the views of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from driftlake.llm import textbytes
from driftlake.llm.textbytes import BYTE_CODES, span_hashes, word_hashes, word_spans
from driftlake.llm.toxicity import Classifier


def test_words_are_hashed_by_slices_with_the_same_result(monkeypatch):
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 5000):
        data = rng.integers(30, 60, n).astype(np.uint8)
        data[n // 3 : n // 2] = 97  # a word longer than a slice
        starts, ends, _ = word_spans(data, np.array([0, n]))
        want = span_hashes(BYTE_CODES[data], starts, ends)
        monkeypatch.setattr(textbytes, "SLICE_BYTES", 64)
        assert (word_hashes(data, starts, ends) == want).all()
        monkeypatch.undo()


def test_long_texts_leave_nothing_in_a_worker():
    data = np.full(9 << 20, 97, np.uint8)
    data[::7] = 32
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    span_hashes(BYTE_CODES[data[: 6 << 20]], starts[:10], ends[:10])
    word_hashes(data, starts, ends)
    assert all(len(x) <= (1 << 20) + 4096 for x in textbytes._powers.values())


def test_scores_take_the_memory_of_a_slice():
    texts = pa.record_batch([pa.array([" ".join(f"w{(k * j) % 977}" for j in range(400)) for k in range(4000)])], ["text"])
    model = Classifier(np.arange(128, dtype=np.uint32), np.ones(128), 0.0)
    textbytes._powers.clear()
    tracemalloc.start()
    for part in textbytes.slices(texts):
        model.scores(part.column(0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
