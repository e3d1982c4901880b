"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (PASSAGE words each, the last one shorter). Every passage of a text is encoded: shares of
the classes that follow one another among its bytes (three at a time, hashed), and how its words look and repeat. A small
network learns from the labels of whole documents: a hidden representation of each passage, a gated attention weight for
it (tanh and sigmoid branches), and the label from the sum of the representations by those weights. So a document whose
first passages are sound and whose later ones are junk can be told by the latter, without any label of passages.

The network is fitted with numpy on a sample bounded in rows (LEARN of each label, those of least hashed id, so the same
on every run) and in bytes (SAMPLE_BYTES of each label; rows beyond are left out, the first too if it is longer). Rows
are weighted so that the labels count as often as they do among all rows that may be learned from. Every text is scored,
whole; a task holds the features of one chunk of passages, and of a document two numbers a passage.

A null or empty text is one passage without words; repeated rows get equal scores; an id that the labels hold more than
once has their mean, 0.5 counting as 1; labels without one of the two values give the share of the other as every score;
an empty table gives an empty one; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import carried, map_texts, table, with_carried
from driftlake.llm.textbytes import BYTE_CODES, mix, powers, utf8, word_spans
from driftlake.llm.toxicity import held_out

#: Rows of each label to learn from at most, and bytes of their texts.
LEARN, SAMPLE_BYTES = 1500, 12 << 20
PASSAGE = 64
#: Bins of byte classes; bytes whose features a task makes at a time.
BINS, CHUNK = 192, 1 << 20
HIDDEN, ATTENTION = 24, 16
#: Words of a passage at which its features count half.
FEW_WORDS = 4
CUTOFF = 0.5


def _classes() -> np.ndarray:
    """Small letters, capitals, digits, white space and bytes of other scripts are a class each; every sign its own."""
    code = np.arange(256)
    for n, members in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), (0x20, 0x09, 0x0C, 0x0B), (0x0A, 0x0D), range(0x80, 0x100))):
        code[list(members)] = 256 + n
    return code


_CLASS = _classes()
_UPPER, _DIGIT, _LINE, _OTHER = 257, 258, 260, 261
_SIGN = (_CLASS < 256) & (np.arange(256) > 0x20)
STYLE = 9
WIDTH = BINS + STYLE


def encoded(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each passage, its features), a chunk of whole passages at a time; a row without words has one passage."""
    data, offsets = utf8(texts)
    starts, ends, counts = word_spans(data, offsets)
    per_row = np.maximum(1, -(-np.diff(counts) // PASSAGE))
    row = np.repeat(np.arange(len(per_row)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    first = counts[row] + nth * PASSAGE  # a passage's first word
    begin = np.where(nth == 0, offsets[row], starts[np.minimum(first, max(0, len(starts) - 1))] if len(starts) else 0)
    words = np.append(first, counts[-1])
    bytes_ = np.append(begin, offsets[-1])
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(bytes_, bytes_[at] + CHUNK, "right")) - 1)
        to = min(to, len(row))
        yield row[at:to], _features(data, bytes_[at : to + 1], starts, ends, words[at : to + 1])
        at = to


def _features(data: np.ndarray, begin: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(begin) - 1
    bins, kinds = np.zeros(n * BINS), np.zeros((n, 5))
    for a in range(int(begin[0]), int(begin[-1]), CHUNK):  # a passage longer than a chunk comes in parts
        b = min(a + CHUNK, int(begin[-1]))
        part = data[a:b]
        of = np.searchsorted(begin, np.arange(a, b), "right") - 1
        c = _CLASS[part].astype(np.uint64)
        three = c.copy()
        three[1:] += c[:-1] * np.uint64(512)
        three[2:] += c[:-2] * np.uint64(512 * 512)
        bins += np.bincount(of * BINS + (mix(three) % np.uint64(BINS)).astype(np.int64), minlength=n * BINS)
        for k, flag in enumerate((c == _UPPER, c == _DIGIT, c == _LINE, c == _OTHER, _SIGN[part])):
            kinds[:, k] += np.bincount(of[flag], minlength=n)
    size = np.maximum(1, np.diff(begin))[:, None]
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :BINS] = np.sqrt(bins.reshape(n, BINS) / size)
    out[:, BINS : BINS + 5] = np.sqrt(kinds / size)
    w0, w1 = int(first[0]), int(first[-1])
    if w1 > w0:
        own = np.repeat(np.arange(n), np.diff(first))
        held = _hashes(data, starts[w0:w1], ends[w0:w1])
        number = np.maximum(1, np.diff(first))
        again = np.zeros(len(held), bool)
        again[1:] = (held[1:] == held[:-1]) & (own[1:] == own[:-1])
        order = np.lexsort((held, own))
        new = np.ones(len(held), bool)
        new[1:] = (np.diff(held[order]) != 0) | (np.diff(own[order]) != 0)
        out[:, BINS + 5] = np.log1p(np.diff(first))
        out[:, BINS + 6] = np.log1p(np.bincount(own, (ends - starts)[w0:w1], n) / number)
        out[:, BINS + 7] = np.bincount(own[again], minlength=n) / number
        out[:, BINS + 8] = np.bincount(own[order][new], minlength=n) / number
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words (equal words have equal ones; a collision only counts as a repeat)."""
    lo, hi = int(starts[0]), int(ends[-1])
    up, down = powers(hi - lo + 1)
    total = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum(BYTE_CODES[data[lo:hi]] * up[: hi - lo], out=total[1:])
    return mix((total[ends - lo] - total[starts - lo]) * down[starts - lo])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """Weights of the network; without any, `bias` alone gives the score."""

    bias: float
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH, np.float32))
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Features by mean and spread; those of a passage of few words, being noisy, are drawn to the mean."""
        words = np.expm1(x[:, BINS + 5 : BINS + 6])
        return (((x - self.mean) * self.scale).clip(-8, 8) * (words / (words + FEW_WORDS))).astype(np.float32)

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each passage: its attention before normalisation, and what its representation adds to the score."""
        w = self.weights
        if not w:
            return np.zeros(len(x)), np.zeros(len(x))
        # not by matrix products of a library, whose rounding depends on a row's place: equal texts get equal scores
        of = lambda a, b: np.einsum("ij,jk->ik", a, b.astype(np.float64))
        h = np.tanh(of(self.standard(x).astype(np.float64), w["W"]) + w["b"])
        gate = np.tanh(of(h, w["V"])) * _sigmoid(of(h, w["U"]))
        return of(gate, w["w"][:, None])[:, 0], of(h, w["c"][:, None])[:, 0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        parts = [(row, *self.passages(x)) for row, x in encoded(texts)]
        if not parts:
            return np.zeros(0)
        row, attention, value = (np.concatenate(x) for x in zip(*parts))
        begin = np.searchsorted(row, np.arange(len(texts)))
        a = np.exp(attention - np.maximum.reduceat(attention, begin)[row])
        return _sigmoid(np.add.reduceat(a * value, begin) / np.add.reduceat(a, begin) + self.bias)


def fit(bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> AttentionModel:
    """The network that minimises the weighted logistic loss over bags of passages, by Adam with decoupled weight decay."""
    prior = float(np.clip(np.average(label, weights=weight), 0.001, 0.999))
    model = AttentionModel(float(np.log(prior / (1 - prior))))
    if not bags or label.min() == label.max():
        return model
    every = np.concatenate(bags)
    model.mean = every.mean(0)
    model.scale = 1 / (every.std(0) + 0.02)
    size = np.array([len(b) for b in bags])
    begin = np.cumsum(size) - size
    x_all = model.standard(every)
    rng = np.random.default_rng(seed)
    draw = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
    p = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.full(1, model.bias, np.float32)}
    first, second, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            bag = np.repeat(np.arange(len(own)), size[own])
            x = x_all[np.repeat(begin[own], size[own]) + np.arange(len(bag)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])]
            h = np.tanh(x @ p["W"] + p["b"])
            v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
            e = (v * u) @ p["w"]
            heads = np.searchsorted(bag, np.arange(len(own)))
            a = np.exp(e - np.maximum.reduceat(e, heads)[bag])
            a /= np.add.reduceat(a, heads)[bag]
            z = np.add.reduceat(a[:, None] * h, heads)
            error = (_sigmoid(z @ p["c"] + p["d"]) - label[own]) * weight[own] / weight[own].sum()
            dz = error[:, None] * p["c"]
            from_h = dz[bag]
            da = (from_h * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, heads)[bag])
            dg = de[:, None] * p["w"]
            dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
            dh = (a[:, None] * from_h + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
            g = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": z.T @ error, "d": error.sum(keepdims=True)}
            t += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                move = (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                p[k] = (p[k] - step * (move + (decay * p[k] if k not in "bd" else 0))).astype(np.float32)
    model.bias = float(p.pop("d")[0])
    model.weights = p
    return model


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LEARN, sample_bytes: int = SAMPLE_BYTES) -> AttentionModel:
    """Learns from at most `most` texts of each label, all of rows where may_learn."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    known = labels.where(may_learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 1) / (total + 2)
    if len(counts) < 2:
        return AttentionModel(float(np.log(prior / (1 - prior))))
    sizes = docs.where(may_learn & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
    # at most 2 * `most` ids, so they are broadcast; of an id that many rows share one text is taken below
    wanted = F.broadcast(pick(0).union(pick(1)))
    found = sizes.join(wanted, "id").groupBy("id", "y").agg(F.min("bytes").alias("bytes")).toArrow().to_pandas()
    found = found.iloc[np.lexsort((found["id"], found["bytes"]))]
    found = found[found.groupby("y")["bytes"].cumsum() <= sample_bytes]
    if found["y"].nunique() < 2:
        return AttentionModel(float(np.log(prior / (1 - prior))))
    chosen = spark.createDataFrame(list(zip(found["id"].tolist(), found["y"].tolist())), f"id {kind}, y int")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, cells = [], []
        for row, x in encoded(batch.column(1)):
            rows.append(row)
            cells.append(x.astype(np.float16))
        row, x = np.concatenate(rows), np.concatenate(cells)
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["y", "passages"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min_by("text", F.struct(F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text"))).alias("text")).select("y", "text")
    held = map_texts(texts, work, "y int, passages binary").toArrow().to_pylist()
    held.sort(key=lambda r: (r["y"], len(r["passages"]), r["passages"]))  # the same order on every run
    label = np.array([r["y"] for r in held], np.float32)
    bags = [np.frombuffer(r["passages"], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in held]
    mine = np.bincount(label.astype(int), minlength=2)
    weight = np.array([counts[y] / total / mine[y] for y in label.astype(int)], np.float32)
    return fit(bags, label, weight / weight.mean())


def scored(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score) for every row of docs: 0 to 1, higher the likelier good; with carry, these columns of docs."""
    kind = dict(docs.dtypes)[id_col]
    docs, more, kinds = with_carried(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], carry)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1))), *batch.columns[2:]], ["id", "score", *more])

    return carried(map_texts(docs, work, f"id {kind}, score double{kinds}", limit=CHUNK).withColumnRenamed("id", id_col), carry)


def op12_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    found = scored(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
