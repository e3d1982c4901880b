"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words learns from texts confirmed as toxic and from texts without any label. The risk of
taking an unlabelled text for clean is corrected by the class prior: the toxic part of the unlabelled texts is
estimated from the positive ones and taken off, and when that would make the clean part's risk negative - which only an
overfitted classifier reaches - the step goes the other way (the non-negative estimator).

The prior is counted over all labelled rows that may be learned from. The texts to learn from are two samples, bounded in
rows (POSITIVES, UNLABELLED; the rows of least hashed id, so the same on every run) and in bytes (SAMPLE_BYTES each; rows
beyond it are left out, the first too if it is longer); every text is scored, whole.

A null or empty text is scored by the bias alone; repeated rows get equal scores; tables without positive labels give
the prior as every score; an empty table gives an empty one; further columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import carried, map_texts, table, with_carried
from driftlake.llm.textbytes import BYTE_CODES, byte_class, mix, powers, utf8, word_spans

#: Rows to learn from at most.
POSITIVES, UNLABELLED = 2000, 6000
#: Bytes of text of each sample at most; of a text that occurs under one id more than once, one row is learned from.
SAMPLE_BYTES = 24 << 20
#: Bytes of the beginnings of words that count as words of their own.
BEGINNINGS = (5, 6, 7, 8)
FEATURES = 128
LEAST_TEXTS = 3
CUTOFF = 0.7
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LETTERS = byte_class(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))


#: Weight decay of the learner.
DECAY = 3e-4


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each row's words, lower-cased and without punctuation, and of their beginnings; the row of each.

    Beginnings of a few bytes stand for all forms of a stem."""
    data, offsets = utf8(texts)
    data = _LOWER[data]
    starts, ends, counts = word_spans(data, offsets, _LETTERS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(BYTE_CODES[data], up[: len(data)], out=total[1:])
    np.cumsum(total, out=total)
    hashes, rows = [(mix((total[ends] - total[starts]) * down[starts]) >> np.uint64(32)).astype(np.uint32)], [row]
    for n in BEGINNINGS:
        own = np.flatnonzero(ends - starts > n)
        hashes.append((mix((total[starts[own] + n] - total[starts[own]]) * down[starts[own]] + np.uint64(n)) >> np.uint64(32)).astype(np.uint32))
        rows.append(row[own])
    return np.concatenate(hashes), np.concatenate(rows)


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, times) of each different hash of a row, in the order of rows."""
    pair, n = np.unique(rows.astype(np.uint64) << np.uint64(32) | hashes, return_counts=True)
    return (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32), (pair >> np.uint64(32)).astype(np.int64), n


@dataclass
class Classifier:
    """Hashes of the words that count, sorted, their weights and a bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        hashes, rows = words_in(texts)
        totals = np.bincount(rows, minlength=len(texts))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            held = self.words[at] == hashes
            hashes, rows = hashes[held], rows[held]
        return self.probability(*self.features(*counted(hashes, rows), totals), len(texts))

    def features(self, hashes: np.ndarray, rows: np.ndarray, times: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of the words that count: the logarithm of one more than their number in a thousand of
        the row's words, so that a word that a long text holds by chance weighs little."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        held = np.flatnonzero(self.words[at] == hashes)
        return rows[held], at[held], np.log1p(1000.0 * times[held] / totals[rows[held]])

    def probability(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, value * self.weights[feature], minlength=rows))))


def informative_words(positive: np.ndarray, unlabelled: np.ndarray, rows: tuple[int, int], features: int) -> np.ndarray:
    """Of the hashes of each sample (each once a text) those whose share of texts differs most, in standard errors."""
    own, n = np.unique(positive, return_counts=True)
    own, n = own[n >= LEAST_TEXTS], n[n >= LEAST_TEXTS]
    all_, m = np.unique(unlabelled, return_counts=True)
    at = np.minimum(np.searchsorted(all_, own), max(0, len(all_) - 1))
    among = np.where(all_[at] == own, m[at], 0) if len(all_) else np.zeros(len(own))
    p, u = n / rows[0], (among + 1) / (rows[1] + 1)
    z = (p - u) / np.sqrt(u * (1 - np.minimum(u, 0.99)) * (1 / rows[0] + 1 / rows[1]))
    best = np.argsort(-z, kind="stable")[:features]
    return np.sort(own[best[(z[best] > 5) & (p[best] > 3 * u[best])]])


def nnpu(positive: tuple, unlabelled: tuple, rows: tuple[int, int], features: int, prior: float, steps: int = 600, rate: float = 0.05, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam over whole samples."""
    w, b = np.zeros(features), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(features + 1), np.zeros(features + 1)

    def margin(x: tuple, n: int) -> np.ndarray:
        return b + np.bincount(x[0], x[2] * w[x[1]], minlength=n)

    def pull(x: tuple, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(x[1], x[2] * g[x[0]], minlength=features), [g.sum()]])

    for t in range(1, steps + 1):
        p, u = margin(positive, rows[0]), margin(unlabelled, rows[1])
        toxic_p, toxic_u = 1 / (1 + np.exp(-p)), 1 / (1 + np.exp(-u))
        clean_risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        as_positive = pull(positive, prior * (toxic_p - 1) / rows[0])
        as_clean = pull(unlabelled, toxic_u / rows[1]) - pull(positive, prior * toxic_p / rows[0])
        gradient = as_positive + as_clean if clean_risk >= 0 else -as_clean
        gradient[:-1] += decay * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        change = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        w, b = w - change[:-1], b - change[-1]
    return w, b


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, sample_bytes: int = SAMPLE_BYTES) -> Classifier:
    """Learns from at most `positives` texts of label 1 and `unlabelled` further texts, all of rows where may_learn."""
    known = labels.where(may_learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col(label_col) == 1).cast("long")), F.lit(0))).first()
    prior = min(0.9, max(0.001, (toxic + 1) / (n + 2)))
    kind = dict(docs.dtypes)[id_col]
    spark = docs.sparkSession
    if not toxic:
        return Classifier(np.zeros(0, np.uint32), np.zeros(0), float(np.log(prior / (1 - prior))))
    may = docs.where(may_learn & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    confirmed = known.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id")).limit(positives)
    first = lambda rows, most, flag: rows.orderBy(F.xxhash64("id"), "bytes").limit(most).select("id", "bytes", F.lit(flag).alias("toxic"))
    # the samples' ids and sizes: `positives` + `unlabelled` rows at most
    found = first(may.join(F.broadcast(confirmed), "id"), positives, 1).union(first(may, unlabelled, 0)).toArrow().to_pandas()
    found["total"] = found.groupby("toxic")["bytes"].cumsum()
    found = found[found["total"] <= sample_bytes].drop_duplicates(["id", "toxic"])
    chosen = spark.createDataFrame(list(zip(found["id"].tolist(), found["toxic"].tolist())), f"id {kind}, toxic int")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, row, times = counted(*words_in(batch.column(1)))
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        cells = [(hashes[a:b].tobytes(), times[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in cells], pa.binary()), pa.array([c for _, c in cells], pa.binary())], ["toxic", "words", "times"])

    # the samples' ids are broadcast: their number is bounded; an id that many rows share gives one of them
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.octet_length("text"), F.xxhash64("text"))).alias("text")).select("toxic", "text")
    held = map_texts(texts, work, "toxic int, words binary, times binary").toArrow()
    sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    flags, rows = held.column("toxic").to_numpy(), ()
    for toxic_ in (1, 0):
        own = held.filter(pa.array(flags == toxic_))
        cells = sorted(zip(own.column("words").to_pylist(), own.column("times").to_pylist()), key=lambda c: (len(c[0]), *c))  # the same order on every run
        row = np.repeat(np.arange(len(cells)), [len(w) // 4 for w, _ in cells])
        times = np.frombuffer(b"".join(t for _, t in cells), "<u4")
        sample[toxic_] = np.frombuffer(b"".join(w for w, _ in cells), np.uint32), row, times, np.bincount(row, times, minlength=len(cells))
        rows += (len(cells),)
    model = Classifier(np.zeros(0, np.uint32), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not rows[0] or not rows[1]:
        return model
    model.words = informative_words(sample[1][0], sample[0][0], rows, FEATURES)
    if len(model.words):
        model.weights, model.bias = nnpu(model.features(*sample[1]), model.features(*sample[0]), rows, len(model.words), prior)
    return model


def scored(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score) for every row of docs: 0 to 1, higher the likelier toxic; with carry, these columns of docs."""
    kind = dict(docs.dtypes)[id_col]
    docs, more, kinds = with_carried(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], carry)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1))), *batch.columns[2:]], ["id", "score", *more])

    return carried(map_texts(docs, work, f"id {kind}, score double{kinds}").withColumnRenamed("id", id_col), carry)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    found = scored(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
