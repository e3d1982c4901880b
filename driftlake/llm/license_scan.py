"""License scans by a positional rare-token index.

The licence templates are indexed by word: each word's postings are (template, position). The words' document
frequencies are counted over the whole corpus. Of each template the words of highest IDF are looked up in a file, so
many that no alignment with enough of its words can be without one of them (LEAST_COVERAGE; a template of few words may be
looked up by each of them); their postings give alignments by relative
position (place in the file minus place in the template), and each is verified: the template's mandatory key phrases
must stand in the file, and enough of the template's words must stand at their places. So the corpus decides which words
are looked up, but not the labels.

Base labels come from fixed phrases whose words stand consecutively. Null and empty texts have no words, no labels
and score 0; texts are read whole; repeated rows give repeated results; an empty table gives an empty one; further
columns of the input are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm import license_texts as texts
from driftlake.llm.common import map_texts, table
from driftlake.llm.textbytes import byte_class, utf8, window_hashes, word_hashes, word_spans

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case.
LICENSE_WORDS = byte_class(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: Phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...]


#: Whole licences and notices, their beginnings as they are often quoted, and one-line tags.
TEMPLATES = (
    Template("mit", texts.MIT, ("permission is hereby granted", "without restriction")),
    Template("mit", texts.MIT.split(" and to permit")[0], ("permission is hereby granted", "without restriction")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    Template("apache", texts.APACHE, ("apache license", "in compliance with")),
    Template("apache", texts.APACHE.split(" Unless")[0], ("apache license", "in compliance with")),
    Template("apache", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache",)),
    Template("gpl", texts.GPL, ("gnu general public license",)),
    Template("gpl", texts.GPL.split(". ")[0], ("gnu general public license",)),
    Template("gpl", "SPDX-License-Identifier: GPL-3.0", ("spdx license identifier gpl",)),
    Template("lgpl", texts.LGPL, ("gnu lesser general public license",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", texts.AGPL, ("gnu affero general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("bsd", texts.BSD_2, ("redistribution and use in source and binary forms",)),
    Template("bsd", texts.BSD_3, ("redistribution and use in source and binary forms", "neither the name of")),
    Template("bsd", texts.BSD_2.split(" met:")[0] + " met", ("redistribution and use in source and binary forms",)),
    Template("isc", texts.ISC, ("permission to use copy modify", "with or without fee")),
    Template("isc", texts.ISC.split(",\nprovided")[0], ("permission to use copy modify", "with or without fee")),
    Template("zlib", texts.ZLIB, ("origin of this software must not be misrepresented",)),
    Template("mpl", texts.MPL, ("mozilla public license",)),
    Template("mpl", texts.MPL.split(" If")[0], ("mozilla public license",)),
    Template("unlicense", texts.UNLICENSE, ("free and unencumbered software",)),
    Template("unlicense", texts.UNLICENSE.split(". ")[0], ("free and unencumbered software",)),
    Template("cc-by", texts.CC_BY, ("creative commons attribution", "international license")),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by",)),
    Template("cc0", texts.CC0, ("waived all copyright and related",)),
    Template("copyright", "Copyright (c) All rights reserved", ("all rights reserved",)),
)
LEAST_COVERAGE = 0.6
#: Templates of so many words or more are aligned with gaps.
LONG = 20


def _hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), LICENSE_WORDS)
    return word_hashes(data, starts, ends)


def words_of(text: str) -> list[str]:
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), LICENSE_WORDS)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


def templates_from(spark: SparkSession, folder: str) -> tuple[Template, ...]:
    """Templates from text files, each named by its label (mit.txt, gpl-3.txt): a file's first six words must stand."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("name"), "value").collect()  # as many as licences
    labels = [(r["name"].rsplit("/", 1)[-1].rsplit(".", 1)[0], r["value"]) for r in files]
    return tuple(Template(label, text, (" ".join(words_of(text)[:6]),)) for label, text in sorted(labels))


class PositionalIndex:
    """Postings of the templates' words by hash, and their key phrases."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        vocabulary = sorted({w for ws in self.words for w in ws})
        hashes = _hash(vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.vocabulary = hashes[order], [vocabulary[i] for i in order]
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.sequences = [np.array([number[w] for w in ws]) for ws in self.words]
        self.counts = [Counter(ws.tolist()) for ws in self.sequences]
        self.backwards = [{w: np.flatnonzero(ws == w)[::-1].tolist() for w in set(ws.tolist())} for ws in self.sequences]
        self.phrases = [[[number.get(w, -1) for w in words_of(p)] for p in t.key_phrases] for t in templates]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word hash, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at, -1)

    def rarest(self, idf: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The postings of each template's words of highest IDF: all but so many as an alignment must have, and one."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.sequences):
            need = next(m for m in range(1, len(words) + 1) if m / len(words) >= LEAST_COVERAGE)
            for place in np.argsort(-idf[words], kind="stable")[: len(words) - need + 1].tolist():
                out[int(words[place])].append((t, place))
        return dict(out)

    def match(self, own: np.ndarray, places: np.ndarray, rarest: dict[int, list[tuple[int, int]]]) -> dict[str, float]:
        """Labels and coverage for a file with vocabulary words `own` at `places`.

        Each place of a rare word gives a relative position at which a template may begin. Of a short template the words
        must stand at just that distance. A long one may have words put in or left out: the words near that position are
        aligned with it in order, and the longest common sequence counts."""
        at = dict(zip(places.tolist(), own.tolist()))
        shifts: dict[int, set[int]] = defaultdict(set)
        for place, w in at.items():
            for t, k in rarest.get(w, ()):
                shifts[t].add(place - k)
        found: dict[str, float] = {}
        for t, begins in shifts.items():
            words, label = self.sequences[t], self.templates[t].label
            size, slack = len(words), 0 if len(words) < LONG else len(words) // 6 + 4
            last = None
            for shift in sorted(begins):
                if last is not None and shift - last < slack // 2:
                    continue  # the window of the last one holds this alignment too
                last = shift
                if slack:
                    low, high = np.searchsorted(places, [shift - slack, shift + size + slack])
                    coverage = self.aligned(t, own[low:high].tolist()) / size
                else:
                    coverage = sum(at.get(shift + k) == w for k, w in enumerate(words.tolist())) / size
                if coverage < LEAST_COVERAGE or coverage <= found.get(label, 0.0):
                    continue
                window = range(max(0, shift - 8 - slack), shift + size + 8 + slack)
                if all(any(stands(phrase, at, s) for s in window) for phrase in self.phrases[t]):
                    found[label] = coverage
        return found

    def aligned(self, t: int, own: list[int]) -> int:
        """The length of the longest common sequence of a template's words and a file's, 0 if too few can be common."""
        wanted, counts = self.counts[t], Counter(own)
        if sum(min(n, counts[w]) for w, n in wanted.items()) < LEAST_COVERAGE * len(self.sequences[t]):
            return 0
        ends: list[int] = []  # the least template place at which a common sequence of each length ends
        for w in own:
            for k in self.backwards[t].get(w, ()):
                j = bisect_left(ends, k)
                ends[j : j + 1] = [k]
        return len(ends)


def stands(phrase: list[int], at: dict[int, int], begin: int) -> bool:
    """Whether a phrase begins at a place. Of its words in order, two may be put in between those of a phrase of four or
    more, and one may be missing; one may be put in between three; shorter ones stand as they are."""
    slips, missing = (2, 1) if len(phrase) >= 4 else (1, 0) if len(phrase) == 3 else (0, 0)
    if at.get(begin) != phrase[0] and (not missing or at.get(begin) != phrase[1]):
        return False
    place, k = begin, 0
    while k < len(phrase):
        if at.get(place) == phrase[k]:
            place, k = place + 1, k + 1
        elif missing and k + 1 < len(phrase) and (at.get(place) == phrase[k + 1] or at.get(place + 1) == phrase[k + 1]):
            # left out, or another word in its place
            missing, k, place = missing - 1, k + 1, place + (at.get(place) != phrase[k + 1])
        elif missing and k + 1 == len(phrase):
            missing, k = missing - 1, k + 1
        elif slips:
            slips, place = slips - 1, place + 1
        else:
            return False
    return True


def word_frequencies(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(word int, n long): in how many rows of docs each template word stands, by its vocabulary number."""
    index = PositionalIndex(templates)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column(0))
        data = _LOWER[data]
        starts, ends, counts = word_spans(data, offsets, LICENSE_WORDS)
        numbers = index.numbers(word_hashes(data, starts, ends))
        held = np.flatnonzero(numbers >= 0)
        row = np.searchsorted(counts, held, "right") - 1
        pairs = np.unique(row * len(index.vocabulary) + numbers[held])
        n = np.bincount(pairs % len(index.vocabulary), minlength=len(index.vocabulary))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64())], ["word", "n"])

    return map_texts(docs.select(F.col(text_col).alias("text")), work, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    Two passes over docs: the words' document frequencies (as many numbers as the templates have words), then the scan."""
    index = PositionalIndex(templates)
    total = max(1, docs.count())
    counts = np.zeros(len(index.vocabulary))
    for row in word_frequencies(docs, text_col, templates).collect():  # one row a template word at most
        counts[row["word"]] = row["n"]
    idf = np.array([math.log((total + 1) / (n + 0.5)) for n in counts])
    rarest = index.rarest(idf)
    looked_up = np.isin(np.arange(len(index.vocabulary)), list(rarest))
    phrases = [(words_of(p), label) for p, label in BASE_PHRASES.items()]
    sizes = sorted({len(p) for p, _ in phrases})
    phrase_hashes = {n: [(window_hashes(_hash(p), n)[0], p, label) for p, label in phrases if len(p) == n] for n in sizes}
    kind = dict(docs.dtypes)[id_col]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column(1))
        data = _LOWER[data]
        starts, ends, counts = word_spans(data, offsets, LICENSE_WORDS)
        hashes = word_hashes(data, starts, ends)
        base: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for n in sizes:
            windows = window_hashes(hashes, n)
            for h, words, label in phrase_hashes[n]:
                for at in np.flatnonzero(windows == h).tolist():
                    row = int(np.searchsorted(counts, at, "right") - 1)
                    if at + n <= counts[row + 1] and [data[starts[at + k] : ends[at + k]].tobytes().decode() for k in range(n)] == words:
                        base[row].append((at - int(counts[row]), label))
        numbers = index.numbers(hashes)
        held = np.flatnonzero(numbers >= 0)
        cuts = np.searchsorted(held, counts)
        rare = np.concatenate([[0], np.cumsum(looked_up[numbers[held]])])
        rows = []
        for i in range(batch.num_rows):
            a, b, n = int(cuts[i]), int(cuts[i + 1]), int(counts[i + 1] - counts[i])
            found = index.match(numbers[held[a:b]], held[a:b] - counts[i], rarest) if rare[b] - rare[a] >= 1 else {}
            places = sorted(base.get(i, ()))
            own = sorted({label for _, label in places})
            score = max([0.9 if places else 0.0, *found.values()])
            rows.append((n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(own), ",".join(sorted({*own, *found})), score))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, schema).withColumnRenamed("id", id_col)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
