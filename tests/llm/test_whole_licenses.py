"""Files of many notices, and changed copies."""

import random

from driftlake.llm import license_scan, license_texts
from driftlake.llm.common import prepare


def test_labels_do_not_depend_on_the_file_s_other_notices_or_the_corpus(spark):
    prepare(spark)
    labels = {t.label for t in license_scan.TEMPLATES}
    every = " ; ".join(f"some words before {t.text} and after" for t in license_scan.TEMPLATES)
    mit = license_scan.TEMPLATES[0].text + " Copyright (c) All rights reserved"
    common = [(100 + i, "Copyright (c) All rights reserved copyright rights reserved") for i in range(60)]
    rows = license_scan.license_scan(spark.createDataFrame([(1, every), (2, mit), (3, every * 40), *common], "doc_id long, text string")).collect()
    got = {r.doc_id: set(r.labels.split(",")) for r in rows}
    assert got[1] == got[3] == labels and got[2] == {"mit", "copyright"}
    assert all(got[i] == {"copyright"} for i, _ in common)


def changed(words, rate, rnd):
    """A copy with some words replaced, left out or put in, a different word each time."""
    out = []
    for w in words:
        x = rnd.random()
        if x < rate / 3:
            out.append(f"other{rnd.randrange(10**6)}")
        elif x < 2 * rate / 3:
            pass
        elif x < rate:
            out += [w, f"more{rnd.randrange(10**6)}"]
        else:
            out.append(w)
    return " ".join(out)


def test_recall_on_changed_copies(spark):
    """Copies with a twentieth of their words replaced, but for the mandatory phrases, are found; copies with a hundredth of
    any words replaced, left out or put in (which shifts what is behind them) mostly; reordered words have no label."""
    prepare(spark)
    rnd = random.Random(5)
    whole = {"mit": license_texts.MIT, "apache": license_texts.APACHE, "gpl": license_texts.GPL, "bsd": license_texts.BSD_3, "isc": license_texts.ISC, "zlib": license_texts.ZLIB, "unlicense": license_texts.UNLICENSE}
    rows, want = [], {}
    for k in range(140):
        label = rnd.choice(list(whole))
        words = whole[label].split()
        if k % 2:
            kept = {w for t in license_scan.TEMPLATES if t.label == label for p in t.key_phrases for w in p.split()}
            text = " ".join(w if rnd.random() > 0.05 or license_scan.words_of(w)[:1] == [] or license_scan.words_of(w)[0] in kept else f"other{k}" for w in words)
        else:
            text = changed(words, 0.01, rnd)
        want[k] = label
        rows.append((k, f"begin {text} end"))
    for k in range(200, 240):
        words = rnd.choice(list(whole.values())).split()
        rnd.shuffle(words)
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    replaced, shifted = ([want[k] in got[k] for k in range(a, 140, 2)] for a in (1, 0))
    assert sum(replaced) >= 0.95 * len(replaced) and sum(shifted) >= 0.8 * len(shifted)
    assert all(set(got[k]) <= {"", "copyright"} for k in range(200, 240))


def test_templates_from_files(spark, tmp_path):
    prepare(spark)
    (tmp_path / "own-1.txt").write_text("You may do with this program whatever seems right to you, but tell us about it")
    own = license_scan.templates_from(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "x " + own[0].text), (2, "you may")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.license_scan(docs, templates=own).collect()} == {1: "own-1", 2: ""}


def edited(words, kind, rate, rnd):
    out = []
    for w in words:
        hit = rnd.random() < rate
        out += [] if hit and kind == "left out" else [f"other{rnd.randrange(10**6)}"] if hit and kind == "replaced" else [w, f"more{rnd.randrange(10**6)}"] if hit else [w]
    return " ".join(out)


def test_recall_of_each_long_template(spark):
    """Two hundredths of any words put in, left out or replaced, and lines with a word before them: nine in ten are found,
    of each template of 20 words or more."""
    prepare(spark)
    rnd, rows, want = random.Random(11), [], {}
    long = [t for t in license_scan.TEMPLATES if len(license_scan.words_of(t.text)) >= 20]
    for t in long:
        words = t.text.split()
        for kind in ("put in", "left out", "replaced", "prefixed"):
            for _ in range(30):
                lines = [" ".join(words[a : a + 10]) for a in range(0, len(words), 10)]
                text = "dnl " + "\ndnl ".join(lines) if kind == "prefixed" else edited(words, kind, 0.02, rnd)
                want[len(rows)] = (t.label, words_in_phrase(t), kind)
                rows.append((len(rows), f"begin here {text} and end"))
    got = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {}
    for k, own in want.items():
        found.setdefault(own, []).append(own[0] in got[k])
    short = {own: sum(f) / len(f) for own, f in found.items() if sum(f) < 0.9 * len(f)}
    assert not {own: share for own, share in short.items() if own[2] != "prefixed" or share < 0.9} and len(found) > 40, short


def words_in_phrase(template):
    return " / ".join(template.key_phrases)


def test_phrases_may_slip():
    phrase = [1, 2, 3, 4]
    at = lambda *words: dict(enumerate(words))
    assert all(license_scan.stands(phrase, at(*w), 0) for w in ((1, 2, 3, 4), (1, 9, 2, 3, 4), (1, 2, 9, 9, 3, 4), (1, 3, 4), (1, 2, 9, 4), (1, 2, 3)))
    assert not any(license_scan.stands(phrase, at(*w), 0) for w in ((1, 2), (1, 9, 9, 9, 2, 3, 4), (4, 3, 2, 1), (1, 4), ()))
    assert license_scan.stands([1, 2], at(1, 2), 0) and not license_scan.stands([1, 2], at(1, 9, 2), 0)
