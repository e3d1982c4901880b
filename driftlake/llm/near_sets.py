"""Near copies by the Jaccard similarity of word shingles: an exact join by prefixes of rare shingles.

A text's set holds the 64-bit hashes of its runs of words, A-Z in lower case. Two texts are linked if their sets share at
least LEAST of their union; texts that are linked, directly or through others, form a group.

In any fixed order of all shingles, two linked sets have a shingle in common among the first n - ceil(LEAST * n) + 1 of
each, and at their first common one the shorter rest of the two holds all that they share. Shingles that stand in more than
some thirty texts, as counted in a part of the corpus, come last in that order; which ones they are changes the work, never
the result. So texts that share a template, but too little to be linked, meet by a shingle of the template behind all of
their own, where too little is left: they are no candidates. Of the sets that meet by a shingle neighbours in size are
compared first; where a shingle has more sets than a step of FAR, those that stand no further apart than that, step by step;
then all pairs. Each time only pairs that the links before have not brought together are made, so in a large group of near
copies a set makes pairs until it has found the group, and no more. All pairs of sets that meet and are not linked in the
end are made, whatever their number. Every pair
is compared by its whole sets, unless the parities of their hashes in some classes already differ in more places than linked
sets may differ in shingles. Shingles with more than MEMBERS sets are dealt out as pairs of blocks, in the order of size.

A set counts a shingle once, so two pages that are one line repeated a hundred times but for a few words are far apart.
Such pages have SimHash fingerprints close to each other, which count repeats. If groups by fingerprints are given, each
node's text is also compared with the first of its group by what they share with repeats counted, and linked at LEAST or
more. That comes with the first pairs, so large groups are together before all pairs are made.

Equal sets are one node, named by its first row by id, so a group of copies costs what one document costs. Null texts and
texts without words have the empty set and are linked to each other only; fewer words than a shingle are one shingle;
texts are read whole. Rows are told apart by their place, not by id: rows of one id with different texts are different nodes, and
rows without id link and bridge like others; a group is named by its smallest id, by none if none of its rows has one. An
empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.llm.common import map_texts, with_carried, written
from driftlake.llm.simhash import components
from driftlake.llm.textbytes import WORD_BYTES, span_hashes, sure_word_hashes, utf8, window_hashes, word_spans

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Shingles are counted in one text of PART; those that stand in OFTEN or more of these come late. MOST_LATE bounds the list
#: that goes to the tasks (8 bytes each): where it would be longer, twice OFTEN is asked for, and so on.
PART, OFTEN, MOST_LATE = 8, 4, 1 << 22
#: Classes of hashes whose parities tell sets apart: a power of two, twice a set's size at least, and no fewer than these.
LEAST_CLASSES = 256
#: Sets that meet by a shingle in one task at most, of each of two blocks.
MEMBERS = 4096
#: How far apart in size sets of a shingle are compared after neighbours and before all pairs; changes the work only.
FAR = (32, 512)
#: Text that is hashed at a time.
BLOCK_BYTES = 1 << 20
#: Makes (row, component_id) of (row, text).
Groups = Callable[[DataFrame], DataFrame]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def shingles(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The shingle hashes of each text in their order, repeats included."""
    data, offsets = utf8(texts)
    data = _LOWER[data]
    starts, ends, counts = word_spans(data, offsets, WORD_BYTES)
    words = sure_word_hashes(data, starts, ends)
    windows = window_hashes(words, shingle)
    out = []
    for a, b in zip(counts.tolist(), counts[1:].tolist()):
        short = 0 < b - a < shingle
        out.append(span_hashes(words, np.array([a]), np.array([b])) if short else windows[a : max(a, b - shingle + 1)])
    return out


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    return [np.unique(x) for x in shingles(texts, shingle)]


def prefix(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of a set by which linked sets must meet, frequent ones last."""
    at = np.minimum(np.searchsorted(frequent, own), max(0, len(frequent) - 1))
    late = frequent[at] == own if len(frequent) else np.zeros(len(own), bool)
    return np.concatenate([own[~late], own[late]])[: len(own) + LEAST[0] * len(own) // -LEAST[1] + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * common >= LEAST[0] * (len(a) + len(b) - common)


def late_shingles(counted: DataFrame, most: int = MOST_LATE) -> np.ndarray:
    """The sorted keys of (key long, n long) of the largest counts, no more than `most`."""
    steps = counted.groupBy(F.floor(F.log2(F.col("n") / OFTEN)).alias("step")).agg(F.count("*").alias("n")).collect()
    least = next(k for k in range(64) if sum(r["n"] for r in steps if r["step"] >= k) <= most)
    keys = counted.where(F.col("n") >= OFTEN << least).select("key").toArrow().column("key").to_numpy()
    return np.sort(keys.view(np.uint64))


def parities(own: np.ndarray) -> np.ndarray:
    """For each class of hashes whether a set holds an odd number of them, as 64-bit integers."""
    classes = max(LEAST_CLASSES, 1 << (2 * len(own) - 1).bit_length()) if len(own) else LEAST_CLASSES
    odd = np.bincount((own & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def odd_differences(a: Column, b: Column) -> Column:
    """In how many classes the parities of two sets differ, which is at most in how many members the sets do. The longer
    list is folded to the shorter one's length: classes that agree in their lower bits become one."""
    size = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = lambda x: F.when(F.size(x) == 2 * size, F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), xor)).otherwise(F.slice(x, F.lit(1), size))
    apart = F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    # linked sets are of similar size, so their lists differ by one doubling at most
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * size, apart).otherwise(F.lit(0))


def by_key(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """work on tables that hold all rows of their keys, from batches sorted by key."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        key = held.column("key").to_numpy()
        other = np.flatnonzero(key != key[-1])
        if len(other):
            yield from work(held.slice(0, int(other[-1]) + 1))
            held = held.slice(int(other[-1]) + 1)
    if held is not None and held.num_rows:
        yield from work(held)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, without those that are alone, and with a row's place among those of its key."""
    held, last, count = None, None, 0
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        key = rows.column("key").to_numpy()
        if not len(key):
            continue
        new = np.concatenate([[held is not None or key[0] != last], key[1:] != key[:-1]])
        place = np.arange(len(key))
        begin = np.maximum.accumulate(np.where(new, place, 0))
        place = place - begin + np.where(begin == 0, 0 if new[0] else count, 0)
        shared = (place > 0) | np.concatenate([key[1:] == key[:-1], [False]])
        out = rows.append_column("place", pa.array(place.astype(np.int32))).filter(pa.array(shared))
        yield from out.to_batches()
        # whether the last row is alone is not known yet
        held = rows.slice(len(key) - 1).to_batches()[0] if not shared[-1] else None
        last, count = (None, 0) if held is not None else (key[-1], int(place[-1]) + 1)


def _others(key: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which rows, sorted by key, are not of the most frequent component of their key."""
    order = np.lexsort((component, key))
    k, c = key[order], component[order]
    runs = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
    times = np.diff(np.append(runs, len(k)))
    ranked = np.lexsort((times, k[runs]))
    of = k[runs][ranked]
    frequent = np.zeros(len(runs), bool)
    frequent[ranked[np.append(of[1:] != of[:-1], True)]] = True
    other = np.empty(len(key), bool)
    other[order] = ~np.repeat(frequent, times)
    return other


def _pairs(rows: pa.Table, far: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of a key of different components, whose sizes, and what is left behind the key, allow the similarity; no more
    than `far` places apart if given. side: rows of two blocks (1 and 2) meet across, others (0) among themselves.

    One of each pair is not of its key's most frequent component, so only such rows are gone through."""
    key, rep, n, most, component, side = (rows.column(c).to_numpy() for c in ("key", "rep", "n", "most", "component", "side"))
    other, step = _others(key, component), 1
    down = np.flatnonzero(other)
    up = down[most[down] >= n[down]]
    while len(up) or len(down):
        # sizes ascend within a key
        up = up[up + step < len(key)]
        up = up[(key[up] == key[up + step]) & (LEAST[1] * n[up] >= LEAST[0] * n[up + step]) & (most[up] >= n[up + step])]
        down = down[down >= step]
        down = down[(key[down] == key[down - step]) & (LEAST[1] * n[down - step] >= LEAST[0] * n[down])]
        at = np.concatenate([up, down[~other[down - step]] - step])
        allowed = (most[at] >= n[at + step]) & (most[at + step] >= n[at]) & ((side[at] == 0) | (side[at] != side[at + step]))
        here = at[(component[at] != component[at + step]) & allowed]
        if len(here):
            a, b = rep[here], rep[here + step]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        step += 1
        if far and step > far:
            break


def _block() -> Column:
    """The block of MEMBERS rows of its key that a row is in."""
    return F.floor(F.col("place") / MEMBERS).cast("int")


def _dealt(met: DataFrame) -> DataFrame:
    """met with a side, its keys split into pairs of blocks where they have several: of each pair only the rows that may be
    linked to one of the other block."""
    large = written(met.where(F.col("place") == MEMBERS).select("key"), "large")
    met = met.withColumn("block", _block())
    if large.isEmpty():
        return met.select("key", "rep", "n", "most", "component", F.lit(0).alias("side"))
    blocks = met.join(large, "key", "left_semi").groupBy("key", "block").agg(F.min("n").alias("least"), F.max("most").alias("reach"))
    blocks = blocks.groupBy("key").agg(F.collect_list(F.struct("block", "least", "reach")).alias("blocks"))
    wide = met.join(blocks, "key", "left")
    own, other = F.col("block"), lambda x: x["block"]
    meets = F.filter("blocks", lambda x: (other(x) == own) | ((other(x) < own) & (x["reach"] >= F.col("n"))) | ((other(x) > own) & (F.col("most") >= x["least"])))
    wide = wide.withColumn("other", F.explode(F.coalesce(F.transform(meets, other), F.array(F.lit(0)))))
    side = F.when(own == F.col("other"), 0).when(own < F.col("other"), 1).otherwise(2)
    key = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(own, F.col("other")), F.greatest(own, F.col("other"))))
    return wide.select(key.alias("key"), "rep", "n", "most", "component", side.cast("int").alias("side"))


def _meeting(met: DataFrame, far: int | None) -> DataFrame:
    """(a, b): pairs that meet by a shingle, all or no more than `far` places apart. met: (key, rep, n, most, place, component)."""
    if far is None:
        dealt = _dealt(met)
    else:  # those within a block will do
        key = F.when(F.col("place") < MEMBERS, F.col("key")).otherwise(F.xxhash64("key", _block()))
        dealt = met.select(key.alias("key"), "rep", "n", "most", "component", F.lit(0).alias("side"))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "n", "rep")
    return written(dealt.mapInArrow(lambda batches: by_key(batches, lambda rows: _pairs(rows, far)), "a long, b long").distinct(), "pairs")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the shingles of two texts share at least LEAST of their union, repeats counted."""
    (x, n), (y, m) = (np.unique(own, return_counts=True) for own in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return LEAST[1] * common >= LEAST[0] * (len(a) + len(b) - common)


def _first_pairs(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): each node of groups (row, component_id) with the node of its group that is first by id."""
    named = groups.select(F.col("row").alias("rep"), "component_id").join(nodes.select("rep", "first"), "rep")
    first = named.groupBy("component_id").agg(F.min("first")["row"].alias("to"))
    ends = named.join(first, "component_id").where("rep <> to")
    return ends.select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b"))


def _compared(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b): the linked ones of some pairs (a, b, likely); likely ones are compared with repeats counted as well."""
    left, right = (nodes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab")
    apart = odd_differences(F.col("odd_a"), F.col("odd_b"))
    near = (LEAST[0] + LEAST[1]) * apart <= (LEAST[1] - LEAST[0]) * (F.col("n_a") + F.col("n_b"))
    pairs = pairs.join(left, "a").join(right, "b").where(near | F.col("likely")).groupBy("a", "b").agg(F.max("likely").alias("likely"))
    pairs = written(pairs, "candidates")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                part = batch.slice(k, 16)
                both = zip(part.column(2).to_pylist(), shingles(part.column(3), shingle), shingles(part.column(4), shingle))
                ok = [similar(np.unique(x), np.unique(y)) or likely and alike(x, y) for likely, x, y in both]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # only texts that are to be compared move
    some = texts.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    left, right = some.select(F.col("id").alias("a"), F.col("text").alias("text_a")), some.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "likely", "text_a", "text_b")
    return written(both.mapInArrow(compare, "a long, b long"), "links")


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, id, text, print, n, odd, and the carried columns as _0, _1, ...): every row with a number of its own, the digest
    and size of its set and the parities; written, so that the numbers stay."""

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), shingle)
        made = [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([parities(s) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *made, *batch.columns[2:]], ["id", "text", "print", "n", "odd", *more])

    docs, more, kinds = with_carried(docs, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], carry)
    rows = map_texts(docs, describe, f"id long, text string, print binary, n int, odd array<long>{kinds}", limit=BLOCK_BYTES)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "prints")


def near_nodes(rows: DataFrame, shingle: int = SHINGLE, groups: Groups | None = None) -> DataFrame:
    """(print, component, first): the group of each different set of described rows, and the first of the set's rows as
    (no id, id, row)."""
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    nodes = written(rows.groupBy("print").agg(F.min(first)["row"].alias("rep"), F.min(first).alias("first"), F.min("n").alias("n"), F.min("odd").alias("odd")), "nodes")
    texts = written(rows.select(F.col("row").alias("id"), "text").join(nodes.select(F.col("rep").alias("id")), "id", "left_semi"), "texts")

    def all_shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), shingle)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["key"])

    part = texts.where(F.pmod(F.xxhash64("id"), F.lit(PART)) == 0)
    counted = map_texts(part, all_shingles, "key long", limit=BLOCK_BYTES).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    frequent = late_shingles(written(counted, "counted"))

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), shingle)
        own = [prefix(s, frequent) if len(s) else s for s in sets]
        times = [len(x) for x in own]
        n = np.repeat([len(s) for s in sets], times).astype(np.int64)
        rest = n - np.concatenate([np.arange(t) for t in times])
        most = np.minimum(rest * sum(LEAST) // LEAST[0] - n, (1 << 31) - 1)  # the largest set that may be linked by this shingle
        columns = [np.concatenate(own).view(np.int64), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), times), n.astype(np.int32), most.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "rep", "n", "most"])

    schema = "key long, rep long, n int, most int"
    met = map_texts(texts, keys, schema, limit=BLOCK_BYTES).repartition("key").sortWithinPartitions("key", "n", "rep")
    met = written(met.mapInArrow(_met, f"{schema}, place int"), "met")

    def components_of(links: DataFrame, met: DataFrame) -> DataFrame:
        named = met.join(components(links, "near"), F.col("rep") == F.col("node"), "left")
        return named.select("key", "rep", "n", "most", "place", F.coalesce("component", "rep").alias("component"))

    unlike = lambda pairs: pairs.withColumn("likely", F.lit(False))
    pairs = unlike(_meeting(met.withColumn("component", F.col("rep")), far=1))
    if groups is not None:
        pairs = pairs.union(_first_pairs(groups(texts.select(F.col("id").alias("row"), "text")), nodes).withColumn("likely", F.lit(True)))
    links = _compared(pairs, nodes, texts, shingle)
    for far in FAR:
        crowded = written(met.where(F.col("place") == far).select("key"), "crowded")
        if crowded.isEmpty():
            break
        pairs = _meeting(components_of(links, met.join(crowded, "key", "left_semi")), far=far)
        links = links.union(_compared(unlike(pairs), nodes, texts, shingle))
    links = links.union(_compared(unlike(_meeting(components_of(links, met), far=None)), nodes, texts, shingle))
    found = components(links, "near")
    return nodes.join(found, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("component", "rep").alias("component"), "first")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, groups: Groups | None = None) -> DataFrame:
    """(id, component_id) for every row: the smallest id of the row's group (null where no row of it has one).

    groups: makes (row, component_id) of (row, text), as `simhash.near_duplicates` does, for one row of each set. Rows whose
    shingles, repeats counted, agree with those of the first of their group to LEAST are linked to it as well."""
    rows = described(docs, id_col, text_col, shingle)
    nodes = near_nodes(rows, shingle, groups)
    names = nodes.groupBy("component").agg(F.min("first")["id"].alias("component_id"))
    named = nodes.join(names, "component").select("print", "component_id")
    return rows.join(named, "print").select(F.col("id").alias(id_col), "component_id")


def without_near_copies(docs: DataFrame, carry: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, groups: Groups | None = None) -> DataFrame:
    """The carried columns of one row of each group: that of the smallest id, of equal ids the first row; a row without id
    only stays if its group has no row with one."""
    more = tuple(c for c in carry if c not in (id_col, text_col))
    rows = described(docs, id_col, text_col, shingle, more)
    stay = near_nodes(rows, shingle, groups).groupBy("component").agg(F.min("first")["row"].alias("row")).select("row")
    kept = rows.join(written(stay, "stay"), "row", "left_semi")
    own = {id_col: F.col("id").cast(dict(docs.dtypes)[id_col]), text_col: F.col("text"), **{c: F.col(f"_{k}") for k, c in enumerate(more)}}
    return kept.select(*(own[c].alias(c) for c in carry))
