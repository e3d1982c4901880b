"""Substring deduplication by prefix-partitioned suffix trees.

A window of `window` consecutive words repeats if the suffixes that start at two places have a common ancestor at least
that deep in the suffix tree of the corpus; nothing deeper matters, so suffixes are cut off at that depth. What Spark
does:

1. Documents are dealt out in buckets of a few megabytes. In each window one place is marked, its anchor: where the
   shorter run of `window // 2` words with the least hash begins (the leftmost). Equal windows have it at the same place,
   so only windows whose anchor's run stands at other places too can repeat. Buckets send their anchors to parts by the
   anchors' hashes and are told which ones do.
2. A part knows how often each of its anchors stands in the corpus. It shares the anchors' suffixes out among groups by
   their prefixes (the anchors' runs), so many prefixes to a group as fit in memory; a prefix that is too frequent for
   one group is extended to the whole window and split further (the variable-length prefixes).
3. A bucket sends the stretches of words around its repeated anchors to their groups, each different stretch once. A
   group builds the tree of its suffixes: ranks of runs of 1, then 4, 12, ... words give their lexicographic order, and
   suffixes of equal rank at the full depth are the leaves below one deep internal node. All but the first leaf of such
   a node are marked. Words are compared letter by letter, not by hashes.
4. Groups of a prefix that is too frequent are built in shards of buckets first; each shard passes on the first leaf of
   each node, so a passage in very many documents costs one leaf a shard.
5. A bucket gets one bit back for each suffix it sent, takes all marked windows - repeated stretches within the bucket
   included - and removes the words that they cover, joining overlapping windows to maximal repeats.

No step holds more than a bucket, a part or a group. A bucket sends a row to a part or group only if it has something for
it, so there are never more rows than anchors.

Null and empty texts have no words and stay empty; documents shorter than a window lose nothing; a text is read whole
(its bucket's task needs some thirty bytes a byte of it); rows without id come last; rows of equal id, and rows without
id, are separate documents in the order of a hash of their texts; an empty table gives an empty one; further columns of
the input are not read. Rows that agree in both id and text are the only ones bound to meet in one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import carried, table, with_carried
from driftlake.llm.textbytes import WORD_BYTES, mix, powers, utf8, word_hashes, word_spans

WINDOW = 20
BUCKET_BYTES, MOST_BUCKET_BYTES, BUCKETS = 4 << 20, 16 << 20, 8192
#: Stretches in a group and anchors in a part, about.
GROUP_STRETCHES = 1 << 17
PART_ANCHORS = 1 << 20
_LAST_ID = np.iinfo(np.int64).max


def windows_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, from one running sum; runs may cross documents."""
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: max(0, len(total) - size)] + np.uint64(size))


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def ranks_at(codes: np.ndarray, depth: int) -> np.ndarray:
    """The lexicographic rank of the run of `depth` codes at each place, equal runs having equal ranks; runs that pass the
    end have ranks of no meaning. Ranks of short runs are combined to those of longer ones, as many at a time as a 64-bit
    integer holds."""
    rank, have = codes.astype(np.int64), 1
    while have < depth:
        base = int(rank.max(initial=0)) + 1
        parts = 2
        while base ** (parts + 1) < 1 << 63 and have * parts < depth:
            parts += 1
        reach = min(depth, have * parts)
        key = np.zeros(len(rank), np.int64)
        for k in range(parts):
            at = min(k * have, reach - have)
            key *= base
            key[: len(rank) - at] += rank[at:]
        rank, have = np.unique(key, return_inverse=True)[1].ravel(), reach
    return rank


@dataclass
class Stretches:
    """What a bucket may have to send: words around anchors, each the words of some consecutive windows.

    first, size: their first windows (places of words) and numbers of windows; anchor: hashes of their anchors' runs."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    first: np.ndarray
    size: np.ndarray
    anchor: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, window: int) -> Stretches:
        starts, ends, counts = word_spans(data, offsets)
        words = np.empty(len(starts), np.uint64)
        # hashed by parts of the bytes, so that a long text needs no more memory than its words
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + BUCKET_BYTES, "right")))
            words[at:to] = word_hashes(data[starts[at] : ends[to - 1]], starts[at:to] - starts[at], ends[at:to] - starts[at])
            at = to
        room = np.maximum(np.diff(counts) - window + 1, 0)
        start = np.repeat(counts[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
        none = np.zeros(0, np.int64)
        if not len(start):
            return cls(data, starts, ends, counts, words, none, none, np.zeros(0, np.uint64))
        half = max(1, window // 2)
        runs = windows_of(words, half)
        least = sliding_least(runs, window - half + 1)[start]
        place = start.copy()
        for k in range(window - half, -1, -1):
            here = runs[start + k] == least
            place[here] = start[here] + k
        head = np.ones(len(start), bool)
        head[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(head)
        return cls(data, starts, ends, counts, words, start[heads], np.diff([*heads, len(start)]), least[heads])

    def document(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.counts, start, "right") - 1

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each begins."""
        sizes = self.ends - self.starts
        begin = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes + 1, out=begin[1:])
        out = np.full(begin[-1], 32, np.uint8)
        out[np.arange(begin[-1] - len(sizes)) + np.repeat(np.arange(len(sizes)), sizes)] = self.data[WORD_BYTES[self.data]]
        return out.tobytes(), begin


def _whole(docs: pa.Table) -> pa.Table:
    """A bucket's documents in their order."""
    ids, order = docs.column("id").combine_chunks().fill_null(_LAST_ID).to_numpy(), docs.column("order").to_numpy()
    missing = docs.column("id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    places = np.lexsort((order, ids, missing))
    ties = (ids[places][1:] == ids[places][:-1]) & (order[places][1:] == order[places][:-1])
    if ties.any():
        texts = docs.column("text").to_pylist()
        places = np.array(sorted(range(len(texts)), key=lambda i: (missing[i], ids[i], order[i], texts[i] or "")))
    return docs.take(pa.array(places))


def _joined(cells: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
ANCHOR_ROWS = "part int, bucket int, hashes binary, times binary"
#: What a part tells a bucket: repeated anchors, their groups (negative: so many groups share it) and numbers of shards.
REPEATED_ROWS = "bucket int, hashes binary, groups binary, shards binary"
SUFFIX_ROWS = "key long, up long, bucket int, stretches binary, ids binary, orders binary, documents binary, places binary"
#: Marks for a bucket (bits, places), or leaves that a shard passes on to the group `to`.
LEAF_ROWS = "to long, key long, bucket int, bits binary, stretches binary, ids binary, orders binary, documents binary, places binary"


def _rows(rows: list[tuple], ddl: str) -> pa.Table:
    schema = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in ddl.split(", ")])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def anchors_of(docs: pa.Table, window: int, parts: int) -> pa.Table:
    """A bucket's different anchors by parts, and how often each stands in it (as a power of two, rounded up)."""
    own = Stretches.of(*utf8(docs.column("text")), window)
    if not len(own.first):
        return _rows([], ANCHOR_ROWS)
    hashes, n = np.unique(own.anchor, return_counts=True)
    times = np.ceil(np.log2(n)).astype(np.uint8)
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bucket = docs.column("bucket")[0].as_py()
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return _rows([(int(part[p[0]]), bucket, hashes[p].tobytes(), times[p].tobytes()) for p in np.split(order, cuts)], ANCHOR_ROWS)


def repeated_anchors(rows: pa.Table, most: int) -> pa.Table:
    """Of a part's anchors those that stand at two places or more, for each bucket that has them, with their groups."""
    cells, buckets = rows.column("hashes").to_pylist(), np.array(rows.column("bucket").to_pylist())
    hashes, n = _joined(cells, np.uint64), np.exp2(_joined(rows.column("times").to_pylist(), np.uint8)).astype(np.int64)
    bucket = np.repeat(buckets, [len(c) // 8 for c in cells])
    _, which = np.unique(hashes, return_inverse=True)
    total = np.bincount(which, n).astype(np.int64)
    part = rows.column("part")[0].as_py()
    # prefixes fill one group after the other; those that are too frequent get groups and shards of their own
    cold = total <= most
    group = (part << 32) + np.cumsum(np.where(cold & (total > 1), total, 0)) // most
    group, shards = np.where(cold, group, -(-total // most)), np.where(cold, 1, -(-total // most))
    group = np.where(cold, group, -group)
    keep = np.flatnonzero(total[which] > 1)
    keep = keep[np.argsort(bucket[keep], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[keep])) + 1
    return _rows([(int(bucket[p[0]]), hashes[p].tobytes(), group[which[p]].tobytes(), shards[which[p]].tobytes()) for p in np.split(keep, cuts) if len(p)], REPEATED_ROWS)


class Bucket:
    """The stretches of a bucket whose windows may repeat, and which of them go to which groups."""

    def __init__(self, docs: pa.Table, repeated: pa.Table, window: int):
        self.docs, self.window = _whole(docs), window
        self.number = docs.column("bucket")[0].as_py()
        self.own = own = Stretches.of(*utf8(self.docs.column("text")), window)
        hashes, group, shards = (_joined(repeated.column(c).to_pylist(), k) for c, k in (("hashes", np.uint64), ("groups", np.int64), ("shards", np.int64)))
        order = np.argsort(hashes)
        hashes, group, shards = hashes[order], group[order], shards[order]
        at = np.minimum(np.searchsorted(hashes, own.anchor), max(0, len(hashes) - 1))
        held = np.flatnonzero(hashes[at] == own.anchor) if len(hashes) else np.zeros(0, np.int64)
        first, size, group, shards, anchor = own.first[held], own.size[held], group[at[held]], shards[at[held]], own.anchor[held]
        # of an anchor that is too frequent each window goes its own way, by its whole hash
        times = np.where(group < 0, size, 1)
        again = np.repeat(np.arange(len(first)), times)
        within = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        hot = group[again] < 0
        self.first, self.size = first[again] + np.where(hot, within, 0), np.where(hot, 1, size[again])
        self.key, self.up = group[again], np.zeros(len(again), np.int64)
        if hot.any():
            whole = windows_of(own.words, window)[self.first[hot]]
            split = mix(anchor[again][hot] ^ mix(whole % (-group[again][hot]).astype(np.uint64)))
            shard = np.uint64(self.number) % shards[again][hot].astype(np.uint64)
            self.up[hot] = split.view(np.int64)
            self.key[hot] = mix(split + shard + np.uint64(1)).view(np.int64)
        self.raw, self.begin = own.joined() if len(self.first) else (b"", np.zeros(1, np.int64))
        # each different stretch once: a later equal one repeats in all its windows
        seen: dict[bytes, None] = {}
        new = np.zeros(len(self.first), bool)
        lows, highs = self.begin[self.first].tolist(), self.begin[self.first + self.size + window - 1].tolist()
        for i, (a, b) in enumerate(zip(lows, highs)):
            cell = self.raw[a:b]
            if cell not in seen:
                seen[cell] = None
                new[i] = True
        self.new = new
        sent = np.flatnonzero(new)
        self.sent = sent[np.argsort(self.key[sent], kind="stable")]
        self.lows, self.highs = lows, highs

    def groups(self) -> Iterator[np.ndarray]:
        """The stretches that go to each group, in the order of their places."""
        if len(self.sent):
            yield from np.split(self.sent, np.flatnonzero(np.diff(self.key[self.sent])) + 1)


def suffixes_of(docs: pa.Table, repeated: pa.Table, window: int) -> pa.Table:
    """A bucket's different stretches by groups."""
    if not docs.num_rows or not repeated.num_rows:
        return _rows([], SUFFIX_ROWS)
    bucket, rows = Bucket(docs, repeated, window), []
    ids, orders = bucket.docs.column("id").combine_chunks().fill_null(_LAST_ID).to_numpy(), bucket.docs.column("order").to_numpy()
    for own in bucket.groups():
        there, index = np.unique(bucket.own.document(bucket.first[own]), return_inverse=True)
        text = b"\n".join([bucket.raw[bucket.lows[i] : bucket.highs[i]] for i in own.tolist()]) + b"\n"
        rows.append((int(bucket.key[own[0]]), int(bucket.up[own[0]]), bucket.number, text, ids[there].tobytes(), orders[there].tobytes(), index.astype(np.uint32).tobytes(), b""))
    return _rows(rows, SUFFIX_ROWS)


class Subtree:
    """The suffix tree of a group down to the depth of a window: its leaves and the deep node above each.

    rows hold stretches (words with a space after each, a line feed after each stretch) and the documents of each."""

    def __init__(self, rows: pa.Table, window: int):
        cells = rows.column("stretches").to_pylist()
        data = np.frombuffer(b"".join(cells), np.uint8)
        line = data == 10
        self.data = data[~line]
        # a stretch's words are counted at its line feed
        words_before = np.concatenate([[0], np.cumsum(data == 32)[line]])
        self.offsets = np.concatenate([[0], np.flatnonzero(self.data == 32) + 1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data)])
        codes = words.dictionary_encode().indices.to_numpy()
        leaves = np.diff(words_before) - window + 1
        self.stretch = np.repeat(np.arange(len(leaves)), leaves)
        self.start = np.arange(leaves.sum()) + np.repeat(words_before[:-1] - (np.cumsum(leaves) - leaves), leaves)
        self.node = ranks_at(codes, window)[self.start]
        self.row = np.repeat(np.arange(len(cells)), [c.count(b"\n") for c in cells])[self.stretch]
        columns = {c: rows.column(c).to_pylist() for c in ("ids", "orders", "documents")}
        picked = [np.frombuffer(d, np.uint32) for d in columns["documents"]]
        self.id, self.order = (np.concatenate([np.frombuffer(c, np.int64)[d] for c, d in zip(columns[k], picked)])[self.stretch] for k in ("ids", "orders"))

    def marked(self, bucket: np.ndarray) -> np.ndarray:
        """Whether a leaf is not the first one below its deep node, in the order of documents and places."""
        leaf = np.lexsort((np.arange(len(self.node)), bucket[self.row], self.order, self.id, self.node))
        out = np.zeros(len(leaf), bool)
        out[leaf[1:]] = self.node[leaf][1:] == self.node[leaf][:-1]
        return out

    def words(self, leaf: int, window: int) -> bytes:
        return self.data[self.offsets[self.start[leaf]] : self.offsets[self.start[leaf] + window]].tobytes()


def marked_leaves(rows: pa.Table, window: int) -> pa.Table:
    """A bit for each leaf that a bucket sent, set unless the leaf is the first of its node. A shard also passes on its
    first leaves."""
    tree, buckets = Subtree(rows, window), np.array(rows.column("bucket").to_pylist())
    marked, out = tree.marked(buckets), []
    keys, ups = rows.column("key").to_pylist(), rows.column("up").to_pylist()
    cuts = np.searchsorted(tree.row, np.arange(rows.num_rows + 1))
    for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        own = marked[a:b]
        if own.any():
            out.append((int(buckets[i]), keys[i], int(buckets[i]), np.packbits(own).tobytes(), *[b""] * 5))
        firsts = np.flatnonzero(~own)
        if ups[i] and len(firsts):
            text = b"".join(tree.words(a + k, window) + b"\n" for k in firsts.tolist())
            out.append((ups[i], keys[i], int(buckets[i]), b"", text, tree.id[a + firsts].tobytes(), tree.order[a + firsts].tobytes(), np.arange(len(firsts), dtype=np.uint32).tobytes(), firsts.astype(np.uint32).tobytes()))
    return _rows(out, LEAF_ROWS)


def merged_leaves(rows: pa.Table, window: int) -> pa.Table:
    """Marks as they are, and marks of the leaves that shards passed on: all but the first of each node."""
    passed = pc.greater(pc.binary_length(rows.column("stretches")), 0)
    out = [rows.filter(pc.invert(passed)).select(["key", "bucket", "bits", "places"])]
    rows = rows.filter(passed)
    if rows.num_rows:
        tree, more = Subtree(rows, window), []
        marked = tree.marked(np.array(rows.column("bucket").to_pylist()))
        cuts = np.searchsorted(tree.row, np.arange(rows.num_rows + 1)).tolist()
        for a, b, key, bucket, places in zip(cuts, cuts[1:], *(rows.column(c).to_pylist() for c in ("key", "bucket", "places"))):
            if marked[a:b].any():
                more.append((key, bucket, b"", np.frombuffer(places, np.uint32)[marked[a:b]].tobytes()))
        out.append(_rows(more, "key long, bucket int, bits binary, places binary"))
    return pa.concat_tables(out)


def kept_words(docs: pa.Table, told: pa.Table, window: int, more: list[str]) -> pa.Table:
    """(id, n_words, n_removed, kept) of a bucket's documents, and further columns of theirs.

    told: what parts (hashes) and groups (bits, places) say to this bucket."""
    parts = pc.is_valid(told.column("hashes"))
    bucket, marks = Bucket(docs, told.filter(parts), window), told.filter(pc.invert(parts))
    own, said = bucket.own, {}
    for key, bits, places in zip(*(marks.column(c).to_pylist() for c in ("key", "bits", "places"))):
        said.setdefault(key, []).append((bits, places))
    gone = ~bucket.new
    begins, ends = [bucket.first[gone]], [bucket.first[gone] + bucket.size[gone] + window - 1]
    for members in bucket.groups():
        if (answers := said.get(int(bucket.key[members[0]]))) is None:
            continue
        sizes = bucket.size[members]
        at = np.repeat(bucket.first[members] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        marked = np.zeros(len(at), bool)
        for bits, places in answers:
            if bits:
                marked |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)
            marked[np.frombuffer(places, np.uint32)] = True
        begins.append(at[marked])
        ends.append(at[marked] + window)
    room = len(own.words) + window + 1
    cover = np.bincount(np.concatenate(begins), minlength=room) - np.bincount(np.concatenate(ends), minlength=room)
    kept = np.cumsum(cover)[: len(own.words)] == 0
    n_words = np.diff(own.counts)
    before = np.concatenate([[0], np.cumsum(kept)])
    n_kept = before[own.counts[1:]] - before[own.counts[:-1]]
    # the bytes of kept words, with a space after each but the last of a document
    sizes, places = (own.ends - own.starts)[kept], own.starts[kept]
    gap = np.ones(len(sizes), np.int64)
    gap[before[own.counts[1:]][n_kept > 0] - 1] = 0
    end = np.cumsum(sizes + gap)
    out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    source = np.repeat(places - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    target = np.repeat(end - gap - sizes - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    out[target] = own.data[source]
    offsets = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n_kept)])]
    text = pa.LargeStringArray.from_buffers(len(n_words), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    return pa.table({"id": bucket.docs.column("id"), "n_words": n_words, "n_removed": n_words - n_kept, "kept": text} | {c: bucket.docs.column(c) for c in more})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_removed, kept): each document without the words of windows that also start earlier in docs.

    kept: the remaining words joined by one space. With carry, these columns of docs come too."""
    docs, more, kinds = with_carried(docs, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], carry)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # larger buckets for a larger corpus, within bounds: a passage that stands in every bucket has so many anchors
    buckets = max(1, -(-n_bytes // min(max(BUCKET_BYTES, n_bytes // BUCKETS), max(BUCKET_BYTES, MOST_BUCKET_BYTES))))
    parts, most = max(1, n_bytes // (6 * PART_ANCHORS)), GROUP_STRETCHES
    dealt = docs.withColumn("order", F.xxhash64("text"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("id", "order"), F.lit(buckets)).cast("int"))
    anchors = dealt.groupBy("bucket").applyInArrow(lambda t: anchors_of(t, window, parts), ANCHOR_ROWS)
    repeated = anchors.groupBy("part").applyInArrow(lambda t: repeated_anchors(t, most), REPEATED_ROWS)
    suffixes = dealt.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(lambda d, r: suffixes_of(d, r, window), SUFFIX_ROWS)
    leaves = suffixes.groupBy("key").applyInArrow(lambda t: marked_leaves(t, window), LEAF_ROWS)
    marks = leaves.groupBy("to").applyInArrow(lambda t: merged_leaves(t, window), "key long, bucket int, bits binary, places binary")
    told = repeated.unionByName(marks, allowMissingColumns=True)
    out = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(lambda d, t: kept_words(d, t, window, more), f"id long, n_words long, n_removed long, kept string{kinds}")
    return carried(out.withColumnRenamed("id", id_col), carry)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: All windows as word lists, each with its first place, in plain SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), r AS (
  SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1
), c AS (
  SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(range(0, 20)) AS k)
), x AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda y, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
