"""Conversation structure repair by a Viterbi search whose survivors coalesce.

The turns of a conversation are kept (K), given the role user or assistant (R), deleted (D), or turns without text are
inserted between them (I), so that the roles read: perhaps a system turn, then user and assistant in turn, ending with
an assistant - or nothing at all. Blank turns and repeats must go, truncated turns that stay cost extra. Of all cheapest
repairs that with the ASCII-least string of edits counts.

Spark sorts the turns of each conversation and hands them on as a stream; no conversation is collected. The search has
four states (nothing yet, after the system turn, after a user, after an assistant); each keeps its cheapest path, and the
paths are a tree of segments that branch where survivors part. A segment counts what refers to it; when a survivor dies,
what only it used is freed, and what all survivors share is emitted: appended to the audit string, its text fed to the
digest. States that another state beats whatever follows are dropped, so they cannot hold the tree open. Ties are broken
by comparing the whole unresolved strings below the common ancestor; they part within their first few letters, since equal
letters lead to equal states. Unresolved edits take a byte a branch; when the texts waiting with them exceed PENDING
bytes, each branch gets a digest of its own and the texts are let go.

Repeats are found before: the first turn of each (conversation, role, text) is aggregated with partial sums and joined to
the rows; blank turns take no part. One conversation of a third of all rows passes through one task, in constant memory
but for its audit string: a digest of the whole text is a chain that cannot be split.

Null roles and texts count as one space; null turns come first; rows of one turn go by role and text, and equal ones are
repeats; a null conv_id is a conversation like any other; a role that is empty has no initial and is never kept; a
conversation without rows gives zeros and the digest of nothing; an empty table gives an empty one; further columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bytes of text that may wait for a decision before each branch gets its own digest.
PENDING = 32 << 20
SPACES = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: Where a role's initial leads from each state, if it may stand there.
_KEEP = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
#: The state after a user or assistant turn that is put in.
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}


class Digest:
    """SHA-256 of role:text, joined by newlines."""

    def __init__(self, held=None, some: bool = False):
        self.held, self.some = held or hashlib.sha256(), some

    def copy(self) -> Digest:
        return Digest(self.held.copy(), self.some)

    def add(self, role: str, text: str) -> None:
        self.held.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True


class Turns:
    """The repaired turns themselves."""

    def __init__(self):
        self.rows: list[tuple[str, str]] = []

    def add(self, role: str, text: str) -> None:
        self.rows.append((role, text))


class Segment:
    """Edits between two branchings, and the turns that they give; `digest` covers all before `rows`, if it is set."""

    __slots__ = ("parent", "children", "letters", "rows", "states", "digest")

    def __init__(self, parent: Segment | None):
        self.parent, self.children, self.letters, self.rows, self.states, self.digest = parent, [], bytearray(), [], 0, None


class Repair:
    """The search over one conversation, a turn at a time."""

    def __init__(self, sink, pending: int | None = PENDING):
        self.sink, self.pending, self.waiting = sink, pending, 0
        self.audit = bytearray()
        self.root = Segment(None)
        self.root.states = 1
        self._follow({_START: (0, self.root, b"", ())})

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        extra, best = TRUNCATED if truncated else 0, {}
        for state, (cost, leaf) in self.alive.items():
            self._offer(best, state, cost + DELETE, leaf, b"D", ())
            if must_go:
                continue
            to = _KEEP.get(role[:1], {}).get(state)
            if to is not None:
                self._offer(best, to, cost + extra, leaf, b"K", ((role, text),))
            self._offer(best, _NEXT[state], cost + REROLE + extra, leaf, b"R", ((_ROLE[_NEXT[state]], text),))
        self._follow(best)

    def _offer(self, best: dict, state: int, cost: int, leaf: Segment, letters: bytes, rows: tuple) -> None:
        held = best.get(state)
        if held is None or cost < held[0] or (cost == held[0] and _before(leaf, letters, held[1], held[2])):
            best[state] = cost, leaf, letters, rows

    def _follow(self, best: dict) -> None:
        """Insertions after a turn, then the survivors' segments; `best` holds (cost, segment, letters, turns) a state."""
        for source, to in ((_START, _USER), (_SYSTEM, _USER), (_ASSISTANT, _USER), (_USER, _ASSISTANT)):
            if source in best:
                cost, leaf, letters, rows = best[source]
                self._offer(best, to, cost + INSERT, leaf, letters + b"I", (*rows, (_ROLE[to], "")))
        # an assistant's state can do whatever comes; only a system turn that stays would have to go
        last = best[_ASSISTANT][0]
        if _START in best and best[_START][0] > last + DELETE:
            del best[_START]
        if _SYSTEM in best and best[_SYSTEM][0] > last:
            del best[_SYSTEM]
        uses: dict[int, int] = {}
        for _, leaf, _, _ in best.values():
            uses[id(leaf)] = uses.get(id(leaf), 0) + 1
        old = {id(leaf): leaf for _, leaf in getattr(self, "alive", {}).values()}
        self.alive = {}
        for state, (cost, leaf, letters, rows) in best.items():
            if uses[id(leaf)] > 1:  # survivors part here
                own = Segment(leaf)
                leaf.children.append(own)
                leaf.states = 0
            else:
                own = leaf
            own.letters += letters
            own.rows += rows
            own.states = 1
            self.waiting += sum(len(text) for _, text in rows)
            self.alive[state] = cost, own
        self._free([leaf for key, leaf in old.items() if key not in uses])
        self._emit()
        if self.pending is not None and self.waiting > self.pending:
            self._fold()

    def _free(self, dead: list[Segment]) -> None:
        """Takes dead survivors' segments away up to those that others use; a segment left with one child takes it in."""
        left = []
        for leaf in dead:
            leaf.states = 0
            while not leaf.children and not leaf.states and leaf.parent is not None:
                self.waiting -= sum(len(text) for _, text in leaf.rows)
                leaf.parent.children.remove(leaf)
                leaf = leaf.parent
            left.append(leaf)
        for leaf in left:
            while leaf.parent is not None and len(leaf.children) == 1 and leaf in leaf.parent.children:
                self._take_in(leaf, leaf.children[0])

    def _take_in(self, leaf: Segment, child: Segment) -> None:
        leaf.letters += child.letters
        if child.digest is not None:
            leaf.digest, leaf.rows = child.digest, child.rows
        else:
            leaf.rows += child.rows
        leaf.children, leaf.states = child.children, child.states
        for c in leaf.children:
            c.parent = leaf
        for state, (cost, own) in self.alive.items():
            if own is child:
                self.alive[state] = cost, leaf

    def _emit(self) -> None:
        while True:
            self.audit += self.root.letters
            if self.root.digest is not None:
                self.sink = self.root.digest
            for role, text in self.root.rows:
                self.sink.add(role, text)
                self.waiting -= len(text)
            self.root.letters, self.root.rows, self.root.digest = bytearray(), [], None
            if self.root.states or len(self.root.children) != 1:
                return
            self.root = self.root.children[0]
            self.root.parent = None

    def _fold(self) -> None:
        """Feeds the waiting texts to a digest of each branch."""
        todo = [(self.root, self.sink)]
        while todo:
            segment, before = todo.pop()
            if segment is not self.root:
                segment.digest = segment.digest or before.copy()
                for role, text in segment.rows:
                    segment.digest.add(role, text)
                segment.rows = []
                before = segment.digest
            todo += [(c, before) for c in segment.children]
        self.waiting = 0

    def finish(self) -> tuple[int, str]:
        """(cost, audit) of the best repair; its turns have gone to the sink."""
        last = {state: self.alive[state] for state in (_START, _ASSISTANT) if state in self.alive}
        state = _ASSISTANT
        if _START in last:
            (cost, leaf), (other, own) = last[_START], last[_ASSISTANT]
            state = _START if cost < other or (cost == other and _before(leaf, b"", own, b"")) else _ASSISTANT
        cost, leaf = last[state]
        dead = [own for _, own in self.alive.values() if own is not leaf]
        self.alive = {state: (cost, leaf)}
        self._free(dead)
        self._emit()
        return cost, self.audit.decode()


def _before(a: Segment, more_a: bytes, b: Segment, more_b: bytes) -> bool:
    """Whether the edits up to a, and then more_a, come before those up to b in ASCII order."""
    if a is b:
        return more_a < more_b
    up, down = [], []
    for segment, chain in ((a, up), (b, down)):
        while segment is not None:
            chain.append(segment)
            segment = segment.parent
    while up and down and up[-1] is down[-1]:
        up.pop()
        down.pop()
    x, y = ([*(s.letters for s in reversed(chain)), more] for chain, more in ((up, more_a), (down, more_b)))
    head_x, head_y = (b"".join(bytes(s[:8]) for s in z) if len(z) == 1 else bytes(z[0][:8]) for z in (x, y))
    for p, q in zip(head_x, head_y):
        if p != q:
            return p < q
    return b"".join(map(bytes, x)) < b"".join(map(bytes, y))


def classed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, gone, blank, later, truncated) of rows; `gone` marks rows that are there only for the
    conversation's id. later: role and text were seen in an earlier turn (equal rows of one turn are told in the stream)."""
    whole = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.coalesce(gone, F.lit(False)).alias("gone") if gone is not None else F.lit(False).alias("gone"),
    )
    ended = F.rtrim("text", F.lit(SPACES))
    whole = whole.withColumn("blank", ended == "").withColumn("truncated", ~F.substring(ended, -1, 1).isin(".", "!", "?"))
    whole = whole.withColumn("said", F.when(~F.col("gone") & ~F.col("blank"), F.sha2("text", 256)))
    seen = whole.where(F.col("said").isNotNull()).groupBy("conv_id", "role", "said").agg(F.count("*").alias("times"), F.max(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("first"))
    seen = seen.where(F.col("times") > 1).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("t"), "untimed", "first")
    found = whole.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("t")), "left")
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("untimed") | (F.col("turn") > F.col("first"))), F.lit(False))
    return found.select("conv_id", "turn", "role", "text", "gone", "blank", later.alias("later"), "truncated")


def _conversations(batches: Iterator[pa.RecordBatch], sink: type, pending: int | None) -> Iterator[tuple]:
    """(conv_id, counts, search) of each conversation of a sorted stream."""
    none = object()
    conv, counts, search, before, before_turn, least, most, turns = none, None, None, None, none, None, None, 0

    def end() -> tuple:
        counts["gaps"] = most - least + 1 - turns if turns else 0
        counts["cost"], counts["audit"] = search.finish()
        return conv, counts, search

    for batch in batches:
        for c, turn, role, text, gone, blank, later, truncated in zip(*(x.to_pylist() for x in batch.columns)):
            if conv is none or c != conv:
                if conv is not none:
                    yield end()
                conv, counts, search = c, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), Repair(sink(), pending)
                before, before_turn, least, most, turns = None, none, None, None, 0
            if gone:
                continue
            if before is not None and before[0][:1] + role[:1] not in ("su", "ua", "au"):
                counts["illegal"] += 1
            same = before == (role, text) and before_turn == turn
            if turn is not None and turn != before_turn:
                least, most, turns = turn if least is None else least, turn, turns + 1
            fault = "blank" if blank else "duplicate" if later or same else "truncated" if truncated else None
            if fault:
                counts[fault] += 1
            search.turn(role, text, fault in ("blank", "duplicate"), fault == "truncated")
            before, before_turn = (role, text), turn
    if conv is not none:
        yield end()


def _sorted(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def audited(turns: DataFrame, pending: int = PENDING) -> DataFrame:
    """One row a conversation of classed(): counts of faults, cost and audit of the repair, and its digest."""
    kind = dict(turns.dtypes)["conv_id"]
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, type_ = [], pa.int64()

        def typed(all_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal type_
            for batch in all_:
                type_ = batch.schema.field(0).type
                yield batch

        def block() -> pa.RecordBatch:
            columns = [pa.array([h[0] for h in held], type_), *(pa.array([h[1][k] for h in held], pa.int64()) for k in numbers), pa.array([h[1]["audit"] for h in held]), pa.array([h[2] for h in held])]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *numbers, "audit", "repaired_sha256"])

        size = 0
        for conv, counts, search in _conversations(typed(batches), Digest, pending):
            held.append((conv, counts, search.sink.held.hexdigest()))
            size += 200 + len(counts["audit"])
            if size > 1 << 22:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    longs = "".join(f"{n} long, " for n in numbers)
    return _sorted(turns).mapInArrow(run, f"conv_id {kind}, {longs}audit string, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations. Turns wait in memory until they are decided."""
    kind = dict(turns.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        type_ = first.schema.field(0).type

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for conv, _, search in _conversations(again(), Turns, None):
            rows = search.sink.rows
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(rows), type_), pa.array(range(len(rows)), pa.int64()), pa.array([r for r, _ in rows]), pa.array([t for _, t in rows])], ["conv_id", "place", "role", "text"])

    return _sorted(turns).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of conv_id:turn modulo 20; dropped ones stay, marked `gone`, without text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(classed(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone")))


#: The same search as a recursion over turns: the best (cost, audit) of each state after each turn.
ORACLE_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
    COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), hit AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS d
  FROM raw
), bad AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE d <> 0
), t AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM bad)
), f AS (
  SELECT conv_id, turn, role, text, n, ini, CASE WHEN ended = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY n) || ini AS pair
  FROM t
), edit(letter, src, dst, price, needs) AS (
  VALUES ('D', 0, 0, 4, ''), ('D', 1, 1, 4, ''), ('D', 2, 2, 4, ''), ('D', 3, 3, 4, ''), ('K', 0, 1, 0, 's'), ('K', 0, 2, 0, 'u'), ('K', 1, 2, 0, 'u'), ('K', 3, 2, 0, 'u'), ('K', 2, 3, 0, 'a'),
    ('R', 0, 2, 3, ''), ('R', 1, 2, 3, ''), ('R', 3, 2, 3, ''), ('R', 2, 3, 3, '')
), put(pre, post, letters, fee) AS (
  VALUES (0, 0, '', 0), (0, 2, 'I', 3), (0, 3, 'II', 6), (1, 1, '', 0), (1, 2, 'I', 3), (1, 3, 'II', 6), (2, 2, '', 0), (2, 3, 'I', 3), (3, 3, '', 0), (3, 2, 'I', 3)
), path(conv_id, n, state, cost, audit) AS (
  SELECT c.conv_id, CAST(0 AS BIGINT), post, fee, letters FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN put ON pre = 0
  UNION ALL
  SELECT conv_id, n, state, cost, audit FROM (
    SELECT p.conv_id, f.n, put.post AS state, p.cost + e.price + put.fee + CASE WHEN e.letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost, p.audit || e.letter || put.letters AS audit
    FROM path p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1
      JOIN edit e ON e.src = p.state AND (e.letter = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (e.needs = '' OR e.needs = f.ini) JOIN put ON put.pre = e.dst
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), best AS (
  SELECT conv_id, cost, audit FROM path WHERE state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, cost, audit) = 1
), step AS (
  SELECT conv_id, i, substr(audit, i, 1) AS letter, len(replace(substr(audit, 1, i), 'I', '')) AS n FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS i FROM best)
), said AS (
  SELECT s.conv_id, i, letter, role, text, row_number() OVER (PARTITION BY s.conv_id ORDER BY i) AS k, first_value(letter = 'K' AND ini = 's') OVER (PARTITION BY s.conv_id ORDER BY i) AS sys
  FROM step s LEFT JOIN f ON s.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.n WHERE letter <> 'D'
), whole AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS said
  FROM said GROUP BY conv_id
), counts AS (
  SELECT conv_id, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT b.conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, CAST(COALESCE(blank, 0) AS BIGINT) AS blank, CAST(COALESCE(duplicate, 0) AS BIGINT) AS duplicate, CAST(COALESCE(truncated, 0) AS BIGINT) AS truncated,
  CAST(COALESCE(illegal, 0) AS BIGINT) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit, sha256(COALESCE(said, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM b.conv_id
"""
