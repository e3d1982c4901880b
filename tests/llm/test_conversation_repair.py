"""Repairs of conversations against a search that keeps every state's whole string."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from driftlake.llm import conversation_repair as cr
from driftlake.llm.common import prepare
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
NEXT = {0: 2, 1: 2, 3: 2, 2: 3}
ROLE = {2: "user", 3: "assistant"}
NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(turns):
    """(cost, audit, turns) of the best repair of (role, text, must go, truncated)."""

    def better(states, state, path):
        if state not in states or path[:2] < states[state][:2]:
            states[state] = path

    def filled(states):
        for _ in range(3):
            for s, (cost, audit, out) in list(states.items()):
                better(states, NEXT[s], (cost + 3, audit + "I", (*out, (ROLE[NEXT[s]], ""))))
        return states

    states = filled({0: (0, "", ())})
    for role, text, must_go, truncated in turns:
        new, more = {}, 3 if truncated else 0
        for s, (cost, audit, out) in states.items():
            better(new, s, (cost + 4, audit + "D", out))
            if not must_go:
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((s, role[:1]))
                if to is not None:
                    better(new, to, (cost + more, audit + "K", (*out, (role, text))))
                better(new, NEXT[s], (cost + 3 + more, audit + "R", (*out, (ROLE[NEXT[s]], text))))
        states = filled(new)
    return min(states[s] for s in (0, 3) if s in states)


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def by_hand(rows):
    """What the query returns for (conv_id, turn, role, text) rows."""
    conversations = {}
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        seen, counts, steps = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            words = text.strip(cr.SPACES)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            steps.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = cheapest(steps)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest(kept)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def test_search_keeps_the_least_of_equal_repairs():
    rng = random.Random(1)
    for n in range(3000):
        weights = rng.choice([(1, 1, 1, 1), (0, 1, 1, 5), (5, 1, 1, 0), (1, 5, 5, 1)])
        rows = [(rng.choices(["system", "user", "assistant", "tool"], weights)[0], str(i), rng.random() < 0.3, rng.random() < 0.2) for i in range(rng.randrange(14))]
        for pending in (None, 0, 3):
            search = cr.Repair(cr.Digest(), pending)
            for row in rows:
                search.turn(*row)
            cost, audit, kept = cheapest(rows)
            assert (*search.finish(), search.sink.held.hexdigest()) == (cost, audit, digest(kept)), rows


@pytest.mark.parametrize("roles", [["tool"], ["user", "assistant"], ["system"], ["tool", "user"], ["blank"], ["user"]])
def test_memory_stays_bounded(roles):
    """Long conversations that stay undecided, or are decided at once: few segments, texts let go, time in proportion."""

    def run(n):
        search, began, most, waiting = cr.Repair(cr.Digest(), 1000), time.perf_counter(), 0, 0
        for i in range(n):
            search.turn(roles[i % len(roles)], "text", roles[i % len(roles)] == "blank", False)
            todo, segments = [search.root], 0
            while todo:
                segments += 1
                todo += todo.pop().children
            most, waiting = max(most, segments), max(waiting, search.waiting)
        search.finish()
        assert most <= 7 and waiting <= 1100
        return time.perf_counter() - began

    run(1000)
    assert run(40000) < 10 * run(10000) + 1


def test_rows_of_every_kind(spark):
    prepare(spark)
    rng = random.Random(5)
    texts = ["Yes.", "No", "", " \n", None, "Why?", "é ß\x85", "x" * 40000 + "!", "a.\t\n", "a.　"]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(rng.choice([*range(30), None]), rng.choice([*range(9), None]), rng.choices(roles, (6, 6, 2, 1, 1, 1, 1))[0], rng.choice(texts)) for _ in range(600)]
    rows += [rows[3]] * 3 + [(90, 0, "user", "."), (91, None, None, None), (92, 5, "assistant", "Hm.")]
    rows += [(c, t, "user", "Gone.") for c in range(100, 140) for t in range(1)]  # some are dropped whole
    rows += [(200, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]  # a third of all rows
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    turns = cr.classed(cr.damaged(df), gone=F.col("gone"))
    want = by_hand(rows)
    for pending in (cr.PENDING, 0):
        got = sorted((tuple(r) for r in cr.audited(turns, pending).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert got == want
    assert any(r[7] == "" and r[8] == NOTHING for r in want)
    whole = {}
    for r in cr.repaired(turns).orderBy("place").collect():
        whole.setdefault(r.conv_id, []).append((r.role, r.text))
    assert {c: digest(t) for c, t in whole.items()} == {r[0]: r[8] for r in want if r[8] != NOTHING}
    assert cr.audited(cr.classed(cr.damaged(df.limit(0)), gone=F.col("gone"))).collect() == []


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    key = lambda r: r[0]
    got = sorted((tuple(r) for r in cr.op13_conversation_repair(spark, SF).collect()), key=key)
    assert got == sorted(con.sql(cr.ORACLE_SQL).fetchall(), key=key) and got
