"""Repair of conversations against all edits of short ones, and a plain dynamic programme over whole audits."""

import hashlib
import re
import zlib
from functools import cache
from itertools import product

import pytest
from helpers import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from massgrid.llm import conversations as C

WANTED = re.compile(r"(s?(ua)+)?")


def results(initials, faults, inserts=3):
    """Every (cost, audit) of edits that give a wanted role sequence, with up to `inserts` inserted turns."""
    found = []

    def go(i, roles, cost, audit, left):
        if i == len(initials):
            if WANTED.fullmatch(roles):
                found.append((cost, audit))
        else:
            go(i + 1, roles, cost + 3, audit + "D", left)
            if faults[i] not in (C.BLANK, C.DUPLICATE):
                stays = faults[i] == C.TRUNCATED
                go(i + 1, roles + initials[i], cost + stays, audit + "K", left)
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + stays, audit + "R", left)
        if left:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", left - 1)

    go(0, "", 0, "", inserts)
    return min(found)


@pytest.mark.parametrize("n", range(4))
def test_all_short_conversations(n):
    for initials in product("sua ", repeat=n):
        for faults in product((C.NONE, C.BLANK, C.TRUNCATED)[: 3 if n < 3 else 1], repeat=n):
            assert C.cheapest("".join(initials), bytes(faults)) == results(initials, faults)


def plain(initials, faults):
    """(cost, audit) by a table over (turns, state) with whole strings."""
    best = {(0, C.START): (0, "")}
    for i in range(len(initials) + 1):
        for _ in range(4):  # insertions from state to state
            for s in range(4):
                if (i, s) in best:
                    cost, audit = best[i, s]
                    for r in "ua":
                        t = C.STEP.get((s, r))
                        if t is not None:
                            best[i, t] = min(best.get((i, t), (10**9, "")), (cost + 2, audit + "I"))
        if i == len(initials):
            break
        for s in range(4):
            if (i, s) in best:
                cost, audit = best[i, s]
                edges = [(3, "D", s)]
                if faults[i] in (C.NONE, C.TRUNCATED):
                    k = faults[i] == C.TRUNCATED
                    edges += [(2 + k, "R", C.STEP[s, r]) for r in "ua" if (s, r) in C.STEP]
                    edges += [(k, "K", C.STEP[s, initials[i]])] if (s, initials[i]) in C.STEP else []
                for c, letter, t in edges:
                    best[i + 1, t] = min(best.get((i + 1, t), (10**9, "")), (cost + c, audit + letter))
    return min(best[len(initials), s] for s in (C.START, C.ASSISTANT) if (len(initials), s) in best)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(range(4))), max_size=60))
def test_longer_conversations(turns):
    initials, faults = "".join(t[0] for t in turns), bytes(t[1] for t in turns)
    assert C.cheapest(initials, faults) == plain(initials, faults)


def test_a_long_conversation_takes_time_in_proportion():
    import time

    initials, took = "uuauasa" * 3000, []
    for n in (5000, 20000):
        start = time.perf_counter()
        cost, audit = C.cheapest(initials[:n], bytes(n))
        took.append(time.perf_counter() - start)
        assert len(audit) >= n and cost > 0
    assert took[1] < 10 * took[0] + 1


def by_hand(rows):
    """The whole query in plain Python: rows of (conv_id, turn, role, text)."""
    conversations = {}
    for conv_id, turn, role, text in rows:
        own = conversations.setdefault(conv_id, [])
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv_id)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv_id, own in conversations.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(C.BLANK if not solid else C.DUPLICATE if (role, text) in seen else C.TRUNCATED if solid[-1] not in ".!?" else C.NONE)
            seen.add((role, text))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain(initials, faults)
        left, turns, last = [], iter(own), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(turns)[1:]
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                left.append(f"{role}:{text}")
                last = role[0]
        assert WANTED.fullmatch("".join(x[0] for x in left))
        yield (conv_id, gaps, *(faults.count(f) for f in (C.BLANK, C.DUPLICATE, C.TRUNCATED)), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


@cache
def small_rows():
    import pyarrow.parquet as pq

    return [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{SMALL}/conversations.parquet").to_pylist()]


def answers(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_query(spark):
    rows = C.query(spark, SMALL)
    assert rows.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert answers(rows) == sorted(by_hand(small_rows()), key=repr)


def test_odd_rows(spark, tmp_path):
    """Nulls anywhere, equal turns, repeated rows, odd roles, long texts and clashing columns; and no rows at all."""
    rows = [(c, t, role, text) for c in (None, 1, 2) for t, role, text in [(None, "user", "a."), (None, None, None), (3, "user", "b."), (3, "user", "b."), (3, "assistant", "c!"), (9, "", "x"), (10, "ünknown", "é?"), (11, "system", " \n"), (12, "assistant", "w " * 200_000)]]
    rows += [(100 + k, 0, "user", "only") for k in range(60)]  # some have their one turn dropped
    schema = "conv_id long, turn long, role string, text string, part int, kind string, audit string"
    frame = spark.createDataFrame([(*r, 7, "k", "K") for r in rows], schema)
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = answers(C.query(spark, str(tmp_path)))
    assert got == sorted(by_hand(rows), key=repr)
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in got)
    frame.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert C.query(spark, str(tmp_path / "none")).isEmpty()


def test_repaired_turns_without_damage(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    rows = C.turns(frame)
    found = C.audits(rows)
    assert (found.first().cost, found.first().audit) == (2, "KIKK")
    fixed = [(r.place, r.edit, r.role, r.text) for r in C.repaired(rows, found).orderBy("place").collect()]
    assert fixed == [(0, "K", "user", "Hi."), (1, "I", "assistant", ""), (2, "K", "user", "Still there?"), (3, "K", "assistant", "Yes.")]
