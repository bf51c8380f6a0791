"""Conversation repair against a search over all edits, whole and in segments."""

import hashlib
import heapq
import random
import zlib

import pytest

from wayfold.llm import conversation_repair as repair

STEP = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def best(turns):
    """(cost, audit, lines) by a search of least (cost, audit): turns are (role, text, fault)."""
    heap, done = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in "0a":
            return cost, audit, list(out)
        for name in ("user", "assistant"):
            if (state, name[0]) in STEP:
                heapq.heappush(heap, (cost + 5, audit + "I", i, STEP[state, name[0]], (*out, f"{name}:")))
        if i == len(turns):
            continue
        role, text, fault = turns[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        extra = 5 * (fault == "truncated")
        if (state, role[:1]) in STEP:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, STEP[state, role[:1]], (*out, f"{role}:{text}")))
        for name in ("user", "assistant"):
            if (state, name[0]) in STEP:
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, STEP[state, name[0]], (*out, f"{name}:{text}")))
    raise AssertionError


def plain(rows, damage=True):
    """The results of rows (conv_id, turn, role, text), by loops."""
    space = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20 if damage else 9
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        mine.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns = set(), []
        for _, role, text in mine:
            solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [r[0] for r in mine if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = best(turns)
        out[conv] = (gaps, *(sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def collected(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made_up(n, seed=3):
    random.seed(seed)
    rows = []
    for conv in range(n):
        for turn in range(random.randint(1, 9)):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, random.choice([turn, turn, turn, None, 2]), role, random.choice(["Yes.", "No!", "cut of", "", " \t", "é? ", "Well. And", None, f"t{turn}."])))
    return rows + [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (n + 1, None, None, None), (n + 2, 5, "user", "Why?"), (n + 2, 9, "assistant", "So.")]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert collected(repair.repaired(repair.damaged(df))) == plain(rows)


@pytest.mark.parametrize("segment", [2, 512])
def test_odd_rows(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = made_up(120)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS key", "'clash' AS seg", "'clash' AS cost", "7 AS fault").repartition(5)
    assert collected(repair.repaired(repair.damaged(df))) == plain(rows)
    assert collected(repair.repaired(df)) == plain(rows, damage=False)
    assert repair.repaired(repair.damaged(df.where("false"))).count() == 0


def test_a_conversation_of_many_turns_is_cut(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    random.seed(8)
    rows = [(1, t // 2, random.choice(["user", "assistant", "assistant", "system"]), random.choice([f"{t}.", f"{t}", "Same.", ""])) for t in range(400)]
    rows += [(2, t, "assistant" if t % 2 else "user", f"{t}!") for t in range(200)] + [(3, 0, "user", "a.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = collected(repair.repaired(df))
    assert got == plain(rows, damage=False)
    assert got[2][:6] == (0,) * 6 and got[2][6] == "K" * 200
    assert collected(repair.repaired(repair.damaged(df))) == plain(rows)


def test_dropped_conversations_and_string_ids(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "x.")], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert collected(repair.repaired(repair.damaged(df))) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    names = spark.createDataFrame([('q"\n', 1, "user", "x."), ('q"\n', 2, "assistant", "y")], "conv_id string, turn int, role string, text string")
    assert collected(repair.repaired(names))['q"\n'][:7] == (0, 0, 0, 1, 0, 4, "DD")


def test_layers_against_the_search():
    random.seed(1)
    for _ in range(3000):
        turns = [(random.choice(["system", "user", "assistant", "tool"]), str(i), random.choice(["", "", "", "blank", "duplicate", "truncated"])) for i in range(random.randint(0, 7))]
        cost, audit, kept = repair.solved(tuple((r[:1], f) for r, _, f in turns))
        assert (cost, audit, repair.lines(kept, [t[:2] for t in turns])) == best(turns)
