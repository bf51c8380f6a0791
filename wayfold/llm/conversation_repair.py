"""Conversations brought back to the form (s?(ua)+)? of role initials by the cheapest edits.

Per turn a set of the grammar's states is kept as four bits, and there is a
layer of these sets for each cost, as in the approximate matching of Wu and
Manber: layer c holds the states from which the rest of the conversation can be
accepted at cost c. Layers are added until the start is in one; its number is
the cost. The audit is traced through the layers from the start, by the least
edit whose state and rest of the cost are set. A turn to delete in any case
shifts the layers; the others keep, rerole, delete or insert.

Turns are dealt by ranges of (conversation, turn) and sorted, so that a task
solves the conversations that lie within it as they pass by. A conversation of
more than SEGMENT turns, or at an end of a task, is cut into segments: each
gets its costs from state to state in a task of its own, a fold over the
segments gives the costs of what follows each one, their traces are again made
apart, and a last fold picks those that follow on each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.tables import Scratch

#: Costs of the edits, and the states of the grammar: start, after s, after u, after a; the first and last accept.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START = 0
#: Turns that are solved at a time.
SEGMENT = 512
FAR = 10**15

#: Where an initial leads from each state; nowhere is -1. An edit that sets the role always takes the one that fits.
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
SET = (2, 2, 3, 2)
SET_ROLE = ("user", "user", "assistant", "user")


def _before(step: tuple[int, ...]) -> list[int]:
    """For each set of states, those from which one step leads into it."""
    return [sum(1 << s for s in range(4) if step[s] >= 0 and states >> step[s] & 1) for states in range(16)]


KEPT_FROM = {initial: _before(step) for initial, step in NEXT.items()} | {"": [0] * 16}
SET_FROM = _before(SET)


class Layers:
    """The layers of turns (initial, fault), from given costs of the states after the last; faults are '', 'blank', 'duplicate', 'truncated'."""

    def __init__(self, turns: list[tuple[str, str]], after: tuple[int, int, int, int]):
        self.turns, self.n = turns, len(turns)
        self.gone = [f in ("blank", "duplicate") for _, f in turns]
        #: forced[i]: the costs of the turns from i on that must be deleted; layers leave them out.
        self.forced = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            self.forced[i] = self.forced[i + 1] + DELETE * self.gone[i]
        self.kept_from = [KEPT_FROM.get(initial, KEPT_FROM[""]) for initial, _ in turns]
        self.after, self.least = after, min(after)
        self.layers: list[list[int]] = []

    def _add(self) -> None:
        c, n = len(self.layers), self.n
        empty = [0] * (n + 1)
        less = lambda k: self.layers[c - k] if c >= k else empty
        one, two, five, six = less(REROLE), less(DELETE), less(INSERT), less(REROLE + TRUNCATED)
        at = sum(1 << s for s in range(4) if self.after[s] - self.least == c) | SET_FROM[five[n]]
        layer = [0] * n + [at]
        for i in range(n - 1, -1, -1):
            if self.gone[i]:
                pass
            elif self.turns[i][1] == "truncated":
                at = self.kept_from[i][five[i + 1]] | SET_FROM[six[i + 1]] | two[i + 1]
            else:
                at = self.kept_from[i][at] | SET_FROM[one[i + 1]] | two[i + 1]
            at |= SET_FROM[five[i]]
            layer[i] = at
        self.layers.append(layer)

    def cost(self, state: int) -> int:
        """The least cost from a state before the first turn. Every state is within some layer, as turns can be deleted and inserted."""
        c = 0
        while True:
            if c == len(self.layers):
                self._add()
            if self.layers[c][0] >> state & 1:
                return c + self.least + self.forced[0]
            c += 1

    def trace(self, state: int) -> tuple[str, int, list[tuple[int, str]]]:
        """(audit, state after, kept): the edits of least initials, and what stays as (turn or -1, role that is set or '')."""
        left, i, audit, kept = self.cost(state) - self.least - self.forced[0], 0, [], []
        there = lambda c, i, s: c >= 0 and s >= 0 and self.layers[c][i] >> s & 1
        while i < self.n or not self.after[state] - self.least == left:
            step, extra = SET[state], 0
            if i < self.n:
                extra = TRUNCATED if self.turns[i][1] == "truncated" else 0
                if self.gone[i] and there(left, i + 1, state):
                    audit.append("D")
                    i += 1
                    continue
                if not self.gone[i] and there(left - DELETE, i + 1, state):
                    audit.append("D")
                    i, left = i + 1, left - DELETE
                    continue
            if there(left - INSERT, i, step):
                audit.append("I")
                kept.append((-1, SET_ROLE[state]))
                state, left = step, left - INSERT
                continue
            own = NEXT.get(self.turns[i][0], (-1,) * 4)[state]
            if there(left - extra, i + 1, own):
                audit.append("K")
                kept.append((i, ""))
                state, left = own, left - extra
            else:
                audit.append("R")
                kept.append((i, SET_ROLE[state]))
                state, left = step, left - extra - REROLE
            i += 1
        return "".join(audit), state, kept


ACCEPT = (0, FAR, FAR, 0)


def solved(turns: tuple[tuple[str, str], ...]) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, audit, kept) of a whole conversation. Short ones are often alike and kept in mind."""
    return _short(turns) if len(turns) <= 32 else _solved(turns)


def _solved(turns: tuple[tuple[str, str], ...]) -> tuple[int, str, list[tuple[int, str]]]:
    layers = Layers(list(turns), ACCEPT)
    audit, _, kept = layers.trace(START)
    return layers.cost(START), audit, kept


_short = lru_cache(4096)(_solved)


def lines(kept: list[tuple[int, str]], rows: list[tuple[str, str]]) -> list[str]:
    """role:text of what stays of rows (role, text)."""
    return [f"{role or rows[i][0]}:{rows[i][1] if i >= 0 else ''}" for i, role in kept]


def _conversation(rows: list[tuple]) -> tuple:
    """All of a conversation's result but its id, from sorted rows (turn, role, text, fault but for duplicates, dropped)."""
    rows = [r for r in rows if not r[4]]
    seen, turns = set(), []
    for _, role, text, fault, _ in rows:
        again = (role, text) in seen
        seen.add((role, text))
        turns.append((role[:1], fault if fault == "blank" else "duplicate" if again else fault))
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
    cost, audit, kept = solved(tuple(turns))
    digest = hashlib.sha256("\n".join(lines(kept, [r[1:3] for r in rows])).encode()).hexdigest()
    return gaps, *(sum(f == x for _, f in turns) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROW = "turn long, role string, text string, fault string, dropped boolean"
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
_ROW_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations that lie within sorted rows (key, turn, role, text, fault, dropped), and the rows of others in segments.

    The segments of a task are numbered by `run`, within them rows by `at`.
    """
    names = ["key", "run", "at", "turn", "role", "text", "fault", "dropped", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    whole: list[tuple] = []
    cut: list[tuple] = []
    key, held, run, at, edge = None, [], -1, 0, True

    def emitted() -> pa.RecordBatch:
        n, m = len(whole), len(cut)
        kind = lambda values, t, before, after: pa.concat_arrays([pa.nulls(before, t), pa.array(values, t), pa.nulls(after, t)])
        arrays = [pa.array([*(x[0] for x in whole), *(x[0] for x in cut)], pa.string())]
        arrays += [kind([x[1 + k] for x in cut], t, n, 0) for k, t in enumerate([pa.int32(), pa.int32(), *_ROW_TYPES])]
        arrays += [kind([x[1 + k] for x in whole], t, 0, m) for k, t in enumerate(_TYPES)]
        whole.clear()
        cut.clear()
        return pa.RecordBatch.from_arrays(arrays, names)

    def flush() -> None:
        nonlocal run, at
        for row in held:
            if at % SEGMENT == 0:
                run, at = run + 1, 0
            cut.append((key, run, at, *row))
            at += 1
        held.clear()

    for batch in batches:
        for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                # the first conversation of a task may have begun in the one before it
                if edge:
                    flush()
                elif held:
                    whole.append((key, *_conversation(held)))
                    held.clear()
                edge = key is None
                key, at = own, 0
            held.append(tuple(row))
            if len(held) > SEGMENT or edge and len(held) == SEGMENT:
                flush()
                edge = True
        if whole or cut:
            yield emitted()
    flush()
    if cut:
        yield emitted()


def _codes(rows: Column) -> Column:
    return F.transform(F.array_sort(rows), lambda x: F.struct(x["initial"].alias("initial"), x["fault"].alias("fault")))


def _turns(codes) -> list[tuple[str, str]]:
    return [(x["initial"], x["fault"]) for x in codes]


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seg, costs) of (key, seg, codes): 16 costs, from state to state."""
    for batch in batches:
        out = []
        for codes in batch.column(2).to_pylist():
            ends = [Layers(_turns(codes), tuple(0 if s == end else FAR for s in range(4))) for end in range(4)]
            # the start and s can't be come back to: only from themselves, by deleting
            out.append([_reached(layers, start, end) for start in range(4) for end, layers in enumerate(ends)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["key", "seg", "costs"])


def _reached(layers: Layers, start: int, end: int) -> int:
    return layers.cost(start) if end in (2, 3) or start == end or (start, end) == (0, 1) and any(i == "s" and f not in ("blank", "duplicate") for i, f in layers.turns) else FAR


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seg, after, cost) of (key, seg, costs), of each key from the last segment to the first: costs from each state after a segment, and from the start before it."""
    key, after = None, ACCEPT
    for batch in batches:
        afters, totals = [], []
        for own, costs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own != key:
                key, after = own, ACCEPT
            afters.append(list(after))
            after = tuple(min(costs[4 * s + e] + after[e] for e in range(4)) for s in range(4))
            totals.append(after[START])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(afters, pa.list_(pa.int64())), pa.array(totals, pa.int64())], ["key", "seg", "after", "cost"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seg, audit, state) of (key, seg, audits, states), of each key from the first segment to the last: the audit from the state that is come to."""
    key, state = None, START
    for batch in batches:
        audits, before = [], []
        for own, each, states in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            if own != key:
                key, state = own, START
            audits.append(each[state])
            before.append(state)
            state = states[state]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(audits, pa.string()), pa.array(before, pa.int32())], ["key", "seg", "audit", "state"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seg, audits, states) of (key, seg, codes, after): from each of the four states before a segment."""
    for batch in batches:
        audits, states = [], []
        for codes, after in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            layers = Layers(_turns(codes), tuple(after))
            found = [layers.trace(s)[:2] for s in range(4)]
            audits.append([a for a, _ in found])
            states.append([s for _, s in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], ["key", "seg", "audits", "states"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seg, n, text) of (key, seg, rows, audit, state): the number of lines that stay of a segment, and these."""
    for batch in batches:
        counts, texts = [], []
        for rows, audit, state in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            i, out = 0, []
            for edit in audit:
                if edit == "I":
                    out.append(f"{SET_ROLE[state]}:")
                    state = SET[state]
                    continue
                if edit != "D":
                    role, text = rows[i]["role"], rows[i]["text"]
                    out.append(f"{role if edit == 'K' else SET_ROLE[state]}:{text}")
                    state = NEXT[role[:1]][state] if edit == "K" else SET[state]
                i += 1
            counts.append(len(out))
            texts.append("\n".join(out))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], ["key", "seg", "n", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, repaired_sha256) of sorted (key, seg, n, text), which pass by one after the other."""
    key, digest, begun, first = None, hashlib.sha256(), False, True
    for batch in batches:
        out = []
        for own, n, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            if first or own != key:
                if not first:
                    out.append((key, digest.hexdigest()))
                key, digest, begun, first = own, hashlib.sha256(), False, False
            if n:
                digest.update((("\n" if begun else "") + text).encode())
                begun = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out])], ["key", "repaired_sha256"])
    if not first:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])


def _in_segments(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, RESULT) of conversations whose rows (key, seg, at, ROW) are in several tasks or many."""
    whole = rows.select("key").distinct()
    rows = scratch.written(rows.where("NOT dropped").withColumn("code", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)), "turns")
    place = F.struct("seg", "at")
    again = rows.groupBy("key", "code").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.select("key", "code", "seg", "at").join(again, ["key", "code"]).where(place > F.col("first")).select("key", "seg", "at", F.lit(True).alias("later"))
    fault = F.when((F.col("fault") != "blank") & F.coalesce("later", F.lit(False)), "duplicate").otherwise(F.col("fault"))
    rows = scratch.written(rows.join(later, ["key", "seg", "at"], "left").withColumns({"fault": fault, "initial": F.substring("role", 1, 1)}).drop("later", "code"), "faults")

    # neighbours of segments meet in a window over the segments of a conversation, of which there is one for 512 turns
    sorted_rows = F.array_sort(F.collect_list(F.struct("at", "initial", "fault", "turn")))
    segments = rows.groupBy("key", "seg").agg(sorted_rows.alias("rows"), *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    different = F.size(F.array_distinct(F.filter(F.transform("rows", lambda x: x["turn"]), lambda x: x.isNotNull())))
    order = Window.partitionBy("key").orderBy("seg")
    first, last = F.col("rows")[0], F.element_at("rows", -1)
    pair = lambda a, b: ~F.concat(a, b).isin("su", "ua", "au")
    inside = F.size(F.filter(F.zip_with(F.slice("rows", 1, F.size("rows") - 1), F.slice("rows", 2, F.size("rows") - 1), lambda a, b: pair(a["initial"], b["initial"])), lambda x: x))
    before = F.lag(F.struct(last["initial"].alias("initial"), last["turn"].alias("turn"))).over(order)
    segments = segments.withColumn("before", before)
    across = F.coalesce(pair(F.col("before.initial"), first["initial"]).cast("int"), F.lit(0))
    shared = F.coalesce((F.col("before.turn") == first["turn"]).cast("int"), F.lit(0))
    segments = scratch.written(
        segments.select("key", "seg", "blank", "duplicate", "truncated", (inside + across).alias("illegal"), (different - shared).alias("turns"), F.array_min(F.transform("rows", lambda x: x["turn"])).alias("low"), last["turn"].alias("high"), _codes(F.col("rows")).alias("codes")),
        "segments",
    )
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    facts = segments.groupBy("key").agg(gaps, *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))

    # what follows a segment costs, from each state: the segments of a conversation pass by from the last to the first, then from the first on
    costs = segments.select("key", "seg", "codes").mapInArrow(_costs, "key string, seg long, costs array<long>")
    passing = lambda df, *order: df.repartition("key").sortWithinPartitions("key", *order)
    after = scratch.written(passing(costs, F.desc("seg")).mapInArrow(_backward, "key string, seg long, after array<long>, cost long"), "costs")
    traced = segments.join(after, ["key", "seg"]).select("key", "seg", "codes", "after").mapInArrow(_traced, "key string, seg long, audits array<string>, states array<int>")
    chosen = scratch.written(passing(traced, "seg").mapInArrow(_forward, "key string, seg long, audit string, state int"), "audits")
    audits = chosen.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    total = after.groupBy("key").agg(F.min_by("cost", "seg").alias("cost"))

    pieces = rows.groupBy("key", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("rows"))
    pieces = pieces.join(chosen, ["key", "seg"]).select("key", "seg", "rows", "audit", "state").mapInArrow(_kept, "key string, seg long, n int, text string")
    digests = passing(pieces, "seg").mapInArrow(_digests, "key string, repaired_sha256 string")
    found = facts.join(total, "key").join(audits, "key").join(digests, "key")
    # a conversation of which every row is dropped has no segment
    none = F.sha2(F.lit(""), 256)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.join(found, "key", "left").select("key", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows with the faults of their crc32; dropped ones stay as marks of their conversation."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    dropped = kind == 0
    return rows.select("conv_id", "turn", F.when(dropped, "").otherwise(role).alias("role"), F.when(dropped, "").otherwise(text).alias("text"), dropped.alias("dropped"), copies.alias("copy")).drop("copy")


def repaired(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of rows.

    rows: (conv_id, turn, role, text) and, if some rows only name their
    conversation, dropped. Turns are in order, nulls first, then by role and
    text. A null role or text is one space; a null conv_id is a conversation. A
    role counts by its first character, and one other than s, u and a can't
    stay. No rows give no rows; other columns don't matter.
    """
    scratch = Scratch(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    # characters other than the six of white space
    solid = F.translate("text", " \t\n\x0b\x0c\r", "")
    fault = F.when(solid == "", "blank").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    key = F.to_json(F.struct(F.col(conv_col).alias("id")))
    told = rows.select(key.alias("key"), F.col(conv_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), dropped.alias("dropped")).withColumn("fault", fault)
    order = ["key", F.asc_nulls_first("turn"), "role", "text"]
    passed = told.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "turn", "role", "text", "fault", "dropped")
    passed = passed.mapInArrow(_passing, f"key string, run int, at int, {ROW}, {RESULT}").withColumn("task", F.spark_partition_id())
    passed = scratch.written(passed, "passed")
    names = [x.split()[0] for x in RESULT.split(", ")]
    cut = passed.where("run IS NOT NULL").select("key", (F.col("task").cast("long") * 2**31 + F.col("run")).alias("seg"), "at", *(x.split()[0] for x in ROW.split(", ")))
    found = passed.where("run IS NULL").select("key", *names).unionByName(_in_segments(cut, scratch))
    kind = rows.schema[conv_col].dataType.simpleString()
    conv_id = F.from_json("key", f"id {kind}")["id"].alias(conv_col)
    return scratch.last(found.select(conv_id, *names), "repaired")
