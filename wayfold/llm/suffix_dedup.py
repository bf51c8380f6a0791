"""Removal of byte strings that occur earlier in the collection, by column-wise suffix sorting.

Each 100-byte string is named by its anchor, the least code of the shorter
grams in it, so equal strings have equal anchors. A count-min sketch of anchor
occurrences, merged over all tasks, leaves the strings whose anchor may occur
twice; a run of them under one anchor is a segment. Segments are dealt by
anchor, and in each group the Burrows-Wheeler transform and the common
prefixes of the collection of its distinct segments that may share a string are
built column by column (others are settled by their own places): every round puts one more symbol of each segment in
front of its suffix and inserts the new suffixes into the sorted order. The
order lives in files that a round reads and writes from front to back through
a buffer. Suffixes with a common prefix of 100 bytes are one string; of all
the places of their segments, the earliest stays.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.substring_dedup import RUN_SCHEMA, SKETCH_SCHEMA, TEXT_SCHEMA, merged_sketch, over_one, pack_by_document, sketch_cells, sketch_rows, unpack_by_document
from wayfold.llm.tables import id_and_text
from wayfold.llm.wordcode import BYTE_CODES, U, mixed, pieces, powers, sliding_min, steps, text_bytes

#: Bytes of text in a step; segments that a task holds; anchor occurrences for which there is one group.
STEP = 1_000_000
HELD = 300_000
GROUPED = 200_000
#: Segments that are sorted together, at least; the segments of an anchor always are.
SORTED = 1000
#: Suffixes of the sorted order that a round reads or writes at once, of eight bytes each.
BUFFER = 1 << 15
SUFFIX = np.dtype([("symbol", "u1"), ("common", "u1"), ("length", "u2"), ("string", "u4")])


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    up, _ = powers(which, len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODES[which][data] * up[: len(data)], out=total[1:])
    return total


def _codes(total: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice, which: int) -> np.ndarray:
    return mixed((total[stop] - total[start]) * powers(which, len(total))[1][: len(total)][start])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of grams, anchors of windows, which windows lie in one text, prefix sums)."""
    total = _sums(data, 0)
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool), total
    codes = _codes(total, slice(0, len(data) - gram + 1), slice(gram, len(data) + 1), 0)
    least = sliding_min(codes, window - gram + 1)
    full = np.zeros(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        full[a : max(a, b - window + 1)] = True
    return codes, least, full, total


def occurrences(codes: np.ndarray, least: np.ndarray, full: np.ndarray, width: int) -> np.ndarray:
    """The codes at all places of grams that are the anchor of some window; each place once."""
    best = np.concatenate([np.zeros(width - 1, U), np.where(full, least, U(0)), np.zeros(width - 1, U)])
    # the greatest anchor of the windows that hold a gram is its own code if it is any's
    return codes[~sliding_min(~best, width) == codes]


class Order:
    """The sorted suffixes of a collection, in two files by turns: whose each is, how long, the symbol before it and its common prefix with the one before.

    Rounds read and write `buffer` suffixes at a time. The order only grows, so
    that a file is written over and never cut.
    """

    def __init__(self, files: list[BinaryIO], buffer: int):
        self.files, self.buffer, self.turn, self.size = files, buffer, 0, 0
        #: How often each symbol stands in the order.
        self.count = np.zeros(256, np.int64)

    def chunks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first, suffixes), from front to back."""
        file = self.files[self.turn % 2]
        file.seek(0)
        for at in range(0, self.size, self.buffer):
            part = np.empty(min(self.buffer, self.size - at), SUFFIX)
            file.readinto(memoryview(part.view(np.uint8)))
            yield at, part

    def insert(self, to: np.ndarray, new: np.ndarray, changed: np.ndarray, common: np.ndarray) -> None:
        """Write the order with new suffixes at places `to` of the result, and other common prefixes of the suffixes at places `changed` now."""
        file = self.files[(self.turn + 1) % 2]
        file.seek(0)
        before = to - np.arange(len(to))
        done = 0
        for at, part in self.chunks():
            a, b = np.searchsorted(changed, [at, at + len(part)])
            part["common"][changed[a:b] - at] = common[a:b]
            upto = int(np.searchsorted(before, at + len(part)))
            file.write(memoryview(np.insert(part.view(np.uint64), before[done:upto] - at, new[done:upto].view(np.uint64)).view(np.uint8)))
            done = upto
        file.write(memoryview(new[done:].view(np.uint8)))
        self.turn, self.size = self.turn + 1, self.size + len(to)
        self.count += np.bincount(new["symbol"], minlength=256)


def _least_between(common: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of common[low:high], for all pairs."""
    if not len(low):
        return np.zeros(0, np.uint8)
    first = np.argsort(low, kind="stable")
    out = np.empty(len(low), np.uint8)
    out[first] = np.minimum.reduceat(np.append(common, np.uint8(255)), np.stack([low[first], high[first]], 1).ravel())[::2]
    return out


def _places(order: Order, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the suffixes at `at`, in order, and the symbols before them: (how often a symbol stands before its place,
    the least common prefix since the last place of the symbol, the least up to the next one).

    One pass. Between chunks only the least common prefix since each symbol's
    last place is kept, and which suffix still waits for the next one.
    """
    seen, since = np.zeros(256, np.int64), np.full(256, 255, np.uint8)
    waiting = np.full(256, -1)
    nth, back, ahead = np.empty(len(at), np.int64), np.empty(len(at), np.uint8), np.full(len(at), 255, np.uint8)
    for start, part in order.chunks():
        symbol, common = np.ascontiguousarray(part["symbol"]), np.ascontiguousarray(part["common"])
        by = np.argsort(symbol, kind="stable")
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        here = np.bincount(symbol, minlength=256)
        first = np.cumsum(here) - here
        # few places are wanted, so ranges are gone through for these and not added up for all
        until = lambda stop: _least_between(common, np.zeros(len(stop), np.int64), stop)  # noqa: E731, B023
        since_then = lambda begin: _least_between(common, begin, np.full(len(begin), len(common)))  # noqa: E731, B023
        whole = common.min()
        some = here > 0
        # who waits for a symbol that stands here has its next place
        waits = np.flatnonzero(waiting >= 0)
        met = waits[some[waits]]
        ahead[waiting[met]] = np.minimum(ahead[waiting[met]], until(by[first[met]] + 1))
        waiting[met] = -1
        waits = waits[~some[waits]]
        ahead[waiting[waits]] = np.minimum(ahead[waiting[waits]], whole)
        i, j = np.searchsorted(at, [start, start + len(part)])
        p, c = at[i:j] - start, own[i:j]
        r = rank[p]
        nth[i:j] = seen[c] + r - first[c]
        inside = r > first[c]
        back[i:j][~inside] = np.minimum(since[c[~inside]], until(p[~inside] + 1))
        back[i:j][inside] = _least_between(common, by[r[inside] - 1] + 1, p[inside] + 1)
        inside = r + 1 < first[c] + here[c]
        ahead[i:j][inside] = _least_between(common, p[inside] + 1, by[r[inside] + 1] + 1)
        last = np.flatnonzero(~inside)
        ahead[i:j][last] = since_then(p[last] + 1)
        waiting[c[last]] = i + last
        seen += here
        since = np.minimum(since, whole)
        since[some] = since_then(by[(first + here - 1)[some]] + 1)
    return nth, back, ahead


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, buffer: int = BUFFER) -> Iterator[np.ndarray]:
    """All suffixes of strings of at most 255 bytes, in order, `buffer` at a time: string, length, common prefix with the suffix before.

    Equal suffixes are in the order of their strings. Round r puts the r-th
    symbol from the end of each string that has one in front of its suffix.
    The place of c + S among the suffixes that begin with c is the number of
    symbols c before S in the transform; its common prefix with the c + S'
    before it is one more than the least between S' and S. Beside the strings,
    memory holds some 60 bytes for each string and 40 for each suffix of the
    buffer; the order itself is in files.
    """
    n = len(starts)
    size = stops - starts

    def suffixes(who: np.ndarray, length: int, common: np.ndarray) -> np.ndarray:
        """The symbol before a suffix is a byte plus one (255 is no byte of UTF-8), or 0 where it is the whole string."""
        out = np.zeros(len(who), SUFFIX)
        out["string"], out["length"], out["common"] = who, length, common
        if len(data):
            out["symbol"] = np.where(size[who] > length, data[np.maximum(stops[who] - length - 1, 0)] + np.uint8(1), np.uint8(0))
        return out

    with tempfile.TemporaryFile() as one, tempfile.TemporaryFile() as two:
        order = Order([one, two], buffer)
        at = np.arange(n)
        new = suffixes(at, 0, np.zeros(n, np.uint8))
        order.insert(at, new, at[:0], at[:0])
        for r in range(1, int(size.max(initial=0)) + 1):
            going = new["symbol"] > 0
            at, who, own = at[going], new["string"][going], new["symbol"][going].astype(np.int64)
            nth, back, ahead = _places(order, at, own)
            follows, leads = nth > 0, nth + 1 < order.count[own]
            # suffixes by their first symbol: the n empty ones, then those behind each symbol but the ends
            to = n + (np.cumsum(order.count) - order.count - order.count[0])[own] + nth
            by = np.argsort(to, kind="stable")
            at, new = to[by], suffixes(who[by], r, np.where(follows, back + np.uint8(1), np.uint8(0))[by])
            # an old suffix that comes to stand behind a new one has a new common prefix too
            behind, common = at[leads[by]] + 1, (ahead + np.uint8(1))[by][leads[by]]
            slot = np.searchsorted(at, behind)
            old = at[np.minimum(slot, len(at) - 1)] != behind
            order.insert(at, new, (behind - slot)[old], common[old])
        for _, part in order.chunks():
            yield part


def may_share(strings: list[bytes], anchor: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Which distinct strings can have a window in common with another one, or twice, given the anchor of all windows of each.

    Around the anchor that equal windows hold, the half of their other bytes
    before it or the half behind it is equal too.
    """
    half = -(-(window - gram) // 2)
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings], np.int64)
    if len(data) < gram:
        return np.zeros(len(strings), bool)
    stops = np.cumsum(size)
    total = _sums(data, 0)
    owner = np.repeat(np.arange(len(strings)), size)[: len(data) - gram + 1]
    places = np.flatnonzero(_codes(total, slice(0, len(data) - gram + 1), slice(gram, len(data) + 1), 0) == anchor[owner])
    own = owner[places]
    keys, whose = [], []
    for side, begin, end in ((U(1), places - half, places + gram), (U(2), places, places + gram + half)):
        inside = (begin >= (stops - size)[own]) & (end <= stops[own])
        keys.append(mixed(_codes(total, begin[inside], end[inside], 0) ^ side))
        whose.append(own[inside])
    _, which, shared = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    found = np.zeros(len(strings), bool)
    found[np.concatenate(whose)[shared[which] > 1]] = True
    return found


def _repeats(parts: Iterator[np.ndarray], window: int, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of equal windows, string, length) of the windows that occur twice: in two suffixes, or in one of a string of many occurrences."""
    kept, held, count = [np.zeros(0, SUFFIX)], np.zeros(0, SUFFIX), 0
    groups = [np.zeros(0, np.int64)]
    for part in chain(parts, [None]):
        last = part is None
        # a shorter suffix between two has less in common with the second than a window, and so have they
        part = held if last else np.concatenate([held, part[part["length"] >= window]])
        if not len(part):
            continue
        same = part["common"] >= window
        group = count + np.cumsum(~same)
        twice = many[part["string"]] | same
        twice[:-1] |= same[1:]
        # the last one's like may open the next part
        done = len(part) if last else len(part) - 1
        count = int(group[done - 1]) if done else count
        kept.append(part[:done][twice[:done]])
        groups.append(group[:done][twice[:done]])
        held = part[done:]
    found = np.concatenate(kept)
    return np.concatenate(groups), found["string"].astype(np.int64), found["length"].astype(np.int64)


def _string_runs(string: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, length) of the runs of consecutive offsets."""
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    new = np.ones(len(order), bool)
    new[1:] = (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(new)
    return string[at], offset[at], np.diff(at, append=len(order))


def repeated_strings(docs: DataFrame, window: int, gram: int, depth: int, width: int) -> DataFrame:
    """(doc_id, text_code, starts, lengths): runs of windows of bytes that start earlier as well; one row for each text."""
    spread = window - gram + 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        for whole in batches:
            for batch in steps(whole, 1, STEP):
                codes, least, full, _ = anchors(*text_bytes(batch.column(1)), window, gram)
                found = occurrences(codes, least, full, spread) if len(least) else codes
                yield found, len(found)

    bits, n_places = merged_sketch(docs.select("doc_id", "text").mapInArrow(lambda batches: sketch_rows(places(batches), depth, width), SKETCH_SCHEMA), depth, width)
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    groups = max(1, -(-n_places // GROUPED))
    names = ["bucket", "doc_id", "text_code", "start", "member", "size", "anchor", "data"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.uint8)
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[list[bytes]] = []
        n_held = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            """Segments by group: the bytes of each distinct one, and which of these stands at which place."""
            nonlocal held, texts, n_held
            if held:
                anchor, doc, code, start, size, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
                data = [s for part in texts for s in part]
                order = np.lexsort((size, two, one))
                new = np.ones(len(order), bool)
                new[1:] = False
                for x in (one, two, size):
                    new[1:] |= x[order[1:]] != x[order[:-1]]
                which, shown = np.empty(len(order), np.int64), np.zeros(len(order), bool)
                which[order], shown[order[new]] = np.cumsum(new), True
                bucket = (anchor % U(groups)).astype(np.int64)
                order = np.lexsort((which, ~shown, bucket))
                columns: list[list] = [[] for _ in names]
                for a, b in pieces(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)):
                    part = order[a:b]
                    distinct = part[shown[part]]
                    member = np.searchsorted(which[distinct], which[part]).astype(np.int32)
                    values = (doc[part], code[part], start[part].astype(np.int32), member, size[distinct].astype(np.uint8), anchor[distinct])
                    for column, v in zip(columns, (int(bucket[part[0]]), *(x.tobytes() for x in values), b"".join([data[i] for i in distinct.tolist()])), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)
            held, texts, n_held = [], [], 0

        for whole in batches:
            for batch in steps(whole, 1, STEP):
                data, offsets = text_bytes(batch.column(1))
                _, least, full, total = anchors(data, offsets, window, gram)
                for cells in sketch_cells(least, depth, width):
                    full &= over_one(known, cells)
                at = np.flatnonzero(full)
                if not len(at):
                    continue
                text = np.searchsorted(offsets, at, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (text[1:] != text[:-1]) | (least[at[1:]] != least[at[:-1]])
                # an anchor's run is no longer than its spread unless the text is periodic; then it is cut
                begin = np.flatnonzero(new)
                inside = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
                begin = np.flatnonzero(inside % spread == 0)
                count = np.diff(begin, append=len(at))
                first = at[begin]
                size = count + window - 1
                second = _sums(data, 1)
                owner = text[begin]
                held.append(
                    (least[first], batch.column(0).to_numpy(zero_copy_only=False)[owner], batch.column(2).to_numpy(zero_copy_only=False)[owner], first - offsets[owner], size, _codes(total, first, first + size, 0), _codes(second, first, first + size, 1))
                )
                raw = data.tobytes()
                texts.append([raw[s : s + k] for s, k in zip(first.tolist(), size.tolist(), strict=True)])
                n_held += len(first)
                if n_held > HELD:
                    yield from hand_on()
        yield from hand_on()

    def group(table: pa.Table) -> pa.Table:
        """All windows of the group's segments but the earliest of each, as runs."""
        places_, anchors_ = [], []
        known: dict[bytes, int] = {}
        for row in table.to_pylist():
            size = np.frombuffer(row["size"], np.uint8).astype(np.int64)
            stop = np.cumsum(size)
            before = len(known)
            which = np.array([known.setdefault(row["data"][e - s : e], len(known)) for s, e in zip(size.tolist(), stop.tolist(), strict=True)], np.int64)
            anchors_.append(np.frombuffer(row["anchor"], U)[which >= before])
            places_.append((which[np.frombuffer(row["member"], np.int32)], *(np.frombuffer(row[c], kind) for c, kind in (("doc_id", np.int64), ("text_code", np.int64), ("start", np.int32)))))
        distinct, anchor = list(known), np.concatenate(anchors_)
        # the places of each distinct segment, the earliest first; rows that repeat a document are one place
        segment, doc, code, start = (np.concatenate(x) for x in zip(*places_, strict=True))
        order = np.lexsort((start, code, doc, segment))
        segment, doc, code, start = (x[order] for x in (segment, doc, code, start))
        new = np.ones(len(order), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]) | (start[1:] != start[:-1])
        segment, doc, code, start = (x[new] for x in (segment, doc, code, start))
        times = np.bincount(segment, minlength=len(distinct))
        first = np.cumsum(times) - times
        share = may_share(distinct, anchor, window, gram)
        use = np.flatnonzero(share)
        # whole anchors at a time
        _, by_anchor = np.unique(anchor, return_inverse=True)
        use = use[np.argsort(by_anchor[use], kind="stable")]
        ends = np.flatnonzero(np.diff(by_anchor[use], append=-1))
        found = []

        def but_first(who: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
            """Runs of windows of segments go at all places of these but the first."""
            others = times[who] - 1
            nth = np.arange(others.sum()) - np.repeat(np.cumsum(others) - others, others)
            found.append((np.repeat(first[who] + 1, others) + nth, np.repeat(at, others), np.repeat(count, others)))

        # what has no string in common with another segment is settled by its own places
        alone = np.flatnonzero((times > 1) & ~share)
        but_first(alone, np.zeros(len(alone), np.int64), np.array([len(distinct[k]) for k in alone.tolist()], np.int64) - window + 1)
        begin = 0
        for end in (ends + 1).tolist():
            if end - begin < SORTED and end < len(use):
                continue
            part = use[begin:end]
            begin = end
            size = np.array([len(distinct[k]) for k in part.tolist()], np.int64)
            stops = np.cumsum(size)
            data = np.frombuffer(b"".join([distinct[k] for k in part.tolist()]), np.uint8)
            equal, string, length = _repeats(sorted_suffixes(data, stops - size, stops), window, times[part] > 1)
            offset, string = size[string] - length, part[string]
            # at the earliest place of equal windows only the places behind it go, at others all
            by = np.lexsort((start[first[string]] + offset, code[first[string]], doc[first[string]], equal))
            later = by[1:][equal[by][1:] == equal[by][:-1]]
            who, at, count = _string_runs(string[later], offset[later])
            found.append((first[who], at, count))
            again = times[string] > 1
            but_first(*_string_runs(string[again], offset[again]))
        place, at, count = (np.concatenate(x) for x in zip(*found, strict=True))
        return pack_by_document(doc[place], code[place], start[place] + at, count, groups)

    found = docs.select("doc_id", "text", "text_code").mapInArrow(candidates, "bucket long, doc_id binary, text_code binary, start binary, member binary, size binary, anchor binary, data binary")
    runs = found.groupBy("bucket").applyInArrow(group, RUN_SCHEMA)
    return runs.groupBy("share").applyInArrow(unpack_by_document, TEXT_SCHEMA)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, gram: int = 32, depth: int = 2, width: int = 1 << 27, with_bytes: bool = True) -> DataFrame:
    """One row for each row of docs: its bytes, how many go and in how many runs, and what is kept.

    A byte goes if a string of `window` bytes covers it that also starts
    earlier: in a text of a smaller doc_id, or in the same text at an earlier
    byte. Matches lie in one text each; kept bytes may break a UTF-8 character.

    Null and empty texts have no bytes and the digest of nothing; shorter texts
    than a window lose none. Rows that share an id are ordered by a hash of
    their text; identical rows count as one text and get identical results.
    Rows of null id take no part and lose nothing. An empty table gives an
    empty one; other columns are not read. with_bytes=False leaves kept null.
    width and depth size the sketch, as in substring_dedup. window is at most
    (255 + gram) // 2.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_code", F.coalesce(F.xxhash64("text"), F.lit(0)))
    runs = repeated_strings(rows.where(F.col("doc_id").isNotNull()), window, gram, depth, width)
    joined = rows.join(runs.hint("shuffle_hash"), ["doc_id", "text_code"], "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, 1):
                data, offsets = text_bytes(batch.column(1))
                kept, spans = [], []
                for i, (starts, lengths) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    own = data[offsets[i] : offsets[i + 1]]
                    n = 0
                    if starts:
                        edge = np.zeros(len(own) + 1, np.int32)
                        start = np.frombuffer(starts, np.int32)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + np.frombuffer(lengths, np.int32) + (window - 1), -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        n = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) > 0))
                        own = own[~gone]
                    kept.append(own.tobytes())
                    spans.append(n)
                sizes = np.diff(offsets)
                columns = [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(sizes - np.array([len(k) for k in kept], np.int64), pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array([k if with_bytes else None for k in kept], pa.binary()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return joined.select("doc_id", "text", "starts", "lengths").mapInArrow(keep, SCHEMA)
