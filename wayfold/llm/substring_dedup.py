"""Removal of passages that an earlier document also holds, behind a count-min prefilter.

Pass one makes a count-min sketch of the windows of each partition and merges
them. A window is hashed into the sketch through the least of its shorter
grams, a function of the window alone, so that the overlapping windows of a
passage share few cells and a partition's sketch is small enough to ship as
sorted cells. Counts are overestimates: a window in two documents always has
an estimate of two or more. Pass two sends only windows with such an estimate
to an exact grouping by a 128-bit code, so none is lost, and what the sketch
overestimated costs time alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import id_and_text
from wayfold.llm.wordcode import BLANK_WORDS, U, grams, mixed, pieces, sliding_min, steps, words_of

#: Cells of a block of the sketch; their places in it fit 16 bits.
BLOCK = 1 << 16
#: Windows that a task holds before it hands them on, and that one exact group of windows should have.
HELD = 1_500_000
GROUPED = 750_000


def _anchors(codes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window the code of its least gram."""
    return sliding_min(grams(codes, gram), window - gram + 1)


def sketch_cells(anchors: np.ndarray, depth: int, width: int) -> list[np.ndarray]:
    """The cell of each code in each row of the sketch."""
    return [(mixed(anchors + U(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) & U(width - 1)).astype(np.int64) + k * width for k in range(depth)]


def over_one(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether the count of each cell of a merged sketch is over one."""
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)


def sketch_rows(parts: Iterator[tuple[np.ndarray, int]], depth: int, width: int) -> Iterator[pa.RecordBatch]:
    """A task's count-min sketch of codes, as sorted cells of count one and of count two or more, block by block.

    parts gives codes and how many windows they stand for; block -1 holds the sum of these.
    """
    held: list[np.ndarray] = []
    n_held = n_windows = 0

    def hand_on() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
        blocks, once, more = [-1], [b""], [n_windows.to_bytes(8, "little")]
        for cells in sketch_cells(values, depth, width):
            order = np.argsort(cells, kind="stable")
            cells, many = cells[order], counts[order] > 1
            same = np.flatnonzero(np.diff(cells, prepend=-1) != 0)
            if len(same):
                many = np.maximum.reduceat(many, same) | (np.diff(same, append=len(cells)) > 1)
            cells = cells[same]
            for a, b in pieces(np.flatnonzero(np.diff(cells // BLOCK, prepend=-1)), len(cells)):
                low = (cells[a:b] % BLOCK).astype(np.uint16)
                blocks.append(int(cells[a]) // BLOCK)
                once.append(low[~many[a:b]].tobytes())
                more.append(low[many[a:b]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "more"])

    for codes, n in parts:
        held.append(codes)
        n_held, n_windows = n_held + len(codes), n_windows + n
        if n_held > HELD:
            yield hand_on()
            held, n_held, n_windows = [], 0, 0
    yield hand_on()


def merged_sketch(rows: DataFrame, depth: int, width: int) -> tuple[np.ndarray, int]:
    """(a bit for each cell of the merged sketch: its count is over one; the number of windows).

    Its size is depth * width bits whatever the input; the driver gathers it.
    """

    def merge(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        if block < 0:
            n = sum(int.from_bytes(b, "little") for b in rows.column("more").to_pylist())
            return pa.table({"block": pa.array([block], pa.int64()), "bits": pa.array([n.to_bytes(8, "little")], pa.binary())})
        total = np.zeros(BLOCK, np.int32)
        for once, more in zip(rows.column("once").to_pylist(), rows.column("more").to_pylist(), strict=True):
            total[np.frombuffer(once, np.uint16)] += 1
            total[np.frombuffer(more, np.uint16)] += 2
        return pa.table({"block": pa.array([block], pa.int64()), "bits": pa.array([np.packbits(total > 1).tobytes()], pa.binary())})

    bits = np.zeros(depth * width // 8, np.uint8)
    n_windows = 0
    for row in rows.groupBy("block").applyInArrow(merge, "block long, bits binary").collect():
        if row["block"] < 0:
            n_windows = int.from_bytes(row["bits"], "little")
        else:
            bits[row["block"] * BLOCK // 8 :][: BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits, n_windows


SKETCH_SCHEMA = "block long, once binary, more binary"
RUN_SCHEMA = "share long, doc_id binary, text_code binary, start binary, length binary"
TEXT_SCHEMA = "doc_id long, text_code long, starts binary, lengths binary"


def pack_by_document(doc: np.ndarray, code: np.ndarray, start: np.ndarray, length: np.ndarray, groups: int) -> pa.Table:
    """Runs as one row for each share of the documents, so that rows don't multiply by documents and groups."""
    share = (mixed(doc.astype(U)) % U(groups)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    parts = pieces(np.flatnonzero(np.diff(share[order], prepend=-1)), len(order))
    columns = [pa.array([x[order[i:j]].tobytes() for i, j in parts], pa.binary()) for x in (doc, code, start.astype(np.int32), length.astype(np.int32))]
    return pa.table([pa.array([int(share[order[i]]) for i, _ in parts], pa.int64()), *columns], names=["share", "doc_id", "text_code", "start", "length"])


def unpack_by_document(table: pa.Table) -> pa.Table:
    """One row of runs for each text of a share."""
    doc, code, start, length = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("doc_id", np.int64), ("text_code", np.int64), ("start", np.int32), ("length", np.int32)))
    order = np.lexsort((start, code, doc))
    doc, code, start, length = doc[order], code[order], start[order], length[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    parts = pieces(np.flatnonzero(new), len(doc))
    at = [i for i, _ in parts]
    return pa.table([pa.array(doc[at]), pa.array(code[at]), *(pa.array([x[i:j].tobytes() for i, j in parts], pa.binary()) for x in (start, length))], names=["doc_id", "text_code", "starts", "lengths"])


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of consecutive numbers in a sorted array."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
    return at[cut], np.diff(cut, append=len(at))


def repeated_windows(docs: DataFrame, window: int, gram: int, depth: int, width: int) -> DataFrame:
    """(doc_id, text_code, starts, lengths): runs of windows that start in a document of a smaller id as well.

    One row for each text of a document; its runs may overlap.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        for whole in batches:
            for batch in steps(whole, 1):
                words = words_of(batch.column(1), BLANK_WORDS)
                full = words.left()[: max(0, len(words.starts) - window + 1)] >= window
                anchors = _anchors(words.codes[0], window, gram)
                at = np.flatnonzero(full)
                text = words.text_of()
                new = np.ones(len(at), bool)
                new[1:] = (anchors[at[1:]] != anchors[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
                yield anchors[at[new]], len(at)

    bits, n_windows = merged_sketch(docs.select("doc_id", "text").mapInArrow(lambda batches: sketch_rows(counted(batches), depth, width), SKETCH_SCHEMA), depth, width)
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    groups = max(1, -(-n_windows // GROUPED))
    schema = "bucket long, doc_id long, text_code long, first binary, second binary, owner binary, place binary, owners binary, owner_codes binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 6

    def rows(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.uint8)
        held: list[list[np.ndarray]] = []
        ids: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        n_held = n_texts = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, codes, n_held, n_texts
            if held:
                first, second, owner, place = (np.concatenate(x) for x in zip(*held, strict=True))
                doc, code = np.concatenate(ids), np.concatenate(codes)
                order = np.lexsort((doc[owner], second, first))
                first, second, owner, place = first[order], second[order], owner[order], place[order]
                new = np.ones(len(first), bool)
                new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                least = doc[owner][np.flatnonzero(new)][np.cumsum(new) - 1]
                mine = doc[owner] == least
                # a copy of a smaller id is in hand: this one's fate is known
                gone = np.flatnonzero(~mine)
                gone = gone[np.lexsort((place[gone], owner[gone]))]
                out: list[list] = [[] for _ in kinds]
                cut = np.flatnonzero(np.diff(owner[gone], prepend=-1))
                for a, b in pieces(cut, len(gone)):
                    o = int(owner[gone[a]])
                    start, length = _runs(np.unique(place[gone[a:b]]))
                    for column, v in zip(out, (o % groups, int(doc[o]), int(code[o]), start.astype(np.int32).tobytes(), length.astype(np.int32).tobytes(), None, None, None, None), strict=True):
                        column.append(v)
                yield rows(out)
                first, second, owner, place = first[mine], second[mine], owner[mine], place[mine]
                bucket = (first % U(groups)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                out = [[] for _ in kinds]
                for a, b in pieces(cut, len(order)):
                    part = order[a:b]
                    owners, local = np.unique(owner[part], return_inverse=True)
                    for column, v in zip(out, (int(bucket[part[0]]), None, None, first[part].tobytes(), second[part].tobytes(), local.astype(np.int32).tobytes(), place[part].astype(np.int32).tobytes(), doc[owners].tobytes(), code[owners].tobytes()), strict=True):
                        column.append(v)
                yield rows(out)
            held, ids, codes, n_held, n_texts = [], [], [], 0, 0

        for whole in batches:
            for batch in steps(whole, 1):
                words = words_of(batch.column(1), BLANK_WORDS, 2)
                full = words.left()[: max(0, len(words.starts) - window + 1)] >= window
                anchors = _anchors(words.codes[0], window, gram)
                for cells in sketch_cells(anchors, depth, width):
                    full &= over_one(known, cells)
                at = np.flatnonzero(full)
                text = words.text_of()[at]
                one, two = (grams(words.codes[k], window, k)[at] for k in (0, 1))
                held.append([one, two, text + n_texts, at - words.ends_at[text]])
                ids.append(batch.column(0).to_numpy(zero_copy_only=False))
                codes.append(batch.column(2).to_numpy(zero_copy_only=False))
                n_held, n_texts = n_held + len(at), n_texts + batch.num_rows
                if n_held > HELD:
                    yield from hand_on()
        yield from hand_on()

    def group(table: pa.Table) -> pa.Table:
        """Exact groups of equal windows: all but those of the least document go, as runs."""
        held, known = [], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for row in table.to_pylist():
            if row["owner"] is None:
                start, length = np.frombuffer(row["first"], np.int32), np.frombuffer(row["second"], np.int32)
                known.append((np.full(len(start), row["doc_id"]), np.full(len(start), row["text_code"]), start, length))
            else:
                owner = np.frombuffer(row["owner"], np.int32)
                held.append((np.frombuffer(row["first"], U), np.frombuffer(row["second"], U), np.frombuffer(row["owners"], np.int64)[owner], np.frombuffer(row["owner_codes"], np.int64)[owner], np.frombuffer(row["place"], np.int32)))
        if held:
            first, second, doc, code, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, second, first))
            new = np.ones(len(order), bool)
            new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
            least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = order[doc[order] > least]
            gone = gone[np.lexsort((place[gone], code[gone], doc[gone]))]
            doc, code, place = doc[gone], code[gone], place[gone]
            new = np.ones(len(gone), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]) | (np.diff(place) > 1)
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(gone))[: len(at)] - 1
            known.append((doc[at], code[at], place[at], (place[last] - place[at] + 1).astype(np.int32)))
        return pack_by_document(*(np.concatenate(x) for x in zip(*known, strict=True)), groups)

    found = docs.select("doc_id", "text", "text_code").mapInArrow(candidates, schema)
    runs = found.groupBy("bucket").applyInArrow(group, RUN_SCHEMA)
    return runs.groupBy("share").applyInArrow(unpack_by_document, TEXT_SCHEMA)


SCHEMA = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 6, depth: int = 2, width: int = 1 << 27, with_text: bool = True
) -> DataFrame:
    """One row for each row of docs: its words, how many of them go, and what is kept.

    A word goes if a window of `window` consecutive words covers it whose word
    sequence also starts in a document of a smaller id. Words are runs without
    white space and stay as they are; kept words are joined by one space.

    Null and empty texts have no words and the digest of the empty string.
    Texts with fewer words than a window lose none. Rows of one id don't remove
    each other's windows; identical rows get identical results. Rows of null id
    take no part and lose nothing. An empty table gives an empty one. Other
    columns are not read. with_text=False leaves kept null.

    width and depth size the sketch (width: a power of two of at least 65536);
    a small one lets more windows through to the exact grouping, never fewer.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_code", F.coalesce(F.xxhash64("text"), F.lit(0)))
    runs = repeated_windows(rows.where(F.col("doc_id").isNotNull()), window, gram, depth, width)
    joined = rows.join(runs.hint("shuffle_hash"), ["doc_id", "text_code"], "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, 1):
                words = words_of(batch.column(1), BLANK_WORDS, 0)
                data = words.data.tobytes()
                counts, gone, kept = words.counts, [], []
                for i, (runs, sizes) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    a, b = int(words.ends_at[i]), int(words.ends_at[i + 1])
                    stay = np.ones(b - a, bool)
                    if runs:
                        edge = np.zeros(b - a + 1, np.int32)
                        start = np.frombuffer(runs, np.int32)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + np.frombuffer(sizes, np.int32) + (window - 1), -1)
                        stay = np.cumsum(edge[:-1]) == 0
                    at = np.flatnonzero(stay) + a
                    kept.append(b" ".join([data[s:e] for s, e in zip(words.starts[at].tolist(), words.stops[at].tolist(), strict=True)]))
                    gone.append(b - a - len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array([k.decode() if with_text else None for k in kept], pa.string()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    return joined.select("doc_id", "text", "starts", "lengths").mapInArrow(keep, SCHEMA)
