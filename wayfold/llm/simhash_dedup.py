"""Near duplicates by SimHash: fingerprints of 64 bits that differ in few bits, found by anchors of a covering code.

The anchors are the words of a linear code of length 64: a subcode of the
second-order Reed-Muller code that holds the first-order one. That one has a
covering radius of 28, so no fingerprint is farther from its nearest anchor;
most are much nearer, the more anchors there are. The nearest anchor is a
fingerprint's home, at distance r, and it visits every anchor within r plus the
threshold. Of two fingerprints within the threshold let x be the one nearer to
its home c: then d(y, c) <= r(x) + threshold <= r(y) + threshold, so y visits
c, and comparing who lives at an anchor with who visits it misses no link.

Fingerprints are compared once however many documents share them. Homes and
visitors of an anchor are dealt to blocks, so a task compares a block with a
block; it hands on the links, or, of very many, links that join the same
fingerprints. Documents are never paired by equality.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.components import components
from wayfold.llm.tables import Scratch, id_and_text
from wayfold.llm.wordcode import text_bytes

SHINGLE, THRESHOLD, SEED = 4, 4, 42
#: Bits of an anchor's number: the code has 2^7 words at least, and 2^16 at most; about as many fingerprints call each anchor home.
LEAST_BITS, MOST_BITS, AT_HOME = 7, 16, 16
#: Fingerprints of a block of an anchor, on either side, those sent as one list, and shingles hashed at a time.
BLOCK, PACKED, STEP = 1024, 128, 50_000
#: A document without an id stands after all others.
NO_ID = 2**63 - 1

_FORM = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def _bits(text: bytes) -> tuple[int, np.ndarray]:
    """The number of shingles of a text of words parted by one space, and in how many of their hashes each bit is set."""
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, stops = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(text)]])
    n = max(1, len(starts) - SHINGLE + 1)
    ends = stops[min(SHINGLE, len(stops)) - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, STEP):
        hashes = np.array([digest(text[i:j], SEED) for i, j in zip(starts[k : min(k + STEP, n)].tolist(), ends[k : k + STEP].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return n, counts


def fingerprint(text: bytes) -> int:
    """The SimHash of a UTF-8 text, as a signed number of 64 bits."""
    text = text.translate(_FORM)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    text = text.strip(b" ")
    if not text:
        return 0
    n, counts = _bits(text)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, offsets = text_bytes(batch.column(1))
        prints = [fingerprint(whole[i:j].tobytes()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])


def _field() -> tuple[list[int], list[int]]:
    """Powers of a generator of the field of 64 elements (x^6 = x + 1), and their logarithms."""
    powers, logs, x = [], [0] * 64, 1
    for k in range(63):
        powers.append(x)
        logs[x] = k
        x = (x << 1) ^ (0b1000011 if x & 32 else 0)
    return powers, logs


@lru_cache
def anchors(bits: int) -> np.ndarray:
    """The 2^bits words of the code: truth tables, over the field of 64 elements, of 1, Tr(a x), Tr(b x^3) and Tr(c x^5)."""
    powers, logs = _field()

    def trace(x: int) -> int:
        total = 0
        for k in range(6):
            total ^= powers[logs[x] * 2**k % 63] if x else 0
        return total & 1  # 0 or 1 as an element

    basis = [2**64 - 1]
    for exponent in (1, 3, 5):
        for k in range(6):  # a, b, c: a basis of the field
            table = [trace(powers[(logs[x] * exponent + k) % 63]) if x else 0 for x in range(64)]
            basis.append(sum(bit << x for x, bit in enumerate(table)))
    words = np.zeros(1, np.uint64)
    for word in basis[:bits]:
        words = np.concatenate([words, words ^ np.uint64(word)])
    return words


def _visits(bits: int, threshold: int):
    """(anchor, home, prints): of each batch the fingerprints at home at an anchor, and those that visit it, in lists of PACKED at most."""

    def packed(prints: np.ndarray, anchor: np.ndarray, home: bool) -> pa.RecordBatch:
        order = np.argsort(anchor, kind="stable")
        prints, anchor = prints[order], anchor[order]
        at = np.arange(len(anchor))
        first = np.searchsorted(anchor, anchor)
        starts = np.flatnonzero((at - first) % PACKED == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(prints))
        return pa.RecordBatch.from_arrays([pa.array(anchor[starts].astype(np.int32)), pa.array([home] * len(starts), pa.bool_()), lists], ["anchor", "home", "prints"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = anchors(bits)
        size = max(1, 2**21 // len(code))
        for batch in batches:
            prints = batch.column(0).to_numpy()
            homes, who, where = [], [], []
            for k in range(0, len(prints), size):
                far = np.bitwise_count(prints[k : k + size].view(np.uint64)[:, None] ^ code[None, :])
                homes.append(far.argmin(axis=1))
                i, j = np.nonzero(far <= far.min(axis=1)[:, None] + threshold)
                who.append(i + k)
                where.append(j)
            if homes:
                yield packed(prints, np.concatenate(homes), True)
                yield packed(prints[np.concatenate(who)], np.concatenate(where), False)

    return run


def _joined(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows and columns of a matrix, numbered on from the rows.

    They are the matrix's own, or if these outnumber rows and columns, a link of
    each to the first row of its part.
    """
    n, m = near.shape
    if near.sum() <= n + m:
        i, j = np.nonzero(near)
        return i, j + n
    rows, before = np.arange(n), None
    while before is None or (rows != before).any():
        before = rows
        columns = np.where(near, rows[:, None], n).min(axis=0)
        rows = np.minimum(rows, np.where(near, columns[None, :], n).min(axis=1))
    linked = np.flatnonzero(columns < n)
    return np.concatenate([np.arange(n), linked + n]), np.concatenate([rows, columns[linked]])


def _links(threshold: int):
    def run(rows: pa.Table) -> pa.Table:
        home, prints = rows["home"], rows["prints"]
        h, v = (prints.filter(x).combine_chunks().flatten().to_numpy() for x in (home, pc.invert(home)))
        near = np.bitwise_count(h.view(np.uint64)[:, None] ^ v.view(np.uint64)[None, :]) <= threshold
        both = np.concatenate([h, v])
        u, w = (both[x] for x in _joined(near))
        return pa.table({"u": u[u != w], "v": w[u != w]})

    return run


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    A fingerprint is over the repeated four-word shingles of the lower-cased
    text (A-Z only; a shorter text is one shingle); a text without words, or a
    null one, has fingerprint zero and links like any other. component_id is the
    least doc_id that links of at most `threshold` bits reach, the row's own
    included. A null doc_id links too and is never the least; a component of
    only such rows has a null component_id. Repeated rows each give a row, and
    rows of one doc_id but other texts aren't linked by it. Other columns of
    docs don't matter; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, print long"), "prints")
    known = scratch.written(rows.groupBy("print").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("doc")), "known")
    count = known.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (max(count, 1) // AT_HOME).bit_length()))
    spread = known.select("print").repartition(max(1, min(count // 8000, 20_000)))
    visits = scratch.written(spread.mapInArrow(_visits(bits, threshold), "anchor int, home boolean, prints array<long>"), "visits")

    # at most 2^MOST_BITS rows: the blocks of each anchor
    blocks = lambda home: F.ceil(F.sum(F.when(F.col("home") == home, F.size("prints")).otherwise(0)) / BLOCK).cast("int")
    anchor_blocks = visits.groupBy("anchor").agg(blocks(True).alias("homes"), blocks(False).alias("visitors")).where("homes > 0")
    dealt = visits.join(F.broadcast(anchor_blocks), "anchor")
    own = lambda n: F.array(F.pmod(F.xxhash64("prints"), F.col(n)).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    low, high = F.when(F.col("home"), own("homes")).otherwise(each("homes")), F.when(F.col("home"), each("visitors")).otherwise(own("visitors"))
    tiles = dealt.withColumn("low", F.explode(low)).withColumn("high", F.explode(high))
    links = tiles.groupBy("anchor", "low", "high").applyInArrow(_links(threshold), "u long, v long")
    found = components(links, keep=scratch.written)
    # a component is named by its least fingerprint; what is wanted is its least document
    named = scratch.written(known.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", "doc", F.coalesce("component", "print").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    classes = scratch.written(named.join(least, "component").select("print", "least"), "classes")
    out = rows.join(classes, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.nullif("least", F.lit(NO_ID)).alias("component_id"))
    return scratch.last(out, "simhash")
