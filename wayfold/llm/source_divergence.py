"""How far the sources of a language stand apart in their words, by tiles of group blocks.

Words are counted for each (lang, source) group, once in each Arrow batch
before anything is shuffled. Kept terms are dealt to vocabulary chunks by hash
and numbered in them; the counts of a group in a chunk are one packed vector.
Groups are dealt to blocks, and each vector is replicated to the tiles (block,
block) that its block takes part in. A tile reads its vectors chunk after chunk
and adds the chunk's differences to a submatrix of pairs, so that a task holds
one chunk of two blocks at a time, whatever the vocabulary. A tile of a large
vocabulary is several tasks (sections of chunks), whose submatrices are summed.

All arithmetic is on integers. A share floor(10^9 (c + 5) / d) is taken in
three steps of a thousand, exact for d below 9 * 10^15; beyond it is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.tables import Scratch
from wayfold.llm.wordcode import steps, text_bytes

LEAST_DOCS, RANKS, ADDED = 30, 50, 5
#: Terms of a chunk, groups of a block and chunks of a section: what a task holds, about, and reads at most.
CHUNK_TERMS, BLOCK_GROUPS, SECTION_CHUNKS = 2048, 32, 4
#: Counted terms of a task that make it send what it has, and bytes of a text that are split at a time.
HELD_TERMS, SLICE = 100_000, 1_000_000
MOST_TOTAL = 9 * 10**15

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _slices(text: bytes) -> Iterator[bytes]:
    """A text of words and spaces in parts that end between words."""
    at = 0
    while len(text) - at > SLICE:
        end = text.find(b" ", at + SLICE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of (lang, source, text); a group's presence is a row of the term ''."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (words, docs) in held.items():
            terms = [b"", *words]
            same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int32)))
            counts = [pa.array([0, *x], pa.int64()) for x in (words.values(), map(docs.__getitem__, words))]
            yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(terms, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for whole in batches:
        for batch in steps(whole, 2):
            data, offsets = text_bytes(batch.column(2))
            data = data.tobytes().translate(_LETTERS)
            for lang, source, start, stop in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words, docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for part in _slices(data[start:stop]):
                    found = part.split()
                    words.update(found)
                    seen.update(found)
                docs.update(seen)
            if sum(len(w) for w, _ in held.values()) > HELD_TERMS:
                yield from sent()
    yield from sent()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 5) / total), exactly."""
    div = lambda a, b: F.call_function("div", a, b)
    out, rest = F.lit(0).cast("long"), count + ADDED
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + div(rest, total), rest % total
    return out + 1


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    out, rest = np.zeros_like(counts), counts + ADDED
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // totals, rest % totals
    return out + 1


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, one, other, value) of vectors sorted by tile and chunk: the sum over a tile's chunks of |p - q| for each pair."""
    tile, chunk, held, sums = None, None, [], {}
    names: list[list[str]] = [[], []]

    def add() -> None:
        """The chunk that has been read goes into the submatrix."""
        nonlocal names
        parts = []
        for side in (0, 1):
            own = sorted((x for x in held if x[0] == side), key=lambda x: x[1])
            counts = np.zeros((len(own), held[0][3]), np.int64)
            for row, (_, _, _, _, at, n) in zip(counts, own, strict=True):
                row[at] = n
            totals = np.array([x[2] for x in own], np.int64)[:, None]
            parts.append(_shares(counts, np.maximum(totals, 1)) if counts.size else counts)
            names[side] = [x[1] for x in own]
        if tile[1] == tile[2]:
            parts[1], names[1] = parts[0], names[0]
        matrix = sums.setdefault("m", np.zeros((len(names[0]), len(names[1])), np.int64))
        for row, p in zip(matrix, parts[0], strict=True):
            row += np.abs(parts[1] - p).sum(axis=1)

    def done() -> pa.RecordBatch:
        same = tile[1] == tile[2]
        matrix = sums.pop("m")
        i, j = np.nonzero(np.triu(np.ones_like(matrix), 1)) if same else np.nonzero(np.ones_like(matrix))
        one, other = np.array(names[0], object)[i], np.array(names[1], object)[j]
        return pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(i), pa.string()), pa.array(one, pa.string()), pa.array(other, pa.string()), pa.array(matrix[i, j])], ["lang", "one", "other", "value"])

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(9)]
        # arrays are read as numpy, a row at a time
        ats, counts = batch.column(9), batch.column(10)
        for k, (lang, low, high, section, part, side, source, total, size) in enumerate(zip(*columns, strict=True)):
            if (lang, low, high, section) != tile or part != chunk:
                if held:
                    add()
                    held.clear()
                if tile is not None and (lang, low, high, section) != tile:
                    yield done()
                tile, chunk = (lang, low, high, section), part
            at, n = (x[k].values.to_numpy(zero_copy_only=False) if x[k].is_valid else np.zeros(0, np.int64) for x in (ats, counts))
            held.append((side, source, total, size, at, n))
    if held:
        add()
        yield done()


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, chunk_terms: int = CHUNK_TERMS, block_groups: int = BLOCK_GROUPS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) of docs.

    Null text, lang and source are ''. A document is a row, repeated ones each
    for itself. Terms are runs of letters and non-ASCII characters with A-Z
    lower-cased; a language keeps those of at least `least_docs` documents. Part
    'pair' has each other source of the language with the sum of |p - q| over
    its kept terms, 0 if it keeps none; part 'term' has the kept terms that the
    group holds and uses more than its language, up to `ranks`. Ranks are by
    value, then item. No rows give no rows; other columns of docs don't matter.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counted = scratch.written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")

    terms = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    terms = scratch.written(terms, "terms")
    langs = counted.select("lang").distinct().join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("lang_total", F.lit(0)) + ADDED * F.coalesce("v", F.lit(0))).alias("lang_total"))
    langs = langs.withColumn("lang_total", F.when(F.col("lang_total") < MOST_TOTAL, F.col("lang_total")).otherwise(F.raise_error(F.lit("too many words for exact shares"))))
    kept = scratch.written(counted.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counted.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang")
    groups = scratch.written(groups.select("lang", "source", "v", "lang_total", (F.coalesce("n", F.lit(0)) + ADDED * F.col("v")).alias("total")), "groups")

    # part 'term': the ranks wanted are cut to in each task before rows of a group meet
    own = kept.join(groups, ["lang", "source"]).withColumn("value", _share(F.col("n"), F.col("total")) - _share(F.col("lang_n"), F.col("lang_total")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.where("n > 0 AND value > 0").select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)

    # numbers of terms in their chunks, and a vector for each group and chunk, empty ones too
    chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / chunk_terms)).cast("int")
    in_chunk = Window.partitionBy("lang", "chunk")
    numbered = terms.join(langs.select("lang", chunks.alias("chunks")), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    # dealt by language and chunk: the join by language alone may put most terms into one task
    numbered = scratch.written(numbered.repartition("lang", "chunk").withColumn("at", (F.row_number().over(in_chunk.orderBy("term")) - 1).cast("long")).select("lang", "term", "chunk", "at"), "numbers")
    chunk_sizes = numbered.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size"))
    pack = kept.join(numbered, ["lang", "term"]).groupBy("lang", "source", "chunk").agg(F.collect_list("at").alias("ats"), F.collect_list("n").alias("counts"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block_groups).cast("int").alias("blocks"))
    slots = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    vectors = slots.join(chunk_sizes, ["lang", "chunk"], "left").join(pack, ["lang", "source", "chunk"], "left")

    # each vector goes to the tiles of its block: as the lower one, or as the higher one
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = vectors.withColumn("other", other).select(
        "lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("chunk") / SECTION_CHUNKS).cast("int").alias("section"), "chunk",
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "source", "total", F.coalesce("size", F.lit(0)).alias("size"), "ats", "counts",
    )
    tile = ["lang", "low", "high", "section"]
    sums = tiles.repartition(*tile).sortWithinPartitions(*tile, "chunk").mapInArrow(_tiles, "lang string, one string, other string, value long")
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.*", "value").withColumn("rank", F.row_number().over(best))

    out = pairs.withColumn("part", F.lit("pair")).unionByName(own.withColumn("part", F.lit("term")))
    return scratch.last(out.select("lang", "source", "part", "item", "value", "rank"), "divergence")
