"""Exact top-k search by distributed histogram selection.

Vectors are packed into matrices, one row of a table for each. Queries are
numbered and taken in blocks of consecutive numbers, whatever their ids, so a
block's size is bounded; it goes to every task, which scores it
against its matrices. Where each query's k-th best score lies is found by
histograms: all tasks count scores in equal bins, the sums name the bin that
holds the k-th best, and the next round divides that bin, until it is one
score wide. A last pass keeps what scores more, and of what scores the same
the smallest ids that are still needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.tables import Scratch

#: Queries in a block, and components of a block's matrix, at most (a longer single vector aside).
BLOCK_QUERIES = 2048
BLOCK_CELLS = 8_000_000
BINS = 1 << 12
PACKED_ROWS = 4096
#: Scores that a task holds at once.
TILE = 4_000_000


def _packed(vectors: DataFrame, scale: int) -> DataFrame:
    """(size, ids, cells, top): matrices of floor(scale * x), by vector length; top is the greatest magnitude."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PACKED_ROWS):
                batch = whole.slice(start, PACKED_ROWS)
                batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
                vector, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = pc.list_value_length(vector).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.list_flatten(vector).to_numpy(zero_copy_only=False).astype(np.float64)
                fine = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)], minlength=len(sizes)) == 0
                at = np.cumsum(sizes) - sizes
                for size in np.unique(sizes[fine]).tolist():
                    of = np.flatnonzero(fine & (sizes == size))
                    cells = np.floor(scale * flat[at[of][:, None] + np.arange(size)])
                    top = float(np.abs(cells).max(initial=0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([size], pa.int64()), pa.array([ids[of].tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary()), pa.array([top], pa.float64())], names=["size", "ids", "cells", "top"]
                    )

    return vectors.mapInArrow(pack, "size long, ids binary, cells binary, top double")


def _scores(queries: np.ndarray, cells: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products. Floats hold them exactly below 2**53; beyond, 64-bit integers, modulo 2**64."""
    if exact:
        return (queries @ cells.T).astype(np.int64)
    with np.errstate(invalid="ignore"):
        return queries.astype(np.int64) @ cells.astype(np.int64).T


def top_k(vectors: DataFrame, is_query: str, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows but the query's own, for each row that is_query (SQL on `id`) holds for.

    The score is the inner product of floor(scale * x) over doubles x; equal
    scores rank by the smaller id. Null vectors, vectors with a null or
    non-finite component and rows of null id take no part. Only vectors of one
    length score against each other. Rows that share an id are never each
    other's answer; each such query row is answered by itself, under the same
    query_id. Fewer than k candidates give fewer rows, an empty table none;
    other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("v", F.when(~F.exists("v", lambda x: x.isNull()), F.col("v")))
    scratch = Scratch(spark)
    packed = scratch.written(_packed(rows, scale), "vectors")
    queries = _numbered(rows.where(F.expr(is_query)), scratch)
    size = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    per = max(1, min(BLOCK_QUERIES, BLOCK_CELLS // max(size[1] or 1, 1)))
    most = packed.agg(F.max("top")).first()[0] or 0.0
    done = []
    for start in range(0, max(1, size[0]), per):
        part = queries.where((F.col("number") >= start) & (F.col("number") < start + per)).select("id", "v")
        best = _block(packed, part, scale, k, most, spark)
        done.append(best if size[0] <= per else scratch.written(best, "block"))
    # the results of several blocks are tables, so the plan that reads them has one scan a block and no more
    return scratch.last(reduce(DataFrame.unionByName, done), "top_k")


def _numbered(queries: DataFrame, scratch: Scratch) -> DataFrame:
    """queries with their number, from 0 on without gaps: a row's place in its task, and the rows of the tasks before."""
    low = F.lit((1 << 33) - 1)
    placed = queries.withColumn("at", F.monotonically_increasing_id())
    placed = scratch.written(placed.select("id", "v", F.shiftright("at", 33).cast("int").alias("task"), F.col("at").bitwiseAND(low).alias("place")), "placed")
    # one row a task
    tasks = placed.groupBy("task").agg(F.count("*").alias("n"))
    starts = tasks.select("task", (F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    return scratch.written(placed.join(F.broadcast(starts), "task").select("id", "v", (F.col("start") + F.col("place")).alias("number")), "queries")


def _block(packed: DataFrame, queries: DataFrame, scale: int, k: int, most: float, spark) -> DataFrame:
    gathered = _packed(queries, scale).collect()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    n = 0
    ids: list[np.ndarray] = []
    exact = True
    for length in sorted({r["size"] for r in gathered}):
        own = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in gathered if r["size"] == length])
        cells = np.concatenate([np.frombuffer(r["cells"]).reshape(len(r["ids"]) // 8, length) for r in gathered if r["size"] == length])
        exact &= length * most * most < 2**53
        by_size[length] = (np.arange(n, n + len(own)), cells)
        ids.append(own)
        n += len(own)
    query_ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    sent = spark.sparkContext.broadcast((by_size, query_ids))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, ids, scores, the queries' own ids) of one tile after the other."""
        blocks, own = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                if row["size"] not in blocks:
                    continue
                which, cells = blocks[row["size"]]
                there, other = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cells"]).reshape(len(row["ids"]) // 8, row["size"])
                step = max(1, TILE // max(1, len(there)))
                for a in range(0, len(which), step):
                    yield which[a : a + step], there, _scores(cells[a : a + step], other, exact), own[which[a : a + step]]

    # Round by round: the k-th best of query q lies in [low, low + width); above[q] scores lie above it.
    bound = max([1.0, *(float(length) * most * most for length in by_size)]) if exact else 2.0**63
    top = 1
    while top <= bound:
        top *= 2
    top = min(top, 2**63)
    low, width, above = np.full(n, -top, object), 2 * top, np.zeros(n, np.int64)
    while width > 1 and n:
        step = max(1, width // BINS)
        state = spark.sparkContext.broadcast((low.astype(np.int64), step, width))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Counts by query and bin, from above down to this task's own k-th best: the k-th best of all is no lower."""
            lows, step, width = state.value
            seen: list[list[np.ndarray]] = []

            def merged() -> list[np.ndarray]:
                if not seen:
                    return [np.zeros(0, np.int64)] * 3
                q, b, c = (np.concatenate(x) for x in zip(*seen, strict=True))
                order = np.lexsort((-b, q))
                q, b, c = q[order], b[order], c[order]
                new = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
                q, b, c = q[new], b[new], np.add.reduceat(c, new) if len(new) else c
                before = np.cumsum(c) - c
                first = np.flatnonzero(np.diff(q, prepend=-1))
                before -= np.repeat(before[first], np.diff(first, append=len(q)))
                use = before < k
                return [q[use], b[use], c[use]]

            for which, there, scores, own in scored(batches):
                inside = (scores >= lows[which][:, None]) & (there != own[:, None])
                if width < 2**63:
                    inside &= scores - lows[which][:, None] < width
                q, at = np.nonzero(inside)
                gap = (scores[q, at].astype(np.uint64) - lows[which][q].astype(np.uint64)) // np.uint64(step)
                code, counts = np.unique(which[q] * np.int64(2 * BINS) + gap.astype(np.int64), return_counts=True)
                seen.append([code // (2 * BINS), code % (2 * BINS), counts])
                if len(seen) > 16:
                    seen = [merged()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged()], names=["q", "bin", "n"])

        sums = packed.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # no more than k of a query's non-empty bins have fewer than k scores above them, so the driver gets k rows a query
        over = Window.partitionBy("q").orderBy(F.desc("bin"))
        running = sums.withColumn("above", F.sum("n").over(over) - F.col("n")).where(F.col("above") < k)
        last = [-1] * n
        reached = np.zeros(n, np.int64)
        counts: dict[int, list[tuple[int, int]]] = {}
        for row in running.collect():
            counts.setdefault(row["q"], []).append((row["bin"], row["n"]))
        for q, bins in counts.items():
            got = int(above[q])
            for b, c in sorted(bins, reverse=True):
                last[q], reached[q] = b, got
                if got + c >= k:
                    break
                got += c
        for q in range(n):
            if last[q] >= 0:
                low[q] += last[q] * step
                above[q] = reached[q]
        width = step
    final = spark.sparkContext.broadcast(low.astype(np.int64))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which, there, scores, own in scored(batches):
            least = final.value[which][:, None]
            fair = there != own[:, None]
            q, at = np.nonzero((scores > least) & fair)
            tie_q, tie_at = np.nonzero((scores == least) & fair)
            order = np.lexsort((there[tie_at], tie_q))
            tie_q, tie_at = tie_q[order], tie_at[order]
            first = np.flatnonzero(np.diff(tie_q, prepend=-1))
            place = np.arange(len(tie_q)) - np.repeat(first, np.diff(first, append=len(tie_q)))
            q, at = np.append(q, tie_q[place < k]), np.append(at, tie_at[place < k])
            yield pa.RecordBatch.from_arrays([pa.array(which[q]), pa.array(own[q]), pa.array(there[at]), pa.array(scores[q, at])], names=["q", "query_id", "vec_id", "score"])

    over = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = packed.mapInArrow(keep, "q long, query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
