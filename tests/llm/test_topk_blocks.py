"""Blocks of queries of op1: bounded whatever the ids are, and exact beyond what floats hold."""

import random

import pytest

from wayfold.llm import topk


def best(rows, is_query, k):
    """By every pair, in Python's integers; one list of (vec_id, score) for each query row."""
    whole = [(i, [int(1024 * x // 1) for x in v]) for i, v in rows]
    out = []
    for i, v in whole:
        if is_query(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i)
            out.append((i, tuple((j, -s) for s, j in scored[:k])))
    return sorted(out)


def found(rows):
    """The answers of each query row; rows of one id give one id's answers several times."""
    out = {}
    for r in rows:
        out.setdefault((r.query_id, r["rank"]), []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("size", [1.0, 40_000.0])
def test_blocks_are_bounded_and_exact(spark, monkeypatch, size):
    """A third of the rows has one id; with the greater components scores need 64-bit integers."""
    random.seed(3)
    rows = [(20 if i % 3 == 0 else i, [random.uniform(-size, size) for _ in range(6)]) for i in range(300)]
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 40)
    sizes = []
    block = topk._block

    def counted(packed, queries, *rest):
        sizes.append(queries.count())
        return block(packed, queries, *rest)

    monkeypatch.setattr(topk, "_block", counted)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = found(topk.top_k(df, "id % 20 = 0", k=4).collect())
    wanted = {}
    for i, answers in best(rows, lambda i: i % 20 == 0, 4):
        for rank, answer in enumerate(answers, 1):
            wanted.setdefault((i, rank), []).append(answer)
    assert {q: sorted(a) for q, a in got.items()} == {q: sorted(a) for q, a in wanted.items()}
    queries = sum(i % 20 == 0 for i, _ in rows)
    assert sum(sizes) == queries and max(sizes) <= 40 and len(sizes) == -(-queries // 40)
    assert (6 * (1024 * size) ** 2 > 2**53) == (size > 1)
