"""The whole model of op5: n-grams seen once keep their own discount."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from wayfold.llm import language_model, queries


def whole(training, tests):
    """log10 probabilities of texts under interpolated modified Kneser-Ney trigrams, as plain loops."""
    tokens = lambda t: [*plain.blank_words((t or "").translate(plain.LOWER)), "</s>"]
    grams = lambda w: [(w[i - 2] if i > 1 else "<s>", w[i - 1] if i else "<s>", w[i]) for i in range(len(w))]
    tri, words, bi = Counter(), set(), Counter()
    for t in training:
        tri.update(grams(tokens(t)))
        words.update(tokens(t))
    for (_, v, w), c in tri.items():
        bi[v, w] += c if v == "<s>" else 1
    one = Counter((w,) for _, w in bi)

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]

    orders = []
    for counts in (one, bi, tri):
        d, total, left = discounts(counts), Counter(), defaultdict(float)
        for k, c in counts.items():
            total[k[:-1]] += c
            left[k[:-1]] += d[min(c, 3)]
        orders.append((counts, d, total, left))

    def p(u, v, w):
        out = 1 / (len(words) + 1)
        for key, (counts, d, total, left) in zip(((w,), (v, w), (u, v, w)), orders, strict=True):
            if n := total[key[:-1]]:
                c = counts[key]
                out = (c - d[min(c, 3)] + left[key[:-1]] * out) / n
        return out

    assert abs(sum(p("the", "of", w) for w in [*words, "unseen"]) - 1) < 1e-9
    assert 0 < orders[1][1][1] < 1 and 0 < orders[2][1][1] < 1
    return [sum(np.log10(p(*g)) for g in grams(tokens(t))) for t in tests]


@pytest.mark.parametrize("grouped", [language_model.GROUPED, 10_000])
def test_query_scores_by_the_whole_model(spark, sf_dir, monkeypatch, grouped):
    monkeypatch.setattr(language_model, "GROUPED", grouped)
    got = {r.doc_id: r.score for r in queries.op5_lm_scoring(spark, sf_dir).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = whole([t for i, t in rows if not held(i)], [t for _, t in rows])
    assert max(abs(got[i] - s) for (i, _), s in zip(rows, want, strict=True)) < 1e-6


def test_a_trigram_seen_once_is_likelier_than_one_never_seen(spark):
    docs = spark.createDataFrame([(0, "a b c"), (1, "a b d a b d c e c e a b d"), (2, "a b c"), (3, "a b e")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.score(docs, F.col("doc_id") > 1).collect()}
    assert got[2] > got[3] + 0.1
