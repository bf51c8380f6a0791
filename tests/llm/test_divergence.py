"""Divergence of sources against plain loops, with small blocks and chunks, on odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import ODD

from wayfold.llm import source_divergence
from wayfold.llm.source_divergence import divergence


def plain(rows, least_docs, ranks=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = [s for g, s in groups if g == lang]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = shares(counts[lang, source])
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        pairs = [(sum(abs(p[t] - q[t]) for t in kept), s) for s in sources if s != source for q in [shares(counts[lang, s])]]
        terms = [(p[t] - whole[t], t) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def rows_of(df):
    return [(r.lang, r.source, r.text) for r in df.collect()]


@pytest.mark.parametrize("sizes", [{}, {"chunk_terms": 3, "block_groups": 2}])
def test_odd_rows(spark, monkeypatch, sizes):
    monkeypatch.setattr(source_divergence, "SLICE", 40)
    random.seed(6)
    rows = [(random.choice(["en", "de", None, ""]), random.choice(["a", "b", "c", "d", "é", "E", None]), random.choice([*ODD, LINE := "Some words and some more WORDS"])) for _ in range(400)]
    rows += rows[:30] + [("fr", f"s{i}", "") for i in range(4)] + [("it", "only one", LINE)] * 3 + [("pt", "x", LINE)] * 3 + [("pt", "empty", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("clash") for c in ("term", "n", "item", "value", "block", "total", "v")}).repartition(4)
    got = sorted(tuple(r) for r in divergence(df, least_docs=3, ranks=7, **sizes).select("lang", "source", "part", "item", "value", "rank").collect())
    want = plain(rows, 3, 7)
    assert got == want
    assert ("fr", "s0", "pair", "s1", 0, 1) in got and not any(r[0] == "it" and r[2] == "pair" for r in got)
    assert divergence(df.where("false")).count() == 0


def test_a_task_that_holds_little_sends_often(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 5)
    rows = [("en", f"s{i % 3}", f"w{i % 40} common word") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence(df, least_docs=7).select("lang", "source", "part", "item", "value", "rank").collect()) == plain(rows, 7)


def test_shares_are_exact(spark):
    import numpy as np

    counts = [0, 1, 5, 10**6, 10**12, 8 * 10**15]
    totals = [5, 7, 10**6 + 10, 10**12 + 17, 9 * 10**15 - 1]
    pairs = [(c, t) for c in counts for t in totals if c + 5 <= t]
    want = [1 + 10**9 * (c + 5) // t for c, t in pairs]
    assert source_divergence._shares(*(np.array(x, np.int64) for x in zip(*pairs))).tolist() == want
    df = spark.createDataFrame(pairs, "c long, t long")
    assert [r[0] for r in df.coalesce(1).select(source_divergence._share(F.col("c"), F.col("t"))).collect()] == want
