"""SimHash near-dedup against plain loops, and the code of its anchors."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F
from test_operators import ODD

from wayfold.llm import simhash_dedup


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, threshold=4):
    prints = [p for _, p in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def check(df):
    texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    rows = [(d, plain_print(t)) for d, t in texts]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(rows, plain_components(rows))), key=repr)
    assert sorted((tuple(r) for r in simhash_dedup.near_duplicates(df).collect()), key=repr) == want


def test_documents(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "another text of one id"), (None, "no id here at all"), (None, "a"), (7, ODD[7]), (70, "A\tb\x0bc\x0cd\re\nf  g"), (71, "a b c d e f g"), (72, "x y"), (73, "nobody has this one"), (None, "nor this lonely one here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("print", "doc", "anchor", "home", "least", "u", "v")}).repartition(3)
    check(df)
    assert simhash_dedup.near_duplicates(df.where("false")).count() == 0


def test_many_near_prints_over_several_blocks(spark, monkeypatch):
    """A hot ball of fingerprints and chains of them, by numbers instead of texts; blocks are small, so an anchor has many."""
    random.seed(5)
    centre, rows = random.getrandbits(64), []
    for i in range(500):
        rows.append(centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 6))))
    for _ in range(30):
        x = random.getrandbits(64)
        for _ in range(random.randint(1, 12)):
            rows.append(x)
            x ^= sum(1 << b for b in random.sample(range(64), random.randint(1, 5)))
    rows += [random.getrandbits(64) for _ in range(300)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    data = list(enumerate(rows))
    monkeypatch.setattr(simhash_dedup, "BLOCK", 40)
    monkeypatch.setattr(simhash_dedup, "AT_HOME", 2)
    monkeypatch.setattr(simhash_dedup, "_fingerprints", lambda batches: (b.rename_columns(["doc_id", "print"]).set_column(1, "print", b.column(1).cast("int64")) for b in batches))
    df = spark.createDataFrame([(i, str(signed(p))) for i, p in data], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(df).collect()}
    assert got == dict(zip(range(len(rows)), plain_components(data)))


def test_joined_links_keep_the_parts():
    rng = np.random.default_rng(1)
    for density in (0.02, 0.1, 0.5):
        near = rng.random((30, 40)) < density
        for tile in (near, np.kron(np.eye(2, dtype=bool), near)):
            parts = lambda pairs, n: {frozenset(x) for x in _parts(pairs, n)}
            n = sum(tile.shape)
            own = [(i, j + tile.shape[0]) for i, j in zip(*np.nonzero(tile))]
            made = list(zip(*(x.tolist() for x in simhash_dedup._joined(tile))))
            assert parts(made, n) == parts(own, n) and len(made) <= n + 1


def _parts(pairs, n):
    group = {i: {i} for i in range(n)}
    for i, j in pairs:
        if group[i] is not group[j]:
            whole = group[i] | group[j]
            for x in whole:
                group[x] = whole
    return group.values()


def test_the_code():
    for bits in (7, 13, 16):
        words = simhash_dedup.anchors(bits)
        assert len(set(words.tolist())) == 2**bits
        assert all(int(words[i] ^ words[j]) in set(words.tolist()) for i, j in ((1, 2), (5, 100), (77, 126)))
    weights = set(np.bitwise_count(simhash_dedup.anchors(7)).tolist())
    assert weights == {0, 32, 64}  # the first-order Reed-Muller code
    assert min(np.bitwise_count(simhash_dedup.anchors(16))[1:]) >= 16  # within the second-order one
    rng = np.random.default_rng(2)
    points = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    assert np.bitwise_count(points[:, None] ^ simhash_dedup.anchors(7)[None, :]).min(axis=1).max() <= 28
