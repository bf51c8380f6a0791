"""Similarity join on word shingles with Bayesian pruning of candidates.

Documents of equal shingle sets are one node. Nodes that agree in any band of
MinHash values are candidates: each band's nodes gather under their least
node, and only nodes that share such a leader are compared. Comparisons go
through MinHash values a few at a time; after each step a pair is dropped if
the posterior probability that its similarity reaches the threshold is below a
tolerance. What is left is verified exactly on the sets, and counted under the
least leader that both nodes share. Groups are compared block against block, so
no pair is ever a row and no task holds a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.components import components
from wayfold.llm.tables import Scratch, id_and_text, written
from wayfold.llm.wordcode import PLAIN_WORDS, U, Words, grams, mixed, steps, words_of

#: MinHash values compared between two looks at the posterior; values in bands at most; how likely a pair at the threshold may be missed.
LOOK, MOST, MISSED = 16, 170, 1e-10
#: Nodes, and bytes of shingle sets, that a block should have.
BLOCK_NODES, BLOCK_BYTES = 512, 4 << 20
#: Groups of several blocks whose sizes are sent to all tasks at most.
SENT_GROUPS = 100_000
#: Bits of the filter through which the second reading of the documents goes.
FILTER_BITS = 1 << 26

_RANDOM = np.random.Generator(np.random.PCG64(8088))
_TIMES = _RANDOM.integers(1, 2**63, 1024, dtype=U) | U(1)
_PLUS = _RANDOM.integers(1, 2**63, 1024, dtype=U)


@dataclass
class Bands:
    """Bands of MinHash values for a threshold: as many values to a band as let MOST values miss a pair at it with MISSED."""

    bands: int
    rows: int

    @classmethod
    def of(cls, threshold: float) -> Bands:
        if not 0.05 <= threshold <= 1:
            raise ValueError("the threshold has to be from 0.05 to 1")
        needed = lambda rows: 1 if threshold == 1 else math.ceil(math.log(MISSED) / math.log(1 - threshold**rows))
        rows = max([r for r in range(2, 17) if r * needed(r) <= MOST], default=1)
        return cls(needed(rows), rows)

    @property
    def hashes(self) -> int:
        return -(-self.bands * self.rows // LOOK) * LOOK


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle codes of all texts, where each text's start). A text of fewer than n words is one shingle."""
    counts = words.counts
    full = words.left()[: max(0, len(words.starts) - n + 1)] >= n
    codes = grams(words.codes[0], n)[full]
    text = words.text_of()[: len(full)][full]
    for i in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        own = words.codes[0][words.ends_at[i] : words.ends_at[i + 1]]
        codes, text = np.append(codes, grams(own, len(own))), np.append(text, i)
    order = np.lexsort((codes, text))
    codes, text = codes[order], text[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
    return codes[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def signatures(docs: DataFrame, shingle: int, plan: Bands) -> DataFrame:
    """(doc_id, text_code, node, n, sig, bands): the set's 128-bit name and size, MinHash values to 16 bits, and band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, 1):
                codes, first = shingle_sets(words_of(batch.column(1), PLAIN_WORDS), shingle)
                n = np.diff(first)
                full = n > 0
                at = first[:-1][full]
                names = np.zeros((len(n), 2), U)
                values = np.zeros((len(n), plan.hashes), U)
                if len(at):
                    names[full, 0] = np.add.reduceat(codes, at)
                    names[full, 1] = np.add.reduceat(mixed(codes ^ U(0x5851F42D4C957F2D)), at)
                    for k in range(plan.hashes):
                        values[full, k] = np.minimum.reduceat(codes * _TIMES[k] + _PLUS[k], at)
                names = mixed(names + n[:, None].astype(U))
                bands = np.zeros((len(n), plan.bands), U)
                for k in range(plan.rows):
                    bands = mixed(bands * U(0x9E3779B97F4A7C15) + values[:, k : plan.bands * plan.rows : plan.rows])
                bands = mixed(bands + np.arange(plan.bands, dtype=U) * U(0xC2B2AE3D27D4EB4F)).astype(np.int64)
                short = (values >> U(40)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array([x.tobytes() if k else None for x, k in zip(names.byteswap(), full, strict=True)], pa.binary()),
                        pa.array(n, pa.int64()),
                        pa.array([x.tobytes() if k else None for x, k in zip(short, full, strict=True)], pa.binary()),
                        pa.array([x if k else None for x, k in zip(bands, full, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_code", "node", "n", "sig", "bands"],
                )

    return docs.select("doc_id", "text", "text_code").mapInArrow(sign, "doc_id long, text_code long, node binary, n long, sig binary, bands array<long>")


def least_matches(threshold: float, tolerance: float, hashes: int) -> dict[int, int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior, n values of which m match give Beta(m + 1, n - m + 1);
    that it exceeds the threshold is as likely as m or fewer successes in n + 1
    trials of that probability.
    """
    out = {}
    for n in range(LOOK, hashes + 1, LOOK):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def likely_pairs(a: np.ndarray, b: np.ndarray, same: bool, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two matrices of MinHash values that no look drops; of one block with itself, each pair once."""
    matches = np.zeros((len(a), len(b)), np.uint8)
    for k in range(LOOK):
        matches += a[:, k, None] == b[None, :, k]
    keep = matches >= least[LOOK]
    if same:
        keep &= np.arange(len(a))[:, None] < np.arange(len(b))
    i, j = np.nonzero(keep)
    count = matches[i, j].astype(np.int64)
    for n in range(2 * LOOK, a.shape[1] + 1, LOOK):
        part = slice(n - LOOK, n)
        for at in range(0, len(i), 1 << 16):
            count[at : at + (1 << 16)] += (a[i[at : at + (1 << 16)], part] == b[j[at : at + (1 << 16)], part]).sum(1)
        keep = count >= least[n]
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The size of the intersection of a[i] and b[j], for all pairs."""
    if len(i) < 256:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    rows, back_i = np.unique(i, return_inverse=True)
    columns, back_j = np.unique(j, return_inverse=True)
    left, right = (np.concatenate([s[k] for k in of.tolist()]) for s, of in ((a, rows), (b, columns)))
    whose = [np.repeat(np.arange(len(of)), [len(s[k]) for k in of.tolist()]) for s, of in ((a, rows), (b, columns))]
    common = np.intersect1d(left, right)
    total = np.zeros((len(rows), len(columns)), np.float32)
    at = [np.searchsorted(common, x) for x in (left, right)]
    hit = [(p < len(common)) & (common[np.minimum(p, len(common) - 1)] == x) if len(common) else np.zeros(len(x), bool) for p, x in zip(at, (left, right), strict=True)]
    for start in range(0, len(common), 4096):
        dense = []
        for p, h, w, size in zip(at, hit, whose, (len(rows), len(columns)), strict=True):
            use = h & (p >= start) & (p < start + 4096)
            m = np.zeros((size, min(4096, len(common) - start)), np.float32)
            m[w[use], p[use] - start] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    return total[back_i, back_j].astype(np.int64)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _block_pairs(members: DataFrame, columns: list[str], blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (grp, node, columns) as blocks, and each block beside each block of its group, itself included.

    blocks gives each group's number of blocks; members are dealt over them by hash.
    """
    # few groups have several blocks; where these are too many to send to all tasks, a join splits their rows
    many = blocks.where(F.col("blocks") > 1)
    many = F.broadcast(many) if many.count() <= SENT_GROUPS else many
    dealt = members.join(many, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).select("grp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("i"), F.struct("node", *columns).alias("x"))
    packed = dealt.groupBy("grp", "blocks", "i").agg(F.collect_list("x").alias("a"))
    packed = scratch.written(packed, "blocks")
    alone = packed.where(F.col("blocks") == 1).select("grp", F.lit(True).alias("same"), "a", F.lit(None).cast(packed.schema["a"].dataType).alias("b"))
    many = packed.where(F.col("blocks") > 1)
    left = many.select("grp", "i", "a", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
    right = many.select("grp", F.col("i").alias("j"), F.col("a").alias("b"))
    pairs = left.join(right, ["grp", "j"]).select("grp", (F.col("i") == F.col("j")).alias("same"), "a", F.when(F.col("i") != F.col("j"), F.col("b")).alias("b"))
    return alone.unionByName(pairs)


def _compare(pairs: DataFrame, least: dict[int, int], exact: Fraction | None) -> DataFrame:
    """(grp, node, links, label): for each node of a pair of blocks with a link, how many, and the least node it leads to.

    With exact, members hold their sets as codes, and as lower the codes of
    their groups before this one: a pair that shares one of these is left to it.
    """
    hashes = max(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                row = whole.slice(k, 1)
                sides = [row.column(2).to_pylist()[0], row.column(3).to_pylist()[0]]
                same = sides[1] is None
                a, b = sides[0], sides[0] if same else sides[1]
                sig = [np.frombuffer(b"".join([m["sig"] for m in s]), np.uint16).reshape(-1, hashes) for s in (a, b)]
                i, j = likely_pairs(sig[0], sig[1], same, least)
                if exact is not None and len(i):
                    lower = [[np.array(m["lower"], np.int64).view(U) for m in s] for s in (a, b)]
                    own = shared_counts(*lower, i, j) == 0
                    i, j = i[own], j[own]
                if exact is not None and len(i):
                    sets = [[np.frombuffer(m["codes"], U) for m in s] for s in (a, b)]
                    both = shared_counts(*sets, i, j)
                    size = [np.array([len(x) for x in s]) for s in sets]
                    keep = both * exact.denominator >= exact.numerator * (size[0][i] + size[1][j] - both)
                    i, j = i[keep], j[keep]
                nodes = [m["node"] for m in a] + ([] if same else [m["node"] for m in b])
                j = j if same else j + len(a)
                links = np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
                label = _labels(len(nodes), i, j)
                use = np.flatnonzero(links).tolist()
                grp = row.column(0)[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * len(use), pa.binary()), pa.array([nodes[x] for x in use], pa.binary()), pa.array(links[use].astype(np.int64)), pa.array([nodes[label[x]] for x in use], pa.binary())],
                    names=["grp", "node", "links", "label"],
                )

    return pairs.select("grp", "same", "a", "b").mapInArrow(run, "grp binary, node binary, links long, label binary")


def _name(rep: Column, node: Column) -> Column:
    """A node's name, in whose order a smaller id comes first and null last."""
    ordered = F.unhex(F.lpad(F.hex(rep.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    return F.concat(F.when(rep.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), F.coalesce(ordered, F.unhex(F.lit("00" * 8))), node)


def _rep(name: Column) -> Column:
    """The id in a name."""
    value = F.conv(F.hex(F.substring(name, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")
    return F.when(F.substring(name, 1, 1) == F.unhex(F.lit("00")), value.cast("long"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, tolerance: float = 1e-9) -> DataFrame:
    """One row for each row of docs: (doc_id, text_code, class_id, n_links, n_copies).

    Words are lower-cased in A-Z and consist of letters, digits and all beyond
    ASCII; a document is the set of its runs of `shingle` words, or the one run
    of all its words if they are fewer. A link joins two different sets of a
    Jaccard similarity of at least the threshold. class_id is the least doc_id
    of all documents that links and equal sets connect; n_links counts the
    other sets linked to the document's own, n_copies the rows of its own set.

    A pair at the threshold is missed with a probability of at most 1e-10 for
    the bands, which are made for the threshold, and of the order of the
    tolerance for the pruning; there is no other loss and no cap. Null and empty
    texts, and texts without words, have no set: class_id is their doc_id,
    n_links 0, n_copies 1. Repeated rows count as copies. Rows of null id take
    part; a class of such rows alone has a null class_id. An empty table gives
    an empty one. Other columns are not read; text_code is xxhash64 of the text.

    The join runs when this is called; what is returned reads its rows from the
    shared folder, and the tables between are deleted.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_code", F.xxhash64("text"))
    scratch = Scratch(docs.sparkSession)
    plan = Bands.of(threshold)
    signed = scratch.written(signatures(rows, shingle, plan), "signatures")
    least = least_matches(threshold, tolerance, plan.hashes)
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_code")).alias("source"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    nodes = scratch.written(nodes.withColumn("name", _name(F.col("rep"), F.col("node"))), "nodes")
    banded = nodes.select(F.col("name").alias("node"), F.explode("bands").alias("band"))
    # leaders and blocks are written, so that the rows of a hot band or group can be split where they join
    leaders = scratch.written(banded.groupBy("band").agg(F.min("node").alias("grp"), F.count("*").alias("size")).where("size > 1").drop("size"), "leaders")
    members = scratch.written(banded.join(leaders, "band").select("grp", "node").distinct(), "members")
    blocks = scratch.written(members.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_NODES).alias("blocks")), "block-counts")
    near = members.join(nodes.select(F.col("name").alias("node"), "sig"), "node")
    likely = scratch.written(_compare(_block_pairs(near, ["sig"], blocks, scratch), least, None).select("grp", "node").distinct(), "likely")

    # the groups in which a node has a likely partner, each with the codes of those before it
    own = F.sort_array(F.collect_list(F.struct(F.xxhash64("grp").alias("code"), "grp")))
    before = F.transform("groups", lambda g: F.struct(g["grp"].alias("grp"), F.transform(F.filter("groups", lambda x: x["code"] < g["code"]), lambda x: x["code"]).alias("lower")))
    chosen = likely.groupBy("node").agg(own.alias("groups")).withColumn("groups", before)
    chosen = scratch.written(chosen.join(nodes.select(F.col("name").alias("node"), "sig", "n", "source"), "node").select("node", "groups", "sig", "n", "source.doc_id", "source.text_code"), "chosen")

    # the sets of these nodes, from the documents that may hold them
    place = F.pmod(F.col("text_code"), F.lit(FILTER_BITS))
    # FILTER_BITS bits in all, whatever the input
    filled = chosen.select(place.alias("p")).groupBy(F.call_function("bitmap_bucket_number", F.col("p")).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("p"))).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS + (1 << 16), bool)
    for r in filled:
        # bucket 1 holds 1 to 32768; bucket 0 holds 0 alone
        got = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        base = (r["bucket"] - 1) * len(got) + 1
        at = base + np.flatnonzero(got)
        bits[at[at >= 0]] = True
        if r["bucket"] == 0:
            bits[0] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.uint8)
        for whole in batches:
            code = whole.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            p = code % FILTER_BITS
            hit = (known[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
            for batch in steps(whole.filter(pa.array(hit)), 1):
                codes, first = shingle_sets(words_of(batch.column(1), PLAIN_WORDS), shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([codes[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "text_code", "codes"])

    found = rows.where(F.col("text_code").isNotNull()).select("doc_id", "text", "text_code").mapInArrow(sets, "doc_id long, text_code long, codes binary")
    # repeated rows of a document hold equal sets
    on = [chosen["doc_id"].eqNullSafe(found["doc_id"]), chosen["text_code"] == found["text_code"]]
    full = chosen.join(found, on).select("node", "groups", "sig", "codes").dropDuplicates(["node"])
    full = full.select("node", "sig", "codes", F.explode("groups").alias("g")).select("g.grp", "node", "sig", "codes", "g.lower")
    sized = chosen.select("n", F.explode("groups.grp").alias("grp"))
    blocks = scratch.written(sized.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).alias("blocks")), "block-counts")
    exact = Fraction(threshold).limit_denominator(10**6)
    linked = scratch.written(_compare(_block_pairs(full, ["sig", "codes", "lower"], blocks, scratch), least, exact).drop("grp"), "links")
    degree = linked.groupBy("node").agg(F.sum("links").alias("n_links"))
    final = components(linked.select(F.col("node").alias("u"), F.col("label").alias("v")), keep=scratch.written)
    # names are in the order of ids, so a component's least name tells its least id
    named = nodes.select("node", "name", "copies").join(final.withColumnRenamed("node", "name"), "name", "left").join(degree.withColumnRenamed("node", "name"), "name", "left")
    named = named.select("node", _rep(F.coalesce("component", "name")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    out = signed.select("doc_id", "text_code", "node").join(scratch.written(named, "named"), "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return scratch.last(out.select("doc_id", "text_code", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")), "similar")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they are, that stand for their class: those of its least doc_id.

    Repeated rows of one id and text stay once. Texts without words are classes of their own.
    """
    found = similar_documents(docs, id_col, text_col, shingle, threshold)
    none = F.lit(-(2**63))
    keys = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", none).alias("key_id"), F.coalesce("text_code", none).alias("key_code")).distinct()
    keyed = docs.withColumns({"key_id": F.coalesce(F.col(id_col).cast("long"), none), "key_code": F.coalesce(F.xxhash64(F.col(text_col).cast("string")), none)})
    return keyed.join(written(keys, "representatives"), ["key_id", "key_code"], "left_semi").dropDuplicates(["key_id", "key_code"]).select(*docs.columns)
