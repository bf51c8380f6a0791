"""An interpolated modified Kneser-Ney model of word trigrams, counted in Spark and read by memory map.

Words get numbers: a first pass counts their 64-bit codes, deals them by range
and writes them as sorted arrays; a word's number is its place in them. A
second pass counts trigrams of numbers, task by task, and deals them by their
middle word, so that a trigram (u, v, w), its context (u, v), its suffix (v, w)
and the shorter context (v) meet in one group. A middle word with a large share
of all tokens is dealt over several groups by the third word.

N-grams are stored as sorted arrays of hashes. The leading bits of a hash name
the group, so that the groups of one part, dealt in order, append to the same
few files: their number doesn't grow with the text. More leading bits are left
out and stand in an index of where each bucket of hashes starts; 32 further
bits are stored. Workers map the files into memory and look up sorted batches;
what a batch doesn't touch is never read.

All trigrams, bigrams and contexts are stored with their counts, those seen
once too.
"""

from __future__ import annotations

import mmap
import os
import shutil
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import id_and_text, shared_folder, written
from wayfold.llm.wordcode import BLANK_WORDS, U, mixed, pieces, steps, words_of

LOWER_BLANK_WORDS = BLANK_WORDS.copy()
LOWER_BLANK_WORDS[65:91] += 32
#: The end of a text, as a token; the start only as context.
END = U(0x1F2E3D4C5B6A7988)
#: Numbers of words: 0 is none of the training words, 1 the start; words go from FIRST on.
START, FIRST = 1, 2
#: Tokens that a task holds before it hands them on, and that one group should have at most.
HELD = 2_000_000
GROUPED = 2_000_000
#: Parts of a table at most, as a power of two.
PARTS = 10
#: Bytes of text that are scored at once: the more, the more lookups fall together.
SCORED = 3_000_000


def tokens(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the tokens of all texts, each text's end included; where each text starts among them)."""
    words = words_of(batch.column(column), LOWER_BLANK_WORDS)
    n = len(words.counts)
    starts = words.ends_at + np.arange(n + 1)
    codes = np.empty(starts[-1], U)
    ends = np.zeros(len(codes), bool)
    ends[starts[1:] - 1] = True
    codes[ends] = END
    codes[~ends] = words.codes[0]
    return codes, starts


def trigrams(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words before each token, and the token, as numbers; texts start with two STARTs."""
    v, u = np.empty_like(words), np.empty_like(words)
    v[1:], u[2:] = words[:-1], words[:-2]
    first = starts[:-1]
    v[first] = u[first] = START
    second = first + 1
    u[second[second < starts[1:]]] = START
    return u, v, words


def hashed(*words: np.ndarray) -> np.ndarray:
    out = mixed(words[0].astype(U))
    for w in words[1:]:
        out = mixed(out * U(0x9E3779B97F4A7C15) + w.astype(U))
    return out


def in_order(v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The order by v, then u, then w."""
    if v.dtype != np.uint32:
        return np.lexsort((w, u, v))
    # two words fill a key of 64 bits; the rank of their pair and the third word fill another
    _, rank = np.unique((v.astype(U) << U(32)) | u, return_inverse=True)
    return np.argsort((rank.astype(U) << U(32)) | w)


def runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows start."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = False
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


# Rows of numbers travel with all their first bytes together, then all second ones, and so on.


def packed(x: np.ndarray) -> bytes:
    size = x.dtype.itemsize
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, size).T.tobytes()
    return np.array([len(x), size], np.int64).tobytes() + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(b: bytes) -> np.ndarray:
    n, size = np.frombuffer(b[:16], np.int64).tolist()
    raw = np.frombuffer(pa.decompress(b[16:], n * size, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(f"u{size}").ravel()


def fitting(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest of them takes."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


@dataclass
class Model:
    """Where the files are, how words are dealt, and the few numbers that hold for all."""

    folder: str
    #: Leading bits of a hash that name its part, its group and its bucket.
    part_bits: int
    bits: int
    bucket_bits: int
    bases: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    n_tokens: int = 0
    n_words: int = 0
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    spreads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    start: list[int] = field(default_factory=lambda: [0] * 4)
    discounts: list[list[float]] = field(default_factory=list)
    types: float = 0.0
    floor: float = 1.0

    @property
    def kind(self) -> type:
        """The type of words' numbers."""
        return np.uint32 if self.n_words < 2**32 - FIRST else np.uint64

    def spread(self, v: np.ndarray) -> np.ndarray:
        """Over how many groups the trigrams of a middle word are dealt."""
        out = np.ones(len(v), np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, v), len(self.common) - 1)
            hit = self.common[at] == v
            out[hit] = self.spreads[at[hit]]
        return out

    def group(self, v: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mixed(mixed(v.astype(U)) + salt.astype(U)) >> U(64 - self.bits)

    def salt(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return mixed(w.astype(U)) % self.spread(v).astype(U)

    def key(self, group: np.ndarray, code: np.ndarray) -> np.ndarray:
        """A hash that begins with the group."""
        return (group << U(64 - self.bits)) | (code >> U(self.bits))

    def path(self, table: str, part: int, of: str) -> str:
        return f"{self.folder}/{table}-{part}.{of}"


class Writer:
    """A part of a table of sorted keys with values, written from front to back, group by group.

    Small values are a code; others have the code FULL and stand in a list of their own.
    A file gets its name when it is whole, so a task that runs again replaces it by an equal one.
    """

    def __init__(self, model: Model, table: str, part: int, wide: bool = False):
        self.model, self.wide = model, wide
        self.paths = [model.path(table, part, of) for of in ("starts", "keys", "codes", "over-at", "over")]
        self.parts = [f"{p}.{uuid.uuid4().hex}.tmp" for p in self.paths]
        self.files = [open(p, "wb") for p in self.parts]
        self.n = 0
        self.bucket = part << (model.bucket_bits - model.part_bits)
        self.stop = (part + 1) << (model.bucket_bits - model.part_bits)

    def _skip_to(self, bucket: int) -> None:
        while self.bucket < bucket:
            size = min(1 << 16, bucket - self.bucket)
            self.files[0].write(np.full(size, self.n, np.int64).tobytes())
            self.bucket += size

    def add(self, keys: np.ndarray, codes: np.ndarray, values: np.ndarray) -> None:
        """Keys of the next group, in any order; values are rows of counts."""
        if not len(keys):
            return
        order = np.argsort(keys)
        keys, codes = keys[order], codes[order]
        model = self.model
        bucket = (keys >> U(64 - model.bucket_bits)).astype(np.int64)
        first = int(bucket[0])
        self._skip_to(first)
        counts = np.bincount(bucket - first)
        self.files[0].write((self.n + np.cumsum(counts) - counts).astype(np.int64).tobytes())
        self.bucket = first + len(counts)
        self.files[1].write((keys if self.wide else ((keys << U(model.bucket_bits)) >> U(32)).astype(np.uint32)).tobytes())
        self.files[2].write(codes.tobytes())
        over = np.flatnonzero(codes == FULL[codes.dtype.itemsize])
        self.files[3].write((self.n + over).astype(np.int64).tobytes())
        self.files[4].write(values[order[over]].astype(np.int64).tobytes())
        self.n += len(keys)

    def close(self) -> None:
        self._skip_to(self.stop)
        self.files[0].write(np.int64(self.n).tobytes())
        for f, part, path in zip(self.files, self.parts, self.paths, strict=True):
            f.close()
            os.replace(part, path)


FULL = {1: 255, 2: 65535}


def count_codes(n: np.ndarray) -> np.ndarray:
    """A byte for each count."""
    return np.minimum(n, FULL[1]).astype(np.uint8)


def sums_of(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of counts: their sum, and how many are 1, 2 and more."""
    return np.stack([np.add.reduceat(x.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64) for x in (counts, counts == 1, counts == 2, counts > 2)], 1)


def sum_codes(sums: np.ndarray) -> np.ndarray:
    """Two bytes for each row of sums: ones in 5 bits, twos in 3, more in 3, what these others sum up to in 5."""
    total, one, two, more = sums.T
    rest = total - one - 2 * two
    small = (one < 32) & (two < 8) & (more < 8) & (rest < 32)
    code = one | (two << 5) | (more << 8) | (rest << 11)
    return np.where(small & (code != FULL[2]), code, FULL[2]).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    one, two, more, rest = code & 31, code >> 5 & 7, code >> 8 & 7, code >> 11
    return np.stack([one + 2 * two + rest, one, two, more], 1)


@lru_cache(maxsize=1 << 16)
def _mapped(path: str, kind: type) -> np.ndarray:
    """A file as an array; no file is empty. The map holds no descriptor, so there may be many."""
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.zeros(0, kind)
    with open(path, "rb") as f:
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), kind)


def _places(model: Model, table: str, part: int, keys: np.ndarray, wide: bool) -> np.ndarray:
    """Where sorted keys stand in a part of a table; -1 where they don't."""
    starts, stored = _mapped(model.path(table, part, "starts"), np.int64), _mapped(model.path(table, part, "keys"), U if wide else np.uint32)
    if not len(stored):
        return np.full(len(keys), -1)
    bucket = (keys >> U(64 - model.bucket_bits)).astype(np.int64) - (part << (model.bucket_bits - model.part_bits))
    low, end = starts[bucket], starts[bucket + 1]
    wanted = keys if wide else ((keys << U(model.bucket_bits)) >> U(32)).astype(np.uint32)
    high = end
    while (going := low < high).any():
        middle = (low + high) >> 1
        less = going & (stored[np.minimum(middle, len(stored) - 1)] < wanted)
        high = np.where(going & ~less, middle, high)
        low = np.where(less, middle + 1, low)
    hit = (low < end) & (stored[np.minimum(low, len(stored) - 1)] == wanted)
    return np.where(hit, low, -1)


def found(model: Model, table: str, keys: np.ndarray, code: type, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the values of keys, zeros where missing; their places over all parts, -1 where missing, for wide keys)."""
    values, places = np.zeros((len(keys), width), np.int64), np.full(len(keys), -1)
    order = np.argsort(keys)
    ordered = keys[order]
    wide = table == "words"
    cut = np.flatnonzero(np.diff((ordered >> U(64 - model.part_bits)).astype(np.int64), prepend=-1))
    for a, b in pieces(cut, len(order)):
        part = int(ordered[a] >> U(64 - model.part_bits))
        at = _places(model, table, part, ordered[a:b], wide)
        hit = np.flatnonzero(at >= 0)
        at = at[hit]
        codes = _mapped(model.path(table, part, "codes"), code)[at]
        got = decoded(codes) if code is np.uint16 else codes.astype(np.int64)[:, None]
        over = np.flatnonzero(codes == FULL[codes.dtype.itemsize])
        if len(over):
            row = np.searchsorted(_mapped(model.path(table, part, "over-at"), np.int64), at[over])
            got[over] = _mapped(model.path(table, part, "over"), np.int64).reshape(-1, width)[row]
        values[order[a + hit]] = got
        if wide:
            places[order[a + hit]] = at + model.bases[part]
    return values, places


def numbered(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of words, 0 for those not in training; their counts)."""
    distinct, which = np.unique(codes, return_inverse=True)
    counts, places = found(model, "words", distinct, np.uint8, 1)
    return np.where(places < 0, 0, places + FIRST).astype(model.kind)[which], counts[:, 0][which]


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """The rows of a partition that is sorted by g, group by group, as lists by column."""
    own, held = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["g"] != own:
                if held:
                    yield own, held
                own, held = row["g"], {k: [] for k in row}
            for k, x in row.items():
                held[k].append(x)
    if held:
        yield own, held


def dealt(model: Model, rows: DataFrame) -> DataFrame:
    """Rows (g, ..) by part, each part's groups in order in one task."""
    return rows.withColumn("part", F.shiftright("g", model.bits - model.part_bits)).repartition(1 << model.part_bits, "part").sortWithinPartitions("part", "g").drop("part")


def by_part(model: Model, batches: Iterator[pa.RecordBatch], tables: dict[str, bool]) -> Iterator[tuple[int, dict[str, list], dict[str, Writer]]]:
    """Groups of a partition and the writers (wide or not) of their part; writers are closed behind a part's last group."""
    own, writers = None, {}
    for g, rows in by_group(batches):
        part = g >> (model.bits - model.part_bits)
        if part != own:
            for w in writers.values():
                w.close()
            own, writers = part, {t: Writer(model, t, part, wide) for t, wide in tables.items()}
        yield g, rows, writers
    for w in writers.values():
        w.close()


def _local(spark) -> str:
    """The shared folder as a path that workers can map files from."""
    url = urllib.parse.urlparse(shared_folder(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped and needs a shared folder mounted on all machines, not {url.scheme}:")
    return url.path


def _held(batches: Iterator[pa.RecordBatch], made, size) -> Iterator[list]:
    """What made() gives for each step, in lists of some HELD tokens by size()."""
    held, n = [], 0
    for whole in batches:
        for batch in steps(whole, 1):
            held.append(made(batch))
            n += size(held[-1])
            if n >= HELD:
                yield held
                held, n = [], 0
    if held:
        yield held


def _count_words(training: DataFrame, model: Model) -> None:
    """Write the words with their counts; fill in their number, the first number of each part, and what the commonest are dealt over."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, lambda b: tokens(b, 1)[0], len):
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            group = (codes >> U(64 - model.bits)).astype(np.int64)
            parts = pieces(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            columns = [pa.array([int(group[a]) for a, _ in parts], pa.int64()), *(pa.array([f(x[a:b]) for a, b in parts], pa.binary()) for f, x in ((bytes, codes), (lambda x: packed(fitting(x)), counts)))]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "key", "n"])

    names = ["part", "n", "distinct", "words", "counts"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, rows, writers in by_part(model, batches, {"words": True}):
            before = writers["words"].n
            keys, at = np.unique(np.concatenate([np.frombuffer(x, U) for x in rows["key"]]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([unpacked(x) for x in rows["n"]]).astype(np.int64)).astype(np.int64)
            writers["words"].add(keys, count_codes(counts), counts[:, None])
            most = np.argsort(-counts, kind="stable")[:64]
            part = g >> (model.bits - model.part_bits)
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([part], [int(counts.sum())], [len(keys)], [(before + most).tolist()], [counts[most].tolist()]), strict=True)), out_schema)

    out_schema = pa.schema([(k, pa.list_(pa.int64()) if k in names[3:] else pa.int64()) for k in names])
    out = dealt(model, training.mapInArrow(count, "g long, key binary, n binary")).mapInArrow(merge, "part long, n long, distinct long, words array<long>, counts array<long>")
    out = written(out, "word-counts")
    sizes = np.zeros(1 << model.part_bits, np.int64)
    for r in out.groupBy("part").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct")).collect():
        sizes[r["part"]] = r["distinct"]
        model.n_tokens += r["n"]
    model.bases = np.cumsum(sizes) - sizes
    model.n_words = int(sizes.sum())
    groups = 1 << model.bits
    # no more than 2 * groups words have such a share of the tokens
    common = out.select("part", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("part", "x.*").where(F.col("counts") * 2 * groups > model.n_tokens)
    spreads = {FIRST + int(model.bases[r["part"]]) + r["words"]: r["counts"] for r in common.collect()}
    # every text has one start, as it has one end
    n_texts = int(found(model, "words", np.array([END]), np.uint8, 1)[0][0, 0])
    if n_texts * 2 * groups > model.n_tokens:
        spreads[START] = n_texts
    words = sorted(spreads)
    model.common = np.array(words, np.int64)
    model.spreads = np.array([min(groups, -(-2 * groups * spreads[w] // model.n_tokens)) for w in words], np.int64)


def _dense(model: Model, name: str, kind: type, width: int) -> np.ndarray:
    """An array by number of word, mapped."""
    return _mapped(f"{model.folder}/{name}", kind).reshape(-1, width)


def train(training: DataFrame) -> Model:
    """Count and store the model of (doc_id, text)."""
    spark = training.sparkSession
    folder = f"{_local(spark)}/lm-{uuid.uuid4().hex}"
    os.makedirs(folder)
    size = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(1, (size // (5 * GROUPED)).bit_length())
    model = Model(folder, min(bits, PARTS), bits, min(bits + max(1, (GROUPED // 32).bit_length()), 60))
    _count_words(training, model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            codes, starts = tokens(batch, 1)
            return trigrams(numbered(model, codes)[0], starts)

        for held in _held(batches, made, lambda x: len(x[0])):
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            order = in_order(v, u, w)
            u, v, w = u[order], v[order], w[order]
            at = runs(v, u, w)
            counts = np.diff(at, append=len(u))
            u, v, w = u[at], v[at], w[at]
            group = model.group(v, model.salt(v, w))
            order = np.argsort(group.astype(np.min_scalar_type(1 << model.bits)), kind="stable")
            u, v, w, counts, group = u[order], v[order], w[order], counts[order], group[order].astype(np.int64)
            columns: list[list] = [[] for _ in range(8)]
            for a, b in pieces(np.flatnonzero(np.diff(group, prepend=-1)), len(group)):
                # a middle word once for its run, and the word before it once for the run of both
                one, two = runs(v[a:b]), runs(v[a:b], u[a:b])
                many = np.flatnonzero(counts[a:b] > 1)
                fields = (v[a:b][one], fitting(np.diff(one, append=b - a)), u[a:b][two], fitting(np.diff(two, append=b - a)), w[a:b], many.astype(np.uint32), fitting(counts[a:b][many]))
                for c, x in zip(columns, (int(group[a]), *map(packed, fields)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["g", "v", "v_runs", "u", "u_runs", "w", "many", "counts"])

    out_schema = pa.schema([("part", pa.int64()), ("w", pa.binary()), ("before", pa.binary()), ("v", pa.binary()), ("sums", pa.binary()), ("tri", pa.list_(pa.int64())), ("bi", pa.list_(pa.int64())), ("start", pa.list_(pa.int64()))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write a part's n-grams; hand on, by range of words, what each group knows of single words."""
        of = lambda x: [int(np.count_nonzero(x == k)) for k in range(1, 5)]
        for _, rows, writers in by_part(model, batches, {"tri": False, "ctx": False, "bi": False}):
            us, vs, ws, cs = [], [], [], []
            for v, v_runs, u, u_runs, w, many, counts in zip(*(rows[k] for k in ("v", "v_runs", "u", "u_runs", "w", "many", "counts")), strict=True):
                vs.append(np.repeat(unpacked(v), unpacked(v_runs)))
                us.append(np.repeat(unpacked(u), unpacked(u_runs)))
                ws.append(unpacked(w))
                c = np.ones(len(ws[-1]), np.int64)
                c[unpacked(many)] = unpacked(counts)
                cs.append(c)
            u, v, w, c = (np.concatenate(x) for x in (us, vs, ws, cs))
            order = in_order(v, u, w)
            u, v, w, c = u[order], v[order], w[order], c[order]
            at = runs(v, u, w)
            u, v, w, c = u[at], v[at], w[at], np.add.reduceat(c, at)
            group = model.group(v, model.salt(v, w))
            writers["tri"].add(model.key(group, hashed(u, v, w)), count_codes(c), c[:, None])
            at = runs(v, u)
            sums = sums_of(c, at)
            writers["ctx"].add(model.key(group[at], hashed(u[at], v[at])), sum_codes(sums), sums)
            tri = of(c)
            # bigrams: an adjusted count is the number of distinct words before, but the plain count after a start
            order = in_order(v, w, u)
            v, w, c = v[order], w[order], c[order]
            at = runs(v, w)
            n = np.diff(at, append=len(v))
            v, w = v[at], w[at]
            n = np.where(v == START, np.add.reduceat(c, at), n)
            writers["bi"].add(model.key(group[0].repeat(len(v)), hashed(v, w)), count_codes(n), n[:, None])
            at = runs(v)
            v, sums = v[at], sums_of(n, at)
            last, n_before = np.unique(w, return_counts=True)
            start = v == START
            lists: dict[str, list] = {k: [None] for k in out_schema.names} | {"part": [-1], "tri": [tri], "bi": [of(n)], "start": [sums[start].sum(0).tolist()]}
            v, sums = v[~start], sums[~start]
            parts = [np.searchsorted(model.bases, x.astype(np.int64) - FIRST, "right") - 1 for x in (last, v)]
            for part in np.unique(np.concatenate(parts)).tolist():
                of_last, of_v = parts[0] == part, parts[1] == part
                row = {"part": part, "w": packed(last[of_last]), "before": packed(fitting(n_before[of_last])), "v": packed(v[of_v]), "sums": packed(fitting(sums[of_v].ravel()))}
                for k, x in lists.items():
                    x.append(row.get(k))
            yield pa.RecordBatch.from_pydict(lists, out_schema)

    for name, bytes_each in (("uni", 8), ("ctx1", 32)):
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(model.n_words * bytes_each)

    def singles(table: pa.Table) -> pa.Table:
        """Write what is known of each word of a range: in how many distinct words' wake it comes, and its sums as a context."""
        part = table.column("part")[0].as_py()
        base = int(model.bases[part])
        size = int(np.append(model.bases, model.n_words)[part + 1]) - base
        uni, sums = np.zeros(size, np.int64), np.zeros((size, 4), np.int64)
        for row in table.to_pylist():
            uni[unpacked(row["w"]).astype(np.int64) - (FIRST + base)] += unpacked(row["before"]).astype(np.int64)
            at = unpacked(row["v"]).astype(np.int64) - (FIRST + base)
            sums[at] += unpacked(row["sums"]).astype(np.int64).reshape(-1, 4)
        for name, x in (("uni", uni), ("ctx1", sums)):
            # a range of a file of fixed size: a task that runs again writes equal bytes
            with open(f"{folder}/{name}", "r+b") as f:
                f.seek(base * x.itemsize * (x.size // max(1, size)))
                f.write(x.tobytes())
        return pa.table({"n": pa.array([[int((uni == k).sum()) for k in range(1, 5)] + [int((uni > 2).sum()), int(uni.sum())]], pa.list_(pa.int64()))})

    schema = "g long, v binary, v_runs binary, u binary, u_runs binary, w binary, many binary, counts binary"
    out = dealt(model, training.mapInArrow(count, schema)).mapInArrow(merge, "part long, w binary, before binary, v binary, sums binary, tri array<long>, bi array<long>, start array<long>")
    out = written(out, "single-words")
    sums = lambda df, c, k: [x or 0 for x in df.agg(*(F.sum(F.element_at(c, i + 1)) for i in range(k))).first()]
    tri, bi, model.start = (sums(out.where("part < 0"), c, 4) for c in ("tri", "bi", "start"))
    uni = sums(written(out.where("part >= 0").select("part", "w", "before", "v", "sums").groupBy("part").applyInArrow(singles, "n array<long>"), "unigrams"), "n", 6)

    def discounts(n: list[int]) -> list[float]:
        """Of counts 1, 2 and more; where too few counts are there to estimate them: 0.5, 1 and 1.5."""
        if min(n[:4]) == 0:
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]

    model.discounts = [discounts(uni), discounts(bi), discounts(tri)]
    model.types = float(uni[5])
    d = model.discounts[0]
    left = (uni[0] * d[0] + uni[1] * d[1] + uni[4] * d[2]) / model.types if model.types else 1.0
    model.floor = left / (model.n_words + 1)
    return model


def _discounted(model: Model, order: int, counts: np.ndarray) -> np.ndarray:
    return counts - np.array([0.0, *model.discounts[order - 1]])[np.minimum(counts, 3)]


def _backed_off(model: Model, order: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the total of a context, the weight of what is shorter); contexts that were never seen back off wholly."""
    total = sums[:, 0]
    seen = total > 0
    safe = np.where(seen, total, 1)
    return safe, np.where(seen, (sums[:, 1:] @ np.array(model.discounts[order - 1])) / safe, 1.0)


def _contexts(model: Model, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sums of contexts of two words, over all groups that their second word is spread over."""
    spread = model.spread(v)
    code = hashed(u, v)
    out = np.zeros((len(v), 4), np.int64)
    for salt in range(int(spread.max(initial=0))):
        at = np.flatnonzero(spread > salt)
        out[at] += found(model, "ctx", model.key(model.group(v[at], np.full(len(at), salt)), code[at]), np.uint16, 4)[0]
    return out


def probabilities(model: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """p(w | u, v) for arrays of numbers of words."""
    uni, ctx1 = _dense(model, "uni", np.int64, 1), _dense(model, "ctx1", np.int64, 4)
    order = in_order(v, u, w)
    at = runs(v[order], u[order], w[order])
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(at)), np.diff(at, append=len(order)))
    u, v, w = (x[order][at] for x in (u, v, w))

    # each distinct trigram; pairs of words once for their run
    pair = runs(v, u)
    of_pair = np.repeat(np.arange(len(pair)), np.diff(pair, append=len(v)))
    known = w >= FIRST
    n = np.zeros(len(w), np.int64)
    n[known] = uni[w[known].astype(np.int64) - FIRST, 0]
    p = np.maximum(_discounted(model, 1, n), 0) / max(model.types, 1) + model.floor

    sums = np.zeros((len(pair), 4), np.int64)
    pv, pu = v[pair], u[pair]
    known = pv >= FIRST
    sums[known] = ctx1[pv[known].astype(np.int64) - FIRST]
    sums[pv == START] = model.start
    total, back = _backed_off(model, 2, sums)
    group = model.group(v, model.salt(v, w))
    n = found(model, "bi", model.key(group, hashed(v, w)), np.uint8, 1)[0][:, 0]
    p = _discounted(model, 2, n) / total[of_pair] + back[of_pair] * p

    total, back = _backed_off(model, 3, _contexts(model, pu, pv))
    n = found(model, "tri", model.key(group, hashed(u, v, w)), np.uint8, 1)[0][:, 0]
    return (_discounted(model, 3, n) / total[of_pair] + back[of_pair] * p)[which]


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, scored by a model of the rows that aren't held out.

    held_out is a condition on doc_id. Tokens: runs without white space, A-Z
    lower-cased, then one end. base_score sums log10((c + 1) / (N + V + 1))
    over a text's tokens; score sums log10 of the trigram model's probability,
    and perplexity is 10 ** (-score / n_tokens).

    Null and empty texts have the end alone, in training too. Repeated rows
    count each time. A null doc_id is held out. Without any training rows all
    probabilities are one. An empty table gives an empty one; other columns are
    not read. Words are told apart by 64 bits of hash, n-grams by 32 bits and
    those of their bucket, 64 at most.

    The model is counted and the rows are scored when this is called; the model
    is deleted then, and what is returned reads the scores from the shared folder.
    """
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    model = train(rows.where(~F.col("held_out")).select("doc_id", "text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, 1, SCORED):
                codes, starts = tokens(batch, 1)
                words, counts = numbered(model, codes)
                base = np.log10((counts + 1) / (model.n_tokens + model.n_words + 1))
                logs = np.log10(probabilities(model, *trigrams(words, starts)))
                n = np.diff(starts)
                total = np.add.reduceat(logs, starts[:-1])
                columns = [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n, pa.int64()),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts[:-1])),
                    pa.array(np.full(len(n), model.n_tokens), pa.int64()),
                    pa.array(np.add.reduceat(base, starts[:-1])),
                    pa.array(total),
                    pa.array(10 ** (-total / n)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    out = written(rows.mapInArrow(apply, SCHEMA), "scores")
    shutil.rmtree(model.folder)
    return out
