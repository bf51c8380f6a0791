"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by measures of its
characters and words and by a hashed projection of its words, then by one
layer; gated attention weighs the passages, and the weighted sum of their
codes is scored. Only documents have labels: attention learns from them which
passages tell. The model is trained on a bounded sample of labelled documents
and applied to every passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import id_and_text
from wayfold.llm.wordcode import BLANK_WORDS, U, Words, mixed, steps, words_of

PASSAGE_WORDS = 100
PROJECTED = 16
MEASURES = 21


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _LOWER, _DIGIT = np.zeros(256, np.int64), np.zeros(256, np.int64), _class("0123456789")
_UPPER[65:91] = _LOWER[97:123] = 1
_HIGH = np.zeros(256, np.int64)
_HIGH[128:] = 1
_CLASSES = [_UPPER, _LOWER, _DIGIT, _HIGH, _class("!?"), _class(".,;:"), _class("#$%&*@^~=+_\\<>"), _class("|/"), _class("()[]{}\"'`-")]


def measures(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(passages by features, where each document's passages start). A text without words is one empty passage."""
    counts = words.counts
    n_passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    n = int(first[-1])
    doc = np.repeat(np.arange(len(counts)), n_passages)
    local = np.arange(n) - first[doc]
    cut = words.ends_at[:-1][doc] + local * counts[doc] // n_passages[doc]
    size = np.diff(np.append(cut, words.ends_at[-1]))
    of = np.repeat(np.arange(n), size)
    total = np.maximum(size, 1).astype(float)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, x, n)

    length = words.stops - words.starts
    by_class = []
    for kind in _CLASSES:
        up = np.concatenate([[0], np.cumsum(kind[words.data])])
        by_class.append(up[words.stops] - up[words.starts])
    chars = np.maximum(summed(length), 1)
    code = words.codes[0]
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (of[1:] == of[:-1])
    two = np.zeros(len(code), bool)
    two[2:] = (code[2:] == code[:-2]) & (of[2:] == of[:-2])
    distinct = _distinct(of, code, n)
    lines = np.concatenate([[0], np.cumsum(words.data == 10)])
    bare = by_class[0] + by_class[1] + by_class[3] == 0
    shout = (by_class[0] > 1) & (by_class[1] == 0)
    short = length <= 3
    features = [
        *(summed(c) / chars for c in by_class),
        summed(length) / total / 10,
        np.sqrt(np.maximum(summed(length**2) / total - (summed(length) / total) ** 2, 0)) / 5,
        distinct / total,
        summed(again) / total,
        summed(two) / total,
        summed(bare) / total,
        summed(shout) / total,
        summed(short) / total,
        summed((by_class[6] > 0) & (by_class[0] + by_class[1] > 0)) / total,
        summed(lines[words.starts] - lines[np.append(words.starts[:1], words.stops[:-1])]) / total,
        np.log1p(size) / 5,
        np.log1p(counts[doc]) / 7,
    ]
    bits = mixed(code)
    projected = [summed(((bits >> U(k)) & U(1)).astype(float) * 2 - 1) / np.sqrt(total) / 3 for k in range(PROJECTED)]
    return np.stack([*features, *projected], 1).astype(np.float32), first


def _distinct(of: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """The number of distinct codes of each of n passages."""
    order = np.lexsort((code, of))
    new = np.ones(len(of), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (code[order][1:] != code[order][:-1])
    return np.bincount(of[order][new], minlength=n)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Scores of bags; first[i]:first[i+1] are the passages of bag i, one at least."""
        w = self.weights
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t, s = np.tanh(h @ w["att_v"]), 1 / (1 + np.exp(-(h @ w["att_u"])))
        logit = (t * s) @ w["att_w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(logit - np.maximum.reduceat(logit, first[:-1])[bag])
        a = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        y = 1 / (1 + np.exp(-(z @ w["out"] + w["out_b"][0])))
        return y, {"h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag}

    def gradients(self, x: np.ndarray, first: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        y, c = self.forward(x, first)
        dy = ((y - target) / len(target))[:, None]
        g = {"out": (c["z"] * dy).sum(0), "out_b": dy.sum(0)}
        dz = (dy * w["out"])[c["bag"]]
        da = (dz * c["h"]).sum(1)
        mean = np.add.reduceat(c["a"] * da, first[:-1])[c["bag"]]
        dlogit = (c["a"] * (da - mean))[:, None]
        g["att_w"] = ((c["t"] * c["s"]) * dlogit).sum(0)
        dts = dlogit * w["att_w"]
        dt, ds = dts * c["s"] * (1 - c["t"] ** 2), dts * c["t"] * c["s"] * (1 - c["s"])
        g["att_v"], g["att_u"] = c["h"].T @ dt, c["h"].T @ ds
        dh = c["a"][:, None] * dz + dt @ w["att_v"].T + ds @ w["att_u"].T
        dpre = dh * (1 - c["h"] ** 2)
        g["enc"], g["enc_b"] = x.T @ dpre, dpre.sum(0)
        return g


def fit(x: np.ndarray, first: np.ndarray, target: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 30, decay: float = 1e-4, seed: int = 5) -> Network:
    """Train by Adam on mini-batches of bags. Without bags, every score is one half."""
    random = np.random.default_rng(seed)
    width = x.shape[1]
    normal = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {"enc": normal(width, hidden), "enc_b": np.zeros(hidden), "att_v": normal(hidden, attention), "att_u": normal(hidden, attention), "att_w": normal(attention), "out": np.zeros(hidden), "out_b": np.zeros(1)}
    if not len(target):
        return Network(np.zeros(width), np.ones(width), weights)
    net = Network(x.mean(0), x.std(0) + 1e-3, weights)
    x = net.encoded(x)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = random.permutation(len(target))
        for at in range(0, len(order), 128):
            bags = order[at : at + 128]
            sizes = np.diff(first)[bags]
            rows = np.repeat(first[bags] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            step += 1
            for k, g in net.gradients(x[rows], np.concatenate([[0], np.cumsum(sizes)]), target[bags]).items():
                m, v = moments[k]
                g = g + decay * weights[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(rows: DataFrame, labels: DataFrame, sample: int) -> Network:
    """rows: (doc_id, text); labels: (doc_id, quality). Of the labelled documents, the `sample` of least hashed id."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    # at most `sample` rows of two numbers are broadcast
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, 1):
                x, first = measures(words_of(batch.column(1), BLANK_WORDS))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "quality", "x"])

    found = known.mapInArrow(encode, "doc_id long, quality double, x binary").orderBy("doc_id", "x").limit(2 * sample).collect()
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, MEASURES + PROJECTED) for r in found]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags) if bags else np.zeros((0, MEASURES + PROJECTED), np.float32)
    return fit(x, first, np.array([r["quality"] for r in found], float))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000, threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: (doc_id, held_out, score, predicted).

    score is near 1 where label 1 is likelier; predicted is 1 from the threshold
    on. held_out is a condition on doc_id; rows it holds for are not learnt
    from. `sample` bounds the labelled documents that training takes; scoring
    takes every passage of every text and nothing but the text.

    Null and empty texts are one empty passage and get that passage's score.
    Null labels and labels of unknown documents are ignored; several labels of a
    document are averaged; without any label every score is 0.5. Repeated rows
    give repeated results; a null doc_id is held out; an empty table gives an
    empty one; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("quality")).where(~F.coalesce(held_out, F.lit(True)))
    net = train(rows.select("doc_id", "text"), marks, sample)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, 1):
                x, first = measures(words_of(batch.column(1), BLANK_WORDS))
                y, _ = net.forward(net.encoded(x), first)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(y), pa.array((y >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(apply, SCHEMA)


def accepted(docs: DataFrame, labels: DataFrame, held_out: Column, text_col: str = "text", label_col: str = "quality", sample: int = 8000, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the threshold. Learns and scores as score() does."""
    mark = F.coalesce(held_out, F.lit(True))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("quality")).where(~mark)
    net = train(id_and_text(docs, "doc_id", text_col), marks, sample)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, at):
                x, first = measures(words_of(batch.column(at), BLANK_WORDS))
                y, _ = net.forward(net.encoded(x), first)
                yield batch.filter(pa.array(y >= threshold))

    return docs.mapInArrow(keep, docs.schema)
