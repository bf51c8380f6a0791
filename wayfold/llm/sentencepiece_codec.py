"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Each chunk of a text starts as one symbol per character. An agenda holds all
adjacent pairs whose concatenation is a piece; the pair of the highest score
(leftmost among equals) merges, and its two new neighbours enter the agenda.
The agendas of many distinct chunks run in lock-step on numpy matrices; those of
long chunks are heaps. No piece holds a space after a non-space, so no merge
crosses the border between a word and the space that follows, and the distinct
chunks of a batch are encoded once. Every text then goes through the
sentencepiece library too, and has to come out the same.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wayfold.llm.tables import id_and_text
from wayfold.llm.wordcode import steps

SPACE = "▁"
NONE = np.int32(2**31 - 1)
LONGEST_IN_STEP = 32
#: Bytes of text whose distinct chunks are encoded together; a worker takes about 140 MB for it.
STEP = 2_000_000

SCHEMA = "doc_id long, n_tokens long, ids string, decoded string, ids_sha256 string, decoded_sha256 string"


class Codec:
    """The tables of one model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        self.end = lib.eos_id()
        normal = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece holds a space after a non-space; chunks would not be independent")
        symbols = {pieces[i]: i for i in normal}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = [b""] * size
        for i in range(size):
            if lib.is_byte(i):
                value = int(pieces[i][3:5], 16)
                self.byte_ids[value] = i
                self.raw[i] = bytes([value])
        for i in normal:
            self.raw[i] = pieces[i].replace(SPACE, " ").encode()
        self.n_pieces = size
        for ch in sorted({c for i in normal for c in pieces[i]}):
            symbols.setdefault(ch, len(symbols) + size)
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for ch, i in symbols.items():
            if len(ch) == 1:
                self.char_symbol[ord(ch)] = i
        scores = {i: lib.get_score(i) for i in normal}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for i in normal:
            for cut in range(1, len(pieces[i])):
                left, right = symbols.get(pieces[i][:cut]), symbols.get(pieces[i][cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = (rank[scores[i]], i)
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.pairs.values()], np.int32)[order]
        self.merged = np.array([m for _, m in self.pairs.values()], np.int32)[order]
        self.names = pa.array([str(i) for i in range(size)])

    # -- agenda ---------------------------------------------------------

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def _in_step(self, symbols: np.ndarray) -> np.ndarray:
        """Merge all rows of a matrix of symbols until no row has a pair left; merged places hold -2 but for their first."""
        n, width = symbols.shape
        flat = symbols.ravel().copy()
        if width < 2:
            return flat.reshape(n, width)
        # the agenda: for each place the rank of the pair that begins there, and what it merges into
        rank, into = np.full((n, width), NONE), np.full((n, width), -1, np.int32)
        rank[:, :-1], into[:, :-1] = self._look_up(symbols[:, :-1], symbols[:, 1:])
        into = into.ravel()
        place = np.arange(n * width).reshape(n, width)
        after, before = place + 1, place - 1
        after[:, -1] = before[:, 0] = -1
        after, before = after.ravel(), before.ravel()
        row = np.arange(n)
        while len(row):
            part = rank if len(row) == n else rank[row]
            best = part.argmin(1)
            live = part[np.arange(len(row)), best] != NONE
            row, best = row[live], best[live]
            left = row * width + best
            right = after[left]
            flat[left], flat[right] = into[left], -2
            then = after[right]
            after[left] = then
            ranks = rank.reshape(-1)
            ranks[left] = ranks[right] = NONE
            follows, leads = then >= 0, before[left] >= 0
            before[then[follows]] = left[follows]
            first = np.concatenate([left[follows], before[left[leads]]])
            second = np.concatenate([then[follows], left[leads]])
            ranks[first], into[first] = self._look_up(flat[first], flat[second])
        return flat.reshape(n, width)

    def _by_heap(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def enter(a: int, b: int) -> None:
            if a >= 0 and b < n and (found := self.pairs.get((symbols[a], symbols[b]))):
                heapq.heappush(agenda, (found[0], a, symbols[a], symbols[b], found[1]))

        for i in range(n - 1):
            enter(i, i + 1)
        while agenda:
            _, a, left, right, won = heapq.heappop(agenda)
            b = after[a]
            if symbols[a] != left or b >= n or symbols[b] != right:
                continue
            symbols[a], symbols[b] = won, -3
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            enter(before[a], a)
            enter(a, after[a])
        return [s for s in symbols if s != -3]

    def _with_bytes(self, chunk: str, symbols: list[int]) -> list[int]:
        """Symbols that are no piece fall back to bytes."""
        ids, at = [], 0
        for s in symbols:
            if 0 <= s < self.n_pieces:
                ids.append(s)
                at += len(self.raw[s].decode())
            else:
                ids.extend(self.byte_ids[b] for b in chunk[at].encode())
                at += 1
        return ids

    def encode_chunks(self, chunks: list[str]) -> tuple[pa.ListArray, list[str]]:
        """Ids of distinct chunks (given without their first space), and what they decode to."""
        decoded = [" " + c for c in chunks]
        if not chunks:
            return pa.array([], pa.list_(pa.int32())), decoded
        start = self.char_symbol[np.frombuffer((SPACE + SPACE.join(chunks)).replace(" ", SPACE).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter((len(c) for c in decoded), np.int64, len(chunks))
        first = np.cumsum(sizes) - sizes
        lists, rows = [], []
        odd: dict[int, list[int]] = {}
        for i in np.flatnonzero(sizes > LONGEST_IN_STEP).tolist():
            odd[i] = self._by_heap(start[first[i] : first[i] + sizes[i]].tolist())
        for w in np.unique(sizes[sizes <= LONGEST_IN_STEP]).tolist():
            same = np.flatnonzero(sizes == w)
            for k in range(0, len(same), 50_000):
                part = same[k : k + 50_000]
                done = self._in_step(start[first[part][:, None] + np.arange(w)])
                counts = (done != -2).sum(1)
                fall = (((done < 0) & (done != -2)) | (done >= self.n_pieces)).any(1)
                for j in np.flatnonzero(fall).tolist():
                    odd[int(part[j])] = done[j][done[j] != -2].tolist()
                done, counts = done[~fall], counts[~fall]
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(done[done != -2], pa.int32())))
                rows.append(part[~fall])
        for i, symbols in odd.items():
            # without byte fallback the pieces' concatenation is the chunk
            ids = self._with_bytes(decoded[i], symbols) if any(s < 0 or s >= self.n_pieces for s in symbols) else symbols
            odd[i] = ids
            decoded[i] = b"".join([self.raw[s] for s in ids]).decode(errors="replace")
        lists.append(pa.array(list(odd.values()), pa.list_(pa.int32())))
        rows.append(np.array(list(odd), np.int64))
        return pa.concat_arrays(lists).take(pa.array(np.argsort(np.concatenate(rows)))), decoded

    # -- texts ----------------------------------------------------------

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text, each without its first space."""
        text = text.replace(SPACE, " ")
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in re.findall(r" +[^ ]+| +", " " + text)]
        return text.split(" ")

    def _joined(self, ends: np.ndarray, ids: pa.Array) -> list[str]:
        """The ids of each text, joined by a space."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.names.take(ids)), " ").to_pylist()

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by a space, decoded text) of each text."""
        split = [self.chunks(t) for t in texts]
        at = np.concatenate([[0], np.cumsum([len(s) for s in split])])
        coded = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        ids, decoded = self.encode_chunks(coded.dictionary.to_pylist())
        ids = ids.take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])[at]
        names = self._joined(ends, ids.flatten())
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(decoded, pa.string()).take(coded.indices)), "").to_pylist()
        end = str(self.end)
        return [(n + 1, f"{x} {end}" if x else end, d[1:]) for n, x, d in zip(np.diff(ends).tolist(), names, whole, strict=True)]

    def by_library(self, text: str) -> tuple[int, str, str]:
        return self.all_by_library([text])[0]

    def all_by_library(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """What the library gives for each text."""
        ids = self.library.encode(texts, add_eos=True, num_threads=1)
        sizes = [len(i) for i in ids]
        names = self._joined(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, sum(sizes))))
        return list(zip(sizes, names, self.library.decode(ids, num_threads=1), strict=True))

    def checked_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """encode_batch, with each text held against the library."""
        found = self.encode_batch(texts)
        wrong = [i for i, x in enumerate(self.all_by_library(texts)) if found[i] != x]
        if wrong:
            raise ValueError(f"{len(wrong)} of {len(texts)} texts differ from the library's result, the first of them: {texts[wrong[0]][:200]!r}")
        return found


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One Codec for each model in a worker."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode_and_decode(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """One row for each row of docs: ids, their number and digest, and the decoded text and its digest.

    ids ends with the end id and holds no start id. Every text also goes through
    the sentencepiece library, encoding and decoding; any difference is an error.
    with_text=False leaves ids and decoded null and keeps the digests.

    Null and empty texts have the end id alone and decode to the empty string;
    repeated rows give repeated results; an empty table gives an empty one;
    null doc_id stays null; other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for whole in batches:
            for batch in steps(whole, 1, STEP):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                found = own.checked_batch(texts)
                digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] if with_text else None for f in found], pa.string()),
                        pa.array([f[2] if with_text else None for f in found], pa.string()),
                        pa.array([digest(f[1]) for f in found], pa.string()),
                        pa.array([digest(f[2]) for f in found], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(encode, SCHEMA)
