"""SentencePiece encoding and decoding over an Aho-Corasick automaton of the pieces.

One pass over a text's characters visits, through the automaton's output links, every piece
that ends at each position, and relaxes the best segmentation up to there. What is best is
the model's matter: of a unigram model the largest sum of scores, of a BPE model the one
piece whose merges agree with the piece before it, which makes the ids those that merging in
score order gives. Characters without a piece become byte pieces. White space and the
dummy prefix are escaped as the models of identity normalisation do.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import batches, held

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Encoded words of a generation that a worker remembers. Bounds memory, not results.
REMEMBERED = 300_000
UNIGRAM, BPE = 1, 2


def model_path(name: str = MODEL, folder: str | None = None) -> str:
    """A vocabulary file of the folder, by default /opt/tokenizers."""
    return os.path.join(folder or "/opt/tokenizers", name)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class _Words(dict):
    """Words to the ids they have after a space; a first newline means at the start of a line.

    Two generations bound the memory: when one is full it becomes the old one, from which
    words that come again are taken over.
    """

    def __init__(self, model: Model):
        self.model, self.old = model, {}

    def __missing__(self, w: str) -> bytes:
        ids = self.old.get(w)
        if ids is None:
            tail, pairs = w[-2:], self.model.pairs
            if len(tail) == 2 and tail not in pairs and tail[1] in self.model.ends and w[0] != "\n":
                return self[w[:-1]] + self.model.ends[tail[1]]
            ids = self.model._ids(SPACE + w) if w[:1] != "\n" else self.model._ids(w)
        if len(w) < 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[w] = ids
        return ids


class Model:
    """A SentencePiece model file of type unigram or BPE with byte fallback."""

    def __init__(self, data: bytes, kind: int | None = None):
        import ahocorasick

        pieces, self.kind, prefix = [], UNIGRAM, True
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]), p.get(3, 1)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
        self.kind = kind or self.kind
        self.prefix = SPACE if prefix else ""
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == 2)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == 6}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        normal = {p[0]: i for i, p in enumerate(pieces) if p[2] in (1, 4) and p[0]}
        self.score = [p[1] for p in pieces]
        self.size = [len(p[0]) for p in pieces]
        self.decoded = [p[0].replace(SPACE, " ") if p[2] in (1, 4) else " ⁇ " if p[2] == 2 else "" for p in pieces]
        self.least = min((self.score[i] for i in normal.values()), default=0.0) - 10.0  # an unknown character's score
        if self.kind == BPE:
            self._merges(normal)
        # Words are segmented apart where no piece goes over a gap from other characters to the space sign.
        self.apart = not any(SPACE in w.lstrip(SPACE) for w in normal)
        self.automaton = ahocorasick.Automaton()
        for w, i in normal.items():
            if self.kind == UNIGRAM or i in self.parts:
                self.automaton.add_word(w, (i, len(w)))
        self.automaton.make_automaton()
        self.newline = not any("\n" in w for w in normal)
        # for BPE: characters that have pieces, pairs that stand side by side in some, and marks that end words
        self.chars = {w for w in normal if len(w) == 1}
        self.pairs = {w[k : k + 2] for w in normal for k in range(len(w) - 1)}
        self.agree: dict[int, bool] = {}
        self.ends = {c: array("i", [normal[c]]).tobytes() for c in ",.!?:;|*" if c in normal} if self.kind == BPE else {}
        self.cache = _Words(self)

    def _merges(self, normal: dict[str, int]) -> None:
        """rank: when a piece is merged, -1 for single characters; parts: of which two it is merged last."""
        order = sorted((i for w, i in normal.items() if len(w) > 1), key=lambda i: -self.score[i])
        self.rank = {i: -1 for w, i in normal.items() if len(w) == 1} | {i: k for k, i in enumerate(order)}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int] | None] = {i: None for w, i in normal.items() if len(w) == 1}
        names = {i: w for w, i in normal.items()}
        for w, i in sorted(normal.items(), key=lambda x: len(x[0])):
            if len(w) < 2 or any(c not in normal for c in w):
                continue
            symbols, last = [normal[c] for c in w], None
            while len(symbols) > 1:
                best = min(((self.rank[c], k, c) for k in range(len(symbols) - 1) if (c := normal.get(names[symbols[k]] + names[symbols[k + 1]])) is not None), default=None)
                if best is None:
                    break
                last = (symbols[best[1]], symbols[best[1] + 1])
                symbols[best[1] : best[1] + 2] = [best[2]]
            if symbols == [i]:
                self.parts[i] = last
            for k in range(1, len(w)):
                a, b = normal.get(w[:k]), normal.get(w[k:])
                if a is not None and b is not None:
                    self.joined[a, b] = self.rank[i]

    def agrees(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side: undo the later merge at their border step by step; no join across it may have come first."""
        rank, joined, limit = self.rank, self.joined, len(self.rank) + 1
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.parts[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.parts[b][0]
            else:
                return True

    def _merged(self, w: str) -> list[int]:
        """Of text whose characters all have pieces: the piece that ends at each position and agrees with the one before it; there is one for each."""
        agree, back, reached = self.agree, [0] * (len(w) + 1), 0
        for end, (piece, size) in self.automaton.iter(w):
            if end >= reached:
                before = back[end + 1 - size]
                if size <= end:
                    key = before << 20 | piece
                    ok = agree[key] if key in agree else self._ask(key)
                    if not ok:
                        continue
                back[end + 1] = piece
                reached = end + 1
        out, at, sizes = [], len(w), self.size
        while at:
            piece = back[at]
            out.append(piece)
            at -= sizes[piece]
        out.reverse()
        return out

    def _ask(self, key: int) -> bool:
        if len(self.agree) > 1_000_000:
            self.agree.clear()
        ok = self.agree[key] = self.agrees(key >> 20, key & 0xFFFFF)
        return ok

    def _viterbi(self, w: str) -> list[int]:
        """The segmentation of the largest score; -1 marks a character without a piece, at the score of an unknown one."""
        n, size, score, least = len(w), self.size, self.score, self.least
        best, back, done = [0.0] + [None] * n, [-1] * (n + 1), 0
        for end, (piece, _) in (*self.automaton.iter(w), (n, (-1, 0))):
            while done < end:  # all pieces that end up to here are seen
                done += 1
                if best[done] is None:
                    best[done] = best[done - 1] + least
            if piece >= 0:
                s = best[end + 1 - size[piece]] + score[piece]
                if best[end + 1] is None or s > best[end + 1]:
                    best[end + 1], back[end + 1] = s, piece
        out, at = [], n
        while at:
            piece = back[at]
            out.append(piece)
            at -= size[piece] if piece >= 0 else 1
        return out[::-1]

    def _fallback(self, c: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in c.encode("utf-8", "replace")]

    def _ids(self, w: str) -> bytes:
        out, at = [], 0
        if self.kind == BPE and self.chars.issuperset(w):
            out = self._merged(w)
        elif self.kind == BPE:  # no merge goes over a character without a piece
            while at < len(w):
                end = at
                while end < len(w) and w[end] in self.chars:
                    end += 1
                out += self._merged(w[at:end]) if end > at else []
                out += self._fallback(w[end]) if end < len(w) else []
                at = end + 1
        else:
            for piece in self._viterbi(w):
                out += [piece] if piece >= 0 else self._fallback(w[at])
                at += self.size[piece] if piece >= 0 else 1
        return array("i", out).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; none of null or empty text."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        if not (self.apart and self.prefix) or SPACE in text:
            return np.frombuffer(self._ids(self.prefix + text.replace(" ", SPACE)), dtype=np.int32)
        cache, out = self.cache, []
        for k, line in enumerate(text.split("\n") if self.newline else (text,)):
            words = line.split(" ")
            if k:
                words[0] = "\n" + words[0]  # no dummy prefix, and the newline's own ids
            if "" in words:
                out.append(self._spaced(words))
            else:
                out += [cache[w] for w in words]
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def _spaced(self, words: list[str]) -> bytes:
        """Words parted by one space each, some of them empty: a run of spaces is segmented with the word after it."""
        out, run = [], 0
        for w in words:
            if w == "":
                run += 1
            elif run:
                out.append(self._ids(SPACE * (run + 1) + w))
                run = 0
            else:
                out.append(self.cache[w])
        if run:
            out.append(self._ids(SPACE * run))
        return b"".join(out)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text: byte pieces are read as UTF-8, and the dummy prefix goes."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        table, of_byte = self.decoded, self.of_byte
        out = "".join([table[i] for i in ids]) if not (of_byte.keys() & set(ids)) else self._with_bytes(ids)
        return out[1:] if self.prefix and out.startswith(" ") else out

    def _with_bytes(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.decoded[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)


def load(path: str, kind: int | None = None) -> Model:
    def build() -> Model:
        with open(path, "rb") as f:
            return Model(f.read(), kind)

    return held(("pieces", path, kind), build)


SCHEMA = "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean"


def encode(docs: DataFrame, path: str, kind: int | None = None) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip of every row of docs; kind reads the model's pieces as of another type than its own.

    round_trip: decoding gives the text again (not so where it holds the space sign U+2581
    itself). Null text is empty: no ids. Texts of any length are encoded whole. Of
    segmentations of equal score that with the longer last piece is taken. Repeated rows are
    encoded as often as they stand, null ids are carried, other columns are ignored, and an
    empty table gives none. The model file is one that every executor has.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, kind)
        for b in batches(it, 1000):
            texts = b.column(1).to_pylist()
            ids = [model.encode(t) for t in texts]
            good = [model.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
            sizes = np.array([len(i) for i in ids], dtype=np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), lists, pa.array(good, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id, token_ids; null ids give null text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches(it, 1000):
            text = [None if i is None else model.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("token_ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
