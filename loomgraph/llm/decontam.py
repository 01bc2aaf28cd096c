"""Benchmark decontamination: rare pairs of words as seeds, then Smith-Waterman alignment.

Words are lower-cased runs of ASCII letters, digits and underscores and of all characters
beyond ASCII. Documents are aligned with an item word by word (match 2, mismatch -1, gap
-1). The score is the best alignment's share of a verbatim copy's.

Seeds miss no alignment of that score. A step from a match to the next gives 2 less the
words it skips on the longer side, so steps of 2 or more skipped words give nothing. Every
word of an item forms seeds with the next two; one that recurs in a document with as many
words apart in both gives 2 if adjacent, else 1. If m words match, the m - 1 steps give at
least the score less 2, so an item is aligned only where seeds at different places, within
the width of an alignment, add up to that. The places whose seeds most documents hold,
counted over all of them, are left out, and each lowers the sum needed by 2.

Test items are taken in blocks of bounded size; each block is one pass with its seeds in the
tasks' closure, so memory doesn't grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import BROADCAST_BYTES, batches, cut, held

#: Words of a seed are at most NEAR apart: a step over more words costs as much as a match gives.
NEAR, MATCH, MISMATCH, GAP = 2, 2, -1, -1
THRESHOLD, BLOCK_BYTES = 0.5, 4 << 20
#: ASCII characters that aren't of a word become spaces.
SPACES = bytes(c if c >= 128 or chr(c).isalnum() or c == ord("_") else 32 for c in range(256))
ROWS = 250


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(SPACES).split() if text else []


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score of word ids a against b, and the stretch [start, end) of b it covers; negative ids match nothing."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        step = GAP * np.arange(len(b) + 1)
        row, top, end = np.zeros(len(b) + 1, dtype=np.int64), 0, 0
        for x in a:
            new = np.zeros(len(b) + 1, dtype=np.int64)
            new[1:] = np.maximum(np.maximum(row[:-1] + np.where((b == x) & (b >= 0), MATCH, MISMATCH), row[1:] + GAP), 0)
            row = np.maximum.accumulate(new - step) + step  # gaps along b
            if row.max() > top:
                top, end = int(row.max()), int(row.argmax())
        return top, end

    top, end = best(a, b)
    if not top:
        return 0, 0, 0
    _, back = best(a[::-1], b[:end][::-1])
    return top, end - back, end


_R, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_R, -1, 1 << 64)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, as many as were asked for at least."""
    have = held("powers", lambda: [np.zeros(0, dtype=np.uint64)] * 2)
    if len(have[0]) < size:
        have[:] = _series(size)
    return have[0], have[1]


def _series(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for r in (_R, _INVERSE):
        p = np.full(size, r, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Stream:
    """The words of several texts with a 64-bit hash of each, from prefix sums over the bytes."""

    def __init__(self, texts: list[str | None]):
        raw = [t.lower().encode("utf-8", "replace").translate(SPACES) + b" " if t else b" " for t in texts]
        self.blob = b"".join(raw)
        a = np.frombuffer(self.blob, dtype=np.uint8)
        edges = np.diff((a != 32).view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        power, inverse = _powers(1 << max(20, (len(a)).bit_length()))
        sums = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(a * power[: len(a)], out=sums[1:])
        self.hash = _mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, np.concatenate(([0], np.cumsum([len(r) for r in raw]))))

    def pairs(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that one text has d words before another, and the hashes of both; of single words, where d is 0."""
        n = max(0, len(self.hash) - d)
        at = np.arange(n)
        if not d:
            return at, _mix(self.hash)
        inside = np.ones(n, dtype=bool)
        for k in range(1, d + 1):
            cut = self.first[1:] - k
            inside[cut[(cut >= 0) & (cut < n)]] = False
        at = at[inside]
        return at, _mix(_mix(self.hash[at]) + self.hash[at + d] + np.uint64(2))

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.blob[i:j] for i, j in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


class Index:
    """Seeds of some items: pairs of words, or words where one match is enough. codes are sorted hashes; the postings of code k are rows at[k] to at[k + 1] of item, place and apart."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.threshold = threshold
        self.ids = [i for i, _ in split]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, s in split for w in s))}
        self.items = [self.numbers(s) for _, s in split]
        self.sizes = np.array([len(s) for _, s in split], dtype=np.int64)
        score = MATCH * self.sizes * threshold
        self.least = score - MATCH
        self.single = self.least <= 1e-9
        self.least[self.single] = MATCH
        self.width = np.maximum(self.sizes, np.ceil((MATCH + 1) * self.sizes - score).astype(np.int64))
        stream = Stream([b" ".join(s).decode("utf-8") for _, s in split])
        parts = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
        for d in range(NEAR + 1):
            at, g = stream.pairs(d)
            k = np.searchsorted(stream.first, at, side="right") - 1
            own = self.single[k] == (d == 0)
            parts.append((g[own], k[own], at[own] - stream.first[k[own]], np.full(own.sum(), d)))
        self._file(*map(np.concatenate, zip(*parts, strict=True)))

    def _file(self, code: np.ndarray, item: np.ndarray, place: np.ndarray, apart: np.ndarray) -> None:
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        self.item, self.place, self.apart, self.at = item[order], place[order], apart[order], np.append(first, len(order))
        self.maybe = np.zeros(1 << 18, dtype=bool)
        self.maybe[self.codes >> np.uint64(46)] = True

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), dtype=np.int64, count=len(ws))

    def choose(self, holders: np.ndarray) -> None:
        """Leave out the places of each item whose seeds most texts hold, as many as take at most half of what is needed."""
        starts = np.cumsum(self.sizes) - self.sizes
        cell = starts[self.item] + self.place
        common = np.bincount(cell, weights=np.repeat(holders, np.diff(self.at)), minlength=int(self.sizes.sum()))
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.lexsort((-common, owner))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - starts[owner]
        spare = np.where(self.single, 0, self.least // (2 * MATCH)).astype(np.int64)
        keep = rank[cell] >= spare[self.item]
        self.least = self.least - MATCH * spare
        self._file(np.repeat(self.codes, np.diff(self.at))[keep], self.item[keep], self.place[keep], self.apart[keep])

    def hits(self, texts: list[str | None]) -> tuple[Stream, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' words, and positions, seeds and words apart of the hits."""
        stream = Stream(texts)
        found = [[np.zeros(0, np.int64)] * 3]
        for d in range(0 if self.single.any() else 1, NEAR + 1):
            at, g = stream.pairs(d)
            may = self.maybe[g >> np.uint64(46)]
            at, g = at[may], g[may]
            k = np.minimum(np.searchsorted(self.codes, g), len(self.codes) - 1)
            good = self.codes[k] == g
            found.append([at[good], k[good], np.full(good.sum(), d)])
        return (stream, *map(np.concatenate, zip(*found, strict=True)))

    def holders(self, texts: list[str | None]) -> np.ndarray:
        """For each seed, how many of the texts hold it."""
        stream, at, seed, _ = self.hits(texts)
        doc = np.searchsorted(stream.first, at, side="right") - 1
        return np.bincount(np.unique(doc * max(1, len(self.codes)) + seed) % max(1, len(self.codes)), minlength=len(self.codes))

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """(index of the text, item id, score, first word, past the last word) where a text holds an item; of several copies the best."""
        stream, at, seed, apart = self.hits(texts)
        if not len(at):
            return []
        reps = self.at[seed + 1] - self.at[seed]
        ends = np.cumsum(reps)
        flat = np.arange(ends[-1]) - np.repeat(ends - reps, reps) + np.repeat(self.at[seed], reps)
        item, place, pos = self.item[flat], self.place[flat], np.repeat(at, reps)
        worth = MATCH + GAP * (np.maximum(1, np.maximum(self.apart[flat], np.repeat(apart, reps))) - 1)
        doc = np.searchsorted(stream.first, pos, side="right") - 1
        key = doc * len(self.items) + item
        _, where = np.unique(key, return_inverse=True)
        may = np.bincount(where, weights=worth)[where] >= self.least[item] - 1e-9
        key, item, place, pos, worth, doc = (x[may] for x in (key, item, place, pos, worth, doc))
        # an alignment lies in two neighbouring stretches of its greatest width, and passes each place once
        stretch = (pos - stream.first[doc]) // self.width[item]
        back = stretch > 0
        key, item, place, worth = (np.concatenate((x, x[back])) for x in (key, item, place, worth))
        stretch = np.concatenate((stretch, stretch[back] - 1))
        order = np.lexsort((-worth, place, stretch, key))
        key, item, place, worth, stretch = (x[order] for x in (key, item, place, worth, stretch))
        moved = lambda *xs: np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in xs], axis=0)))) if len(key) else np.zeros(0, np.int64)
        best = moved(key, stretch, place)
        key, item, worth, stretch = key[best], item[best], worth[best], stretch[best]
        lead = moved(key, stretch)
        good = lead[np.add.reduceat(worth, lead) >= self.least[item[lead]] - 1e-9] if len(lead) else lead
        key, stretch = key[good], stretch[good]
        found = []
        for lo, hi in _runs(key) if len(key) else ():
            d, k = divmod(int(key[lo]), len(self.items))
            own, width = self.items[k], int(self.width[k])
            begin, stop = int(stream.first[d]), int(stream.first[d + 1])
            cuts = np.flatnonzero(np.diff(stretch[lo:hi]) > 1) + 1
            best = (0.0, 0, 0)
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), hi - lo], strict=True):
                a, b = begin + int(stretch[lo + i]) * width, min(stop, begin + (int(stretch[lo + j - 1]) + 2) * width)
                score, start, end = smith_waterman(own, self.numbers(stream.words(a, b)))
                if score / (MATCH * len(own)) > best[0]:
                    best = (score / (MATCH * len(own)), a - begin + start, a - begin + end)
            if best[0] >= self.threshold:
                found.append((d, self.ids[k], *best))
        return found


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    edges = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1, [len(x)])).tolist()
    return list(zip(edges, edges[1:], strict=False))


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items with text and id, in order, in lists of at most so many bytes; the driver holds one list at a time."""
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    block, held = [], 0
    for r in rows.toLocalIterator(prefetchPartitions=True):
        if block and held + len(r.text) > size:
            yield sorted(block)
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += len(r.text)
    if block:
        yield sorted(block)


def fit(docs: DataFrame, items: list[tuple[int, str]], threshold: float = THRESHOLD) -> Index:
    """An index of a block of items with seeds chosen by their rarity in all documents."""
    index = Index(items, threshold)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.codes), dtype=np.int64)
        for part in batches(it, ROWS):
            total += index.holders(part.column(0).to_pylist())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["seed", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # two numbers for each seed of the block
    holders = np.zeros(len(index.codes), dtype=np.int64)
    holders[counted.column("seed").to_numpy()] = counted.column("n").to_numpy()
    index.choose(holders)
    return index


SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long"
#: Rows of one key are dealt to so many tasks where the keys are too many to be broadcast.
SALTS = 16


def _matched(docs: DataFrame, benchmark: DataFrame, threshold: float, named: list[Column]) -> DataFrame:
    """The named columns, item_id, score, first_word and end_word of the rows of docs that hold an item; a block of items after the other."""
    source = docs.select(F.struct(*named).alias("own"), F.col("text").cast("string").alias("text"))
    rest = "item_id long, score double, first_word long, end_word long"
    schema = f"own {source.schema['own'].dataType.simpleString()}, {rest}"
    out = None
    for items in blocks(benchmark):
        index = fit(docs, items, threshold)

        def run(it: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches(it, ROWS):
                found = index.matches(b.column(1).to_pylist())
                if found:
                    which, *more = zip(*found, strict=True)
                    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), *[pa.array(c, k) for c, k in zip(more, kinds, strict=True)]], ["own", "item_id", "score", "first_word", "end_word"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return (out if out is not None else docs.sparkSession.createDataFrame([], schema)).select("own.*", "item_id", "score", "first_word", "end_word")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word for each document and item it holds a copy of.

    Null or empty text holds nothing; items with null text, null id or no word match
    nothing; repeated items count once, repeated documents as often as they stand. Of
    several copies in a text the best counts, of equally good ones the first. Texts are
    read whole, however long. Other columns are ignored. An empty table gives none.
    """
    return _matched(docs, benchmark, threshold, [F.col("doc_id").cast("long").alias("doc_id")])


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, unchanged, that hold a copy of no item.

    Rows with null or empty text stay; repeated rows stay or go together; columns of any
    name pass through; without items all stay. Each block of items is fitted on and matched
    with all rows, in passes of their own, so that a task never holds more than one block;
    what a text holds is brought to its rows by two hashes of the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    found = cut(_matched(docs, benchmark, threshold, key).select("h1", "h2").distinct())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    if found.count() * 32 <= BROADCAST_BYTES:
        kept = whole.join(F.broadcast(found), ["h1", "h2"], "left_anti")
    else:
        dealt = whole.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        kept = dealt.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h1", "h2", "salt"], "left_anti")
    return kept.select("row.*")
