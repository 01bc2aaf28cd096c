"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed into the
longest phrases that occur in a language's text; the language that needs the fewest
phrases, normalised by the size of its text, wins. All texts are parsed whole, by the
chunk: a phrase ends at the end of each CHUNK symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.shared import batches, held, utf32

#: The bounded sample: a language is learned from the whole texts of at most TRAIN_ROWS rows, of TRAIN_CHARS characters in all (or of one text that is longer). Texts of up to ROW_CHARS are preferred.
TRAIN_ROWS, ROW_CHARS, TRAIN_CHARS = 48, 1000, 24_000
CHUNK, LANES = 2048, 4096
#: A language's most frequent symbols have columns in its table; transitions by others are looked up.
COLUMNS = 255
UNKNOWN = "und"
#: A text is rejected whose phrases cost so many times its letters one by one.
SLACK = 1.25


def symbols() -> np.ndarray:
    """Code point to itself lower-cased if it is a letter, else 0."""
    return _symbols()


@lru_cache(1)
def _symbols() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def letters(text: str) -> np.ndarray:
    """Lower-case letters with one 0 for each run of anything else."""
    x = symbols()[utf32(text)]
    return x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))] if len(x) else x


class Automaton:
    """Suffix automaton of a symbol sequence as a dense table; -1 where no transition leads on.

    Of more than COLUMNS symbols the rarer ones share the last column, which is empty, and
    their transitions are sorted by state and symbol.
    """

    def __init__(self, sequence: list[int], width: int):
        following: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sequence:
            new = len(following)
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(following)
                    following.append(dict(following[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and following[p].get(c) == q:
                        following[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.width, self.column = width, None
        if width > COLUMNS:
            often = np.argsort(-np.bincount(sequence, minlength=width), kind="stable")[: COLUMNS - 1]
            self.column = np.full(width, COLUMNS - 1, dtype=np.uint16)
            self.column[often] = np.arange(len(often))
        # the last state has no transition: a symbol that the sequence lacks is a phrase by itself
        self.table = np.full((len(following) + 1, min(width, COLUMNS)), -1, dtype=np.int32)
        self.root = np.full(width, len(following), dtype=np.int64)
        rare = []
        for s, edges in enumerate(following):
            for c, t in edges.items():
                k = c if self.column is None else int(self.column[c])
                if self.column is None or k < COLUMNS - 1:
                    self.table[s, k] = t
                else:
                    rare.append((s * width + c, t))
        self.root[list(following[0])] = list(following[0].values())
        self.rare = np.array(sorted(rare), dtype=np.int64).reshape(-1, 2).T.copy()

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where symbols with and without a column lead from the states."""
        k = self.column[c]
        to = self.table[state, k]
        far = np.flatnonzero(k == COLUMNS - 1)
        if len(far) and self.rare.shape[1]:
            key = state[far] * self.width + c[far]
            at = np.minimum(np.searchsorted(self.rare[0], key), self.rare.shape[1] - 1)
            to[far] = np.where(self.rare[0, at] == key, self.rare[1, at], -1)
        return to

    def phrases(self, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each lane (column of lanes, longest first)."""
        flat, width = self.table.ravel(), self.table.shape[1]
        root = self.root
        state = np.zeros(lanes.shape[1], dtype=np.int64)
        count = (lengths > 0).astype(np.int64)
        active = np.searchsorted(-lengths, -np.arange(lanes.shape[0]), side="left")
        for t in range(lanes.shape[0]):
            r = active[t]
            c = lanes[t, :r]
            to = flat[state[:r] * width + c] if self.column is None else self._step(state[:r], c)
            lost = to < 0
            if t:
                count[:r] += lost
            state[:r] = np.where(lost, root[c], to)
        return count


class Model:
    """texts: language to its training letters."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        parts = {k: letters(texts[k]) for k in self.langs}
        known = np.unique(np.concatenate([np.zeros(1, np.uint32), *parts.values()]))
        self.ids = np.full(0x110000, len(known), dtype=np.uint16 if len(known) < 1 << 16 else np.uint32)
        self.ids[known] = np.arange(len(known))
        self.ids[0] = 0
        self.automata = [Automaton(self.ids[parts[k]].tolist(), len(known) + 1) for k in self.langs]
        self.bits = np.array([np.log2(max(2, len(parts[k]))) for k in self.langs])
        self.letter_bits = np.array([np.log2(max(2, len(np.unique(parts[k])))) for k in self.langs])

    def predict(self, texts: list[str | None], slack: float = 1.0) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and told of each text.

        und and 0 where text is null, has no letter, or nothing was learned; score is the
        runner-up's share of both costs, 1 for a single language; of equal costs the first
        language by name wins. told: the phrases beyond the first cost less than slack times
        the text's letters one by one, as they don't in text of no language that was learned.
        """
        seqs = [letters(t) if t else np.zeros(0, np.uint32) for t in texts]
        usable = [bool(self.langs) and bool(s.any()) for s in seqs]
        cost = np.zeros((len(self.langs), len(texts)))
        owner, pieces = [], []
        for i, s in enumerate(seqs):
            if usable[i]:
                ids = self.ids[s]
                for k in range(0, len(ids), CHUNK):
                    owner.append(i)
                    pieces.append(ids[k : k + CHUNK])
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
        for at in range(0, len(order), LANES):
            part = order[at : at + LANES]
            lengths = np.array([len(pieces[k]) for k in part])
            lanes = np.zeros((len(part), lengths[0]), dtype=self.ids.dtype)
            for row, k in enumerate(part):
                lanes[row, : lengths[row]] = pieces[k]
            lanes = np.ascontiguousarray(lanes.T)
            owners = np.array([owner[k] for k in part])
            for l, a in enumerate(self.automata):
                np.add.at(cost[l], owners, a.phrases(lanes, lengths))
        names, scores, told = [], [], []
        for i in range(len(texts)):
            if not usable[i]:
                names.append(UNKNOWN)
                scores.append(0.0)
                told.append(False)
                continue
            c = cost[:, i] * self.bits
            best = int(np.argmin(c))
            names.append(self.langs[best])
            rest = np.delete(c, best)
            scores.append(float(rest.min() / (rest.min() + c[best])) if len(rest) else 1.0)
            told.append(bool(c[best] - self.bits[best] < slack * len(seqs[i]) * self.letter_bits[best]))
        return names, scores, told


def _model(texts: tuple[tuple[str, str], ...]) -> Model:
    return held(("langid", texts), lambda: Model(dict(texts)))


def training(docs: DataFrame, rows: int = TRAIN_ROWS, row_chars: int = ROW_CHARS, chars: int = TRAIN_CHARS) -> dict[str, str]:
    """Language to training text, from a bounded sample of labelled rows, whose texts are taken whole.

    Rows whose crc32(doc_id as text) mod 4 is 2, or that have no id, language or text, take
    no part; repeated rows count once; an empty table teaches nothing. Of each language the
    rows with the smallest hash of id and text are taken, texts longer than row_chars only
    if there are too few others, the shortest first. Rows are chosen by hash and length, of
    each of 64 salts before all, so that no task orders a whole language; only then are
    their texts fetched.
    """
    h = F.xxhash64("doc_id", "text")
    usable = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).filter(F.length(F.trim("text")) > 0)
    size = F.length("text")
    skinny = usable.select(F.col("lang").cast("string").alias("lang"), "doc_id", h.alias("h"), size.alias("size"), F.when(size > row_chars, size).otherwise(0).alias("late"), F.pmod(h, F.lit(64)).alias("salt"))
    first = skinny.withColumn("n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("late", "h", "doc_id"))).filter(F.col("n") <= rows)
    best = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("late", "h", "doc_id"))).filter(F.col("n") <= rows)
    chosen: dict[str, dict[int, object]] = {}
    held: dict[str, int] = {}
    for r in sorted(best.collect(), key=lambda r: (r.lang, r.n)):  # at most rows of each language
        own = chosen.setdefault(r.lang, {})
        if r.h not in own and (not own or held[r.lang] + r["size"] <= chars):
            own[r.h] = r.doc_id
            held[r.lang] = held.get(r.lang, 0) + r["size"]
    if not chosen:
        return {}
    ids = sorted({i for own in chosen.values() for i in own.values()})
    hashes = sorted({k for own in chosen.values() for k in own})
    found = usable.filter(F.col("doc_id").isin(ids)).select(F.col("lang").cast("string").alias("lang"), h.alias("h"), F.col("text").cast("string").alias("text")).filter(F.col("h").isin(hashes)).distinct()
    texts = {(r.lang, r.h): r.text for r in found.collect()}
    return {lang: "\n".join(texts[lang, k] for k in own) for lang, own in chosen.items()}


def predict(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score of every row; only text is an input of the prediction.

    Null text, and text without a letter, is und with score 0, as all text is if nothing was
    learned. Repeated rows are predicted as often as they stand, null ids are carried, other
    columns are ignored, and an empty table gives none. A text of any length is parsed
    whole. Of languages of equal cost the first by name is taken.
    """
    key = tuple(sorted(texts.items()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2000):
            names, scores, _ = _model(key).predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, texts: dict[str, str], least: float = 0.0) -> DataFrame:
    """The rows of docs, unchanged, whose language is told with at least that score.

    Rejected are texts that are null or without a letter, and those that the best language's
    phrases explain so much worse than its letters one by one would (SLACK): text of no
    language that was learned. Repeated rows and rows without an id are judged like others. Columns of any
    name pass through. If nothing was learned, no row is kept.
    """
    key = tuple(sorted(texts.items()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2000):
            names, scores, told = _model(key).predict(b.column(b.schema.get_field_index("text")).to_pylist(), SLACK)
            keep = pa.array([n != UNKNOWN and t and s >= least for n, s, t in zip(names, scores, told, strict=True)], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema)
