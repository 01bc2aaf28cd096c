"""Importance resampling with hashed n-gram models.

Words and marks and their pairs are hashed into BUCKETS; two generative models are counted,
one over all documents, one over a bounded sample of labelled good ones. A document's
importance is the log ratio of what the two models give its text, the sum over its n-grams;
adding Gumbel noise keyed by its id and text and taking the largest k is sampling k documents
without replacement in proportion to the ratio.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import batches, cut, held
from loomgraph.operators.ranking import ranked

BUCKETS, SMOOTH = 1 << 14, 0.1
#: The target model is counted over at most so many labelled documents, those with the smallest hashes.
TARGET_ROWS = 4000
TOKENS = re.compile(r"\w+|[^\w\s]+").findall
REMEMBERED = 400_000


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token) & 0x7FFFFFFFFFFF
        return h


def _hashes() -> _Hashes:
    return held("hashes", _Hashes)


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's words and pairs; none of null or blank text."""
    ts = TOKENS(text.lower()) if text else []
    table = _hashes()
    h = np.fromiter(map(table.__getitem__, ts), dtype=np.int64, count=len(ts))
    pair = (h[:-1] * 0x9E3779B1 + h[1:] * 0x85EBCA6B) >> 13
    return np.concatenate((h, pair)) & (BUCKETS - 1)


def sample(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS) -> list[int]:
    """Ids of at most so many documents labelled good and not toxic."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return [r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]


def models(docs: DataFrame, target: list[int]) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | all), counted in one pass over all documents."""
    chosen = frozenset(target)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for b in it:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.bincount(features(t), minlength=BUCKETS)
                total[0] += c
                if i in chosen:
                    total[1] += c
        k = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[0, k]), pa.array(total[1, k])], ["bucket", "every", "good"])

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "bucket long, every long, good long")
    table = np.full((2, BUCKETS), SMOOTH)
    for r in counted.groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("good").alias("good")).collect():  # BUCKETS rows
        table[:, r.bucket] += (r.every, r.good)
    p = np.log(table / table.sum(axis=1, keepdims=True))
    return p[1] - p[0] if target else np.zeros(BUCKETS)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, importance, key of every row. A text without n-grams has importance 0: both models give it 1."""
    salt = str(seed).encode()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2000):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            weight, key = np.empty(len(ids)), np.empty(len(ids))
            for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
                f = features(t)
                weight[k] = ratio[f].sum() if len(f) else 0.0
                u = (xxhash.xxh64_intdigest(salt + b"\0" + str(i).encode() + b"\0" + (t or "").encode("utf-8", "replace")) + 0.5) / 2.0**64
                key[k] = weight[k] - np.log(-np.log(min(max(u, 1e-18), 1 - 1e-16)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight), pa.array(key)], ["doc_id", "importance", "key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, importance double, key double")


def threshold(keys: DataFrame, k: int) -> float | None:
    """The k-th largest key (None if there are fewer), by narrowing histograms: each pass counts 4,096 bins and none sorts."""
    span = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("key").alias("n")).first()
    if k <= 0 or span.n == 0:
        return float("inf")
    if span.n < k:
        return None
    lo, hi, above = span.lo, span.hi, 0
    while True:
        width = (hi - lo) / 4096
        if width <= 0 or lo + width == lo:
            return lo
        bins = F.least(F.lit(4095), F.floor((F.col("key") - lo) / width)).cast("int")
        rows = sorted(((r.b, r.n, r.lo, r.hi) for r in keys.filter(F.col("key").between(lo, hi)).groupBy(bins.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()), reverse=True)
        for _, n, low, high in rows:
            if above + n >= k:
                break
            above += n
        if low == high or n <= 1:
            return low
        if n <= 4096:
            few = sorted((r.key for r in keys.filter(F.col("key").between(low, high)).select("key").collect()), reverse=True)
            return few[k - above - 1]
        lo, hi = low, high


def select(docs: DataFrame, labels: DataFrame, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, importance, key, kept of every row: kept are the k rows with the largest keys.

    k is the fraction of all rows, by default the share of good ones that aren't toxic among
    labelled documents (all, if there are no labels). Null text counts as empty, a text of
    any length whole; a null doc_id isn't in the target. Repeated rows have equal keys; of
    rows with the k-th largest key those with the smallest doc_id are kept, null last, and
    among rows that are equal it makes no difference which. Other columns are ignored; an
    empty table gives none.
    """
    if fraction is None:
        good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
        s = labels.agg(F.avg(F.when(good, 1.0).otherwise(0.0)).alias("s")).first().s
        fraction = 1.0 if s is None else s
    table = cut(weigh(docs, models(docs, sample(docs, labels)), seed))
    n = table.count()
    k = round(n * fraction)
    t = threshold(table, k)
    if t is None or k >= n:
        return table.withColumn("kept", F.lit(True))
    more = table.filter(F.col("key") > t).count()
    tied = table.filter(F.col("key") == t)
    if tied.count() + more == k:
        return table.withColumn("kept", F.col("key") >= t)
    # ties may be many and of one id: they are ranked by ranges of id and place
    named = tied.withColumn("__null", F.col("doc_id").isNull()).withColumn("__at", F.monotonically_increasing_id())
    first = ranked(named, ["__null", "doc_id", "__at"], "__n").select("doc_id", "importance", "key", (F.col("__n") < k - more).alias("kept"))
    return table.filter(F.col("key") != t).withColumn("kept", F.col("key") > t).unionByName(first)
