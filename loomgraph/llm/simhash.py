"""SimHash near-duplicates by a generalised pigeonhole join.

Fingerprints: ASCII-lower-cased words, 4-word shingles with repeats, XXH64 (seed 42), a
bit is set if over half the shingles set it. Fewer than four words are one shingle; no
word, or null text, gives fingerprint zero, linked like any other.

Linking: equal fingerprints are one node, whatever the number of copies. The 64 bits are
grouped into parts by correlation, measured over all fingerprints. If two fingerprints
differ in at most d bits and the thresholds t of the parts satisfy sum(t + 1) = d + 1, some
part differs in at most its t bits; a part with t = -1 is skipped. The thresholds minimise
the estimated number of probes and candidates by dynamic programming; each fingerprint then
probes all values within t of its own in each part, and every candidate pair is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import components
from loomgraph.llm.shared import cut, join_checked, join_hot, join_shuffled

BITS, SHINGLE, SEED = 64, 4, 42
#: What a candidate costs, in probes: probes are spread evenly, candidates gather at common values in few tasks.
CANDIDATE = 8.0
#: A part value that more fingerprints have is crowded. Its links are made through representatives.
CROWD = 64
#: Fingerprints of a crowded value are dealt to so many tasks.
SALTS = 16


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: A-Z only, and white space 09-0D and 20
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=at[1:])
    view, h = line, xxhash.xxh64_intdigest
    starts, ends = at[: -SHINGLE].tolist(), (at[SHINGLE:] - 1).tolist()
    count = np.zeros(BITS, dtype=np.int64)
    n = len(starts)
    for k in range(0, n, 1 << 15):
        hashes = np.array([h(view[i:j], SEED) for i, j in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)], strict=True)], dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (LONG, the unsigned bits) of every row of docs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """parts: the bit positions of each part; thresholds: its t."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal width; each starts at the free bit with most correlation and takes the bits closest to it."""
    c = np.abs(correlation.copy())
    np.fill_diagonal(c, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        left = sorted(free)
        part = [max(left, key=lambda b: (c[b, left].sum(), -b))]
        free.discard(part[0])
        while len(part) < width:
            b = max(sorted(free), key=lambda b: (c[b, part].sum(), -b))
            part.append(b)
            free.discard(b)
        parts.append(sorted(part))
    return parts


def mismatch(p: np.ndarray, most: int) -> np.ndarray:
    """P(two fingerprints differ in exactly k of the bits), k = 0..most, for bits set with probability p."""
    out = np.zeros(most + 1)
    out[0] = 1
    for q in 2 * p * (1 - p):
        out[1:] = out[1:] * (1 - q) + out[:-1] * q
        out[0] *= 1 - q
    return out


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """costs[i][t + 1]: of part i at threshold t, -1 at least. The cheapest thresholds with sum(t + 1) = budget."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * budget
    for row in costs:
        new: list[tuple[float, list[int]] | None] = [None] * (budget + 1)
        for spent, had in enumerate(best):
            for k, c in enumerate(row[: budget - spent + 1]) if had else ():
                if new[spent + k] is None or had[0] + c < new[spent + k][0]:
                    new[spent + k] = (had[0] + c, [*had[1], k - 1])
        best = new
    return best[budget]


def plan(fps: DataFrame, distance: int, parts: tuple[int, ...] | None = None) -> Plan:
    """The cheapest grouping and thresholds for the numbers of parts, by default 2 to distance + 1; fps has distinct fingerprints, all of which are counted."""
    parts = parts or tuple(range(min(2, distance + 1), distance + 2))

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS), dtype=np.int64)
        for b in it:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in range(0, len(x), 1 << 14):
                bits = np.unpackbits(x[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[:BITS] += np.rint(bits.T @ bits).astype(np.int64)
                total[BITS] += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "n"])

    cells = fps.mapInArrow(moments, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 65 x 64 rows
    table = np.zeros((BITS + 1) * BITS)
    for r in cells:
        table[r.cell] = r.n
    table = table.reshape(BITS + 1, BITS)
    n = max(1.0, table[BITS, 0])
    p = np.diag(table) / n
    cov = table[:BITS] / n - np.outer(p, p)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    grouped = {m: group_bits(cov / np.outer(sd, sd), m) for m in parts}
    masks = [(m, k, mask(part)) for m, g in grouped.items() for k, part in enumerate(g)]
    values = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(w)).alias("v")) for i, (_, _, w) in enumerate(masks)])).alias("x"))
    same = {r.i: r.pairs for r in values.groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("c")).groupBy("i").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).collect()}
    plans = []
    for m, g in grouped.items():
        costs = []
        for k, part in enumerate(g):
            exact = same.get(masks.index((m, k, mask(part))), 0.0)
            model = np.cumsum(mismatch(p[part], distance))
            row = [0.0]
            for t in range(min(distance, len(part)) + 1):
                probes = n * (1 + sum(comb(len(part), e) for e in range(t + 1)))
                row.append(probes + CANDIDATE * exact * model[t] / max(model[0], 1e-300) / 2)
            costs.append(row)
        cost, thresholds = allocate(costs, distance + 1)
        plans.append(Plan(tuple(map(tuple, g)), tuple(thresholds), cost))
    return min(plans, key=lambda x: x.cost)


def mask(bits: tuple[int, ...] | list[int]) -> int:
    """The bits as a signed 64-bit integer."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def _sides(fps: DataFrame, by: Plan) -> tuple[DataFrame, DataFrame]:
    """(part, value, a) of the fingerprints' own values, and (part, value, b) of all that they probe."""

    def keys(i: int, most: int) -> Column:
        """The part's value and all within so many bits of it."""
        value = F.col("fp").bitwiseAND(F.lit(mask(by.parts[i])))
        errors = F.array(*[F.lit(mask(c)) for e in range(most + 1) for c in combinations(by.parts[i], e)])
        return F.transform(errors, lambda e: F.struct(F.lit(i).alias("part"), value.bitwiseXOR(e).alias("value")))

    used = sorted((i for i, t in enumerate(by.thresholds) if t >= 0), key=lambda i: -by.thresholds[i])  # the same plan whichever part has which threshold
    home = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*[keys(i, 0) for i in used])).alias("k")).select("a", "k.*")
    probe = fps.select(F.col("fp").alias("b"), F.explode(F.concat(*[keys(i, by.thresholds[i]) for i in used])).alias("k")).select("b", "k.*")
    return home, probe


def _near(distance: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance


def links(fps: DataFrame, distance: int, by: Plan | None = None) -> DataFrame:
    """a < b (signed order): all pairs of distinct fingerprints that differ in at most so many bits."""
    home, probe = _sides(fps, by or plan(fps, distance))
    return join_shuffled(home, probe, ["part", "value"]).filter((F.col("a") < F.col("b")) & _near(distance)).select("a", "b").distinct()


def roots(fps: DataFrame, distance: int, by: Plan | None = None, crowd: int = CROWD) -> DataFrame:
    """node, root of the fingerprints that have a link: root is the least one that links reach.

    Values that at most crowd fingerprints have are joined with their probes. Of a crowded
    value all probes are compared with its least fingerprint. With the components of these
    links, the members of a crowded value that are in its largest component need no more
    comparison with one another: what is left are the pairs of which one is outside it.
    """
    by = by or plan(fps, distance)
    home, probe = _sides(fps, by)
    n = fps.count()
    crowded = cut(home.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).filter(F.col("n") > crowd), len(by.parts) * n)
    pairs = lambda joined: joined.filter((F.col("a") != F.col("b")) & _near(distance)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if crowded.isEmpty():
        return components(cut(pairs(join_shuffled(home, probe, ["part", "value"])).distinct()))
    width = 32  # two numbers and their overhead
    marks = crowded.select("part", "value")
    quiet = join_shuffled(join_checked(home, marks, ["part", "value"], "left_anti", width), probe, ["part", "value"])
    busy_home = cut(join_checked(home, marks, ["part", "value"], "left_semi", width))
    busy_probe = cut(join_checked(probe, marks, ["part", "value"], "left_semi", width))
    stars = join_checked(busy_probe, crowded.select("part", "value", "a"), ["part", "value"], "inner", width)
    found = cut(pairs(quiet).unionByName(pairs(stars)).distinct())
    known = components(found)
    own = lambda df, c, r: join_checked(df, known.select(F.col("node").alias(c), F.col("root").alias(r)), [c], "left", width).withColumn(r, F.coalesce(r, c))
    busy_home, busy_probe = cut(own(busy_home, "a", "ra")), cut(own(busy_probe, "b", "rb"))
    sizes = busy_home.groupBy("part", "value", "ra").agg(F.count(F.lit(1)).alias("n"))
    largest = cut(sizes.groupBy("part", "value").agg(F.max_by("ra", F.struct("n", "ra")).alias("main")), len(by.parts) * n)
    inner = lambda df: join_checked(df, largest, ["part", "value"], "inner", width)
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lambda df, c: df.withColumn("salt", F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int"))
    h, p, key = inner(busy_home), inner(busy_probe).drop("main"), ["part", "value", "salt"]
    outside = join_shuffled(salted(h.filter("ra <> main").drop("main")), dealt(p, "b"), key)
    inside = join_shuffled(dealt(h.filter("ra = main").drop("main"), "a"), salted(inner(busy_probe).filter("rb <> main").drop("main")), key)
    more = cut(pairs(outside.unionByName(inside).filter("ra <> rb")).distinct())
    return known if more.isEmpty() else components(known.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs.

    component_id is the smallest doc_id that links reach, the row's own included. Null and
    empty texts have fingerprint zero and are one node. Rows with a null doc_id take part
    and have their group's id, null if no row of it has one. Repeated rows are returned as
    often as they stand. Very long texts are read whole. Other columns are ignored. An empty
    table gives none.
    """
    table = cut(fingerprints(docs))
    n = table.count()
    nodes = cut(table.groupBy("fp").agg(F.min("doc_id").alias("first")), n)
    moved = cut(join_checked(nodes, roots(nodes.select("fp"), distance).withColumnRenamed("node", "fp"), ["fp"], "left", 32).select("fp", "first", F.coalesce("root", "fp").alias("root")), 2 * n)
    least = cut(moved.groupBy("root").agg(F.min("first").alias("component_id")), n)
    ids = cut(join_hot(moved, least, "root").select("fp", "component_id"), 2 * n)
    return join_hot(table, ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, distance: int = 4) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest doc_id.

    Rows with a null doc_id can't be named and stay. If several rows share a doc_id that
    stays, one of each fingerprint is kept, that whose columns hash least.
    """
    table = cut(near_duplicates(docs, distance))
    own = F.col("doc_id") == F.col("component_id")
    per = cut(table.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(own.cast("int")).alias("own")).filter("n > 1 OR own = 0"))
    out = join_checked(docs, per.select("doc_id"), ["doc_id"], "left_anti", 16).select(docs.columns)
    again = per.filter("n > 1 AND own > 0").select("doc_id")
    if again.isEmpty():
        return out
    prints = cut(join_checked(table.filter(own), again, ["doc_id"], "left_semi", 16).select("doc_id", "fingerprint").distinct())
    rows = join_checked(docs, again, ["doc_id"], "left_semi", 16).select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            hexed = pa.array([f"{fingerprint(t):016x}" for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), hexed, b.column(2)], schema=pa.schema([("doc_id", b.schema.field(0).type), ("fingerprint", pa.string()), pa.field("r", b.schema.field(2).type)]))

    schema = rows.schema.fields
    named = rows.mapInArrow(run, f"doc_id {schema[0].dataType.simpleString()}, fingerprint string, r {schema[2].dataType.simpleString()}")
    least = join_checked(named, prints, ["doc_id", "fingerprint"], "left_semi").groupBy("doc_id", "fingerprint").agg(F.min_by("r", F.xxhash64("r")).alias("r"))
    return out.unionByName(least.select("r.*"))
