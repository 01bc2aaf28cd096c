"""Flat token files: writing, the separator scan, and training-order shards.

A flat file holds little-endian 16-bit token ids of one document after the other, each
followed by the end-of-document id, and nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.pieces import model_path
from loomgraph.llm.shared import batches, cut, discard, held, listing, open_input, open_output, scratch

VOCABULARY, EOD, WIDTH = "byte_bpe_multi_50k.tiktoken", 50256, 2
BLOCK = 8 << 20
REMEMBERED = 400_000
#: How the vocabulary's byte-level BPE parts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SPACED = re.compile(r" \s").search


class Tokenizer(dict):
    """Texts to ids as bytes. Text is parted before single spaces, where no token goes across, and each part is encoded once."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), dtype="<u2").tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.plain(" " + part)
        if len(part) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1] == " " or SPACED(text):
            return self.plain(text)  # runs of white space are parted otherwise
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))


def tokenizer(path: str) -> Tokenizer:
    return held(("tokenizer", path), lambda: Tokenizer(path))


def write(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Writes a flat file for each partition of docs and returns, materialised, file, ordinal, doc_id in the order written.

    A task that runs again rewrites its file under the same name. Null text is a document of no token.
    """
    path = path or model_path(VOCABULARY)
    end = np.array([EOD], dtype="<u2").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, t, k = f"part-{TaskContext.get().partitionId():06d}.tok", tokenizer(path), 0
        source = batches(it, 2000)
        first = next(source, None)
        if first is None:
            return
        ids = []
        with open_output(f"{folder}/{name}") as out:
            for b in chain([first], source):
                out.write(b"".join([x for text in b.column(1).to_pylist() for x in (t.encode(text), end)]))
                ids.append(b.column(0))
        for c in ids:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(c)), pa.array(np.arange(k, k + len(c))), c], ["file", "ordinal", "doc_id"])
            k += len(c)

    return cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, ordinal long, doc_id long"))


def blocks(spark: SparkSession, folder: str, size: int = BLOCK) -> DataFrame:
    """file, uri, block, start, bytes: the files of a folder cut at multiples of size, whatever lies there."""
    files = [(u.rsplit("/", 1)[1], u, n) for u, n in listing(folder)]
    if not files:
        return spark.createDataFrame([], "file string, uri string, block long, start long, bytes long")
    table = spark.createDataFrame(files, "file string, uri string, n long")
    cutting = table.select("file", "uri", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size)))).alias("block"))
    rows = cutting.select("file", "uri", "block", (F.col("block") * size).alias("start"), F.least(F.lit(size).cast("long"), F.col("n") - F.col("block") * size).alias("bytes")).filter("bytes > 0")
    return rows.repartition(max(1, min(10_000, sum(n for _, _, n in files) // size + len(files))), "file", "block")


def scan(spark: SparkSession, folder: str, eod: int = EOD, size: int = BLOCK) -> DataFrame:
    """file, ordinal, n_tokens of each document of flat files without an index.

    Each block is searched by itself for separators. A prefix scan over the blocks' counts
    and open ends gives each block the ordinal of its first document and the tokens of it
    that lie before. Tokens after the last separator of a file are a document of their own.
    A document over many blocks costs no memory.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for file, uri, block, start, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with open_input(uri) as f:
                    f.seek(start)
                    x = np.frombuffer(f.read(n), dtype="<u2")
                at = np.flatnonzero(x == eod)
                lengths = np.diff(at, prepend=-1) - 1
                tail = len(x) - (int(at[-1]) + 1 if len(at) else 0)
                # the row of ordinal -1 is the block's summary: separators, and tokens after the last
                yield pa.RecordBatch.from_arrays([pa.array([file] * (len(at) + 1)), pa.array([block] * (len(at) + 1)), pa.array(np.append(np.arange(len(at)), -1)), pa.array(np.append(lengths, tail)), pa.array(np.full(len(at) + 1, len(at)))], ["file", "block", "k", "n", "ends"])

    found = cut(blocks(spark, folder, size).mapInArrow(run, "file string, block long, k long, n long, ends long"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file").orderBy(F.col("block").desc())
    summary = found.filter("k = -1").select("file", "block", F.col("n").alias("tail"), "ends")
    # tokens open before a block: the tails since the last block that has a separator
    run_no = F.coalesce(F.sum((F.col("ends") > 0).cast("long")).over(w), F.lit(0))
    marked = summary.withColumn("run", run_no).withColumn("before", F.coalesce(F.sum("ends").over(w), F.lit(0)))
    prior = marked.withColumn("group", F.col("run") + (F.col("ends") > 0).cast("long"))
    in_group = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = prior.withColumn("open_after", F.sum("tail").over(in_group))
    carry = cut(sums.withColumn("open", F.coalesce(F.lag("open_after").over(Window.partitionBy("file").orderBy("block")), F.lit(0))).withColumn("last", F.row_number().over(last) == 1))
    docs = found.filter("k >= 0").join(carry.select("file", "block", "before", "open"), ["file", "block"]).select("file", (F.col("before") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("k") == 0, F.col("open")).otherwise(0)).alias("n_tokens"))
    rest = carry.filter("last AND open_after > 0").select("file", (F.col("before") + F.col("ends")).alias("ordinal"), F.col("open_after").alias("n_tokens"))
    return docs.unionByName(rest)


def token_counts(docs: DataFrame, path: str | None = None, size: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens of every row: docs are written as flat files, which are then scanned, and deleted.

    Null and empty text have 0 tokens. Rows are matched by place, so null and repeated ids
    are carried as they stand. Texts of any length are written and scanned whole. Other
    columns are ignored; an empty table gives none.
    """
    folder = scratch(docs.sparkSession, "tokens")
    order = write(docs, folder, path)
    out = cut(order.join(scan(docs.sparkSession, folder, EOD, size), ["file", "ordinal"]).select("doc_id", "n_tokens"))
    discard(docs.sparkSession, folder)
    return out


class Permutation:
    """A keyed bijection of 0..n-1: a balanced Feistel network on the next even number of bits, walked until it falls in range."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = np.uint64(max(1, (max(2, n) - 1).bit_length() + 1 >> 1))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        raw = hashlib.blake2b(key.to_bytes(16, "little", signed=True), digest_size=8 * rounds).digest()
        self.keys = [np.uint64(int.from_bytes(raw[8 * i : 8 * i + 8], "little")) for i in range(rounds)]

    def _round(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, dtype=np.uint64).copy()
        todo = np.arange(len(x))
        while len(todo):
            y = x[todo]
            left, right = y >> self.half, y & self.mask
            for k in reversed(self.keys) if back else self.keys:
                left, right = (right ^ self._round(left, k), left) if back else (right, left ^ self._round(right, k))
            x[todo] = left << self.half | right
            todo = todo[x[todo] >= self.n]
        return x.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


#: Sequences that a task reads at once; shards that are shuffled at once, at most; how many parts of the slots are shuffled one after the other.
CHUNK, PARTITIONS, WAVES = 4096, 10_000, 4
SEQUENCE = "slot long, sequence long, n_tokens long, ids binary"
PLACED = "slot long, shard long, byte_offset long, sequence long, n_tokens long, sha1 string"


def chunks(spark: SparkSession, folder: str, tokens: int) -> tuple[int, DataFrame | None]:
    """The tokens of all flat files, and chunk, extents: which stretch of which file holds each so many tokens of the files' one stream."""
    files = listing(folder)
    sizes = [n // WIDTH for _, n in files]
    begins = np.concatenate(([0], np.cumsum(sizes))).tolist()
    if not begins[-1]:
        return 0, None
    table = spark.createDataFrame([(u, b, n) for (u, _), b, n in zip(files, begins, sizes, strict=False) if n], "uri string, begin long, n long")
    each = table.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("begin") / tokens), F.floor((F.col("begin") + F.col("n") - 1) / tokens))))
    low = F.greatest(F.col("begin"), F.col("chunk") * tokens)
    high = F.least(F.col("begin") + F.col("n"), (F.col("chunk") + 1) * tokens)
    extent = F.struct(low.alias("at"), F.col("uri"), (low - F.col("begin")).alias("from"), (high - low).alias("n"))
    return begins[-1], cut(each.groupBy("chunk").agg(F.array_sort(F.collect_list(extent)).alias("extents")))


def materialise(docs: DataFrame, folder: str, length: int = 1024, per_shard: int = 8192, key: int = 0, path: str | None = None, waves: int = WAVES) -> DataFrame:
    """Writes shards of fixed-stride sequences in training order; slot, shard, byte_offset, sequence, n_tokens, sha1 of each.

    The documents' tokens, ends of documents included, are one stream in file order, cut
    into sequences of length tokens, the last filled with end-of-document ids. The keyed
    permutation gives each sequence its slot; shard k holds slots k * per_shard and on, each
    at a multiple of 2 * length bytes, so a reader resumes at any slot by seeking. Flat files
    are read forwards, the sequences are dealt to ranges of slots and sorted, and each range
    writes its shards from first to last. That goes on for one part of the slots after the
    other, waves of them, so that no more than that part of the tokens is in a shuffle at a
    time; one wave reads the flat files once. What a task writes depends on nothing but
    slots, so it can run again anywhere. The flat files stay in the folder beside the
    shards; the caller may delete them. Null and empty texts are an end-of-document id;
    repeated rows are written as often as they stand; long texts run over many sequences;
    ids and other columns aren't read; an empty table writes and gives nothing.
    """
    spark = docs.sparkSession
    write(docs, f"{folder}/flat", path)
    total, table = chunks(spark, f"{folder}/flat", CHUNK * length)
    if not total:
        return spark.createDataFrame([], PLACED)
    n, stride = -(-total // length), length * WIDTH
    order, shards = Permutation(n, key), -(-n // per_shard)

    def read(low: int, high: int):
        """The sequences of slots from low to high, from whole chunks."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches(it, 1):
                first = b.column(0)[0].as_py() * CHUNK
                count = min(CHUNK, n - first)
                buffer, at = np.full(count * length, EOD, dtype="<u2"), 0
                for e in b.column(1)[0].as_py():
                    with open_input(e["uri"]) as f:
                        f.seek(e["from"] * WIDTH)
                        buffer[at : at + e["n"]] = np.frombuffer(f.read(e["n"] * WIDTH), dtype="<u2")
                    at += e["n"]
                own = np.arange(first, first + count)
                slots = order.slots(own)
                wanted = np.flatnonzero((slots >= low) & (slots < high))
                raw = np.ascontiguousarray(buffer.reshape(count, length)[wanted])
                ids = pa.Array.from_buffers(pa.binary(), len(wanted), [None, pa.py_buffer(np.arange(0, (len(wanted) + 1) * stride, stride, dtype=np.int32)), pa.py_buffer(raw)])
                used = np.clip(total - own[wanted] * length, 0, length)
                yield pa.RecordBatch.from_arrays([pa.array(slots[wanted]), pa.array(own[wanted]), pa.array(used), ids], ["slot", "sequence", "n_tokens", "ids"])

        return run

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, rows = -1, None, []

        def close() -> pa.RecordBatch:
            out.__exit__(None)
            slots, sequences, used = zip(*rows, strict=True)
            with open_input(f"{folder}/shards/shard-{shard:06d}.bin") as back:  # what a sequential reader finds
                sums = [hashlib.sha1(back.read(stride)).hexdigest() for _ in rows]
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array([shard] * len(rows)), pa.array([(k % per_shard) * stride for k in slots]), pa.array(sequences), pa.array(used), pa.array(sums)], ["slot", "shard", "byte_offset", "sequence", "n_tokens", "sha1"])

        for b in it:
            for slot, sequence, used, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if slot // per_shard != shard:
                    if out:
                        yield close()
                    shard, rows = slot // per_shard, []
                    out = open_output(f"{folder}/shards/shard-{shard:06d}.bin")
                    stream = out.__enter__()
                stream.write(ids)
                rows.append((slot, sequence, used))
        if out:
            yield close()

    # a session of its own, whose shuffles are deleted as soon as their query is done
    side = spark.newSession()
    side.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    source = side.read.schema(table.schema).parquet(*table.inputFiles())
    placed, waves = scratch(spark, "placed"), max(1, min(waves, shards))
    for w in range(waves):
        low, high = shards * w // waves, shards * (w + 1) // waves
        parts = min(PARTITIONS, high - low)
        rows = source.repartition(min(PARTITIONS, -(-n // CHUNK)), "chunk").mapInArrow(read(low * per_shard, high * per_shard), SEQUENCE)
        at = F.floor((F.floor(F.col("slot") / per_shard) - low) * parts / (high - low)).cast("int")
        rows.repartitionById(parts, at).sortWithinPartitions("slot").mapInArrow(put, PLACED).write.mode("append").parquet(placed)
    return spark.read.schema(PLACED).parquet(placed)


def read_slots(folder: str, first: int, count: int, length: int = 1024, per_shard: int = 8192) -> Iterator[np.ndarray]:
    """Sequences of slots first, first + 1, ... as a training job reads them, from any slot on."""
    for slot in range(first, first + count):
        with open_input(f"{folder}/shards/shard-{slot // per_shard:06d}.bin") as f:
            f.seek(slot % per_shard * length * WIDTH)
            yield np.frombuffer(f.read(length * WIDTH), dtype="<u2")
