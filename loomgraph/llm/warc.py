"""WARC archives: writing pages, and reading them back with segment reassembly.

Long records are written as a first segment and continuation records. Reading groups
segments by origin identifier, orders them by segment number, verifies the numbers and the
total length, takes the HTTP message apart and decodes chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.shared import batches, cut, discard, join_checked, join_hot, listing, open_input, open_output, scratch

SEGMENT, CHUNK, MIN_BYTES = 16 << 10, 4096, 0
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{digest}')}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        head = body[at:end].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", head):
            raise WarcError(f"no chunk size at byte {at}")
        size, at = int(head, 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise WarcError(f"chunk at byte {at} isn't {size} bytes long")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, unchunked where its header says so."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("HTTP header without an end")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding", b"").endswith(b"chunked") else body


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, segment: int = SEGMENT) -> Iterator[bytes]:
    """A page's response record in segments, or its revisit of the page first."""
    digest = digest32(payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    base = {"WARC-Record-ID": record_id(page_id, digest), "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": "" if page_id is None else str(page_id)}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = {"Content-Type": "application/http;msgtype=response"}
    if revisit:
        yield record({"WARC-Type": "revisit"} | base | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first, digest)} | kind, head)
        return
    block = head + chunked(payload)
    if len(block) <= segment:
        yield record({"WARC-Type": "response"} | base | kind, block)
        return
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        own = base | kind if k == 1 else {"WARC-Record-ID": record_id(page_id, f"{digest}/{k}"), "WARC-Date": base["WARC-Date"], "WARC-Segment-Origin-ID": base["WARC-Record-ID"]}
        total = {"WARC-Segment-Total-Length": str(len(block))} if k == len(parts) else {}
        yield record({"WARC-Type": "response" if k == 1 else "continuation"} | own | {"WARC-Segment-Number": str(k)} | total, part)


def roles(pages: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """Materialised: id, sha, refers_to of the pages that revisit another. Of equal payloads of at least so many bytes the smallest page_id is the response."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), _payload().alias("b")).select("page_id", F.sha1("b").alias("sha"), F.octet_length("b").alias("n"))
    p = cut(p)
    first = p.filter(F.col("n") >= least).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("sha", "refers_to")
    found = join_hot(p, cut(first), "sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return cut(found.select(_id().alias("id"), "sha", "refers_to").distinct())


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")


def _id() -> Column:
    return F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63)))


def write(pages: DataFrame, folder: str, least: int = MIN_BYTES, segment: int = SEGMENT) -> DataFrame:
    """Writes an archive for each partition of pages and returns, materialised, file and number of pages.

    Null html is an empty payload. Rows that repeat the smallest page_id of a payload are
    each a response; a null page_id revisits any other.
    """
    marks = roles(pages, least)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload"))
    p = p.withColumn("id", _id()).withColumn("sha", F.sha1("payload"))
    p = join_checked(p, marks.withColumn("again", F.lit(True)), ["id", "sha"], "left", 96).select("page_id", "url", "payload", "refers_to", "again")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc", 0
        source = batches(it, 1000)
        first = next(source, None)
        if first is None:
            return
        with open_output(f"{folder}/{name}") as out:
            for b in chain([first], source):
                for page, url, payload, to, again in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    out.write(b"".join(page_records(page, url, payload, to, bool(again), segment)))
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "pages"])

    return cut(p.mapInArrow(run, "file string, pages long"))


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of an open archive, one at a time."""
    held, size = b"", 1 << 20

    def upto(mark: bytes) -> bytes | None:
        nonlocal held
        seen = 0
        while (k := held.find(mark, max(0, seen - len(mark)))) < 0:
            more = stream.read(size)
            if not more:
                return None
            seen = len(held)
            held += more
        out, held = held[:k], held[k + len(mark) :]
        return out

    while True:
        head = upto(b"\r\n\r\n")
        if head is None:
            if held.strip():
                raise WarcError("archive ends within a record's header")
            return
        lines = head.decode("utf-8").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"no record begins at {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        parts, have = [held], len(held)
        while have < n + 4:
            more = stream.read(max(size, n + 4 - have))
            if not more:
                raise WarcError("archive ends within a record")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        block, held = held[:n], held[n + 4 :]
        yield fields, block


SEGMENT_ROW = "origin string, kind string, page_id long, digest string, refers string, number int, total long, block binary, bytes long"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """record, kind, page_id, digest, bytes, refers of each logical record, segments put together.

    digest and bytes are those of the decoded payload, which is checked against the record's
    own digest; of a revisit they are what the record says, and null. Records that are whole
    are decoded where they are read; only segments are shuffled with their blocks.
    """
    files = [u for u, _ in listing(folder)]
    if not files:
        return spark.createDataFrame([], "record string, kind string, page_id long, digest string, bytes long, refers string")
    paths = spark.createDataFrame([(f,) for f in files], "uri string").repartition(min(10_000, len(files)), "uri")

    def decoded(block: bytes, want: str) -> tuple[str, int]:
        payload = http_payload(block)
        digest = digest32(payload)
        if want and digest != want:
            raise WarcError(f"payload digest is {digest}, the record says {want}")
        return digest, len(payload)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
        names = [x.split()[0] for x in SEGMENT_ROW.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in it:
            for uri in b.column(0).to_pylist():
                rows, held = [], 0
                with open_input(uri) as stream:
                    for f, block in parse(stream):
                        kind, own = f["warc-type"], f["warc-record-id"]
                        page = int(f["x-page-id"]) if f.get("x-page-id") else None
                        want = f.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "revisit":
                            rows.append((own, kind, page, want, f["warc-refers-to"], None, None, None, None))
                        elif "warc-segment-number" in f:
                            total = f.get("warc-segment-total-length")
                            rows.append((f.get("warc-segment-origin-id", own), kind, page, want, None, int(f["warc-segment-number"]), int(total) if total else None, block, None))
                            held += len(block)
                        elif kind == "response":
                            digest, n = decoded(block, want)
                            rows.append((own, kind, page, digest, None, None, None, None, n))
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 64):
            rows = []
            for origin, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_number = {}
                for p in parts:
                    by_number.setdefault(p["number"], p)  # archived twice: equal segments
                if sorted(by_number) != list(range(1, len(by_number) + 1)):
                    raise WarcError(f"{origin}: segments {sorted(by_number)} aren't complete")
                block = b"".join(by_number[k]["block"] for k in sorted(by_number))
                if by_number[len(by_number)]["total"] != len(block):
                    raise WarcError(f"{origin}: {len(block)} bytes, the last segment says {by_number[len(by_number)]['total']}")
                head = by_number[1]
                rows += [(origin, head["kind"], head["page_id"], *decoded(block, head["digest"]), None)] * sum(p["number"] == 1 for p in parts)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["record", "kind", "page_id", "digest", "bytes", "refers"])

    table = paths.mapInArrow(read, SEGMENT_ROW)
    parts = F.collect_list(F.struct("number", "kind", "page_id", "digest", "total", "block"))
    # whole records pass beside the segments: one row each, no block
    table = cut(table.withColumn("whole", F.col("number").isNull()))
    whole = table.filter("whole").select(F.col("origin").alias("record"), "kind", "page_id", "digest", "bytes", F.col("refers"))
    grouped = table.filter("NOT whole").groupBy("origin").agg(parts.alias("parts"))
    return whole.unionByName(grouped.mapInArrow(join, "record string, kind string, page_id long, digest string, bytes long, refers string"))


def round_trip(pages: DataFrame, least: int = MIN_BYTES, segment: int = SEGMENT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as the archives written give them back.

    A revisit takes the length of its payload from the response it refers to, whose digest
    must be its own. Null html is empty; pages of any length are written whole; repeated
    rows and null page_ids are as in write; other columns are ignored. The archives are
    deleted once they are read. An empty table writes and gives nothing.
    """
    folder = scratch(pages.sparkSession, "warc")
    write(pages, folder, least, segment)
    found = cut(records(pages.sparkSession, folder))
    discard(pages.sparkSession, folder)
    responses = found.filter("kind = 'response'")
    origin = cut(responses.groupBy(F.col("record").alias("refers")).agg(F.min("page_id").alias("refers_to"), F.max("bytes").alias("known"), F.max("digest").alias("same")))
    again = found.filter("kind = 'revisit'").select("page_id", "digest", "kind", "record", "refers")
    # a payload that most pages share has one response, which its revisits meet by broadcast
    checked = F.when(F.col("same") == F.col("digest"), F.col("known")).otherwise(F.raise_error(F.concat(F.lit("another payload than its response: "), F.col("record"))).cast("long"))
    met = cut(join_hot(again, origin, "refers").select("page_id", checked.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"))
    if met.count() != again.count():
        raise WarcError("there are revisits without their response")
    return responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(met)
