"""WARC archives: segmented, chunk-framed response records and revisits, written and read back.

The writer cuts long blocks into a first segment and continuation records. The
reader deals segments out by their origin's id, puts them in order of segment
number, checks the total length, and takes the payload out of its chunked framing;
records that are whole are taken apart where they are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import BROADCAST_BYTES, arrow_batch, heavy_keys, slices, spread_join, store, struct
from .files import new_file, open_file
from .ordering import parts_of

# Fixed values of the formats.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "2024-01-01T00:00:00Z"
NO_URL = "none"

#: Block bytes of a segment, payload bytes of a chunk, and the compression of a record's gzip member.
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
GZIP_LEVEL = 3
#: Payloads shorter than this are never revisits.
LEAST_REVISIT_BYTES = 1_000


_HEX, _DIGITS = re.compile(rb"[0-9A-Fa-f]{1,15}"), re.compile(r"[0-9]{1,18}")
#: Segments of a record are numbered up to this.
MOST_SEGMENTS = (1 << 31) - 1


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload out of chunked transfer framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        digits = body[at:end].split(b";")[0].rstrip(b" \t")
        if not _HEX.fullmatch(digits):  # int() would take signs, prefixes and underscores
            raise ValueError("a chunk's size is no hexadecimal number")
        size = int(digits, 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has another length than its size says")
        out.append(body[at : at + size])
        at += size + 2


def record_id(*parts) -> str:
    """The same id for the same page, url and payload, so a writing task may run again."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def member(headers: dict[str, object], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": len(block)}).items() if v is not None)
    pack = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return pack.compress(VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def records(page_id, url: str | None, payload: bytes, keeper, keeper_url: str | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The gzip members of one page: a revisit of ``keeper``, or a response in one or more segments."""
    digest = hashlib.sha1(payload).digest()
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    own = record_id(page_id, url, digest)
    common = {"WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(), "X-Page-Id": page_id}
    if url is None or uri.strip() != url:  # what a header can't hold as it is
        common["X-Page-Url"] = NO_URL if url is None else "=" + quote(url, safe="")
    if keeper is not None:
        block = (HTTP_HEAD + f"Content-Length: {len(payload)}\r\n\r\n").encode()
        yield member({"WARC-Type": "revisit"} | common | {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(keeper, keeper_url, digest), "X-Refers-To-Page": keeper, "Content-Type": "application/http;msgtype=response"}, block)
        return
    block = (HTTP_HEAD + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload)
    cuts = range(0, len(block), segment)
    for n, at in enumerate(cuts, 1):
        part = block[at : at + segment]
        total = {"WARC-Segment-Total-Length": len(block)} if n == len(cuts) > 1 else {}
        if n == 1:
            yield member({"WARC-Type": "response"} | common | {"WARC-Segment-Number": 1 if len(cuts) > 1 else None, "Content-Type": "application/http;msgtype=response"}, part)
        else:
            yield member({"WARC-Type": "continuation", "WARC-Record-ID": record_id(own, n), "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": n} | total, part)


def members(f) -> Iterator[bytes]:
    """The records of an archive, one gzip member at a time."""
    buffer, unpack, out = b"", None, []
    while True:
        if not buffer:
            buffer = f.read(1 << 20)
            if not buffer:
                if unpack is not None:
                    raise ValueError("the archive ends within a record")
                return
        unpack = unpack or zlib.decompressobj(31)
        out.append(unpack.decompress(buffer))
        buffer = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = None, []


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    end = record.find(b"\r\n\r\n")
    if not record.startswith(b"WARC/") or end < 0:
        raise ValueError("not a WARC record")
    lines = record[:end].decode().split("\r\n")[1:]
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = _number(headers["content-length"], 1 << 62)
    block = record[end + 4 : end + 4 + size]
    if len(block) != size:
        raise ValueError("a block is shorter than its length says")
    return headers, block


def keepers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(digest, keeper, keeper_url) of every payload of at least ``least`` bytes that several pages hold."""
    body = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(url_col).alias("u"), body.alias("b")).where(F.octet_length("b") >= least)
    groups = rows.groupBy(F.unhex(F.sha2("b", 256)).alias("digest")).agg(F.max(F.struct("k", "u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").select("digest", F.col("m.k").alias("keeper"), F.col("m.u").alias("keeper_url"), "n")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, segment_bytes: int = SEGMENT_BYTES) -> tuple[str, DataFrame]:
    """Write one record per row as gzipped WARC files; the folder and the manifest (name, n_records).

    Of rows with equal payloads of at least LEAST_REVISIT_BYTES bytes (UTF-8; null is
    empty) the one with the largest id is written as response, the others as revisits
    of it; all other rows are responses. Rows with a null id are responses and are not
    referred to; of rows repeated with the largest id each is a response. Null and odd
    urls are kept as they are; other columns aren't read. Each task writes the rows it reads to one
    file; the payloads are not shuffled as long as the table of repeated payloads is
    small enough to broadcast, else those that may be repeated are joined by digest, very frequent
    ones dealt over several tasks. An empty table gives no files.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    repeated = store(keepers(pages, id_col, url_col, payload_col), "warc-keepers")
    body = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload"))
    long_enough = F.octet_length("payload") >= LEAST_REVISIT_BYTES
    rows = rows.withColumn("digest", F.when(long_enough & F.col("id").isNotNull(), F.unhex(F.sha2("payload", 256))))
    n_rows, size = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("keeper_url")), F.lit(0))).first()
    if size + 96 * n_rows <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(repeated.drop("n")), "digest", "left")
    else:
        heavy = heavy_keys(repeated, "digest", repeated.agg(F.sum("n")).first()[0], "n")
        joined = spread_join(rows, repeated.drop("n"), "digest", heavy, ("id", "url"), "left")
    other = F.col("keeper") != F.col("id")
    planned = joined.select("id", "url", "payload", F.when(other, F.col("keeper")).alias("keeper"), F.when(other, F.col("keeper_url")).alias("keeper_url"))
    listed = struct(name="string", n_records="long")

    def files(batches):
        rows = (row for whole in batches for batch in slices(whole) for row in zip(*[batch.column(c).to_pylist() for c in ("id", "url", "payload", "keeper", "keeper_url")]))
        first = next(rows, None)
        if first is None:
            return
        count = 0
        with new_file(folder, "pages", ".warc.gz") as (name, out):
            for row in chain([first], rows):
                for x in records(*row, segment_bytes):
                    out.write(x)
                    count += 1
        yield arrow_batch(listed, {"name": [name], "n_records": [count]})

    return folder, store(planned.mapInArrow(files, listed), "warc-manifest")


def assemble(segments: list[tuple]) -> Iterator[tuple]:
    """Rows of one origin's records from its segments (number, total, page, kind, url, digest, refers, block).

    Numbers must run from 1 without a gap and the blocks add up to the total length.
    Records written for repeated rows share an origin: each number then comes equally often.
    """
    by: dict[int, list[tuple]] = {}
    for s in segments:
        by.setdefault(s[0], []).append(s)
    copies = by.get(1, [])
    for i in range(max(map(len, by.values()))):
        head = copies[i] if i < len(copies) else None
        _, _, page, kind, url, digest, refers, _ = head or segments[0]
        try:
            if head is None or sorted(by) != list(range(1, len(by) + 1)) or any(len(x) <= i for x in by.values()):
                raise ValueError("segments are missing")
            block = b"".join(by[n][i][-1] for n in sorted(by))
            total = by[len(by)][i][1]
            if (total is None) != (len(by) == 1) or total is not None and total != len(block):
                raise ValueError("the segments don't add up to the total length")
            top, _, rest = block.partition(b"\r\n\r\n")
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in top.split(b"\r\n")[1:])}
            if kind == "revisit":
                yield page, kind, url, refers, None, int(http[b"content-length"]), digest, None
                continue
            payload = unchunked(rest) if http.get(b"transfer-encoding") == b"chunked" else rest
            if (got := hashlib.sha1(payload).hexdigest()) != digest:
                raise ValueError("the payload doesn't match its digest")
            yield page, kind, url, refers, payload, len(payload), got, None
        except (ValueError, KeyError) as e:
            yield page, kind, url, refers, None, None, digest, str(e)


def _number(text: str | None, most: int) -> int | None:
    if text is None:
        return None
    if not _DIGITS.fullmatch(text) or int(text) > most:
        raise ValueError(f"not a number up to {most}: {text[:40]!r}")
    return int(text)


def _fields(record: bytes) -> tuple | None:
    """(origin, number, total, page, kind, url, digest, refers, block) of a record; None where it is of another kind."""
    h, block = parse(record)
    kind = h["warc-type"]
    if kind not in ("response", "revisit", "continuation"):
        return None
    algorithm, _, digest = h.get("warc-payload-digest", "").partition(":")
    given = h.get("x-page-url")
    url = h.get("warc-target-uri") if given is None else None if given == NO_URL else unquote(given[1:])
    return (
        h["warc-segment-origin-id"] if kind == "continuation" else h["warc-record-id"], _number(h.get("warc-segment-number", "0"), MOST_SEGMENTS), _number(h.get("warc-segment-total-length"), 1 << 62),
        h.get("x-page-id"), kind, url, base64.b32decode(digest).hex() if algorithm == "sha1" else None, h.get("x-refers-to-page"), block,
    )


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, record_type, url, refers_to, payload, payload_bytes, payload_digest, problem) per response and revisit.

    Segments meet by their origin's id in one shuffle; records that are not segmented
    are finished where they are read, so files are read twice and whole payloads not shuffled. The
    digest (hexadecimal SHA-1) and size of a revisit are those of the payload it refers to;
    its payload is null. A record whose segments are missing, or whose framing, length or
    digest is wrong, has a problem and no payload; one whose head can't be read, and
    the rest of a file that breaks off, give a row with nothing but a problem. None of them stops the
    others. Page ids that aren't numbers are null. An empty payload is empty, not null.
    """
    parts = parts_of(manifest)
    raw = struct(origin="string", number="int", total="long", page="string", kind="string", url="string", digest="string", refers="string", block="binary")
    made = struct(page="string", record_type="string", url="string", refers="string", payload="binary", payload_bytes="long", payload_digest="string", problem="string")

    def fields_of(name: str) -> Iterator[tuple[tuple | None, str | None]]:
        """Each record's fields, or what is wrong with it."""
        with open_file(folder, name) as f:
            try:
                for record in members(f):
                    try:
                        found = _fields(record)
                    except (ValueError, KeyError) as e:
                        yield None, f"{name}: a record can't be read: {e!r}"
                        continue
                    if found is not None:
                        yield found, None
            except (ValueError, zlib.error) as e:
                yield None, f"{name}: {e}"

    def rows_of(names: list[str], schema, pick) -> Iterator:
        held, size = [], 0
        for name in names:
            for found, problem in fields_of(name):
                for row in pick(found, problem):
                    held.append(row)
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                if size > 4 << 20 or len(held) >= 512:
                    yield arrow_batch(schema, dict(zip(schema.fieldNames(), map(list, zip(*held)))))
                    held, size = [], 0
        if held:
            yield arrow_batch(schema, dict(zip(schema.fieldNames(), map(list, zip(*held)))))

    def whole(found, problem):
        if found is None:
            return [(None,) * 7 + (problem,)]
        if found[1] or found[4] == "continuation":
            return []
        return assemble([(1, *found[2:])])

    def segment(found, problem):
        return [found] if found is not None and (found[1] or found[4] == "continuation") else []

    def scan(schema, pick):
        def run(batches):
            for batch in batches:
                yield from rows_of(batch.column("name").to_pylist(), schema, pick)

        return run

    def join(batches):
        origin, segments, done, size = None, [], [], 0
        names = raw.fieldNames()[1:]
        for all_ in batches:
            for batch in slices(all_):
                for row in zip(batch.column("origin").to_pylist(), *[batch.column(c).to_pylist() for c in names]):
                    if row[0] != origin and segments:
                        done += assemble(segments)
                        segments = []
                    origin = row[0]
                    segments.append(row[1:])
                    size += len(row[-1])
                    if size > 4 << 20 and done:
                        yield arrow_batch(made, dict(zip(made.fieldNames(), map(list, zip(*done)))))
                        done, size = [], 0
        if segments:
            done += assemble(segments)
        if done:
            yield arrow_batch(made, dict(zip(made.fieldNames(), map(list, zip(*done)))))

    files = manifest.select("name").repartition(parts, "name")
    complete = files.mapInArrow(scan(made, whole), made)
    joined = files.mapInArrow(scan(raw, segment), raw).repartition(parts, "origin").sortWithinPartitions("origin", "number").mapInArrow(join, made)
    number = lambda c: F.col(c).try_cast("long")
    return complete.unionByName(joined).select(number("page").alias("page_id"), "record_type", "url", number("refers").alias("refers_to"), "payload", "payload_bytes", "payload_digest", "problem")
