"""WARC archives: a writer that segments records and marks revisits, and a
reader that reassembles segments.

Writing.  A payload becomes an HTTP response in chunked transfer framing.  A
block longer than ``segment_bytes`` is cut: the first segment is the response
record (``WARC-Segment-Number: 1``), continuation records name it in
``WARC-Segment-Origin-ID``, and the last one has ``WARC-Segment-Total-Length``.
Of rows with equal payloads one with the smallest id is the response; the others
become revisit records that carry HTTP headers only.

Spark's text writer puts the files into the folder, with the record separator
as its line end and the whole file gzipped, so they may be in any store.

Reading.  Files are parsed as streams, once.  Records of one segment are complete
there.  Segments are dealt by their origin, sorted by segment number, and
reassembled as a stream: digest and transfer framing are decoded segment by
segment, the total length is verified at the last one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import BATCH_BYTES, map_batches, slices
from quillon.session import materialised, scope

#: Fixed values of the format.
VERSION, EOL, END = b"WARC/1.1", b"\r\n", "\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2000-01-01T00:00:00Z"
HTTP = b"application/http;msgtype=response"
SALTS = 32
#: Rows that are read back, and the parts that they are put together from.
FOUND = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, segments int, error string"
FOUND_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
PARTS = "origin string, number int, total long, claimed string, block binary, kind string, size long, own string, refers string, error string"
PART_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([b"%x\r\n%b\r\n" % (len(p), p) for p in parts]) + b"0\r\n\r\n"


class Dechunker:
    """Decodes chunked transfer framing fed piecewise; cuts may be anywhere."""

    def __init__(self) -> None:
        self._line, self._left, self._state = b"", 0, "size"

    def feed(self, data: bytes) -> bytes:
        out, at = [], 0
        while at < len(data):
            if self._state == "data":
                take = min(self._left, len(data) - at)
                out.append(data[at : at + take])
                at += take
                self._left -= take
                if not self._left:
                    self._state, self._line = "data end", b""
                continue
            cut = data.find(b"\n", at)
            self._line += data[at : cut + 1 if cut >= 0 else len(data)]
            if cut < 0:
                break
            at, line, self._line = cut + 1, self._line.strip(), b""
            if self._state == "size":
                self._left = int(line.split(b";")[0], 16)
                self._state = "data" if self._left else "trailer"
            elif self._state == "data end":
                if line:
                    raise ValueError("no line end after a chunk")
                self._state = "size"
            elif self._state == "trailer":
                self._state = "over" if not line else "trailer"
            else:
                raise ValueError("data after the last chunk")
        return b"".join(out)

    def over(self) -> bool:
        return self._state == "over"


class Payload:
    """The payload of an HTTP response whose bytes come piecewise."""

    def __init__(self, keep: bool = False) -> None:
        self.sha, self.size, self.seen, self.headers = hashlib.sha1(), 0, 0, None
        self._head, self._de, self.parts, self._keep = b"", None, [], keep
        self._wrong: str | None = None

    def feed(self, data: bytes) -> None:
        self.seen += len(data)
        try:
            self._take(data)
        except ValueError as e:  # the rest of the payload cannot be told
            self._wrong = self._wrong or f"wrong framing: {e}"

    def _take(self, data: bytes) -> None:
        if self._wrong:
            return
        if self.headers is None:
            self._head += data
            end = self._head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self._head[:end].split(EOL)[1:]
            self.headers = {k.strip().lower(): v.strip() for k, v in (x.split(b":", 1) for x in lines)}
            self._de = Dechunker() if self.headers.get(b"transfer-encoding", b"").lower() == b"chunked" else None
            data, self._head = self._head[end + 4 :], b""
        body = self._de.feed(data) if self._de else data
        self.size += len(body)
        self.sha.update(body)
        if self._keep:
            self.parts.append(body)

    def error(self) -> str | None:
        if self._wrong or self.headers is None:
            return self._wrong or "no HTTP headers"
        return "framing not ended" if self._de and not self._de.over() else None

    def digest(self) -> str:
        return base64.b32encode(self.sha.digest()).decode()


def record(kind: bytes, name: bytes, block: bytes, **more: bytes) -> bytes:
    """A record without the line ends that close it."""
    head = [VERSION, b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name + b">", b"WARC-Date: " + DATE]
    head += [k.replace("_", "-").encode() + b": " + v for k, v in more.items() if v]
    return EOL.join([*head, b"Content-Length: %d" % len(block), b"", block])


def _target(url: str | None) -> bytes:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()


def revisit(name: str, url: str | None, size: int, sha: str, first: str) -> bytes:
    """The record of a row whose payload ``first`` has; ``sha``: hexadecimal."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: %d\r\n\r\n" % size
    mark = b"sha1:" + base64.b32encode(bytes.fromhex(sha))
    return record(b"revisit", name.encode(), block, WARC_Target_URI=_target(url), WARC_Payload_Digest=mark, WARC_Profile=PROFILE, WARC_Refers_To=b"<" + first.encode() + b">", Content_Type=HTTP)


def records(name: str, url: str | None, payload: bytes, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The response record of a payload and its continuations."""
    head = {"WARC_Target_URI": _target(url), "WARC_Payload_Digest": b"sha1:" + digest(payload).encode(), "Content_Type": HTTP}
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record(b"response", name.encode(), block, **head)
        return
    yield record(b"response", name.encode(), block[:segment_bytes], WARC_Segment_Number=b"1", **head)
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        total = b"%d" % len(block) if at + segment_bytes >= len(block) else b""
        yield record(b"continuation", f"{name}:{number}".encode(), block[at : at + segment_bytes], WARC_Segment_Origin_ID=b"<" + name.encode() + b">", WARC_Segment_Number=b"%d" % number, WARC_Segment_Total_Length=total)


def parse(stream):
    """(headers, block) of each record of a stream, one record in memory."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins at {line[:40]!r}")
        head: dict[bytes, bytes] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.partition(b":")
            head[k.strip().lower()] = v.strip()
        size = int(head[b"content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield head, block


def payload_rows(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``id``, ``url``, ``payload`` (bytes) and what tells payloads apart: their
    size and two hashes."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    return rows.select("id", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha"), F.xxhash64("payload").alias("xx"))


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))


def write_warc(df: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0, segment_bytes: int = 65536, chunk_bytes: int = 8192, records_per_file: int = 1000) -> None:
    """Write a record for each row below ``path``, named ``urn:row:ID:NUMBER``;
    the number is the row's own, so rows may repeat an id or have none (``ID`` is
    empty then).

    ``payload_col``: text (as UTF-8) or binary; null is an empty payload.  Of rows
    with equal payloads of at least ``least_bytes`` bytes, one of those with the
    smallest id (null is the greatest) is the response, the others are revisits of
    it, also where they repeat its id; rows with smaller payloads are all
    responses.  Null urls are empty, further columns are ignored.  A file holds at
    most ``records_per_file * segment_bytes`` bytes and their headers.

    Rows are numbered in a written table, and payloads meet their record's name by
    that number: it is unique, so no id or payload that many rows have makes a
    large task.  Of equal payloads only hashes are compared."""
    with scope(df.sparkSession):
        _records_of(df, id_col, url_col, payload_col, least_bytes, segment_bytes, chunk_bytes).write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _records_of(df: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int, segment_bytes: int, chunk_bytes: int) -> DataFrame:
    spark = df.sparkSession
    rows = payload_rows(df, id_col, url_col, payload_col)
    same = ["sha", "xx", "size"]
    large = rows.filter(F.col("size") >= least_bytes)
    known = materialised(spark, large.withColumn("number", F.monotonically_increasing_id()), "warc-rows")
    groups = known.groupBy(*same).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialised(spark, groups, "warc-groups")
    again = known.drop("payload").withColumn("salt", F.pmod(F.col("number"), F.lit(SALTS))).join(groups.filter("n > 1").select(*same, "first", _salts().alias("salt")), [*same, "salt"])
    again = again.filter(F.col("number") != F.col("first.number")).select(_urn("id", "number").alias("name"), "url", "size", "sha", _urn("first.id", "first.number").alias("first"))
    firsts = groups.select("first.number", _urn("first.id", "first.number").alias("name"), "first.url")
    once = known.select("number", "payload").join(firsts, "number").select("name", "url", "payload")
    if least_bytes > 0:
        small = rows.filter(F.col("size") < least_bytes).withColumn("number", F.monotonically_increasing_id())
        once = once.unionByName(small.select(F.concat(_urn("id", "number"), F.lit("s")).alias("name"), "url", "payload"))

    def responses(batches):
        for whole in batches:
            for b in slices(whole, 2):
                out = [r for name, url, payload in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in records(name, url, payload, segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    def revisits(batches):
        for b in batches:
            out = [revisit(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return map_batches(once, responses, "value binary").unionByName(map_batches(again, revisits, "value binary")).select(F.col("value").cast("string"))


def _urn(id_col: str, number: str) -> Column:
    return F.concat(F.lit("urn:row:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col(number).cast("string"))


def _name(value: bytes | None) -> str | None:
    return value.strip(b"<>").decode() if value else None


def _finished(name: str, kind: str, p: Payload, claimed: str, segments: int, error: str | None) -> tuple:
    error = error or p.error() or (None if claimed in ("", p.digest()) else "digest differs")
    return name, kind, p.size, p.digest(), None, segments, error


class Pieces(io.RawIOBase):
    """A byte stream over an iterator of pieces."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self._pieces, self._rest = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not len(self._rest):
            piece = next(self._pieces, None)
            if piece is None:
                return 0
            self._rest = memoryview(piece)
        n = min(len(into), len(self._rest))
        into[:n], self._rest = self._rest[:n], self._rest[n:]
        return n


def archive_rows(stream) -> Iterator[tuple]:
    """A row of ``PARTS`` for each response, revisit or segment of a stream."""
    for head, block in parse(stream):
        kind = head[b"warc-type"].decode()
        name, claimed = _name(head[b"warc-record-id"]), head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
        if b"warc-segment-number" in head:
            origin = _name(head.get(b"warc-segment-origin-id")) or name
            yield origin, int(head[b"warc-segment-number"]), int(head.get(b"warc-segment-total-length", b"-1")), claimed, block, None, None, None, None, None
        elif kind == "revisit":
            p = Payload()
            p.feed(block)
            yield name, 0, -1, claimed, None, kind, int((p.headers or {}).get(b"x-payload-length", b"-1")), claimed, _name(head.get(b"warc-refers-to")), None if p.headers is not None else "no HTTP headers"
        elif kind == "response":
            p = Payload()
            p.feed(block)
            _, _, size, own, _, _, error = _finished(name, kind, p, claimed, 1, None)
            yield name, 0, -1, claimed, None, kind, size, own, None, error


def _part_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + len(r[4] or b"")
        if size > BATCH_BYTES:
            yield _batch(held, PARTS, PART_KINDS)
            held, size = [], 0
    if held:
        yield _batch(held, PARTS, PART_KINDS)


def _streamed(batches) -> Iterator[pa.RecordBatch]:
    """Lines of files, in order, to rows; ``file`` tells where one ends."""
    lines = (r for b in batches for r in _runs(b))
    for _, of_file in groupby(lines, key=itemgetter(0)):
        yield from _part_batches(archive_rows(io.BufferedReader(Pieces(piece for _, piece in of_file), 1 << 16)))


def _runs(b: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(file, its lines in one piece) for each run of a batch."""
    file = np.asarray(b.column(1))
    ends = np.flatnonzero(np.diff(file)) + 1
    for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(file)], strict=True):
        if j > i:
            yield int(file[i]), b"\n".join(b.column(0).slice(i, j - i).to_pylist()) + b"\n"


def _opened(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0):
            raw = io.BytesIO(memoryview(data.as_buffer()))
            zipped = raw.getbuffer()[:2] == b"\x1f\x8b"
            yield from _part_batches(archive_rows(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if zipped else raw))


def _reassembled(batches) -> Iterator[pa.RecordBatch]:
    """Segments of one origin follow each other, in order; whole records pass."""
    name, state = None, None
    for b in batches:
        rows = []
        for origin, number, total, claimed, block, kind, size, own, refers, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not number:
                rows.append((origin, kind, size, own, refers, 1, error))
                continue
            if origin != name:
                if state:
                    rows.append(_end(name, state))
                name, state = origin, {"p": Payload(), "claimed": "", "next": 1, "total": -1, "error": None}
            if number != state["next"]:
                state["error"] = state["error"] or ("a segment is repeated" if number < state["next"] else "a segment is missing")
                if number < state["next"]:
                    continue
            state["next"] = number + 1
            state["claimed"] = claimed or state["claimed"]
            state["total"] = max(state["total"], total)
            if not state["error"]:
                state["p"].feed(block)
        if rows:
            yield _batch(rows, FOUND, FOUND_KINDS)
    if state:
        yield _batch([_end(name, state)], FOUND, FOUND_KINDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response or revisit record of the archives below ``path``,
    whatever the files are called (but for those that begin with ``_`` or ``.``),
    reassembled: ``record_id``, ``record_type``, ``payload_bytes`` and
    ``payload_digest`` (of the whole payload), ``refers_to``, ``segments``, and
    ``error``: null, or why the record is not as it should be (a missing or
    repeated segment, a wrong total length, wrong framing, another digest than the
    record's).

    Each file is read once.  Files called ``*.gz`` are read as streams of lines,
    with one record in memory; others, plain or gzipped, as one value each, which
    Spark limits to 2 GB (a longer one is an error).  Whole records keep their
    digest only; blocks of segments are dealt by origin and sorted by number."""
    every = {"recursiveFileLookup": "true"}
    # no gzipped file can be split, so all lines of one are in one task, in order
    lines = spark.read.options(**every, pathGlobFilter="*.gz", lineSep="\n").text(path).select(F.col("value").cast("binary"), F.xxhash64(F.input_file_name()).alias("file"))
    files = spark.read.format("binaryFile").options(**every, pathGlobFilter="{*[^z],*[^g]z,*[^.]gz,z,gz}").load(path).select("content")
    parts = map_batches(lines, _streamed, PARTS).unionByName(map_batches(files, _opened, PARTS))
    dealt = parts.repartition("origin").sortWithinPartitions("origin", "number")
    return map_batches(dealt, _reassembled, FOUND)


def _end(name: str, state: dict) -> tuple:
    p, error = state["p"], state["error"]
    if not error and state["total"] < 0:
        error = "the last segment is missing"
    if not error and state["total"] != p.seen:
        error = "the total length differs"
    return _finished(name, "response", p, state["claimed"], state["next"] - 1, error)


def _batch(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Write all pages below ``path`` and read them back: a row for each row of
    ``pages``, null ids and repeated rows included.  A record that was not read
    back whole is an error, whatever columns are asked for."""
    write_warc(pages, path, "page_id", "url", "html")
    back = read_warc(pages.sparkSession, path)
    whole = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("warc: "), "error")).cast("boolean"))

    def number(c):
        digits = F.regexp_extract(c, "^urn:row:(-?[0-9]+):[0-9]+$", 1)
        return F.when(digits != "", digits).cast("long")

    return back.filter(whole).select(
        number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
