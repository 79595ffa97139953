"""WARC archives with a two-level capture index.

`write_archives` writes one gzip member per record and returns the captures (where each record
lies). `build_index` sorts the captures by reversed-host URL key into compressed blocks and
keeps a sparse directory with the first and last key of each block. `locate` finds the
blocks of the wanted keys by binary search, reads just these blocks, and `read_records`
reads the records' byte ranges, adjoining ranges together.

All files lie in a shared folder and are opened by URI. A task writes to files named after
its attempt, and only files that a stored manifest names are ever read, so a lost or repeated
task leaves at most an unread file behind.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_one, materialise, scratch_path, slices, small_batches

LEAST = 100  # smaller payloads are never revisits
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL = 1 << 30  # bytes of an archive before the next is begun
BLOCK_LINES = 1024
READ_AHEAD = 4 << 20
BYTES_A_TASK, LINES_A_TASK = 256 << 20, 1_000_000  # of archives read, of captures sorted or keys looked up


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def url_key(url: Column) -> Column:
    """Reversed-host key, as in org,example,www)/path?query: host labels reversed, scheme
    and fragment left out, host lowered. Empty for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.when(url.isNull(), F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), tail))


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with digest, bytes and `original`: of the pages with an
    equal payload of at least `least` bytes, the smallest page_id, where several share it.

    Payloads are compared by their SHA-256. Groups of copies are found on digests alone and stored;
    they come back to the pages by `join_one`, so payloads are shuffled only where the groups are
    too many to broadcast, and a group of any size is no hot key then.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.withColumns({"html": html, "digest": F.sha2(F.encode(html, "utf-8"), 256), "bytes": F.octet_length(html).cast("long")})
    groups = pages.select("page_id", html.alias("html")).filter(F.octet_length("html") >= least).groupBy(F.sha2(F.encode("html", "utf-8"), 256).alias("digest"))
    groups, _ = materialise(groups.agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
    return join_one(own, groups, "digest")


def tasks_for(spark: SparkSession, size: int, per_task: int, least: int) -> int:
    """Tasks of at most `per_task` each; a smaller job is dealt to all cores, `least` a task at
    the least."""
    return max(1, -(-size // per_task), min(spark.sparkContext.defaultParallelism, -(-size // least)))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record, compressed as a gzip member. A revisit has the HTTP headers of the
    full payload and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> dict:
    """The record of a gzip member: headers, HTTP headers and payload (None for a revisit).
    A response is checked against its digest and length."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    out = {"headers": headers, "payload_bytes": int(fields["Content-Length"]), "digest": headers["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": None}
    if headers["WARC-Type"] == "response":
        if len(body) != out["payload_bytes"] or hashlib.sha256(body).hexdigest() != out["digest"]:
            raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not what was written")
        out["payload"] = body
    return out


CAPTURE_SCHEMA = "key string, page_id long, path string, at long, size long"


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row of pages under `folder` and returns the stored captures.

    A null html is an empty payload, a null url has no target and the empty key. Rows that
    repeat the smallest page_id of their payload are all responses; rows without a page_id
    revisit it. An empty table writes no archive.
    """
    narrow = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    decided = decide(narrow, least).select("page_id", "url", "html", "digest", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")).alias("refers_to"), url_key(F.col("url")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, n = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0, 0
        found, base = _open(f"{folder}/archives")
        for part in slices(batches, 2):
            rows = []
            for page_id, url, html, digest, refers_to, key in zip(*(c.to_pylist() for c in part.columns)):
                if out is None or at >= ROLL:
                    if out is not None:
                        out.close()
                    path, at, n = f"{name}-{n}.warc.gz", 0, n + 1
                    found.create_dir(base, recursive=True)
                    out = found.open_output_stream(f"{base}/{path}", compression=None)
                member = build_record(page_id, url, html.encode(), digest, refers_to)
                out.write(member)
                rows.append((key, page_id, path, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "path", "at", "size"])
        if out is not None:
            out.close()

    return materialise(decided.mapInArrow(run, CAPTURE_SCHEMA), "captures")[0]


@dataclass(frozen=True)
class CaptureIndex:
    """An index on shared storage. `parts` has the first and last key of each index file,
    one entry a file; the directory of a file's blocks lies beside it."""

    folder: str
    parts: tuple[tuple[str, str, str], ...]


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sorts captures by (key, page_id) into compressed blocks of `block_lines` lines with a
    directory for each range-partitioned file. Captures of one key may fill many blocks; the
    sort's second key spreads them over files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, lines, directory = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0, [], []
        found, base = _open(f"{folder}/index")

        def block():
            nonlocal out, at, lines
            if out is None:
                found.create_dir(base, recursive=True)
                out = found.open_output_stream(f"{base}/{name}.blocks", compression=None)
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(packed)
            directory.append((lines[0][0], lines[-1][0], at, len(packed)))
            at, lines = at + len(packed), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(row)
                if len(lines) == block_lines:
                    block()
        if lines:
            block()
        if out is not None:
            out.close()
            with found.open_output_stream(f"{base}/{name}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[-1][1]]), pa.array([name])], ["first", "last", "name"])

    tasks = tasks_for(captures.sparkSession, captures.count(), LINES_A_TASK, LINES_A_TASK // 100)
    sorted_ = captures.repartitionByRange(tasks, "key", "page_id", "path", "at").sortWithinPartitions("key", "page_id", "path", "at")
    parts, _ = materialise(sorted_.mapInArrow(run, "first string, last string, name string"), "index-parts")
    # One row for each file of the index, so bounded by the number of range partitions.
    return CaptureIndex(folder, tuple(sorted((r["first"], r["last"], r["name"]) for r in parts.collect())))


class Directory:
    """Binary search over an index's files and, with one file's directory loaded at a
    time, its blocks."""

    def __init__(self, index: CaptureIndex):
        self.index, self.lasts = index, [p[1] for p in index.parts]
        self.loaded: tuple[str, list, list] | None = None

    def _blocks(self, name: str) -> tuple[list, list]:
        if self.loaded is None or self.loaded[0] != name:
            found, base = _open(f"{self.index.folder}/index")
            with found.open_input_file(f"{base}/{name}.directory") as f:
                blocks = json.loads(zlib.decompress(f.read()))
            self.loaded = (name, blocks, [b[1] for b in blocks])
        return self.loaded[1:]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, size) of the blocks that can hold the key."""
        for k in range(bisect.bisect_left(self.lasts, key), len(self.lasts)):
            first, _, name = self.index.parts[k]
            if first > key:
                return
            blocks, lasts = self._blocks(name)
            for b in range(bisect.bisect_left(lasts, key), len(blocks)):
                if blocks[b][0] > key:
                    return
                yield name, blocks[b][2], blocks[b][3]


def locate(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """Captures (key, page_id, path, at, size) of the wanted keys (column `key`; repeats and
    nulls count for nothing). Keys are sorted first, so a task looks at neighbouring
    blocks and asks for each but once; the blocks, not the keys, are then dealt out, so the
    blocks of a much captured key are read by many tasks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, now, wanted = Directory(index), None, []

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows]), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[0][2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["name", "at", "size", "keys"])

        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for place in directory.blocks(key):
                    if place != now:
                        if wanted:
                            rows.append((now, wanted))
                        now, wanted = place, []
                    wanted.append(key)
                    if len(rows) >= 256:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)
        if wanted:
            yield flush([(now, wanted)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, base = _open(f"{index.folder}/index")
        for batch in batches:
            for name, at, size, keys in zip(*(c.to_pylist() for c in batch.columns)):
                with found.open_input_file(f"{base}/{name}.blocks") as f:
                    lines = [json.loads(x) for x in zlib.decompress(f.read_at(size, at)).decode().split("\n")]
                firsts, rows = [x[0] for x in lines], []
                for key in keys:
                    rows += lines[bisect.bisect_left(firsts, key) : bisect.bisect_right(firsts, key)]
                cols = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "path", "at", "size"])

    wanted, _ = materialise(keys.select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL").distinct(), "wanted")
    tasks = tasks_for(keys.sparkSession, wanted.count(), LINES_A_TASK, LINES_A_TASK // 100)
    wanted = wanted.repartitionByRange(tasks, "key").sortWithinPartitions("key")
    asked = wanted.mapInArrow(search, "name string, at long, size long, keys array<string>")
    return asked.repartition("name", "at").mapInArrow(read, CAPTURE_SCHEMA)


RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _page(urn: str | None) -> int | None:
    text = (urn or "")[len("<urn:page:") : -1]
    return int(text) if text else None


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at the captures' byte ranges, read in archive order; ranges that adjoin
    are fetched together, up to READ_AHEAD bytes. Tasks are as many as the ranges' bytes ask for, which
    the captures' own size says nothing of; pass stored captures. `payloads` False leaves out payloads
    (they are still read and checked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, base = _open(f"{folder}/archives")
        name, file = None, None

        def emit(group):
            nonlocal name, file
            path, lo, hi = group[0][0], group[0][1], group[-1][1] + group[-1][2]
            if path != name:
                if file is not None:
                    file.close()
                name, file = path, found.open_input_file(f"{base}/{path}")
            raw, rows = file.read_at(hi - lo, lo), []
            for _, at, size in group:
                r = parse_record(raw[at - lo : at - lo + size])
                h = r["headers"]
                rows.append((_page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), r["payload_bytes"], r["digest"], h["WARC-Type"], _page(h.get("WARC-Refers-To")), r["payload"] if payloads else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in RECORD_SCHEMA.split(", ")])

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and (row[0] != group[0][0] or row[1] != group[-1][1] + group[-1][2] or row[1] + row[2] - group[0][1] > READ_AHEAD):
                    yield emit(group)
                    group = []
                group.append(row)
        if group:
            yield emit(group)
        if file is not None:
            file.close()

    tasks = tasks_for(captures.sparkSession, captures.agg(F.sum("size")).first()[0] or 0, BYTES_A_TASK, BYTES_A_TASK // 64)
    ordered = captures.select("path", "at", "size").repartitionByRange(tasks, "path", "at").sortWithinPartitions("path", "at")
    return ordered.mapInArrow(run, RECORD_SCHEMA)


def archive_and_read(pages: DataFrame, least: int = LEAST, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes all pages, indexes them, looks up every URL and returns what the archives hold."""
    spark: SparkSession = pages.sparkSession
    folder = scratch_path(spark, "lasting-warc")  # the records are read as the result is
    captures = write_archives(pages, folder, least)
    index = build_index(captures, folder, block_lines)
    found, _ = materialise(locate(index, pages.select(url_key(F.col("url").cast("string")).alias("key"))), "found")
    return read_records(found, folder, payloads=False)
