"""WARC archives of web pages: a writer with revisit records, and a reader that salvages damaged files.

Each record is a gzip member of its own, or plain bytes.  The reader checks every member and record; where a check
fails it searches for the next gzip magic or version line at which a whole record can be read again, goes on there, and
reports the bytes between as a gap.  In a gzip member of several records, the unpacked bytes are searched likewise.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from clinspark.llm.files import new_file, open_file
from clinspark.llm.text import batches
from clinspark.session import stage_table

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
PIECE = 1 << 20
LONGEST_START = 10
MANIFEST = "path string, n_records long, n_bytes long"
READ = (
    "path string, kind string, at long, size long, reason string, record_type string, page_id long, url string, "
    "refers_to long, payload binary, payload_bytes long, payload_digest string"
)


@dataclass(frozen=True)
class WarcOptions:
    """``min_bytes`` from which equal payloads are told once; ``file_bytes`` after which a task begins a new file."""

    min_bytes: int = 0
    file_bytes: int = 64_000_000
    compress: bool = True
    date: str = "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, owner: int | None, payload_digest: str, options: WarcOptions) -> bytes:
    """One record: a response with its payload, or a revisit of the page ``owner`` without it."""
    revisit = owner is not None
    block = HTTP_HEAD.format(n=len(payload)).encode() + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {payload_digest}')}>",
        "WARC-Date": options.date,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~"),
        "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To-Page-ID": owner,
        "WARC-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    whole = VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(whole, 6, mtime=0) if options.compress else whole


def write_warc(pages: DataFrame, folder: str, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the manifest, a row per file, as a table.

    Of equal payloads of at least ``min_bytes`` the row with the largest page_id is the response and the others revisit
    it; rows that repeat that page_id are responses too, and so are all if no such row has an id.  A null html is an
    empty payload; null ids and urls are left out of the header; an empty table writes no file; further columns are
    not read.  Digests meet without the pages' bytes: owners are aggregated before they join.
    """
    own = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    owners = (
        own.where(F.length("payload") >= options.min_bytes).groupBy("sha1")
        .agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("sha1", "owner")
    )
    long_enough = F.length("payload") >= options.min_bytes
    roles = own.join(owners, "sha1", "left").withColumn(
        "owner", F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    )

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, parts = TaskContext.get().partitionId(), 0, batches(parts)
        todo = ((page, url, payload, owner) for b in parts
                for page, url, payload, owner in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "owner"))))
        row = next(todo, None)
        while row is not None:
            path, n, size = f"{folder}/part-{task:06d}-{number:05d}.warc" + (".gz" if options.compress else ""), 0, 0
            with new_file(path) as out:
                while row is not None and size < options.file_bytes:
                    page, url, payload, owner = row
                    data = record(page, url, payload, owner, digest(payload), options)
                    out.write(data)
                    n, size, row = n + 1, size + len(data), next(todo, None)
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})
            number += 1

    chosen = roles.select("page_id", "url", "payload", "owner")
    return stage_table(chosen.mapInArrow(rows, MANIFEST), "archives")


class Damaged(ValueError):
    """A member or record that fails a check."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at`` of plain bytes, and where it ends."""
    if not START.match(data, at) or data[at:at + 1] != b"W":
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Damaged("header without end")
    head = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    try:
        length = int(head["content-length"])
        page_id = int(head["warc-page-id"]) if "warc-page-id" in head else None
        refers_to = int(head["warc-refers-to-page-id"]) if "warc-refers-to-page-id" in head else None
        told = int(head["warc-payload-length"]) if "warc-payload-length" in head else None
    except (KeyError, ValueError):
        raise Damaged("header without a valid number") from None
    start, end = head_end + 4, head_end + 4 + length
    block = data[start:end]
    if length < 0 or len(block) < length or data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("block is cut short")
    if head.get("warc-block-digest", "").removeprefix("sha1:") not in ("", digest(block)):
        raise Damaged("block does not match its digest")
    kind = head.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    given = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and given not in ("", digest(payload)):
        raise Damaged("payload does not match its digest")
    url = unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None
    return {
        "record_type": kind, "page_id": page_id, "url": url, "refers_to": refers_to,
        "payload": None if kind == "revisit" else payload,
        "payload_bytes": told if kind == "revisit" else len(payload),
        "payload_digest": given if kind == "revisit" else digest(payload),
    }, end + 4


def inner_rows(data: bytes) -> list[dict]:
    """The records of a member's unpacked bytes, and the stretches between them that hold no whole record."""
    found, k, lost, problem = [], 0, None, ""

    def gap(end: int) -> dict:
        return {"kind": "gap", "reason": f"{problem} (unpacked bytes {lost} to {end})", "problem": problem}

    while k < len(data):
        try:
            one, end = parse_record(data, k)
        except Damaged as error:
            if lost is None:
                lost, problem = k, str(error)
            hit = VERSION_LINE.search(data, k + 1)
            k = hit.start() if hit else len(data)
            continue
        if lost is not None:
            found.append(gap(k))
            lost = None
        found.append({"kind": "record", **one})
        k = end
    return found if lost is None else [*found, gap(len(data))]


class Salvage:
    """Reads the records of one file in turn; holds no more than one member, or one plain record, at once."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def at(self, place: int, n: int) -> bytes:
        return self.file.read_at(min(n, self.size - place), place) if place < self.size else b""

    def unpacked(self, place: int) -> tuple[bytes, int, str]:
        """What the gzip member at ``place`` holds, as far as it unpacks, where reading ended, and what was wrong."""
        unpack, out, read = zlib.decompressobj(31), [], place
        while not unpack.eof:
            piece = self.at(read, PIECE)
            if not piece:
                return b"".join(out), read, "member is cut short"
            before = unpack.copy()
            try:
                out.append(unpack.decompress(piece))
            except zlib.error as error:
                # A call that fails gives nothing, so this piece is taken again byte by byte up to the damage.
                for k in range(len(piece)):
                    try:
                        out.append(before.decompress(piece[k:k + 1]))
                    except zlib.error:
                        break
                return b"".join(out), read + k, f"member: {error}"
            read += len(piece)
        return b"".join(out), read - len(unpack.unused_data), ""

    def member(self, place: int) -> tuple[list[dict], int, str]:
        """The records and gaps that begin at ``place`` (those of a gzip member, or one plain record), where they end,
        and what is wrong with a member of which only a part unpacks."""
        if self.at(place, 3) == b"\x1f\x8b\x08":
            data, end, problem = self.unpacked(place)
            found = inner_rows(data)
            if not any(r["kind"] == "record" for r in found) and (problem or found):
                raise Damaged(problem or found[0]["problem"])
            if problem and found[-1]["kind"] == "gap":
                found.pop()  # told with the rest of the member
            return found, end, problem
        data = self.at(place, PIECE)
        while True:
            try:
                one, end = parse_record(data)
                return [{"kind": "record", **one}], place + end, ""
            except Damaged:
                # More bytes help only a record that is not whole yet.
                head_end = data.find(b"\r\n\r\n")
                length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data[:max(head_end, 0)])
                need = head_end + 8 + int(length[1]) if length else 2 * len(data)
                whole = place + len(data) >= self.size or need <= len(data) or (head_end < 0 and len(data) > 4 * PIECE)
                if whole or not data.startswith(b"WARC/"):
                    raise
                data = self.at(place, need)

    def next_start(self, place: int) -> int:
        """The next place from ``place`` on where a member or record may begin; the file's size if there is none."""
        while place < self.size:
            piece = self.at(place, PIECE)
            if hit := START.search(piece):
                return place + hit.start()
            if len(piece) < PIECE:
                break
            place += len(piece) - LONGEST_START
        return self.size

    def rows(self) -> Iterator[dict]:
        """Records and gaps; those inside a gzip member bear the member's place and size, or as much as was unpacked."""
        place, gap, reason, told, told_end = 0, None, "", [], 0
        while place < self.size:
            try:
                found, end, problem = self.member(place)
            except Damaged as error:
                if gap is None:
                    gap, reason = place, str(error)
                place = self.next_start(place + 1)
                continue
            if place < told_end and found and found[0] in told and self.at(place, 1) == b"W":
                # The bytes of a damaged member that was not compressed: this record is known from unpacking it.
                place = self.next_start(end)
                continue
            if gap is not None:
                yield {"kind": "gap", "at": gap, "size": place - gap, "reason": reason}
                gap = None
            for one in found:
                yield {"at": place, "size": end - place, **one}
            if problem:
                # Where a damaged member ends is not known, so the next start is searched from its beginning.
                gap, reason, told, told_end = place, problem, found, end
                place = self.next_start(place + 1)
            else:
                place = end
        if gap is not None:
            yield {"kind": "gap", "at": gap, "size": self.size - gap, "reason": reason}


def read_warc(files: DataFrame) -> DataFrame:
    """Records and gaps of the files in column ``path``, told apart by ``kind``; a damaged file never stops the read.

    Each file is one unit of work, dealt over as many tasks as there are files.  An empty file has no rows.
    """
    fields = [f.split()[0] for f in READ.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in READ.split(", "))])
    count = max(1, files.count())

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            for path in b["path"].to_pylist():
                with open_file(path) as f:
                    held, size = [], 0
                    for one in Salvage(f, f.size()).rows():
                        held.append({k: one.get(k) for k in fields} | {"path": path})
                        size += len(one.get("payload") or b"")
                        if len(held) >= 1000 or size > 4 * PIECE:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path").repartition(count).mapInArrow(rows, READ)
