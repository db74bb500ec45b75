"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A shard file is a run of frames: payload length (8 bytes), masked CRC-32 of those bytes (4), payload, masked CRC-32 of
the payload (4).  A payload is one byte of flags (1: an id is present, 2: ids take four bytes, else two), the doc_id
(8 bytes), then the ids.  The index file beside it has one entry of 32 bytes per record: frame offset, frame length,
ids before it in the shard, ids in it.  All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from clinspark.llm.encoding import word_encoder
from clinspark.llm.files import new_file, open_file
from clinspark.llm.text import batches, starts_of
from clinspark.session import stage_table

HEAD, PAYLOAD_HEAD, CHECK, ENTRY = struct.Struct("<QI"), struct.Struct("<Bq"), struct.Struct("<I"), np.dtype("<u8")
HAS_ID, WIDE = 1, 2
READ_BYTES = 8_000_000  # most that is read at once, but for a longer record
MANIFEST = "shard long, path string, index_path string, n_records long, n_tokens long, n_bytes long"


@dataclass(frozen=True)
class RecordFormat:
    """``shard_chars`` of text go to a shard on average."""

    tokenizer: str
    end_id: int | None = 2
    shard_chars: int = 32_000_000


class DamagedRecord(ValueError):
    """A frame whose checksums do not hold."""


def masked(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that the checksum of checksummed data differs."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    flags = (HAS_ID if doc_id is not None else 0) | (WIDE if wide else 0)
    payload = PAYLOAD_HEAD.pack(flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + CHECK.pack(masked(length)) + payload + CHECK.pack(masked(payload))


def unframe(data: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one frame; both checksums are tested."""
    if len(data) < HEAD.size:
        raise DamagedRecord("frame is cut short")
    length, check = HEAD.unpack_from(data)
    if masked(data[:8]) != check or len(data) != HEAD.size + length + CHECK.size:
        raise DamagedRecord("length does not match its checksum")
    payload = data[HEAD.size:HEAD.size + length]
    if masked(payload) != CHECK.unpack_from(data, HEAD.size + length)[0]:
        raise DamagedRecord("payload does not match its checksum")
    flags, doc_id = PAYLOAD_HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=PAYLOAD_HEAD.size)
    return (doc_id if flags & HAS_ID else None), ids.astype("<u4")


def write_records(documents: DataFrame, folder: str, options: RecordFormat) -> DataFrame:
    """Write all documents in ascending doc_id order and return the manifest, one row per shard, written as a table.

    Shards are ranges of doc_id, so their numbers follow the order too.  Null texts count as empty; null ids come first;
    rows that repeat an id stand in the order of their texts; an empty table writes no shard.
    """
    size = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // options.shard_chars))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = batches(parts)
        first = next(parts, None)
        if first is None:
            return
        encoder = word_encoder(options.tokenizer)
        shard, offset, tokens, n = TaskContext.get().partitionId(), 0, 0, 0
        path = f"{folder}/shard-{shard:08d}"
        end = np.array([] if options.end_id is None else [options.end_id], dtype="<u4")
        with new_file(f"{path}.records") as out, new_file(f"{path}.index") as index:
            while first is not None:
                ids, counts = encoder.encode(first["text"])
                at, entries = starts_of(counts), []
                for k, doc_id in enumerate(first["doc_id"].to_pylist()):
                    own = np.concatenate((ids[at[k]:at[k + 1]], end))
                    data = frame(doc_id, own)
                    out.write(data)
                    entries.append((offset, len(data), tokens, len(own)))
                    offset, tokens, n = offset + len(data), tokens + len(own), n + 1
                index.write(np.array(entries, dtype=ENTRY).tobytes())
                first = next(parts, None)
        yield pa.RecordBatch.from_pydict({
            "shard": [shard], "path": [f"{path}.records"], "index_path": [f"{path}.index"], "n_records": [n],
            "n_tokens": [tokens], "n_bytes": [offset],
        })

    named = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = named.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return stage_table(ordered.mapInArrow(rows, MANIFEST), "records")


def read_index(manifest: DataFrame) -> DataFrame:
    """(path, at, size, start, n_tokens): one row per record, from the index files alone.

    ``start`` counts the ids of all records before it, over all shards: a running total of the manifest, which has
    a row per shard.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = manifest.withColumn("base", before).select("path", "index_path", "base")
    shards = max(1, manifest.count())

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            for path, index_path, base in zip(*(b[c].to_pylist() for c in ("path", "index_path", "base"))):
                with open_file(index_path) as f:
                    while raw := f.read(4 * ENTRY.itemsize * 65536):
                        at, size, start, n = np.frombuffer(raw, ENTRY).reshape(-1, 4).astype(np.int64).T
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(at)), pa.array(at), pa.array(size), pa.array(start + base), pa.array(n)],
                            ["path", "at", "size", "start", "n_tokens"],
                        )

    return based.repartition(shards).mapInArrow(rows, "path string, at long, size long, start long, n_tokens long")


def fetch(entries: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the records that ``entries`` (rows of the index, in any order) point at.

    Neighbouring records of a file are read together, at most ``READ_BYTES`` at once; every frame is checked.
    """
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            b = b.sort_by([("path", "ascending"), ("at", "ascending")])
            todo = list(zip(*(b[c].to_pylist() for c in ("path", "at", "size", "start"))))
            k = 0
            while k < len(todo):
                path, low = todo[k][0], todo[k][1]
                high, last = low + todo[k][2], k + 1
                while last < len(todo) and todo[last][0] == path and todo[last][1] <= high and todo[last][1] + todo[last][2] - low <= READ_BYTES:
                    high, last = max(high, todo[last][1] + todo[last][2]), last + 1
                with open_file(path) as f:
                    f.seek(low)
                    data = f.read(high - low)
                found = [unframe(data[at - low:at - low + size]) for _, at, size, _ in todo[k:last]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in found], pa.int64()), pa.array([t[3] for t in todo[k:last]], pa.int64()),
                     pa.array([i.tobytes() for _, i in found], pa.binary())],
                    ["doc_id", "start", "ids"],
                )
                k = last

    return entries.select("path", "at", "size", "start").mapInArrow(rows, "doc_id long, start long, ids binary")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """All records in an order that depends on ``seed`` alone, fetched through the index."""
    entries = read_index(manifest)
    return fetch(entries.orderBy(F.xxhash64("path", "at", F.lit(seed))))
