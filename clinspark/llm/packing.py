"""Cost-balanced packing of tokenized documents into sequences of a fixed capacity.

The cost of a piece is linear in its tokens (projections) plus quadratic (attention within the piece).  Pieces in
descending order go to the sequence of lowest cost that has room; a piece that fits nowhere is cut at the room of the
cheapest open sequence and its rest is queued again.  Since a group opens only as many sequences as its tokens fill,
less than one sequence of padding is left per group.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clinspark.llm.encoding import word_encoder
from clinspark.llm.text import batches, binary_slices, starts_of

CHARS_PER_TOKEN = 2.5  # only sets how many groups there are


@dataclass(frozen=True)
class Packing:
    """``group_tokens`` is the mean size of the groups that are packed apart: it bounds the memory of a task."""

    tokenizer: str
    end_id: int = 2
    capacity: int = 4096
    linear: float = 1.0
    quadratic: float = 1.0 / 1024
    group_tokens: int = 3_000_000

    def cost(self, tokens: np.ndarray) -> np.ndarray:
        return self.linear * tokens + self.quadratic * tokens * tokens


def token_pieces(documents: DataFrame, options: Packing) -> DataFrame:
    """(doc_id, start, doc_tokens, ids, spread): every document with its end id, cut at the capacity.

    ``ids`` are unsigned 16-bit while they pass through the shuffle if all of a batch fit, else 32-bit.  ``spread``
    depends on the content alone, so a retried task deals its rows as before.
    """
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(options.tokenizer)
        for b in batches(parts):
            ids, counts = encoder.encode(b["text"])
            whole = counts + 1
            at = starts_of(whole)
            full = np.full(at[-1], options.end_id, dtype="<u4")
            body = np.ones(at[-1], dtype=bool)
            body[at[1:] - 1] = False
            full[body] = ids
            pieces = -(-whole // options.capacity)
            doc = np.repeat(np.arange(len(whole)), pieces)
            nth = np.arange(len(doc)) - np.repeat(starts_of(pieces)[:-1], pieces)
            start = nth * options.capacity
            cuts = np.append(at[doc] + start, at[-1])
            narrow = full.astype("<u2") if full.max(initial=0) < 65536 else full
            slices = binary_slices(narrow, cuts)
            spread = np.fromiter((zlib.crc32(s) for s in slices.to_pylist()), np.int64, len(slices))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(pa.array(doc)), pa.array(start), pa.array(whole[doc]), pa.array(np.diff(cuts)),
                 slices.cast(pa.binary()), pa.array(spread)],
                ["doc_id", "start", "doc_tokens", "length", "ids", "spread"],
            )

    named = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(rows, "doc_id long, start long, doc_tokens long, length long, ids binary, spread long")


def assign(lengths: np.ndarray, options: Packing) -> list[tuple[int, int, int, int, int]]:
    """(piece, offset in piece, length, sequence, offset in sequence) of each placed part."""
    sequences = -(-int(lengths.sum()) // options.capacity)
    room, cost = np.full(sequences, options.capacity), np.zeros(sequences)
    queue = [(-n, i, 0) for i, n in enumerate(lengths.tolist())]
    heapq.heapify(queue)
    placed = []
    while queue:
        negative, piece, skipped = heapq.heappop(queue)
        length = -negative
        fits = room >= length
        if not fits.any():
            fits = room > 0
        s = int(np.where(fits, cost, np.inf).argmin())
        part = min(length, int(room[s]))
        placed.append((piece, skipped, part, s, options.capacity - int(room[s])))
        room[s] -= part
        cost[s] += options.cost(part)
        if part < length:
            heapq.heappush(queue, (part - length, piece, skipped + part))
    return placed


def pack(documents: DataFrame, options: Packing) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    sequence_cost.

    Null and empty texts are a document of the end id alone.  Repeated rows are packed each on its own, a null id is
    kept, an empty table gives no rows, and further columns, whatever their names, are not read.
    """
    size = documents.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).first()
    tokens = (size["chars"] or 0) / CHARS_PER_TOKEN + size["n"]
    groups = max(1, round(tokens / options.group_tokens))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("spread", "ascending")])
        lengths = rows["length"].to_numpy()
        parts = np.array(assign(lengths, options), dtype=np.int64).reshape(-1, 5)
        piece, skipped, length, sequence, offset = parts.T
        raw = rows["ids"].to_pylist()
        total = np.bincount(sequence, weights=options.cost(length.astype(float)))
        ids = []
        for p, k, n in zip(piece.tolist(), skipped.tolist(), length.tolist()):
            width = "<u2" if len(raw[p]) == 2 * lengths[p] else "<u4"
            ids.append(np.frombuffer(raw[p], width)[k:k + n].astype("<u4").tobytes())
        taken = rows.take(pa.array(piece))
        return pa.table({
            "doc_id": taken["doc_id"], "start": pa.array(taken["start"].to_numpy() + skipped), "length": length,
            "ids": pa.array(ids, pa.binary()), "doc_tokens": taken["doc_tokens"],
            "sequence_id": (key[0].as_py() << 32) + sequence, "offset": offset, "sequence_cost": total[sequence],
        })

    dealt = token_pieces(documents, options).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "spread"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(
        packed,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_cost double",
    )
