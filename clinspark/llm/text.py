"""Shared helpers: session settings, folds, bounded samples, and words of Arrow batches as integer codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clinspark.session import configure, stage_table

# Rows and bytes that one Arrow batch brings to a Python worker: they bound the memory of every operator here.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": "6m",
}


def tuned(spark: SparkSession) -> SparkSession:
    """The library's session settings plus bounded Arrow batches."""
    configure(spark)
    for name, value in BATCH_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``most`` rows of ``rows``, all of them if there are fewer: those whose hashed keys are smallest.

    Only for fitting classifiers.  A share with six deviations of room comes before the order, so that few rows are sorted.
    """
    n = rows.count()
    if n <= most:
        return rows
    share = int(2**31 * (most + 6 * most**0.5 + 20) / n)
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(2**31))
    return rows.where(place < share).orderBy(place, key).limit(most)


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents; of several labels of one id the largest counts.

    The sample is drawn from the narrow labels, so that only its own texts are read on; it is broadcast because
    ``most`` bounds it.  Null ids and null labels teach nothing.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    # Written, so that every step of a fit reads the same labels.
    chosen = stage_table(bounded_sample(known, "doc_id", most), "labels")
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


@dataclass
class Words:
    """Words of ``n`` texts: ``codes`` point into ``vocabulary``, ``doc`` is the text each word stands in."""

    vocabulary: pa.Array
    codes: np.ndarray
    doc: np.ndarray
    n: int

    def per_doc(self, value: np.ndarray | None = None) -> np.ndarray:
        """Sum over the words of each text of a value given per distinct word (one if none is given)."""
        weights = None if value is None else value[self.codes]
        return np.bincount(self.doc, weights=weights, minlength=self.n)


def split_words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of whole texts; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, doc = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(), doc.filter(full).to_numpy().astype(np.int64), len(texts))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets before each of the groups of the given sizes, and the total at the end."""
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    before = starts_of(lengths)
    return np.arange(before[-1]) + np.repeat(starts - before[:-1], lengths)


def binary_slices(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value per group: the bytes of ``data[starts[i]:starts[i + 1]]``."""
    width = data.dtype.itemsize
    offsets = pa.py_buffer((starts * width).astype(np.int64).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, offsets, pa.py_buffer(data.tobytes())])


def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that hold rows."""
    return (b for b in rows if b.num_rows)
