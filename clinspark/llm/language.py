"""Language identification by error-correcting output codes over hashed letter n-grams.

Every language has a codeword.  One binary classifier per bit tells the languages with +1 from those with -1; its
weights are log-odds of n-grams, from one count of all training texts.  Decoding adds a logistic loss per bit, weighted
by how far apart the bit's two sides are, and takes the codeword of least loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from clinspark.llm.minhash import STEP, mix
from clinspark.llm.text import batches, crc_fold, starts_of

UNKNOWN = "und"
SLICE_ROWS = 512  # texts whose n-grams are held at once


@dataclass(frozen=True)
class LanguageOptions:
    """n-gram lengths, hash buckets, smoothing, the largest number of languages, and the lead below which a
    prediction is ambiguous."""

    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    smoothing: float = 0.5
    most_languages: int = 200
    lead: float = 0.2


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, which bound the n-grams held at once; every row is in one piece."""
    for b in batches(parts):
        for begin in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(begin, SLICE_ROWS)


def ngrams(texts: pa.Array, options: LanguageOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram of lower-cased words with their borders, and the letters of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    n = len(texts)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(n), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    letter = letters()[points]
    n_letters = np.bincount(doc[letter], minlength=n)
    # A run of other characters is one border, and every text begins with one.
    first = starts_of(np.bincount(doc, minlength=n))[:-1]
    points, doc = np.insert(points, first, 0), np.insert(doc, first, np.arange(n))
    letter = np.insert(letter, first, False)
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    points, doc = np.where(letter[keep], points[keep], 0).astype(np.uint64), doc[keep]
    buckets, owners = [], []
    for order in options.orders:
        size = len(points) - order + 1
        if size <= 0:
            continue
        h = np.full(size, np.uint64(order))
        for k in range(order):
            h = h * STEP + points[k:k + size]
        same = doc[:size] == doc[order - 1:]
        buckets.append((mix(h[same]) % np.uint64(options.buckets)).astype(np.int64))
        owners.append(doc[:size][same])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(buckets or [none]), np.concatenate(owners or [none]), n_letters


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 per class: all distinct splits for up to seven classes, else the best of random codes."""
    if classes <= 7:
        columns = [[1 if c in side else -1 for c in range(classes)]
                   for size in range(classes) for rest in combinations(range(1, classes), size) if len(side := {0, *rest}) < classes]
        return np.array(columns, dtype=float).reshape(-1, classes).T
    rng, bits = np.random.default_rng(7), 10 * int(np.ceil(np.log2(classes)))
    best, least = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        apart = (bits - code @ code.T) / 2
        low = apart[~np.eye(classes, dtype=bool)].min()
        if low > least and (np.abs(code.sum(axis=0)) < classes).all():
            best, least = code, low
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    options: LanguageOptions

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (share of the best codeword) and whether the second is close, for each text."""
        bucket, doc, n_letters = ngrams(texts, self.options)
        n = len(texts)
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        margin = np.stack([np.bincount(doc, weights=w[bucket], minlength=n) for w in self.weights], axis=1) if len(self.weights) else np.zeros((n, 0))
        margin = margin / np.sqrt(count)[:, None]
        loss = np.stack([(self.trust * np.logaddexp(0, -margin * word)).sum(axis=1) for word in self.code], axis=1) if len(self.code) else np.zeros((n, 1))
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share = np.sort(share / share.sum(axis=1, keepdims=True), axis=1)
        silent = (n_letters == 0) | (not self.languages)
        best = [UNKNOWN if s else self.languages[k] for s, k in zip(silent.tolist(), loss.argmin(axis=1).tolist())]
        second = share[:, -2] if share.shape[1] > 1 else np.zeros(n)
        score = np.where(silent, 0.0, share[:, -1])
        return best, score, silent | (share[:, -1] - second < self.options.lead)


def fit_languages(documents: DataFrame, options: LanguageOptions = LanguageOptions()) -> LanguageModel:
    """Model from all texts of ``documents`` whose ``lang`` is not null.

    Tasks count n-grams per language in arrays and hand on their sums; what comes to the driver has at most one row per
    bucket and language, whatever the number of documents.
    """
    labelled = documents.where("lang IS NOT NULL AND text IS NOT NULL")
    languages = [r["lang"] for r in labelled.select("lang").distinct().orderBy("lang").limit(options.most_languages + 1).collect()]
    if len(languages) > options.most_languages:
        raise ValueError(f"more than {options.most_languages} languages")
    number, size = {lang: k for k, lang in enumerate(languages)}, options.buckets

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * size, dtype=np.int64)
        for b in slices(parts):
            bucket, doc, _ = ngrams(b["text"], options)
            own = np.array([number[lang] for lang in b["lang"].to_pylist()], dtype=np.int64)
            total += np.bincount(own[doc] * size + bucket, minlength=len(total))
        seen = np.flatnonzero(total)
        for i in range(0, len(seen), 65536):
            at = seen[i:i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    sums = labelled.select("lang", "text").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(len(languages) * size)
    table[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    table = table.reshape(len(languages), size) + options.smoothing
    share = table / table.sum(axis=1, keepdims=True) if languages else table
    code = codewords(len(languages)) if languages else np.zeros((0, 0))
    weights, trust = [], []
    for bit in code.T:
        plus, minus = share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)
        odds = np.log(plus / minus)
        weights.append(odds)
        trust.append(((plus - minus) * odds).sum())
    trust = np.array(trust)
    return LanguageModel(languages, code, np.array(weights).reshape(-1, size), trust / max(trust.mean(), 1e-12) if len(trust) else trust, options)


def training_texts(documents: DataFrame) -> DataFrame:
    """Documents that may teach: crc32 of the id as text, modulo 5, is not 0."""
    return documents.where(crc_fold("doc_id", 5) != 0)


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, lang_pred, score, ambiguous.

    A null text, or one without letters, is ``und`` with score 0 and ambiguous; so is everything if nothing could be
    learned.  Repeated rows are judged alike; a null id is not held out; an empty table gives no rows; further columns,
    whatever their names, are not read.
    """
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts):
            best, score, ambiguous = model.predict(b["text"])
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array(best, pa.string()), pa.array(score), pa.array(ambiguous)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    named = documents.select(
        F.col("doc_id").cast("long"), F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string"),
    )
    return named.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
