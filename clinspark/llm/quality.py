"""Quality rules: boosted trees over document statistics, scored in batches from flat node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from clinspark.llm.boosting import Boosting, FlatTrees
from clinspark.llm.text import Words, batches, labelled_texts, split_words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "capital_words",
    "digit_words", "closed_words", "symbol_words", "words_per_line", "same_as_last", "log_lines", "other_chars",
)
# More symbols, repeated lines, repeated windows or immediate repeats never raise the quality.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "symbol_words", "same_as_last")


@dataclass(frozen=True)
class QualityOptions:
    """``fit_rows`` bounds the labelled documents of the fit; a document stays if its score reaches ``keep_from``."""

    fit_rows: int = 20_000
    keep_from: float = 0.5
    boosting: Boosting = Boosting(trees=60, depth=3, monotone={FEATURES.index(f): -1 for f in FALLING})


def repeated_words(words: Words) -> np.ndarray:
    """Words of each text that lie in a five-word window which occurs twice or more in that text.

    Windows are compared exactly: pairs of (code so far, next word) are renumbered step by step, texts first.
    """
    n = len(words.codes)
    if n < WINDOW:
        return np.zeros(words.n, dtype=np.int64)
    size = len(words.vocabulary) + 1
    start = np.arange(n - WINDOW + 1)
    start = start[words.doc[start] == words.doc[start + WINDOW - 1]]
    code = words.doc[start]
    for k in range(WINDOW):
        code = np.unique(code * size + words.codes[start + k], return_inverse=True)[1].astype(np.int64)
    twice = start[np.bincount(code)[code] > 1] if len(code) else start
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(words.doc, weights=np.cumsum(edge[:-1]) > 0, minlength=words.n).astype(np.int64)


def line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them that equal an earlier line, of each text."""
    lists = pc.split_pattern(texts, "\n")
    lines, doc = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")
    code = lines.filter(full).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = doc.filter(full).to_numpy().astype(np.int64)
    count = np.bincount(doc, minlength=len(texts))
    first = np.unique(doc * (code.max(initial=0) + 1) + code, return_index=True)[1]
    return count, count - np.bincount(doc[first], minlength=len(texts))


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of ``BASE`` and the matrix of ``FEATURES`` of each text; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    words = split_words(texts)
    vocabulary, count = words.vocabulary, words.per_doc()
    length = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(float)
    symbols = pc.count_substring_regex(vocabulary, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(float)

    def words_with(pattern: str) -> np.ndarray:
        return words.per_doc(pc.match_substring_regex(vocabulary, pattern).to_numpy(zero_copy_only=False).astype(float))

    lines, dup_lines = line_counts(texts)
    repeats = repeated_words(words)
    pairs = np.unique(words.doc * (len(vocabulary) + 1) + words.codes) // (len(vocabulary) + 1)
    same = np.flatnonzero((words.codes[1:] == words.codes[:-1]) & (words.doc[1:] == words.doc[:-1]))
    chars = words.per_doc(length)
    base = {
        "n_words": count, "word_chars": chars, "n_symbols": words.per_doc(symbols), "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
    }
    base = {k: v.astype(np.int64) for k, v in base.items()}
    many, long = np.maximum(count, 1), np.maximum(chars, 1)
    features = np.column_stack([
        np.log1p(count), chars / many, base["n_symbols"] / long, dup_lines / np.maximum(lines, 1), repeats / many,
        np.bincount(pairs, minlength=words.n) / many, words_with(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$") / many,
        words_with("[0-9]") / many, words_with(r"[.,;:!?]$") / many, words_with("[#*$%&|<>]") / many,
        count / np.maximum(lines, 1), np.bincount(words.doc[same], minlength=words.n) / many, np.log1p(lines),
        words.per_doc(pc.count_substring_regex(vocabulary, r"[^\p{L}\p{N}]").to_numpy(zero_copy_only=False).astype(float)) / long,
    ])
    return base, features


@dataclass
class QualityModel:
    trees: FlatTrees
    options: QualityOptions

    def judge(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Base counts, ``base_failed``, ``score`` (probability of good quality) and ``kept`` of each text."""
        base, features = statistics(texts)
        failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
        score = self.trees.probability(features)
        return base | {"base_failed": failed, "score": score, "kept": ~failed & (score >= self.options.keep_from)}


def fit_quality(documents: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions()) -> QualityModel:
    """Trees fitted on ``labels.quality`` of a bounded sample of labelled documents.

    Executors turn texts to statistics; the driver gets one short row of numbers per sampled document, at most
    ``options.fit_rows``.  Without labels, or with one class only, the score is constant.
    """
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            x = statistics(b["text"])[1]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], pa.array(list(x))], ["doc_id", "y", "x"])

    sample = labelled_texts(documents, labels, "quality", options.fit_rows)
    got = sample.mapInArrow(rows, "doc_id long, y int, x array<double>").orderBy("doc_id", "x").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return QualityModel(options.boosting.fit(x, got["y"].to_numpy().astype(float)), options)


def score_quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """One row per row of ``documents``: doc_id, the base counts, base_failed, kept and score.

    Null and empty texts have no words and fail the base rule; repeated rows are judged alike, each on its own; an
    empty table gives no rows; further columns of ``documents``, whatever their names, are not read.
    """
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            found = model.judge(b["text"])
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *(pa.array(found[k]) for k in (*BASE, "base_failed", "kept", "score"))],
                ["doc_id", *BASE, "base_failed", "kept", "score"],
            )

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, score double"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)


def keep_good(documents: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``documents``, with all their columns, that the base rules and the trees keep."""
    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        return pa.array(model.judge(texts)["kept"])

    return documents.where(kept(F.col("text").cast("string")))
