"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

The lexicon has a fixed part and a part learned from the training labels: words, and beginnings of words, that stand in
toxic documents far more often than in others.  It is learned on one half of the sample and the trees on the other, so
that the trees see the learned part as it does on unseen texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from clinspark.llm.boosting import Boosting, FlatTrees, isotonic, out_of_fold
from clinspark.llm.text import Words, batches, crc_fold, labelled_texts, split_words

# Insults in four languages, the fixed part of the lexicon.
INSULTS = (
    "arsehole asshole bastard bitch clown cretin creep crap damn disgusting dumb dumbass fool freak fuck fucking garbage "
    "hate idiot idiotic imbecile jerk kill loser lunatic moron moronic nasty pathetic pig rat scum shit shut stupid sucker "
    "trash ugly vermin weak worthless "
    "abschaum arschloch dumm dummkopf ekelhaft hurensohn idiotin schwachkopf trottel verdammt versager wertlos "
    "abruti connard crétin dégoûtant imbécile merde minable nul ordure pathétique stupide "
    "asqueroso basura cabrón estúpido gilipollas idiota imbécil inútil mierda patético puta tonto"
).split()
SECOND_PERSON = (
    "you your yours yourself youre u du dich dir dein deine deinen euch euer sie ihr tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro su sus"
).split()
LEET = str.maketrans("013457@$!", "oieastasi")
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_"
PREFIXES = (4, 5, 6)
NEAR = 5  # words between a second person and a lexicon word
FEATURES = (
    "fixed_hits", "fixed_density", "learned_words", "learned_density", "learned_weight", "stem_hits", "stem_density",
    "stem_weight", "hidden_hits", "second_person", "near_hits", "capital_chars", "capital_words", "exclamations",
    "questions", "repeated_marks", "obfuscated", "stretched", "log_words",
)
RISING = ("fixed_hits", "learned_words", "learned_weight", "stem_hits", "stem_weight", "hidden_hits", "near_hits")


@dataclass(frozen=True)
class ToxicityOptions:
    """``fit_rows`` bounds the labelled documents; a learned unit needs ``min_evidence`` of log-likelihood ratio (G²)
    and at least half of its documents toxic; at most ``max_units`` with most evidence are kept."""

    fit_rows: int = 24_000
    min_evidence: float = 16.0
    max_units: int = 3_000
    folds: int = 3
    threshold: float = 0.7
    boosting: Boosting = Boosting(trees=60, depth=3, rate=0.2, monotone={FEATURES.index(f): 1 for f in RISING})


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


def units(word: str) -> list[str]:
    """A word's lexicon keys: itself, and its beginnings (marked by a closing tilde)."""
    return [word, *(word[:k] + "~" for k in PREFIXES if len(word) > k)]


class Lexicon:
    """Fixed and learned words, and what each distinct word of a batch contributes to the features."""

    COLUMNS = 10

    def __init__(self, weights: dict[str, float]):
        self.weights, self.fixed, self.second = weights, frozenset(INSULTS), frozenset(SECOND_PERSON)

    def describe(self, word: str) -> tuple[float, ...]:
        w = bare(word)
        fixed = w in self.fixed
        learned = self.weights.get(w, 0.0)
        stem = max((self.weights.get(w[:k] + "~", 0.0) for k in PREFIXES if len(w) > k), default=0.0)
        plain = w.isalpha()
        hidden = 0.0
        if not plain and w:
            opened = "".join(c for c in w.translate(LEET) if c.isalpha())
            hidden = float(opened != w and (opened in self.fixed or opened in self.weights))
        letters = sum(map(str.isalpha, word)) if not plain else len(w)
        return (
            float(fixed), learned, stem, hidden, float(w in self.second), float(letters > 1 and word.isupper()),
            float(not plain and letters > 0 and any(c.isdigit() or c in "*@$#" for c in w)),
            float(any(a == b == c for a, b, c in zip(w, w[1:], w[2:]))), float(sum(map(str.isupper, word))), float(letters),
        )


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """The matrix of ``FEATURES``; a null text counts as empty, and an empty text has zeros."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    words: Words = split_words(texts)
    vocabulary = words.vocabulary
    of = np.array([lexicon.describe(w) for w in vocabulary.to_pylist()], dtype=float).reshape(-1, Lexicon.COLUMNS)
    fixed, learned, stem, hidden, second, capital, obfuscated, stretched, upper, letters = of.T

    def matches(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(vocabulary, pattern).to_numpy(zero_copy_only=False).astype(float)

    def highest(value: np.ndarray) -> np.ndarray:
        out = np.zeros(words.n)
        hot = np.flatnonzero(value[words.codes])
        np.maximum.at(out, words.doc[hot], value[words.codes[hot]])
        return out

    total = {k: words.per_doc(v) for k, v in (
        ("fixed", fixed), ("learned", learned > 0), ("stem", stem > 0), ("hidden", hidden), ("second", second),
        ("capital", capital), ("obfuscated", obfuscated), ("stretched", stretched), ("upper", upper), ("letters", letters))}
    # Lexicon words with a second person within NEAR words of the same text.
    hit = np.flatnonzero(((fixed > 0) | (learned > 0) | (stem > 0) | (hidden > 0))[words.codes])
    speaks = np.flatnonzero(second[words.codes] > 0)
    near = np.zeros(words.n)
    if len(hit) and len(speaks):
        after = np.searchsorted(speaks, hit)
        for side in (np.clip(after - 1, 0, len(speaks) - 1), np.clip(after, 0, len(speaks) - 1)):
            close = (np.abs(speaks[side] - hit) <= NEAR) & (words.doc[speaks[side]] == words.doc[hit])
            near += np.bincount(words.doc[hit[close]], minlength=words.n)
    count = words.per_doc()
    many, written = np.maximum(count, 1), np.maximum(total["letters"], 1)
    return np.column_stack([
        total["fixed"], total["fixed"] / many, total["learned"], total["learned"] / many, highest(learned), total["stem"],
        total["stem"] / many, highest(stem), total["hidden"], total["second"] / many, near, total["upper"] / written,
        total["capital"] / many, words.per_doc(matches("!")) / many, words.per_doc(matches(r"\?")) / many,
        words.per_doc(matches(r"[!?]{2,}|\.{2,}")) / many, total["obfuscated"] / many, total["stretched"] / many,
        np.log1p(count),
    ])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: FlatTrees
    at: np.ndarray
    level: np.ndarray
    options: ToxicityOptions

    def score(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probability of label 1: trees, then the rising step values."""
        raw = self.trees.raw(features(texts, self.lexicon))
        return np.clip(np.interp(raw, self.at, self.level), 0.0, 1.0) if len(self.at) else 1 / (1 + np.exp(-raw))


def learn_lexicon(sample: DataFrame, options: ToxicityOptions) -> Lexicon:
    """Units of the learned lexicon and their log-odds, from counts of documents per unit and label.

    Tasks count per batch and Spark adds up; only the chosen units, at most ``max_units``, come to the driver.
    """
    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            toxic, all_docs = Counter(), Counter()
            for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist()):
                seen = {u for w in set(map(bare, (text or "").split())) if w for u in units(w)}
                all_docs.update(seen)
                if y:
                    toxic.update(seen)
            yield pa.RecordBatch.from_pydict({
                "unit": list(all_docs), "n": list(all_docs.values()), "toxic": [toxic[u] for u in all_docs]
            })

    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    if not 0 < size["t"] < size["n"]:
        return Lexicon({})
    share = size["t"] / size["n"]

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    n, t = F.col("n"), F.col("toxic")
    chosen = (
        sample.mapInArrow(counted, "unit string, n long, toxic long").groupBy("unit")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .where((t >= 2) & (2 * t >= n))
        .withColumn("evidence", 2 * (part(t, n * share) + part(n - t, n * (1 - share))))
        .where(F.col("evidence") >= options.min_evidence)
        .orderBy(F.desc("evidence"), "unit").limit(options.max_units).collect()
    )
    prior = math.log(share / (1 - share))
    return Lexicon({r["unit"]: math.log((r["toxic"] + 0.5) / (r["n"] - r["toxic"] + 0.5)) - prior for r in chosen})


def fit_toxicity(documents: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> ToxicityModel:
    """Model of ``labels.toxic``, from at most ``options.fit_rows`` labelled documents.

    Half of them (by hash of the id) teach the learned lexicon, the other half the trees; log-odds of documents left
    out in turn are the ones that calibration is fitted on.  Without labels or with one class the score is constant.
    """
    sample = labelled_texts(documents, labels, "toxic", options.fit_rows)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    lexicon = learn_lexicon(sample.where(half == 0), options)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            x = features(b["text"], lexicon)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], pa.array(list(x))], ["doc_id", "y", "x"])

    got = sample.where(half == 1).mapInArrow(rows, "doc_id long, y int, x array<double>").orderBy("doc_id", "x").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = got["y"].to_numpy().astype(float)
    trees = options.boosting.fit(x, y)
    at, level = isotonic(out_of_fold(options.boosting, x, y, options.folds), y) if 0 < y.sum() < len(y) else (np.zeros(0),) * 2
    return ToxicityModel(lexicon, trees, at, level, options)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the documents that may teach: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(crc_fold("doc_id", 3) != 1)


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score, predicted.

    Null and empty texts are scored as texts without words; repeated rows get equal scores; a null id is not held
    out; an empty table gives no rows; further columns, whatever their names, are not read.
    """
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            score = model.score(b["text"])
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= model.options.threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    named = documents.select(
        F.col("doc_id").cast("long"), F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("text").cast("string"),
    )
    return named.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``documents``, with all their columns, that are not predicted toxic."""
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts) < model.options.threshold)

    return documents.where(clean(F.col("text").cast("string")))
