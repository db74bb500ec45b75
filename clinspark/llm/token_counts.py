"""Token counts of sections: whole texts are encoded once, and tokens are attributed by their character spans.

The rule for a token that crosses a border is explicit: ``start`` gives it to the section of its first character,
``majority`` to the one with most of its characters (the earlier of equals), ``fraction`` splits it by characters.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from clinspark.llm.encoding import MEMO_LENGTH, MEMO_WORDS
from clinspark.llm.text import batches, gather, starts_of

RULES = ("start", "majority", "fraction")
# A word with the space before it; white space up to the last character before a word; that character.
CHUNK = regex.compile(r" ?\P{White_Space}+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}")
Sections = Callable[[str], tuple[np.ndarray, np.ndarray]]


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines of a text, each with its line feed; an empty text is one empty line."""
    cuts, at = [0], text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] < len(text) or len(cuts) == 1:
        cuts.append(len(text))
    return np.array(cuts[:-1], dtype=np.int64), np.array(cuts[1:], dtype=np.int64)


@dataclass(frozen=True)
class Attribution:
    """Tokenizer file (byte-level, so that text is encoded alike from each word on), rule, and how texts are cut.

    ``sections`` returns the spans of a text in ascending order, without overlaps; gaps are allowed.
    """

    tokenizer: str
    rule: str = "start"
    sections: Sections = lines

    def __post_init__(self):
        if self.rule not in RULES:
            raise ValueError(f"rule is one of {', '.join(RULES)}")


class SpanEncoder:
    """Character spans of the tokens of whole texts; each distinct word goes to the library once per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.memo: dict[str, bytes] = {}

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, number of tokens per text), places counted in characters of the text."""
        code: dict[str, int] = {}
        codes, counts = [], []
        for text in texts:
            chunks = CHUNK.findall(text)
            counts.append(len(chunks))
            codes.extend([code.setdefault(c, len(code)) for c in chunks])
        words = list(code)
        flat = [np.frombuffer(s, "<i4") for s in self.look_up(words)]
        n_tokens = np.array([len(s) // 2 for s in flat], dtype=np.int64)
        both = (np.concatenate(flat) if flat else np.zeros(0, "<i4")).reshape(-1, 2)
        codes, counts = np.array(codes, dtype=np.int64), np.array(counts, dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        size = np.array([len(w) for w in words], dtype=np.int64)
        place = starts_of(size[codes])[:-1]
        place = place - place[np.minimum(starts_of(counts)[:-1], max(len(place) - 1, 0))][owner] if len(place) else place
        each = n_tokens[codes]
        found = both[gather(starts_of(n_tokens)[:-1][codes], each)] + np.repeat(place, each)[:, None]
        return found[:, 0], found[:, 1], np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)

    def look_up(self, words: list[str]) -> list[bytes]:
        memo = self.memo
        missing = [w for w in words if w not in memo]
        if len(memo) + len(missing) > MEMO_WORDS:
            memo.clear()
            missing = words
        fresh = {}
        for i in range(0, len(missing), 1024):
            block = missing[i:i + 1024]
            for w, e in zip(block, self.tokenizer.encode_batch(block, add_special_tokens=False)):
                fresh[w] = np.array(e.offsets, dtype="<i4").tobytes()
        memo.update((w, s) for w, s in fresh.items() if len(w) <= MEMO_LENGTH)
        return [fresh[w] if w in fresh else memo[w] for w in words]


@lru_cache(maxsize=2)
def span_encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)


def attribute(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, from token spans and section spans in ascending order (an interval join by search).

    Characters between sections belong to none; under ``majority`` a token with more than half of its characters there
    counts for none.
    """
    out = np.zeros(len(low))
    if not len(low) or not len(start):
        return out
    first = np.searchsorted(high, start, side="right")
    if rule == "start":
        at = np.searchsorted(low, start, side="right") - 1
        inside = (at >= 0) & (start < high[at])
        return np.bincount(at[inside], minlength=len(low)).astype(float)
    last = np.maximum(np.searchsorted(low, end, side="left"), first)
    token = np.repeat(np.arange(len(start)), last - first)
    section = gather(first, last - first)
    shared = np.minimum(end[token], high[section]) - np.maximum(start[token], low[section])
    token, section, shared = token[shared > 0], section[shared > 0], shared[shared > 0]
    if rule == "fraction":
        np.add.at(out, section, shared / np.maximum(end - start, 1)[token])
        return out
    order = np.lexsort((section, -shared, token))
    best = order[np.unique(token[order], return_index=True)[1]]
    most = 2 * np.bincount(token, weights=shared, minlength=len(start))[token[best]] >= (end - start)[token[best]]
    return np.bincount(section[best[most]], minlength=len(low)).astype(float)


def count_section_tokens(documents: DataFrame, options: Attribution) -> DataFrame:
    """One row per section of each row of ``documents``: doc_id, section, char_start, char_end, n_tokens, doc_tokens.

    ``n_tokens`` is whole but under the rule ``fraction``.  Null texts count as empty; an empty text has one empty line
    and no tokens; repeated rows are counted alike; an empty table gives no rows; further columns, whatever
    their names, are not read.
    """
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = span_encoder(options.tokenizer)
        for b in batches(parts):
            texts = [t or "" for t in b["text"].to_pylist()]
            start, end, count = encoder.spans(texts)
            at = starts_of(count)
            doc, nth, lows, highs, tokens = [], [], [], [], []
            for k, text in enumerate(texts):
                low, high = options.sections(text)
                own = slice(at[k], at[k + 1])
                tokens.append(attribute(start[own], end[own], low, high, options.rule))
                doc.append(np.full(len(low), k))
                nth.append(np.arange(len(low)))
                lows.append(low)
                highs.append(high)
            doc = np.concatenate(doc)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(pa.array(doc)), *(pa.array(np.concatenate(x)) for x in (nth, lows, highs, tokens)),
                 pa.array(count[doc])],
                ["doc_id", "section", "char_start", "char_end", "n_tokens", "doc_tokens"],
            )

    named = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, section long, char_start long, char_end long, n_tokens double, doc_tokens long"
    return named.mapInArrow(rows, schema)
