"""Byte-pair encoding of words that drop white space, by segment trees over the ranks of adjacent pairs, and decoding.

A word is a row of symbols.  The leaves of its tree hold the merge rank of each symbol with its right neighbour, inner
nodes the minimum of their children, so the root is the lowest rank and the way down, left first, its leftmost place.
A merge changes three leaves, which takes three walks to the root.  All distinct words of a batch with trees of the same
size advance together in arrays, one merge per word and step, until no root holds a rank.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from clinspark.llm.encoding import DistinctEncoder
from clinspark.llm.text import batches, binary_slices, starts_of

NONE = np.int64(2**31 - 1)
TREE_CELLS = 4_000_000  # cells of the trees that are held at once, but for one longer word
WHITE = r"\p{White_Space}"


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class MergeEncoder(DistinctEncoder):
    """A vocabulary file with merges, an end-of-word suffix, and a pattern of pre-tokens over lower-cased NFC text."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocabulary.items()} | {a["id"]: a["content"] for a in file["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in file["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pieces = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pieces.replace(r"\s", WHITE))
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocabulary[c + end] for c in letters], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs, self.rank_of = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where there is no merge or no right neighbour (-1)."""
        key = (left << 32) | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((right >= 0) & (left >= 0) & (self.pairs[at] == key), self.rank_of[at], NONE)

    def pre_tokens(self, word: str) -> list[str | int]:
        """Pre-tokens of raw text; a special token is its id."""
        out: list[str | int] = []
        for part in self.special_pattern.split(word):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # Lower-casing letter by letter: the final sigma has no form of its own.
                plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out.extend(m[0] for m in self.pattern.finditer(plain.lower()))
        return out

    def encode_distinct(self, words: list[str]) -> dict[str, bytes]:
        split = [self.pre_tokens(w) for w in words]
        distinct = list({p for parts in split for p in parts if isinstance(p, str)})
        known = dict(zip(distinct, self.merge([p.encode("utf-8") for p in distinct])))
        return {w: b"".join(known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in parts)
                for w, parts in zip(words, split)}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (its bytes), as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        size = np.maximum(1, 2 ** np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for leaves in np.unique(size).tolist():
            same = np.flatnonzero(size == leaves)
            step = max(1, TREE_CELLS // (2 * leaves))
            for i in range(0, len(same), step):
                rows = same[i:i + step]
                found, at = self._merge_rows([words[r] for r in rows], lengths[rows], leaves)
                raw, at = found.astype("<u4").tobytes(), (4 * at).tolist()
                for r, a, b in zip(rows.tolist(), at, at[1:]):
                    out[r] = raw[a:b]
        return out

    def _merge_rows(self, words: list[bytes], lengths: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        ids = np.full((n, leaves), -1, dtype=np.int64)
        inside = np.arange(leaves) < lengths[:, None]
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids[inside] = self.inner[raw]
        ids[np.arange(n), lengths - 1] = self.last[raw[np.cumsum(lengths) - 1]]
        after = np.where(np.arange(1, leaves + 1) < lengths[:, None], np.arange(1, leaves + 1), -1)
        before = np.tile(np.arange(-1, leaves - 1), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
        if leaves > 1:
            tree[:, leaves:-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        level = leaves // 2
        while level:
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < NONE)

        def update(r: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
            node = leaves + place
            tree[r, node] = rank
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        while len(row):
            rank, node = tree[row, 1], np.ones(len(row), dtype=np.int64)
            for _ in range(leaves.bit_length() - 1):
                node = 2 * node + (tree[row, 2 * node] != rank)
            i = node - leaves
            j = after[row, i]
            k, h = after[row, j], before[row, i]
            ids[row, i] = self.merged[rank]
            ids[row, j] = -1
            after[row, i] = k
            tied = k >= 0
            before[row[tied], k[tied]] = i[tied]
            update(row, j, np.full(len(row), NONE))
            update(row, i, self.ranks(ids[row, i], np.where(tied, ids[row, np.maximum(k, 0)], -1)))
            led = np.flatnonzero(h >= 0)
            if len(led):
                r, left = row[led], h[led]
                update(r, left, self.ranks(ids[r, left], ids[r, i[led]]))
            row = row[tree[row, 1] < NONE]
        return ids[ids >= 0], starts_of((ids >= 0).sum(axis=1))

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with a space between; ids without a token are left out."""
        return " ".join([t for i in ids.tolist() if (t := self.tokens.get(i)) is not None])


@lru_cache(maxsize=2)
def merge_encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row of ``documents``; ids are little-endian unsigned 32-bit numbers.

    Null and empty texts have no ids; repeated rows are encoded alike; an empty table gives no rows; further columns,
    whatever their names, are not read.
    """
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(path)
        for b in batches(parts):
            ids, counts = encoder.encode(b["text"])
            slices = binary_slices(ids, starts_of(counts)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(counts), slices], ["doc_id", "n_tokens", "ids"])

    named = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(rows, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with the decoded text beside the ids; no ids give an empty text."""
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(path)
        for b in batches(parts):
            texts = [encoder.decode(np.frombuffer(raw or b"", "<u4")) for raw in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_tokens"], b["ids"], pa.array(texts, pa.string())],
                                             ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.mapInArrow(rows, "doc_id long, n_tokens long, ids binary, decoded string")
