"""Token ids from a tokenizers file, with each distinct word encoded once per worker.

For vocabularies that drop white space and never merge across it (their pre-tokenizer works on runs without white
space), the ids of a text are the ids of its words in order.  Real text repeats its words, so a batch is reduced to
distinct words first; the library encodes those, many in one call.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clinspark.llm.text import gather, split_words, starts_of

MEMO_WORDS = 300_000  # words a worker remembers; the memory is emptied beyond that
MEMO_LENGTH = 64  # longer words are encoded anew each time
JOINED = 512  # words that go to the library in one text


class DistinctEncoder:
    """Texts to ids by distinct words; ``encode_distinct`` of a subclass gives the ids of words as bytes."""

    def __init__(self) -> None:
        self.memo: dict[str, bytes] = {}

    def encode_distinct(self, words: list[str]) -> dict[str, bytes]:
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text; a null text has none."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        # Lower-casing here only saves distinct words; it would make new special tokens where "<|" occurs.
        if not pc.any(pc.match_substring(texts, "<|"), min_count=0).as_py():
            texts = pc.ascii_lower(texts)
        # A letter and the punctuation that closes its word are never one token.
        words = split_words(pc.replace_substring_regex(texts, r"([a-z])([.,]|!!)([ \n])", r"\1 \2\3"))
        known = self.look_up(words.vocabulary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        each = lengths[words.codes]
        ids = flat[gather(starts_of(lengths)[:-1][words.codes], each)]
        return ids, np.bincount(words.doc, weights=each, minlength=words.n).astype(np.int64)

    def look_up(self, words: list[str]) -> list[bytes]:
        memo = self.memo
        missing = [w for w in words if w not in memo]
        if len(memo) + len(missing) > MEMO_WORDS:
            memo.clear()
            missing = words
        fresh = self.encode_distinct(missing)
        memo.update((w, b) for w, b in fresh.items() if len(w) <= MEMO_LENGTH)
        return [fresh[w] if w in fresh else memo[w] for w in words]


class WordEncoder(DistinctEncoder):
    """The words go to the tokenizers library."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode_distinct(self, words: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        if not words:
            return found
        # Words of plain letters are one pre-token each, so many can be encoded as one text and cut after each end of word.
        plain = pc.match_substring_regex(pa.array(words), r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$").to_pylist()
        simple = [w for w, p in zip(words, plain) if p]
        for i in range(0, len(simple), JOINED):
            block = simple[i:i + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(block) or cuts[-1] != len(ids):
                plain_block = self.tokenizer.encode_batch_fast(block, add_special_tokens=False)
                found.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(block, plain_block))
                continue
            raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
            found.update((w, raw[a:b]) for w, a, b in zip(block, at, at[1:]))
        rest = [w for w, p in zip(words, plain) if not p]
        for i in range(0, len(rest), JOINED):
            block = rest[i:i + JOINED]
            for w, e in zip(block, self.tokenizer.encode_batch_fast(block, add_special_tokens=False)):
                found[w] = np.array(e.ids, dtype="<u4").tobytes()
        return found


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file; kept between tasks, so its memory of words is too."""
    return WordEncoder(path)
