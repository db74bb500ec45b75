"""Cross-tokenizer alignment against whole-text encoding and loops."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clinspark.llm import alignment
from clinspark.llm.alignment import Alignment, PerfectHash, align_tokenizers
from clinspark.llm.bpe import byte_letters
from clinspark.llm.text import table

from .conftest import ODD

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [
    (20, "a\n  b \t c  d  e　f  "), (21, "  lead  and  trail  "), (22, "▁odd ▁ mark"), (23, "café naïve déjà vu là"),
    (24, "x \x1c y \x85 z\x00w"), (25, "<s> </s> <unk> <0x0A> <|endoftext|>"), (26, "emoji 👩‍👩‍👧 ﬁ ① ½"), (27, "don't can't we'll I'm"),
    (28, "\n\n\n"), (29, " "), (30, "tab\tsep\tvalue 12345 67,890.12"),
]


def brute(rows):
    """What the contract asks, from whole texts and one token at a time."""
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(byte_letters())}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc, text in rows:
        links, groups, spans = [], [], [[], []]
        if text:
            whole = (" " + text).encode()
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            parts = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes_b(i) for i in ids[1]]]
            if all(b"".join(p) == whole for p in parts):
                for side in (0, 1):
                    at = 0
                    for i, raw in zip(ids[side], parts[side]):
                        spans[side].append((at, at + len(raw), i))
                        at += len(raw)
                first = 0
                for x, y, i in spans[0]:
                    while spans[1][first][1] <= x:
                        first += 1
                    k = first
                    while k < len(spans[1]) and spans[1][k][0] < y:
                        links.append((i, spans[1][k][2]))
                        k += 1
                cuts = sorted({y for _, y, _ in spans[0]} & {y for _, y, _ in spans[1]})
                low = 0
                for cut in cuts:
                    groups.append("|".join(",".join(str(i) for x, y, i in s if low <= x and y <= cut) for s in spans) if len(text) < 3000 else None)
                    low = cut
        counts.update(links)
        found.append((doc, len(spans[0]), len(spans[1]), links, groups))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter(
        (doc, x, y, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
         None if None in groups else ";".join(groups))
        for doc, x, y, links, groups in found)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(alignment, "SHARD_KEYS", 40)


def test_matches_whole_texts(llm, odd, small_shards):
    rows = ODD + MORE
    more = llm.createDataFrame([(i, t, None, None, None, 0.5, "x") for i, t in MORE], odd.schema)
    have = align_tokenizers(odd.unionByName(more), Alignment(BYTE, PIECE)).collect()
    want = brute(rows)
    long_ = {i for i, t in rows if t and len(t) >= 3000}
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert Counter(tuple(None if c == "groups" and r["doc_id"] in long_ else r[c] for c in columns) for r in have) == want


def test_given_documents(llm, small_dir):
    documents = table(llm, small_dir, "documents").where("length(text) < 3000")
    have = Counter(tuple(r) for r in align_tokenizers(documents, Alignment(BYTE, PIECE)).collect())
    assert have == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_empty_table(llm, empty):
    assert align_tokenizers(empty, Alignment(BYTE, PIECE)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(2**60, n, replace=False).astype(np.int64)
    made = PerfectHash.build(keys)
    assert sorted(made.places(keys).tolist()) == list(range(n))
    assert (made.places(keys + 1) >= 0).sum() == np.isin(keys + 1, keys).sum()


def test_look_ups_hold_a_bounded_part(llm, odd, small_shards, monkeypatch):
    whole = Counter(tuple(r) for r in align_tokenizers(odd, Alignment(BYTE, PIECE)).collect())
    monkeypatch.setattr(alignment, "HELD_BYTES", 1)
    assert Counter(tuple(r) for r in align_tokenizers(odd, Alignment(BYTE, PIECE)).collect()) == whole
