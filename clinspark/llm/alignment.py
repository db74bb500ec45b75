"""Alignment of two tokenizers: which ids cover the same bytes, counted over the corpus by minimal perfect hashing.

Texts are cut before spaces that follow no white space.  No token of either tokenizer crosses such a cut, so a text's
alignment is that of its distinct pieces, which a worker remembers.  The first pass counts id pairs.  The distinct pairs are
dealt into shards by hash; each shard has a minimal perfect hash (buckets, each with a seed that sends its keys to free
places), a key at every place to verify look-ups, and dense count vectors that are summed up a tree.  The second pass aligns
the texts again and looks counts up in files of the shared folder, of which a worker holds a bounded part.
"""

from __future__ import annotations

import itertools
import os
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from clinspark.llm.bpe import byte_letters
from clinspark.llm.files import new_file, open_file, run_folder
from clinspark.llm.text import batches, starts_of
from clinspark.session import stage_table

SHARD_KEYS = 32_768  # pairs of a shard, about
LEAVES, FAN = 16, 4  # count vectors of a shard before they are summed, and how many each step of the tree sums
HELD_BYTES = 128_000_000  # shards that a worker holds for look-ups
MEMO_PIECES, MEMO_LENGTH = 300_000, 64  # pieces that a worker remembers, and their longest
KEYS_A_BUCKET = 3
TOGETHER = 2048  # pieces that are encoded as one text

MIX_1, MIX_2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


# --- minimal perfect hashing ---------------------------------------------------------------------


@dataclass(frozen=True)
class PerfectHash:
    """``seeds`` of the buckets; a negative one names the only place of its bucket.  ``keys`` are the keys at each place."""

    seeds: np.ndarray
    keys: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct 64-bit keys: the largest buckets first, each tries seeds until all of its keys find free places."""
        n = len(keys)
        codes = mix(keys.astype(np.uint64))
        buckets = max(1, n // KEYS_A_BUCKET)
        bucket = (codes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        at = starts_of(sizes)
        seeds, taken = np.zeros(buckets, dtype=np.int64), np.zeros(n, dtype=bool)
        placed = np.zeros(n, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            own = order[at[b]:at[b + 1]]
            first, tried = 0, 16
            while True:
                tries = np.arange(first, first + tried, dtype=np.uint64)
                places = (mix(codes[own][None, :] + tries[:, None] * STEP) % np.uint64(n)).astype(np.int64)
                ranked = np.sort(places, axis=1)
                free = ~taken[places].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if free.any():
                    hit = int(free.argmax())
                    break
                first, tried = first + tried, min(4096, 2 * tried)
            seeds[b] = first + hit
            taken[places[hit]] = True
            placed[places[hit]] = keys[own].astype(np.uint64)
        alone = np.flatnonzero(sizes == 1)
        rest = np.flatnonzero(~taken)
        seeds[alone] = -1 - rest
        placed[rest] = keys[order[at[alone]]].astype(np.uint64)
        return cls(seeds, placed)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for a key that was not built in."""
        keys = keys.astype(np.uint64)
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        codes = mix(keys)
        seed = self.seeds[(codes % np.uint64(len(self.seeds))).astype(np.int64)]
        spread = (mix(codes + np.maximum(seed, 0).astype(np.uint64) * STEP) % np.uint64(len(self.keys))).astype(np.int64)
        place = np.where(seed < 0, -1 - seed, spread)
        return np.where(self.keys[place] == keys, place, -1)


# --- aligned pieces ------------------------------------------------------------------------------


# The alignment of one piece: numbers of tokens of A, of B and of groups, the pair of each link as 64-bit numbers, groups as
# text.  A plain tuple, since Python's garbage collector visits remembered named tuples again and again.
Piece = tuple[int, int, int, bytes, str]

NOTHING: Piece = (0, 0, 0, b"", "")


class Aligner:
    """Ids of a byte-level tokenizers file (A) and of a sentencepiece model (B) over ``space + text``."""

    def __init__(self, byte_path: str, piece_path: str, named: bool):
        """``named`` gives the groups as text, which only the second pass needs."""
        self.named = named
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings are ordinary text
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_a = {
            i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)
        }
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(names)
        ]
        # A vocabulary with a space inside a piece could join words, so its texts are not cut.
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)
        self.size_a = np.zeros(max(self.bytes_a) + 1, dtype=np.int64)
        self.size_a[list(self.bytes_a)] = [len(v) for v in self.bytes_a.values()]
        self.list_a = [self.bytes_a.get(i, b"") for i in range(len(self.size_a))]
        self.size_b = np.array([len(v) for v in self.bytes_b], dtype=np.int64)
        # An id as text, with what follows it inside a group and at the end of its side of one.
        self.named_a = [np.array([f"{i}{end}" for i in range(len(self.size_a))], dtype=object) for end in ",|"]
        self.named_b = [np.array([f"{i}{end}" for i in range(len(names))], dtype=object) for end in ",;"]
        self.memo: dict[bytes, Piece | None] = {}

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both sides of many pieces, encoded as one text; None unless ids give the bytes of all pieces back.

        Only for pieces that end in no white space: the cut before the next one then is one between any two of them.
        """
        whole = b"".join(words)
        text = whole.decode("utf-8")
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets
        b = self.b.encode(text[1:])  # the model puts the space before
        if b"".join(map(self.list_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        ids = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        cuts = np.cumsum([len(w) for w in words])
        if all(np.isin(cuts, np.cumsum(size[x])).all() for x, size in zip(ids, (self.size_a, self.size_b))):
            return ids
        return None

    def one_by_one(self, words: list[bytes]) -> dict[bytes, Piece | None]:
        texts = [w.decode("utf-8") for w in words]
        coded_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        coded_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        found: dict[bytes, Piece | None] = {}
        for w, a, b in zip(words, coded_a, coded_b):
            same = b"".join([self.bytes_a.get(i, b"") for i in a]) == w == b"".join([self.bytes_b[i] for i in b])
            found[w] = self.aligned([w], np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))[0] if same else None
        return found

    def aligned(self, words: list[bytes], ids_a: np.ndarray, ids_b: np.ndarray) -> list[Piece]:
        """Of many pieces at once, whose ids give their bytes back.

        The places where tokens end, counted through all pieces, are the ends of links; those of both sides end groups.
        """
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        word_end = np.cumsum([len(w) for w in words])
        in_a, in_b = np.zeros((2, int(word_end[-1]) + 1), dtype=bool)
        in_a[end_a] = in_b[end_b] = True
        in_both = in_a & in_b
        upto_a, upto_b, upto_both = np.cumsum(in_a), np.cumsum(in_b), np.cumsum(in_both)
        n_a, n_b, n_groups = (np.diff(upto[word_end], prepend=0) for upto in (upto_a, upto_b, upto_both))
        # The tokens that end a link or first thereafter are the ones it is between.
        ends = np.flatnonzero(in_a | in_b)
        linked = (ids_a[upto_a[ends] - in_a[ends]] << 32) | ids_b[upto_b[ends] - in_b[ends]]
        raw, links = linked.astype("<i8").tobytes(), np.searchsorted(ends, word_end, side="right")
        at, link_at = starts_of(n_a + n_b).tolist(), [0, *links.tolist()]
        numbers = zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), link_at, link_at[1:], at, at[1:])
        if not self.named:
            return [(x, y, g, raw[8 * i:8 * j], "") for x, y, g, i, j, _, _ in numbers]
        # Ids as text in the order of groups, in each those of A before those of B.
        texts = np.concatenate([
            np.where(in_both[end], named[1][ids], named[0][ids])
            for ids, end, named in ((ids_a, end_a, self.named_a), (ids_b, end_b, self.named_b))])
        place = np.concatenate([2 * (upto_both - in_both)[end_a], 2 * (upto_both - in_both)[end_b] + 1])
        texts = texts[np.argsort(place, kind="stable")].tolist()
        return [(x, y, g, raw[8 * i:8 * j], "".join(texts[k:m])[:-1]) for x, y, g, i, j, k, m in numbers]

    def pieces(self, raw: list[bytes]) -> list[Piece | None]:
        """The alignment of each distinct piece, which begins with a space; None if ids don't give its bytes back."""
        missing = [w for w in raw if w not in self.memo]
        fresh: dict[bytes, Piece | None] = {}
        for i in range(0, len(missing), TOGETHER):
            block = missing[i:i + TOGETHER]
            open_ = _ends_white_space(np.frombuffer(b"".join(block), np.uint8))[np.cumsum([len(w) for w in block]) - 1].tolist()
            closed = [w for w, o in zip(block, open_) if not o]
            if closed and (ids := self.together(closed)) is not None:
                fresh.update(zip(closed, self.aligned(closed, *ids)))
            rest = [w for w in block if w not in fresh]
            if rest:
                fresh.update(self.one_by_one(rest))
        # The pieces seen first stay: frequent ones are among them, and a batch may hold more than there is room for.
        if (room := MEMO_PIECES - len(self.memo)) > 0:
            self.memo.update(itertools.islice(((w, p) for w, p in fresh.items() if len(w) <= MEMO_LENGTH), room))
        return [fresh[w] if w in fresh else self.memo[w] for w in raw]

    def split(self, texts: pa.Array) -> tuple[list[Piece | None], np.ndarray, np.ndarray]:
        """(distinct pieces, the code of each piece in order, where each text's begin); a null or empty text has none."""
        raw = [b"" if not t else b" " + t for t in texts.cast(pa.binary()).to_pylist()]
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = starts_of(np.fromiter(map(len, raw), np.int64, len(raw)))
        begins = np.zeros(len(data), dtype=bool)
        if self.cuts and len(data):
            begins[1:] = (data[1:] == 0x20) & ~_ends_white_space(data)[:-1]
        filled = np.diff(at) > 0
        begins[at[1:][filled] - 1] = False  # a last space alone would reach the model as an empty text
        begins[at[:-1][filled]] = True
        first = np.flatnonzero(begins)
        offsets = pa.py_buffer(np.append(first, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        return self.pieces(coded.dictionary.to_pylist()), codes, np.searchsorted(first, at)


def _ends_white_space(data: np.ndarray) -> np.ndarray:
    """Where the last byte of a white-space character stands (the separators 1C to 1F are counted among them)."""
    out = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1F))
    if len(data) > 1:
        out[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    if len(data) > 2:
        x, y, z = data[:-2], data[1:-1], data[2:]
        spaces = (z >= 0x80) & (z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)
        out[2:] |= (x == 0xE2) & ((y == 0x80) & spaces | (y == 0x81) & (z == 0x9F))
        out[2:] |= (x == 0xE3) & (y == 0x80) & (z == 0x80) | (x == 0xE1) & (y == 0x9A) & (z == 0x80)
    return out


@lru_cache(maxsize=1)  # the second pass needs no pieces of the first
def aligner(byte_path: str, piece_path: str, named: bool) -> Aligner:
    return Aligner(byte_path, piece_path, named)


class _Batch:
    """The pieces of a batch of texts; a text with a piece that ids don't give back has no tokens."""

    def __init__(self, own: Aligner, texts: pa.Array):
        self.pieces, self.codes, self.at = own.split(texts)
        broken = np.array([p is None for p in self.pieces], dtype=bool)
        bad = np.concatenate(([0], np.cumsum(broken[self.codes]))) if len(self.codes) else np.zeros(1, np.int64)
        self.valid = (self.at[1:] > self.at[:-1]) & (bad[self.at[1:]] == bad[self.at[:-1]])
        self.used = np.repeat(self.valid, np.diff(self.at))
        columns = list(zip(*[p or NOTHING for p in self.pieces])) or [()] * len(NOTHING)
        self.n_a, self.n_b, self.n_groups, self.linked, self.texts = columns
        self.n_links = [len(x) // 8 for x in self.linked]

    def per_text(self, value: Sequence[int]) -> np.ndarray:
        """Sums over the pieces of each text of a value per distinct piece, in whole numbers."""
        each = np.array(value, dtype=np.int64)[self.codes] if len(self.codes) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(np.where(self.used, each, 0))))
        return total[self.at[1:]] - total[self.at[:-1]]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, pair, times) of the links of the distinct pieces that texts with tokens hold; ``times`` they occur."""
        times = np.bincount(self.codes[self.used], minlength=len(self.pieces))
        filled = np.flatnonzero(times)
        size = np.array(self.n_links, dtype=np.int64)[filled]
        pairs = np.frombuffer(b"".join([self.linked[k] for k in filled.tolist()]), "<i8")
        return np.repeat(filled, size), pairs, np.repeat(times[filled], size)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs of the batch, their links)."""
        _, linked, times = self.links()
        pairs, where = np.unique(linked, return_inverse=True)
        links = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(links, where.ravel(), times)
        return pairs, links


# --- passes --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Alignment:
    """The two tokenizer files."""

    byte_tokenizer: str
    piece_tokenizer: str


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def counted_pairs(documents: DataFrame, options: Alignment) -> DataFrame:
    """(pair, links) of each batch of texts; ``pair`` is the id of A in the upper and that of B in the lower half."""
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(options.byte_tokenizer, options.piece_tokenizer, False)
        for b in batches(parts):
            pairs, links = _Batch(own, b["text"]).pairs()
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(links)], ["pair", "links"])

    return _named(documents).select("text").mapInArrow(rows, "pair long, links long")


def _table(**columns) -> pa.Table:
    return pa.table(columns)


def _shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard}.parquet"


def _read(folder: str, shard: int) -> dict[str, np.ndarray]:
    with open_file(_shard_path(folder, shard)) as f:
        row = pq.read_table(f).to_pylist()[0]
    return {k: np.frombuffer(v, np.int64) for k, v in row.items()}


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    """Apart from the places inside a shard, which come from the same scrambling without the step."""
    return (mix(pairs.view(np.uint64) + STEP) % np.uint64(shards)).astype(np.int64)


def _sharded(pairs: DataFrame, shards: int) -> DataFrame:
    """The rows (pair, …) with their shard."""
    @F.arrow_udf("int")
    def shard(values: pa.Array) -> pa.Array:
        return pa.array(_shard_of(values.to_numpy(zero_copy_only=False).astype(np.int64), shards).astype(np.int32))

    return pairs.withColumn("shard", shard("pair"))


def write_index(partial: DataFrame, shards: int) -> tuple[DataFrame, str]:
    """The perfect hash of each shard's distinct pairs, as files of a new folder; (shard, keys) of the written ones."""
    folder = run_folder(partial.sparkSession, "pair-index")

    def build(table):
        shard = table["shard"][0].as_py()
        made = PerfectHash.build(table["pair"].to_numpy())
        with new_file(_shard_path(folder, shard)) as out:
            pq.write_table(_table(seeds=[made.seeds.tobytes()], keys=[made.keys.tobytes()]), out)
        return _table(shard=pa.array([shard], pa.int32()), keys=pa.array([len(made.keys)], pa.int64()))

    distinct = _sharded(partial.select("pair").distinct(), shards)
    return stage_table(distinct.groupBy("shard").applyInArrow(build, "shard int, keys long"), "shards"), folder


def dense_counts(partial: DataFrame, shards: int, folder: str) -> DataFrame:
    """(shard, counts): the links of each place of a shard, as vectors of its leaves summed up a tree."""
    def vector(key, table):
        stored = _read(folder, key[0].as_py())
        index = PerfectHash(stored["seeds"], stored["keys"].view(np.uint64))
        counts = np.zeros(len(index.keys), dtype=np.int64)
        place = index.places(table["pair"].to_numpy())
        if (place < 0).any():
            raise ValueError("a pair is missing from the index of its shard")
        np.add.at(counts, place, table["links"].to_numpy())
        return _table(shard=pa.array([key[0].as_py()], pa.int32()), leaf=pa.array([key[1].as_py()], pa.int32()), counts=[counts.tobytes()])

    def summed(key, table):
        total = np.sum([np.frombuffer(c, np.int64) for c in table["counts"].to_pylist()], axis=0, dtype=np.int64)
        return _table(shard=pa.array([key[0].as_py()], pa.int32()), leaf=pa.array([key[1].as_py()], pa.int32()), counts=[total.tobytes()])

    schema = "shard int, leaf int, counts binary"
    # A pair occurs once in each batch of texts, so the rows of a shard are dealt by chance.
    leaf = F.pmod(F.xxhash64("pair", "links", F.monotonically_increasing_id()), F.lit(LEAVES)).cast("int")
    level = _sharded(partial, shards).withColumn("leaf", leaf)
    level = level.groupBy("shard", "leaf").applyInArrow(vector, schema)
    width = LEAVES
    while width > 1:
        width = -(-width // FAN)
        level = level.withColumn("leaf", (F.col("leaf") / FAN).cast("int")).groupBy("shard", "leaf").applyInArrow(summed, schema)
    return level.select("shard", "counts")


def finish_index(counts: DataFrame, folder: str, n_b: int) -> str:
    """Files with keys, seeds, counts and the mark of each B id's highest counts; returns their folder."""
    def highest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            for shard, raw in zip(b["shard"].to_pylist(), b["counts"].to_pylist()):
                ids = _read(folder, shard)["keys"] & 0xFFFFFFFF
                best = np.zeros(n_b, dtype=np.int64)
                np.maximum.at(best, ids, np.frombuffer(raw, np.int64))
                found = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(best[found])], ["id", "best"])

    # One number per entry of the vocabulary of B: that bounds what the driver gets and what it sends.
    per_id = counts.mapInArrow(highest, "id long, best long").groupBy("id").agg(F.max("best").alias("best"))
    best = np.zeros(n_b, dtype=np.int64)
    for row in per_id.collect():
        best[row["id"]] = row["best"]
    spark = counts.sparkSession
    sent, final = spark.sparkContext.broadcast(best), run_folder(spark, "pair-counts")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            for shard, raw in zip(b["shard"].to_pylist(), b["counts"].to_pylist()):
                stored, own = _read(folder, shard), np.frombuffer(raw, np.int64)
                marks = (own == sent.value[stored["keys"] & 0xFFFFFFFF]).astype(np.int64)
                with new_file(_shard_path(final, shard)) as out:
                    pq.write_table(_table(seeds=[stored["seeds"].tobytes()], keys=[stored["keys"].tobytes()],
                                          counts=[raw], marks=[marks.tobytes()]), out)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

    stage_table(counts.mapInArrow(write, "shard int"), "written")
    return final


class _Counts:
    """Look-ups in the shard files; the shards used last are held, up to a number of bytes."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.size = folder, shards, 0
        self.held: OrderedDict[int, dict[str, np.ndarray]] = OrderedDict()

    def shard(self, number: int) -> dict[str, np.ndarray]:
        if number in self.held:
            self.held.move_to_end(number)
            return self.held[number]
        found = _read(self.folder, number)
        self.held[number] = found
        self.size += sum(v.nbytes for v in found.values())
        while self.size > HELD_BYTES and len(self.held) > 1:
            _, gone = self.held.popitem(last=False)
            self.size -= sum(v.nbytes for v in gone.values())
        return found

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the highest of its B id) of distinct pairs."""
        counts, marks = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        shard = _shard_of(pairs, self.shards) if len(pairs) else pairs
        for s in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == s)
            stored = self.shard(s)
            place = PerfectHash(stored["seeds"], stored["keys"].view(np.uint64)).places(pairs[mine])
            if (place < 0).any():
                raise ValueError("a pair is missing from the index of its shard")
            counts[mine], marks[mine] = stored["counts"][place], stored["marks"][place]
        return counts, marks


@lru_cache(maxsize=1)
def _counts(folder: str, shards: int) -> _Counts:
    return _Counts(folder, shards)


def align_tokenizers(documents: DataFrame, options: Alignment) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` lists the ids of the groups as ``a1,a2|b1;a3|b2,b3``.  A text that is null or empty, or that a tokenizer
    does not give back byte by byte, has no tokens: zeros and an empty text.  Repeated rows count each time; an empty table
    gives no rows; further columns, whatever their names, are not read.
    """
    partial = stage_table(counted_pairs(documents, options), "pairs")
    distinct = partial.select("pair").distinct().count()
    shards = max(1, -(-distinct // SHARD_KEYS))
    _, folder = write_index(partial, shards)
    counts = stage_table(dense_counts(partial, shards, folder), "pair-counts")
    final = finish_index(counts, folder, len(aligner(options.byte_tokenizer, options.piece_tokenizer, False).bytes_b))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = aligner(options.byte_tokenizer, options.piece_tokenizer, True), _counts(final, shards)
        for b in batches(parts):
            held = _Batch(own, b["text"])
            piece, linked, _ = held.links()
            pairs, where = np.unique(linked, return_inverse=True)
            count, mark = known.look_up(pairs)
            # What the index says of the links of each piece.
            sums, best = np.zeros((2, len(held.pieces)), np.int64)
            np.add.at(sums, piece, count[where.ravel()])
            np.add.at(best, piece, mark[where.ravel()])
            numbers = [held.per_text(x) for x in (held.n_a, held.n_b, held.n_groups, held.n_links, best, sums)]
            names = np.array(held.texts, dtype=object)
            texts = [";".join(names[held.codes[i:j]]) if good else ""
                     for i, j, good in zip(held.at[:-1].tolist(), held.at[1:].tolist(), held.valid.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *(pa.array(x) for x in numbers), pa.array(texts, pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return _named(documents).mapInArrow(rows, schema)
