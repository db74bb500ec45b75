"""Near-duplicates of whole texts: a Hamming join of b-bit MinHash signatures through several indexes, then exact sets.

A signature has 64 symbols of 16 bits.  It is split into 14 chunks; if two signatures differ in at most 27 symbols, then
some chunk differs in at most one (14 chunks with two errors each would be 28).  So each chunk gives one key per symbol
left out, 64 keys in all, and every pair within the distance shares a key.  A pair at the linking similarity of 0.8
differs in 12.8 symbols on average, with a deviation of 3.2; the chance that it differs in more than 27 is 1.4e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clinspark.llm.components import connected_components
from clinspark.llm.text import batches, split_words, starts_of
from clinspark.session import stage_table

SYMBOLS = 64
MIX_1, MIX_2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240229)
FACTORS = _SEEDS.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _SEEDS.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
# Bits of the map of a set: eight for each shingle, between these bounds.
FEWEST_BITS, MOST_BITS = 1024, 32768


@dataclass(frozen=True)
class NearDuplicates:
    """``words`` of a shingle, linking similarity in percent, signature distance allowed.

    The number of chunks follows from the distance: the smallest whose single-error keys cover it.
    """

    words: int = 5
    percent: int = 80
    distance: int = 27

    @property
    def chunks(self) -> list[np.ndarray]:
        return np.array_split(np.arange(SYMBOLS), self.distance // 2 + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in one array, and where each text's begin.

    A-Z are lower-cased; a text with fewer words than ``size`` has its whole sequence as one shingle; a null text, or
    one without words, has none.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    words = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    names = np.array(words.vocabulary.to_pylist(), dtype=object)
    code = pd.util.hash_array(names, categorize=False)[words.codes] if len(names) else np.zeros(0, np.uint64)
    counts = words.per_doc()
    at = starts_of(counts)

    def rolled(start: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(start), np.uint64(length))
        for k in range(length):
            h = mix(h * STEP + code[start + k])
        return h

    windows = np.maximum(counts - size + 1, np.minimum(counts, 1))
    first = starts_of(windows)
    full = np.flatnonzero(words.doc[: max(len(code) - size + 1, 0)] == words.doc[size - 1:]) if len(code) >= size else np.zeros(0, np.int64)
    out = np.zeros(first[-1], dtype=np.uint64)
    out[first[words.doc[full]] + full - at[words.doc[full]]] = rolled(full, size)
    for length in range(1, size):
        short = np.flatnonzero(counts == length)
        out[first[short]] = rolled(at[short], length)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out[a:b].sort()
    owner = np.repeat(np.arange(words.n), windows)
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], starts_of(np.bincount(owner[fresh], minlength=words.n))


def set_names(sets: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """A digest of each set, the name of its class; null for an empty set."""
    raw, at = memoryview(sets.tobytes()), (starts * 8).tolist()
    return [hashlib.blake2b(raw[x:y], digest_size=16).digest() if y > x else None for x, y in zip(at, at[1:])]


def signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of 64 symbols for each set that is not empty."""
    filled = starts[:-1][np.diff(starts) > 0]
    symbols = np.zeros((len(filled), SYMBOLS), dtype="<u2")
    if len(filled):
        for i in range(SYMBOLS):
            lowest = np.minimum.reduceat(sets * FACTORS[i] + SHIFTS[i], filled)
            symbols[:, i] = (mix(lowest) & np.uint64(0xFFFF)).astype(np.uint16)
    return symbols


def index_keys(symbols: np.ndarray, chunks: list[np.ndarray]) -> np.ndarray:
    """The keys of each signature: every chunk with each of its symbols left out in turn.

    The lowest six bits of a key are the place of the symbol left out.
    """
    keys = []
    for c, chunk in enumerate(chunks):
        for gone in chunk:
            h = np.full(len(symbols), np.uint64(c * SYMBOLS + gone))
            for i in chunk[chunk != gone]:
                h = mix(h * STEP + symbols[:, i].astype(np.uint64))
            keys.append((h & ~np.uint64(SYMBOLS - 1)) | np.uint64(gone))
    return np.stack(keys, axis=1).view(np.int64)


def sketches(symbols: np.ndarray) -> np.ndarray:
    """Two bits of each symbol, in two 64-bit values: they differ in no more places than the symbols do."""
    low = (symbols & 3).astype(np.uint64)
    shift = (2 * np.arange(SYMBOLS // 2)).astype(np.uint64)
    half = SYMBOLS // 2
    return np.stack([(low[:, :half] << shift).sum(axis=1), (low[:, half:] << shift).sum(axis=1)], axis=1).view(np.int64)


def _sketch_distance(a: str, b: str) -> Column:
    """Places in which two sketches (columns ``…s0`` and ``…s1`` with the given prefixes) differ."""
    def differing(part: str) -> Column:
        x = F.col(a + part).bitwiseXOR(F.col(b + part))
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        return F.bit_count(either)

    return differing("s0") + differing("s1")


def bit_maps(sets: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """A map of hashed bits for each set, in 64-bit values; its width is a power of two, at least eight bits a shingle.

    Each bit that one map has and another lacks stands for at least one shingle that the other set lacks.  The halves of
    a map, joined by OR, are the map of half the width.
    """
    place, maps = mix(sets + STEP), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        width = min(max(FEWEST_BITS, 1 << (8 * (b - a) - 1).bit_length()), MOST_BITS) if b > a else FEWEST_BITS
        bits = np.zeros(width, dtype=np.uint8)
        bits[(place[a:b] & np.uint64(width - 1)).astype(np.int64)] = 1
        maps.append(np.packbits(bits, bitorder="little").view("<i8"))
    return maps


def _bits_missing(a: str, b: str) -> Column:
    """How many bits the map ``a`` has that the map ``b`` lacks, at the smaller of their widths.

    Sets whose sizes allow a link differ in width by a factor of two at most.
    """
    width = F.least(F.size(a), F.size(b))

    def folded(name: str) -> Column:
        halves = F.zip_with(F.slice(name, F.lit(1), width), F.slice(name, width + 1, width), lambda x, y: x.bitwiseOR(y))
        return F.when(F.size(name) > width, halves).otherwise(F.col(name))

    missing = F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(missing, F.lit(0), lambda total, n: total + n)


def _first_shared(a: str, b: str, chunks: list[np.ndarray]) -> Column:
    """The place left out in the first key that two signatures (array columns) share; null if they share none.

    A chunk with one differing symbol shares the key without it; a chunk without any shares all, of which the first counts.
    """
    cases = None
    for chunk in chunks:
        first, size = int(chunk[0]), len(chunk)
        differ = F.filter(F.sequence(F.lit(first), F.lit(first + size - 1)), lambda i: F.get(a, i) != F.get(b, i))
        cases = (F if cases is None else cases).when(F.size(differ) <= 1, F.coalesce(F.get(differ, F.lit(0)), F.lit(first)))
    return cases


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, SYMBOLS)


def describe(documents: DataFrame, options: NearDuplicates) -> DataFrame:
    """(doc_id, n_shingles, class, signature): ``class`` names equal sets; both are null for an empty set."""
    size = options.words

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            sets, starts = shingle_sets(b["text"], size)
            symbols, n = iter(signatures(sets, starts)), np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n), pa.array(set_names(sets, starts), pa.binary()),
                 pa.array([next(symbols).tobytes() if k else None for k in n.tolist()], pa.binary())],
                ["doc_id", "n_shingles", "class", "signature"],
            )

    named = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(rows, "doc_id long, n_shingles long, class binary, signature binary")


def keyed(nodes: DataFrame, options: NearDuplicates) -> DataFrame:
    """(key, node): the index entries of each signature."""
    chunks = options.chunks

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            keys = index_keys(_symbols(b["signature"]), chunks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(b["node"].to_numpy(), keys.shape[1]))], ["key", "node"]
            )

    return nodes.select("node", "signature").mapInArrow(rows, "key long, node long")


def sketched(nodes: DataFrame) -> DataFrame:
    """(node, n_shingles, s0, s1, symbols)."""
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            s = sketches(_symbols(b["signature"]))
            symbols = pa.array(list(_symbols(b["signature"]).view("<i2")), pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays(
                [b["node"], b["n_shingles"], pa.array(s[:, 0]), pa.array(s[:, 1]), symbols],
                ["node", "n_shingles", "s0", "s1", "symbols"],
            )

    return nodes.select("node", "n_shingles", "signature").mapInArrow(
        rows, "node long, n_shingles long, s0 long, s1 long, symbols array<smallint>"
    )


class _Join:
    """One run over the classes of a document table: candidate pairs by shared keys, links confirmed on full sets."""

    def __init__(self, documents: DataFrame, classes: DataFrame, nodes: DataFrame, options: NearDuplicates):
        self.options, self.nodes = options, nodes
        keys = keyed(nodes, options)
        shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
        # Written before the join on the same key: a join straight above its aggregate could not split a hot key.
        shared = stage_table(shared.select("key", "leader"), "shared")
        self.index = stage_table(keys.join(shared, "key"), "index")
        # Full sets of the classes that share any key, once for all rounds.
        wanted = stage_table(
            classes.join(self.index.select("node"), "node", "left_semi").select(F.col("lowest").alias("doc_id"), "class", "node"),
            "wanted",
        )
        # A doc_id may stand on rows of several classes: the class picks the text that a node stands for.
        sets = self._full_sets(documents.join(wanted, "doc_id", "left_semi"))
        self.sets = stage_table(sets.join(wanted.select("class", "node"), "class").select("node", "shingles"), "sets")

    def _full_sets(self, documents: DataFrame) -> DataFrame:
        size = self.options.words

        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches(parts):
                sets, starts = shingle_sets(b["text"], size)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_names(sets, starts), pa.binary()), lists], ["class", "shingles"])

        named = documents.select(F.col("text").cast("string"))
        return named.mapInArrow(rows, "class binary, shingles array<long>").dropDuplicates(["class"])

    def _within_distance(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity and whose signatures are within the distance."""
        distance = self.options.distance

        @F.arrow_udf("boolean")
        def near(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array((_symbols(a) != _symbols(b)).sum(axis=1) <= distance)

        def side(name: str) -> DataFrame:
            return self.nodes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"),
                                     F.col("signature").alias(f"g_{name}"))

        both = pairs.join(side("a"), "a").join(side("b"), "b")
        fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.options.percent
        return both.where(fits).where(near("g_a", "g_b")).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the linking similarity, written."""
        def side(name: str) -> DataFrame:
            return self.sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s_{name}"))

        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("s_a", "s_b"))
        union = F.size("s_a") + F.size("s_b") - common
        return stage_table(both.where(common * 100 >= union * self.options.percent).select("a", "b"), "links")

    def leader_pairs(self) -> DataFrame:
        """Each entry of the index with the smallest node of its key."""
        return self._ordered(self.index.where(F.col("node") != F.col("leader")), "node", "leader")

    @staticmethod
    def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    def open_index(self, components: DataFrame) -> DataFrame:
        """Entries of the keys that still join different components: (key, node, component)."""
        placed = self.index.select("key", "node").join(components, "node", "left")
        placed = placed.select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = (
            placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .where("low < high").select("key")
        )
        return placed.join(stage_table(mixed, "mixed"), "key", "left_semi")

    def common_shingles(self, index: DataFrame) -> DataFrame:
        """(node, common): how many shingles of each open node a node of another component has too.

        No intersection of two nodes of different components is larger than that of either, which rules out most pairs
        of a large group of loosely similar texts before they are formed.
        """
        single = self.sets.join(index.select("node", "component").distinct(), "node")
        single = single.select("node", "component", F.explode("shingles").alias("shingle"))
        repeated = (
            single.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .where("low < high").select("shingle")
        )
        return single.join(repeated, "shingle").groupBy("node").agg(F.count("*").alias("common"))

    def _can_link(self, prefix_a: str, prefix_b: str) -> Column:
        """Whether sizes and common shingles (columns with the given prefixes) allow the similarity."""
        p = self.options.percent
        total = F.col(f"{prefix_a}n_shingles") + F.col(f"{prefix_b}n_shingles")
        return F.least(f"{prefix_a}common", f"{prefix_b}common") * (100 + p) >= total * p

    def mapped(self, index: DataFrame) -> DataFrame:
        """(node, bits): the bit map of the full set of each node of the index."""
        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches(parts):
                lists = b["shingles"]
                sets = lists.flatten().to_numpy().view(np.uint64)
                starts = starts_of(pc.list_value_length(lists).to_numpy())
                maps = pa.array(bit_maps(sets, starts), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b["node"], maps], ["node", "bits"])

        return self.sets.join(index.select("node").distinct(), "node", "left_semi").mapInArrow(rows, "node long, bits array<long>")

    def cross_pairs(self, index: DataFrame, common: DataFrame) -> DataFrame:
        """All pairs of different components that share a key, each at the first key it shares, as far as sizes, common
        shingles, signatures and bit maps allow a link.

        The bit maps decide most pairs of a large group of similar texts that do not link.  Their bound is exact: with d
        bits of a missing in b, the sets have at most |a| - d shingles in common.
        """
        able = stage_table(self._linkable(index, common), "able")
        full = able.join(common, "node").join(sketched(self.nodes), "node").join(self.mapped(able), "node")
        columns = ("node", "component", "n_shingles", "common", "s0", "s1", "symbols", "bits")
        left, right = (full.select("key", *(F.col(c).alias(f"{p}{c}") for c in columns)) for p in ("a_", "b_"))
        low, high = F.least("a_n_shingles", "b_n_shingles"), F.greatest("a_n_shingles", "b_n_shingles")
        p = self.options.percent

        def enough_shared(a: str, b: str) -> Column:
            shared = F.col(f"{a}n_shingles") - _bits_missing(f"{a}bits", f"{b}bits")
            return shared * (100 + p) >= (F.col("a_n_shingles") + F.col("b_n_shingles")) * p

        near = (
            (F.col("a_component") < F.col("b_component")) & (low * 100 >= high * p)
            & self._can_link("a_", "b_") & (_sketch_distance("a_", "b_") <= self.options.distance)
            & (_first_shared("a_symbols", "b_symbols", self.options.chunks) == left["key"].bitwiseAND(F.lit(SYMBOLS - 1)))
            & enough_shared("a_", "b_") & enough_shared("b_", "a_")
        )
        return self._ordered(left.join(right, (left["key"] == right["key"]) & near), "a_node", "b_node")

    def components(self) -> DataFrame:
        """(node, component) of linked classes.

        Leaders first: each entry of a key is compared with one leader, which joins large groups at the cost of a row
        per entry.  Then every pair that shares a key and lies in different components is compared, so no
        link between components is missed; links inside a component change nothing and are not looked for.
        """
        links = self.confirmed(self._within_distance(self.leader_pairs()))
        placed = stage_table(connected_components(links, "a", "b"), "components")
        rest = stage_table(self.open_index(placed), "open")
        common = stage_table(self.common_shingles(rest), "common")
        links = links.unionByName(self.confirmed(self.cross_pairs(rest, common)))
        return stage_table(connected_components(links, "a", "b"), "components")

    def _linkable(self, index: DataFrame, common: DataFrame) -> DataFrame:
        """Entries of the nodes that can have a link at all: with |x| shingles, a partner holds at least its share of them."""
        able = common.join(self.nodes.select("node", "n_shingles"), "node")
        able = able.where(F.col("common") * 100 >= F.col("n_shingles") * self.options.percent).select("node")
        return index.join(able, "node", "left_semi")


def _judged(documents: DataFrame, options: NearDuplicates) -> DataFrame:
    """What ``near_duplicates`` returns, and the ``class`` of each row."""
    base = stage_table(describe(documents, options), "sets")
    # Written before the join on the same column, so that a class of very many copies can be split there.  Nodes are
    # numbers of their own, since one doc_id may stand on rows of several classes; writing them makes them last.
    classes = base.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("lowest")).where("lowest IS NOT NULL")
    classes = stage_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = stage_table(
        base.join(classes, "class", "left").select(
            "doc_id", "n_shingles", "class", "node", "lowest",
            F.when(F.col("doc_id") == F.col("lowest"), F.col("signature")).alias("signature")),
        "members",
    )
    nodes = stage_table(
        members.where("node IS NOT NULL AND signature IS NOT NULL").select("node", "n_shingles", "signature")
        .dropDuplicates(["node"]),
        "nodes",
    )
    found = _Join(documents, classes, nodes, options).components()
    # A component is named by the smallest doc_id of its classes; of classes with that same doc_id one leads.
    placed = found.join(classes, "node")
    leaders = stage_table(placed.groupBy("component").agg(F.min(F.struct("lowest", "class")).alias("led")), "led")
    placed = placed.join(leaders, "component").select(
        "node", F.col("led.lowest").alias("led"), (F.col("class") == F.col("led.class")).alias("leads"))
    named = members.drop("signature").join(stage_table(placed, "placed"), "node", "left")
    component = F.coalesce("led", "lowest", "doc_id")
    return named.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce((F.col("doc_id") == component) & F.coalesce("leads", F.lit(True)), F.lit(False)).alias("kept"), "class",
    )


def near_duplicates(documents: DataFrame, options: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links, the row itself included; ``kept`` marks the row that
    bears it.  Equal sets are one class and are compared once.  Null texts and texts without words have no shingles and
    are linked with nothing.  Rows that share a doc_id are one document only if their sets are equal: other texts under
    that doc_id have links and components of their own, and of such texts in one component one is kept.  A null doc_id
    gets the component of its class, null if the class has no other id, and is not kept.  An empty table gives no rows;
    further columns, whatever their names, are not read.
    """
    return _judged(documents, options).drop("class")


def keep_one(documents: DataFrame, options: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The rows of ``documents``, with all their columns, without the near-duplicates: one document of a group stays.

    Of rows that repeat a doc_id and a set of shingles one stays; different texts under one doc_id are judged each for
    itself.  Rows without a doc_id cannot be named as a group's document and stay.
    """
    @F.arrow_udf("binary")
    def class_of(texts: pa.Array) -> pa.Array:
        return pa.array(set_names(*shingle_sets(texts, options.words)), pa.binary())

    found = _judged(documents, options).where("doc_id IS NOT NULL")
    rows = found.groupBy("doc_id", "class").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    rows = stage_table(rows, "judged")
    ids = stage_table(
        rows.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.sum("copies").alias("copies")).where("kept"), "kept")
    single = documents.join(ids.where("copies = 1").select("doc_id"), "doc_id", "left_semi")
    repeated = documents.join(ids.where("copies > 1").select("doc_id"), "doc_id", "left_semi")
    repeated = repeated.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), class_of(F.col("text").cast("string")).alias("name"))
    chosen = rows.where("kept").select(F.col("doc_id").alias("id"), F.col("class").alias("name"))
    same = (repeated["id"] == chosen["id"]) & repeated["name"].eqNullSafe(chosen["name"])
    repeated = repeated.join(chosen, same, "left_semi").dropDuplicates(["id", "name"]).select("row.*")
    return single.unionByName(repeated).unionByName(documents.where("doc_id IS NULL"))
