"""Audit of how the sources of a language differ in their words, over the terms that iceberg refinement of prefixes keeps.

Byte prefixes are extended level by level (1, 2, 4, 8, ... bytes).  A prefix in fewer documents of its language than the
threshold is discarded with everything that begins with it, since no longer prefix is in more documents; a term is complete
at the first level that holds it whole.  One pass over the texts writes the document counts of all levels, combined for
many documents at a time, without a shuffle; each level then shuffles only the rows whose shorter prefix was kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from clinspark.llm.text import batches, starts_of
from clinspark.session import stage_table

TERMS = 0  # the level under which whole terms are written
COMBINED = 3_000_000  # terms of texts whose counts are combined before they are written

# Bytes of a term: letters A to Z in either case and all bytes beyond ASCII.  Only A to Z are lower-cased.
_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_IN_TERM = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = np.where(_UPPER, _BYTES + 0x20, _BYTES).astype(np.uint8)


@dataclass(frozen=True)
class Divergence:
    """Documents of its language that a kept term is in, pseudo-count, unit of the probabilities, terms reported."""

    min_docs: int = 3
    pseudo: int = 1
    unit: int = 1_000_000_000
    top: int = 200


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts in one array, and where each begins; a null text is empty."""
    raw = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), starts_of(np.fromiter(map(len, raw), np.int64, len(raw)))


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the terms of all texts in order, as bytes; the text that each stands in)."""
    data, at = _bytes_of(texts)
    inside = _IN_TERM[data]
    # A term begins where the byte before is no part of one, or belongs to another text.
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    filled = at[:-1][np.diff(at) > 0]
    begins[filled] = inside[filled]
    kept = np.flatnonzero(inside)
    first = np.flatnonzero(begins[kept])
    offsets = pa.py_buffer(np.append(first, len(kept)).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, offsets, pa.py_buffer(_LOWER[data[kept]])])
    return words, (np.searchsorted(at, kept[first], side="right") - 1).astype(np.int64)


class _Combined:
    """Terms of many texts, whose languages and sources are known, until they are written as counts."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.words: list[pa.Array] = []
        self.docs: list[np.ndarray] = []
        self.group_of: list[int] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        words, doc = terms(batch["text"])
        self.words.append(words)
        self.docs.append((doc + len(self.group_of)).astype(np.int32))
        names = zip(batch["lang"].to_pylist(), batch["source"].to_pylist())
        self.group_of.extend(self.groups.setdefault(n, len(self.groups)) for n in names)
        self.size += len(words)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Counts of whole terms by language and source, and of the documents of each level's prefixes by language.

        Every pair of language and source gives at least a row, with an empty term if it has no terms.
        """
        groups = list(self.groups)
        group_langs, group_sources = pa.array([g for g, _ in groups]), pa.array([g for _, g in groups])
        langs = group_langs.dictionary_encode()
        lang_of = langs.indices.to_numpy().astype(np.int64)[np.array(self.group_of)]
        group_of = np.array(self.group_of, dtype=np.int64)
        yield self._batch(TERMS, group_langs, group_sources, pa.array([b""] * len(groups), pa.large_binary()),
                          np.zeros(len(groups)), np.zeros(len(groups)))

        coded = pa.concat_arrays(self.words).dictionary_encode()
        names, k = coded.dictionary, max(1, len(coded.dictionary))
        # One entry per document and term, with its occurrences.
        entry, n = np.unique(np.concatenate(self.docs) * np.int64(k) + coded.indices.to_numpy(), return_counts=True)
        self.words, self.docs, coded = [], [], None
        doc, code = entry // k, entry % k
        key = group_of[doc] * k + code
        order = np.argsort(key, kind="stable")
        found, at, docs = np.unique(key[order], return_index=True, return_counts=True)
        group = pa.array(found // k)
        yield self._batch(TERMS, group_langs.take(group), group_sources.take(group), names.take(pa.array(found % k)),
                          np.add.reduceat(n[order], at) if len(at) else at, docs)

        lengths = pc.binary_length(names).to_numpy()
        level = 1
        # A level matters to the terms that are longer: the rest are complete.
        while (longer := lengths > level).any():
            heads = pc.binary_slice(names.filter(pa.array(longer)), 0, level).dictionary_encode()
            h, prefix_of = len(heads.dictionary), np.zeros(k, dtype=np.int64)
            prefix_of[longer] = heads.indices.to_numpy()
            mine = longer[code]
            in_doc = np.unique(doc[mine] * np.int64(h) + prefix_of[code[mine]])
            found, docs = np.unique(lang_of[in_doc // h] * h + in_doc % h, return_counts=True)
            yield self._batch(level, langs.dictionary.take(pa.array(found // h)), pa.array([""] * len(found), pa.string()),
                              heads.dictionary.take(pa.array(found % h)), np.zeros(len(found)), docs)
            level *= 2

    @staticmethod
    def _batch(level: int, lang: pa.Array, source: pa.Array, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(lang), level, dtype=np.int32)), lang.cast(pa.string()), source.cast(pa.string()),
             term.cast(pa.binary()), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))],
            ["level", "lang", "source", "term", "n", "docs"],
        )


def counted_levels(documents: DataFrame) -> DataFrame:
    """(level, lang, source, term, n, docs): partial counts of whole terms (level 0) and of the prefixes of each level.

    Texts, languages and sources that are null count as empty.
    """
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Combined()
        for b in batches(parts):
            held.add(b)
            if held.size >= COMBINED:
                yield from held.rows()
                held = _Combined()
        if held.group_of:
            yield from held.rows()

    named = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return named.mapInArrow(rows, "level int, lang string, source string, term binary, n long, docs long")


def _head(column: str, level: Column | int) -> Column:
    return F.substring(F.col(column), F.lit(1), F.lit(level) if isinstance(level, int) else level)


def kept_prefixes(counted: DataFrame, min_docs: int) -> tuple[DataFrame | None, list[int]]:
    """(level, lang, prefix) of all kept prefixes, and the levels that were refined; stops when none is left."""
    levels = sorted(r["level"] for r in counted.select("level").distinct().collect() if r["level"] != TERMS)
    kept, done = None, []
    for level in levels:
        rows = counted.where(F.col("level") == level).select("lang", F.col("term").alias("prefix"), "docs")
        if done:
            last = kept.where(F.col("level") == done[-1]).select("lang", F.col("prefix").alias("parent"))
            rows = rows.withColumn("parent", _head("prefix", done[-1])).join(last, ["lang", "parent"], "left_semi")
        found = rows.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        found = stage_table(found.select(F.lit(level).alias("level"), "lang", "prefix"), f"prefixes-{level}")
        kept = found if kept is None else kept.unionByName(found)
        done.append(level)
        if not found.head(1):
            break
    return kept, done


def kept_terms(counted: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The kept terms of each language with their occurrences, and the groups (lang, source), both written.

    A row per (lang, term) holds its occurrences ``n`` and the list ``by`` of (source, n), with an entry per source that
    has it.  Rows are dealt once, by language and kept prefix: equal terms have one prefix, so the sums per source and per
    term happen where the prefixes are looked up.
    """
    whole = counted.where(F.col("level") == TERMS).select("lang", "source", "term", "n", "docs")
    kept, levels = kept_prefixes(counted, min_docs)
    groups = stage_table(whole.where("length(term) = 0").select("lang", "source").distinct(), "groups")
    whole = whole.where("length(term) > 0")
    if levels:
        # The longest level that is shorter than the term; beyond the last refined one nothing was kept.  The length of a
        # prefix is its level; terms of one byte are complete without one.
        size = F.length("term")
        level = F.greatest(F.lit(0), *[F.when(size > lv, F.lit(lv)).otherwise(F.lit(0)) for lv in levels])
        known = kept.select("lang", "prefix").unionByName(groups.select("lang", F.lit(b"").alias("prefix")).distinct())
        # Few prefixes against many terms: they are held per part, and the terms need no order.
        whole = whole.withColumn("prefix", _head("term", level)).join(known.hint("shuffle_hash"), ["lang", "prefix"], "left_semi")
    else:
        whole = whole.withColumn("prefix", F.lit(b"")).repartition("lang", "prefix")
    by_source = whole.groupBy("lang", "prefix", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "prefix", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by"))
    return stage_table(by_term.where(F.col("docs") >= min_docs).drop("docs", "prefix"), "kept"), groups


def _probability(n: Column, total: Column, options: Divergence, vocabulary: Column) -> Column:
    """1 + floor(unit * (n + pseudo) / (total + pseudo * vocabulary)) in whole numbers."""
    return F.expr("1L") + F.call_function("div", F.lit(options.unit).cast("long") * (n + options.pseudo), total + options.pseudo * vocabulary)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit_sources(documents: DataFrame, options: Divergence = Divergence()) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others and from its whole language.

    ``pair`` rows sum the gaps over all kept terms, also those that neither source has; the work for them follows the
    terms that occur: absent terms have one probability per source, so terms of one source only are counted by their
    number of occurrences, and only the sources of one term are paired.  ``term`` rows name the terms a source has more of
    than its language.  Rows without text, language or source count with empty ones; every row is a document, repeated
    ones too; an empty table gives no rows; columns beside text, lang and source are not read.
    """
    counted = stage_table(counted_levels(documents), "levels")
    kept, groups = kept_terms(counted, options.min_docs)
    # A row per language and per source from here on: joined as Spark's size check decides.
    whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    sources = kept.select("lang", F.inline("by")).groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    totals = groups.join(whole, "lang", "left").join(sources, ["lang", "source"], "left")
    totals = totals.na.fill(0, ["v", "lang_total", "total", "own"])
    absent = _probability(F.lit(0).cast("long"), F.col("total"), options, F.col("v"))
    # Without kept terms there is nothing to divide by.
    totals = stage_table(totals.withColumn("absent", F.when(F.col("v") > 0, absent).otherwise(F.lit(1).cast("long"))), "totals")

    placed = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("by")).join(totals, ["lang", "source"])
    p = _probability(F.col("n"), F.col("total"), options, F.col("v"))
    q = _probability(F.col("lang_n"), F.col("lang_total"), options, F.col("v"))
    over = placed.select("lang", "source", F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    over = over.select("lang", "source", "item", _gap(F.col("p"), F.col("q")).alias("value"))
    alike = stage_table(placed.groupBy("lang", "source", p.alias("p")).agg(F.count("*").alias("terms")), "alike")
    pairs = _pair_values(kept, totals, alike, options)

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.top)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(
        ranked.withColumn("part", F.lit("term")).select(columns))


def _pair_values(kept: DataFrame, totals: DataFrame, alike: DataFrame, options: Divergence) -> DataFrame:
    """(lang, source, item, value): the summed gaps of each ordered pair of sources of a language.

    Over terms of both: the gap itself, less the gaps that the sums over one side's terms count for them.
    """
    left = totals.select("lang", "v", "source", F.col("own").alias("own_p"), F.col("absent").alias("absent_p"), F.col("total").alias("total_p"))
    right = totals.select(
        "lang", F.col("source").alias("item"), F.col("own").alias("own_q"), F.col("absent").alias("absent_q"), F.col("total").alias("total_q"))
    sides = stage_table(left.join(right, "lang").where(F.col("source") != F.col("item")), "sides")
    # Terms of one side, by number of occurrences, against the other side's probability of an absent term.
    by_left = sides.join(alike, ["lang", "source"]).select(
        "lang", "source", "item", (F.col("terms") * _gap(F.col("p"), F.col("absent_q"))).alias("value"))
    by_right = sides.join(alike.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "terms"), ["lang", "item"]).select(
        "lang", "source", "item", (F.col("terms") * _gap(F.col("absent_p"), F.col("q"))).alias("value"))
    # Terms of both sides: how often each pair of numbers of occurrences comes with each pair of sources, counted for one
    # order of the two sources and valued for both.
    mine = kept.where(F.size("by") > 1).select("lang", "by", F.inline("by"))
    shared = mine.select("lang", "source", F.col("n").alias("n_p"), F.inline(F.col("by"))).toDF("lang", "source", "n_p", "item", "n_q")
    shared = shared.where(F.col("source") < F.col("item")).groupBy("lang", "source", "item", "n_p", "n_q").agg(F.count("*").alias("terms"))
    shared = shared.join(sides, ["lang", "source", "item"])
    p, q = (_probability(F.col(f"n_{x}"), F.col(f"total_{x}"), options, F.col("v")) for x in "pq")
    absent_p, absent_q = F.col("absent_p"), F.col("absent_q")
    there = _gap(p, q) - _gap(p, absent_q) - _gap(absent_p, q)
    back = _gap(q, p) - _gap(q, absent_p) - _gap(absent_q, p)
    shared = stage_table(shared.groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * there).alias("value"), F.sum(F.col("terms") * back).alias("back"), F.sum("terms").alias("both")), "shared")
    shared = shared.drop("back").unionByName(
        shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"), "both"))
    # Terms of neither side, by their number.
    rest = sides.join(shared.select("lang", "source", "item", "both"), ["lang", "source", "item"], "left").select(
        "lang", "source", "item",
        ((F.col("v") - F.col("own_p") - F.col("own_q") + F.coalesce("both", F.lit(0)))
         * _gap(absent_p, absent_q)).alias("value"))
    parts = rest.unionByName(by_left).unionByName(by_right).unionByName(shared.drop("both"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
