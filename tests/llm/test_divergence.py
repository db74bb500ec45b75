"""The divergence audit against brute force, and the refinement of prefixes against plain counts."""

import re
from collections import Counter, defaultdict

import pytest

from clinspark.llm import divergence
from clinspark.llm.divergence import Divergence, audit_sources, counted_levels, kept_prefixes, kept_terms
from clinspark.session import stage_table

from .conftest import DOCUMENTS

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LONG = "x" * 5000
ROWS = [
    (1, "The river, the RIVER! and the boat", "en", "a"), (2, "river boat boats", "en", "b"), (3, "A boat on the river-bank", "en", "a"),
    (3, "A boat on the river-bank", "en", "a"), (4, None, "en", "c"), (5, "12 34 --", "de", "a"), (6, "naïve Ünder ünder", "fr", None),
    (7, "naïve Ünder", "fr", "b"), (8, "naïve ünder naïve", "fr", ""), (9, LONG + " end", None, "a"), (10, LONG + " end", None, "b"),
    (None, LONG + " end", "", "b"), (11, "unter unters untere", "de", "b"), (12, "日本語 日本 テキスト", "ja", "a"),
    (13, "日本語", "ja", "a"), (14, "日本語 日本", "ja", "b"), (15, "", "de", "c"),
]


def frame(llm, rows=ROWS):
    return llm.createDataFrame([(i, t, lang, source, None, 0.5, "x") for i, t, lang, source in rows], DOCUMENTS).repartition(3)


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, min_docs=3, top=200):
    docs, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = words(text)
        docs.update((lang, w) for w in set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [w for (g, w), n in docs.items() if g == lang and n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update({w: counts[lang, s][w] for w in kept})

        def chances(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1000000000 * (c[w] + 1) // (total + len(kept)) for w in kept}

        p = {s: chances(counts[lang, s]) for s in sources}
        q = chances(whole)
        for s in sources:
            pair = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in sources if o != s]
            over = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pair), ("term", over)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return Counter(out)


def test_matches_brute_force(llm):
    assert Counter(tuple(r) for r in audit_sources(frame(llm)).collect()) == brute(ROWS)
    assert Counter(tuple(r) for r in audit_sources(frame(llm), Divergence(min_docs=1, top=2)).collect()) == brute(ROWS, 1, 2)


def test_counts_in_small_pieces(llm, monkeypatch):
    monkeypatch.setattr(divergence, "COMBINED", 1)
    assert Counter(tuple(r) for r in audit_sources(frame(llm)).collect()) == brute(ROWS)


def test_odd_documents(llm, odd):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert Counter(tuple(r) for r in audit_sources(odd).collect()) == brute(rows)


def test_empty_table(llm, empty):
    assert audit_sources(empty).collect() == []


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_refinement_keeps_what_counts_keep(llm, min_docs):
    """Kept prefixes are those in enough documents, at every level up to the first without any."""
    counted = counted_levels(frame(llm))
    docs = Counter()
    for _, text, lang, _ in ROWS:
        docs.update({(lang or "", n, w.encode()[:n]) for w in words(text) for n in (2**k for k in range(20)) if len(w.encode()) > n})
    kept, levels = kept_prefixes(counted, min_docs)
    have = {(r["lang"], r["level"], bytes(r["prefix"])) for r in kept.collect()}
    assert have == {key for key, n in docs.items() if n >= min_docs and key[1] in levels}
    assert {(r["lang"], bytes(r["term"]).decode()) for r in kept_terms(counted, min_docs)[0].collect()} == {
        (g, w) for (g, w), n in Counter((lang or "", w) for _, t, lang, _ in ROWS for w in set(words(t))).items() if n >= min_docs}


def test_terms_are_dealt_once_and_pairs_counted_once(llm, monkeypatch):
    written = {}

    def staged(df, name):
        written[name], written[f"{name} plan"] = stage_table(df, name), df._jdf.queryExecution().executedPlan().toString()
        return written[name]

    monkeypatch.setattr(divergence, "stage_table", staged)
    assert Counter(tuple(r) for r in audit_sources(frame(llm)).collect()) == brute(ROWS)
    text = written["kept plan"]
    # Above the look-up of prefixes the rows stay where they are.
    assert "Exchange" not in text[:text.index("LeftSemi")] and "REPARTITION" not in text
    pairs = [tuple(r) for r in written["shared"].select("lang", "source", "item").collect()]
    assert pairs and all(source < item for _, source, item in pairs)
