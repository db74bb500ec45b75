"""One doc_id on rows with different texts."""

from clinspark.llm.minhash import NearDuplicates, keep_one, near_duplicates

from .test_operators import brute_components

A, B, C = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
ROWS = [
    (9, A), (9, B), (20, A), (30, B), (20, B + " end"), (40, C), (41, C + " end"), (41, A + " more"), (7, "short"), (7, None),
    (50, "d " + C), (9, A),
]


def brute(size, percent):
    """(doc_id, text) of one row per component of distinct texts: the smallest doc_id's."""
    texts = sorted({t or "" for _, t in ROWS})
    found = brute_components(list(enumerate(texts)), size, percent)
    smallest = {}
    for i, t in ROWS:
        component = found[texts.index(t or "")][1]
        smallest[component] = min(smallest.get(component, i), i)
    return {t: (found[texts.index(t)][0], smallest[found[texts.index(t)][1]]) for t in texts}


def test_texts_under_one_id_match_brute_force(llm):
    docs = llm.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    want = brute(4, 80)
    rows = near_duplicates(docs, NearDuplicates(words=4)).collect()
    have = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert have == sorted((i, *want[t or ""]) for i, t in ROWS)


def test_no_text_under_a_shared_id_is_lost(llm):
    docs = llm.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    kept = sorted((r["doc_id"], r["text"] or "") for r in keep_one(docs, NearDuplicates(words=4)).collect())
    assert kept == sorted([(9, A), (9, B), (40, C), (7, "short"), (7, "")])
    few = llm.createDataFrame([(9, A), (9, B), (20, A), (30, B)], "doc_id long, text string")
    assert sorted(r["text"] for r in keep_one(few).collect()) == [A, B]


def test_of_like_texts_under_one_id_one_stays(llm):
    docs = llm.createDataFrame([(9, A), (9, A + " end"), (9, C), (10, A)], "doc_id long, text string")
    rows = keep_one(docs, NearDuplicates(words=4)).collect()
    assert len(rows) == 2 and {r["doc_id"] for r in rows} == {9} and C in {r["text"] for r in rows}
