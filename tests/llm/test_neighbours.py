"""Near-duplicates of embeddings against all cosines."""

import math

import numpy as np
import pytest

from clinspark.llm import neighbours
from clinspark.llm.neighbours import NearVectors, near_vectors
from clinspark.llm.text import table

SCHEMA = "vec_id long, embedding array<double>, label string, node string, name string, kept int"


def frame(llm, rows):
    return llm.createDataFrame([(i, v, "l", "n", "x", 3) for i, v in rows], SCHEMA).repartition(4)


def brute(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept), by comparing every vector with every other one."""
    good = []
    for k, (i, v) in enumerate(rows):
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            u = np.array(v) / np.abs(v).max()
            good.append((k, u / math.sqrt(u @ u)))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (k, x) in enumerate(good):
        for m, y in good[:n]:
            if len(x) == len(y) and x @ y >= cosine:
                links[k] += 1
                links[m] += 1
                parent[root(k)] = root(m)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            lowest[root(k)] = min(lowest.get(root(k), i), i)
    return sorted(((i, links[k], lowest.get(root(k)), i is not None and i == lowest[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def answer(df, options=NearVectors()):
    return sorted((tuple(r) for r in near_vectors(df, options).collect()), key=str)


def planted(seed, dim=32):
    """Background, pairs, a tight group, a wide group whose members are linked but too far apart for one bundle, a chain."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    near = lambda centre, n, spread: unit(centre + spread * rng.standard_normal((n, dim)) / math.sqrt(dim))
    parts = [unit(rng.standard_normal((150, dim)))]
    parts += [near(c, 2, 0.1) for c in unit(rng.standard_normal((10, dim)))]
    parts += [near(unit(rng.standard_normal(dim)), 120, 0.08), near(unit(rng.standard_normal(dim)), 40, 0.21)]
    a, b = unit(rng.standard_normal((2, dim)))
    b = unit(b - (a @ b) * a)
    parts.append(np.array([math.cos(t) * a + math.sin(t) * b for t in np.arange(0, 1.5, 0.1)]))
    return np.concatenate(parts)


def test_matches_all_cosines(llm):
    vectors = planted(1)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[200].tolist()) for i in range(30)] + [(2000, (3 * vectors[0]).tolist()), (2001, (1e300 * vectors[1]).tolist())]
    assert answer(frame(llm, rows)) == brute(rows)


def test_odd_rows(llm):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]),
        (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [0.0, 1.0]), (10, [-1.0, 0.0]), (11, [1e-300, 0.0]),
        (12, [-0.0, 1.0]),
    ]
    have = answer(frame(llm, rows))
    want = brute(rows)
    assert have == want


def test_empty_and_all_equal(llm):
    assert answer(frame(llm, [])) == []
    rows = [(i, [0.5, 0.5, 1.0]) for i in range(300)]
    assert answer(frame(llm, rows)) == [(i, 299, 0, i == 0) for i in sorted(range(300), key=lambda i: str((i, 299, 0, i == 0)))]


def test_given_table_and_audit(llm, monkeypatch):
    """Without an order to begin with, the audit asks for more until the links are found."""
    rows = [(r["vec_id"], r["embedding"]) for r in table(llm, "/root/testdata/sf0.01", "embeddings").collect()]
    assert answer(table(llm, "/root/testdata/sf0.01", "embeddings")) == brute(rows)
    seen = []
    audited = neighbours.audited_recall
    monkeypatch.setattr(neighbours, "audited_recall", lambda *a: seen.append(audited(*a)) or seen[-1])
    vectors = planted(2, 16)
    answer(frame(llm, [(i, v.tolist()) for i, v in enumerate(vectors)]), NearVectors(orders=1, neighbours=2, window=1))
    assert seen[-1] >= 0.97
