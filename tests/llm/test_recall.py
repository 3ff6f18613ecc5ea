"""Near copies against brute force on a whole table.

``BARS_TEST_DIR=/root/testdata/sf0.1 python -m pytest tests/llm/test_recall.py -s`` prints how many texts have their most
similar other text at which similarity, and how many of them are in one class with it.
"""

import os

import corpus
import numpy as np
import pytest

from barsmith.llm import nearcopies

FOLDER = os.environ.get("BARS_TEST_DIR", "/root/testdata/sf0.01")
BINS = [0.1, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97, 1.0]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def shingle_sets(texts, size=5):
    """Numbers of the distinct shingles of each text."""
    names, out = {}, []
    for text in texts:
        w = corpus.WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
        own = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}
        out.append(np.array([names.setdefault(s, len(names)) for s in own]))
    return out


def similar_pairs(sets, least):
    """(a, b, similarity) of all pairs at ``least`` or more that share a shingle, by counting in an inverted index."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingle = np.concatenate(sets)
    order = np.argsort(shingle, kind="stable")
    owner, bound = owner[order], np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
    sizes = np.array([len(s) for s in sets])
    for a, own in enumerate(sets):
        both = np.bincount(np.concatenate([owner[bound[s] : bound[s + 1]] for s in own]), minlength=len(sets))
        sim = both / (sizes + sizes[a] - both)
        for b in np.flatnonzero((sim >= least) & (np.arange(len(sets)) != a)):
            yield a, int(b), float(sim[b])


def test_classes_of_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    first = {}
    for i, text in sorted(rows):
        first.setdefault(text or "", i)
    ids = list(first.values())
    pairs = list(similar_pairs(shingle_sets(first), BINS[0]))
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n_links = 0
    for a, b, sim in pairs:
        if sim >= nearcopies.LEAST and a < b:
            n_links += 1
            p, q = root(ids[a]), root(ids[b])
            parent[max(p, q)] = min(p, q)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.id: r.component for r in nearcopies.classes(docs).collect()}
    assert got == {i: root(first[text or ""]) for i, text in rows}

    best = {}
    for a, b, sim in pairs:
        best[a] = max(best.get(a, (0.0, 0)), (sim, b))
    print(f"\n{len(rows)} documents, {len(ids)} texts, {n_links} links")
    for low, high in zip(BINS, BINS[1:]):
        held = [(a, b) for a, (sim, b) in best.items() if low <= sim and (sim < high or high == 1.0)]
        print(f"{low:.2f} to {high:.2f}: {len(held)} texts, {sum(got[ids[a]] == got[ids[b]] for a, b in held)} in one class")
