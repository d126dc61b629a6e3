"""Ranked search against plain scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from silolens.llm import search
from silolens.llm.common import stored
from tests.llm.helpers import docs as given_docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, top=20):
    """[(item, rank, doc, score)] of rows (id, text), by scoring everything."""
    counts = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in Counter(words(text)).items())
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:top])]
    return sorted(out, key=repr)


def found(spark, docs, items, **settings):
    table = given_docs(spark, [t for _, t in docs], [i for i, _ in docs])
    asked = spark.createDataFrame(items, "item_id long, text string")
    blocks = stored(search.index(table), "blocks")
    rows = search.search(table, asked, blocks, **settings).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=repr)


def corpus(seed=3, n=600):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 20, 60, 300]))) for _ in range(n)]
    texts += [texts[0]] * 40 + ["", None, "... --- !!!", "Ünïcode ÉTÉ été", " ".join(vocabulary * 30), vocabulary[0] * 1 + " " + (vocabulary[3] + " ") * 5000]
    return list(enumerate(texts)), vocabulary


def test_search_equals_scoring_everything(spark):
    docs, vocabulary = corpus()
    docs += [(None, docs[5][1]), (None, docs[5][1]), (7, docs[7][1]), (7, docs[8][1])]
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 8, 40])))) for k in range(30)]
    items += [(100, docs[0][1].upper()), (101, docs[5][1]), (102, ""), (103, None), (104, "nowhere-to be_found1"), (105, "ÉTÉ"), (106, vocabulary[0] + " " + vocabulary[0]), (None, vocabulary[9])]
    assert found(spark, docs, items) == plain(docs, items)


def test_chunks_of_items_and_shorter_lists(spark, monkeypatch):
    docs, vocabulary = corpus(5, 120)
    items = [(k, f"{vocabulary[k]} {vocabulary[k + 1]}") for k in range(25)]
    monkeypatch.setattr(search, "CHUNK_ITEMS", 7)
    assert found(spark, docs, items, top=5) == plain(docs, items, 5)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == []
    assert found(spark, [(1, None), (2, "?")], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], [(1, "a a"), (2, "a c b")]) == plain([(1, "a b")], [(1, "a a"), (2, "a c b")])


@pytest.mark.parametrize("repeats", [1, 3, 50])
def test_bounds_are_never_below_the_score(repeats):
    rng = random.Random(repeats)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=60) * rng.randint(1, repeats)) for _ in range(50)]
    asked = [Counter(search.terms(" ".join(rng.choices(vocabulary, k=12)))) for _ in range(20)] + [Counter()]
    counts = Counter(t for x in texts for t in set(search.terms(x)))
    q = search.prepare(asked, {t: counts[t] for t in sorted({t for c in asked for t in c})}, len(texts), sum(len(search.terms(x)) for x in texts))
    block = search._Block(8192)
    for k, x in enumerate(texts):
        block.add(k, k, Counter(search.terms(x)), len(search.terms(x)))
    held = block.record()
    most = search.bounds(q, held["bits"], held["sizes"], held["slices"])
    true = np.array([search.exact(q, x, range(len(asked))) for x in texts]).T
    assert (most >= true).all() and most[:20].sum() < 1.6 * true.sum()


def test_few_documents_are_scored_exactly(spark, sf):
    """The bounds exclude most documents, and the ranking is whole all the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    blocks = stored(search.index(docs), "blocks")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in search.search(docs, items, blocks).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
