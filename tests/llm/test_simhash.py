"""SimHash against fingerprints and links computed bit by bit."""

import random
import re
from collections import Counter

import pytest
import xxhash

from silolens.llm import simhash
from silolens.llm.components import components
from tests.llm.helpers import docs, odd_docs, reachable, texts


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64(s.encode(), seed=42).intdigest() >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def near(a, b):
    return (a ^ b).bit_count() <= 3


def test_fingerprints_and_components(spark):
    found = texts()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark)).collect()}
    prints = [plain(t) for t in found]
    assert [got[i].fp % (1 << 64) for i in range(len(found))] == prints
    pairs = [(i, j) for i in range(len(found)) for j in range(i) if near(prints[i], prints[j])]
    assert [got[i].component_id for i in range(len(found))] == reachable(len(found), pairs)


@pytest.mark.parametrize("tile", [4096, 8])
def test_links_of_close_fingerprints(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre)
            for _ in range(rng.randint(1, 3)):
                centre ^= 1 << rng.randrange(64)
    fps |= {0, (1 << 64) - 1, 1, 3, 7, 15}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.linked(frame)).collect()}
    pairs = [(i, j) for i in range(len(signed)) for j in range(i) if near(signed[i] % (1 << 64), signed[j] % (1 << 64))]
    want = reachable(len(signed), pairs)
    assert [got.get(f, f) for f in signed] == [signed[w] for w in want]


def test_one_of_each_group_stays(spark):
    frame = odd_docs(spark)
    kept = simhash.keep_first(frame)
    assert kept.schema == frame.schema
    rows = kept.collect()
    prints = [plain(r.text) for r in rows]
    assert all(not near(a, b) for i, a in enumerate(prints) for b in prints[:i])
    everything = frame.collect()
    assert all(r in everything for r in rows)
    all_prints = [plain(r.text) for r in everything]
    groups = reachable(len(everything), [(i, j) for i in range(len(everything)) for j in range(i) if near(all_prints[i], all_prints[j])])
    assert len(rows) == len(set(groups))
    named = {}
    for g, r in zip(groups, everything):
        named.setdefault(g, []).append(r.doc_id)
    want = Counter(min((i for i in ids if i is not None), default=None) for ids in named.values())
    assert Counter(r.doc_id for r in rows) == want


def test_odd_and_empty_tables(spark):
    frame = odd_docs(spark)
    assert simhash.near_duplicates(frame).count() == frame.count()
    assert simhash.near_duplicates(frame.where("false")).count() == 0
    assert simhash.keep_first(frame.where("false")).count() == 0
    lone = simhash.near_duplicates(docs(spark, ["lonely words of one text"], [None])).first()
    assert lone.doc_id is None and lone.component_id is None


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(9)
    n = 400
    pairs = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(7, i) for i in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(250)], "none": [(3, 3)]}[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long").union(spark.createDataFrame([(None, 4)], "a long, b long"))).collect()}
    want = reachable(n, pairs)
    assert [got.get(i, i) for i in range(n)] == want
    assert len(got) == len({i for p in pairs for i in p if p[0] != p[1]})
