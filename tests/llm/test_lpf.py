"""Removed bytes against all windows of all texts, and the local arrays against their definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silolens.llm import lpf
from tests.llm.helpers import docs, odd_docs, sentence, texts


def plain(found):
    """Kept bytes of each text, in order: a byte goes if a window over it was seen before."""
    seen, out = set(), []
    for text in found:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        out.append(gone)
    return out


def compare(frame, found):
    got = {r.doc_id: r for r in lpf.dedup(frame).collect()}
    for i, gone in enumerate(plain(found)):
        mask = bytearray(len(gone))
        for s in got[i].spans:
            mask[s.start : s.stop] = b"\1" * (s.stop - s.start)
        assert mask == gone, i
        data = (found[i] or "").encode()
        assert got[i].n_bytes == len(data) and got[i].kept == bytes(b for b, m in zip(data, gone) if not m)
        runs = sum(1 for k, m in enumerate(gone) if m and (not k or not gone[k - 1]))
        assert len(got[i].spans) == runs


@pytest.mark.parametrize("segment", [1 << 20, 150])
def test_removed_bytes(spark, monkeypatch, segment):
    monkeypatch.setattr(lpf, "SEGMENT", segment)
    compare(docs(spark).repartition(3), texts())


@pytest.mark.parametrize("hot", [False, True])
def test_shared_passages(spark, monkeypatch, hot):
    if hot:  # every anchor counts as one that many documents share
        monkeypatch.setattr(lpf, "HOT_FOUND", 1)
        monkeypatch.setattr(lpf, "SAMPLED", 1)
    rng = random.Random(8)
    shared = [sentence(rng, n) for n in (12, 18, 25, 60)]
    found = [" ".join([sentence(rng, 10), rng.choice(shared)[rng.randint(0, 9) :], sentence(rng, 8), rng.choice(shared), sentence(rng, rng.randint(0, 3))]) for _ in range(60)]
    compare(docs(spark, found).repartition(5), found)


@pytest.mark.parametrize("hot", [False, True])
def test_streams_in_small_parts(spark, monkeypatch, hot):
    """Classes and anchors that go on over many batches and many sorted parts."""
    if hot:
        monkeypatch.setattr(lpf, "HOT_FOUND", 1)
        monkeypatch.setattr(lpf, "SAMPLED", 1)
    monkeypatch.setattr(lpf, "FACTOR_WINDOWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(9)
        copy, shared = sentence(rng, 60), sentence(rng, 30)
        found = [copy if i % 3 else " ".join([sentence(rng, 5), shared[rng.randint(0, 9) :], sentence(rng, 4)]) for i in range(90)] + ["ab" * 200]
        compare(docs(spark, found).repartition(4), found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_are_found_by_the_sample(spark):
    """The anchors of a text with 5,000 copies are seen as hot, and its copies lose all bytes but the first's."""
    rng = random.Random(12)
    for _ in range(4):  # whatever the text's hash
        copy = sentence(rng, 40)
        frame = spark.range(6000).selectExpr("id AS doc_id", "id").withColumn("text", F.when(F.col("id") % 6 > 0, F.lit(copy)).otherwise(F.concat(F.lit("short "), "id"))).repartition(6)
        assert set(lpf.blocks(np.frombuffer(copy.encode(), np.uint8), lpf._Hashes())[2].tolist()) <= set(lpf.hot_anchors(frame, F.col("text")).tolist())
    left = lpf.dedup(frame).where("length(kept) > 0").select("doc_id", F.col("kept").cast("string").alias("kept")).where("kept NOT LIKE 'short%'").collect()
    assert [(r.doc_id, r.kept) for r in left] == [(1, copy)]


def test_rows_that_share_ids(spark):
    frame = odd_docs(spark)
    rows = lpf.dedup(frame).collect()
    assert len(rows) == frame.count()
    twins = {}
    for r in rows:
        twins.setdefault((r.doc_id, r.text), []).append(r.kept)
    assert all(len(set(kept)) == 1 for kept in twins.values())
    # each text of 100 bytes or more that occurs is kept once at least
    whole = [r.text for r in rows if r.text and r.kept == r.text.encode()]
    assert {t for t in texts()[:20] if len(t.encode()) >= 100} <= set(whole)


def test_text_form_and_empty_tables(spark):
    frame = docs(spark, ["é" * 60 + "x", "a" + "é" * 60, None, ""])
    out = lpf.dedup(frame, as_text=True)
    assert out.schema == frame.schema
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[2] is None and got[3] == "" and "�" not in got[1]
    assert lpf.dedup(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        lpf.dedup(frame.withColumnRenamed("fp", "kept"))


def test_nearest_smaller():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 300):
        p = rng.permutation(n)
        want = [max((j for j in range(i) if p[j] < p[i]), default=-1) for i in range(n)]
        assert lpf.nearest_smaller(p).tolist() == want


def test_longest_previous_factor():
    rng = np.random.default_rng(3)
    w = rng.integers(97, 99, (200, 12), dtype=np.uint8)
    p = rng.permutation(200)

    def common(a, b):
        return next((k for k in range(12) if a[k] != b[k]), 12)

    want = [max((common(w[i], w[j]) for j in range(200) if p[j] < p[i]), default=0) for i in range(200)]
    assert lpf.longest_previous(w, p).tolist() == want


def test_merged():
    doc, lo, hi = lpf.merged(np.array([1, 0, 0, 0, 1]), np.array([5, 0, 3, 10, 0]), np.array([9, 4, 6, 12, 5]))
    assert list(zip(doc.tolist(), lo.tolist(), hi.tolist())) == [(0, 0, 6), (0, 10, 12), (1, 0, 9)]
