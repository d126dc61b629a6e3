"""The registered queries against SQL or brute force on a given table, and the pipeline stage by stage."""

import functools

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from silolens.llm import decision_rules, packing
from silolens.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import reachable
from tests.llm.test_credentials import plain as plain_spans
from tests.llm.test_decision_rules import plain as plain_statistics
from tests.llm.test_lpf import plain as plain_removed
from tests.llm.test_packing import check as check_packing
from tests.llm.test_simhash import near, plain as plain_print
from tools.check_oracle import TABLES, verdict


@functools.cache
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert verdict(QUERIES[name](spark, sf).toPandas(), duck(sf).execute(ORACLES[name]).df()) == "ok"


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage against brute force on the rows that the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "near_duplicates", "repeated_passages", "live_credentials", "packed"]

    good = steps["quality_rules"](spark, docs, sf).cache()
    rules = decision_rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = set()
    for r in docs.collect():
        n, chars, symbols, lines, repeated, failed = plain_statistics(r.text)
        values = () if failed else (float(n), chars / n, symbols / n, float(lines), repeated / n)
        if not failed and not any(all(c.holds(values) for c in rule) for rule in rules):
            want.add(r.doc_id)
    assert good.columns == columns and {r.doc_id for r in good.collect()} == want

    rows = good.orderBy("doc_id").collect()
    prints = [plain_print(r.text) for r in rows]
    groups = reachable(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near(prints[i], prints[j])])
    single = steps["near_duplicates"](spark, good, sf).cache()
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {rows[g].doc_id for g in groups}

    rows = single.orderBy("doc_id").collect()
    cut = steps["repeated_passages"](spark, single, sf).cache()
    left = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and len(left) == len(rows)
    for r, gone in zip(rows, plain_removed([r.text for r in rows])):
        text = bytes(b for b, m in zip(r.text.encode(), gone) if not m).decode(errors="ignore")
        assert (left[r.doc_id].text, left[r.doc_id].n_chars) == (text, len(text))

    masked = steps["live_credentials"](spark, cut, sf).cache()
    assert masked.columns == columns
    after = {r.doc_id: r.text for r in masked.collect()}
    assert set(after) == set(left)
    for i, r in left.items():
        assert len(after[i]) == len(r.text)
        if not plain_spans(r.text):
            assert after[i] == r.text

    packed = steps["packed"](spark, masked, sf).collect()
    check_packing(packed, after)
    assert packing.SCHEMA.count(",") + 1 == len(packed[0])
    total = sum(r.length for r in corpus_pipeline.run(spark, sf).collect())
    assert total == sum(r.length for r in packed)

