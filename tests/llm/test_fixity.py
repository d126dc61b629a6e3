"""Merkle audit against a plain comparison of all records."""

import pytest

from silolens.llm import fixity

SCHEMA = "file long, start long, size long, digest string"


def leaves(n=300):
    return [(i % 3, (i // 3) * 1000, 1000, f"d{i}") for i in range(n)]


@pytest.mark.parametrize("damage", [{}, {5: "bad"}, {0: None, 7: "bad", 299: "x"}, {i: None for i in range(0, 300, 3)}])
def test_only_damaged_records_are_found(spark, damage):
    ours = leaves()
    theirs = [(*r[:3], damage.get(i, r[3])) for i, r in enumerate(ours) if damage.get(i, r[3]) is not None]
    a, b = spark.createDataFrame(ours, SCHEMA), spark.createDataFrame(theirs, SCHEMA)
    got = fixity.audit(a, b, range_bytes=4000, fanout=4, levels=3).collect()
    assert {(r.file, r.start, r.status) for r in got} == {(*ours[i][:2], "missing" if v is None else "altered") for i, v in damage.items()}
    assert {r.status for r in fixity.audit(b, a, range_bytes=4000, fanout=4).collect()} <= {"added", "altered"}


def test_empty_replicas(spark):
    a = spark.createDataFrame(leaves(), SCHEMA)
    assert fixity.audit(a.where("false"), a.where("false")).count() == 0
    assert fixity.audit(a, a.where("false")).where("status = 'missing'").count() == 300


def test_roots_depend_on_order_and_place(spark):
    base = spark.createDataFrame([(0, 0, 10, "a"), (0, 10, 10, "b")], SCHEMA)
    moved = spark.createDataFrame([(0, 0, 10, "b"), (0, 10, 10, "a")], SCHEMA)
    root = [fixity.tree(t)[-1].first().digest for t in (base, moved, base)]
    assert root[0] != root[1] and root[0] == root[2]


def test_records_and_layout(spark):
    rows = [(1, "u", "h"), (1, "u", "h"), (None, None, None), (2, None, ""), (2, "", None), (3, "u", "é" * 10)]
    found = fixity.records(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", ["url", "html"])
    laid = sorted(fixity.laid_out(found, 40).collect(), key=lambda r: (r.file, r.start))
    assert len(laid) == 5 and sum(r.copies for r in laid) == 6 and len({r.file for r in laid}) > 1
    ends = {}
    for r in laid:
        assert r.start == ends.get(r.file, 0)
        ends[r.file] = r.start + r.size * r.copies
    assert fixity.laid_out(found.where("false")).count() == 0


def test_fields_do_not_run_into_each_other(spark):
    rows = [(1, "a\nb", "c"), (1, "a", "b\nc"), (1, None, "c"), (1, "\0", "c"), (1, "", "c"), (1, "1:a", ""), (1, "", "1:a"), (None, "a", "c"), (1, "x", "y" * 200_000), (1, "x", "y" * 200_000)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "id int, url string, html string, digest int")
    got = fixity.records(table, "id", ["url", "html"]).collect()
    assert len(got) == len({r.digest for r in got}) == len(rows) - 1
    assert sorted(r.copies for r in got) == [1] * (len(rows) - 2) + [2] and max(r.size for r in got) > 200_000


def test_added_records_are_reported(spark):
    a = spark.createDataFrame(leaves(30), SCHEMA)
    more = spark.createDataFrame([(0, 10_000, 1000, "new"), (9, 0, 5, "file")], SCHEMA)
    got = {(r.file, r.start, r.status, r.expected, r.found) for r in fixity.audit(a, a.union(more)).collect()}
    assert got == {(0, 10_000, "added", None, "new"), (9, 0, "added", None, "file")}
