"""Line deduplication against a plain count of lines."""

import hashlib
import re

from silolens.llm import line_dedup
from silolens.llm.queries import QUERIES
from tests.llm.helpers import DOC_SCHEMA

EDGE = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
FOLD = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def plain(rows, min_chars=40, min_docs=5):
    """(n_lines, n_dropped, kept text) of each (id, text)."""
    def key(line):
        return EDGE.sub("", line).translate(FOLD)

    order = lambda i: (i is not None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)], key=order) == i]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def given(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "fp", "0", "n", "i", "w") for i, t in rows], DOC_SCHEMA)


def rows():
    shared = ["A line of the licence that is repeated everywhere, in full.", "Ünïcode lines keep their É; only A to Z are folded here.", "x" * 40, "y" * 39]
    found = []
    for i in range(12):
        lines = [f"own line {i}", shared[0] if i % 2 else f"\t {shared[0].upper()} \r", shared[1] if i < 5 else shared[1].replace("É", "é"), shared[2], shared[3], shared[2], ""]
        found.append((i, "\n".join(lines)))
    found += [(40, "z" * 60), (41, "z" * 60), (42, "z" * 60), (43, "z" * 60)]  # four documents are too few
    found += [(50, "w" * 60 + "\n" + "w" * 60)] * 6  # one document, however often it repeats
    found += [(None, shared[0]), (None, "v" * 50 + "\n" + shared[2]), (None, None), (60, ""), (61, None), (62, "\n\n"), (63, shared[0] + "\n" + shared[0])]
    return found + [(70, "\n".join(f"{shared[0]}\n{k}" for k in range(3000)))]


def check(spark, found, **settings):
    got = line_dedup.dedup(given(spark, found), **settings)
    assert {"fp", "start", "_id", "words"} < set(got.columns)
    texts = got.selectExpr("doc_id", "text", "n_lines", "n_dropped", "keep").withColumn("left", line_dedup.apply_keep("text", "keep")).collect()
    seen = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.left if r.keep is not None else r.text or "") for r in texts), key=repr)
    want = sorted(((i, t, *w) for (i, t), w in zip(found, plain(found, **settings))), key=repr)
    assert seen == want
    for r in texts:
        assert r.keep is None or (sum(r.keep) == r.n_lines and sum(r.keep[1::2]) == r.n_dropped and all(n > 0 for n in r.keep[1:-1]))


def test_lines_equal_a_plain_count(spark):
    check(spark, rows())


def test_other_bounds_and_documents(spark):
    check(spark, rows(), min_chars=1, min_docs=2)


def test_hot_line_is_kept_in_one_document(spark):
    line = "Subscribe to our newsletter for weekly updates!"
    check(spark, [(i, f"{line}\nbody of {i} is long enough to count as a line of text") for i in range(3000)])


def test_empty_table(spark):
    assert line_dedup.dedup(given(spark, [])).count() == 0


def test_query_digest_equals_plain(spark, sf):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op12_line_dedup"](spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, d, t) in zip(docs, plain(docs))}
