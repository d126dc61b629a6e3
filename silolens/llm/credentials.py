"""Secret scan with corpus-wide ownership frequency.

A scan finds candidates in every text. Their hashes are counted by distinct
owners and repositories: a value that three owners or many repositories hold is
a copied example, a rarer one that looks random is a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silolens.llm.common import fresh, row_hash, stored
from silolens.session import small

# The three kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need not be matched first
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: A value of at least so many owners, or of so many repositories even of one owner, is an example that people copy.
COPIED_OWNERS, COPIED_REPOS = 3, 10
#: A live-looking value has so many bits a character, or such a part of what its length allows if that is less, and mixed characters.
LIVE_BITS, LIVE_PART = 3.0, 0.8
#: Letters alone are mixed if they fall into words of fewer letters than this; names in code have longer ones.
MIXED_LETTERS = 3

SPAN = "struct<kind: int, start: int, stop: int, vstart: int, vstop: int, vhash: binary, random: boolean>"


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in code points, by start, then kind."""
    found = [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(value: str) -> bool:
    letters = [c for c in value if c.isalpha()]
    if not letters:
        return False
    if not any(c.isdigit() for c in value) and len(WORD.findall(value)) * MIXED_LETTERS <= len(letters):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= min(LIVE_BITS, LIVE_PART * math.log2(n))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("vstart", pa.int32()), ("vstop", pa.int32()), ("vhash", pa.binary()), ("random", pa.bool_())]))
    for batch in batches:
        rows = []
        for cell in batch.column("text"):
            text, spans = cell.as_py() or "", []
            for start, k, stop, a, b in base_spans(text):
                value = text[a:b]
                spans.append({"kind": k, "start": start, "stop": stop, "vstart": a, "vstop": b, "vhash": hashlib.sha256(value.encode()).digest()[:16], "random": looks_random(value)})
            rows.append(spans)
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(rows, kind)], names=[*rest, "spans"])


def _scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None) -> DataFrame:
    """Each row's base spans with the hashes of their values; the text itself is left behind."""
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), row_hash(docs).alias("mark"),
        F.col(owner_col).cast("string").alias("owner"), (F.lit(None) if repo_col is None else F.col(repo_col)).cast("string").alias("repo"), F.col(text_col).alias("text"))
    return stored(slim.mapInArrow(_scan, f"row long, doc_id long, mark long, owner string, repo string, spans array<{SPAN}>"), "candidates")


def ownership(candidates: DataFrame) -> DataFrame:
    """Of each value (``vhash``): ``n_found, n_repos, n_owners, verdict``.

    Partial sums over (value, owner, repository), then (value, owner), then the
    value: a value that a third of all rows holds is a few rows after the first.
    A repository is named within its owner; null owners count as one owner, null
    repositories of an owner as one repository.
    """
    by_repo = candidates.groupBy("vhash", "random", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("vhash", "random", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    total = by_owner.groupBy("vhash", "random").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    verdict = F.expr(f"CASE WHEN n_owners >= {COPIED_OWNERS} OR n_repos >= {COPIED_REPOS} THEN 'copied' WHEN random THEN 'live' ELSE 'unclear' END")
    return total.withColumn("verdict", verdict).drop("random")


def _judged(rows: DataFrame) -> DataFrame:
    """Every candidate with its value's verdict."""
    each = rows.where("size(spans) > 0").select("row", "doc_id", "mark", "owner", "repo", F.explode("spans").alias("s")).select("row", "doc_id", "mark", "owner", "repo", "s.*")
    each = stored(each, "spans")
    return each.join(stored(ownership(each), "ownership"), "vhash")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """``doc_id, base, live, n_copied, n_live, n_unclear``: one row per row of ``docs``.

    ``base`` holds the spans of the three patterns, ``live`` the value spans of
    credentials that are no copied examples and look random; both in code points
    of the whole text, by start, then kind. Without ``repo_col`` an owner counts
    as one repository. A null text is empty. Rows that repeat others count as
    further finds of the same owner. An empty table gives an empty result;
    columns other than those named are not shown.
    """
    rows = _scanned(docs, id_col, text_col, owner_col, repo_col)
    return _assembled(rows, _judged(rows))


def _assembled(rows: DataFrame, judged: DataFrame) -> DataFrame:
    per_row = judged.groupBy("row").agg(
        F.array_distinct(F.array_sort(F.collect_list(F.expr("CASE WHEN verdict = 'live' THEN struct(vstart AS start, 3 AS kind, vstop AS stop) END")))).alias("live"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("copied", "live", "unclear")])
    out = rows.select("row", "doc_id", "spans").join(stored(per_row, "verdicts"), "row", "left")
    return out.select(
        "doc_id", F.expr("transform(spans, s -> struct(s.start AS start, s.kind AS kind, s.stop AS stop))").alias("base"),
        F.expr("coalesce(live, array())").alias("live"), *[F.coalesce(f"n_{v}", F.lit(0)).cast("long").alias(f"n_{v}") for v in ("copied", "live", "unclear")])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """``docs`` with every live credential's characters replaced by ``*``; copied examples stay.

    Lengths and all other columns are unchanged, rows without a live credential
    are returned as they are. Only the places to mask travel to the rows: they
    are broadcast if few, else joined by id and row hash.
    """
    rows = _scanned(docs, id_col, text_col, owner_col, repo_col)
    masks = _judged(rows).where("verdict = 'live'").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("vstart", "vstop")).alias("cuts"))
    masks = stored(masks, "masks").selectExpr("doc_id AS _d", "mark AS _m", "cuts AS _cuts")
    key, mark = fresh(docs, "id"), fresh(docs, "mark")
    marked = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(mark, row_hash(docs))
    met = marked.join(small(masks), marked[key].eqNullSafe(F.col("_d")) & (marked[mark] == F.col("_m")), "left")
    text = f"`{text_col}`"
    masked = F.expr(f"CASE WHEN _cuts IS NULL THEN {text} ELSE aggregate(_cuts, {text}, (t, c) -> overlay(t PLACING repeat('*', c.vstop - c.vstart) FROM c.vstart + 1 FOR c.vstop - c.vstart)) END")
    return met.withColumn(text_col, masked).select(*[F.col(f"`{c}`") for c in docs.columns])
