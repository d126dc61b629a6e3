"""Ranked lexical search over bit-sliced Bloom signatures, with exact scores for all that is not provably excluded.

The index holds blocks of documents of similar size. A document's signature is
a Bloom filter of its terms; a term that occurs often is entered once more for
each of ``LEVELS`` that its count reaches. A block stores its signatures by
slices: slice j is a bitmap over the block's documents, those whose signature
has bit j. The conjunction of a term's slices is a bitmap that holds every
document with the term (and some without it), and the highest level that tests
positive bounds how often the term occurs. Weighted sums of these bitmaps are
upper bounds of the scores, for a whole block at once.

A search makes four passes: documents per query term; bounds, of which each
item's best few documents are scored exactly; bounds again, now against the
score that those documents have already reached; exact scores of every document
whose bound reaches it. A document is left out only if its bound lies below the
score of as many documents as are asked for.

Items are taken in chunks of bounded size, so queries, weights and thresholds
are small whatever the table of items. No step groups rows by term.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh3_64_intdigest

from silolens.llm.common import stored
from silolens.session import small, spread

TOP = 20
#: Documents of each item that are scored to find what must be reached.
PILOTS = 2 * TOP
#: Counts from which a term is entered once more; the next level less one bounds its count.
LEVELS = np.array([1, 2, 3, 4, 6, 9, 14, 22, 40, 100, 1000], np.int64)
PROBES = 4
BITS_AN_ENTRY = 10
BLOCK_DOCS = 1024
#: Entries that a task holds before it writes all its open blocks.
HELD_ENTRIES = 1 << 21
#: Items and bytes of their texts that one chunk of a search holds.
CHUNK_ITEMS, CHUNK_BYTES = 512, 4 << 20
BLOCK_SCHEMA = "bits int, docs array<long>, rows array<long>, sizes array<long>, slices binary"

#: Bytes of terms as they are, A-Z in lower case, all others as blanks.
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return text.encode(errors="surrogatepass").translate(FOLD).split() if text else []


def _probes(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """(entries, ``PROBES``) bit positions of terms at a level, for signatures of ``bits`` (a power of two)."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        step = (mixed >> np.uint64(33)) | np.uint64(1)
        found = mixed[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]
    return (found & np.uint64(bits - 1)).astype(np.int64)


class _Block:
    """Signatures of one size that a task is collecting."""

    def __init__(self, bits: int):
        self.bits, self.docs, self.rows, self.sizes, self.hashes, self.counts = bits, [], [], [], [], []

    def add(self, doc, row: int, found: Counter, n: int) -> None:
        self.docs.append(doc)
        self.rows.append(row)
        self.sizes.append(n)
        self.hashes.append(np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found)))
        self.counts.append(np.fromiter(found.values(), np.int64, len(found)))

    def record(self) -> dict:
        dense = np.zeros((self.bits, len(self.docs)), bool)
        at = np.repeat(np.arange(len(self.docs)), [len(h) for h in self.hashes])
        hashes, counts = np.concatenate(self.hashes), np.concatenate(self.counts)
        for level, least in enumerate(LEVELS):
            held = counts >= least
            if not held.any():
                break
            dense[_probes(hashes[held], level, self.bits), at[held, None]] = True
        return {"bits": self.bits, "docs": self.docs, "rows": self.rows, "sizes": self.sizes, "slices": np.packbits(dense, axis=1).tobytes()}


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, text): ``row`` is a hash of the text and tells rows of one id apart."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks (bits, docs, rows, sizes, slices) of all documents with a term; ``sizes`` counts terms with repeats.

    Null and empty texts and texts without a term are in no block. Rows that
    repeat are indexed as often as they stand; ids may be null.
    """
    schema = pa.schema([("bits", pa.int32()), ("docs", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("slices", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = {}, 0
        for batch in batches:
            for doc, row, text in zip(*(batch.column(c) for c in ("doc", "row", "text"))):
                words = terms(text.as_py())
                if not words:
                    continue
                found = Counter(words)
                entries = sum(1 if c == 1 else int(np.searchsorted(LEVELS, c, "right")) for c in found.values())
                bits = 1 << max(6, (BITS_AN_ENTRY * entries - 1).bit_length())
                block = open_.setdefault(bits, _Block(bits))
                block.add(doc.as_py(), row.as_py(), found, len(words))
                held += len(found)
                full = list(open_) if held >= HELD_ENTRIES else [bits] if len(block.docs) >= BLOCK_DOCS else []
                for b in full:
                    held -= sum(map(len, open_[b].hashes))
                    yield pa.RecordBatch.from_pylist([open_.pop(b).record()], schema)
        for block in open_.values():
            yield pa.RecordBatch.from_pylist([block.record()], schema)

    return spread(_rows(docs, id_col, text_col)).mapInArrow(blocks, BLOCK_SCHEMA)


def document_counts(docs: DataFrame, wanted: list[bytes], text_col: str = "text") -> list[int]:
    """How many rows of ``docs`` hold each wanted term: one partial count a task, summed by term."""
    number = {t: i for i, t in enumerate(wanted)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(number), np.int64)
        for batch in batches:
            for text in batch.column(0):
                held = [number[t] for t in number.keys() & set(terms(text.as_py()))]
                seen[held] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["term", "n"])

    parts = spread(docs.select(F.col(f"`{text_col}`").alias("text"))).mapInArrow(count, "term int, n long")
    out = [0] * len(wanted)
    for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most one row a wanted term
        out[r["term"]] = r["n"]
    return out


@dataclass
class Queries:
    """A chunk of items against one corpus. Item i has the entries ``starts[i]`` to ``starts[i + 1]``."""

    hashes: np.ndarray
    weights: np.ndarray  # of each entry: the term's weight times its repeats
    entries: np.ndarray  # the term of each entry
    starts: np.ndarray
    wanted: dict[bytes, int]
    n_docs: int
    n_terms: int

    def scale(self, size: int) -> int:
        """A document's length norm: 100 - 25 + (25 n N) div L."""
        return 75 + 25 * size * self.n_docs // self.n_terms

    def items(self) -> int:
        return len(self.starts) - 1


def prepare(found: list[Counter], counts: dict[bytes, int], n_docs: int, n_terms: int) -> Queries:
    """Weights floor(1000 ln((2N + 2) / (2 df + 1))) for the items' terms; rare and missing terms alike have one."""
    wanted = list(counts)
    number = {t: i for i, t in enumerate(wanted)}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts[t] + 1))) for t in wanted], np.int64)
    entries = np.array([number[t] for c in found for t in c], np.int64)
    repeats = np.array([v for c in found for v in c.values()], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(c) for c in found])]).astype(np.int64)
    hashes = np.array([xxh3_64_intdigest(t) for t in wanted], np.uint64)
    return Queries(hashes, weights[entries] * repeats, entries, starts, number, n_docs, n_terms)


def _factors(counts: np.ndarray, scales: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 12 * scales)


def bounds(q: Queries, bits: int, sizes: list[int], slices: bytes) -> np.ndarray:
    """(items, documents): what each document of a block can score at most for each item."""
    n = len(sizes)
    width = (n + 7) // 8
    table = np.frombuffer(slices, np.uint8).reshape(bits, width)
    size = np.array(sizes, np.int64)
    scales = np.array([q.scale(s) for s in sizes], np.int64)
    levels = np.zeros((len(q.hashes), n), np.int8)
    live = np.arange(len(q.hashes))
    held = np.full((len(live), width), 255, np.uint8)
    for level in range(len(LEVELS)):
        held = held & np.bitwise_and.reduce(table[_probes(q.hashes[live], level, bits)], axis=1)
        some = held.any(axis=1)
        live, held = live[some], held[some]
        if not len(live):
            break
        levels[live] += np.unpackbits(held, axis=1, count=n).view(np.int8)
    most = np.append(LEVELS[1:] - 1, np.iinfo(np.int64).max)
    factors = np.zeros((len(LEVELS) + 1, n), np.int64)
    for level in range(len(LEVELS)):
        factors[level + 1] = _factors(np.minimum(size, most[level]), scales)
    out = np.zeros((q.items(), n), np.int64)
    filled = np.flatnonzero(np.diff(q.starts))
    for at in range(0, n, 128):  # keeps the entries of all items within a few MB
        part = slice(at, min(at + 128, n))
        each = np.take_along_axis(factors[:, part], levels[:, part], axis=0)
        if len(filled):
            out[filled, part] = np.add.reduceat(each[q.entries] * q.weights[:, None], q.starts[:-1][filled], axis=0)
    return out


def exact(q: Queries, text: str | None, items: Iterable[int]) -> list[int]:
    """The scores of one text for the given items."""
    words = terms(text)
    scale = q.scale(len(words))
    factor = np.zeros(len(q.hashes), np.int64)
    for t, c in Counter(w for w in words if w in q.wanted).items():
        factor[q.wanted[t]] = 1_000_000_000 * c // (1000 * c + 12 * scale)
    return [int(factor[q.entries[a:b]] @ q.weights[a:b]) for a, b in ((q.starts[i], q.starts[i + 1]) for i in items)]


def _pilots(blocks: DataFrame, q: Queries) -> DataFrame:
    """(item, doc, row): documents of each item with the highest bounds, ``PILOTS`` at most."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((q.items(), 0), np.int64)
        docs, rows = np.zeros((q.items(), 0), object), np.zeros((q.items(), 0), np.int64)
        for batch in batches:
            for b in batch.to_pylist():
                found = bounds(q, b["bits"], b["sizes"], b["slices"])
                top = np.concatenate([top, found], axis=1)
                docs = np.concatenate([docs, np.broadcast_to(np.array(b["docs"], object), found.shape)], axis=1)
                rows = np.concatenate([rows, np.broadcast_to(np.array(b["rows"], np.int64), found.shape)], axis=1)
                if top.shape[1] > PILOTS:
                    at = np.argpartition(-top, PILOTS - 1, axis=1)[:, :PILOTS]
                    top, docs, rows = (np.take_along_axis(x, at, axis=1) for x in (top, docs, rows))
        item, at = np.nonzero(top)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(list(docs[item, at]), pa.int64()), pa.array(rows[item, at]), pa.array(top[item, at])], ["item", "doc", "row", "bound"])

    found = blocks.mapInArrow(best, "item int, doc long, row long, bound long")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc").asc_nulls_last(), "row")
    return found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= PILOTS).select("item", "doc", "row")


def _candidates(blocks: DataFrame, q: Queries, reached: np.ndarray) -> DataFrame:
    """(doc, row, items): every document with the items for which its bound is what is ``reached`` or more."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                hit = bounds(q, b["bits"], b["sizes"], b["slices"]) >= reached[:, None]
                docs = np.flatnonzero(hit.any(axis=0))
                items = [np.flatnonzero(hit[:, d]) for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["docs"][d] for d in docs], pa.int64()), pa.array([b["rows"][d] for d in docs], pa.int64()), pa.array(items, pa.list_(pa.int32()))],
                    ["doc", "row", "items"])

    return blocks.mapInArrow(kept, "doc long, row long, items array<int>").dropDuplicates(["doc", "row"])


def _scored(rows: DataFrame, wanted: DataFrame, q: Queries) -> DataFrame:
    """(item, doc, row, score) with a score above 0: each row of the corpus for the items that ``wanted`` names."""
    wanted = wanted.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "items")
    met = rows.join(wanted, rows["doc"].eqNullSafe(wanted["_doc"]) & (rows["row"] == wanted["_row"])).select("doc", "row", "text", "items")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                doc, row, text, items = (batch.column(c)[at].as_py() for c in ("doc", "row", "text", "items"))
                found = [(i, s) for i, s in zip(items, exact(q, text, items)) if s > 0]
                k = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in found], pa.int32()), pa.array([doc] * k, pa.int64()), pa.array([row] * k, pa.int64()), pa.array([s for _, s in found], pa.int64())],
                    ["item", "doc", "row", "score"])

    return met.mapInArrow(score, "item int, doc long, row long, score long")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last(), "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _chunks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[Row]]:
    """The items' rows, in lists of bounded size: the driver holds one list and a part of the table."""
    chunk, size = [], 0
    for r in items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).toLocalIterator():
        more = len(r["text"] or "")
        if chunk and (len(chunk) >= CHUNK_ITEMS or size + more > CHUNK_BYTES):
            yield chunk
            chunk, size = [], 0
        chunk.append(r)
        size += more
    if chunk:
        yield chunk


def search(docs: DataFrame, items: DataFrame, blocks: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
           item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 for each row of ``items``.

    ``blocks`` is the :func:`index` of ``docs``. Every row of either table
    counts for itself, repeated or not; equal scores rank by ascending id, then
    by a hash of the text, rows without an id last. Items and documents without
    a term give no rows; a null item id is returned as null.
    """
    spark = docs.sparkSession
    if top > PILOTS:
        raise ValueError(f"top is at most {PILOTS}")
    schema = StructType([StructField(item_id, items.schema[item_id].dataType), *StructType.fromDDL(f"rank int, `{doc_id}` long, score long").fields])
    totals = blocks.agg(F.sum(F.size("docs")).alias("n"), F.sum(F.expr("aggregate(sizes, 0L, (t, s) -> t + s)")).alias("l")).first()
    rows, out = spread(_rows(docs, doc_id, doc_text)), []
    for chunk in _chunks(items, item_id, item_text) if totals["n"] else ():
        found = [Counter(terms(r["text"])) for r in chunk]
        wanted = sorted({t for c in found for t in c})
        if not wanted:
            continue
        q = prepare(found, dict(zip(wanted, document_counts(docs, wanted, doc_text))), totals["n"], totals["l"])
        pilots = _pilots(blocks, q).groupBy("doc", "row").agg(F.collect_set("item").alias("items"))  # PILOTS rows an item at most
        reached = np.ones(q.items(), np.int64)
        sure = _ranked(_scored(rows, F.broadcast(pilots), q), top)
        for r in sure.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():
            if r["n"] == top:
                reached[r["item"]] = r["least"]
        candidates = stored(_candidates(blocks, q, reached), "candidates")
        best = _ranked(_scored(rows, small(candidates), q), top)
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(chunk)], StructType([StructField("item", best.schema["item"].dataType), schema[0]]))
        out.append(best.join(F.broadcast(names), "item").select(F.col(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_id), "score"))
        if len(out) > 1:
            out = [out[0].unionAll(out[1])] if len(out) < 8 else [stored(out[0].unionAll(out[1]), "ranked")]
    return out[0] if out else spark.createDataFrame([], schema)
