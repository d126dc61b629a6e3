"""Cross-tokenizer alignment in Arrow: flattened lists, segmented sums, hash joins on ends, partial group counts.

Texts are encoded by a byte-level tokenizer (A) and a piece model (B), some
hundred KB at a time. The id lists are flattened beside the index of their document; token
lengths in bytes, summed within each document, give every token's end. An Acero
hash join of the ends on (document, end) finds where tokens of both end
together: these are the cuts between groups, and the two tokens that end at a
cut are linked. How often two ids are linked is counted by ``Table.group_by``
over each task's links; Spark adds the partial counts.

A document's links are judged by those counts in blocks of at most
``PAIR_BLOCK`` id pairs, which every task holds while it reads the links: the
links are not shuffled, so a pair that a third of them share costs nothing.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.acero  # noqa: F401  (Table.join and Table.group_by run on it)
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from silolens.llm.common import stored
from silolens.llm.packing import encoder
from silolens.session import spread

#: Bytes of text that are aligned at once; a longer text is aligned alone.
CHUNK_BYTES = 1 << 18
#: Bytes of packed links that are counted or judged at once.
LINK_BYTES = 1 << 21
#: Distinct links that a task counts before it passes them on.
HELD_PAIRS = 1 << 19
#: Id pairs whose counts are broadcast at once.
PAIR_BLOCK = 2_000_000
#: Row groups of the stored links.
GROUP_BYTES = 16 << 20
SUMMARY = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
GROUPS = "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it prints, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass(frozen=True)
class Coder:
    """Both encoders with the bytes of their tokens, by id."""

    encode_a: object
    pieces: sentencepiece.SentencePieceProcessor
    bytes_a: pa.Array
    bytes_b: pa.Array
    spelled: pa.Array  # an id in decimals and what follows it: entry 3 id + (0 ',', 1 '|', 2 ';')


@functools.cache
def coder(vocabulary: str, model: str, ranks: str | None = None) -> Coder:
    own = Tokenizer.from_file(vocabulary)
    back = byte_characters()
    size = own.get_vocab_size(with_added_tokens=True)
    bytes_a = []
    for i in range(size):
        token = own.id_to_token(i) or ""
        whole = all(c in back for c in token)
        bytes_a.append(bytes(back[c] for c in token) if whole else token.encode())
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    bytes_b = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())
    spelled = [f"{i}{after}".encode() for i in range(max(size, len(bytes_b))) for after in ",|;"]
    return Coder(_plain_encoder(own, encoder(vocabulary, ranks)), pieces, *(pa.array(x, pa.binary()) for x in (bytes_a, bytes_b, spelled)))


def _plain_encoder(own: Tokenizer, quick):
    """``text -> ids`` where special tokens spelled in a text are ordinary text."""
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    own.encode_special_tokens = True

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
        return quick(text)

    return encode


def _joined_bytes(tokens: pa.ListArray, names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The bytes of each document's tokens, and the length of every token."""
    taken = names.take(tokens.flatten())
    at = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset) if len(taken) else np.zeros(1, np.int32)
    ends = np.ascontiguousarray(at[tokens.offsets.to_numpy()])
    data = taken.buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(ends), data]), np.diff(at)


def _ends(tokens: pa.ListArray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and end in bytes of every token: a running sum that starts anew in each document."""
    doc = pc.list_parent_indices(tokens).to_numpy()
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return doc, total[1:] - total[tokens.offsets.to_numpy()[:-1]][doc]


@dataclass
class Aligned:
    """A chunk's documents that both encoders reproduce. ``cut_a`` and ``cut_b`` index the tokens that end together."""

    whole: np.ndarray
    a: pa.ListArray
    b: pa.ListArray
    cut_a: np.ndarray
    cut_b: np.ndarray
    groups: np.ndarray  # groups of each document


def _lists(ids: list) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def align_chunk(texts: list[str], by: Coder) -> Aligned:
    spaced = [f" {t}" for t in texts]
    a, b = _lists([by.encode_a(t) for t in spaced]), _lists(by.pieces.encode(texts, out_type=int, num_threads=1))
    true = pa.array([t.encode() for t in spaced], pa.binary())
    (bytes_a, length_a), (bytes_b, length_b) = _joined_bytes(a, by.bytes_a), _joined_bytes(b, by.bytes_b)
    whole = pc.and_(pc.equal(bytes_a, true), pc.equal(bytes_b, true))
    whole = pc.and_(whole, pa.array([bool(t) for t in texts], pa.bool_())).to_numpy(zero_copy_only=False)
    if not whole.all():
        kept = np.flatnonzero(whole)
        token_a, token_b = (np.repeat(whole, np.diff(x.offsets.to_numpy())) for x in (a, b))
        a, b = a.take(pa.array(kept)), b.take(pa.array(kept))
        length_a, length_b = length_a[token_a], length_b[token_b]
    (doc_a, end_a), (doc_b, end_b) = _ends(a, length_a), _ends(b, length_b)
    left = pa.table({"doc": doc_a, "end": end_a, "at_a": np.arange(len(doc_a))})
    right = pa.table({"doc": doc_b, "end": end_b, "at_b": np.arange(len(doc_b))})
    met = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
    cut_a, cut_b = met["at_a"].to_numpy(), met["at_b"].to_numpy()
    order = np.argsort(cut_a, kind="stable")
    cut_a, cut_b = cut_a[order], cut_b[order]
    return Aligned(whole, a, b, cut_a, cut_b, np.bincount(doc_a[cut_a], minlength=len(a)))


def _spell(found: Aligned, by: Coder) -> list[str]:
    """SHA-256 of each document's groups, spelled ``a1,a2|b1;a3|b2,b3``."""
    ids_a, ids_b = (x.flatten().to_numpy().astype(np.int64) for x in (found.a, found.b))
    ends_a, ends_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    ends_a[found.cut_a], ends_b[found.cut_b] = 1, 1
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    n = len(found.cut_a)
    before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=n))])
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n))])
    merged = np.empty(len(ids_a) + len(ids_b), np.int64)
    merged[np.arange(len(ids_a)) + before_b[group_a]] = 3 * ids_a + ends_a
    merged[np.arange(len(ids_b)) + before_a[group_b + 1]] = 3 * ids_b + 2 * ends_b
    taken = by.spelled.take(pa.array(merged))
    at = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
    text = memoryview(taken.buffers()[2]) if len(taken) else memoryview(b"")
    ends = at[found.a.offsets.to_numpy() + found.b.offsets.to_numpy()]
    return [hashlib.sha256(text[s : e - 1]).hexdigest() for s, e in zip(ends, ends[1:])]


def _chunks(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, cut so that a column's values stay within ``most`` bytes; a larger value goes alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        past = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))
        past = max(past, at + 1)
        yield batch.slice(at, past - at)
        at = past


def _spread_out(values: pa.Array, whole: np.ndarray) -> pa.Array:
    """Values of the documents that are whole, in their places; null in all others."""
    at = np.where(whole, np.cumsum(whole) - 1, 0)
    return values.take(pa.array(at, mask=~whole))


def _per_text(docs: DataFrame, id_col: str, text_col: str, schema: str, paths: tuple, make) -> DataFrame:
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coder(*paths)
        for batch in batches:
            for chunk in _chunks(batch, "text", CHUNK_BYTES):
                found = align_chunk([t or "" for t in chunk.column("text").to_pylist()], by)
                yield pa.RecordBatch.from_arrays([chunk.column("doc"), *make(found, by)], names)

    names = ["doc", *(c.split()[0] for c in schema.split(", "))]
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {schema}")


def _group_columns(found: Aligned, by: Coder) -> list[pa.Array]:
    offsets = np.concatenate([[0], np.cumsum(found.groups)]).astype(np.int32)
    doc = np.repeat(np.arange(len(found.groups)), found.groups)
    past = [c + 1 - x.offsets.to_numpy()[:-1][doc] for c, x in ((found.cut_a, found.a), (found.cut_b, found.b))]
    ends = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(p, pa.int32())) for p in past]
    return [pc.fill_null(_spread_out(x, found.whole), pa.scalar([], pa.list_(pa.int32()))) for x in (found.a, found.b, *ends)]


def groups(docs: DataFrame, vocabulary: str, model: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, a_ends, b_ends): group g holds the ids of A from ``a_ends[g - 1]`` up to ``a_ends[g]``, of B likewise.

    The text is aligned with one space before it. Null and empty texts, and
    texts that the joined token bytes of either side do not give back, have
    empty lists. Rows that repeat are aligned each.
    """
    return _per_text(docs, id_col, text_col, GROUPS, (vocabulary, model, ranks), _group_columns).withColumnRenamed("doc", id_col)


def _summary_columns(found: Aligned, by: Coder) -> list[pa.Array]:
    counts = [np.diff(found.a.offsets.to_numpy()), np.diff(found.b.offsets.to_numpy()), found.groups]
    out = [pc.fill_null(_spread_out(pa.array(c.astype(np.int64)), found.whole), 0) for c in counts]
    out.append(pc.fill_null(_spread_out(pa.array(_spell(found, by), pa.string()), found.whole), ""))
    pairs = np.stack([x.flatten().to_numpy()[cut] for cut, x in ((found.cut_a, found.a), (found.cut_b, found.b))], axis=1).astype("<i4")
    offsets = 8 * np.concatenate([[0], np.cumsum(found.groups)]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(found.groups), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pairs))])
    return [*out, pc.fill_null(_spread_out(packed, found.whole), b"")]


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id of A and id of B of every link in a column of packed pairs."""
    pairs = np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, 2)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // 8
    return np.repeat(np.arange(len(column)), sizes), pairs[:, 0], pairs[:, 1]


def summaries(docs: DataFrame, vocabulary: str, model: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_a, n_b, n_groups, groups_sha256, links): counts and digest of each text's :func:`groups`, and its links.

    ``links`` packs the linked ids of A and B as pairs of 32-bit integers.
    """
    return _per_text(docs, id_col, text_col, SUMMARY, (vocabulary, model, ranks), _summary_columns)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links join two ids, and whether no other id of A has more with that id of B.

    ``best`` looks at one id of B at a time: at most as many rows as A has ids.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def counted() -> pa.Table:
            return pa.concat_tables(held).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])

        for chunk in (c for batch in batches for c in _chunks(batch, "links", LINK_BYTES)):
            _, a, b = _links(chunk.column("links"))
            held.append(pa.table({"a": a, "b": b}).group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"]))
            if sum(t.num_rows for t in held) > HELD_PAIRS:
                held = [counted()]
                if held[0].num_rows > HELD_PAIRS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from counted().to_batches()

    sums = links.select("links").mapInArrow(partial, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _judge(links: DataFrame, block: pa.Table) -> DataFrame:
    """Add what the pairs of one block contribute to ``n_best`` and ``count_sum``."""
    code = (block["a"].to_numpy().astype(np.int64) << 32) | block["b"].to_numpy()
    order = np.argsort(code)
    known = links.sparkSession.sparkContext.broadcast((code[order], block["n"].to_numpy()[order], block["best"].to_numpy(zero_copy_only=False)[order]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = known.value
        for batch in (c for whole in batches for c in _chunks(whole, "links", LINK_BYTES)):
            doc, a, b = _links(batch.column("links"))
            asked = (a.astype(np.int64) << 32) | b
            at = np.minimum(np.searchsorted(codes, asked), max(len(codes) - 1, 0))
            met = codes[at] == asked if len(codes) else np.zeros(len(asked), bool)
            more = {"n_best": np.zeros(batch.num_rows, np.int64), "count_sum": np.zeros(batch.num_rows, np.int64)}
            if len(codes):
                np.add.at(more["n_best"], doc[met], best[at[met]].astype(np.int64))
                np.add.at(more["count_sum"], doc[met], counts[at[met]])
            for name, values in more.items():
                place = batch.schema.get_field_index(name)
                batch = batch.set_column(place, name, pa.array(batch.column(name).to_numpy() + values))
            yield batch

    return links.mapInArrow(add, links.schema)


def align(docs: DataFrame, vocabulary: str, model: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          pair_block: int = PAIR_BLOCK) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    ``n_best`` counts the links whose pair has the most links of the corpus for
    its id of B, ties included; ``count_sum`` adds up the counts of all links.
    Null, empty and irreproducible texts have zeros and an empty digest; rows
    that repeat count as often as they stand.
    """
    links = stored(summaries(docs, vocabulary, model, ranks, id_col, text_col), "links", GROUP_BYTES)
    pairs = stored(pair_counts(links), "pairs")
    blocks = max(1, -(-pairs.count() // pair_block))
    judged = links.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(blocks)) == k)
        judged = _judge(judged, part.toArrow())
        if k + 1 < blocks:
            judged = stored(judged, "judged", GROUP_BYTES)
    return judged.select(F.col("doc").alias(id_col), "n_a", "n_b", "n_groups", F.expr("cast(octet_length(links) div 8 AS long)").alias("n_links"), "n_best", "count_sum", "groups_sha256")
