"""Hierarchical multi-length packing: context tiers, gap filling from shorter tiers, balanced step groups.

Each document is tokenised and cut into full windows of the longest context;
the rest is routed to the shortest tier that holds it. Tiers are packed from
the longest down: a rest opens a window of its tier, the gap takes the largest
shorter rests that fit, and the last bit is cut from the shortest one. So
every sequence is exactly as long as a tier, and only the very end of a packing
group is split into smaller powers of two: nothing is padded. The sequences of
a group are dealt to steps in order of length, so steps differ by at most one
sequence. Work is one pass over the scan: no shuffle, and memory is one group.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TIERS = (2048, 1024, 512, 256)
END_ID = 1
GROUP_TOKENS = 1 << 21
STEP_TOKENS = 1 << 17
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"

# The split pattern of the byte-level vocabulary, without its branch for longer runs of white space.
SINGLE_SPACES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
RUN_OF_SPACES = re.compile(r"\s{2}")


@functools.cache
def encoder(vocabulary: str, ranks: str | None):
    """``text -> ids`` (uint32), equal to the tokenizers file's own ids without special tokens added.

    The rank file of the same vocabulary is faster. It takes texts whose white
    space stands alone; all others, and texts that spell a special token, go
    through the tokenizer itself.
    """
    own = Tokenizer.from_file(vocabulary)
    special = [t.content for t in own.get_added_tokens_decoder().values()]

    def slow(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return slow
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("single_spaces", pat_str=SINGLE_SPACES, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if RUN_OF_SPACES.search(text) or any(s in text for s in special):
            return slow(text)
        return quick.encode_to_numpy(text).astype(np.uint32, copy=False)

    return encode


class _Rests:
    """Cuttable pieces (length, document, start) in order of length."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.pieces = sorted(pieces)

    def __len__(self) -> int:
        return len(self.pieces)

    def longest(self) -> tuple[int, int, int]:
        return self.pieces.pop()

    def fill(self, gap: int) -> tuple[int, int, int]:
        """The largest piece that fits; failing that, a cut of the shortest one."""
        at = bisect_right(self.pieces, (gap, 1 << 62, 0))
        if at:
            return self.pieces.pop(at - 1)
        length, doc, start = self.pieces.pop(0)
        insort(self.pieces, (length - gap, doc, start + gap))
        return gap, doc, start


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (length, document, start) that hold every token of every document once."""
    top = max(tiers)
    sequences, rests = [], []
    for doc, n in enumerate(lengths):
        for start in range(0, n - top + 1, top):
            sequences.append([(top, doc, start)])
        if n % top:
            rests.append((n % top, doc, n - n % top))
    left = _Rests(rests)
    while len(left):
        window = [left.longest()]
        context = min(t for t in tiers if t >= window[0][0])
        used = window[0][0]
        while used < context and len(left):
            window.append(left.fill(context - used))
            used += window[-1][0]
        if used == context:
            sequences.append(window)
        else:
            sequences += _powers(window, used)
    return sequences


def _powers(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """The end of a group, cut into sequences whose lengths are the powers of two of its total."""
    pieces = pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        room = total & (1 << bit)
        sequence = []
        while room:
            length, doc, start = pieces.pop()
            take = min(length, room)
            sequence.append((take, doc, start))
            if take < length:
                pieces.append((length - take, doc, start + take))
            room -= take
        if sequence:
            yield sequence


def _packer(vocabulary: str, ranks: str | None, tiers: tuple[int, ...], group_tokens: int, step_tokens: int, with_ids: bool):
    def emit(held: list, first_sequence: int, first_step: int) -> tuple[pa.RecordBatch, int, int]:
        sequences = pack_lengths([len(ids) for _, ids in held], tiers)
        sequences.sort(key=lambda s: -sum(p[0] for p in s))
        steps = max(1, -(-sum(len(ids) for _, ids in held) // step_tokens))
        columns: list[list] = [[] for _ in range(10)]
        for at, sequence in enumerate(sequences):
            offset, tier = 0, sum(p[0] for p in sequence)
            turn, lap = at % steps, at // steps
            step = turn if lap % 2 == 0 else steps - 1 - turn  # back and forth, so that no step gets all the longer ones
            for length, doc, start in sequence:
                ident, ids = held[doc]
                data = ids[start : start + length].tobytes()
                row = (ident, start, length, zlib.crc32(data), len(ids), first_sequence + at, offset, tier, first_step + step, data)
                for column, value in zip(columns, row):
                    column.append(value)
                offset += length
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        arrays = [pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, columns)]
        if with_ids:
            names, arrays = [*names, "ids"], [*arrays, pa.array(columns[9], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=names), first_sequence + len(sequences), first_step + steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        first_sequence = first_step = TaskContext.get().partitionId() << 36
        held, tokens = [], 0
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                held.append((ident, ids))
                tokens += len(ids)
                if tokens >= group_tokens:
                    out, first_sequence, first_step = emit(held, first_sequence, first_step)
                    held, tokens = [], 0
                    yield out
        if held:
            yield emit(held, first_sequence, first_step)[0]

    return run


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS,
         group_tokens: int = GROUP_TOKENS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    ``start`` counts the document's ids before the piece, ``offset`` is the place
    in the sequence, ``tier`` the sequence's length and ``step_id`` its training
    step; ``with_ids`` adds the ids as little-endian 32-bit words. A null or
    empty text is the end id alone. Every row of ``docs`` is a document of its
    own, rows that repeat an id or have none included. Very long texts are cut
    like others. An empty table gives an empty result. Other columns are not
    read. ``tiers`` are powers of two. Sequence and step ids are unique in the result.
    """
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers must be powers of two")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_packer(vocabulary, ranks, tuple(tiers), group_tokens, step_tokens, with_ids), SCHEMA + (", ids binary" if with_ids else ""))
