"""SentencePiece encoding and decoding by batched Viterbi.

Text is cut before each run of spaces, which no piece of such a model crosses.
The distinct words of a batch are grouped by length and advance together: the
hashes of all substrings probe the sorted hashes of the pieces, and one
vectorised maximum a position stores the backpointers. A character without a
piece becomes its UTF-8 byte pieces, so decoding returns the text exactly.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from silolens.llm.common import runs

BATCH_CHARS = 1 << 22
CELLS = 1 << 21
#: A character without a piece scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
WORD = re.compile(r" +[^ ]*|[^ ]+")
SPACE, MARK, NO_PIECE = 0x20, 0x2581, 0x110000

_U = np.uint64
_BASE, _BACK = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted hashes of the pieces
    ids: np.ndarray  # their ids
    scores: np.ndarray  # their scores
    longest: int
    unknown: float
    bytes_: np.ndarray  # id of each byte piece
    pool: np.ndarray  # the bytes that ids decode to, one after another
    first: np.ndarray  # where each id's bytes start
    sizes: np.ndarray  # and how many they are


def _mixed(x: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U(29))) + np.asarray(length).astype(_U) * _U(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Rows of code points to prefix sums of their polynomial hash."""
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), _U)
    np.cumsum((codes.astype(_U) + _U(1)) * _powers(_BASE, codes.shape[1])[:-1], axis=1, dtype=_U, out=sums[:, 1:])
    return sums


@functools.cache
def load(path: str) -> Model:
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, bytes_, pieces = [], np.zeros(256, np.int64), []
    for i in range(processor.vocab_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            value = int(piece[3:-1], 16)
            bytes_[value] = i
            texts.append(bytes([value]))
        elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
            texts.append(b"")
        else:
            texts.append(piece.replace("▁", " ").encode())
            pieces.append((i, piece, processor.get_score(i)))
    keys = np.array([int(_mixed(_prefix(np.array([[ord(c) for c in p]]))[0, -1:], len(p))[0]) for _, p, _ in pieces], _U)
    order = np.argsort(keys)
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two pieces share a hash")
    scores, sizes = np.array([s for _, _, s in pieces]), np.array([len(t) for t in texts])
    return Model(keys[order], np.array([i for i, _, _ in pieces])[order], scores[order], max(len(p) for _, p, _ in pieces), float(scores.min()) - UNKNOWN_PENALTY, bytes_,
                 np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)


def viterbi(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of one length, one word after another, and how many each has.

    The best sum of scores wins, on ties the shorter last piece.
    """
    n, size = len(words), len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.int64)
    codes = np.where(codes == SPACE, MARK, np.where(codes == MARK, NO_PIECE, codes))
    sums, back = _prefix(codes), _powers(_BACK, size)
    depth = min(model.longest, size)
    score = np.full((n, size, depth), -np.inf)  # of the piece that starts here and has so many characters
    piece = np.full((n, size, depth), -1, np.int32)
    for length in range(1, depth + 1):
        starts = size - length + 1
        probe = _mixed((sums[:, length:] - sums[:, :starts]) * back[:starts], length)
        at = np.minimum(np.searchsorted(model.keys, probe), len(model.keys) - 1)
        hit = model.keys[at] == probe
        score[:, :starts, length - 1] = np.where(hit, model.scores[at], -np.inf)
        piece[:, :starts, length - 1] = np.where(hit, model.ids[at], -1)
    lone = piece[:, :, 0] < 0
    score[:, :, 0][lone] = model.unknown
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    step = np.zeros((n, size + 1), np.int32)
    for end in range(1, size + 1):
        lengths = np.arange(1, min(depth, end) + 1)
        options = best[:, end - lengths] + score[:, end - lengths, lengths - 1]
        choice = options.argmax(axis=1)
        best[:, end] = options[np.arange(n), choice]
        step[:, end] = choice + 1
    out = np.full((n, size), -2, np.int64)  # -2: no piece starts here, -1: a character without a piece
    place = np.full(n, size)
    while True:
        open_ = np.flatnonzero(place > 0)
        if not len(open_):
            break
        length = step[open_, place[open_]]
        start = place[open_] - length
        out[open_, start] = piece[open_, start, length - 1]
        place[open_] = start
    odd = np.flatnonzero((out == -1).any(axis=1))
    if not len(odd):
        taken = out >= 0
        return out[taken], taken.sum(axis=1)
    rows = [row[row >= 0] for row in out]
    for i in odd.tolist():  # words with a character that has no piece: its bytes
        ids: list[int] = []
        for at, value in enumerate(out[i].tolist()):
            if value >= 0:
                ids.append(value)
            elif value == -1:
                ids += model.bytes_[list(words[i][at].encode("utf-8", "surrogatepass"))].tolist()
        rows[i] = np.array(ids, np.int64)
    return np.concatenate(rows), np.array([len(r) for r in rows])


def _gathered(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs (first, size) of ``pool``, one after another."""
    return pool[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def encode_texts(texts: list[str], model: Model) -> list[np.ndarray]:
    """Ids (uint32) of each text; an empty text has none. A space is put before the first word."""
    index: dict[str, int] = {}
    number = index.setdefault
    of_text = [np.array([number(w, len(index)) for w in WORD.findall(" " + t)], np.int64) if t else np.zeros(0, np.int64) for t in texts]
    words = list(index)
    first, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    flat, total = [np.zeros(0, np.uint32)], 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for lo, hi in zip(*runs(lengths[order])):
        length = int(lengths[order[lo]])
        at_once = max(1, CELLS // (length * min(length, model.longest)))
        for a in range(lo, hi, at_once):
            part = order[a : min(a + at_once, hi)]
            ids, counts = viterbi([words[i] for i in part.tolist()], model)
            first[part], sizes[part] = total + np.cumsum(counts) - counts, counts
            flat.append(ids.astype(np.uint32))
            total += len(ids)
    pool = np.concatenate(flat)
    return [_gathered(pool, first[mine], sizes[mine]) for mine in of_text]


def decode_ids(ids: np.ndarray, model: Model) -> str:
    """The text of the ids; the space before the first word goes."""
    data = _gathered(model.pool, model.first[ids], model.sizes[ids]).tobytes()
    return (data[1:] if data.startswith(b" ") else data).decode("utf-8", "replace")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= BATCH_CHARS):
                    chars += len(texts[hi])
                    hi += 1
                ids = encode_texts(texts[lo:hi], model)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                    names=["doc_id", "text", "ids", "ids_crc32"])
                lo = hi
    return run


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, ids, ids_crc32``: one row per row of ``docs``, by one pass without a shuffle.

    The segmentation has the largest sum of piece scores. A null or empty text
    has no ids. Whole texts are encoded, a very long one in a batch of its own;
    repeated rows alike; an empty table gives an empty result; other columns are
    not read. The crc is over little-endian unsigned 32-bit ids.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_encode(model_file), "doc_id long, text string, ids array<int>, ids_crc32 long")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [decode_ids(ids.values.to_numpy(zero_copy_only=False), model) if ids.is_valid else None for ids in batch.column("ids")]
            rest = [n for n in batch.schema.names if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(texts, pa.string())], names=[*rest, "decoded"])
    return run


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` with the column ``decoded``, the text of its ``ids``; null ids decode to null."""
    if "decoded" in encoded.columns:
        raise ValueError("decoded is the name of the result")
    return encoded.mapInArrow(_decode(model_file), StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
