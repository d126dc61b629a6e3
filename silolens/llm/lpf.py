"""Suffix-array deduplication of byte strings through longest-previous-factor arrays.

A byte goes if some 100-byte string over it also starts earlier: in a document
with a smaller id, or earlier in the same one. Suffixes that can share such a
string are brought together, put in suffix order, and each suffix's previous
and next smaller position in that order give its longest earlier match.

Which suffixes can match: every window of 100 bytes names its anchor, the
leftmost smallest hash among its 32-byte grams. Equal windows have equal
anchors, so suffix order is only needed among windows of one anchor.
Neighbouring windows with the same anchor travel as one block. Blocks of one
anchor that are equal throughout are one class of the order, whose first block
stands for it and whose later blocks are earlier matches over their whole
length; anchors with one class need no text. The first blocks of the other
anchors' classes fetch their bytes and are sorted. An anchor that very many
documents share sends its windows one by one, keyed by content, so its suffixes
spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from silolens.llm.common import fresh, runs, stored
from silolens.session import bounded_rows

WINDOW = 100
GRAM = 32
GRAMS = WINDOW - GRAM + 1
SEGMENT = 1 << 20
#: Anchors are counted in one of so many rows to find those to spread; this only balances the load.
SAMPLED = 32
HOT_FOUND = 64
HOT_MOST = 50_000
HOT_PARTS = 256
#: Windows sorted at a time.
FACTOR_WINDOWS = 100_000

_U = np.uint64
_BASE, _BACK = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BASE2, _BACK2 = _U(0xC2B2AE3D27D4EB4F), _U(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class _Hashes:
    """Prefix sums from which the hash of any substring of a buffer follows."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.letters = rng.integers(1, 1 << 64, (2, 256), dtype=_U)
        self.powers: list[np.ndarray] = []

    def grow(self, n: int) -> None:
        if not self.powers or len(self.powers[0]) <= n:
            self.powers = []
            for base in (_BASE, _BACK, _BASE2, _BACK2):
                p = np.full(n + 2, base, _U)
                p[0] = 1
                self.powers.append(np.cumprod(p, dtype=_U))

    def prefix(self, data: np.ndarray, which: int) -> np.ndarray:
        self.grow(len(data))
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.letters[which][data] * self.powers[2 * which][: len(data)], dtype=_U, out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.powers[2 * which + 1][start]

    def grams(self, sums: np.ndarray, which: int) -> np.ndarray:
        n = len(sums) - GRAM
        return (sums[GRAM:] - sums[:n]) * self.powers[2 * which + 1][:n]


def blocks(data: np.ndarray, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window, windows, anchor hash, block hash)."""
    windows = len(data) - WINDOW + 1
    if windows < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    sums = hashes.prefix(data, 0)
    gram = _mixed(hashes.grams(sums, 0))
    # the leftmost smallest gram of each window, from minima over blocks of one window's length in both directions
    n = len(gram)
    padded = np.full(-(-n // GRAMS) * GRAMS, ~_U(0))
    place = np.arange(len(padded)) % GRAMS
    padded[:n] = (gram >> _U(7) << _U(7))
    padded = (padded | place.astype(_U)).reshape(-1, GRAMS)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    first, last = np.arange(windows), np.arange(windows) + GRAMS - 1
    left, right = behind[first], ahead[last]
    take = (left >> _U(7)) <= (right >> _U(7))
    at = np.where(take, first - place[first] + (left & _U(127)).astype(np.int64), last - place[last] + (right & _U(127)).astype(np.int64))
    start, stop = runs(at)
    count = stop - start
    anchor = gram[at[start]]
    second = hashes.prefix(data, 1)
    whole = _mixed(hashes.between(second, start, stop - 1 + WINDOW, 1) ^ (count.astype(_U) * _U(0x9FB21C651E98DF25)))
    return start, count, anchor.view(np.int64), whole.view(np.int64)


def _document_blocks(data: np.ndarray, hashes: _Hashes) -> list[np.ndarray]:
    """``blocks`` of a whole document, in segments that overlap by one window."""
    parts = []
    for at in range(0, max(1, len(data) - WINDOW + 1), SEGMENT):
        start, count, anchor, whole = blocks(data[at : at + SEGMENT + WINDOW - 1], hashes)
        parts.append((start + at, count, anchor, whole))
    return [np.concatenate(x) for x in zip(*parts)]


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of byte ranges, as maximal runs in order of document and start."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    step = int(stop.max()) + 2
    lane = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    reach = np.maximum.accumulate(stop + lane * step)
    new = np.concatenate([[True], (start + lane * step)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - lane[last] * step


COVER, BLOCK, WANTED, BYTES = 0, 1, 2, 3
ROWS = "kind byte, part long, anchor long, whole long, d long, tie long, start long, n long"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _rows(kind: int, part, anchor, whole, d, tie, start, n) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(d), kind, np.int8))] + [pa.array(np.asarray(x, np.int64)) for x in (part, anchor, whole, d, tie, start, n)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _cover_rows(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, d: np.ndarray, tie: np.ndarray) -> pa.RecordBatch:
    doc, start, stop = merged(doc, start, stop)
    return _rows(COVER, d[doc] * 31 + start, np.zeros(len(doc)), np.zeros(len(doc)), d[doc], tie[doc], start, stop - start)


def _batch_order(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of a batch in order; of rows that are one document, one."""
    d, tie = batch.column("d").to_numpy(), batch.column("tie").to_numpy()
    order = np.lexsort((tie, d))
    again = (d[order][1:] == d[order][:-1]) & (tie[order][1:] == tie[order][:-1])
    return d, tie, order[np.concatenate([[True], ~again])] if len(order) else order


def _bytes_of(cell: pa.Scalar) -> np.ndarray:
    value = cell.as_buffer()
    return np.frombuffer(value, np.uint8) if value is not None and value.size else np.zeros(0, np.uint8)


def _cut(hot: np.ndarray):
    """Documents to blocks. Of blocks that a batch repeats, the first goes on; the later ones are covered already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            d, tie, order = _batch_order(batch)
            found = [(np.full(len(x[0]), i), *x) for i in order for x in [_document_blocks(_bytes_of(batch.column("text")[int(i)]), hashes)] if len(x[0])]
            if not found:
                continue
            doc, start, count, anchor, whole = (np.concatenate(x) for x in zip(*found))
            rank = np.argsort(_mixed(anchor.view(_U)) + whole.view(_U), kind="stable")  # ties stay in order of position
            a, w = anchor[rank], whole[rank]
            again = np.concatenate([[False], (a[1:] == a[:-1]) & (w[1:] == w[:-1])])
            late = rank[again]
            if len(late):
                yield _cover_rows(doc[late], start[late], start[late] + count[late] - 1 + WINDOW, d, tie)
            kept = np.sort(rank[~again])
            doc, start, count, anchor, whole = (x[kept] for x in (doc, start, count, anchor, whole))
            part = np.where(np.isin(anchor, hot), _mixed((anchor ^ (whole & (HOT_PARTS - 1)) * 0x5851F42D4C957F2D).view(_U)).view(np.int64), anchor) if len(hot) else anchor
            yield _rows(BLOCK, part, anchor, whole, d[doc], tie[doc], start, count)
    return run


def _sampled_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        for cell in batch.column(0):
            anchor = np.unique(_document_blocks(_bytes_of(cell), hashes)[2])
            if len(anchor):
                yield pa.RecordBatch.from_arrays([pa.array(anchor)], names=["anchor"])


def hot_anchors(docs: DataFrame, text: Column) -> np.ndarray:
    """Anchors to spread: at most ``HOT_MOST``, found in a sample of rows. Results do not depend on them.

    Rows are sampled by their place, not by their text, so copies of one text count like any other rows.
    """
    sample = docs.select(text.alias("text"), F.monotonically_increasing_id().alias("at"))
    sample = sample.where(F.pmod(F.xxhash64("at"), F.lit(SAMPLED)) == 0).select("text")
    counts = stored(sample.mapInArrow(_sampled_anchors, "anchor long").groupBy("anchor").count().where(f"count >= {HOT_FOUND // 8}"), "anchors")
    total = counts.agg(F.sum("count")).first()[0] or 0
    rows = counts.where(f"count >= {max(HOT_FOUND, total // HOT_MOST)}").select("anchor").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64))


def _classes(hot: np.ndarray):
    """Blocks sorted by anchor, hash and position: covers for later members of a class, wanted first members.

    Batches stream: of what came before, only the first block of the last class
    is held, so a class may have any number of members.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = None, False  # the last class's first block, and whether it is already wanted
        for chunk in batches:
            col = {n: chunk.column(n).to_numpy() for n in _NAMES}
            cover = col["kind"] == COVER
            if cover.any():
                yield _rows(COVER, *(col[n][cover] for n in _NAMES[1:]))
            rows = [col[x][~cover] for x in _NAMES[2:]]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            anchor, whole, d, tie, start, n = rows
            new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            first = new_anchor | np.concatenate([[True], whole[1:] != whole[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            # rows that are one document give the same block twice
            late = (d != d[head]) | (tie != tie[head]) | (start != start[head])
            zero = np.zeros(late.sum(), np.int64)
            yield _rows(COVER, zero, zero, zero, d[late], tie[late], start[late], n[late] - 1 + WINDOW)
            group = np.cumsum(new_anchor) - 1
            several = np.bincount(group[first], minlength=group[-1] + 1) > 1
            spread = np.isin(anchor, hot)
            wanted = first & (several[group] | spread)
            known = np.zeros(len(first), bool)
            known[0] = held is not None and told
            last = head[-1]
            told = bool(wanted[last] or known[last])
            held = [x[last : last + 1] for x in rows]
            wanted &= ~known
            yield _rows(WANTED, spread[wanted], anchor[wanted], whole[wanted], d[wanted], tie[wanted], start[wanted], n[wanted])
    return run


STRINGS = "part long, d long, tie long, start long, n long, data binary"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their wanted blocks to rows with the blocks' bytes; those of spread anchors window by window.

    Windows of spread anchors that the batch holds earlier are covered already:
    runs of them are rows of minus as many windows, without bytes, and go anywhere.
    """
    names = [c.split()[0] for c in STRINGS.split(", ")]
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            d, tie, order = _batch_order(batch)
            rows: list[tuple] = []
            seen: set[bytes] = set()
            for i in order.tolist():
                data = batch.column("text")[i].as_buffer()
                data = data.to_pybytes() if data is not None else b""
                for w in sorted(batch.column("wanted")[i].as_py(), key=lambda w: w["start"]):
                    start, n = w["start"], w["n"]
                    if not w["spread"]:
                        rows.append((w["anchor"], d[i], tie[i], start, n, data[start : start + n - 1 + WINDOW]))
                        continue
                    for at in range(start, start + n):
                        string = data[at : at + WINDOW]
                        if string not in seen:
                            seen.add(string)
                            key = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
                            rows.append((key, d[i], tie[i], at, 1, string))
                        elif at > start and rows[-1][4] < 0:
                            rows[-1] = (*rows[-1][:4], rows[-1][4] - 1, b"")
                        else:
                            rows.append((0, d[i], tie[i], at, -1, b""))
            columns = list(zip(*rows)) or [[]] * 6
            part, ds, ties, starts, ns = (np.array(c, np.int64) for c in columns[:5])
            part = np.where(ns < 0, _mixed((ds * 31 + starts).view(_U)).view(np.int64), part)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in (part, ds, ties, starts, ns)], pa.array(columns[5], pa.binary())], names=names)


def nearest_smaller(position: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each, -1 if none: all skip ahead together, twice as far each time."""
    near = np.arange(len(position)) - 1
    while True:
        bad = np.flatnonzero((near >= 0) & (position[near] > position))
        if not len(bad):
            return near
        near[bad] = near[near[bad]]


def longest_previous(windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Longest earlier match of each row of ``windows`` (bytes, one suffix a row), from its neighbours in suffix order.

    Suffixes are ordered as far as the window is long, equal ones by position;
    matches are measured to that depth.
    """
    order = np.lexsort((position, windows.view(f"S{windows.shape[1]}").ravel()))
    w, p = windows[order], position[order]
    before = nearest_smaller(p)
    after = len(p) - 1 - nearest_smaller(p[::-1])[::-1]
    best = np.zeros(len(p), np.int64)
    for near, none in ((before, -1), (after, len(p))):
        some = np.flatnonzero(near != none)
        differs = w[some] != w[near[some]]
        length = np.where(differs.any(axis=1), differs.argmax(axis=1), w.shape[1])
        best[some] = np.maximum(best[some], length)
    out = np.empty(len(p), np.int64)
    out[order] = best
    return out


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' bytes sorted by anchor and position: byte ranges of windows whose longest previous factor fills the window.

    About ``FACTOR_WINDOWS`` windows at a time. An anchor that goes on takes
    along its windows without an earlier match: a later window that equals any
    earlier one equals one of them. Windows of a spread anchor meet by content,
    so there it is one window, however many rows share it.
    """
    held = before = None
    for batch in batches:
        windows = np.concatenate([[0], np.cumsum(np.maximum(batch.column("n").to_numpy(), 0))])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(windows, windows[lo] + FACTOR_WINDOWS, side="right")) - 1)
            rows, lo = batch.slice(lo, hi - lo), hi
            n = rows.column("n").to_numpy()
            ident = np.stack([rows.column(c).to_numpy() for c in ("part", "d", "tie", "start")])
            # rows that are one document give the same block twice
            again = (ident == np.concatenate([~ident[:, :1] if before is None else before, ident[:, :-1]], axis=1)).all(axis=0)
            before = ident[:, -1:]
            live = rows.filter(pa.array((n > 0) & ~again))
            found = [rows.filter(pa.array(n < 0)), *([held] if held is not None else []), live]
            out, kept = _factor_part(pa.Table.from_batches(found).combine_chunks())
            held = kept if live.num_rows else held
            if out.num_rows:
                yield out


def _factor_part(chunk: pa.Table) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """Ranges to remove, and the last anchor's windows without an earlier match. Rows of an anchor come by position."""
    part, d, tie, start, n = (chunk.column(c).to_numpy() for c in ("part", "d", "tie", "start", "n"))
    order = np.lexsort((tie, d))
    moved = (d[order][1:] != d[order][:-1]) | (tie[order][1:] != tie[order][:-1])
    doc = np.empty(len(order), np.int64)
    doc[order] = np.concatenate([[0], np.cumsum(moved)])
    done = np.flatnonzero(n < 0)
    hits = [(doc[done], start[done], start[done] - n[done] - 1 + WINDOW)]
    kept = None
    n = np.maximum(n, 0)
    row = np.repeat(np.arange(len(n)), n)
    if len(row):
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        strings = chunk.column("data").to_pylist()
        buffer = np.frombuffer(b"".join(strings), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(x) for x in strings])[:-1]]).astype(np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(buffer, WINDOW)[base[row] + inner]
        late = longest_previous(windows, np.arange(len(row))) >= WINDOW
        at = start[row] + inner
        hits.append((doc[row[late]], at[late], at[late] + WINDOW))
        first = np.flatnonzero(~late & (part[row] == part[-1]))
        data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WINDOW), len(first), [None, pa.py_buffer(windows[first].tobytes())]).cast(pa.binary())
        mine = row[first]
        kept = pa.RecordBatch.from_arrays([*[pa.array(x) for x in (part[mine], d[mine], tie[mine], at[first], np.ones(len(first), np.int64))], data], schema=chunk.schema)
    who, lo, hi = merged(*(np.concatenate(x) for x in zip(*hits)))
    back = np.zeros(len(doc), np.int64)
    back[doc] = np.arange(len(doc))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[back[who]], tie[back[who]], lo, hi - lo)], names=["d", "tie", "start", "n"]), kept


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """The order of documents as two numbers: the id (nulls last), and among rows that share one the text's hash."""
    ident = F.col(id_col).cast("long")
    shared = stored(docs.groupBy(ident.alias("i")).count().where("count > 1 OR i IS NULL").select("i"), "shared_ids")
    d = F.coalesce(ident, F.lit((1 << 63) - 1))
    few = bounded_rows(shared, 1000)
    if few is not None and not few:
        return d, F.lit(0).cast("long")
    return d, F.xxhash64(F.isnull(ident), F.coalesce(F.col(text_col), F.lit("")))


def _apply(n_columns: int, as_text: bool, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sizes, texts = [], [], [], []
            for cell, cuts in zip(batch.column(text_at), batch.column(batch.num_columns - 1)):
                data = cell.as_buffer()
                data = data.to_pybytes() if data is not None else b""
                cuts = cuts.as_py() or []
                lo = np.array([c["start"] for c in cuts], np.int64)
                _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, lo + np.array([c["n"] for c in cuts], np.int64))
                edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if len(lo) else data
                spans.append([{"start": a, "stop": b} for a, b in zip(lo.tolist(), hi.tolist())])
                kept.append(rest)
                sizes.append(len(data))
                texts.append(cell.as_py() if not len(lo) else rest.decode(errors="ignore"))
            columns = [batch.column(i) for i in range(n_columns)]
            names = batch.schema.names[:n_columns]
            if as_text:
                columns[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)
            else:
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "spans", "kept"])
    return run


def removals(docs: DataFrame, d: Column, tie: Column, text_col: str) -> DataFrame:
    """``d, tie, start, n``: byte ranges to remove; their union over a document is the result."""
    text = F.col(text_col)
    hot = hot_anchors(docs, text)
    slim = docs.select(d.alias("d"), tie.alias("tie"), text.alias("text"))
    blocks_ = slim.mapInArrow(_cut(hot), ROWS).repartition("part").sortWithinPartitions("anchor", "whole", "d", "tie", "start")
    found = stored(blocks_.mapInArrow(_classes(hot), ROWS), "blocks")
    covers = found.where(f"kind = {COVER}").select("d", "tie", "start", "n")
    wanted = found.where(f"kind = {WANTED}").groupBy("d", "tie").agg(F.collect_list(F.expr("struct(anchor, start, n, part = 1 AS spread)")).alias("wanted"))
    strings = slim.join(wanted, ["d", "tie"]).select("d", "tie", "text", "wanted").mapInArrow(_strings, STRINGS)
    factors = strings.repartition("part").sortWithinPartitions("part", "d", "tie", "start").mapInArrow(_factor, "d long, tie long, start long, n long")
    return covers.union(factors)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``spans`` (removed byte ranges) and ``kept`` (the bytes that stay).

    With ``as_text`` the columns are those of ``docs`` alone and the text is
    replaced by what stays, without characters that a cut broke. Texts count as
    UTF-8; null and empty ones and those under 100 bytes lose nothing (a null
    text stays null). Null ids come after all others. Rows that share an id are
    ordered by a hash of their text; rows that share both are one document, so
    neither loses text to the other. Very long texts are cut in overlapping
    segments, which does not change the result. An empty table gives an empty
    result. Other columns are kept as they are.
    """
    if not as_text and {"n_bytes", "spans", "kept"} & {c.lower() for c in docs.columns}:
        raise ValueError("n_bytes, spans and kept are names of the result")
    d, tie = _keyed(docs, id_col, text_col)
    cuts = stored(removals(docs, d, tie, text_col), "removals").groupBy("d", "tie").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    low, high, last = fresh(docs, "low"), fresh(docs, "high"), fresh(docs, "cuts")
    rows = docs.withColumn(low, d).withColumn(high, tie)
    met = rows.join(cuts.selectExpr(f"d AS {low}", f"tie AS {high}", f"cuts AS {last}"), [low, high], "left")
    met = met.select(*[F.col(f"`{c}`") for c in docs.columns], last)
    fields = list(docs.schema.fields)
    if not as_text:
        span = StructType([StructField("start", LongType()), StructField("stop", LongType())])
        fields += [StructField("n_bytes", LongType()), StructField("spans", ArrayType(span)), StructField("kept", BinaryType())]
    schema = StructType([StructField(f.name, f.dataType, True) for f in fields])
    return met.mapInArrow(_apply(len(docs.columns), as_text, docs.columns.index(text_col)), schema)
