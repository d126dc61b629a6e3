"""Alignment of two tokenizers against a token-by-token walk."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from silolens.llm import align
from tests.llm.helpers import docs as given_docs, odd_docs, texts

FILES = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def byte_of():
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1]), byte_of()


def tokens(text, libraries):
    """[(id, end)] of either side, or None."""
    a, b, back = libraries
    if not text:
        return None
    sides = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    sides.append([(i, bytes(back[c] for c in a.id_to_token(i))) for i in ids])
    ids = b.encode(text, out_type=int)
    sides.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids])
    out = []
    for side in sides:
        if b"".join(t for _, t in side) != (" " + text).encode():
            return None
        end, placed = 0, []
        for i, t in side:
            end += len(t)
            placed.append((i, end))
        out.append(placed)
    return out


def plain(found, libraries):
    walked = [tokens(t, libraries) for t in found]
    links = []
    for sides in walked:
        links.append([(i, j) for i, e in sides[0] for j, f in sides[1] if e == f] if sides and len(sides[0]) < 300 else
                     [(i, ends[e]) for ends in [{f: j for j, f in sides[1]}] for i, e in sides[0] if e in ends] if sides else [])
    count = Counter(x for each in links for x in each)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for sides, each in zip(walked, links):
        if not sides:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, e in sides[0]} & {f for _, f in sides[1]})
        spelled = []
        ends = [[e for _, e in s] for s in sides]
        at = [0, 0]
        for cut in cuts:
            parts = []
            for k in (0, 1):
                past = ends[k].index(cut, at[k]) + 1
                parts.append(",".join(str(i) for i, _ in sides[k][at[k]:past]))
                at[k] = past
            spelled.append("|".join(parts))
        assert cuts[-1] == ends[0][-1] == ends[1][-1]
        out.append((len(sides[0]), len(sides[1]), len(cuts), len(each), sum(count[x] == best[x[1]] for x in each), sum(count[x] for x in each), hashlib.sha256(";".join(spelled).encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    return ["The quick brown fox", "  two  spaces ", "<|endoftext|> <s> <unk> </s>", "a▁b", "tab\tand\nline\r\n", "\u0000nul", "é" * 30, "日本語のテキスト 😀😀", "é ﬁ ① Ⅳ",
            " non breaking", "1234567890 3.14", "don't we'll", " ", "\n", "x", "﻿bom", "<0x41> <0x0A>", "ÀÉÎõü ß", "▁", "word " * 2000]


def test_alignment_equals_a_walk(spark, libraries):
    found = texts() + odd_texts()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(given_docs(spark, found), *FILES).collect()}
    assert got == dict(enumerate(plain(found, libraries)))
    assert sum(v[0] == 0 for v in got.values()) >= 3  # null, empty, and a text that comes back otherwise


def test_blocks_of_pairs_and_long_chunks(spark, libraries, monkeypatch):
    found = texts(2)
    monkeypatch.setattr(align, "CHUNK_BYTES", 500)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(given_docs(spark, found), *FILES, pair_block=300).collect()}
    assert got == dict(enumerate(plain(found, libraries)))


def test_odd_rows_and_no_rank_file(spark, libraries):
    docs = odd_docs(spark)
    rows = docs.collect()
    got = align.align(docs, *FILES[:2]).collect()
    want = [(r.doc_id, *v) for r, v in zip(rows, plain([r.text for r in rows], libraries))]
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_tables_and_tables_without_tokens(spark):
    assert align.align(given_docs(spark, []), *FILES).collect() == []
    got = align.align(given_docs(spark, ["", None]), *FILES).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_groups_hold_every_token_once(spark, libraries):
    found = texts(3)[:20] + odd_texts()
    for r in align.groups(given_docs(spark, found), *FILES).collect():
        sides = tokens(found[r.doc_id], libraries)
        assert [r.a_ids, r.b_ids] == ([[i for i, _ in s] for s in sides] if sides else [[], []])
        assert len(r.a_ends) == len(r.b_ends) and (not sides or (r.a_ends[-1], r.b_ends[-1]) == (len(r.a_ids), len(r.b_ids)))
        if sides:
            assert [sides[0][k - 1][1] for k in r.a_ends] == [sides[1][k - 1][1] for k in r.b_ends]
