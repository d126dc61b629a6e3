"""Batched Viterbi against one word at a time, and exact round trips."""

import zlib
from array import array

import public_tokenizers
import sentencepiece

from silolens.llm import pieces
from tests.llm.helpers import docs, odd_docs, texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
EXTRA = ["  two  spaces ", " ", "▁ mark ▁▁", "漢字 ﬁ Å \U0001f600", "a\tb\n\nc", "x" * 300, " " * 40 + "end", "null\0byte", "ends ", "<unk> <s> </s> <0x41>"]


def plain(text):
    """Best path over the whole text, one character at a time; on ties the shorter last piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    usable = {model.id_to_piece(i): (model.get_score(i), i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    unknown = min(s for s, _ in usable.values()) - pieces.UNKNOWN_PENALTY
    codes = ["▁" if c == " " else "\0none" if c == "▁" else c for c in " " + text]
    best = [(0.0, 0, None)]
    for end in range(1, len(codes) + 1):
        options = []
        for n in range(1, min(16, end) + 1):
            found = usable.get("".join(codes[end - n : end]))
            if found or n == 1:
                options.append((best[end - n][0] + (found[0] if found else unknown), -n, found[1] if found else None))
        best.append(max(options, key=lambda o: (o[0], o[1])))
    ids, at = [], len(codes)
    while at:
        _, n, i = best[at]
        ids = ([i] if i is not None else [model.piece_to_id(f"<0x{b:02X}>") for b in (" " + text)[at - 1].encode()]) + ids
        at += n
    return ids


def test_ids_equal_a_plain_search():
    model = pieces.load(MODEL)
    found = [t for t in [*texts()[:6], *EXTRA] if t]
    for text, ids in zip(found, pieces.encode_texts(found, model)):
        assert ids.tolist() == plain(text)


def test_round_trip(spark):
    found = [*texts(), *EXTRA]
    rows = {r.doc_id: r for r in pieces.decode(pieces.encode(docs(spark, found), MODEL), MODEL).collect()}
    for i, text in enumerate(found):
        assert rows[i].decoded == (text or "")
        assert rows[i].ids_crc32 == zlib.crc32(array("I", rows[i].ids).tobytes())


def test_odd_and_empty_tables(spark):
    frame = odd_docs(spark)
    assert pieces.encode(frame, MODEL).count() == frame.count()
    assert pieces.decode(pieces.encode(frame.where("false"), MODEL), MODEL).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(none, MODEL).first().decoded is None
