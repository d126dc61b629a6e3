"""Packing against the tokenizer itself."""

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from silolens.llm import packing
from tests.llm.helpers import docs, odd_docs, texts

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(rows, found):
    """Every id of every document lies in one piece; sequences are gapless and never padded."""
    own = Tokenizer.from_file(VOCABULARY)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in found.items():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == pieces[0].tier <= 2048 and at & (at - 1) == 0


@pytest.mark.parametrize("group", [5000, 1 << 21])
def test_pieces_cover_documents(spark, group):
    found = [*texts(), "a  b", "tail ", " head", "x<|endoftext|>y", "tab\t\tb", "it's\nI'll"]
    rows = packing.pack(docs(spark, found), VOCABULARY, RANKS, group_tokens=group).collect()
    check(rows, dict(enumerate(found)))


def test_rank_file_changes_nothing(spark):
    a = packing.pack(docs(spark).coalesce(1), VOCABULARY, RANKS).collect()
    assert a == packing.pack(docs(spark).coalesce(1), VOCABULARY).collect()


def test_ids_are_returned(spark):
    for r in packing.pack(docs(spark), VOCABULARY, RANKS, with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_odd_and_empty_tables(spark):
    frame = odd_docs(spark)
    rows = packing.pack(frame, VOCABULARY, RANKS).collect()
    assert sum(r.start == 0 for r in rows) == frame.count()
    assert packing.pack(frame.where("false"), VOCABULARY, RANKS).count() == 0


def test_tiers_and_steps():
    rng = random.Random(3)
    lengths = [rng.randint(1, 5000) for _ in range(300)] + [2048, 4096, 1, 1024]
    sequences = packing.pack_lengths(lengths)
    assert sum(p[0] for s in sequences for p in s) == sum(lengths)
    sizes = [sum(p[0] for p in s) for s in sequences]
    assert sum(x not in packing.TIERS for x in sizes) <= 11
    assert packing.pack_lengths([]) == []
    with pytest.raises(ValueError):
        packing.pack(None, VOCABULARY, tiers=(3,))


def test_steps_are_balanced(spark):
    rows = packing.pack(docs(spark, texts() * 30).coalesce(1), VOCABULARY, RANKS, step_tokens=1 << 13).collect()
    load = defaultdict(int)
    for r in rows:
        load[r.step_id] += r.length
    assert len(load) > 4 and max(load.values()) - min(load.values()) <= 2048
