import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from aisleworks.llm.packing import ByteTokenizer, pack, pack_histogram, rank_ranges
from aisleworks.llm.token_counts import ChunkCounter, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.text(st.sampled_from(list("aAbthe rsnl'’ \n\t\x1c\x85éÉΣİß1½²!?<|>中🙂\u0301\u200b")), max_size=60)


COUNTER, IDS = ChunkCounter(WORDS), ByteTokenizer(BYTES)
SPECIAL = ["x <|endoftext|> y<|startoftext|>", "<|endoftext|><|endoftext|>", "aaaa aaa aa aaaaaaaa", "It's they'll   we've\n\n 12345"]


LIBRARY = {path: Tokenizer.from_file(path) for path in (WORDS, BYTES)}


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_and_ids_equal_the_library(text):
    assert COUNTER.count([text]) == [len(LIBRARY[WORDS].encode(text, add_special_tokens=False).ids)]
    assert IDS.ids(text) == LIBRARY[BYTES].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", SPECIAL)
def test_special_strings(text):
    assert COUNTER.count([text]) == [len(LIBRARY[WORDS].encode(text, add_special_tokens=False).ids)]
    assert IDS.ids(text) == LIBRARY[BYTES].encode(text, add_special_tokens=False).ids


def test_every_character_counts_as_in_the_library():
    """All code points, each between letters, counted through many rows of a few thousand characters."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 40_000):
        texts = [f"ab{chr(c)}cd" for c in points[begin : begin + 40_000]]
        expected = [len(e.ids) for e in LIBRARY[WORDS].encode_batch_fast(texts, add_special_tokens=False)]
        got = COUNTER.count(texts)
        assert got == expected, [(hex(ord(t[2])), g, e) for t, g, e in zip(texts, got, expected, strict=True) if g != e][:5]


def test_long_chunks_are_counted_and_not_kept():
    text = "w" * 100_000 + " short " + "é" * 5000
    assert COUNTER.count([text]) == [len(LIBRARY[WORDS].encode(text, add_special_tokens=False).ids)]
    assert "short" in COUNTER.kept and max(map(len, COUNTER.kept)) <= 48


def test_token_counts_of_awkward_rows(spark, docs, awkward):
    got = sorted(map(tuple, token_counts(docs(awkward), WORDS, limit=10).collect()), key=str)
    expected = []
    for doc_id, text in awkward:
        n = len(LIBRARY[WORDS].encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 10))
    assert got == sorted(expected, key=str)
    assert token_counts(docs([]), WORDS).count() == 0


def check_packing(rows, awkward, size=64):
    texts = defaultdict(list)
    for doc_id, text in awkward:
        texts[doc_id].append([*LIBRARY[BYTES].encode(text or "", add_special_tokens=False).ids, 0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = {
        doc_id: sorted(
            (start, len(ids[start : start + size]), zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes()), len(ids))
            for ids in several
            for start in range(0, len(ids), size)
        )
        for doc_id, several in texts.items()
    }
    assert {k: sorted(v) for k, v in pieces.items()} == expected
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sum(r["length"] for r in rows) / (size * len(sequences))


def test_packing_places_every_id_once(spark, docs, awkward):
    assert check_packing(pack(docs(awkward), BYTES, max_tokens=64).collect(), awkward) > 0.9
    assert pack(docs([]), BYTES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 400), max_size=30))
def test_patterns_use_every_length_as_often_as_it_occurs(counts):
    patterns = pack_histogram(counts, 50)
    used = defaultdict(int)
    for lengths, packs in patterns:
        assert sum(lengths) <= 50 and packs > 0
        for length in lengths:
            used[length] += packs
    assert dict(used) == {k: v for k, v in counts.items() if v}
    assert len(rank_ranges(patterns)["length"]) == sum(len(p) for p, _ in patterns)


def test_pieces_of_one_length_share_sequences():
    assert pack_histogram({100: 1000}, 1024) == [([100] * 10, 100)]
    assert sum(packs for _, packs in pack_histogram({1: 5000}, 1024)) == 5
    mixed = {100: 3000} | {n: 30 for n in range(50, 250)}
    tokens = sum(n * count for n, count in mixed.items())
    assert sum(packs for _, packs in pack_histogram(mixed, 1024)) * 1024 < 1.05 * tokens
