"""Token blocks: exact round trip, code lengths, format."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beaconry.llm import tokens
from beaconry.llm.common import text_parts

FILE = public_tokenizers.path("word_bpe_49k.json")


def brute_huffman_bits(counts):
    """Total bits of an unlimited Huffman code."""
    import heapq

    heap = [int(c) for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    return total


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_lengths_are_optimal_and_complete(counts):
    counts = np.array(counts)
    lengths = tokens.code_lengths(counts, 30)
    used = counts > 0
    assert (lengths > 0).tolist() == used.tolist()
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
        assert int((lengths * counts).sum()) == brute_huffman_bits(counts)


def test_lengths_respect_limit():
    counts = np.array([2**i for i in range(30)])
    assert tokens.code_lengths(counts, 30).max() == 29
    limited = tokens.code_lengths(counts, 8)
    assert limited.max() == 8 and sum(2.0 ** -int(x) for x in limited) <= 1


@given(st.lists(st.integers(0, 300), min_size=1, max_size=1000))
@settings(max_examples=40, deadline=None)
def test_bits_round_trip(ids):
    ids = np.array(ids)
    code = tokens.Code(tokens.code_lengths(np.bincount(ids)))
    bits, offsets = code.encode(ids)
    assert code.decode(bits, offsets, len(ids)).tolist() == ids.tolist()
    assert len(offsets) == -(-len(ids) // tokens.CHECKPOINT)


TEXTS = ["", None, "The quick, BROWN fox's 123 1.5 naïve café ÉCOLE — é İstanbul Σίσυφος ΟΔΟΣ ß ﬁ", "x" * 3000,
         "a b\x1cc d <|endoftext|> e<|startoftext|>f", "日本語 テスト 😀😀 👩‍👩‍👧", "word, " * 40_000, "don't DON'T we'll |a| b| c.. d.,", "\t\n ", "a|b .x ,"]


def expect(rows):
    tok, out, at = Tokenizer.from_file(FILE), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("vocabulary", [49_408, 1 << 20])
def test_files_hold_exactly_what_the_tokenizer_says(docs, vocabulary):
    rows = [(100 - 7 * i, t) for i, t in enumerate(TEXTS)]
    got = tokens.tokens_round_trip(docs(*rows), FILE, 2, vocabulary)
    assert [tuple(r) for r in got.orderBy("start").collect()] == expect(rows)


def test_null_and_repeated_ids_empty_table(docs):
    rows = [(None, "a b"), (5, "c d e"), (5, "c d e"), (-3, "f")]
    got = [tuple(r) for r in tokens.tokens_round_trip(docs(*rows), FILE, 2, 49_408).orderBy("start").collect()]
    assert got == expect(rows)
    assert tokens.tokens_round_trip(docs(), FILE, 2, 49_408).count() == 0
    only_ends = [tuple(r) for r in tokens.tokens_round_trip(docs((1, ""), (2, None)), FILE, 2, 49_408).orderBy("start").collect()]
    assert only_ends == expect([(1, ""), (2, None)])


def test_small_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "_MEMO_WORDS", 5)
    memo, tok = tokens.WordMemo(FILE, "<u4"), Tokenizer.from_file(FILE)
    assert memo.short_way
    monkeypatch.setattr(tokens, "text_parts", lambda t: text_parts(t, 50))
    for got, text in zip(memo.ids(pa.array(TEXTS), b""), TEXTS):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids


@given(st.one_of(st.text(max_size=60), st.text("aÉß'stdmrvelx.|<>,_1²½\xa0\x85\x1c\x0b \n-", max_size=40)))
@settings(max_examples=600, deadline=None)
def test_any_text(text):
    memo = _memo()
    assert np.frombuffer(memo.ids(pa.array([text]), b"")[0], "<u4").tolist() == memo.tok.encode(text, add_special_tokens=False).ids


def _memo(held=[]):  # noqa: B006
    if not held:
        held.append(tokens.WordMemo(FILE, "<u4"))
    return held[0]
