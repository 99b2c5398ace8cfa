"""The counting steps of the language-model scores: only the bytes they need, with the same numbers."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from loglake.llm import bit_model, lm_score


def test_triple_counts_take_two_bytes_before_only(monkeypatch):
    monkeypatch.setattr(bit_model, "keys", lambda *_: pytest.fail("triples need two bytes before, not five"))
    found, n = bit_model.triple_counts([b"abcab", b"", b"x", b"ab"])
    a, b, c, x, end = 0x61, 0x62, 0x63, 0x78, bit_model.END
    want = {a: 2, a << 8 | b: 2, a << 16 | b << 8 | c: 1, b << 16 | c << 8 | a: 1, c << 16 | a << 8 | b: 1,
            a << 16 | b << 8 | end: 2, end: 1, x: 1, x << 8 | end: 1}
    assert found.dtype == np.uint32
    assert dict(zip(found.tolist(), n.tolist(), strict=True)) == want


def test_token_hashes_are_signed_xxh64():
    words = [b"the", b"the", b"ab\xc3\xa9", b"x" * 300]
    want = [xxhash.xxh64_intdigest(w) - (1 << 63) for w in words] + [lm_score.END_TOKEN]
    assert lm_score.tokens(b" The  THE\tab\xc3\xa9 " + b"X" * 300 + b"\n").tolist() == want
    assert lm_score.tokens(b"").tolist() == [lm_score.END_TOKEN]
