"""The cached word tokenizer: ids as the tokenizer's own, one lookup for each known word."""

from __future__ import annotations

import numpy as np

from tabforge.llm import packing
from tabforge.llm.queries import tokenizer_path

TEXTS = ["İstanbul İ. kemal", "a.b.c 12,5 ##a## don't. x's's", None, "", "  ", "café, CAFÉ! ab cd ab.", "x<|endoftext|>y",
         "\x1c a\x1cb ...", "中文. ŉ. ŉ"]


def test_ids_are_the_tokenizers(monkeypatch):
    tok = packing.WordTokenizer(tokenizer_path())
    plain = [np.asarray(tok.tok.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in TEXTS]
    for most in (packing.CACHE_WORDS, 5, 1):  # small: the cache starts anew with each batch
        monkeypatch.setattr(packing, "CACHE_WORDS", most)
        assert tok.batch(TEXTS) == plain
        assert [tok.batch([t])[0] for t in TEXTS] == plain


def test_known_words_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += a[0] == b"the"
            return super().get(*a)

    tok = packing.WordTokenizer(tokenizer_path())
    tok.batch(["the"])
    tok.cache = Counted(tok.cache)
    tok.batch(["the the new the", "the"])
    assert Counted.asked == 4
