"""Ids by pieces against the library's own ids of whole texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

token_files = pytest.importorskip("sparkloom.llm.token_files")
queries = pytest.importorskip("sparkloom.llm.queries")


@pytest.mark.parametrize("cache", [0, 300_000])
def test_pieces_give_the_ids_of_whole_texts(cache, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", cache)
    monkeypatch.setattr(token_files, "JOINED", 7)
    words = token_files.WordTokens(queries.vocabulary("word_bpe_49k.json"))
    rng = random.Random(6)
    some = ["don't", "DON'T", "we'll've", "x's", "'s's", "ÀÉÎ", "ß", "Straße,", "été", "é!", "12ab34", "</w>", "a</w>b", "<|endoftext|>", "x<|startoftext|>y", "<|EndOfText|>", "日本語の文", "слово", "😀😀", "İstanbul", "a b", "x y", "\u0085", "_^`~", "a" * 3000, "\\1", "$1", "µm²", "10×5÷2"]
    texts = [None, "", " \n\t", *some]
    for _ in range(300):
        made = ["".join(rng.choice("abcXYZéÉ'sd0.9,-<|>/ẃ語") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 12))]
        texts.append(rng.choice(" \n\t\x0b\x0c").join([*made, *rng.sample(some, 2)]))
    want = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for at in (0, 5):  # slices of a column, too
        ids, counts = words.encode(pa.array(texts).slice(at))
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want[at:]
