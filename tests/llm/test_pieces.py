"""Pieces that are encoded together and apart get the library's ids, without work for each."""

from __future__ import annotations

import numpy as np

from lanewise.llm import token_files
from lanewise.llm.queries import tokenizer_file


def texts_of_pieces():
    plain = " ".join(f"word{k}" for k in range(3000))
    return [plain, "", "one", " two  three", "  ", "tab\tand\nline  end ", "é日本 naïve " + plain[:500], "x <|endoftext|> y", "again one"]


def test_ids_are_the_librarys(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    model, texts = Tokenizer.from_file(path), texts_of_pieces()
    wanted = [model.encode(t, add_special_tokens=False).ids for t in texts]
    for pieces in (1_000_000, 5):
        monkeypatch.setattr(token_files, "_LOADED", {})
        monkeypatch.setattr(token_files, "PIECES", pieces)
        ours = token_files.encoder(path)
        assert [x.tolist() for x in ours(texts)] == wanted
        assert [ours([t])[0].tolist() for t in texts] == wanted


def test_fresh_pieces_are_not_split_one_by_one(monkeypatch):
    def refuse(*_):
        raise AssertionError("an array for each piece")

    monkeypatch.setattr(np, "split", refuse)
    monkeypatch.setattr(token_files, "_LOADED", {})
    token_files.encoder(tokenizer_file("byte_bpe_50k.json"))(texts_of_pieces())
