"""The token store's own output against the library, text by text."""

import random
import zlib

import numpy as np
import tokenizers

from meterlark.llm import token_store
from meterlark.llm.queries import tokenizer_path

ODD = ["\0", "\0abc", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", " ", " ", "'s", "'ll", "it's", "x", "été", "日本", "\U0001f600", "12", "12345", "...", "<|endoftext|>", "é", "﻿", "the", "The"]


def _texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    fixed = ["abc x", "y \0abc", "\0abc", "", " ", "\n", " \0", "\0 \0"]
    return fixed + ["".join(rng.choice(ODD) + rng.choice(["", "", " ", " ", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_encoder_equals_library_on_random_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    mine, library = token_store.Encoder(path), tokenizers.Tokenizer.from_file(path)
    texts = _texts(5000, 5)
    for a in range(0, len(texts), 97):
        for text, ids in zip(texts[a : a + 97], mine.encode(texts[a : a + 97]), strict=True):
            assert np.frombuffer(ids, mine.kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_query_output_equals_library(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    texts = [*_texts(300, 6), None]
    rows = [(7 * i - 500, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    found = token_store.store_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, end_id=2).collect()
    library, start, expected = tokenizers.Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found) == expected


def test_library_encodes_each_piece_once_whatever_stands_around_it():
    """Symbols inside words, runs of white space and repetition cost the library nothing."""
    rng, path = random.Random(8), tokenizer_path("byte_bpe_50k.json")
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(8)) for _ in range(100)]
    texts = ["".join(f"{rng.choice(words)}{rng.choice(['', '.', ','])}{rng.choice([' ', ' ', chr(10)])}" for _ in range(300)) + "x  y\n\nz" for _ in range(60)]
    mine, library, seen = token_store.Encoder(path), tokenizers.Tokenizer.from_file(path), []
    call = mine._library
    mine._library = lambda some: seen.extend(map(len, some)) or call(some)
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, mine.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(seen) < 10_000 < sum(map(len, texts)) / 10


def test_long_pieces_are_encoded_and_not_remembered():
    path = tokenizer_path("byte_bpe_50k.json")
    mine, library = token_store.Encoder(path), tokenizers.Tokenizer.from_file(path)
    texts = ["日本" * 500, "a " + "é" * 3000 + " b", "short words only", "<|endoftext|>" + " x" * 100]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, mine.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, mine.memory)) < 100


def test_encoder_equals_library_on_wide_white_space_and_small_chunks(monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    mine, library = token_store.Encoder(path), tokenizers.Tokenizer.from_file(path)
    parts = ["\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\x1f", "\t", "\r\n", " ", " ", "\n", "a", "B.", "'s", "\xab", "\u2026", "\u3042", "12", "_x", ""]
    rng = random.Random(9)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(3000)]
    for chunk in (1, 50, 1 << 22):
        monkeypatch.setattr(token_store, "CHUNK", chunk)
        monkeypatch.setattr(token_store, "REMEMBERED", chunk)
        for text, ids in zip(texts, mine.encode(texts), strict=True):
            assert np.frombuffer(ids, mine.kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_chunk_of_new_pieces_does_not_outgrow_what_is_remembered(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 100)
    path = tokenizer_path("byte_bpe_50k.json")
    mine, library = token_store.Encoder(path), tokenizers.Tokenizer.from_file(path)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j)}" for i in range(500)) for j in range(4)]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, mine.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(mine.memory) <= 200 and len(mine.older) <= 200
