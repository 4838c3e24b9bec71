"""The methods against brute force, the library and round trips."""

import random

import numpy as np
import pytest
import tokenizers

from meterlark.llm import line_dedup, minhash, token_store
from meterlark.llm.bpe_automaton import TokenAutomaton
from meterlark.llm.queries import tokenizer_path

WORDS = ["aaa", "aaaaaaa", "it's", "don't", "été", "日本語", "===", "!!!!!!", "hello,", "12345", "ΣΑΣ", "<|startoftext|>x", "a\x1cb"]


def test_automaton_equals_library():
    path = tokenizer_path("word_bpe_49k.json")
    mine, library, rng = TokenAutomaton(path), tokenizers.Tokenizer.from_file(path), random.Random(3)
    words = WORDS + ["".join(rng.choice("etaoinshrdlu'-e") for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    for word in words:
        ids, shown = mine.encode(word)
        expected = library.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, word
        assert shown == library.decode(expected, skip_special_tokens=False) == mine.decode(np.array(expected))


def test_encoder_equals_library():
    path = tokenizer_path("byte_bpe_50k.json")
    mine, library = token_store.Encoder(path), tokenizers.Tokenizer.from_file(path)
    for text in ["", "a b", " a", "a ", "a\nb", "\na", "a\n", "a  b", "a \n b", "\t x\ty", "x\r\ny", "it's <|endoftext|> ok", "\x00 a\nb c", "日本 語\n\U0001f600", " 's don't\n'll"]:
        assert np.frombuffer(mine.encode([text])[0], mine.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_perfect_hash_is_minimal():
    n = 20_000
    keys = token_store.key_hash(np.arange(n), np.zeros(n, int))
    index = token_store.Index.from_bytes(token_store.Index.build(keys, np.arange(n), np.arange(n) * 3, np.arange(n) % 7).to_bytes())
    assert sorted(index.function.slots(keys)) == list(range(n))
    found, shard, offset, length = index.lookup(keys)
    assert found.all() and (shard == np.arange(n)).all() and (offset == 3 * np.arange(n)).all() and (length == np.arange(n) % 7).all()
    assert index.lookup(token_store.key_hash(np.arange(n) + n, np.zeros(n, int)))[0].sum() <= 1


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (1, 3, 50, 4000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: max(1, int(0.8 * len(a)))], rng.integers(0, 2**63, size // 8, dtype=np.uint64))))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = np.mean(minhash.sketch(a, 240) == minhash.sketch(b, 240))
        assert abs(same - true) < 0.15


def test_ranges_of_a_filter_stay_small():
    """What a task holds is bounded at every size of the text; places go beyond 32 bits and come back."""
    rng = np.random.default_rng(8)
    hashes = np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    for text_bytes in (0, 10**6, 30 * 10**9, 10**12, 10**13, 10**14):
        layout = line_dedup.Layout(text_bytes)
        assert layout.ranges << layout.shift == layout.bits and text_bytes <= 8 * layout.bits and layout.shift <= 24
        places = np.unique(layout.places(hashes))
        assert 0 <= places.min() and places.max() < layout.bits and (places.max() > 2**32) == (text_bytes >= 10**12)
        cut = line_dedup._cut_ranges(places, layout.shift)
        back = np.concatenate([(at << layout.shift) + line_dedup._positions(cut[at]) for at in sorted(cut)])
        assert (back == places).all()
    assert line_dedup.Layout(30 * 10**9).shift == line_dedup.Layout(10**14).shift
    with pytest.raises(ValueError):
        line_dedup._packed(np.array([5, 2**33 + 12]))


def test_twice_seen_filter_misses_no_repeat(tmp_path):
    """Partial filters of several tasks, carried together: every key that two documents hold is found, few others are."""
    rng = np.random.default_rng(2)
    single, shared, inside = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (20_000, 3_000, 500))
    tasks = [np.concatenate((single[i::4], shared[i % 2 :: 2], np.repeat(inside, 2) if i == 3 else single[:0])) for i in range(4)]
    layout = line_dedup.Layout(20_000 * 100)
    ranges = {}
    for hashes in tasks:
        for at, once, twice in line_dedup.partial_filters(hashes, layout):
            ranges.setdefault(at, []).append((once, twice))
    for at, parts in ranges.items():
        (tmp_path / f"twice-{at:04d}.bits").write_bytes(line_dedup.carry(iter(parts), layout.shift).tobytes())
    seen = line_dedup.TwiceSeen(str(tmp_path), layout)
    assert seen.repeated(shared).all() and seen.repeated(inside).all()
    assert seen.repeated(single).mean() < 0.06
    assert not line_dedup.TwiceSeen(str(tmp_path / "none"), layout).repeated(single).any()
