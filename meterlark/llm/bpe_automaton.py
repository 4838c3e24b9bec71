"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts as one state with a loop for every base symbol, and each merge
(a, b) -> c in rank order is applied as a gadget: the state that a leads to is split, the copy loses its
arc b, and a new arc c bypasses the pair, leading where b led. All arcs of one label lead to the same state,
so the result is deterministic and accepts exactly the token sequences that BPE produces; every prefix of
an accepted sequence is accepted, so each position of a word is reached by at most one token.

States keep only what they lost, label -> time of the loss, copied at a split. An arc is absent if its label
was lost, or if a label at the left end of it was lost before the label was built from it. The answers fill
a transition table.

Words are the pre-split pieces of the tokenizer file (NFC, white space, lower case, the split pattern). A
word is encoded by running the table over its substrings; decoding emits the labels of the arcs.

Defined results: null text counts as empty (no tokens, empty decoded text); rows that repeat a doc_id each
come out; strings of special tokens in a text are those tokens, as the library treats them by default;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from meterlark.llm.common import keyed, unkeyed

#: Chunks of text whose tokens a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 250_000
NEVER = 1 << 60
#: Stands for the end of a word in the table of substrings.
END = "\0"


class TokenAutomaton:
    """Compiled once for each worker from a tokenizer file; it is a pure function of that file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.labels: dict[int, str] = {i: s for s, i in self.vocab.items()}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels.update({i: s for s, i in self.special.items()})
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.byte_symbol = _byte_symbols()
        self._compile([tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])
        self.table: dict[int, bool] = {}  # state << 20 | label -> whether the arc is there
        self.trie: dict = {}
        for label, i in self.vocab.items():
            node = self.trie
            for c in label.removesuffix(self.suffix) if self.suffix else label:
                node = node.setdefault(c, {})
            if self.suffix and label.endswith(self.suffix):
                node = node.setdefault(END, {})
            node[""] = i
        self.words: dict[str, list[int]] = {}
        self.memory: dict[str, tuple[bytes, str]] = {}

    def _compile(self, merges: list[tuple[str, str]]) -> None:
        vocab = self.vocab
        self.target = target = dict.fromkeys(vocab.values(), 0)  # label -> state
        self.lost: list[dict[int, int]] = [{}]  # of each state: label -> time of the loss
        self.left: dict[int, int] = {}  # label -> label at its left end
        self.built: dict[int, int] = {}  # label -> time
        shared = [len(target)]  # labels that lead to a state
        for time, (a, b) in enumerate(merges):
            la, lb, lc = vocab[a], vocab[b], vocab[a + b]
            state, after = target[la], target[lb]
            if shared[state] > 1 or la == lb:  # split, or the other labels would lose the arc too
                self.lost.append(self.lost[state].copy())
                shared[state] -= 1
                shared.append(1)
                target[la] = state = len(self.lost) - 1
            self.lost[state].setdefault(lb, time)
            shared[target[lc]] -= 1
            target[lc] = after
            shared[after] += 1
            self.left[lc], self.built[lc] = la, time

    def _has_arc(self, state: int, label: int) -> bool:
        lost, left, built = self.lost[state], self.left, self.built
        before = NEVER
        while True:
            if lost.get(label, NEVER) <= before and label in lost:
                return False
            if label not in left:
                return True
            before, label = min(before, built[label]), left[label]

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-split word, already lower-cased.

        The longest arc is tried first. As a position is reached by one token at most, a position that
        leads nowhere is never entered again.
        """
        text = (word if word.isascii() and word.isprintable() else "".join([self.byte_symbol[b] for b in word.encode("utf-8")])) + END
        n, root, table, target = len(text), self.trie, self.table, self.target
        path: list[int] = []
        open_arcs: list[list[tuple[int, int]]] = []  # of each position on the path, what is left to try
        dead, ends = set(), []
        i, state = 0, 0
        while True:
            node, j, found = root, i, []
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                label = node.get("")
                if label is not None and j != n - 1:
                    found.append((j, label))
            open_arcs.append(found)
            while True:
                found = open_arcs[-1]
                while found:
                    j, label = found.pop()
                    if j in dead:
                        continue
                    key = state << 20 | label
                    arc = table.get(key)
                    if arc is None:
                        arc = table[key] = state == 0 or self._has_arc(state, label)
                    if arc:
                        break
                else:  # nothing leads on from here
                    dead.add(i)
                    open_arcs.pop()
                    path.pop()
                    i, state = ends.pop(), target[path[-1]] if path else 0
                    continue
                break
            path.append(label)
            if j == n:
                return path
            ends.append(i)
            i, state = j, target[label]

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.split.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # Lower-casing is by letter: the library does not look at what follows a sigma.
        return self.split.findall(text.replace("Σ", "σ").lower())

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, labels joined by one space) of a whole text."""
        if self.special_split is not None and "<|" in text and self.special_split.search(text):
            ids: list[bytes] = []
            shown: list[str] = []
            for part in self.special_split.split(text):
                if part in self.special:
                    ids.append(np.uint32(self.special[part]).tobytes())
                    shown.append(part)
                elif part:
                    a, b = self._plain(part)
                    ids.append(a)
                    shown += [b] if b else []
            return b"".join(ids), " ".join(shown)
        return self._plain(text)

    def _plain(self, text: str) -> tuple[bytes, str]:
        # Pieces never span white space, so chunks between it are encoded once and remembered. Python also
        # splits at \x1c-\x1f, which the pattern counts as symbols.
        chunks = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else regex.split(r"\s+", text)
        memory, labels = self.memory, self.labels
        if len(memory) > REMEMBERED:
            memory.clear()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        ids, shown = [], []
        for chunk in chunks:
            known = memory.get(chunk)
            if known is None:
                tokens = []
                for piece in self.pieces(chunk):
                    word = self.words.get(piece)
                    if word is None:
                        word = self.words[piece] = self.encode_word(piece)
                    tokens += word
                known = memory[chunk] = (array("I", tokens).tobytes(), " ".join([labels[t] for t in tokens]))
            if known[0]:
                ids.append(known[0])
                shown.append(known[1])
        return b"".join(ids), " ".join(shown)

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, in order, joined by one space as the library does without a decoder."""
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return out


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids as an array: one row for each row of docs."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TokenAutomaton(path)  # compiled in less than a second, and gone with the task
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                counts, a, b, arrays = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids, _ = bpe.encode(text)
                    shown = bpe.decode(np.frombuffer(ids, dtype="<u4"))
                    counts.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(shown.encode("utf-8")).hexdigest())
                    if with_ids:
                        arrays.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(arrays, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return unkeyed(keyed(docs).mapInArrow(run, schema))
