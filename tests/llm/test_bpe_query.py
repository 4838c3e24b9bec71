"""The query's own output against the library, text by text."""

import hashlib
import random

import numpy as np
import tokenizers

from meterlark.llm.bpe_automaton import encode_documents
from meterlark.llm.queries import tokenizer_path

ODD = ["\0", " ", "  ", "\n", "\t", "it's", "don't", "x", "été", "É", "日本", "\U0001f600", "12", "...", "<|startoftext|>", "<|endoftext|>", "the", "The", "hello,", "$$$", "naïve"]


def test_digests_equal_library(spark):
    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(8)
    texts = [None, "", " "] + ["".join(rng.choice(ODD) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    found = {r["doc_id"]: r for r in encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), repr(text)
