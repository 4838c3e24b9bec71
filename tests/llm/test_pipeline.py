"""Every stage of the pipeline, and the whole of it, against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest
import tokenizers

import corpus_pipeline as p
from meterlark.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key string, _lost string, band string"
WORDS = [f"w{i}" for i in range(400)]
LINE = "this very long line is found in a good many of these documents"
ITEM = " ".join(f"b{i}" for i in range(30))


def _rows():
    rng = random.Random(17)
    texts = {}
    base = [rng.choice(WORDS) for _ in range(120)]
    for i in range(12):
        texts[i] = " ".join(rng.choice(WORDS) for _ in range(80)) + (f"\n{LINE if i % 2 else LINE.upper()}" if i < 7 else "")
    for i in range(20, 26):  # near copies, chained through the base
        copy = list(base)
        copy[i] = "changed"
        texts[i] = " ".join(copy)
    texts[30] = f"start {ITEM} end"
    texts[31] = "start " + " ".join(ITEM.split()[:12]) + " end"
    texts[40], texts[41], texts[42] = None, "", " \t\n "
    rows = [(i, t, "en", "s", len(t or ""), "k", "l", "b") for i, t in texts.items()]
    return [*rows, (None, "no id at all here", None, None, None, None, None, None), rows[3]]


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows, labels=(), items=((1, ITEM), (2, None))):
        spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return write


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _expected(rows):
    """Lines, near-duplicates and decontamination one by one; without labels all quality is good."""
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").lower()
            if len(key) >= 40:
                holders.setdefault(key, set()).add(-(2**63) if r[0] is None else r[0])
    lost = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    kept = []
    for r in rows:
        if r[1] is not None:
            lines = [x for x in r[1].split("\n") if lost.get(x.strip(" \t\n\x0b\x0c\r").lower(), r[0]) == r[0]]
            r = (r[0], "\n".join(lines), *r[2:])
        kept.append(r)
    ids = sorted({-(2**63) if r[0] is None else r[0] for r in kept})
    sets = {i: [_shingles(r[1]) for r in kept if (-(2**63) if r[0] is None else r[0]) == i] for i in ids}
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    kept = [r for r in kept if root[-(2**63) if r[0] is None else r[0]] == (-(2**63) if r[0] is None else r[0])]
    item = ITEM.split()
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}

    def dirty(text):
        w = (text or "").lower().split()
        hit = set()
        for i in range(len(w) - 12):
            if tuple(w[i : i + 13]) in windows:
                hit |= set(range(i, i + 13))
        return bool(hit) and 20 * len(hit) >= len(w)

    return [r for r in kept if not dirty(r[1])]


def test_whole_pipeline_equals_brute_force(spark, tables):
    rows = _rows()
    found = p.run(spark, tables(rows)).collect()
    expected = _expected(rows)
    library = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for r in expected:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in found) == sorted(want)
    gone = {r[0] for r in rows} - {r[0] for r in expected}
    assert {21, 22, 23, 24, 25, 30} <= gone and 20 not in gone and 31 not in gone and None not in gone


def test_stages_keep_columns_and_take_empty_tables(spark, tables):
    sf_dir = tables([], items=())
    docs = spark.createDataFrame([], COLUMNS)
    some = spark.createDataFrame(_rows()[:3], COLUMNS)
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).collect() == [] and stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, some, sf_dir).count() == 3, name
    assert p.run(spark, sf_dir).count() == 0


def test_quality_stage_rejects_junk_and_keeps_clean(spark, tables):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "house", "river", "walked", "old", "quiet", "morning", "letter", "garden", "bread"]) for _ in range(60)) for _ in range(150)]
    junk = [" ".join(rng.choice(["click", "$$$", "buy", "###", "now", "free", "!!!", "pills", "win", "cash"]) for _ in range(60)) for _ in range(150)]
    rows = [(i, t, "en", "s", len(t), "k", "l", "b") for i, t in enumerate(good + junk)]
    sf_dir = tables(rows, labels=[(i, int(i < 150), 0) for i in range(0, 300, 2)])
    kept = {r["doc_id"] for r in p.quality_stage(spark, spark.createDataFrame(rows, COLUMNS), sf_dir).collect()}
    assert len([i for i in kept if i < 150]) >= 147 and not [i for i in kept if i >= 150]
