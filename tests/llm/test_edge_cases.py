"""Every operator on nulls, empty texts, repeated rows, empty tables and clashing column names."""

import pytest

from meterlark.llm import queries as q
from meterlark.llm.bpe_automaton import encode_documents
from meterlark.llm.decontaminate import decontaminate
from meterlark.llm.exact_dedup import exact_dedup
from meterlark.llm.html_extract import extract_main_text
from meterlark.llm.language_id import identify_languages
from meterlark.llm.line_dedup import drop_repeated_lines, line_dedup
from meterlark.llm.minhash import near_duplicates
from meterlark.llm.quality import keep_quality, quality
from meterlark.llm.substring import substring_dedup
from meterlark.llm.token_store import store_digests

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, band string, part string, values string"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
LINE = "a line that is surely longer than forty characters in all"
ROWS = [
    (1, "Alpha beta Gamma delta", "en", "s", 22),
    (2, "alpha BETA gamma Delta", "en", "s", 22),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (None, "no id here at all", "de", "s", 17),
    (5, LONG, "en", "s", len(LONG)),
    (6, LONG, "en", "s", len(LONG)),
    (7, " \t\n ", "fr", "s", 4),
    (8, LINE + "\nx", "fr", "s", 10),
    (8, LINE + "\nx", "fr", "s", 10),
    (9, "Été 日本 \U0001f600 <|endoftext|>", "fr", "s", 12),
    *((20 + i, f"{LINE.upper() if i % 2 else LINE}\nown {i}", "es", "hot", 60) for i in range(6)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "v") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "..."), (4, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")


OPERATORS = {
    "token_store": lambda d, l, b: store_digests(d, q.tokenizer_path("byte_bpe_50k.json")),
    "bpe": lambda d, l, b: encode_documents(d, q.tokenizer_path("word_bpe_49k.json")),
    "minhash": lambda d, l, b: near_duplicates(d, shingle=2),
    "substring": lambda d, l, b: substring_dedup(d),
    "quality": lambda d, l, b: quality(d, l),
    "decontaminate": lambda d, l, b: decontaminate(d, b),
    "exact_dedup": lambda d, l, b: exact_dedup(d, bucket_keys=2),
    "language": lambda d, l, b: identify_languages(d),
    "line_dedup": lambda d, l, b: line_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, docs, empty, labels, benchmark):
    found = OPERATORS[name](docs, labels, benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](empty, labels, benchmark).collect() == []


def test_values(docs, benchmark):
    by = {r["doc_id"]: r for r in exact_dedup(docs, bucket_keys=2).collect()}
    assert (by[1]["keep_id"], by[1]["group_size"], by[1]["kept"]) == (2, 2, False)
    assert by[3]["keep_id"] == 4 and by[5]["keep_id"] == 6 and by[None]["kept"]
    near = {r["doc_id"]: r for r in near_duplicates(docs, shingle=2).collect()}
    assert near[2]["component_id"] == 1 and near[6]["component_id"] == 5 and near[3]["n_shingles"] == 0 and near[4]["kept"]
    cut = {r["doc_id"]: r for r in substring_dedup(docs).collect()}
    assert cut[6]["n_removed"] == cut[6]["n_words"] == 20_000 and 0 < cut[5]["n_removed"] < 20_000 and cut[3]["n_words"] == 0
    lines = {r["doc_id"]: r for r in line_dedup(docs).collect()}
    assert lines[25]["n_dropped"] == 0 and lines[24]["n_dropped"] == 1 and lines[8]["n_dropped"] == 1 and lines[3]["n_lines"] == 1
    hit = {r["doc_id"]: r for r in decontaminate(docs, benchmark).collect()}
    assert hit[1]["contaminated"] and hit[1]["n_hit"] == 3 and hit[5]["n_items"] == 1 and not hit[3]["contaminated"]


def test_pipeline_stages_keep_columns(docs, labels):
    assert drop_repeated_lines(docs).columns == docs.columns == keep_quality(docs, labels).columns
    kept = {r["doc_id"]: r for r in drop_repeated_lines(docs).collect()}
    assert kept[24]["text"] == "own 4" and kept[24]["n_chars"] == 5 and kept[3]["text"] is None


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<p>Just &amp; text"), (4, "u", "<html><nav><a href=x>Menu</a></nav><article><h1>Head line here</h1><p>One  two&nbsp;three<p>Four five six.</article><footer>Foot</footer>")], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    assert found[1]["text"] == found[2]["text"] == "" and found[4]["text"] == "Head line here\nOne two three\nFour five six." and found[4]["n_chars"] == len(found[4]["text"])
    assert extract_main_text(pages.limit(0)).collect() == []
