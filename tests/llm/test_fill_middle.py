"""Fill-in-middle against a plain second writing of its contract, and the round trip of every form."""

import hashlib
import random
import re

import pytest

from meterlark.llm.fill_middle import arrange, fill_in_middle, restore, transform_documents, unit_ends


def expected(doc_id, text):
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(units), "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def test_random_texts():
    random.seed(3)
    forms = set()
    for doc_id in range(4000):
        text = "".join(random.choice(["a", "bc", " ", "\t", "\n", "é", "\x1f", "\x85", "😀", "<", "P>", "<S", ">"]) for _ in range(random.randrange(30)))
        found = arrange(text, str(doc_id))
        assert found == expected(doc_id, text)
        assert restore(found[4], found[1]) == text
        forms.add(found[1])
    assert forms == {"plain", "psm", "spm"}


def test_units_end_after_each_word():
    assert list(unit_ends(" a  b\n")) == [2, 5, 6] and list(unit_ends(" \n")) == [2] and list(unit_ends("")) == []


def test_restore_refuses_a_foreign_form():
    with pytest.raises(ValueError):
        restore("abc", "psm")


def test_edge_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t"), (None, "some words here"), (4, "a <M> b"), (5, long_text), (5, long_text), (-(2**63), "x y")]
    docs = spark.createDataFrame([(i, t, "n", "output") for i, t in rows], "doc_id long, text string, n string, _r string")
    found = fill_in_middle(docs).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[1]["form"] == "plain" and by[1]["n"] == 0 and by[1]["prefix_chars"] is None and by[2]["output"] == "" and by[4]["form"] == "plain"
    for r in found:
        text = dict(rows)[r["doc_id"]] or ""
        doc_id = "" if r["doc_id"] is None else str(r["doc_id"])
        assert tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == expected(doc_id, text)
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
    assert fill_in_middle(docs.limit(0)).collect() == []
    changed = transform_documents(docs)
    assert changed.columns == docs.columns and {r["text"] for r in changed.collect()} == {r["output"] for r in found}


def test_rates_follow_the_parameters(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'one two three four' AS text")
    forms = {r["form"]: r["count"] for r in fill_in_middle(docs, fim_percent=90, spm_percent=30).groupBy("form").count().collect()}
    assert 1700 < forms["psm"] + forms["spm"] < 1900 and forms["spm"] < forms["psm"]
    assert {r["form"] for r in fill_in_middle(docs, fim_percent=0).select("form").distinct().collect()} == {"plain"}
