"""Runs against a search over all periods."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from meterlark.llm import queries
from meterlark.llm.periodic_runs import periodic_runs, runs_of_texts


def brute(words, least=12, exponent=2):
    n, found = len(words), set()
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            run = words[start : start + length]
            if length >= max(least, exponent * p) and not any(run[q:] == run[:-q] for q in range(1, p)):
                found.add((start, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(texts, least, exponent=2):
    return [([tuple(map(int, r)) for r in runs], text.decode()) for _, runs, text in runs_of_texts([t.encode() for t in texts], least, exponent)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 4, 12]), st.sampled_from([2, 3]))
def test_small_alphabets(docs, least, exponent):
    expected = [brute(d, least, exponent) for d in docs]
    assert found([" ".join(d) for d in docs], least, exponent) == [(r, collapsed(d, r)) for d, r in zip(docs, expected, strict=True)]


def test_strings_rich_in_runs():
    a, b = "a", "ab"
    for _ in range(9):
        a, b = b, b + a  # Fibonacci words
    thue = [bin(i).count("1") % 2 for i in range(128)]
    for words in (list(b), ["x"] * 90, [str(t) for t in thue], list("abcab" * 12 + "z" + "abcab" * 9)):
        runs = brute(words, 2)
        assert found([" ".join(words)], 2) == [(runs, collapsed(words, runs))]


def planted(doc_id, text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        a = (h // 10) % len(words)
        p = 1 + (len(words) - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_on_a_small_table(spark, tmp_path):
    random.seed(5)
    rows = [(i, " ".join(random.choice(["the", "a", "x", "yy"] + [f"w{k}" for k in range(40)]) for _ in range(random.choice([0, 30, 150, 300])))) for i in range(250)]
    rows += [(1000, None), (1001, ""), (1002, "so so\tso so so so\nso so so so so so so"), (1003, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    with_runs = 0
    for doc_id, text in rows:
        words = planted(doc_id, text or "")
        runs, r = brute(words), out[doc_id]
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        with_runs += bool(runs)
    assert with_runs >= 12


def test_edge_rows(spark):
    long_text = " ".join(["r0 r1 r2"] * 60_000)
    rows = [(1, None), (2, ""), (None, "a " * 13), (3, long_text), (3, long_text), (4, "\x85 \x1f"), (-(2**63), "b")]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_words int, runs string")
    by = {r["doc_id"]: r for r in periodic_runs(docs).collect()}
    assert len(by) == 6 and by[1]["runs"] == by[2]["runs"] == [] and by[1]["collapsed"] == ""
    assert [tuple(x) for x in by[None]["runs"]] == [(0, 13, 1)] and by[None]["collapsed"] == "a"
    assert [tuple(x) for x in by[3]["runs"]] == [(0, 180_000, 3)] and by[3]["collapsed"] == "r0 r1 r2"
    assert by[4]["n_words"] == 2 and by[4]["collapsed"] == "\x85 \x1f"
    assert periodic_runs(docs).count() == len(rows) and periodic_runs(docs.limit(0)).collect() == []
