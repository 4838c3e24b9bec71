"""Fill-in-middle transformation: documents rearranged so that a model learns to fill a gap from both sides.

A text is cut into units, words with the white space before them (white space at the end is a unit of its own).
Two of the n + 1 places between units, drawn from a keyed hash of the document's id, bound prefix, middle and suffix.
A share of the documents stays plain; of the rest a share takes the order suffix, prefix, middle (spm), the others
prefix, suffix, middle (psm). Each part is led by a mark of its own; a text that holds a mark stays plain, so that
every output can be undone.

An Arrow-batched pandas UDF does the work a document at a time: finditer gives the end of each unit into an array of
four or eight bytes a unit, two look-ups there are the cuts, and hashlib makes seeds and digests. Nothing is shuffled
and nothing but the current batch is held.

Defined results: a null or empty text is plain with no units; a text of white space alone is one unit; a null doc_id
has the empty string as its id; repeated rows come out alike; an empty table gives an empty result; other columns
are kept by transform_documents and may have any name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
_UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I" if len(text) < 2**32 else "Q", (m.end() for m in _UNIT.finditer(text)))


def draws(seed: int, doc_id: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def arrange(text: str, doc_id: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output) of a text."""
    ends = unit_ends(text)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= fim_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", None, None, text
    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return len(ends), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made from. Marks occur nowhere in it, so the first of each kind is the mark."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"an output of form {form} starts with {first}")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return f"{prefix}{middle}{suffix}"


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _arranged(seed: int, fim_percent: int, spm_percent: int, outputs: bool):
    @F.pandas_udf(RESULT)
    def arranged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = []
            for doc_id, text in zip(ids.tolist(), texts.tolist(), strict=True):
                n, form, a, m, output = arrange(text, doc_id, seed, fim_percent, spm_percent)
                rows.append((n, form, a, m, output if outputs else None, _sha256(output), _sha256(restore(output, form))))
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return arranged


def arranged_struct(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, outputs: bool = True) -> Column:
    """The struct RESULT of each document's id and text; output is null where outputs is false."""
    doc_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return _arranged(seed, fim_percent, spm_percent, outputs)(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")))


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, outputs: bool = True) -> DataFrame:
    """doc_id and RESULT, one row for each row of docs."""
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), arranged_struct(docs, seed, fim_percent, spm_percent, outputs).alias("_r"))
    out = told.select("doc_id", "_r.*")
    return out if outputs else out.drop("output")


def transform_documents(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs with the output in place of the text; all columns stay."""
    r = fresh(docs, "_r")
    return docs.withColumn(r, arranged_struct(docs, seed, fim_percent, spm_percent)).withColumn("text", F.col(f"{r}.output")).select(*docs.columns)
