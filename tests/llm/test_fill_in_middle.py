"""Fill-in-middle against a rewriting by hand."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import fill_in_middle as fim


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


ODD = [None, "", " ", "é", "\n\r x", "\x00a", "𐐷𐐷日本é", "a <P> b", "<S", "<M>", "<P<S<M" * 20, "<<<>>>P>S>M>" * 9, "x" * 5000]


@pytest.fixture(scope="module")
def texts(spark, rows_of):
    rows = rows_of + [(1000 * k + j, t) for j, t in enumerate(ODD) for k in range(1, 25)] + [(None, "no id"), (7, "twice"), (7, "twice"), (-3, "minus")]
    return spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, n int, form string, given string")


def test_forms_lengths_and_outputs(texts):
    got = [(r["given"]["doc_id"], r["given"]["text"], r["given"]["n"], r["given"]["given"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in fim.fill_in_middle(texts).collect()]
    want = [(r["doc_id"], r["text"], 1, "y", *by_hand(r["doc_id"], r["text"])) for r in texts.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {g[5] for g in got} == {"plain", "psm", "spm"}


def test_every_text_is_restored_from_output_and_form(texts):
    made = fim.fill_in_middle(texts).withColumn("again", fim.restored(F.col("output"), F.col("form")))
    assert all(r["again"] == (r["given"]["text"] or "") for r in made.collect())
    digests = fim.fill_in_middle_digests(texts).collect()
    assert sorted((r["restored_sha256"] for r in digests)) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in texts.collect())


def test_other_units_are_never_cut(spark):
    docs = spark.createDataFrame([(k, "one two  three four five ") for k in range(200)], "doc_id long, text string")
    for r in fim.fill_in_middle(docs, unit=r"\S+\s+").collect():
        assert r["n"] == 5 and (r["form"] == "plain" or {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= {0, 4, 9, 15, 20, 25}), r
    assert fim.fill_in_middle(docs.withColumn("text", F.lit("no end")), unit=r"\S+\s+").filter("form <> 'plain' or n > 0").count() == 0


def test_long_texts_are_matched_in_runs(monkeypatch):
    text = "日本 text\n" * 50
    monkeypatch.setattr(fim, "MOST_UNITS", 7)
    assert np.array_equal(fim.unit_ends(".")(text), np.arange(1, len(text) + 1))
    assert len(fim.unit_ends("[a-z]")("abc" * 9 + "-")) == 0


def test_no_rows_and_no_columns_lost(none, spark):
    assert fim.fill_in_middle(none).count() == 0 and fim.fill_in_middle_digests(none).count() == 0
    other = spark.createDataFrame([(5, 12), (6, None)], "id int, body int")
    assert sorted(r["n"] for r in fim.fill_in_middle(other, "body", "id").collect()) == [0, 2]
