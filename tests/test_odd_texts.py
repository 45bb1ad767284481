"""Queries on texts that the driver's tables do not have, by brute force."""

import re

import pytest

from talelake.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


TEXTS = {1: "one\nline\n\ntwo & <b>", 2: "a\n\n\n\nb\n", 3: "", 4: None, 5: " \n ", 6: "x", 7: "abcde", 8: "plain text", 9: "\u00e9\n\n\u00e9", 10: "ab"}


def test_every_text_as_html(spark, folder):
    def html(t):
        value = (t or "").strip()
        for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            value = value.replace(sign, code)
        return "".join("<p>" + p.replace("\n", "<br>") + "</p>" for p in re.split(r"\n{2,}", value))

    found = {r.doc_id: r.html for r in registry.QUERIES["n07_to_html"](spark, folder).collect()}
    assert found == {d: html(t) for d, t in TEXTS.items()}
    assert found[2] == "<p>a</p><p>b</p>"


def test_every_text_makes_the_round_trip(spark, folder):
    found = registry.QUERIES["q15_share_round_trip"](spark, folder).collect()
    # an envelope holds the text and 16 bytes more, in at least 24 characters of base64
    assert {tuple(r) for r in found} == {(d, t or "", 16, -(-(len((t or "").encode()) + 16) * 4 // 3) >= 24) for d, t in TEXTS.items()}
