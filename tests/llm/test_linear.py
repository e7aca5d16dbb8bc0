"""Texts and pages made to be slow: work grows with their length, not with its square."""

import time

import pytest
from pyspark.sql import functions as F

from needledrop.llm import language_id, pii


@pytest.mark.parametrize("unit", ["<!--", "<script>", "<html ", "<div class=ads>", "<", "</script ", "<html lang", "class ", "&#"])
def test_odd_pages(unit):
    page, began = unit * (1_000_000 // len(unit)), time.time()
    language_id.visible(page), language_id.declared_language(page)
    assert time.time() - began < 4


def test_visible_text():
    page = "a<!-- x -->b<SCRIPT>var y</script >c<div class='menu x'>no</div><div class=main>d</div><nav>e<p>&amp; 1 < 2 <!-- open"
    assert language_id.visible(page).split() == "a b c d e & 1 < 2 <!-- open".split()
    assert language_id.visible("x <script> y <b>z").split() == ["x", "y", "z"]
    assert language_id.declared_language("<p lang=de><html\nid=x><HTML data-x=1 xml:lang = 'FR-ca'>") == "fr"
    assert language_id.declared_language(None) is None


def test_many_matches_in_a_text(spark):
    units = ["ab@c.de ", "_d@e.f", "1.2.3.4 ", "ssn 123-45-6789 ", "+12 (34) 567-890, "]
    df = spark.createDataFrame([(i, u * 50_000) for i, u in enumerate(units)], "doc_id bigint, text string")
    began = time.time()
    got = pii.find(df).select("doc_id", F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("end")).collect()
    assert time.time() - began < 60
    assert {r["doc_id"]: (r["n"], r["end"]) for r in got} == {i: (50_000, len(u) * 50_000 - (len(u) - len(u.rstrip(" ,")))) for i, u in enumerate(units)}
