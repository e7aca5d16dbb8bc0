import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from needledrop.functions import text


def apply(spark, values, *functions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", *(f(F.col("v")).alias(f"r{k}") for k, f in enumerate(functions))).orderBy("i").collect()
    return [tuple(r)[1] if len(functions) == 1 else tuple(r)[1:] for r in rows]


def test_normalise_and_key(spark):
    values = [None, "", "  A \u2013 B  ", "x\u00a0\u2003y\u200bz", "Loin d\u2019ici", "Bur\u010deska", "N\u02bcDour", "A.B!C", "\u4e2d\u6587 Song", "Guns N' Roses"]
    assert apply(spark, values, text.normalise)[:4] == ["", "", "A - B", "x yz"]
    assert apply(spark, values, text.key) == ["", "", "a b", "x yz", "loin d ici", "burceska", "n dour", "a b c", "\u4e2d\u6587 song", "guns n roses"]


def test_title_parts(spark):
    values = ["Song", "Song (Live) [Remastered 2009]", "A - B - C", "Song - !!", "(Intro)", "Song ()", "Song (feat. X)", "Song feat. X"]
    base = ["Song", "Song", "A", "Song - !!", "", "Song", "Song", "Song feat. X"]
    assert apply(spark, values, text.title_base) == base
    assert apply(spark, values, text.qualifiers) == [[], ["live", "remastered 2009"], ["b c"], [], ["intro"], [], ["feat x"], []]
    assert apply(spark, values, text.loose_key) == ["song", "song", "a", "song", "intro", "song", "song", "song x"]


def test_badges(spark):
    values = ["Song (Official Video)", "Song - Audio", "Song (Music)", "Song [Lyric Video] (Live)", "Song (Prime Video original)", "Song {Official Video}"]
    assert apply(spark, values, lambda v: F.exists(text.qualifiers(v), text.is_badge)) == [True, True, False, True, False, True]
    assert apply(spark, values, text.strip_badges) == ["Song", "Song", "Song (Music)", "Song (Live)", "Song (Prime Video original)", "Song {Official Video}"]


def test_artists(spark):
    values = ["The Wild (UK)", "Los", "Ana, Bruno & Carla", "Nina and the Wild", "A feat. B", "X vs. Y", "(A) | B"]
    assert apply(spark, values, text.artist_key) == ["wild", "los", "ana bruno carla", "nina and the wild", "a b", "x vs y", "b"]
    assert apply(spark, values, text.split_artist) == [[], [], ["Ana", "Bruno", "Carla"], [], ["A", "B"], ["X", "Y"], ["A", "B"]]


def test_pairs_of_names(spark):
    df = spark.createDataFrame([("cris lora", "cristina lora"), ("voyage", "voyager"), ("ana", "ana"), ("a b", "b a"), ("ana", "ana bruno")], "a string, b string")
    rows = df.select(text.abbreviation(F.col("a"), F.col("b"), 4, 2).alias("x"), text.contains_words(F.col("b"), F.col("a")).alias("c")).collect()
    assert [r["x"] and tuple(r["x"]) for r in rows] == [("cris", "cristina"), None, None, None, None]
    assert [r["c"] for r in rows] == [False, False, False, False, True]


def test_title_repeats_artist(spark):
    df = spark.createDataFrame([("Alpha", "Alpha - Song"), ("Alpha", "Alphabet"), ("Al", "Al - Song"), ("Alpha", "Alpha Song"), ("Alpha", "Alpha: Song")], "a string, t string")
    assert [r[0] for r in df.select(text.after_artist(F.col("a"), F.col("t"))).collect()] == ["Song", None, None, None, "Song"]


def test_ordinals_and_versions(spark):
    assert apply(spark, ["lugar i", "lugar ii", "track 12", "xx mix"], text.without_ordinals) == ["lugar", "lugar", "track", "mix"]
    assert apply(spark, ["song live", "alive", "radio edit", "olive"], text.marks_version) == [True, False, True, False]


def plain_key(s):
    s = re.sub("[\u2010-\u2015\u2212]", "-", s)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F).lower()
    return " ".join("".join(c if c.isalnum() else " " for c in s).split())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ \u00e9\u00c9\u00f1\u00fc01-()'!", max_size=20), min_size=50, max_size=100))
def test_key_agrees_with_python(spark, values):
    assert apply(spark, values, text.key) == [plain_key(v) for v in values]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=8), st.text("abc", max_size=8)), min_size=30, max_size=60))
def test_bounded_distance(spark, values):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(text.bounded_distance(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [min(3, plain_distance(a, b)) for a, b in values]


def test_every_code_point_decomposes(spark):
    """All planes at once: each character by itself, and between others."""
    import unicodedata

    marks = {chr(c) for c in range(0x300, 0x370)}
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and c != 0xFDD0]
    whole = spark.createDataFrame([(k, "".join(map(chr, points[k : k + 64]))) for k in range(0, len(points), 64)], "k int, s string")
    alone = [c for c in points if unicodedata.decomposition(chr(c)) or 0xAC00 <= c <= 0xD7A3]
    bare = lambda s: "".join(y for x in s for y in unicodedata.normalize("NFD", x) if y not in marks)
    rows = whole.select("k", "s", text.strip_accents(F.col("s")).alias("t")).collect()
    assert [r["k"] for r in rows if r["t"] != bare(r["s"])] == []
    one = spark.createDataFrame([(c, chr(c)) for c in alone], "c int, s string")
    assert [r["c"] for r in one.select("c", "s", text.strip_accents(F.col("s")).alias("t")).collect() if r["t"] != bare(r["s"])] == []
