"""Findings about albums: missing ones, clashes, and names written in several ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.operators.findings import JOINED, finding, item, log_points, mark, number, plays, quoted, signal, signals, target
from needledrop.plans.index import Index
from needledrop.rules import Rules


def track_albums(index: Index) -> DataFrame:
    """(artist, track_key, title, n, missing, albums, album, album_n, all, after_title, seen) of every track of every artist."""
    c = index.cells
    titles = c.groupBy("artist", "track_key", "title").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"), F.sum(F.when(F.col("album") == "", F.col("n")).otherwise(0)).alias("missing"))
    best = F.max_by("title", F.struct("n", (-F.col("seen")).alias("early"))).alias("title")
    tracks = titles.groupBy("artist", "track_key").agg(best, F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.min("seen").alias("seen"))
    one = F.struct("n", (-F.col("seen")).alias("early"))
    albums = index.track_albums.groupBy("artist", "track_key").agg(
        F.count("*").alias("albums"), F.max_by("album", one).alias("album"), F.max("n").alias("album_n"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "seen", "album", "n"))).alias("all"),
    )
    t = tracks.join(albums, ["artist", "track_key"])
    return t.withColumn("after_title", text.key(F.col("album")) == text.loose_key(F.col("title")))


def missing_albums(index: Index, rules: Rules) -> DataFrame:
    t = track_albums(index).where("missing > 0")
    share = F.col("album_n") / (F.col("n") - F.col("missing"))
    points = F.when(F.col("after_title"), 52).otherwise(78 + F.when(F.col("missing") >= 3, 8).otherwise(0) + F.when(share >= 0.8, 6).otherwise(0))
    said = signals(
        (True, signal("strong", number(F.col("missing")), " play(s) of this track have no album")),
        (True, signal("strong", number(F.col("n") - F.col("missing")), " have one, most often ", quoted(F.col("album")))),
        (F.col("after_title"), signal("note", "The album is named after the track")),
    )
    listed = F.transform("all", lambda a: item(a["album"], plays(a["n"])))
    why = F.when(F.col("after_title"), "The album is named after the track, which is often a wrong tag; filling it in would spread it.").otherwise(
        F.concat(quoted(F.col("album")), F.lit(" is on "), plays(F.col("album_n")), F.lit(" of this track, so it can go to the "), number(F.col("missing")), F.lit(" without."))
    )
    return finding(
        t, 8, "albums", "missing", "fill_album",
        title=F.concat(F.lit("No album: "), quoted(F.concat("artist", F.lit(" — "), "title"))), points=points, impact=F.col("missing"),
        current=F.col("title"), proposed=F.col("album"), seen=F.col("seen"), signals=said,
        warning=F.when(F.col("after_title"), "An album named after its track is often a wrong tag: check before filling it in."),
        targets=F.array(target(F.col("artist"), F.col("title"))), marks=F.array(mark("empty_album", F.col("artist"), F.col("track_key"))),
        evidence=F.concat(listed, F.array(item("(no album)", plays(F.col("missing"))))), shown=rules.evidence_items, explanation=why,
    )


def album_clashes(index: Index, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The clashes worth a look, and those with fewer plays than that (only to be counted)."""
    t = track_albums(index).where("albums > 1").withColumn("impact", F.col("n") - F.col("album_n") - F.col("missing"))
    large = F.col("impact") >= rules.album_clash_impact
    points = 48 + log_points(F.col("impact"), 6, 10)
    points = F.when(F.col("after_title"), F.least(points, F.lit(44.0))).otherwise(points)
    others = F.filter("all", lambda a: a["album"] != F.col("album"))
    said = signals(
        (True, signal("medium", "The title is on ", number(F.col("albums")), " albums")),
        (True, signal("medium", "The most frequent one is ", quoted(F.col("album")))),
    )
    found = finding(
        t.where(large), 8, "albums", "clash", "review_album",
        title=F.concat(F.lit("Several albums: "), quoted(F.concat("artist", F.lit(" — "), "title"))), points=points, impact=F.col("impact"),
        current=F.col("title"), proposed=F.col("album"), seen=F.col("seen"), signals=said,
        targets=F.array(target(F.col("artist"), F.col("title"))),
        marks=F.transform(others, lambda a: mark("track_album", F.col("artist"), F.col("track_key"), a["album"])),
        evidence=F.transform("all", lambda a: item(a["album"], plays(a["n"]))), shown=rules.evidence_items,
        warning=F.when(F.col("after_title"), "An album named after its track is often a wrong tag: check which one is right."),
        explanation=F.concat(F.lit("A single and an album can both be right. To have one, "), quoted(F.col("album")), F.lit(" is the most frequent.")),
    )
    return found, t.where(~large)


def album_names(index: Index, rules: Rules) -> DataFrame:
    """All albums that one artist has in several spellings; ``listed`` takes the first of them."""
    flat = F.lower(text.strip_accents(text.fold_quotes(F.col("album"))))
    one = F.struct("n", (-F.col("seen")).alias("early"))
    g = index.albums.groupBy("artist", "album_key").agg(
        F.count("*").alias("forms"), F.count_distinct(flat).alias("flat"), F.count_distinct(F.lower("album")).alias("lowered"),
        F.max_by("album", one).alias("kept"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "seen", "album", "n"))).alias("all"), F.min("seen").alias("seen"),
    )
    g = g.where("forms > 1 and flat = 1").withColumn("others", F.filter("all", lambda f: f["album"] != F.col("kept")))
    g = g.withColumn("impact", F.aggregate("others", F.lit(0).cast("bigint"), lambda a, f: a + f["n"]))
    capitals = F.col("lowered") == 1
    points = F.when(capitals, 44 + log_points(F.col("impact"), 6, 8)).otherwise(74 + log_points(F.col("impact"), 8, 10))
    names = F.transform("others", lambda f: f["album"])
    said = signals(
        (capitals, signal("strong", "The spellings differ in capitals only")),
        (~capitals, signal("strong", "One album, written with different capitals, accents, quotes or spaces")),
        (True, signal("strong", "Both are of one artist, ", quoted(F.col("artist")))),
    )
    return finding(
        g, 9, "albums", F.when(capitals, "case_only").otherwise("name_variants"), F.when(capitals, "review_capitalisation").otherwise("merge_album"),
        title=F.concat(F.lit("Album in "), number(F.col("forms")), F.lit(" forms: "), quoted(F.concat("artist", F.lit(" — "), "kept"))),
        points=points, impact=F.col("impact"), current=F.array_join(names, JOINED), proposed=F.col("kept"), seen=F.col("seen"), signals=said,
        targets=F.transform(names, lambda a: target(F.col("artist"), album=a)), marks=F.transform(names, lambda a: mark("album", F.col("artist"), F.col("album_key"))),
        evidence=F.transform("all", lambda f: item(f["album"], plays(f["n"]))), shown=rules.evidence_items,
        explanation=F.concat(F.lit("One album is written in "), number(F.col("forms")), F.lit(" ways; "), quoted(F.col("kept")), F.lit(" has most plays."), F.when(capitals, " Nothing is wrong with either: it is a matter of taste.").otherwise("")),
    )


def listed(names: DataFrame, rules: Rules) -> DataFrame:
    """The report's share of ``album_names``: those with most plays; the rest is counted, not dropped in silence."""
    return names.orderBy(F.col("impact").desc(), "seen").limit(rules.album_variants_listed)
