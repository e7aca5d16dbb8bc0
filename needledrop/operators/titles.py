"""Findings about track titles: spellings, versions, badges, repeated artist names and typos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop.functions import text
from needledrop.operators.near import own_keys, probed_keys
from needledrop.operators.findings import EVIDENCE, JOINED, finding, item, log_points, mark, number, plays, preference, quoted, signal, signals, target
from needledrop.operators.pairs import first_by
from needledrop.plans.index import Index
from needledrop.plans.storage import written
from needledrop.rules import Rules

FEATURED = rf"{text.BEFORE}(?:feat|featuring|ft|with){text.AFTER}"
FEATURED_QUALIFIER = rf"^\s*(?:feat|featuring|ft|with|con){text.AFTER}"
#: The points of each sub-case of title variants, in the order in which they are tried.
POINTS = {"featuring": 55, "case_only": 44, "qualifier_formatting": 78, "formatting": 85, "version_marker": 40, "one_qualified": 52, "different_qualifiers": 38}
ADVISORY = {"case_only": "review_capitalisation", "version_marker": "review_track", "different_qualifiers": "review_track"}


def variant_groups(index: Index) -> DataFrame:
    """(artist, track_key, bucket, title, n, seen, ...): the spellings to compare with each other.

    Spellings are sorted into versions by their qualifiers. A version with several spellings is a group of its own; if there
    are several versions, their most frequent spellings are one more group (``bucket`` null).
    """
    t = index.titles.where("track_key <> '' and not badge")
    track, version = Window.partitionBy("artist", "track_key"), Window.partitionBy("artist", "track_key", "qualifiers")
    order = version.orderBy(F.col("n").desc(), "seen")
    t = t.withColumns({"forms": F.count("*").over(track), "in_version": F.count("*").over(version), "place": F.row_number().over(order)})
    t = written(t.where("forms > 1"), "title-forms")
    own = t.where("in_version > 1").withColumn("bucket", F.col("qualifiers"))
    across = t.where("place = 1 and in_version < forms").withColumn("bucket", F.lit(None).cast("string"))
    return own.unionByName(across)


def title_variants(index: Index, rules: Rules) -> DataFrame:
    v = variant_groups(index)
    others = F.filter(text.qualifiers(F.col("title")), lambda q: ~q.rlike(FEATURED_QUALIFIER))
    v = v.withColumns({"signature": F.concat(text.key(text.title_base(F.col("title"))), F.lit("|"), F.array_join(others, ",")), "featured": F.col("strict").rlike(FEATURED)})
    newest = F.lit(None).cast("bigint")
    v = v.withColumn("wanted", preference(rules, F.col("title"), F.col("n"), newest, newest, newest))
    plain = F.col("qualifiers") == ""
    best = lambda *order: F.max_by("title", F.struct(*order, "n", (-F.col("seen")).alias("early")))
    g = v.groupBy("artist", "track_key", "bucket").agg(
        F.count("*").alias("forms"),
        F.count_distinct("strict").alias("stricts"),
        F.count_distinct("qualifiers").alias("qualifier_kinds"),
        F.count_distinct("signature").alias("signatures"),
        F.count_distinct(F.lower("title")).alias("lowered"),
        F.bool_or("featured").alias("featured"),
        F.count_if(plain).alias("plain"),
        F.bool_or(F.col("version") & ~plain).alias("marked"),
        best("wanted").alias("preferred"),
        best(plain.cast("int").alias("plain")).alias("plainest"),
        F.array_sort(F.collect_list(F.struct("seen", "title", "n"))).alias("all"),
        F.min("seen").alias("seen"),
    )
    qualified = F.col("forms") - F.col("plain")
    subtype = (
        F.when((F.col("signatures") == 1) & F.col("featured") & (F.col("stricts") > 1), "featuring")
        .when(F.col("lowered") == 1, "case_only")
        .when((F.col("qualifier_kinds") == 1) & (F.col("plain") == 0), "qualifier_formatting")
        .when(F.col("stricts") == 1, "formatting")
        .when((F.col("plain") > 0) & (qualified > 0) & F.col("marked"), "version_marker")
        .when((F.col("plain") > 0) & (qualified > 0), "one_qualified")
        .otherwise("different_qualifiers")
    )
    g = g.withColumn("subtype", subtype)
    g = g.withColumn("kept", F.when(F.col("subtype") == "version_marker", F.col("plainest")).otherwise(F.col("preferred")))
    g = g.withColumn("others", F.filter("all", lambda f: f["title"] != F.col("kept")))
    g = g.withColumn("impact", F.aggregate("others", F.lit(0).cast("bigint"), lambda a, f: a + f["n"])).where("impact > 0")
    chosen = lambda values, rest: F.coalesce(*(F.when(F.col("subtype") == k, F.lit(x)) for k, x in values.items()), F.lit(rest))
    ranked = F.array_sort(F.transform("others", lambda f: F.struct((-f["n"]).alias("less"), f["seen"].alias("seen"), f["title"].alias("title"), f["n"].alias("n"))))

    def swap(f: Column) -> Column:
        rest = F.filter("all", lambda h: h["title"] != f["title"])
        moved = F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, h: a + h["n"])
        current = F.array_join(F.transform(rest, lambda h: h["title"]), JOINED)
        return F.struct(f["title"].alias("value"), F.concat(number(f["n"]), F.lit(" plays")).alias("reason"), current.alias("current"), f["title"].alias("proposed"), moved.alias("impact"))

    said = {
        "featuring": "One form has the featuring credit, the other has not",
        "case_only": "The forms differ in capitals only",
        "qualifier_formatting": "The same qualifier, in brackets in one form and after a dash in the other",
        "formatting": "Equal but for accents, quotes or spaces",
        "version_marker": "One form says that it is another recording",
        "one_qualified": "One form has a qualifier, the other has none",
        "different_qualifiers": "The qualifiers differ",
    }
    warning = F.when(F.col("subtype").isin("version_marker", "different_qualifiers"), "These may be different recordings: compare them before merging.")
    return finding(
        g, 4, "title_variants", F.col("subtype"), chosen(ADVISORY, "rename_track"),
        title=F.concat(quoted(F.col("artist")), F.lit(" — "), F.col("forms").cast("string"), F.lit(" forms of one title")),
        points=chosen(POINTS, 0) + log_points(F.col("impact"), 6, 8), impact=F.col("impact"),
        current=F.array_join(F.transform("others", lambda f: f["title"]), JOINED), proposed=F.col("kept"), seen=F.col("seen"),
        signals=F.array(F.struct(chosen(said, "").alias("text"), F.lit("strong").alias("level"))), warning=warning,
        alternatives=F.transform(F.slice(ranked, 1, 3), swap),
        targets=F.transform("others", lambda f: target(F.col("artist"), f["title"])),
        evidence=F.transform("all", lambda f: item(f["title"], plays(f["n"]))), shown=rules.evidence_items,
        explanation=F.concat(F.lit("One track of "), quoted(F.col("artist")), F.lit(" is written in "), number(F.col("forms")), F.lit(" ways; "), quoted(F.col("kept")), F.lit(" is the form to keep, for "), plays(F.col("impact")), F.lit(" of others.")),
        marks=F.transform("others", lambda f: mark("title", F.col("artist"), f["title"])),
    )


def title_typos(index: Index, rules: Rules) -> DataFrame:
    """Nearly equal title keys of one artist, of which the rarer one is rare.

    Pairs of an artist meet under an initial and a segment that they share; only a rare title looks for others, so frequent ones
    are never paired.
    """
    t = index.tracks.where((F.length("track_key") >= rules.title_typo_length) & ~F.col("versioned") & ~text.marks_version(F.col("track_key")))
    t = t.select("artist", "track_key", "n", "title", F.substring("track_key", 1, 1).alias("initial"))
    far = rules.title_typo_distance_with_album
    rare = t.where(F.col("n") <= rules.rare_title_plays).withColumn("near", F.explode(probed_keys(F.col("track_key"), far, far, far)))
    a, b = rare.alias("a"), t.withColumn("near", F.explode(own_keys(F.col("track_key"), far))).alias("b")
    same = (F.col("a.artist") == F.col("b.artist")) & (F.col("a.initial") == F.col("b.initial")) & (F.col("a.near") == F.col("b.near"))
    p = a.join(b, same & (F.col("a.n") < F.col("b.n")))
    p = p.withColumn("apart", F.levenshtein(F.col("a.track_key"), F.col("b.track_key"), far)).where("apart > 0")
    p = p.where(text.without_ordinals(F.col("a.track_key")) != text.without_ordinals(F.col("b.track_key")))
    p = p.select("a.artist", F.col("a.track_key").alias("k"), F.col("b.track_key").alias("l"), F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.col("a.title").alias("rare"), F.col("b.title").alias("common"), "apart")
    p = p.distinct()  # once for each pair, however many segments it shares
    albums = index.track_albums.select("artist", "track_key", "album", "seen")
    both = p.select("artist", "k", "l").join(albums.withColumnRenamed("track_key", "k"), ["artist", "k"])
    both = both.join(albums.select("artist", F.col("track_key").alias("l"), "album"), ["artist", "l", "album"])
    both = both.groupBy("artist", "k", "l").agg(F.min_by("album", "seen").alias("album"))
    p = p.join(both, ["artist", "k", "l"], "left")
    shared = F.col("album").isNotNull()
    p = p.where((F.col("apart") <= rules.title_typo_distance) | (shared & (F.col("apart") <= far)))
    points = 38 + F.when(F.col("apart") == 1, 14).otherwise(7) + F.when(shared, 16).otherwise(0) + F.when(shared & (F.col("n") == 1), 6).otherwise(0)
    said = signals(
        (True, signal("medium", "The titles are ", number(F.col("apart")), " character(s) apart")),
        (shared, signal("strong", "Both are on the album ", quoted(F.col("album")))),
    )
    return finding(
        p, 6, "title_variants", "typo", "rename_track",
        title=F.concat(F.lit("Is "), quoted(F.col("rare")), F.lit(" really "), quoted(F.col("common")), F.lit("?")),
        points=points, impact=F.col("n"), current=F.col("rare"), proposed=F.col("common"), seen=-F.col("n"), signals=said,
        targets=F.array(target(F.col("artist"), F.col("rare"))), marks=F.array(mark("title", F.col("artist"), F.col("rare"))),
        evidence=F.array(item(F.col("rare"), F.concat(plays(F.col("n")), F.lit(", the rarer form"))), item(F.col("common"), F.concat(plays(F.col("m")), F.lit(", the proposed form")))), shown=rules.evidence_items,
        explanation=F.concat(F.lit("Both titles are of "), quoted(F.col("artist")), F.when(shared, " and on one album").otherwise(""), F.lit(". The rarer one is probably a slip.")),
    )


def platform_badges(index: Index, rules: Rules) -> DataFrame:
    own = index.titles.where(text.after_artist(F.col("artist"), F.col("title")).isNull())
    bad = own.where("badge").withColumn("clean", text.strip_badges(F.col("title"))).where("clean <> '' and clean <> title")
    g = bad.groupBy("artist", "track_key", "clean").agg(
        F.sum("n").alias("impact"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "seen", "title", "n"))).alias("forms"), F.min("seen").alias("seen")
    )
    plain = own.where("not badge").select("artist", "track_key", F.col("title").alias("clean"), F.col("n").alias("plain_n"))
    g = g.join(plain, ["artist", "track_key", "clean"], "left").withColumn("known", F.col("plain_n").isNotNull())
    shown = F.concat(
        F.transform("forms", lambda f: item(f["title"], F.concat(plays(f["n"]), F.lit(", with a badge")))),
        F.when(F.col("known"), F.array(item(F.col("clean"), plays(F.col("plain_n"))))).otherwise(F.array().cast(EVIDENCE)),
    )
    points = 55 + log_points(F.col("impact"), 9, 12) + F.when(F.col("known"), 0).otherwise(6)
    names = F.transform("forms", lambda f: f["title"])
    return finding(
        g, 5, "title_variants", "platform_badge", "rename_track",
        title=F.concat(F.size("forms").cast("string"), F.lit(" video-page form(s) of "), quoted(F.col("clean"))),
        points=points, impact=F.col("impact"), current=F.array_join(names, JOINED), proposed=F.col("clean"), seen=F.col("seen"),
        signals=F.array(signal("strong", "The title carries a video page's badge")), warning=F.lit("If the video was played on purpose, leave it."),
        targets=F.transform(names, lambda t: target(F.col("artist"), t)), marks=F.transform(names, lambda t: mark("title", F.col("artist"), t)),
        evidence=shown, shown=rules.evidence_items,
        explanation=F.concat(F.lit("A badge tells of the upload, not of the song. "), F.when(F.col("known"), "The clean form is there as well.").otherwise("No play carries the clean form yet.")),
    )


def artist_in_title(index: Index, rules: Rules) -> DataFrame:
    t = index.cells.groupBy("artist", "title").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    t = t.withColumn("rest", text.after_artist(F.col("artist"), F.col("title"))).where("rest is not null")
    bare = text.strip_badges(F.col("rest"))
    t = t.withColumn("kept", F.when(bare == "", F.col("rest")).otherwise(bare))
    points = 62 + log_points(F.col("n"), 12, 20) + F.when(F.col("n") > 5, 6).otherwise(0)
    said = signals(
        (True, signal("strong", "The title begins with the artist's name")),
        (F.col("kept") != F.col("rest"), signal("strong", "It also ends with a video page's badge")),
        (True, signal("medium", number(F.col("n")), " play(s) with this form")),
    )
    return finding(
        t, 7, "artist_in_title", "", "strip_artist_from_title",
        title=F.concat(F.lit("Title repeats the artist: "), quoted(F.col("title"))), points=points, impact=F.col("n"),
        current=F.concat("artist", F.lit(" — "), "title"), proposed=F.col("kept"), seen=F.col("seen"), signals=said,
        targets=F.array(target(F.col("artist"), F.col("title"))), marks=F.array(mark("title", F.col("artist"), F.col("title"))),
        evidence=F.array(item(F.col("title"), plays(F.col("n")))), shown=rules.evidence_items,
        explanation=F.concat(F.lit("The artist field says "), quoted(F.col("artist")), F.lit(" already; video pages put the name into the title as well.")),
    )
