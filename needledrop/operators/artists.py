"""Findings about artist names: duplicates, near-duplicates and names that join several artists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop.functions import text
from needledrop.operators import pairs as P
from needledrop.functions import format as show
from needledrop.operators.findings import EVIDENCE, JOINED, VARIANTS, finding, item, mark, number, plays, preference, quoted, signal, signals, span, target
from needledrop.plans.index import Index
from needledrop.plans.storage import written
from needledrop.rules import Rules

WEEK = 7 * 86_400_000
#: Signals of its pairs that a finding about duplicate artists shows.
SAID = 9


def beside(pairs: DataFrame, artists: DataFrame, side: str, *columns: str) -> DataFrame:
    """``pairs`` with an artist's columns of ``side`` (x or y), named x_n, y_n ..."""
    return pairs.join(artists.select(F.col("artist").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)


def overlap(*, first: tuple[Column, Column], last: tuple[Column, Column]) -> Column:
    """struct(begin, end) of the time in which both have plays; null if there is none or a date is missing."""
    begin, end = F.greatest(*first), F.least(*last)
    known = first[0].isNotNull() & first[1].isNotNull()
    return F.when(known & (end > begin), F.struct(begin.alias("begin"), end.alias("end")))


def pair_signals() -> Column:
    """What speaks for a pair (x, y) of the same artist; its columns are those of ``merge_pairs``."""
    shared, fewest, mix, both = F.col("shared"), F.col("min_tracks"), F.col("mix"), F.col("overlap")
    x_fewer = F.col("x_n_tracks") <= F.col("y_n_tracks")
    fewer, more = F.when(x_fewer, F.col("x")).otherwise(F.col("y")), F.when(x_fewer, F.col("y")).otherwise(F.col("x"))
    return signals(
        (F.col("relation") == "identical", signal("strong", "Only capitals, accents or punctuation tell ", quoted(F.col("x")), " from ", quoted(F.col("y")))),
        (F.col("relation") == "containment", signal("strong", quoted(F.col("y")), " has all words of ", quoted(F.col("x")))),
        (True, signal("strong", "They share ", number(shared), " of ", number(fewest), " track(s), ", show.percent(shared / fewest))),
        ((shared == fewest) & (shared > 0), signal("alarm", "Every track of ", quoted(fewer), " is also under ", quoted(more))),
        (mix > 0, signal("strong", number(mix), " play(s) of one fall within minutes of plays of the other")),
        (fewest < 3, signal("note", "A small sample: ", quoted(fewer), " has ", number(fewest), " track(s)")),
        (both.isNotNull(), signal("medium", "Both were played between ", show.short_date(both["begin"]), " and ", show.short_date(both["end"]))),
    )


def merge_pairs(index: Index, rules: Rules) -> tuple[DataFrame, int]:
    """(x, y, relation, shared, min_tracks, mix, overlap, points, strong, ...): x has the shorter key; and how many pairs shared no track."""
    same = P.same_key_pairs(index.artists).withColumn("relation", F.lit("identical"))
    inside = P.containment_pairs(index.artists).withColumn("relation", F.lit("containment"))
    found = written(P.shared_tracks(same.unionByName(inside), index.tracks), "merge-pairs")
    kept = found.where((F.col("relation") == "identical") | (F.col("shared") > 0)) if rules.require_shared_track else found
    dropped = found.count() - kept.count() if rules.require_shared_track else 0
    p = beside(beside(kept, index.artists, "x", "n_tracks", "first", "last"), index.artists, "y", "n_tracks", "first", "last")
    p = p.withColumn("overlap", overlap(first=(F.col("x_first"), F.col("y_first")), last=(F.col("x_last"), F.col("y_last"))))
    p = P.time_mix(p.withColumn("min_tracks", F.least("x_n_tracks", "y_n_tracks")), index, rules.sitting_window_ms)
    points = (
        40 * (F.col("shared") + 0.5) / (F.col("min_tracks") + 1)
        + 15 * (F.least("shared", F.lit(20)) / 20)
        + F.when(F.col("relation") == "identical", 20).otherwise(15)
        + 15 * (F.least("mix", F.lit(10)) / 10)
        + 10 * (F.least("min_tracks", F.lit(8)) / 8)
    )
    good = (F.col("shared") >= 1) & (F.col("shared") / F.col("min_tracks") >= 0.6) & (F.col("min_tracks") >= 2)
    strong = (F.col("relation") == "identical") | good
    return written(p.withColumns({"points": points, "strong": strong}), "merge-scored"), dropped


def resolutions(index: Index) -> DataFrame:
    """(artist, base, base_key, part, parts, first_exists, n_bases, siblings) of names that join artists one of which exists.

    The base is the first part, as written, that is an artist of its own; the first in the list of artists if several are.
    """
    combined = index.artists.where(F.size("parts") > 1).select("artist", "n", "key", "parts")
    parts = combined.select("artist", "n", F.posexplode("parts").alias("pos", "part")).withColumn("part_key", text.artist_key(F.col("part")))
    own = index.artists.select(F.col("artist").alias("base"), F.col("key").alias("base_key"), F.col("n").alias("base_n"))
    hits = parts.join(own, (F.col("part_key") == F.col("base_key")) & (F.col("artist") != F.col("base")))
    hits = P.first_by(hits, ["artist", "pos"], [F.col("base_n").desc(), F.col("base")])
    bases = hits.groupBy("artist", "n").agg(
        F.min_by(F.struct("pos", "part", "base", "base_key", "base_n"), "pos").alias("b"), F.array_sort(F.collect_list(F.struct("pos", "part", "base", "base_n"))).alias("bases")
    )
    bases = bases.select("artist", "n", "b.*", "bases").where((F.col("base_n") >= 2) & (F.col("base_n") >= 0.05 * F.col("n")))
    again = index.artists.select(F.col("artist").alias("sibling"), F.col("key"), F.col("n").alias("sibling_n"), "first", "last")
    siblings = combined.select("artist", "key").join(again, "key").where("artist <> sibling").groupBy("artist")
    siblings = siblings.agg(F.array_sort(F.collect_list(F.struct((-F.col("sibling_n")).alias("less"), "sibling", "sibling_n", "first", "last"))).alias("siblings"))
    out = bases.join(combined.select("artist", "key", "parts"), "artist").join(siblings, "artist", "left")
    return out.withColumn("siblings", F.coalesce("siblings", F.array().cast("array<struct<less: bigint, sibling: string, sibling_n: bigint, first: bigint, last: bigint>>")))


def combined_artists(index: Index, rules: Rules, resolved: DataFrame | None = None) -> DataFrame:
    r = written(resolved if resolved is not None else resolutions(index), "resolutions")
    p = r.withColumnsRenamed({"artist": "x", "base": "y"})
    p = P.time_mix(P.shared_tracks(p, index.tracks), index, rules.sitting_window_ms)
    p = beside(beside(p, index.artists, "x", "first", "last"), index.artists, "y", "first")
    names = F.concat(F.array("x"), F.transform("siblings", lambda s: s["sibling"]))
    impact = F.col("n") + F.aggregate("siblings", F.lit(0).cast("bigint"), lambda a, s: a + s["sibling_n"])
    near = (F.abs(F.coalesce("x_last", F.lit(0)) - F.coalesce("y_first", F.lit(0))) < WEEK) | (F.col("mix") > 0)
    first = F.get("parts", F.lit(0))
    leads = text.artist_key(first) == F.col("base_key")
    several, few_plays, siblings = F.size("bases") > 1, F.col("n") <= 5, F.size("siblings") > 0
    add = lambda c, k: F.when(c, k).otherwise(0)
    points = F.lit(55) + add(~leads, -8) + add(several, -6) + add(few_plays, 12) + add(F.col("base_n") >= 20, 8) + add(near, 8) + add(F.col("shared") > 0, 12) + add(siblings, 4)
    others = F.transform(F.slice("bases", 2, F.greatest(F.size("bases") - 1, F.lit(0))), lambda b: F.concat(quoted(b["base"]), F.lit(" ("), number(b["base_n"]), F.lit(")")))
    again = F.array_join(F.transform("siblings", lambda v: quoted(v["sibling"])), ", ")
    said = signals(
        (True, signal("medium", "The name joins several artists by “", text.separator(F.col("x")), "”")),
        (True, signal("strong", quoted(F.col("y")), " exists on its own with ", number(F.col("base_n")), " plays")),
        (~leads, signal("note", "The first artist of the name, ", quoted(first), ", is not there on its own")),
        (several, signal("info", "More of its artists are there on their own: ", F.array_join(others, ", "))),
        (few_plays, signal("medium", "Only ", number(F.col("n")), " play(s) under the joined name")),
        (near, signal("medium", "Its plays fall close in time to those of the proposed artist")),
        (F.col("shared") > 0, signal("strong", number(F.col("shared")), " track(s) also exist under ", quoted(F.col("y")))),
        (siblings, signal("strong", "The same name is also written as ", again, ", ", number(impact - F.col("n")), " play(s)")),
    )
    current = F.array_join(names, JOINED)
    rest = F.filter("parts", lambda q: q != F.col("part"))
    other = lambda q: F.struct(q.alias("value"), F.lit("part of the joined name").alias("reason"), current.alias("current"), q.alias("proposed"), impact.alias("impact"))
    warning = F.when(~leads, F.concat(F.lit("The name starts with "), quoted(first), F.lit(", which is no artist of its own here: check before renaming.")))
    items = P.shared_titles(p.select(F.col("x").alias("id"), "x", "y"), index.tracks, rules.evidence_items, lambda n, m: F.concat(number(n), F.lit(" + "), number(m), F.lit(" plays")))
    p = p.join(items.withColumnRenamed("id", "x"), "x", "left")
    why = F.concat(
        plays(impact), F.lit(" stand under a name of "), number(F.size("parts")), F.lit(" artists. "), quoted(F.col("y")), F.lit(" is in the log on its own, so the plays probably belong there and the rest ("),
        F.array_join(rest, ", "), F.lit(") is a guest. Leave it if the name is that of a group."),
    )
    joined = F.struct(F.col("x").alias("value"), F.col("n"), F.col("x_first").alias("first"), F.col("x_last").alias("last"), F.lit(False).alias("canonical"))
    forms = F.concat(F.array(joined), F.transform("siblings", lambda v: F.struct(v["sibling"].alias("value"), v["sibling_n"].alias("n"), v["first"].alias("first"), v["last"].alias("last"), F.lit(False).alias("canonical"))))
    return finding(
        p, 3, "combined_artists", "", "split_combined",
        title=F.concat(quoted(F.col("x")), F.lit(" → "), quoted(F.col("y"))),
        points=points, impact=impact, current=current, proposed=F.col("y"), seen=-F.col("n"),
        signals=said, alternatives=F.transform(rest, other), warning=warning, explanation=why, variants=F.when(siblings, forms).otherwise(F.array().cast(VARIANTS)),
        targets=F.transform(names, lambda n: target(n)), marks=F.transform(names, lambda n: mark("artist", n)),
        evidence=F.coalesce("items", F.array().cast(EVIDENCE)), shown=rules.evidence_items, beyond=F.greatest(F.coalesce("total", F.lit(0)) - rules.evidence_items, F.lit(0)),
    )


def duplicate_artists(index: Index, rules: Rules, scored: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pairs, and groups of names that two or more strong pairs connect, with the form to keep."""
    strong = scored.where("strong")
    labels = P.components(strong.select(F.col("x").alias("a"), F.col("y").alias("b")))
    at = scored.join(labels.toDF("x", "label"), "x", "left").withColumn("group", F.coalesce("label", "x")).drop("label")
    sizes = at.groupBy("group").agg(F.count_if("strong").alias("strong_pairs"))
    at = written(at.join(sizes, "group").withColumn("said", pair_signals()), "merge-groups")
    grouped = at.where("strong_pairs > 1").select("group", F.explode(F.array("x", "y")).alias("name")).distinct()
    in_groups = grouped.select("name").distinct()
    alone = at.where("strong_pairs <= 1").join(in_groups.toDF("x"), "x", "left_anti").join(in_groups.toDF("y"), "y", "left_anti")
    case_of = F.concat(F.lit("p:"), "x", F.lit("\0"), "y")
    own_pairs = at.where("strong_pairs > 1").withColumn("id", F.concat(F.lit("g:"), "group")).unionByName(alone.withColumn("id", case_of))
    own_pairs = written(own_pairs.select("id", "x", "y", "points", "relation", "shared", "min_tracks", "said"), "merge-cases")
    cases = own_pairs.groupBy("id").agg(
        F.count("*").alias("pairs"), F.max("points").alias("points"), F.max("relation").alias("relation"), F.max("shared").alias("shared"),
        F.bool_or((F.col("shared") == F.col("min_tracks")) & (F.col("shared") > 0)).alias("whole"),
    )
    # what the strongest pairs of a case say, each sentence once
    strongest = P.first_by(own_pairs.select("id", "x", "y", "points", "said"), ["id"], [F.col("points").desc(), F.col("x"), F.col("y")], SAID)
    said = strongest.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("less"), "x", "y", "said"))).alias("each"))
    said = said.select("id", F.slice(F.array_distinct(F.flatten(F.transform("each", lambda e: e["said"]))), 1, SAID).alias("pair_said"))
    items = P.shared_titles(own_pairs.select("id", "x", "y"), index.tracks, rules.evidence_items, lambda n, m: F.concat(number(n), F.lit(" + "), number(m), F.lit(" plays")))
    members = grouped.select(F.concat(F.lit("g:"), "group").alias("id"), "name", F.lit(0).alias("place"))
    members = members.unionByName(alone.select(case_of.alias("id"), F.posexplode(F.array("x", "y")).alias("place", "name")).select("id", "name", "place"))
    forms = members.join(index.artists.select(F.col("artist").alias("name"), "n", "first", "last"), "name")
    w = Window.partitionBy("id")
    wanted = preference(rules, F.col("name"), F.col("n"), F.col("last"), F.max("last").over(w), F.min("last").over(w))
    forms = forms.withColumn("wanted", wanted)
    best = F.max_by("name", F.struct("wanted", (-F.col("place")).alias("early"), "n", "name"))
    form = F.struct("name", "n", "first", "last")
    kept = forms.groupBy("id").agg(
        best.alias("canonical"), F.collect_list(F.struct((-F.col("n")).alias("less"), "name", "n", "first", "last")).alias("forms"),
        F.max_by(form, F.struct("n", "name")).alias("most"), F.max_by(form, F.struct(F.coalesce("last", F.lit(0)).alias("last"), "n", "name")).alias("latest"),
    )
    kept = kept.join(resolved.select(F.col("artist").alias("canonical"), "base"), "canonical", "left")
    known = F.exists("forms", lambda f: f["name"] == F.col("base"))
    kept = kept.withColumn("target", F.when(F.col("base").isNotNull() & ~known, F.col("base")).otherwise(F.col("canonical")))
    d = kept.join(cases, "id").join(said, "id").join(items, "id", "left").withColumn("forms", F.array_sort("forms"))
    d = d.withColumn("others", F.filter("forms", lambda f: f["name"] != F.col("target")))
    total = F.aggregate("forms", F.lit(0).cast("bigint"), lambda a, f: a + f["n"])
    d = d.withColumns({"impact": F.aggregate("others", F.lit(0).cast("bigint"), lambda a, f: a + f["n"]), "total_n": total}).where("impact > 0")
    current = F.array_join(F.transform("others", lambda f: f["name"]), JOINED)
    one = F.size("others") == 1
    first = F.get("others", F.lit(0))["name"]

    def swap(f: Column) -> Column:
        """All other forms become this one. They are not listed in each option, which would grow with the square of a group: ``current`` is null and stands for the finding's other variants."""
        reason = F.concat(number(f["n"]), F.lit(" plays, "), span(f["first"], f["last"]))
        return F.struct(f["name"].alias("value"), reason.alias("reason"), F.lit(None).cast("string").alias("current"), f["name"].alias("proposed"), (F.col("total_n") - f["n"]).alias("impact"))

    latest, most, redirected = F.col("latest"), F.col("most"), F.col("target") != F.col("canonical")
    more = signals(
        (redirected, signal("strong", quoted(F.col("canonical")), " itself joins several artists, so every form goes to ", quoted(F.col("target")))),
        (~redirected & (latest["name"] != F.col("canonical")), signal("note", "The latest play is under ", quoted(latest["name"]), " (", show.short_date(latest["last"]), "), the most plays under ", quoted(most["name"]), " (", number(most["n"]), ")")),
        (~redirected & (latest["name"] == F.col("canonical")), signal("medium", "The latest play is under the form to keep, ", quoted(F.col("canonical")))),
    )
    why = F.concat(
        number(F.size("forms")), F.lit(" names with "), plays(F.col("total_n")), F.lit(" in all seem to be one artist"),
        F.when(F.col("shared") > 0, F.concat(F.lit(", with up to "), number(F.col("shared")), F.lit(" track(s) in common"), F.when(F.col("whole"), ", all that one of them has").otherwise(""))).otherwise(""),
        F.lit(". Two artists with the same songs are possible. Keeping "), quoted(F.col("target")), F.lit(" changes "), plays(F.col("impact")), F.lit("."),
    )
    return finding(
        d, 1, "duplicate_artists", F.when(F.col("pairs") > 1, "group").otherwise(F.col("relation")), "rename_artist",
        title=F.concat(F.when(one, quoted(first)).otherwise(F.concat(F.size("others").cast("string"), F.lit(" forms of the same artist"))), F.lit(" → "), quoted(F.col("target"))),
        points=F.col("points"), impact=F.col("impact"), current=current, proposed=F.col("target"), seen=-F.col("impact"),
        signals=F.concat("pair_said", more), alternatives=F.transform("others", swap), explanation=why,
        targets=F.transform("others", lambda f: target(f["name"])), marks=F.transform("others", lambda f: mark("artist", f["name"])),
        evidence=F.coalesce("items", F.array().cast(EVIDENCE)), shown=rules.evidence_items, beyond=F.greatest(F.coalesce("total", F.lit(0)) - rules.evidence_items, F.lit(0)),
        variants=F.transform("forms", lambda f: F.struct(f["name"].alias("value"), f["n"].alias("n"), f["first"].alias("first"), f["last"].alias("last"), (f["name"] == F.col("target")).alias("canonical"))),
    )


def similar_names(index: Index, rules: Rules) -> DataFrame:
    p = P.time_mix(P.shared_tracks(written(P.similar_pairs(index.artists, rules), "similar"), index.tracks), index, rules.sitting_window_ms)
    for side in "xy":
        p = beside(p, index.artists, side, "n", "first", "last", "n_tracks")
    newest, oldest = F.greatest("x_last", "y_last"), F.least("x_last", "y_last")
    of = lambda s: preference(rules, F.col(s), F.col(f"{s}_n"), F.col(f"{s}_last"), newest, oldest)
    keep_x = of("x") >= of("y")
    suspect, kept = F.when(keep_x, F.col("y")).otherwise(F.col("x")), F.when(keep_x, F.col("x")).otherwise(F.col("y"))
    impact = F.when(keep_x, F.col("y_n")).otherwise(F.col("x_n"))
    renamed = F.coalesce((F.col("x_last") <= F.col("y_first")) | (F.col("y_last") <= F.col("x_first")), F.lit(False))
    shared, fewest = F.col("shared"), F.least("x_n_tracks", "y_n_tracks")
    mix = F.least("mix", F.lit(10)) / 10
    with_tracks = (
        18 + 30 * ((shared + 0.5) / (fewest + 1)) + 12 * (F.least(shared, F.lit(20)) / 20) + 12 * mix + 12 * F.col("strength")
        + F.when(renamed, 6).otherwise(0) + F.when(shared == fewest, 12).otherwise(0)
    )
    without = 22 + 26 * F.col("strength") + 10 * mix + F.when(renamed, 8).otherwise(0)
    some = shared > 0
    from_x = F.col("x_last") <= F.col("y_first")
    before, after = F.when(from_x, F.col("x")).otherwise(F.col("y")), F.when(from_x, F.col("y")).otherwise(F.col("x"))
    ends, begins = F.when(from_x, F.col("x_last")).otherwise(F.col("y_last")), F.when(from_x, F.col("y_first")).otherwise(F.col("x_first"))
    said = signals(
        (F.col("kind") == "ratio", signal("medium", "The names are ", number(F.col("apart")), " character(s) apart")),
        (F.col("kind") == "abbreviation", signal("strong", "One word is the beginning of the other's, the rest is equal")),
        (some, signal("strong", "They share ", number(shared), " track(s)")),
        (F.col("mix") > 0, signal("strong", number(F.col("mix")), " play(s) of one fall within minutes of plays of the other")),
        (renamed, signal("strong", quoted(before), " ends on ", show.short_date(ends), " and ", quoted(after), " begins on ", show.short_date(begins), ", as after a rename")),
        (True, signal("info", quoted(F.col("x")), " has ", number(F.col("x_n")), " play(s), ", quoted(F.col("y")), " ", number(F.col("y_n")))),
        (some & (shared == fewest), signal("alarm", "Every track of one also exists under the other")),
    )
    items = P.shared_titles(p.where("shared > 0").select(F.concat("x", F.lit("\0"), "y").alias("id"), "x", "y"), index.tracks, rules.evidence_items, lambda n, m: F.concat(number(n), F.lit(" + "), number(m), F.lit(" plays")))
    p = p.withColumn("id", F.concat("x", F.lit("\0"), "y")).join(items, "id", "left")
    names = F.array(*(item(quoted(F.col(s)), F.concat(plays(F.col(f"{s}_n")), F.lit(", "), span(F.col(f"{s}_first"), F.col(f"{s}_last")))) for s in "xy"), item("Tracks in common", number(shared)))
    why = F.when(some, F.concat(F.lit("Two spellings with "), number(shared), F.lit(" track(s) in common are very likely one artist; the change moves "), plays(impact), F.lit("."))).otherwise(
        F.lit("Alike names without a common track: a slip or a rename, or two artists. The rarer form is more often the slip.")
    )
    return finding(
        p, 2, "duplicate_artists", F.when(some, "similar_with_tracks").otherwise("similar_names"), F.when(some, "rename_artist").otherwise("review_artist"),
        title=F.concat(quoted(suspect), F.lit(" → "), quoted(kept), F.when(some, "").otherwise("?")),
        points=F.when(some, with_tracks).otherwise(without), impact=impact, current=suspect, proposed=kept, seen=-impact, signals=said, explanation=why,
        alternatives=F.array(F.struct(suspect.alias("value"), F.lit("the other name").alias("reason"), kept.alias("current"), suspect.alias("proposed"), F.when(keep_x, F.col("x_n")).otherwise(F.col("y_n")).alias("impact"))),
        warning=F.when(~some, "Alike names can be different artists, and these share no track."),
        targets=F.array(target(suspect)), marks=F.array(mark("artist", suspect)),
        evidence=F.when(some, F.col("items")).otherwise(names), shown=rules.evidence_items, beyond=F.greatest(F.coalesce("total", F.lit(0)) - rules.evidence_items, F.lit(0)),
    )
