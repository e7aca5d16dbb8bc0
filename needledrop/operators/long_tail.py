"""Findings about the long tail: rare names near frequent ones, untidy text, missing albums, rare artists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop.functions import text
from needledrop.operators import pairs as P
from needledrop.operators.findings import finding, item, mark, number, plays, quoted, signal, signals, span, target
from needledrop.plans.index import Index
from needledrop.plans.storage import written
from needledrop.rules import Rules

GARBLED = r"[^\p{L}\p{N}\s'&.,\-]"
#: Names that stand for no artist, and spaces and invisible characters that a tag shouldn't hold.
GENERIC = r"(?i)^(?:unknown artist|unknown|various artists|artista desconocido|va|vv\.?aa\.?|desconocido)$"
WHITE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
ODD_SPACES = "[\N{NO-BREAK SPACE}\N{EN QUAD}-\N{HAIR SPACE}\N{NARROW NO-BREAK SPACE}\N{MEDIUM MATHEMATICAL SPACE}\N{IDEOGRAPHIC SPACE}]"
UNSEEN = "[\N{ZERO WIDTH SPACE}-\N{RIGHT-TO-LEFT MARK}\N{ZERO WIDTH NO-BREAK SPACE}]"
EXAMPLES, EMPTY_ROWS, PARTS = 8, 40, 64
#: Stands for white space that would not be seen.
SEEN = "␣"


def visible(c: Column) -> Column:
    """A value as an example: white space other than single spaces inside it becomes a sign, one for a run at the ends."""
    ends = F.regexp_replace(F.regexp_replace(c, f"^[{WHITE}]+", SEEN), f"[{WHITE}]+\\z", SEEN)
    return F.regexp_replace(ends, f"[{WHITE}&&[^ ]]", SEEN)


def artist_typos(index: Index, rules: Rules) -> DataFrame:
    p = written(P.nearest_frequent(index.artists, rules), "nearest")
    p = P.time_mix(P.shared_tracks(p, index.tracks), index, rules.sitting_window_ms)
    own = index.artists.select("artist", "n", "key", "first", "last")
    p = p.join(own.toDF("x", "n", "x_key", "x_first", "x_last"), "x").join(own.toDF("y", "y_n", "y_key", "y_first", "y_last"), "y")
    inside = text.contains_words(F.col("y_key"), F.col("x_key"))
    garbled = F.col("x").rlike(GARBLED)
    p = p.where((F.col("apart") <= rules.typo_distance) | inside)
    if rules.require_shared_track:
        p = p.where((F.col("shared") > 0) | garbled)
    add = lambda c, k: F.when(c, k).otherwise(0)
    short = (F.length("x_key") <= 4) & (F.col("apart") > 0) & ~inside
    points = 25 + F.when(inside, 20).when(F.col("apart") == 1, 15).otherwise(8) + add(F.col("shared") > 0, 20) + add(F.col("mix") > 0, 15) - add(short, 10) + add(garbled, 20)
    said = signals(
        (inside, signal("strong", "The name is part of ", quoted(F.col("y")))),
        (~inside, signal("medium", "It is ", number(F.col("apart")), " character(s) from ", quoted(F.col("y")))),
        (F.col("shared") > 0, signal("strong", "They share ", number(F.col("shared")), " track(s)")),
        (F.col("mix") > 0, signal("strong", number(F.col("mix")), " play(s) fall within minutes of plays of the other")),
        (short, signal("note", "The name is very short")),
        (garbled, signal("strong", "The name holds unusual characters")),
        (True, signal("note", "Only ", number(F.col("n")), " play(s)")),
    )
    return finding(
        p, 11, "long_tail", "possible_typo", "rename_artist",
        title=F.concat(F.lit("Is "), quoted(F.col("x")), F.lit(" really "), quoted(F.col("y")), F.lit("?")),
        points=points, impact=F.col("n"), current=F.col("x"), proposed=F.col("y"), seen=-F.col("n"), signals=said,
        targets=F.array(target(F.col("x"))), marks=F.array(mark("artist", F.col("x"))),
        evidence=F.array(
            *(item(quoted(F.col(s)), F.concat(plays(n), F.lit(", "), span(F.col(f"{s}_first"), F.col(f"{s}_last")))) for s, n in (("x", F.col("n")), ("y", F.col("y_n")))),
            item("Tracks in common", number(F.col("shared"))),
        ),
        shown=rules.evidence_items,
        explanation=F.concat(quoted(F.col("x")), F.lit(" is rare and close to "), quoted(F.col("y")), F.when(F.col("shared") > 0, ", and they have a track in common: very likely a slip.").otherwise(". They have no track in common, so look first.")),
    )


def untidy(index: Index) -> DataFrame:
    """(problem, n, examples): every check of every field, and missing fields; examples in order of appearance.

    White space is that of Unicode, and what can't be seen of it is marked in the examples.
    """
    checks = []  # fixed values: the names of the problems
    for f in ("artist", "title", "album"):
        v = F.col(f)
        tests = {
            f"leading or trailing spaces in the {f}": v.rlike(f"^[{WHITE}]|[{WHITE}]\\z"),
            f"double spaces in the {f}": v.rlike(f"[{WHITE}]{{2}}"),
            f"unusual (non-breaking) spaces in the {f}": v.rlike(ODD_SPACES),
            f"invisible characters in the {f}": v.rlike(UNSEEN),
            f"unreadable characters in the {f}": v.contains("\N{REPLACEMENT CHARACTER}"),
        }
        if f == "artist":
            tests["generic artist name"] = v.rlike(GENERIC)
        checks += [F.when((v != "") & t, F.struct(F.lit(name).alias("problem"), visible(v).alias("value"))) for name, t in tests.items()]
        checks.append(F.when(v == "", F.struct(F.lit(f"scrobbles with no {f}").alias("problem"), F.lit("(empty)").alias("value"))))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    each = index.cells.select(F.explode(found).alias("x"), "n", "seen").groupBy("x.problem", "x.value").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    # the first of each part of a problem's values, then the first of those: no task sorts all values of a problem
    part = Window.partitionBy("problem", F.pmod(F.xxhash64("value"), F.lit(PARTS))).orderBy("seen", "value")
    parted = each.withColumn("r", F.row_number().over(part)).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(PARTS)))
    example = F.when(F.col("r") <= EXAMPLES, F.struct("seen", "value"))
    sums = parted.groupBy("problem", "part").agg(F.sum("n").alias("n"), F.collect_list(example).alias("first"))
    shown = F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, EXAMPLES), lambda e: e["value"])
    return sums.groupBy("problem").agg(F.sum("n").alias("n"), shown.alias("examples"))


def empty_albums(index: Index) -> DataFrame:
    """(artist, title, n, seen): the plays without an album by track, most first, as many as the report shows."""
    t = index.cells.where("album = ''").groupBy("artist", "title").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    return t.orderBy(F.col("n").desc(), "seen").limit(EMPTY_ROWS)


def rare_artists(index: Index, rules: Rules) -> DataFrame:
    """(artist, n, first, last) of all artists with few plays, most first, then by name."""
    return index.artists.where(F.col("n") <= rules.rare_artist_plays).select("artist", "n", "first", "last")


def notes(index: Index, rules: Rules) -> DataFrame:
    """The informational findings: untidy text, missing albums, rare artists; each only if there is any."""
    problems = untidy(index)
    messy = problems.where("problem <> 'scrobbles with no album'").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "problem", "n", "examples"))).alias("all")
    ).where("n > 0")  # a few rows: one for each check
    texts = F.transform(F.slice("all", 1, 6), lambda x: F.struct(F.concat(number(x["n"]), F.lit(" × "), x["problem"]).alias("text"), F.lit("medium").alias("level")))
    shown = lambda x: F.concat(number(x["n"]), F.lit(": "), F.array_join(F.transform(x["examples"], quoted), ", "))
    items = F.transform("all", lambda x: F.struct(x["problem"].alias("a"), shown(x).alias("b")))
    zero = F.lit(0)
    hygiene = finding(
        messy, 12, "long_tail", "hygiene", "review", title=F.concat(F.lit("Untidy text: "), number(F.col("n")), F.lit(" plays")), points=F.lit(70),
        impact=F.col("n"), current=F.lit("various tags"), proposed=F.lit("(normalise)"), seen=zero, signals=texts, evidence=items, shown=rules.table_rows, informational=True,
    )
    one = F.lit(1).alias("one")
    table = lambda rows, order, a: rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), *order, a.alias("a"), number(F.col("n")).alias("b")))).alias("rows")).select("rows", one)
    listed = F.transform("rows", lambda x: F.struct(x["a"], x["b"]))
    none = problems.where("problem = 'scrobbles with no album'").select("*", one)
    none = none.join(F.broadcast(table(empty_albums(index), ["seen"], F.concat_ws(" — ", "artist", "title"))), "one")  # one row each
    count = F.concat(number(F.col("n")), F.lit(" scrobbles with no album"))
    empty = finding(
        none, 13, "long_tail", "empty", "review", title=count, points=F.lit(45), impact=zero, current=count, proposed=F.lit("(only if you know which one)"),
        seen=zero, signals=F.array(signal("info", "A missing album need not be a mistake")), evidence=listed, shown=rules.table_rows, informational=True,
    )
    all_rare = rare_artists(index, rules)
    first = all_rare.orderBy(F.col("n").desc(), "artist").limit(rules.table_rows)
    few = all_rare.agg(F.count("*").alias("n")).where("n > 0").select("*", one).join(F.broadcast(table(first, ["artist"], F.col("artist"))), "one")
    rare = finding(
        few, 14, "long_tail", "rare_artists", "review", points=zero, impact=zero, seen=zero, informational=True,
        title=F.concat(number(F.col("n")), F.lit(f" artists with {rules.rare_artist_plays} scrobble(s) or fewer")),
        current=F.concat(number(F.col("n")), F.lit(" artists")), proposed=F.lit("(review by hand)"), signals=F.array(signal("info", "Misspellings often hide here")), evidence=listed, shown=rules.table_rows,
    )
    return hygiene.unionByName(empty).unionByName(rare)
