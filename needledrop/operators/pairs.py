"""Pairs of names: candidates by blocking, shared tracks, proximity in time, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop.functions import text
from needledrop.operators.near import own_keys, probed_keys
from needledrop.plans.index import Index, moments
from needledrop.plans.order import first_by
from needledrop.plans.storage import small, written
from needledrop.rules import Rules


def listed_before(a: str, b: str) -> Column:
    """Whether artist row ``a`` comes before ``b`` in the list of artists: more plays first, then by name."""
    more, same = F.col(f"{a}.n") > F.col(f"{b}.n"), F.col(f"{a}.n") == F.col(f"{b}.n")
    return more | (same & (F.col(f"{a}.artist") < F.col(f"{b}.artist")))


def same_key_pairs(artists: DataFrame) -> DataFrame:
    """(x, y): different names with one key; ``x`` is listed first."""
    own = artists.where("key <> ''")
    return own.alias("a").join(own.alias("b"), (F.col("a.key") == F.col("b.key")) & listed_before("a", "b")).select(F.col("a.artist").alias("x"), F.col("b.artist").alias("y"))


def containment_pairs(artists: DataFrame) -> DataFrame:
    """(x, y): ``x``'s key lies in ``y``'s, word for word; names that join several artists have no part.

    A key that contains another one holds all its words, so each key is looked up under its rarest word only.
    """
    own = artists.where((F.col("key") != "") & (F.size("parts") < 2)).select("artist", "key", F.explode(F.array_distinct(text.words(F.col("key")))).alias("word"))
    counts = own.groupBy("word").agg(F.count("*").alias("df"))
    rarest = own.join(counts, "word").groupBy("artist", "key").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    found = rarest.alias("a").join(own.alias("b"), F.col("a.word") == F.col("b.word"))
    found = found.where(text.contains_words(F.col("b.key"), F.col("a.key")))
    return found.select(F.col("a.artist").alias("x"), F.col("b.artist").alias("y"))


def similar_pairs(artists: DataFrame, rules: Rules) -> DataFrame:
    """(x, y, kind, strength, apart): keys that are nearly equal, or equal but for one abbreviated word; ``x`` is listed first.

    Both share the first letter. Nearly equal keys meet under a segment that they share; how many edits the longer one's
    length allows decides how many segments there are. Abbreviations meet under a letter and the words with one left out.
    """
    own = artists.where((F.length("key") >= rules.similar_name_length) & (F.size("parts") < 2)).select("artist", "n", "key")
    own = own.withColumn("initial", F.substring("key", 1, 1))
    edits = range(1, rules.similar_name_distance + 1)
    # a little more than what is allowed, in case a product comes out just below a whole number
    allowed = F.least(F.lit(rules.similar_name_distance), F.floor(F.length("key") * (1 - rules.similar_name_threshold) + 1e-6))
    put = own.withColumn("near", F.explode(F.flatten(F.array(*(own_keys(F.col("key"), k) for k in edits)))))
    probes = F.coalesce(*(F.when(allowed == k, probed_keys(F.col("key"), k, k, 0)) for k in edits), F.array())
    d = F.levenshtein(F.col("a.key"), F.col("b.key"), rules.similar_name_distance)
    size = F.greatest(F.length("a.key"), F.length("b.key"))
    probing = own.withColumn("near", F.explode(probes))
    ratio = put.alias("a").join(probing.alias("b"), (F.col("a.initial") == F.col("b.initial")) & (F.col("a.near") == F.col("b.near")))
    ratio = ratio.where((F.length("a.key") < F.length("b.key")) | ((F.length("a.key") == F.length("b.key")) & (F.col("a.artist") < F.col("b.artist"))))
    ratio = ratio.withColumn("apart", d).where((F.col("apart") > 0) & (1 - F.col("apart") / size >= rules.similar_name_threshold))
    ratio = ratio.select(F.col("a.artist").alias("x"), F.col("b.artist").alias("y"), F.lit("ratio").alias("kind"), (1 - F.col("apart") / size).alias("strength"), "apart")
    ratio = ratio.distinct()  # once for each pair, however many segments it shares

    split = own.withColumn("w", F.split("key", " "))
    holes = F.transform("w", lambda w, i: F.struct(F.array_join(F.transform("w", lambda v, j: F.when(j == i, "").otherwise(v)), " ").alias("rest"), i.alias("hole")))
    split = split.withColumn("h", F.explode(holes)).select("artist", "n", "key", "initial", "h.rest", "h.hole")
    same = (F.col("a.initial") == F.col("b.initial")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.hole") == F.col("b.hole"))
    short = split.alias("a").join(split.alias("b"), same & (F.col("a.artist") < F.col("b.artist")) & (F.col("a.key") != F.col("b.key")))
    pair = text.abbreviation(F.col("a.key"), F.col("b.key"), rules.abbreviation_length, rules.abbreviation_extension)
    short = short.withColumn("pair", pair).where("pair is not null")
    strength = 0.9 + 0.1 * F.length("pair.short") / F.length("pair.long")
    short = short.select(F.col("a.artist").alias("x"), F.col("b.artist").alias("y"), F.lit("abbreviation").alias("kind"), strength.alias("strength"), F.lit(None).cast("int").alias("apart"))
    both = ratio.unionByName(short.join(ratio.select("x", "y").union(ratio.select("y", "x")), ["x", "y"], "left_anti"))

    a, b = own.alias("a"), own.alias("b")
    joined = both.join(a, F.col("x") == F.col("a.artist")).join(b, F.col("y") == F.col("b.artist"))
    apart = ~text.contains_words(F.col("a.key"), F.col("b.key")) & ~text.contains_words(F.col("b.key"), F.col("a.key"))
    first = listed_before("a", "b")
    return joined.where(apart & (F.col("a.key") != F.col("b.key"))).select(
        F.when(first, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("y"), "kind", "strength", "apart"
    )


def nearest_frequent(artists: DataFrame, rules: Rules) -> DataFrame:
    """(x, y, apart): for each rare artist ``x`` the frequent one of the same initial nearest to it, listed first on a tie.

    Frequent artists that are near meet it under a segment that they share. All others count as equally far, by the class of
    their key's length; so of them only the one listed first is looked at, or the second if the first has the same key.
    """
    rare = artists.where((F.col("n") <= rules.rare_artist_plays) & (F.col("key") != ""))
    often = artists.where((F.col("n") >= rules.frequent_artist_plays) & (F.col("key") != ""))
    at = F.substring("key", 1, 1).alias("initial")
    a, b = rare.select("artist", "key", at), often.select("artist", "key", "n", at, (F.length("key") > 10).alias("long"))
    most = rules.typo_distance
    own = b.withColumn("near", F.explode(own_keys(F.col("key"), most + 1)))
    probing = a.withColumn("near", F.explode(probed_keys(F.col("key"), most + 1, most + 1, most + 1)))
    both = lambda j: j.select(F.col("a.artist").alias("x"), F.col("a.key").alias("x_key"), "b.artist", "b.key", "b.n", "b.long")
    near = both(probing.alias("a").join(own.alias("b"), (F.col("a.initial") == F.col("b.initial")) & (F.col("a.near") == F.col("b.near")))).distinct()
    first = F.struct((-F.col("n")).alias("less"), "artist", "key", "n")
    of_key = b.groupBy("initial", "long", "key").agg(F.min(first).alias("first"))
    second = F.min_by("first", "first")
    head = of_key.groupBy("initial", "long").agg(F.min("first").alias("head"))
    rest = of_key.join(head, ["initial", "long"]).where(F.col("key") != F.col("head.key")).groupBy("initial", "long").agg(second.alias("head"))
    firsts = head.unionByName(rest).select("initial", "long", "head.*").drop("less")
    far = both(a.alias("a").join(firsts.alias("b"), F.col("a.initial") == F.col("b.initial")))
    pairs = near.unionByName(far).where((F.col("x") != F.col("artist")) & (F.col("x_key") != F.col("key")))
    d = F.when(F.col("long"), text.bounded_distance(F.col("x_key"), F.col("key"), most + 1)).otherwise(text.bounded_distance(F.col("x_key"), F.col("key"), most))
    best = F.min_by(F.struct(F.col("artist").alias("y"), d.alias("apart")), F.struct(d, -F.col("n"), F.col("artist")))
    return pairs.groupBy("x").agg(best.alias("best")).select("x", "best.*")


def shared_tracks(pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """``pairs`` (x, y, ...) with ``shared``, the number of track keys that both have."""
    own = tracks.select("artist", "track_key")
    at_x = pairs.select("x", "y").join(own.withColumnRenamed("artist", "x"), "x")
    common = at_x.join(own.withColumnRenamed("artist", "y"), ["y", "track_key"]).groupBy("x", "y").agg(F.count("*").alias("shared"))
    return pairs.join(common, ["x", "y"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def shared_titles(pairs: DataFrame, tracks: DataFrame, most: int, text: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, items, total): of the titles that both names of an ``id``'s pairs (id, x, y) have, the ``most`` played, and how many.

    ``text`` says an item's second part from the plays under both names. Each task keeps its first titles of an id before they
    are shuffled (a bounded top-k that merges), so no task holds all common tracks of two large artists.
    """
    own = tracks.select("artist", "track_key", "title", "n")
    at_x = pairs.select("id", "x", "y").join(own.toDF("x", "track_key", "a", "n"), "x")
    both = at_x.join(own.select(F.col("artist").alias("y"), "track_key", F.col("n").alias("m")), ["y", "track_key"])
    each = both.groupBy("id", "a").agg(F.max(F.struct((F.col("n") + F.col("m")).alias("total"), "n", "m")).alias("t"))
    each = written(each, "shared-titles")
    ranked = first_by(each, ["id"], [F.col("t.total").desc(), F.col("a")], most)
    items = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("t.total")).alias("less"), "a", text(F.col("t.n"), F.col("t.m")).alias("b")))).alias("first"))
    items = items.select("id", F.transform("first", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("items"))
    return items.join(each.groupBy("id").agg(F.count("*").alias("total")), "id")


#: Cells of time in a slot; what is in a slot's first or last cell is in the slot beside it as well.
SLOT = 32


def meetings(sides: DataFrame, plays: DataFrame, window_ms: int, times: DataFrame | None = None) -> DataFrame:
    """(few, many, artist, cell, n, lo, hi, u, v, slot): what meets in ``time_mix``, for pairs (few, many) and dated plays (artist, t).

    ``times`` are the plays' cells, if they are known (``Index.times``): one row for all plays of an artist in a cell. Those of
    ``few`` come once for each pair, under the other's name, with ``u`` and ``v`` null; those of ``many`` once each, and those at
    the ends of a slot in the one beside it too. So what moves is bounded by the cells of time, however many plays are in one.
    """
    times = moments(plays, window_ms) if times is None else times
    none, no, slot = F.lit(None).cast("string"), F.lit(None).cast("bigint"), lambda c: F.floor(c / SLOT)
    left = times.join(small(sides.select("few", "many").distinct().withColumn("artist", F.col("few"))), "artist")
    left = left.select("few", "many", F.col("many").alias("artist"), "cell", "n", "lo", "hi", no.alias("u"), no.alias("v"), slot(F.col("cell")).alias("slot"))
    others = times.join(small(sides.select(F.col("many").alias("artist")).distinct()), "artist", "left_semi")
    slots = F.array_distinct(F.array(slot(F.col("cell") - 1), slot(F.col("cell")), slot(F.col("cell") + 1)))
    return left.unionByName(others.select(none.alias("few"), none.alias("many"), "artist", "cell", no.alias("n"), no.alias("lo"), no.alias("hi"), F.col("lo").alias("u"), F.col("hi").alias("v"), F.explode(slots).alias("slot")))


def time_mix(pairs: DataFrame, index: Index, window_ms: int) -> DataFrame:
    """``pairs`` (x, y, ...) with ``mix``: plays of the one with fewer dated plays (x on a tie) near one of the other.

    An as-of semi-join over cells of time as wide as the window. If the other has a play in a cell, all plays in it are near one;
    else those near its last play in the cell before or its first in the cell after. Mostly that holds for all or none of a cell's
    plays, by the first and last of them; only those of the cells left over are looked at one by one.
    """
    dated = index.artists.select("artist", "dated")
    p = pairs.select("x", "y").join(dated.toDF("x", "dx"), "x").join(dated.toDF("y", "dy"), "y")
    swap = F.col("dy") < F.col("dx")
    p = written(p.select("x", "y", F.when(swap, F.col("y")).otherwise(F.col("x")).alias("few"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("many")), "pair-sides")
    w = Window.partitionBy("artist", "slot").orderBy("cell")
    at = lambda f, c, k: f(c).over(w.rangeBetween(k, k))
    met = meetings(p, index.dated, window_ms, index.times(window_ms)).withColumns({"here": at(F.max, "v", 0), "upto": at(F.max, "v", -1) + window_ms, "since": at(F.min, "u", 1) - window_ms})
    met = met.where(F.col("few").isNotNull() & F.coalesce("here", "upto", "since").isNotNull())
    true = lambda c: F.coalesce(c, F.lit(False))
    every = F.col("here").isNotNull() | true(F.col("hi") <= F.col("upto")) | true(F.col("lo") >= F.col("since")) | true(F.col("since") <= F.col("upto"))
    some = true(F.col("lo") <= F.col("upto")) | true(F.col("hi") >= F.col("since"))
    met = met.where(every | some).withColumn("cut", F.when(~every, F.struct("cell", "upto", "since")))
    # whole cells are summed at once; a cell that is cut stays a row
    sums = written(met.groupBy("few", "many", "cut").agg(F.sum("n").alias("n")), "pair-cells")
    cut = written(sums.where("cut is not null").select("few", "many", F.col("few").alias("artist"), "cut.*"), "cut-cells")
    each = index.dated.withColumn("cell", F.floor(F.col("t") / window_ms)).join(small(cut), ["artist", "cell"])
    each = each.where(true(F.col("t") <= F.col("upto")) | true(F.col("t") >= F.col("since"))).groupBy("few", "many").agg(F.count("*").alias("n"))
    counts = sums.where("cut is null").select("few", "many", "n").unionByName(each).groupBy("few", "many").agg(F.sum("n").alias("mix"))
    counts = p.join(counts, ["few", "many"]).select("x", "y", "mix").distinct()
    return pairs.join(counts, ["x", "y"], "left").withColumn("mix", F.coalesce("mix", F.lit(0)))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for all nodes of ``edges`` (a, b).

    Minimum labels with pointer jumping; each round is a written table, and rounds grow with the logarithm of a diameter.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("other", "l"), "other").groupBy("node").agg(F.min("l").alias("l"))
        least = near.join(labels, "node").select("node", F.least("l", "label").alias("to"), F.col("label").alias("was"))
        jumped = least.join(labels.toDF("to", "further"), "to", "left")
        after = written(jumped.select("node", F.least(F.col("to"), F.coalesce("further", "to")).alias("label"), "was"), "labels")
        labels = after.select("node", "label")
        if after.where("label <> was").isEmpty():
            return labels
