"""Runs of the same track within a short time: gaps and islands over the global order of plays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop.functions import format as show
from needledrop.operators.findings import finding, item, mark, number, quoted, signal, signals, target
from needledrop.plans.storage import small, written
from needledrop.rules import Rules


#: Candidates that may be broadcast.
CANDIDATES = 1_000_000


def candidates(plays: DataFrame, rules: Rules) -> DataFrame:
    """(part, i): the plays that may be in a run, and the first and last one of each range.

    A play in a run has a neighbour of the same track, so of the same digest. Only places, times and digests are sorted for this,
    the ranges each in a task of their own or nearly so; equal digests of different tracks are told apart by ``segments``.
    """
    w = Window.partitionBy("part").orderBy("i")
    ranges = plays.agg(F.max("part")).first()[0]
    own = plays.select("part", "i", "ts_ms", F.xxhash64("artist", "track_key").alias("digest"))
    if ranges is not None and ranges >= int(plays.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        own = own.repartition(ranges + 1, "part")
    own = own.withColumns({f"{n}_{c}": f(c).over(w) for n, f in (("before", F.lag), ("after", F.lead)) for c in ("i", "ts_ms", "digest")})
    near = lambda n: (F.col(f"{n}_digest") == F.col("digest")) & (F.abs(F.col(f"{n}_ts_ms") - F.col("ts_ms")) <= rules.repeat_window_ms)
    kept = F.col("before_i").isNull() | F.col("after_i").isNull() | near("before") | near("after")
    return written(own.where(kept).select("part", "i"), "run-candidates")


def segments(plays: DataFrame, rules: Rules) -> DataFrame:
    """(part, artist, track_key, title, start, since, until, plays, gap_ms, opens, closes): maximal runs within each range of plays.

    ``plays`` come dealt into ranges of their order (``part``), and a task only sees its own. Of the segments of one play, only
    those that open or close a range are kept: they may go on in the next one.
    """
    w = Window.partitionBy("part").orderBy("i")
    before, gap = F.lag(F.struct("i", "artist", "track_key", "ts_ms")).over(w), F.col("ts_ms") - F.col("before.ts_ms")
    own = plays.join(small(candidates(plays, rules), CANDIDATES), ["part", "i"])
    own = own.select("part", "i", "artist", "track_key", "title", "ts_ms", before.alias("before"), F.lead("i").over(w).isNull().alias("last"))
    again = (F.col("artist") == F.col("before.artist")) & (F.col("track_key") == F.col("before.track_key")) & (gap <= rules.repeat_window_ms)
    again &= F.col("before.i") == F.col("i") - 1
    own = own.withColumn("gap", F.when(again, gap))
    own = own.withColumn("segment", F.sum(F.col("gap").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = own.groupBy("part", "segment").agg(
        F.first("artist").alias("artist"), F.first("track_key").alias("track_key"), F.min_by("title", "i").alias("title"), F.min("i").alias("start"),
        F.min("ts_ms").alias("since"), F.max("ts_ms").alias("until"), F.count("*").alias("plays"), F.min("gap").alias("gap_ms"), F.bool_or("last").alias("closes"),
    )
    return found.withColumn("opens", F.col("segment") == 1).where("plays > 1 or opens or closes").drop("segment")


def runs(plays: DataFrame, rules: Rules) -> DataFrame:
    """(artist, track_key, title, plays, gap_ms, start, since): runs of two or more plays, as their first place and their length.

    A segment that opens a range and goes on with the one that closed the range before is put together with it, and so on over
    whole ranges: at most two rows for each range meet in one task.
    """
    found = written(segments(plays, rules), "segments")
    edges, order = found.where("opens or closes"), Window.orderBy("start")
    before = F.lag(F.struct("artist", "track_key", "until")).over(order)
    edges = edges.withColumn("before", before).withColumn("gap", F.col("since") - F.col("before.until"))
    on = F.col("opens") & (F.col("artist") == F.col("before.artist")) & (F.col("track_key") == F.col("before.track_key")) & (F.col("gap") <= rules.repeat_window_ms)
    edges = edges.withColumn("on", F.coalesce(on, F.lit(False)))
    edges = edges.withColumn("island", F.sum((~F.col("on")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = lambda c: F.min_by(c, "start").alias(c)
    merged = edges.groupBy("island").agg(
        first("artist"), first("track_key"), first("title"), F.sum("plays").alias("plays"), F.min(F.least("gap_ms", F.when(F.col("on"), F.col("gap")))).alias("gap_ms"),
        F.min("start").alias("start"), F.min("since").alias("since"),
    )
    columns = ["artist", "track_key", "title", "plays", "gap_ms", "start", "since"]
    return found.where("not opens and not closes").select(*columns).unionByName(merged.where("plays > 1").select(*columns))


def listed_plays(plays: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """(start, items): the first plays of each run, with their times and albums, looked up by their places."""
    last = F.least(F.col("start") + F.col("plays") - 1, F.col("start") + most - 1)
    wanted = written(found.select("start", F.explode(F.sequence("start", last)).alias("i")), "run-places")
    each = plays.select("i", "ts_ms", "album").join(small(wanted), "i")
    album = F.when(F.col("album") == "", "(no album)").otherwise(F.col("album"))
    kept = F.when(F.col("i") == F.col("start"), F.concat(album, F.lit(", to keep"))).otherwise(album)
    rows = each.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("i", show.date_time(F.col("ts_ms")).alias("a"), kept.alias("b")))).alias("rows"))
    return rows.select("start", F.transform("rows", lambda x: item(x["a"], x["b"])).alias("items"))


def repeated_plays(plays: DataFrame, rules: Rules) -> DataFrame:
    r = written(runs(plays, rules), "runs")
    r = r.join(listed_plays(plays, r, rules.evidence_items), "start")
    certain, extra = F.col("gap_ms") <= rules.repeat_certain_ms, F.col("plays") - 1
    shortest = show.duration(F.col("gap_ms"))
    return finding(
        r, 10, "duplicate_scrobbles", "", "delete_duplicate",
        title=F.concat(F.col("plays").cast("string"), F.lit(" times in a row: "), quoted(F.concat("artist", F.lit(" — "), "title"))),
        points=F.when(certain, 92).otherwise(74), impact=extra,
        current=F.concat(F.col("plays").cast("string"), F.lit(" consecutive plays")), proposed=F.lit("keep 1"), seen=F.col("start"), since=F.col("since"),
        signals=signals(
            (certain, signal("strong", "The closest two are ", shortest, " apart")),
            (~certain, signal("medium", "The closest two are ", shortest, " apart")),
        ),
        targets=F.array(target(F.col("artist"), F.col("title"))),
        marks=F.array(mark("run", (F.col("start") + 1).cast("string"), (F.col("start") + F.col("plays") - 1).cast("string"))),
        evidence=F.col("items"), shown=rules.evidence_items, beyond=F.greatest(F.col("plays") - rules.evidence_items, F.lit(0)),
        explanation=F.concat(F.lit("Unless it was on repeat, "), number(extra), F.lit(" of these plays are too many.")),
    )
