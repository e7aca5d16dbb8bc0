"""The registered queries of the audit, over the play log that is made from the order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.functions import format as show
from needledrop.functions import text
from needledrop.operators import albums, artists, long_tail, pairs, repeats, titles
from needledrop.operators.findings import canonical_score, preference
from needledrop.plans import storage
from needledrop.plans.index import Index
from needledrop.plans.report import Audit
from needledrop.rules import Rules
from needledrop.sinks.tables import actions, profile_urls, with_choices
from needledrop.sources.orders_log import orders_log, version
from needledrop.sources.plays import read_csv

RULES = Rules()
_audits: dict[tuple[str, str, str], Audit] = {}


def forget_reports() -> None:
    """Compute findings anew from here on; the log and its index stay."""
    _audits.clear()


def forget() -> None:
    """Compute everything anew from here on."""
    forget_reports()
    storage.forget()


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    return audit_of(spark, sf_dir).index


def audit_of(spark: SparkSession, sf_dir: str) -> Audit:
    """The audit of a folder; what it has written is used again within the application while the folder's files stay."""
    at = *storage.run_key(spark), version(spark, sf_dir)
    if at not in _audits:
        _audits[at] = Audit(Index(orders_log(spark, sf_dir), at[-1]), RULES)
    return _audits[at]


def _titles(**columns) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = orders_log(spark, sf_dir).select("title").distinct()
        return own.select("title", *(f(F.col("title")).alias(n) for n, f in columns.items()))

    return run


def _artists(**columns) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = orders_log(spark, sf_dir).select("artist").distinct()
        return own.select("artist", *(f(F.col("artist")).alias(n) for n, f in columns.items()))

    return run


def _of_index(make: Callable[[Index], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(index_of(spark, sf_dir))


def _findings(make: Callable[[Index], DataFrame], *more) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(index_of(spark, sf_dir)).select("subtype", "current", "proposed", "points", "impact", *more)


#: Parts that the names of one initial and length are dealt into; every two parts meet in a group of their own.
TILES = 16


def _edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of artist keys of one initial and length, with their distance, or 3 if it is more than 2.

    The pairs are quadratic in a group's keys by nature, so a group is dealt into tiles, and no task joins more than two of them.
    """
    keys = orders_log(spark, sf_dir).select("artist").distinct().select(text.artist_key(F.col("artist")).alias("k")).distinct()
    tile, every = F.pmod(F.xxhash64("k"), F.lit(TILES)), F.explode(F.sequence(F.lit(0), F.lit(TILES - 1)).cast("array<bigint>"))
    of = [F.substring("k", 1, 1).alias("initial"), F.length("k").alias("size")]
    a = keys.select(F.col("k").alias("a"), *of, tile.alias("row"), every.alias("column"))
    b = keys.select(F.col("k").alias("b"), *of, every.alias("row"), tile.alias("column"))
    met = a.join(b, ["initial", "size", "row", "column"]).where(F.col("a") < F.col("b"))
    return met.select("a", "b", text.bounded_distance(F.col("a"), F.col("b"), 2).alias("distance"))


def _canonical(index: Index) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("key")
    score = canonical_score(F.col("artist"), F.col("n"), F.col("last"), F.max("last").over(w), F.min("last").over(w))
    return index.artists.withColumn("wanted", score).groupBy("key").agg(F.max_by("artist", F.struct("wanted", "n", "artist")).alias("canonical"))


def _duplicate_artists(index: Index) -> DataFrame:
    scored, _ = artists.merge_pairs(index, RULES)
    return artists.duplicate_artists(index, RULES, scored, artists.resolutions(index))


def _components(index: Index) -> DataFrame:
    scored, _ = artists.merge_pairs(index, RULES)
    return pairs.components(scored.where("strong").select(F.col("x").alias("a"), F.col("y").alias("b")))


def _duplicate_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_plays(orders_log(spark, sf_dir), RULES)
    at = F.get("targets", F.lit(0))
    return found.select("subtype", "current", "proposed", "points", "impact", at["artist"].alias("artist"), at["track"].alias("title"))


def _canonical_rules(index: Index) -> DataFrame:
    """The form to keep of each key by the other two rules."""

    def best(rule: str):
        wanted = preference(RULES.override(canonical=rule), F.col("artist"), F.col("n"), F.col("last"), F.col("last"), F.col("last"))
        return F.max_by("artist", F.struct(wanted.alias("wanted"), "n", "artist")).alias(rule)

    return index.artists.groupBy("key").agg(best("recent"), best("frequent"))


def _display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every display form, over the log's times, places and titles."""
    i, ts = F.col("i"), F.col("ts_ms")
    return orders_log(spark, sf_dir).select(
        "i", show.number(ts).alias("number"), show.percent(F.pmod(i, F.lit(1000)) / 1000).alias("percent"), show.capitalised(F.col("title")).alias("capitalised"),
        show.short_date(ts).alias("day"), show.date_time(ts).alias("minute"), show.duration(i * 17_000).alias("duration"),
    )


def _csv_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as another program's export and read again: quotes, delimiters and line breaks in titles, dates in three forms or none."""
    i, when = F.col("i"), F.timestamp_millis("ts_ms")
    dates = (
        F.when(i % 10 == 3, "")
        .when(i % 3 == 0, F.floor(F.col("ts_ms") / 1000).cast("string"))
        .when(i % 3 == 1, F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
        .otherwise(F.date_format(when, "dd MMM yyyy, HH:mm"))
    )
    titles = F.concat("title", F.when(i % 7 == 0, ' "take; 2"').when(i % 11 == 0, "\npart").otherwise(""))
    export = orders_log(spark, sf_dir).select(
        dates.alias("Fecha"), F.col("artist").alias("Nombre del artista"), titles.alias("Título"), F.col("album").alias("Álbum"), F.concat(F.lit("id-"), (i % 5).cast("string")).alias("Album ID")
    )
    path = storage.new_path(spark, "export")
    export.write.csv(path, sep=";", header=True, quoteAll=True, quote='"', escape='"')
    found = read_csv(spark, path)[0].select("artist", "album", "album_id", "title", "ts_ms")
    storage.remove(spark, path)  # the plays have been written as they were numbered
    return found


def _csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as one folder of three programs' exports: Spanish with semicolons, English with commas in another order, and one
    with tabs and without a header; quotes begin inside fields."""
    i, log = F.col("i"), orders_log(spark, sf_dir)
    seconds = F.floor(F.col("ts_ms") / 1000).cast("string")
    path = storage.new_path(spark, "export")
    broken = F.concat("title", F.when(i % 9 == 0, ' "a; b, c"\n2').otherwise(""))
    inside = F.concat(F.substring("artist", 1, 3), F.lit('"'), F.replace(F.substr("artist", F.lit(4)), F.lit('"'), F.lit('""')), F.lit('"'))
    whole = F.concat(F.lit('"'), F.replace(broken, F.lit('"'), F.lit('""')), F.lit('"'))
    spanish = log.where(i % 3 == 0).select(broken.alias("Título"), F.col("artist").alias("Artista"), F.col("album").alias("Álbum"), seconds.alias("Fecha"))
    english = log.where(i % 3 == 1).select(seconds.alias("Date"), broken.alias("Track Name"), F.col("artist").alias("Artist"), F.col("album").alias("Album"))
    bare = log.where(i % 3 == 2).select(F.concat_ws("\t", inside, "album", F.lit("x"), whole, seconds).alias("value"))
    spanish.write.csv(f"{path}/spanish", sep=";", header=True, quoteAll=True, escape='"')
    english.write.csv(f"{path}/english", sep=",", header=True, escape='"', escapeQuotes=True, emptyValue="")
    bare.write.text(f"{path}/bare")
    found = read_csv(spark, path)[0].select("artist", "album", "title", "ts_ms")
    storage.remove(spark, path)
    return found


def _choices(index: Index) -> DataFrame:
    """What the findings of similar names become if each other name is chosen."""
    found = artists.similar_names(index, RULES).withColumn("id", F.concat_ws("|", "current", "proposed"))
    chosen = found.select("id", F.col("alternatives")[0]["value"].alias("value"))
    return with_choices(found, chosen).select("subtype", "current", "proposed", "impact", "how_to")


def _trimmed(audit: Audit) -> DataFrame:
    """One row for each counter of what the report leaves out."""
    return audit.index.plays.sparkSession.createDataFrame(list(audit.trimmed.items()), "counter string, n bigint")


def _joined(column: str, *parts: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(": ", *(x[p] for p in parts))), " | ")


def _report(make: Callable[[Audit], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(audit_of(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    shown = ("place", "id", "type", "subtype", "title", "points", "confidence", "impact", "action", "actionable", "informational", "current", "proposed", "warning")
    return {
        "a_csv_plays": _csv_plays,
        "a_csv_folder": _csv_folder,
        "b_display": _display,
        "b_normalise_text": _titles(normal=text.normalise),
        "b_key": _titles(key=text.key),
        "b_loose_title_key": _titles(key=text.loose_key),
        "b_title_parts": _titles(base=text.title_base, qualifiers=lambda t: F.array_join(text.qualifiers(t), " | ")),
        "b_badge": _titles(badge=lambda t: F.exists(text.qualifiers(t), text.is_badge), stripped=text.strip_badges),
        "b_version_marker": _titles(version=lambda t: text.marks_version(text.key(t))),
        "b_ordinals": lambda s, d: orders_log(s, d).select("track_key").distinct().withColumn("stripped", text.without_ordinals(F.col("track_key"))),
        "b_artist_key": _artists(key=text.artist_key),
        "b_split_artist": _artists(parts=lambda a: F.array_join(text.split_artist(a), " | ")),
        "b_edit_distance": _edit_distance,
        "c_artist_index": _of_index(lambda ix: ix.artists.select("artist", "n", F.col("first").alias("first_ms"), F.col("last").alias("last_ms"), "key", "n_tracks")),
        "c_track_index": _of_index(lambda ix: ix.tracks),
        "c_album_index": _of_index(lambda ix: ix.albums.select("artist", "album", "album_key", "n", "seen")),
        "c_most_frequent": _of_index(lambda ix: ix.track_albums.groupBy("artist", "track_key").agg(F.max_by("album", F.struct("n", (-F.col("seen")).alias("e"))).alias("album"), F.max("n").alias("n"))),
        "c_canonical": _of_index(_canonical),
        "c_canonical_rules": _of_index(_canonical_rules),
        "c_runs": lambda s, d: repeats.runs(orders_log(s, d), RULES).select("artist", "track_key", "title", "plays", "gap_ms", "start"),
        "d_same_key_pairs": _of_index(lambda ix: pairs.same_key_pairs(ix.artists)),
        "d_containment_pairs": _of_index(lambda ix: pairs.containment_pairs(ix.artists)),
        "d_similar_pairs": _of_index(lambda ix: pairs.similar_pairs(ix.artists, RULES).withColumn("strength", F.round("strength", 9))),
        "d_shared_tracks": _of_index(lambda ix: pairs.shared_tracks(pairs.containment_pairs(ix.artists), ix.tracks)),
        "d_temporal_mix": _of_index(lambda ix: pairs.time_mix(pairs.containment_pairs(ix.artists), ix, RULES.sitting_window_ms)),
        "d_nearest_artist": _of_index(lambda ix: pairs.nearest_frequent(ix.artists, RULES)),
        "d_components": _of_index(_components),
        "e_duplicate_artists": _findings(_duplicate_artists),
        "e_similar_names": _findings(lambda ix: artists.similar_names(ix, RULES)),
        "e_combined_artists": _findings(lambda ix: artists.combined_artists(ix, RULES)),
        "e_title_variants": _findings(lambda ix: titles.title_variants(ix, RULES)),
        "e_title_typos": _findings(lambda ix: titles.title_typos(ix, RULES)),
        "e_platform_badges": _findings(lambda ix: titles.platform_badges(ix, RULES)),
        "e_artist_in_title": _findings(lambda ix: titles.artist_in_title(ix, RULES)),
        "e_album_missing": _findings(lambda ix: albums.missing_albums(ix, RULES)),
        "e_album_clash": _findings(lambda ix: albums.album_clashes(ix, RULES)[0]),
        "e_album_name_variants": _findings(lambda ix: albums.album_names(ix, RULES)),
        "e_duplicate_plays": _duplicate_plays,
        "e_longtail_typo": _findings(lambda ix: long_tail.artist_typos(ix, RULES)),
        "e_hygiene": _of_index(lambda ix: long_tail.untidy(ix).select("problem", "n")),
        "e_hygiene_examples": _of_index(lambda ix: long_tail.untidy(ix).withColumn("examples", F.array_join("examples", " | "))),
        "e_empty_albums": _of_index(lambda ix: long_tail.empty_albums(ix).drop("seen")),
        "e_rare_artists": _of_index(lambda ix: long_tail.rare_artists(ix, RULES).select("artist", "n", F.col("first").alias("first_ms"), F.col("last").alias("last_ms"))),
        "e_evidence": _report(lambda a: a.findings.select("place", "type", "subtype", "current", "proposed", _joined("evidence", "a", "b").alias("evidence"), "beyond")),
        "e_signals": _report(lambda a: a.findings.select("place", "type", "subtype", "current", "proposed", _joined("signals", "text").alias("signals"))),
        "f_meta": _report(lambda a: a.meta),
        "f_findings": _report(lambda a: a.findings.select(*shown)),
        "f_summary_by_type": _report(lambda a: a.summary),
        "f_trimmed": _report(_trimmed),
        "f_choices": _of_index(_choices),
        "f_affected_rows": _report(lambda a: a.affected),
        "g_actions_csv": _report(lambda a: actions(a.findings)),
        "g_profile_urls": _report(lambda a: profile_urls(a.findings, "https://example.org/user", "someone")),
    }
