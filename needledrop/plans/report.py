"""The audit: all detectors, filtered, ordered and numbered, with its summary and the plays it touches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop import labels
from needledrop.functions import text
from needledrop.operators import albums, artists, long_tail, repeats, titles
from needledrop.operators.findings import actionable, confidence, content_key
from needledrop.plans.index import Index
from needledrop.plans.order import numbered
from needledrop.plans.storage import small, together, written
from needledrop.rules import Rules


#: Places of a run that one row gives.
PIECE = 65_536


@dataclass
class Audit:
    """Everything about one table of plays under one set of rules; each part is computed when it is asked for, and once."""

    index: Index
    rules: Rules = Rules()

    @property
    def _spark(self) -> SparkSession:
        return self.index.plays.sparkSession

    @cached_property
    def _names(self) -> tuple[DataFrame, dict[str, int]]:
        """Findings about artists without those that a joined name's finding covers, and what was left out."""
        (scored, unshared), resolved, similar = together(
            self._spark,
            lambda: artists.merge_pairs(self.index, self.rules),
            lambda: written(artists.resolutions(self.index), "resolutions"),
            lambda: artists.similar_names(self.index, self.rules),
        )
        combined, merged = together(
            self._spark,
            lambda: written(artists.combined_artists(self.index, self.rules, resolved), "combined"),
            lambda: artists.duplicate_artists(self.index, self.rules, scored, resolved),
        )
        found = written(merged.unionByName(similar).withColumn("id", F.monotonically_increasing_id()), "names")
        absorbed = combined.select(F.explode("marks").alias("m"), F.col("proposed").alias("to")).select(F.col("m.a").alias("name"), "to").distinct()
        named = found.select("id", F.col("proposed").alias("to"), F.explode("marks").alias("m")).select("id", "to", F.col("m.a").alias("name"))
        covered = named.join(absorbed.withColumn("known", F.lit(True)), ["name", "to"], "left").groupBy("id")
        covered = written(covered.agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("covered")).where("covered").select("id"), "covered")
        kept = found.join(covered, "id", "left_anti").drop("id")
        return kept.unionByName(combined), {"artist_pairs_without_shared_track": unshared, "covered_by_stronger": covered.count()}

    @cached_property
    def _all(self) -> tuple[DataFrame, dict[str, int]]:
        ix, rules = self.index, self.rules
        ix.prepare()
        # each detector's findings are planned and written on their own, side by side: one plan of all is slow to optimise
        done = lambda make: lambda: written(make(ix, rules), "detected")
        detectors = (
            titles.title_variants, titles.platform_badges, titles.title_typos, titles.artist_in_title, albums.missing_albums,
            lambda index, rules: repeats.repeated_plays(index.plays, rules), long_tail.artist_typos, long_tail.notes,
        )
        (names, trimmed), (clashes, few), spellings, *others = together(
            self._spark,
            lambda: self._names,
            lambda: albums.album_clashes(ix, rules),
            lambda: written(albums.album_names(ix, rules), "album-names"),
            *map(done, detectors),
        )
        parts = [names, clashes, albums.listed(spellings, rules), *others]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = written(found.withColumn("confidence", confidence(F.col("points"), self.rules)).withColumn("actionable", actionable(F.col("action"))), "found")
        more = {"album_clashes_below_threshold": few.count(), "album_name_variants_beyond_cap": max(0, spellings.count() - self.rules.album_variants_listed)}
        return found, trimmed | more

    @cached_property
    def findings(self) -> DataFrame:
        """All findings that are listed, with ``place`` in the report (from 0) and a unique ``id``.

        The order is total: findings that are equal in all else differ in the digest of what they are about. An id is made of
        that digest and not of the place, so it stays when other findings come or go, and decisions can be kept by it.
        Only runs of one track that begin in the same millisecond share a digest; they are told apart by their order.
        """
        listed = self._all[0].where(F.col("informational") | (F.col("points") >= self.rules.minimum_points))
        of_type = F.array_position(F.array(*map(F.lit, labels.TYPES)), F.col("type"))
        of_confidence = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
        listed = content_key(listed).withColumns({"o1": of_type, "o2": of_confidence, "o3": -F.col("impact"), "o4": -F.col("points")})
        order = [F.col(c) for c in ("o1", "o2", "o3", "o4", "detector", "seen", "current", "proposed", "title", "key")]
        again = F.row_number().over(Window.partitionBy("key").orderBy("seen", "current"))
        listed = listed.withColumn("again", again)
        placed = numbered(listed, order, "place").drop("part", "o1", "o2", "o3", "o4")
        number = F.when(F.col("again") > 1, F.concat(F.lit("-"), F.col("again").cast("string"))).otherwise("")
        base = F.concat("type", F.lit(":"), "subtype", F.lit("|"), "current", F.lit("|"), "proposed", F.lit("#"), "key", number)
        return written(placed.withColumn("id", base).drop("key", "again"), "findings")

    @cached_property
    def trimmed(self) -> dict[str, int]:
        """What the detectors saw and left out, and how many findings were too weak to list."""
        weak = self._all[0].where(~F.col("informational") & (F.col("points") < self.rules.minimum_points)).count()
        return self._all[1] | {"omitted": weak}

    @property
    def summary(self) -> DataFrame:
        """(type, label, findings, impact, high, medium, low, actionable) in the report's order of types."""
        level = lambda name: F.count_if(F.col("confidence") == name).alias(name)
        sums = self.findings.groupBy("type").agg(
            F.count("*").alias("findings"), F.sum("impact").alias("impact"), level("high"), level("medium"), level("low"), F.count_if("actionable").alias("actionable")
        )
        order = F.array_position(F.array(*map(F.lit, labels.TYPES)), F.col("type"))
        label = F.element_at(F.array(*map(F.lit, labels.TYPES.values())), order.cast("int"))
        return sums.select("type", label.alias("label"), "findings", "impact", "high", "medium", "low", "actionable", order.alias("o")).orderBy("o").drop("o")

    @property
    def affected(self) -> DataFrame:
        """(i): every play that a listed finding touches, once.

        What a finding names is looked up in the cells (the different plays), and the log is read once, against the cells that
        are touched. Runs give their places themselves, in pieces, so a long run is no long row.
        """
        marks = written(self.findings.select(F.explode("marks").alias("m")).select("m.*").distinct(), "marks")
        mark_of = lambda kind, *values: F.struct(F.lit(kind).alias("kind"), *(v.alias(n) for n, v in zip("abc", [*values, F.lit(""), F.lit("")], strict=False)))
        artist, track, album = F.col("artist"), F.col("track_key"), F.col("album")
        kinds = [
            F.when(artist != "", mark_of("artist", artist)),
            mark_of("title", artist, F.col("title")),
            F.when(album == "", mark_of("empty_album", artist, track)).otherwise(mark_of("track_album", artist, track, album)),
            F.when(album != "", mark_of("album", artist, text.key(album))),
        ]
        cells = self.index.cells.select("artist", "title", "album", F.explode(F.array_compact(F.array(*kinds))).alias("m")).select("artist", "title", "album", "m.*")
        named = marks.where("kind <> 'run'").fillna("", ["b", "c"])
        touched = written(cells.join(small(named), ["kind", "a", "b", "c"], "left_semi").select("artist", "title", "album").distinct(), "touched-cells")
        plays = self.index.plays.join(small(touched), ["artist", "title", "album"], "left_semi").select("i")
        low, high = F.col("a").cast("bigint"), F.col("b").cast("bigint")
        runs = marks.where("kind = 'run'").select(low.alias("low"), high.alias("high"), F.explode(F.sequence(F.floor(low / PIECE), F.floor(high / PIECE))).alias("piece"))
        runs = runs.select(F.explode(F.sequence(F.greatest("low", F.col("piece") * PIECE), F.least("high", F.col("piece") * PIECE + PIECE - 1))).alias("i"))
        return plays.union(runs).distinct()

    @property
    def meta(self) -> DataFrame:
        """One row: plays, dated plays, artists, tracks, albums, first and last date."""
        p = self.index.plays
        one = F.lit(1).alias("one")
        times = p.agg(F.count("*").alias("plays"), F.count("ts_ms").alias("dated"), F.min("ts_ms").alias("from_ms"), F.max("ts_ms").alias("to_ms"))
        n_artists = self.index.artists.agg(F.count("*").alias("artists"))
        tracks = self.index.cells.select("artist", "track_key").distinct().agg(F.count("*").alias("tracks"))
        keys = self.index.cells.where("album <> ''").select("album").distinct().select(text.key(F.col("album")).alias("k")).distinct()
        n_albums = keys.agg(F.count("*").alias("albums"))
        out = times.select("*", one)
        for part in (n_artists, tracks, n_albums):  # one row each
            out = out.join(F.broadcast(part.select("*", one)), "one")
        return out.drop("one")
