"""The relations that the detectors share, each aggregated once from the plays and written."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.plans.storage import once, written


def moments(plays: DataFrame, window_ms: int) -> DataFrame:
    """(artist, cell, n, lo, hi) from dated plays (artist, t)."""
    return plays.groupBy("artist", F.floor(F.col("t") / window_ms).alias("cell")).agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))


class Index:
    """Artists, tracks, titles and albums of a table of plays.

    ``name`` lets an application that asks for the same plays again find what is written.
    """

    def __init__(self, plays: DataFrame, name: str | None = None) -> None:
        self.plays, self.name = plays, name

    def _kept(self, tag: str, make) -> DataFrame:
        return once(self.plays.sparkSession, f"{tag}:{self.name}", make) if self.name else written(make(), tag)

    def prepare(self) -> None:
        """Write all parts, so that steps which run side by side find them."""
        for part in (self.cells, self.titles, self.tracks, self.artists, self.track_albums, self.albums):
            assert part is not None

    @cached_property
    def cells(self) -> DataFrame:
        """(artist, track_key, title, album, n, seen): everything else is aggregated from these."""
        return self._kept("cells", lambda: self.plays.groupBy("artist", "track_key", "title", "album").agg(F.count("*").alias("n"), F.min("i").alias("seen")))

    @cached_property
    def named(self) -> DataFrame:
        return self.cells.where("artist <> '' or title <> ''")

    @cached_property
    def artists(self) -> DataFrame:
        """(artist, n, first, last, dated, key, parts, n_tracks), of plays that have an artist or a title."""

        def make() -> DataFrame:
            own = self.plays.where("artist <> '' or title <> ''").groupBy("artist")
            sums = own.agg(F.count("*").alias("n"), F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.count("ts_ms").alias("dated"))
            tracks = self.tracks.groupBy("artist").agg(F.count("*").alias("n_tracks"))
            keyed = sums.withColumns({"key": text.artist_key(F.col("artist")), "parts": text.split_artist(F.col("artist"))})
            return keyed.join(tracks, "artist")

        return self._kept("artists", make)

    @cached_property
    def tracks(self) -> DataFrame:
        """(artist, track_key, n, title, versioned): ``title`` is the most frequent spelling, the first seen on a tie."""

        def make() -> DataFrame:
            best = F.max_by("title", F.struct("n", (-F.col("seen")).alias("early")))
            return self.titles.groupBy("artist", "track_key").agg(F.sum("n").alias("n"), best.alias("title"), F.bool_or("version").alias("versioned"))

        return self._kept("tracks", make)

    @cached_property
    def titles(self) -> DataFrame:
        """(artist, track_key, title, n, seen, strict, qualifiers, version, badge) of every spelling."""

        def make() -> DataFrame:
            t = self.named.groupBy("artist", "track_key", "title").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
            t = t.withColumns({"strict": text.key(F.col("title")), "q": text.qualifiers(F.col("title"))})
            t = t.withColumns({"version": text.marks_version(F.col("strict")), "badge": F.exists("q", text.is_badge)})
            return t.withColumn("qualifiers", F.array_join("q", " | ")).drop("q")

        return self._kept("titles", make)

    @cached_property
    def track_albums(self) -> DataFrame:
        """(artist, track_key, album, n, seen) of named albums."""
        own = self.cells.where("album <> ''").groupBy("artist", "track_key", "album")
        return self._kept("track-albums", lambda: own.agg(F.sum("n").alias("n"), F.min("seen").alias("seen")))

    def times(self, window_ms: int) -> DataFrame:
        """(artist, cell, n, lo, hi): the dated plays of each artist in each cell of time as wide as a window, with the first and last."""
        return self._kept(f"times-{window_ms}", lambda: moments(self.dated, window_ms))

    @property
    def dated(self) -> DataFrame:
        """(artist, t) of plays with a date and an artist or a title."""
        return self.plays.where("ts_ms is not null and (artist <> '' or title <> '')").select("artist", F.col("ts_ms").alias("t"))

    @cached_property
    def albums(self) -> DataFrame:
        """(artist, album_key, album, n, seen) of every spelling of an album."""

        def make() -> DataFrame:
            own = self.named.where("album <> ''").groupBy("artist", "album").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
            return own.withColumn("album_key", text.key(F.col("album")))

        return self._kept("albums", make)
