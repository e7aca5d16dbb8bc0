"""Repeated plays on a stream: one row for each sitting in which a track is played again within the repeat window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.rules import Rules


def repeat_sessions(plays: DataFrame, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """(artist, track_key, start, plays) from a stream of (artist, title, ts timestamp).

    Session windows close when the watermark passes them; unlike the batch detector, other plays in between don't end one.
    A play exactly at the window's end still belongs to it, as in the batch.
    """
    gap = f"{rules.repeat_window_ms + 1} milliseconds"
    keyed = text.with_track_key(plays).withWatermark("ts", late)
    sessions = keyed.groupBy(F.session_window("ts", gap).alias("w"), "artist", "track_key").agg(F.count("*").alias("plays"))
    return sessions.where("plays > 1").select("artist", "track_key", F.col("w.start").alias("start"), "plays")
