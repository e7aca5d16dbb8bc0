"""The play log: CSV files in any common layout, Parquet tables, and one schema for both.

A play has i (its place by time, dates unknown last), artist, album, album_id, title, ts_ms (null: unknown), source and
track_key. Missing text is empty, never null.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop.functions import text
from needledrop.plans.order import first_by, numbered
from needledrop.plans.storage import small, written

FIELDS = ("artist", "album", "album_id", "track", "date")
#: Header keys of each field, in order of preference: (expression, excluded expression).
ALIASES = {
    "album_id": [("album.*(id|mbid|identificador)", None)],
    "artist": [("^(artist|artista|artist name|nombre del artista)$", None), ("^(artist|artista)", "album"), ("artist", "album")],
    "album": [("album", "album.*(id|mbid|artist)")],
    "track": [("^(track|track name|title|titulo|song|name|nombre)$", None), ("track|title|song|titulo|canci", None)],
    "date": [("^(date|fecha|uts|timestamp|played at|played_at|time)$", None), ("date|fecha|uts|timestamp|time|when", None)],
}
#: Date forms beside epochs; the last ones are those of common exports.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd", "dd MMM yyyy, HH:mm", "dd MMM yyyy HH:mm", "dd MMM yyyy")
SAMPLE_ROWS, SAMPLE_CHARS = 30, 20_000


def header_key(value: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", value) if not 0x300 <= ord(c) <= 0x36F).lower()
    return re.sub(r"[\W_]+", " ", bare).strip()


def delimiter_of(sample: str) -> str:
    """The most frequent of ; , tab | outside quotes in the first 20 lines."""
    lines = "\n".join(sample[:SAMPLE_CHARS].split("\n")[:20])
    outside = "".join(lines.split('"')[::2])
    return max(";,\t|", key=outside.count)


def is_epoch(value: str) -> bool:
    v = value.strip()
    return bool(re.fullmatch(r"\d{9,14}", v)) and 1e8 < int(v) < 4102444800000


def is_date(value: str) -> bool:
    return is_epoch(value) or bool(re.match(r"\d{4}-\d{2}-\d{2}([ T]|$)", value.strip()))


def columns_of(headers: list[str], rows: list[list[str]]) -> dict[str, int]:
    """Which column holds which field (-1: none), by header and, for dates, by content."""
    keys, out, used = [header_key(h) for h in headers], {}, set()
    for field, choices in ALIASES.items():
        hits = (
            i
            for want, never in choices
            for i, k in enumerate(keys)
            if i not in used and re.search(want, k) and not (never and re.search(never, k))
        )
        out[field] = next(hits, -1)
        used |= {out[field]} - {-1}
    sample = rows[:SAMPLE_ROWS]
    dates = lambda i: sum(i < len(r) and is_date(r[i]) for r in sample)
    if out["date"] < 0 or dates(out["date"]) < len(sample) / 2:
        taken = {out["artist"], out["track"], out["album"]}
        found = (i for i in range(len(headers)) if i not in taken and dates(i) >= len(sample) / 2)
        out["date"] = next(found, out["date"])
    return out


def parse_date(c: Column) -> Column:
    """Epoch seconds (below 1e11) or milliseconds, ISO and common export forms, as milliseconds; null if none fits."""
    s = F.trim(F.coalesce(c, F.lit("")))
    n = s.try_cast("bigint")
    epoch = F.when(n < 100_000_000_000, n * 1000).otherwise(n)
    iso = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}) ", "$1T")
    forms = [F.unix_millis(F.try_to_timestamp(iso, F.lit(f))) for f in FORMATS]
    return F.when(s.rlike(r"^\d{9,14}$"), epoch).when(s != "", F.coalesce(*forms))


#: Different titles that may be broadcast with their keys.
TITLES = 300_000


def keyed_by_title(plays: DataFrame) -> DataFrame:
    """``plays`` with ``track_key``, made once for each title; where there are too many titles to broadcast, for each play."""
    titles = written(plays.select("title").distinct(), "titles")
    if titles.count() > TITLES:
        return text.with_track_key(plays)
    return plays.join(F.broadcast(written(text.with_track_key(titles), "title-keys")), "title")


def as_plays(df: DataFrame, order: list[Column]) -> DataFrame:
    """The play schema from (artist, album, album_id, title, ts_ms, source); ``order`` breaks ties of time."""
    placed = keyed_by_title(numbered(df, [F.col("ts_ms").asc_nulls_last(), *order]))
    return placed.select("i", "part", "artist", "album", "album_id", "title", "ts_ms", "source", "track_key")


#: A character that no text has (a noncharacter); it stands for the delimiters outside quotes.
CUT = "\ufdd0"
#: Bytes that a record may have; a quote that is never closed would make the rest of a file one record.
RECORD_BYTES = 1 << 26
FILE = ["file", "block"]


def fields_of(record: str, delimiter: str) -> list[str]:
    """The fields of a record: every quote toggles, two in a row inside quotes are one, \\r outside them is dropped."""
    parts = record.split('"')
    last = len(parts) - 1
    kept = (p if i % 2 else '"' if p == "" and 0 < i < last else p.replace("\r", "").replace(delimiter, CUT) for i, p in enumerate(parts))
    return "".join(kept).split(CUT)


def fields(record: Column, delimiter: Column) -> Column:
    """``fields_of`` as a Column."""
    parts = F.split(record, '"', -1)
    outside = lambda p: F.call_function("translate", p, F.concat(delimiter, F.lit("\r")), F.lit(CUT))
    # a gap of nothing between two quoted parts is a quote; the first and the last part are no gaps
    marked = F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).when(p == "", '"').otherwise(outside(p)))
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    inner = F.array_join(F.slice(marked, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "")
    whole = F.concat(outside(first), inner, F.when(F.size(parts) % 2 == 1, outside(last)).otherwise(last))
    return F.split(F.when(F.contains(record, F.lit('"')), whole).otherwise(outside(record)), CUT, -1)


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, pos, value, quotes): every line of every file; ``block`` is where the byte range begins that it was read from.

    Large files are read by several tasks; ``pos`` is the order of lines within a range.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(paths, lineSep="\n")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value", quotes.alias("quotes"))


def records_of(lines: DataFrame) -> DataFrame:
    """(file, block, pos, value): the lines put together to records, whose line breaks are inside quotes.

    Whether a line begins inside quotes is the parity of the quotes before it. Ranges of bytes are counted (one row each) and
    the parity at their start is the sum over those before. A range whose lines all have even numbers of quotes, outside them at
    its start, holds a record in each line, and is not shuffled; only the others run through a state machine in their order, and
    only lines that belong together are grouped. A range's last record may go on in the ranges after it.
    """
    odd = F.col("quotes") % 2
    ranges = lines.groupBy(*FILE).agg(F.sum(odd).alias("odd"), F.min(F.when(F.col("block") == 0, F.col("pos"))).alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(ranges.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2), "csv-ranges")
    heads = F.coalesce(F.col("pos") == F.col("first"), F.lit(False))  # whether a line is its file's first
    bare = F.when(heads, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    own = lines.join(small(ranges), FILE).withColumn("value", bare)
    plain = (F.col("odd") == 0) & (F.col("inside") == 0)
    whole = own.where(plain).select(*FILE, "pos", "value", heads.alias("heads"))
    # the others in order, each with the parity at its start
    w = Window.partitionBy(*FILE).orderBy("pos")
    inside = (F.col("inside") + F.coalesce(F.sum(odd).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2
    rest = own.where(~plain).withColumn("begins", inside == 0).withColumn("begun", F.when(F.col("begins"), F.col("pos")))
    rest = rest.withColumns({"begun": F.last("begun", True).over(w), "latest": F.max("begun").over(Window.partitionBy(*FILE))})
    rest = written(rest.select(*FILE, "pos", "value", "begun", "latest", heads.alias("heads")), "csv-lines")
    # of all ranges, the last one before a range in which a record begins holds what goes on at its start
    begun = rest.groupBy(*FILE).agg(F.max("latest").isNotNull().alias("any"))
    begun = ranges.select(*FILE).join(begun, FILE, "left").withColumn("holds", F.when(F.coalesce("any", F.lit(True)), F.col("block")))
    carried = begun.select(*FILE, F.last("holds", True).over(before).alias("holder"))
    keyed = rest.join(small(written(carried, "csv-carried")), FILE)
    goes_on = F.col("begun").isNull()
    keyed = keyed.select(
        "file", F.when(goes_on, F.coalesce("holder", "block")).otherwise(F.col("block")).alias("at"),
        F.when(goes_on | (F.col("begun") == F.col("latest")), -1).otherwise(F.col("begun")).alias("record"), "block", "pos", "value", "heads",
    )
    sizes = keyed.groupBy("file", "at", "record").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    long = sizes.where(F.col("bytes") > RECORD_BYTES).select("file").first()
    if long:
        raise ValueError(f"{long['file']}: a quote is not closed, or a record has more than {RECORD_BYTES:,} bytes")
    grouped = keyed.groupBy("file", "at", "record").agg(F.sort_array(F.collect_list(F.struct("block", "pos", "value"))).alias("lines"), F.bool_or("heads").alias("heads"))
    first = F.element_at("lines", 1)
    joined = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    return whole.unionByName(grouped.select("file", first["block"].alias("block"), first["pos"].alias("pos"), joined.alias("value"), "heads"))


def layout_of(head: list[str]) -> tuple[str, bool, dict[str, int], list[str]]:
    """Delimiter, whether there is a header, the column of each field (-1: none) and warnings, from a file's first lines."""
    sample, warnings = "\n".join(head).removeprefix("\ufeff"), []
    delimiter, lines, held = delimiter_of(sample), [], ""
    for line in sample.split("\n"):
        held = f"{held}\n{line}" if held else line
        if held.count('"') % 2 == 0:
            lines.append(held)
            held = ""
    rows = [fields_of(x, delimiter) for x in lines if x.strip()] or [[""]]
    headers, body = rows[0], rows[1:]
    has_header = bool(body) and not is_epoch(headers[-1])
    at = columns_of(headers, body) if has_header else None
    if not has_header:
        fourth = len(headers) > 4 and not is_epoch(headers[4])
        at = {"artist": 0, "album": 1, "album_id": -1, "track": 2 if fourth else 3, "date": 3 if fourth else 4}
    elif at["artist"] < 0 or at["track"] < 0:
        warnings.append("The artist and title columns could not be identified; the usual order is assumed.")
        at = {"artist": 0, "album": 1, "album_id": 2, "track": 3, "date": 4}
    if at["date"] < 0:
        warnings.append("There is no date column: checks by time are off.")
    return delimiter, has_header, at, warnings


def layouts_of(lines: DataFrame) -> DataFrame:
    """(file, delimiter, header, artist, album, album_id, track, date, warnings): each file's own layout.

    A task keeps the first lines of each file that it reads, and those meet by file: a bounded row for each.
    """
    first = first_by(lines.where("block = 0").select("file", "pos", F.substring("value", 1, SAMPLE_CHARS).alias("value")), ["file"], [F.col("pos")], SAMPLE_ROWS + 1)
    heads = first.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("head"))
    schema = "file string, delimiter string, header boolean, " + ", ".join(f"{f} int" for f in FIELDS) + ", warnings array<string>"

    def sniff(batches):
        for frame in batches:
            rows = []
            for file, head in zip(frame["file"], frame["head"], strict=True):
                delimiter, header, at, warnings = layout_of(list(head))
                rows.append((file, delimiter, header, *(at[f] for f in FIELDS), warnings))
            yield pd.DataFrame(rows, columns=["file", "delimiter", "header", *FIELDS, "warnings"])

    return heads.mapInPandas(sniff, schema)


def read_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """Plays of CSV files or folders, and warnings. Each file has its own delimiter, header and columns.

    One large file is read by many tasks, line breaks inside quotes included; records are told by the parity of quotes.
    """
    lines = lines_of(spark, [path] if isinstance(path, str) else path)
    layouts = written(layouts_of(lines), "csv-layouts")
    if layouts.isEmpty():
        empty = spark.createDataFrame([], "artist string, album string, album_id string, title string, ts_ms bigint, source string")
        return as_plays(empty, [F.col("title")]), ["The file is empty."]
    records = records_of(lines).where(F.trim(F.regexp_replace("value", r"\s", "")) != "").join(small(layouts.drop("warnings")), "file")
    records = records.where(~(F.col("header") & F.col("heads"))).withColumn("f", fields(F.col("value"), F.col("delimiter")))
    value = lambda name: F.when(F.col(name) >= 0, F.get("f", F.col(name)))
    plays = records.select(
        text.normalise(value("artist")).alias("artist"),
        text.normalise(value("album")).alias("album"),
        text.normalise(value("album_id")).alias("album_id"),
        text.normalise(value("track")).alias("title"),
        parse_date(value("date")).alias("ts_ms"),
        F.element_at(F.split("file", "/"), -1).alias("source"),
        "file", "block", "pos",
    )
    plays = as_plays(plays, [F.col("file"), F.col("block"), F.col("pos")])
    said = layouts.select("file", F.explode("warnings").alias("said")).groupBy("said").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    warnings = [r["said"] if r["n"] == 1 else f"{r['said']} ({r['n']:,} files, such as {r['file']})" for r in said.orderBy("said").collect()]  # few: by their texts
    undated = plays.where("ts_ms is null").count()
    if undated:
        warnings.append(f"{undated:,} rows have no recognisable date.")
    return plays, warnings


def from_columns(df: DataFrame, artist: str, title: str, album: str | None = None, ts_ms: str | None = None, source: str = "", order: list[Column] | None = None) -> DataFrame:
    """Plays from any table; values are taken as they are (null: empty)."""
    column = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    when = F.col(ts_ms).cast("bigint") if ts_ms else F.lit(None).cast("bigint")
    fields = df.select(
        column(artist).alias("artist"),
        column(album).alias("album"),
        F.lit("").alias("album_id"),
        column(title).alias("title"),
        when.alias("ts_ms"),
        F.lit(source).alias("source"),
        *(c.alias(f"_o{k}") for k, c in enumerate(order or [])),
    )
    ties = [F.col(f"_o{k}") for k in range(len(order or []))]
    return as_plays(fields, ties or [F.col("artist"), F.col("title"), F.col("album")])
