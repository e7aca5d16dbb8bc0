from pyspark.sql import functions as F

from needledrop.sources import plays as P


def read(spark, tmp_path, text, name="log.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    df, warnings = P.read_csv(spark, str(tmp_path / name))
    return df.orderBy("i").collect(), warnings


def test_spanish_header_in_another_order(spark, tmp_path):
    rows, warnings = read(spark, tmp_path, "T\u00edtulo;Artista;\u00c1lbum;Fecha\nSong;Beta;Alb;1700000000\n")
    assert [(r["artist"], r["album"], r["title"], r["ts_ms"], r["source"]) for r in rows] == [("Beta", "Alb", "Song", 1700000000000, "log.csv")]
    assert warnings == []
    assert P.columns_of(["T\u00edtulo", "Artista", "\u00c1lbum", "Fecha"], [["Song", "Beta", "Alb", "1700000000"]]) == {"album_id": -1, "artist": 1, "album": 2, "track": 0, "date": 3}


def test_no_header_quotes_and_order(spark, tmp_path):
    rows, _ = read(spark, tmp_path, 'B,"Al, ""x""",id,"Two\nlines",1700000100\nA,Al,id,One,1700000000\n')
    assert [(r["i"], r["artist"], r["title"]) for r in rows] == [(0, "A", "One"), (1, "B", "Two lines")]
    assert rows[1]["album"] == 'Al, "x"'


def test_dates(spark):
    values = ["1700000000", "1700000000123", "2023-11-14 22:13:20", "2023-11-14T22:13:20Z", "2023-11-14", "14 Nov 2023, 22:13", "", None, "soon"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(P.parse_date(F.col("v"))).collect()]
    assert got == [1700000000000, 1700000000123, 1700000000000, 1700000000000, 1699920000000, 1699999980000, None, None, None]


def test_missing_date_column_and_empty_file(spark, tmp_path):
    rows, warnings = read(spark, tmp_path, "Artist\tTrack\nA\tOne\nB\tTwo\n")
    assert [r["ts_ms"] for r in rows] == [None, None] and len(warnings) == 2
    rows, warnings = read(spark, tmp_path, "", "empty.csv")
    assert rows == [] and warnings == ["The file is empty."]


def test_delimiters():
    assert [P.delimiter_of(s) for s in ("a;b", "a,b,c;d", "a\tb", "a|b", '"a,b";c', "x")] == [";", ",", "\t", "|", ";", ";"]


def test_numbering_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    from needledrop.plans.order import numbered

    assert numbered(df, [F.col("v")]).where("i <> v").isEmpty()


def test_stream(spark, tmp_path):
    from needledrop.streaming.repeats import repeat_sessions

    rows = [("A", "Song", "2023-01-01 00:00:00"), ("A", "Song (Live)", "2023-01-01 00:00:30"), ("A", "Other", "2023-01-01 00:01:00"), ("B", "End", "2023-01-02 00:00:00")]
    spark.createDataFrame(rows, "artist string, title string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("artist string, title string, ts timestamp").parquet(str(tmp_path / "in"))
    query = repeat_sessions(stream).writeStream.format("memory").queryName("repeats").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["artist"], r["track_key"], r["plays"]) for r in spark.table("repeats").collect()] == [("A", "song", 2)]
