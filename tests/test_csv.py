"""CSV files of any layout, read in pieces, against a plain state machine."""

import random

import pytest

from needledrop.sources import plays as P


def records(text, delimiter):
    """Character by character: every quote toggles, two inside quotes are one, a line break outside ends a record."""
    out, row, field, inside, i = [], [], "", False, 0
    text = text.removeprefix("\ufeff")
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                field += '"'
                i += 1
            elif c == '"':
                inside = False
            else:
                field += c
        elif c == '"':
            inside = True
        elif c == delimiter:
            row.append(field)
            field = ""
        elif c == "\n":
            out.append([*row, field])
            row, field = [], ""
        elif c != "\r":
            field += c
        i += 1
    if field or row:
        out.append([*row, field])
    return [r for r in out if "".join(r).strip() or len(r) > 1]


@pytest.fixture
def pieces(spark):
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield put
    spark.conf.set("spark.sql.files.maxPartitionBytes", keep[0])
    spark.conf.set("spark.sql.files.openCostInBytes", keep[1])


def split(spark, path, delimiter):
    from pyspark.sql import functions as F

    found = P.records_of(P.lines_of(spark, [str(path)]))
    rows = found.orderBy("file", "block", "pos").select(P.fields(F.col("value"), F.lit(delimiter)).alias("f")).collect()
    return [list(r["f"]) for r in rows if "".join(r["f"]).strip() or len(r["f"]) > 1]


@pytest.mark.parametrize("size", (7, 40, 300, 1 << 20))
def test_records_at_every_split(spark, tmp_path, pieces, size):
    r, at = random.Random(size), tmp_path / "log.csv"
    tokens = ['"', '""', ";", "\n", "\r\n", "a", "bc", " ", "é", "\r", ';"x;y"', 'q"u\no"t', '"""']
    text = "\ufeff" + "".join(r.choice(tokens) for _ in range(700)) + '"' * 0
    text += '"' * (text.count('"') % 2) + "\nlast;row\n"
    at.write_bytes(text.encode())
    pieces(size)
    assert size > 1000 or P.lines_of(spark, [str(at)]).rdd.getNumPartitions() > 1
    assert split(spark, at, ";") == records(text, ";")


def test_records_over_many_ranges(spark, tmp_path, pieces):
    """A record that begins in one range, fills others and ends in a last one; then plain ones."""
    long = "\n".join(f"line {i} with text" for i in range(60))
    text = f'a;b\nx;"{long}"\ny;z\nx;"{long}";"{long}"\n"no end\nof;it'
    (tmp_path / "log.csv").write_text(text)
    pieces(50)
    assert split(spark, tmp_path / "log.csv", ";") == records(text, ";")


def test_a_quote_that_is_never_closed_is_said(spark, tmp_path, monkeypatch):
    (tmp_path / "log.csv").write_text('a;b\n"' + "x\n" * 1000)
    monkeypatch.setattr(P, "RECORD_BYTES", 100)
    with pytest.raises(ValueError, match="quote"):
        P.records_of(P.lines_of(spark, [str(tmp_path / "log.csv")]))


def test_quotes_inside_a_field(spark, tmp_path):
    (tmp_path / "log.csv").write_text('Artist;Track;Album;Date\nab"c;d"e;One;Alb;1700000000\n"say ""hi""";Two;;1700000060\n')
    rows, warnings = P.read_csv(spark, str(tmp_path / "log.csv"))
    assert [(r["artist"], r["title"], r["album"]) for r in rows.orderBy("i").collect()] == [("abc;de", "One", "Alb"), ('say "hi"', "Two", "")] and warnings == []


def test_a_folder_of_three_layouts(spark, tmp_path):
    (tmp_path / "es.csv").write_text("\ufeffTítulo;Artista;Álbum;Fecha\nUno;Ana;Alb, x;1700000000\n", encoding="utf-8")
    (tmp_path / "en.csv").write_text('Date,Track,Artist,Album\n2023-11-14 22:14:20,"Two, too",Bob,\n1700000120,Three,Cy,"A;b"\n')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "bare.csv").write_text("Dora\tAlb\tid\tFour\t1700000180\n\nEve\tAlb\tid\tFive\t1700000240\n")
    (tmp_path / "odd.csv").write_text("one;two;three;four\nFay;Alb;id;Six\n")
    rows, warnings = P.read_csv(spark, str(tmp_path))
    got = [(r["artist"], r["title"], r["album"], r["ts_ms"] and r["ts_ms"] // 1000, r["source"]) for r in rows.orderBy("i").collect()]
    assert got == [
        ("Ana", "Uno", "Alb, x", 1700000000, "es.csv"), ("Bob", "Two, too", "", 1700000060, "en.csv"), ("Cy", "Three", "A;b", 1700000120, "en.csv"),
        ("Dora", "Four", "Alb", 1700000180, "bare.csv"), ("Eve", "Five", "Alb", 1700000240, "bare.csv"), ("Fay", "Six", "Alb", None, "odd.csv"),
    ]
    assert len(warnings) == 2 and any("usual order" in w for w in warnings) and any("1 rows" in w for w in warnings)


def test_plain_files_are_not_shuffled_by_range(spark, tmp_path):
    """Only ranges with quoted line breaks go through the ordered path."""
    (tmp_path / "log.csv").write_text("".join(f'a{i};"b;c";d\n' for i in range(50)))
    found = P.records_of(P.lines_of(spark, [str(tmp_path / "log.csv")]))
    assert found.count() == 50


def test_python_and_column_fields_agree(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    values = ["".join(r.choice('";\r ab') for _ in range(r.randrange(12))) for _ in range(300)] + ["", '""', '""""', '"";""', '";"']
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [list(x["f"]) for x in df.select(P.fields(F.col("v"), F.lit(";")).alias("f")).collect()] == [P.fields_of(v, ";") for v in values]
