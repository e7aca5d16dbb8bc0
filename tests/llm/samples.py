"""Documents with every edge case: nulls, empty and long texts, repeated rows, clashing extra columns."""

import duckdb

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["size", "h", "fp", "row", "uid", "place", "target", "kept", "label", "n_words", "spans", "score", "copies", "d", "key"]
DATA = "/root/testdata/sf0.001"


def real(n=120):
    return duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{DATA}/documents.parquet' order by doc_id limit {n}").fetchall()


def rows(n=120):
    edge = [
        (9001, None, "en", "src1", None),
        (9002, "", "en", "src1", 0),
        (9003, " \t\n\x0b ", None, None, 5),
        (9004, "word " * 30_000, "en", "src2", 150_000),
        (9005, "x" * 50_000 + "@" + "y" * 50_000, "de", None, 100_001),
        (None, "a text without an id, but with twelve words in it all told", "en", "src1", 58),
        (9006, "café 日本語 \U0001f600 token=abcdefghijkl é me@example.com 1.2.3.4", "fr", "src3", 60),
        (9006, "café 日本語 \U0001f600 token=abcdefghijkl é me@example.com 1.2.3.4", "fr", "src3", 60),
        (9007, "1" * 20_000, "en", "src1", 20_000),
        (9008, "a.b@c.d@e.f +1 (23) 45-678 4111 1111 1111 1111 +12 999.1.1.1 256.1.1.1 0255.01.1.1", "en", "src1", 80),
    ]
    return real(n) + edge


def frame(spark, data=None, clash=False):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(7) for c in CLASHING})
    return df
