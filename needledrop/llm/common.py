"""Shared pieces of the corpus operators: Arrow batch mapping, bounded samples, spans in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.plans.storage import written  # noqa: F401

#: Words are maximal runs of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str) -> DataFrame:
    """Apply a function of columns, in Arrow batches, without a shuffle.

    ``make()`` runs once per task and returns a function that takes one Python list for each column of ``df`` (a slice
    of at most ``SLICE_ROWS`` rows) and returns one list for each column of ``schema``.
    """
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = f(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=t.type) for v, t in zip(out, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(run, kind)


def remainder(doc_id: F.Column, modulus: int) -> F.Column:
    """crc32 of the id as text (a null id: empty), modulo ``modulus``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def few(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Hint a broadcast of ``df``, of which ``rows`` have been counted, if they are at most ``most``; else a shuffle."""
    return F.broadcast(df) if rows <= most else df


#: Buckets of the histogram that a sample's threshold is read from, and the bits of the hash.
SAMPLE_BUCKETS, SAMPLE_BITS = 4096, 60


def sampled(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most ``most`` different rows of ``df``'s ``columns``, those with the least hashes: the same ones each time.

    A threshold on the hash comes before anything is shuffled, so no task gets more than its share of about four times
    ``most`` rows; a histogram of those gives the exact threshold. Values that repeat count once.
    """
    own = df.select(*columns, F.shiftrightunsigned(F.xxhash64(*columns), 64 - SAMPLE_BITS).alias("_h"))
    n, full = own.count(), 1 << SAMPLE_BITS
    limit = full if n <= most else min(full, full // n * 4 * most)
    while True:
        width = -(-limit // SAMPLE_BUCKETS)
        low = own.where(F.col("_h") < limit).distinct()
        buckets = low.groupBy(F.expr(f"_h div {width}L").alias("b")).count().collect()  # at most SAMPLE_BUCKETS rows
        if limit == full or sum(r["count"] for r in buckets) >= most:
            break
        limit = min(full, 8 * limit)  # values repeat: so many rows hold fewer values
    left, cut = most, limit
    for b, k in sorted((r["b"], r["count"]) for r in buckets):
        if k > left:
            cut = b * width
            break
        left -= k
    return own.where(F.col("_h") < cut).drop("_h").distinct()


def spans_sql(kinds: list[tuple[str, str, str]]) -> str:
    """DuckDB SQL of (doc_id, place, kind, start, stop) for (name, expression, condition on the match m and the gap before it).

    A text is split by the expression; the lengths of gaps and matches give the places.
    """
    each = []
    for n, (name, pattern, condition) in enumerate(kinds):
        p = "'" + pattern.replace("'", "''") + "'"
        each.append(f"""
  SELECT doc_id, {n} AS place, '{name}' AS kind, start, start + len(m) AS stop FROM (
    SELECT doc_id, gaps[i] AS gap, matches[i] AS m,
           (list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda g: len(g))), 0))::BIGINT AS start
    FROM (SELECT doc_id, gaps, matches, unnest(range(1, len(matches) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS matches FROM texts)))
  WHERE {condition}""")
    return " UNION ALL ".join(each)
