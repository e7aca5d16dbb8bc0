"""A play log made from the order tables: parts are titles, brands are artists, with deliberate, repeatable dirt.

The same text is the oracle's: it is written in the SQL that Spark and DuckDB share, but for the milliseconds of a date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.plans.storage import once, stamp
from needledrop.sources.plays import from_columns

DIRTY = r"""
SELECT CASE WHEN l_orderkey % 1499 = 7 THEN p_brand || 'x'
            WHEN l_orderkey % 97 = 0 THEN upper(p_brand)
            WHEN l_orderkey % 97 = 1 THEN p_brand || ' & Guest'
            WHEN l_orderkey % 97 = 2 THEN 'The ' || p_brand
            WHEN l_orderkey % 97 = 3 THEN p_brand || ' Band'
            ELSE p_brand END AS artist,
       CASE (p_partkey * 7 + l_linenumber) % 53
            WHEN 0 THEN upper(p_name)
            WHEN 1 THEN p_name || ' (Live)'
            WHEN 2 THEN p_name || ' - Live'
            WHEN 3 THEN p_name || ' (feat. Guest)'
            WHEN 4 THEN p_name || ' (Official Video)'
            WHEN 5 THEN p_name || 's'
            WHEN 6 THEN p_brand || ' - ' || p_name
            WHEN 7 THEN replace(p_name, 'a', 'á')
            WHEN 8 THEN p_name || ' ''n'' more'
            WHEN 9 THEN p_name || ' ’n’ more'
            WHEN 10 THEN replace(p_name, ' ', '  ')
            WHEN 11 THEN p_name || ' - Official Audio'
            WHEN 12 THEN ''
            ELSE p_name END AS title,
       CASE WHEN l_suppkey % 11 = 0 THEN ''
            WHEN l_suppkey % 13 = 0 THEN lower(p_type)
            WHEN l_suppkey % 17 = 0 THEN replace(p_type, 'E', 'É')
            ELSE p_type END AS album,
       {millis} + (l_orderkey % 1440) * 60000 + l_linenumber * 9000 AS ts_ms,
       l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
"""
SPARK_MILLIS = (
    "(datediff(cast(o_orderdate AS date), date'1970-01-01') * 86400000L + hour(o_orderdate) * 3600000L"
    " + minute(o_orderdate) * 60000L + cast(second(o_orderdate) AS bigint) * 1000L)"
)
DUCKDB = DIRTY.replace("{millis}", "epoch_ms(o_orderdate)")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plays, written once for each application and folder."""

    def make() -> DataFrame:
        query = DIRTY.replace("{millis}", SPARK_MILLIS)
        tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "part", "orders")}
        for n in tables:
            query = query.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
        dirty = spark.sql(query, **tables)
        return from_columns(dirty, "artist", "title", "album", "ts_ms", "orders", [F.col(k) for k in ("k1", "k2", "k3", "k4")])

    return once(spark, f"orders_log:{version(spark, sf_dir)}", make)


def version(spark: SparkSession, sf_dir: str) -> str:
    """What tells this log from one of other tables."""
    return stamp(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "part")))
