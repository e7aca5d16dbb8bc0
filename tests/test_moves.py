"""What tasks sort and what is moved doesn't grow with the plays."""

from pyspark.sql import functions as F

from needledrop.operators import pairs, repeats
from needledrop.plans import order
from needledrop.rules import Rules


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 50)
    got = order.numbered(spark.range(1000).select((999 - F.col("id")).alias("v")), [F.col("v")])
    assert got.where("i <> v").isEmpty() and got.select("part").distinct().count() > 10


def test_only_neighbours_of_one_track_are_looked_at(spark):
    rows = [(0, i, "A", "x" if i in (500, 501) else f"t{i}", i * 1000) for i in range(1000)]
    plays = spark.createDataFrame(rows, "part int, i bigint, artist string, track_key string, ts_ms bigint")
    assert sorted(r["i"] for r in repeats.candidates(plays, Rules()).collect()) == [0, 500, 501, 999]


def test_many_plays_of_a_cell_move_as_one_row(spark):
    w = 600_000
    plays = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("artist"), (F.col("id") * 100).alias("t"))
    sides = spark.createDataFrame([("A", "B", "A", "B")], "x string, y string, few string, many string")
    assert pairs.meetings(sides, plays, w).count() <= 3
