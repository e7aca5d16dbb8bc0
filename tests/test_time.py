"""Nearness in time by a sweep, and untidy text with white space of any kind."""

import random

from pyspark.sql import functions as F

from needledrop.operators import long_tail, pairs
from needledrop.plans.index import Index
from needledrop.plans.storage import written
from needledrop.sources.plays import from_columns

W = 600_000


def index(spark, rows):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "artist string, title string, album string, ts bigint, k int")
    return Index(written(from_columns(df, "artist", "title", "album", "ts", order=[F.col("k")]), "plays"))


def model(times, x, y):
    few, many = (y, x) if len(times[y]) < len(times[x]) else (x, y)
    return sum(any(abs(t - u) <= W for u in times[many]) for t in times[few])


def test_sweep_equals_all_pairs_of_times(spark):
    """Times at the very ends of slots and windows, negative ones and repeats; a star of one artist in many pairs."""
    r = random.Random(4)
    slot = W * pairs.SLOT
    edges = [k * slot + d for k in (-1, 0, 1, 2) for d in (-W - 1, -W, -1, 0, 1, W, W + 1)]
    rows = [("Hub", "s", "", r.choice(edges)) for _ in range(30)] + [("Hub", "s", "", None)]
    for k in range(25):
        rows += [(f"Leaf {k}", "s", "", r.choice(edges) + r.choice((0, 1, W, -W))) for _ in range(r.randrange(1, 40))]
    rows += [("Undated", "s", "", None)]
    times = {}
    for a, _, _, t in rows:
        times.setdefault(a, []).extend([t] if t is not None else [])
    names = [(("Hub", f"Leaf {k}") if k % 2 else (f"Leaf {k}", "Hub")) for k in range(25)] + [("Hub", "Undated"), ("Leaf 1", "Leaf 2")]
    p = spark.createDataFrame([(x, y, 7) for x, y in names], "x string, y string, more int")
    got = {(q["x"], q["y"]): q["mix"] for q in pairs.time_mix(p, index(spark, rows), W).collect()}
    assert got == {(x, y): model(times, x, y) for x, y in names}


def test_a_star_moves_less_than_twice_the_plays(spark):
    """One artist in 1,000 pairs: its plays are not copied for each."""
    rows = [("Hub", "s", "", k * 1000) for k in range(2000)] + [(f"Leaf {k % 1000}", "s", "", k * 900) for k in range(3000)]
    ix = index(spark, rows)
    p = spark.createDataFrame([("Hub", f"Leaf {k}") for k in range(1000)], "x string, y string")
    assert pairs.time_mix(p, ix, W).where("mix > 0").count() == 1000
    few = p.selectExpr("x", "y", "y AS few", "x AS many")
    plays = ix.plays.selectExpr("artist", "ts_ms AS t")
    assert pairs.meetings(few, plays, W).count() < 2 * len(rows)


def test_white_space_of_any_kind(spark):
    rows = [("\tTab", "x　", "a", 1), ("A", " y", "a  b", 2), ("B", "double  nbsp", "z ​", 3), ("C", " sp ", "", 4), ("unknown", "ok", "fi�ne", 5)]
    df = spark.createDataFrame([(*r,) for r in rows], "artist string, title string, album string, ts bigint")
    plays = written(from_columns(df, "artist", "title", "album", "ts"), "plays")
    got = {r["problem"]: (r["n"], r["examples"]) for r in long_tail.untidy(Index(plays)).collect()}
    assert got == {
        "leading or trailing spaces in the artist": (1, ["␣Tab"]),
        "leading or trailing spaces in the title": (3, ["x␣", "␣y", "␣sp␣"]),
        "double spaces in the title": (1, ["double␣␣nbsp"]),
        "double spaces in the album": (1, ["a␣ b"]),
        "unusual (non-breaking) spaces in the title": (3, ["x␣", "␣y", "double␣␣nbsp"]),
        "unusual (non-breaking) spaces in the album": (1, ["a␣ b"]),
        "invisible characters in the album": (1, ["z ​"]),
        "unreadable characters in the album": (1, ["fi�ne"]),
        "generic artist name": (1, ["unknown"]),
        "scrobbles with no album": (1, ["(empty)"]),
    }
