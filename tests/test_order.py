"""Total order, lasting ids, runs over ranges of plays, and touched plays, at several partitionings."""

import random

import pytest
from pyspark.sql import functions as F

from needledrop.operators import repeats
from needledrop.plans.index import Index
from needledrop.plans.report import Audit
from needledrop.plans.storage import written
from needledrop.rules import Rules
from needledrop.sources.plays import from_columns


@pytest.fixture
def partitions(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def put(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)

    yield put
    for k, v in keep.items():
        spark.conf.set(k, v)


def log(spark, rows):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "artist string, title string, album string, ts bigint, k int")
    return written(from_columns(df, "artist", "title", "album", "ts", order=[F.col("k")]), "plays")


def tied():
    """Two artists with the same slips, so that findings are equal but for what they are about; and equal runs."""
    rows = []
    for artist in ("Ada Berg", "Ben Holt", "Cyd Marsh"):
        rows += [(artist, "Hot Bolts", "X", None)] * 6 + [(artist, "Hot Bolt", "X", None)] + [(artist, "Melody (Official Video)", "X", None)] * 2
    rows += [("Loop", "Song", "X", 0), ("Loop", "Song", "X", 0), ("Gap", "Other", "X", 0), ("Loop", "Song", "X", 0), ("Loop", "Song", "X", 0)]
    rows += [("Loop", "Song", "X", 10_000_000), ("Loop", "Song", "X", 10_000_000)]
    return rows


def test_order_and_ids_hold_at_any_partitioning(spark, partitions):
    seen = []
    for n in (1, 7, 64):
        partitions(n)
        audit = Audit(Index(log(spark, tied())), Rules(minimum_confidence="low"))
        seen.append([(r["place"], r["id"], r["proposed"], [tuple(t) for t in r["targets"]]) for r in audit.findings.orderBy("place").collect()])
    assert seen[0] == seen[1] == seen[2]
    ids = [r[1] for r in seen[0]]
    assert len(set(ids)) == len(ids) and sum("Song" in str(r[3]) for r in seen[0]) == 3


def test_ids_stay_when_other_plays_come(spark):
    before = Audit(Index(log(spark, tied())), Rules(minimum_confidence="low"))
    more = tied() + [("New One", "Another", "Y", 99_000_000), ("New One", "Another", "Y", 99_001_000)] + [("Dot Lane", "Hot Bolts", "X", None)] * 6 + [("Dot Lane", "Hot Bolt", "X", None)]
    after = Audit(Index(log(spark, more)), Rules(minimum_confidence="low"))
    listed = lambda a: {r["id"]: (r["type"], [tuple(t) for t in r["targets"]]) for r in a.findings.where("not informational").collect()}
    old, new = listed(before), listed(after)
    assert old.items() <= new.items() and len(new) > len(old)


def model(rows, window):
    """(artist, key, first title, plays, gap, start, since) of every run of two or more."""
    out, i = [], 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows) and rows[j + 1][:2] == rows[i][:2] and None not in (rows[j + 1][3], rows[j][3]) and rows[j + 1][3] - rows[j][3] <= window:
            j += 1
        if j > i:
            out.append((rows[i][0], rows[i][1], rows[i][2], j - i + 1, min(rows[k + 1][3] - rows[k][3] for k in range(i, j)), i, rows[i][3]))
        i = j + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_over_ranges(spark, seed):
    """Ranges of every length, so that runs end at, cross and fill ranges."""
    r = random.Random(seed)
    rows, ts, part, parts = [], 0, 0, []
    for _ in range(300):
        if r.random() < 0.8 and rows:
            a, k = rows[-1][:2]
        else:
            a, k = r.choice("AB"), r.choice("xyz")
        ts += r.choice((0, 1000, 30_000, 60_000, 60_001, 90_000)) if r.random() < 0.5 else 5
        rows.append((a, k, r.choice((k, k.upper())), ts))
        part += r.random() < (0.05, 0.3, 0.7, 1)[seed]
        parts.append(part)
    rows += [("A", "x", "x", None)] * 3
    parts += [part] * 3
    df = spark.createDataFrame([(p, i, *x) for i, (p, x) in enumerate(zip(parts, rows, strict=True))], "part int, i bigint, artist string, track_key string, title string, ts_ms bigint").repartition(5)
    got = repeats.runs(df, Rules()).select("artist", "track_key", "title", "plays", "gap_ms", "start", "since")
    assert sorted(map(tuple, got.collect())) == sorted(model(rows, 60_000))


def test_a_track_on_repeat_is_one_bounded_row(spark):
    n = 300_000
    df = spark.range(n).select((F.col("id") * 1000).alias("ts"), F.lit("A").alias("artist"), F.lit("Song").alias("title"), F.lit("").alias("album"))
    plays = written(from_columns(df, "artist", "title", "album", "ts", order=[F.col("ts")]), "plays")
    assert [(r["plays"], r["start"], r["gap_ms"]) for r in repeats.runs(plays, Rules()).collect()] == [(n, 0, 1000)]
    found = repeats.repeated_plays(plays, Rules()).first()
    assert found["impact"] == n - 1 and len(found["marks"]) == 1
    audit = Audit(Index(plays), Rules())
    assert audit.affected.count() == n - 1  # only the repeats are touched


def test_touched_plays_read_the_log_once(spark):
    audit = Audit(Index(log(spark, tied())), Rules(minimum_confidence="low"))
    plan = audit.affected._jdf.queryExecution().optimizedPlan().toString()
    own = [x for x in plan.split("\n") if "Relation" in x and "album_id" in x]
    assert len(own) <= 1
