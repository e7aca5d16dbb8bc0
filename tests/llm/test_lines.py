"""Line dedup against a plain model."""

import hashlib
import random

from needledrop.llm import line_dedup as K

SPACES, LOWER = " \t\n\x0b\f\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(rows, least=20, docs=3):
    """(id, lines, dropped, kept text)."""
    holders, key = {}, lambda line: line.strip(SPACES).translate(LOWER)
    place = lambda d: (d is not None, d or 0)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(place(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < docs or max(holders[key(x)]) == place(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def digests(rows):
    return sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in rows), key=repr)


LONG = "A line that is long enough"


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id bigint, text string, row int, h1 int, drops int").repartition(3)
    got = sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in K.deduped(df).collect()), key=repr)
    assert got == model(rows)
    assert sorted(map(tuple, K.digested(K.deduped(df)).collect()), key=repr) == digests(got)
    back = K.filtered(df)
    assert back.columns == df.columns and sorted((tuple(r)[:2] for r in back.collect()), key=repr) == sorted(((d, t) for d, _, _, t in got), key=repr)


def test_odd_rows(spark):
    rows = [
        (1, f"{LONG}\nown\n{LONG} "), (2, f"\t{LONG.upper()}\r"), (3, f"x\n\n{LONG}\n"), (3, LONG), (4, None), (5, ""), (6, "\n\n"), (None, LONG), (None, f"{LONG}\nz"),
        (7, "é" * 20), (8, "É" * 20), (9, "é" * 20), (10, "é" * 20 + " "), (11, "é" * 19), (12, "é" * 20 + "\nlast"), (2, f"\t{LONG.upper()}\r"),
    ]
    check(spark, rows)
    check(spark, [])
    check(spark, [(None, LONG), (None, LONG), (1, LONG)])  # two documents: ids count, not rows


def test_random_documents(spark):
    r = random.Random(5)
    lines = [f"{LONG} number {i}" for i in range(30)] + ["short", "", "  "]
    check(spark, [(r.randrange(60), "\n".join(r.choice(lines) for _ in range(r.randrange(1, 30)))) for _ in range(120)])


def test_a_long_document_takes_time_by_its_lines(spark):
    import time

    text = "\n".join(f"{LONG} {i % 50_000}" for i in range(100_000))
    df = spark.createDataFrame([(i, text) for i in range(3)], "doc_id bigint, text string")
    began = time.time()
    assert sorted((r["row"]["doc_id"], r["n_lines"], r["n_dropped"]) for r in K.deduped(df).collect()) == [(0, 100_000, 100_000), (1, 100_000, 100_000), (2, 100_000, 0)]
    assert time.time() - began < 60
