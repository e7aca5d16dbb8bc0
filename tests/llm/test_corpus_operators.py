"""SimHash, mixing and quality rules against plain Python."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from samples import frame, rows

from needledrop.llm import mixing, quality_rules, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
by_row = lambda found: sorted(map(repr, (tuple(r) for r in found)))


def fingerprint(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints):
    """prints: [(doc_id, fp)]; the least id of each row's component."""
    of = sorted({fp for _, fp in prints})
    parent = {f: f for f in of}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(of):
        for b in of[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(b)] = root(a)
    least = defaultdict(list)
    for k, fp in prints:
        least[root(fp)] += [k] * (k is not None)
    return [(k, fp, min(least[root(fp)], default=None)) for k, fp in prints]


def test_simhash_equals_brute_force(spark):
    data = [r for r in rows() if r[0] != 9004]
    base = "the quick brown fox jumps over the lazy dog and then it runs far away from all of us here " * 3
    data += [(30_000 + i, base + f"tail {i % 3}", "en", "s", 1) for i in range(9)]
    want = components([(k, fingerprint(t)) for k, t, *_ in data])
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.classes(frame(spark, data, clash=True)).collect()]
    assert by_row(got) == by_row(want)


@pytest.mark.parametrize("cap", [2048, 3])
def test_links_of_close_fingerprints(spark, cap):
    import random

    r = random.Random(5)
    prints = set()
    for _ in range(25):
        f = r.getrandbits(64)
        for _ in range(8):
            prints.add(f)
            f ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 3, 4, 5])))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp bigint")
    labels = {x["node"] % (1 << 64): x["label"] for x in simhash.components(simhash.edges(df, cap)).collect()}
    want = {f: c for f, _, c in components([(f, f) for f in prints])}
    groups = defaultdict(set)
    for f in prints:
        groups[labels.get(f, f"alone {f}")].add(f)
    expected = defaultdict(set)
    for f in prints:
        expected[want[f]].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_patterns_cover_every_difference():
    """Any difference of at most 4 bits leaves the equal segments of some pattern, and passes its chain test."""
    from itertools import combinations_with_replacement

    found = simhash.patterns()
    for places in combinations_with_replacement(range(simhash.M), simhash.TAU):
        hit = set(places)
        assert any(not hit & set(p) for p in found)


def test_one_document_of_each_group_stays(spark):
    data = [r for r in rows() if r[0] != 9004]
    df = frame(spark, data, clash=True)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    prints = components([(k, fingerprint(t)) for k, t, *_ in data])
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    want = {c if c is not None else fp for _, fp, c in prints}
    assert len(ids) == len(want) and {i for i in ids if i is not None} == {c for _, _, c in prints if c is not None}


def test_mixing_equals_sql(spark):
    data = rows()
    got = mixing.mix(frame(spark, data, clash=True)).collect()
    c = duckdb.connect()
    frame(spark, data).toPandas().pipe(lambda documents: c.register("documents", documents.astype({"doc_id": "Int64", "n_chars": "Int64"})))
    want = c.sql(f"select doc_id, size, source_size, target, taken from ({mixing.ORACLE})").fetchall()
    # repeated rows meet once in the query and twice in the SQL's join only if their keys repeat
    assert by_row(got) == by_row(want)
    total, taken, targets = 0, Counter(), {}
    for (k, text, _, source, _), r in zip(sorted(data, key=repr), sorted(got, key=repr), strict=False):
        total += len(WORDS.findall(text or ""))
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6
        targets[r["source_size"], r["target"]] = r["target"]
        taken[r["source_size"], r["target"]] += r["taken"]
    assert total == sum(r["size"] for r in got)


def test_mixed_rows(spark):
    df = frame(spark, clash=True)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    times = Counter(r["doc_id"] for r in out.collect())
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(df).collect() if r["size"] and r["doc_id"] != 9006}
    assert all(times[k] == n for k, n in want.items())


def statistics(text):
    t = text or ""
    w = WORDS.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark):
    data = rows()
    got = quality_rules.judged(frame(spark, data, clash=True), ["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for k, t, *_ in data:
        s = statistics(t)
        want.append((k, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert by_row(got) == by_row(want)


def test_outliers_go_and_clean_documents_stay(spark):
    import random

    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = lambda mark: " ".join(r.choice(words) + mark() for _ in range(120))
    clean = [(i, text(lambda: "." if r.random() < 0.1 else ""), "en", f"src{i % 2}", 1) for i in range(500)]
    junk = [(1000 + i, text(lambda: r.choice(["###", "$$$"])), "en", f"src{i % 2}", 1) for i in range(60)]
    kept = {x["doc_id"] for x in quality_rules.filtered(frame(spark, clean + junk)).collect()}
    assert kept == {k for k, *_ in clean}


def test_empty_tables(spark):
    df = frame(spark, [])
    assert simhash.classes(df).isEmpty() and simhash.deduplicated(df).isEmpty()
    assert mixing.mix(df).isEmpty() and mixing.mixed(df).isEmpty()
    assert quality_rules.filtered(df).isEmpty()
