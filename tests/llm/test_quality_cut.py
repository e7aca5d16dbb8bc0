"""Quality rules on planted mild junk, beside clean documents with long tails."""

import random

from samples import frame

from needledrop.llm import quality_rules

R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(3000)]


def words(n=120):
    return [R.choice(VOCABULARY) for _ in range(n)]


def prose(n=120, symbols=0.0):
    """A text in lines of ten words, with some capitals, ``symbols`` of its characters being symbols."""
    w = [x.capitalize() if R.random() < 0.1 else x for x in words(n)]
    for _ in range(round(symbols * sum(map(len, w)) / (1 - symbols))):
        w[R.randrange(n)] += "#"
    return "\n".join(" ".join(w[i : i + 10]) for i in range(0, n, 10))


def left(spark, *kinds):
    """The share of each kind's texts that is kept, all in one group."""
    rows = [(i, text, "en", "src", k) for k, texts in enumerate(kinds) for i, text in enumerate(texts)]
    kept = quality_rules.filtered(frame(spark, rows)).groupBy("n_chars").count().collect()
    kept = {r["n_chars"]: r["count"] for r in kept}
    return [kept.get(k, 0) / len(texts) for k, texts in enumerate(kinds)]


def test_each_statistic_rejects_alone(spark):
    clean = [prose() for _ in range(400)]
    symbols = [prose(symbols=0.1) for _ in range(20)]
    # every third line's words once more, in other company: just within the fixed limit on repeated words
    repeats = []
    for _ in range(20):
        w = words(120)
        repeats.append(" ".join(w[:93] + w[:27]))
    shouting = [prose().upper() for _ in range(20)]
    marks = [" ".join(x + "!" * (i % 4 == 0) for i, x in enumerate(words())) for _ in range(20)]
    long_words = [" ".join(x + y for x, y in zip(words(60), words(60), strict=True)) for _ in range(20)]
    got = left(spark, clean, symbols, repeats, shouting, marks, long_words)
    assert got[0] >= 0.99 and got[1:] == [0] * 5


def test_symbols_beyond_a_wide_clean_spread(spark):
    """Clean symbol rates with a deviation of half a log unit: a tenth of symbols is still junk."""
    clean = [prose(200, symbols=0.006 * 2.718 ** R.gauss(0, 0.5)) for _ in range(500)]
    got = left(spark, clean, [prose(200, symbols=0.1) for _ in range(25)], [prose(200, symbols=0.5) for _ in range(25)])
    assert got[0] >= 0.98 and got[1:] == [0, 0]


def test_a_third_of_copies_goes(spark):
    """A third of a group are copies of one junk page: they must not become the estimate."""
    clean = [prose() for _ in range(300)]
    for junk in ([prose(symbols=0.2)] * 150, [prose(symbols=0.2).upper() + f" {i}" for i in range(150)]):
        got = left(spark, clean, junk)
        assert got[0] >= 0.98 and got[1] == 0
