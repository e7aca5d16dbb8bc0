"""Every pair of strings within so many edits shares a key."""

import random
import string

from needledrop.operators.near import own_keys, probed_keys
from pyspark.sql import functions as F

R = random.Random(9)


def edited(s, k):
    for _ in range(k):
        i = R.randrange(len(s) + 1)
        s = R.choice([s[:i] + R.choice("abcd ") + s[i:], s[: max(i - 1, 0)] + s[i:], s[: max(i - 1, 0)] + R.choice("abcd") + s[i:]])
    return s


def test_near_strings_share_a_key(spark):
    rows = []
    for k in (1, 2, 3):
        for _ in range(400):
            s = "".join(R.choice(string.ascii_lowercase[:6] + " ") for _ in range(R.randint(k + 1, 24)))
            rows.append((k, s, edited(s, R.randint(1, k))))
    df = spark.createDataFrame(rows, "k int, a string, b string").where("length(b) > k")
    for k in (1, 2, 3):
        own = df.where(F.col("k") == k).where(F.levenshtein("a", "b") <= k)
        assert own.where(~F.arrays_overlap(own_keys(F.col("a"), k), probed_keys(F.col("b"), k, k, k))).isEmpty() and own.count() > 300
    longer = df.where("k = 2 and length(b) >= length(a)").where(F.levenshtein("a", "b") <= 2)
    assert longer.where(~F.arrays_overlap(own_keys(F.col("a"), 2), probed_keys(F.col("b"), 2, 2, 0))).isEmpty()
