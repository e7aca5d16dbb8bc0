"""The distances of all pairs of keys of one initial and length, far ones included."""

from itertools import combinations

from needledrop import queries


def test_far_pairs_are_there(spark, monkeypatch):
    names = ["abcd", "abce", "axyz", "azzz", "bcde", "abc", "aqrstu", "amnopq"]
    monkeypatch.setattr(queries, "orders_log", lambda spark, folder: spark.createDataFrame([(n,) for n in names], "artist string"))
    got = {(r["a"], r["b"]): r["distance"] for r in queries._edit_distance(spark, "").collect()}
    assert set(got) == {p for p in combinations(sorted(names), 2) if p[0][0] == p[1][0] and len(p[0]) == len(p[1])}
    assert got["abcd", "abce"] == 1 and got["abcd", "axyz"] == 3 and got["amnopq", "aqrstu"] == 3
