"""Run folders: removed at their end, one for each thread, and nothing remembered of them."""

import os
from concurrent.futures import ThreadPoolExecutor

from needledrop.plans import storage
from needledrop.queries import queries

DATA = "/root/testdata/sf0.001"


def rows(spark, name="c_artist_index"):
    return sorted(map(tuple, queries()[name](spark, DATA).collect()))


def test_a_query_works_after_the_run_that_made_it(spark):
    with storage.scratch(spark) as folder:
        inside = rows(spark)
        assert os.listdir(folder.removeprefix("file://"))
    assert not os.path.exists(folder.removeprefix("file://"))
    assert rows(spark) == inside == rows(spark)


def test_runs_of_threads_are_apart(spark):
    """The first to end leaves the other's tables alone; steps side by side write into their run's folder."""

    def run(_):
        with storage.scratch(spark) as folder:
            made = storage.together(spark, lambda: storage.written(spark.range(5), "a"), lambda: storage.shared_dir(spark), lambda: rows(spark))
            assert made[1] == folder and made[0].count() == 5
            assert all(f.startswith(folder) for f in made[0].inputFiles())
            return folder, made[2], rows(spark)

    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(run, range(3)))
    assert len({f for f, _, _ in found}) == 3
    assert all(a == b == found[0][1] for _, a, b in found)
    assert not any(os.path.exists(f.removeprefix("file://")) for f, _, _ in found)
