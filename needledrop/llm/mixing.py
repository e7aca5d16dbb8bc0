"""Mixing sources to target weights with hash-threshold histograms.

Sizes (words) are summed by source and hash bucket. In each source the buckets' running sums show the bucket in which its
budget is reached; only that boundary bucket is refined, by the next bits of the hash, until one hash value is left. A
document is then taken if its hash is below its source's threshold: nothing is sorted, and reruns agree because the hash
is a digest of the document itself. Rows with the same id and text have the same hash; if they are the boundary, a second
hash, of the row's place in its written table, is refined in the same way, so as many of them are taken as fit. Which ones
makes no difference. What a threshold leaves of a budget is the budget of a nested threshold over the documents that aren't
taken and are no longer than it, so a long document at the threshold costs little; what is left after ``ROUNDS`` of them goes
to the one document that is nearest to it in size, if that brings the source nearer to its target.

Sources in code point order (null last) weigh ``WEIGHTS`` in turn and share the sum of all sizes; a target stops at
``MOST`` times its source's size, and the excess is shared again by weight. A target above the source's size takes every
document ``floor(target / size)`` times and the rest by threshold.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own; of rows with the
same id and text, how many are taken is defined, but not which; columns besides id, text and source play no part, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop.llm.common import WORD, few, written

WEIGHTS, MOST = (1, 2, 3), 3
#: Bits of the hash, and of a level of the histograms: a source has at most 4,096 buckets at a time.
HASH_BITS, LEVEL_BITS = 60, 12
#: Nested thresholds of a source.
ROUNDS = 3


def n_words(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def digest(key: str = "doc_id", text: str = "text") -> F.Column:
    """60 bits of the MD5 of a row's id and text."""
    both = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def measured(df: DataFrame, carry: list[str], text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(row, source, size, h, u) of every row, written, so that ``u``, a hash of the row's place, stays as it is.

    ``row`` holds the columns ``carry``.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)
    row = F.struct(*carry).alias("row")
    return written(df.select(row, F.col(source).alias("source"), n_words(text).alias("size"), digest(key, text).alias("h"), place.alias("u")), "sizes")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``place``, a row's 1-based place by ``column`` (null last), without sorting all rows in one task."""
    order = F.col(column).asc_nulls_last()
    dealt = written(df.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "numbered")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.join(F.broadcast(parts), "part").withColumn("place", F.col("before") + within).drop("part", "before")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """(source, place, weight, source_size, target) of every source, and how many sources there are."""
    sums = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sources = written(sums.withColumn("weight", weight.cast("long")), "sources")
    n, total, all_weights = sources.agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
    share = (total or 0) / (all_weights or 1)
    fixed = None
    while True:  # each round fixes the sources that the share would lift above their limit; the share only grows
        above = F.col("source_size") * most <= F.col("weight") * share
        now = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if now == fixed or not now[1]:
            break
        fixed, share = now, (total - now[0]) / now[1]
    target = F.least(F.col("source_size") * most, F.col("weight") * F.lit(float(share))).cast("double")
    return sources.withColumn("target", target), n


def boundary(rows: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """(place, at, left, many) for each source of ``state`` (place, left) that has ``rows`` (place, h, size).

    The rows whose hash is below ``at`` fit in the budget and leave ``left`` of it; ``many`` rows have that hash. Where all fit,
    ``at`` is above every hash.
    """
    state, done, shift = state.withColumn("prefix", F.lit(0).cast("long")), None, HASH_BITS
    while shift:
        shift -= LEVEL_BITS
        own = few(state.withColumnRenamed("place", "of"), n)
        sums = (
            rows.join(own, (F.col("place") == F.col("of")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
            .groupBy("place", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("s"), F.count("*").alias("many"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("left").alias("left"))
        )
        running = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        before = (F.col("left") - F.col("sum") + F.col("s")).alias("left")
        over = F.when(F.col("sum") > F.col("left"), F.struct("bucket", "many", "low", "high", before))
        edge = (
            sums.withColumn("sum", F.sum("s").over(running))
            .groupBy("place")
            .agg(F.min(over).alias("e"), F.max("sum").alias("all"), F.first("left").alias("left"))
        )
        edge = written(edge, "boundary")
        found = edge.where("e is null or e.low = e.high").select(
            "place",
            F.coalesce("e.low", F.lit(1 << HASH_BITS)).alias("at"),
            F.coalesce("e.left", F.col("left") - F.col("all")).alias("left"),
            F.coalesce("e.many", F.lit(0)).alias("many"),
        )
        done = found if done is None else done.unionByName(found)
        state = edge.where("e.low < e.high").select("place", "e.left", F.col("e.bucket").alias("prefix"))
        if state.isEmpty():
            break
    return done


def cut(rows: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """(place, cut, among, left) for each source of ``state`` (place, left) that has ``rows`` (place, h, u, size).

    Rows with a hash below ``cut`` fit in the budget, as do those at ``cut`` whose second hash is below ``among``.
    """
    first = written(boundary(rows.drop("u"), state, n).withColumnRenamed("at", "cut"), "boundary")
    shared = first.where("many > 1")
    if shared.isEmpty():
        return first.select("place", "cut", F.lit(0).cast("long").alias("among"), "left")
    at = few(shared.select(F.col("place").alias("of"), "cut"), n)
    equal = rows.join(at, (F.col("place") == F.col("of")) & (F.col("h") == F.col("cut"))).select("place", F.col("u").alias("h"), "size")
    second = boundary(equal, shared.select("place", "left"), n).select("place", F.col("at").alias("among"), F.col("left").alias("rest"))
    both = first.join(few(second, n), "place", "left")
    return both.select("place", "cut", F.coalesce("among", F.lit(0).cast("long")).alias("among"), F.coalesce("rest", "left").alias("left"))


def below(rounds: int) -> F.Column:
    """Whether one of the first thresholds takes a row, beside the plan's columns."""
    out = F.lit(False)
    for k in range(rounds):
        under = (F.col("h") < F.col(f"cut_{k}")) | ((F.col("h") == F.col(f"cut_{k}")) & (F.col("u") < F.col(f"among_{k}")))
        out = out | ((F.col("size") <= F.col(f"limit_{k}")) & under)
    return out


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """(source, place, weight, source_size, target, copies, limit_k, cut_k, among_k, one_h, one_u) of every source, and how many.

    A document is taken ``copies`` times, and once more if for some k it is at most ``limit_k`` long and its hashes are below
    ``cut_k`` and ``among_k``, or if its hashes are ``one_h`` and ``one_u``.
    """
    sources, n = targets(rows, weights, most)
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)))
    plan = sources.withColumn("copies", F.coalesce(times, F.lit(0)).cast("long"))
    plan = plan.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = written(plan.withColumn("limit_0", F.col("source_size")), "targets")

    def still_open(rounds: int) -> DataFrame:
        own = few(plan.withColumnRenamed("source", "of"), n)
        return rows.where("size > 0").join(own, F.col("source").eqNullSafe(F.col("of"))).where(~below(rounds))

    for k in range(ROUNDS):
        fit = still_open(k).where(F.col("size") <= F.col(f"limit_{k}")).select("place", "h", "u", "size")
        found = cut(fit, plan.select("place", "left"), n).withColumnsRenamed({"cut": f"cut_{k}", "among": f"among_{k}", "left": "rest"})
        plan = plan.join(few(found, n), "place", "left").withColumn("left", F.coalesce("rest", "left")).drop("rest")
        plan = plan.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in (f"cut_{k}", f"among_{k}")})
        plan = written(plan.withColumn(f"limit_{k + 1}", F.floor("left")), "thresholds")
    # one document more for each source whose rest that makes smaller: the nearest size, then the smaller, then by hash
    off = F.abs(F.col("size") - F.col("left"))
    nearest = written(still_open(ROUNDS).groupBy("place").agg(F.min(F.when(off < F.col("left"), off)).alias("off")), "nearest")
    own = few(nearest.where("off is not null").withColumnRenamed("place", "_place"), n)
    ties = still_open(ROUNDS).join(own, (F.col("place") == F.col("_place")) & (off == F.col("off")))
    one = ties.groupBy("place").agg(F.min(F.struct("size", "h", "u")).alias("one")).select("place", F.col("one.h").alias("one_h"), F.col("one.u").alias("one_u"))
    return written(plan.join(few(one, n), "place", "left"), "thresholds"), n


def copies(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """``rows`` (source, size, h, u, ...) with the plan's columns and ``times``, how often each row is taken."""
    own = few(plan.withColumnRenamed("source", "of"), n)
    joined = rows.join(own, F.col("source").eqNullSafe(F.col("of")))
    alone = F.coalesce((F.col("h") == F.col("one_h")) & (F.col("u") == F.col("one_u")), F.lit(False))
    return joined.withColumn("times", F.col("copies") + (below(ROUNDS) | alone).cast("long")).drop("of")


def mix(df: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: the words that the mix takes of it, repeats counted."""
    rows = measured(df, ["doc_id"])
    plan, n = thresholds(rows.drop("row"))
    taken = copies(rows, plan, n)
    return taken.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that the mix takes, each as often as it is taken; columns as in ``df``."""
    rows = measured(df, df.columns)
    plan, n = thresholds(rows.drop("row"))
    taken = copies(rows, plan, n).where("times > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


#: The same rows in DuckDB SQL: targets by the sources' order of limit over weight, thresholds by a running sum over rows in the
#: order of their hash, in which rows with one hash follow each other.
SQL = r"""
WITH rows AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS place FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 15))::BIGINT AS h
    FROM documents)),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM rows GROUP BY source),
ordered AS (
  SELECT (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(3 * source_size) OVER before, 0)::DOUBLE AS fixed,
         ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS weights
  FROM sums WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (SELECT max((total - fixed) / weights) AS share FROM ordered),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * share) AS target,
         CASE WHEN source_size > 0 THEN floor(least((3 * source_size)::DOUBLE, weight * share) / source_size) ELSE 0 END AS copies
  FROM sums, shared),
open_0 AS MATERIALIZED (
  SELECT r.*, t.target - t.copies * t.source_size AS rest FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source WHERE size > 0),
{rounds}
one AS (SELECT * FROM open_{last} WHERE abs(size - rest) < rest QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - rest), size, h, place) = 1)
SELECT r.doc_id, r.size, t.source_size, t.target,
       (r.size * (t.copies + (r.size > 0 AND (o.place IS NULL OR n.place IS NOT NULL))::INTEGER))::BIGINT AS taken
FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
LEFT JOIN open_{last} o ON r.source IS NOT DISTINCT FROM o.source AND r.place = o.place
LEFT JOIN one n ON r.source IS NOT DISTINCT FROM n.source AND r.place = n.place
"""
#: A threshold: the rows that are short enough are summed in order, and those before the first that doesn't fit are taken.
ROUND = """
upto_{k} AS (
  SELECT *, sum(CASE WHEN size <= rest THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place) AS upto FROM open_{k}),
edge_{k} AS MATERIALIZED (
  SELECT source, min(place) FILTER (WHERE size <= rest AND upto > rest) AS edge FROM upto_{k} GROUP BY source),
fits_{k} AS MATERIALIZED (
  SELECT u.*, u.size <= u.rest AND (e.edge IS NULL OR u.place < e.edge) AS taken FROM upto_{k} u JOIN edge_{k} e ON u.source IS NOT DISTINCT FROM e.source),
left_{k} AS (SELECT source, any_value(rest) - coalesce(sum(size) FILTER (WHERE taken), 0) AS rest FROM fits_{k} GROUP BY source),
open_{next} AS MATERIALIZED (
  SELECT f.doc_id, f.source, f.size, f.h, f.place, l.rest FROM fits_{k} f JOIN left_{k} l ON f.source IS NOT DISTINCT FROM l.source WHERE NOT f.taken),"""
ORACLE = SQL.replace("{rounds}", "".join(ROUND.replace("{k}", str(k)).replace("{next}", str(k + 1)) for k in range(ROUNDS))).replace("{last}", str(ROUNDS))
