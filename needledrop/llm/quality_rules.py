"""Quality rules: fixed limits, then robust multivariate outliers by minimum covariance determinant.

Everything is DataFrame expressions. A document's statistics come from its row alone: words, lines and three-word windows
are hashed to 64 bits inside the row, and repeated windows are found by sorting them there, so no word is ever shuffled.

Each (lang, source) with at least ``LEAST`` usable documents has its own estimate; a smaller one takes its language's, and
a smaller language takes that of all documents. An estimate starts from medians and median deviations, keeps the half of
the documents nearest to its centre, takes their mean and covariance, measures Mahalanobis distances from those, and
repeats (concentration steps) until the covariance's determinant stops falling. Documents that tie at the edge of the half
stay out, so a block of copies can't enter there. Groups are only ever aggregated (sums, covariances, quantile sketches),
so their size doesn't matter.

A group's own distances say where its cut lies: the median of their logarithms and ``MULTIPLE`` deviations, the deviation
from the quartile above. Both are taken of the documents inside the cut, starting from a cut that the nearest third alone
gives, until the cut stays. On chi-squared distances that is close to the 0.999 quantile, which is the least cut, so clean
statistics with longer tails get a wider one. A document beyond the cut goes, as does one that fails the fixed limits.

Defined results: a null or empty text has no words and fails; null languages and sources are values of their own; a
document is judged by its own row, so repeated rows get the same verdict; the documents that fail the fixed limits have
no part in the estimates; columns besides text, lang and source play no part, whatever their names (``filtered`` carries them
along); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import WORD, few, written

SYMBOLS = "#*$%&|<>"
#: Documents that a group needs for an estimate of its own; the share of it that an estimate rests on.
LEAST, SHARE = 200, 0.5
#: If the distances from this quantile to the edge are all equal, what ties at the edge is most of the half, and stays in.
TIED = 0.1
#: The fall of the logarithm of the covariance's determinant below which a group's steps end.
FALL = 0.01
#: The statistics of the vector, each with the least standard deviation that a group is given: small enough that the worst
#: value of one statistic that the fixed limits allow lies beyond the cut by itself.
FLOORS = {"symbols": 0.25, "capitals": 0.1, "marks": 0.25, "word_length": 0.03, "repeats": 0.05, "lines": 0.1}
#: Median and 0.999 quantile of a chi-squared variable with as many degrees of freedom.
CHI2_MEDIAN, CHI2_FAR = 5.3481, 22.4577
#: Deviations of the log distances from their median to the cut; how often a cut is taken anew at most.
MULTIPLE, CUTS = 2.5, 10
#: Added to squared distances before their logarithm is taken.
LITTLE = 1e-3
#: Accuracy of the quantile sketches: an error of 1/2,000 of the rows.
ACCURACY = 2000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(windows: Column) -> Column:
    """Words that lie in windows found twice or more, from the hashes of a text's three-word windows in order."""

    def covered(at: Column) -> Column:
        begin = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, begin, step, lambda a: a["n"])

    def by_value(g: Column, twice: Column) -> Column:
        flagged = F.transform(g, lambda x, i: F.when(F.array_contains(twice, x), i))
        return covered(F.filter(flagged, lambda i: i.isNotNull()))

    def by_sort(g: Column) -> Column:
        def of(pairs: Column) -> Column:
            same = lambda p, i: (p["g"] == F.get(pairs, i - 1)["g"]) | (p["g"] == F.get(pairs, i + 1)["g"])
            return covered(F.sort_array(F.transform(F.filter(pairs, lambda p, i: F.coalesce(same(p, i), F.lit(False))), lambda p: p["i"])))

        return let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), of)

    def of(g: Column) -> Column:
        def twice(s: Column) -> Column:
            return F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i - 1), F.lit(False))))

        few_values = lambda t: F.when(F.size(t) <= 16, by_value(g, t)).otherwise(by_sort(g))
        found = let(F.sort_array(g), lambda s: let(twice(s), few_values))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(found)

    return let(windows, of)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_marks and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of_words(words: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            n = F.size(h)
            windows = F.transform(F.slice(h, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
            return F.struct(n.cast("long").alias("n_words"), repeat_words(windows).cast("long").alias("n_repeat_words"))

        return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)

    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    distinct = let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: F.size(h) - F.size(F.array_distinct(h)))
    without = lambda chars: F.length(F.translate(t, chars, ""))
    bare = F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")
    return (
        df.withColumn("_words", of_words(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))))
        .withColumns(
            {
                "n_words": F.col("_words.n_words"),
                "word_chars": F.length(bare).cast("long"),
                "n_symbols": (F.length(t) - without(SYMBOLS)).cast("long"),
                "n_lines": F.size(lines).cast("long"),
                "n_dup_lines": distinct.cast("long"),
                "n_repeat_words": F.col("_words.n_repeat_words"),
                "n_capitals": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long"),
                "n_marks": (F.length(t) - without("!?")).cast("long"),
            }
        )
        .drop("_words")
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def vector() -> dict[str, Column]:
    """The transformed statistics: logarithms of rates, with a constant that makes low rates alike whatever the length.

    What repeats within a text is a plain share: a little of it is common, and most of a text is far from that.
    """
    rate = lambda n, of, least: F.log(F.col(n) / (F.col(of) + 1.0) + least)
    return {
        "symbols": rate("n_symbols", "word_chars", 0.003),
        "capitals": rate("n_capitals", "word_chars", 0.01),
        "marks": rate("n_marks", "word_chars", 0.003),
        "word_length": F.log((F.col("word_chars") + 1.0) / (F.col("n_words") + 1.0)),
        "repeats": F.col("n_repeat_words") / (F.col("n_words") + 1.0),
        "lines": F.col("n_dup_lines") / (F.col("n_lines") + 1.0),
    }


def grouped(stats: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, int]:
    """(lang, source, level) for each pair, rows (lang, source, level, vector) by the groups they take part in, and how many pairs.

    Level 0 is the pair itself, 1 its language, 2 all documents. In the rows, what a level doesn't tell apart is null.
    """
    usable = stats.where("not base_failed")
    pairs = stats.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    by_lang = pairs.groupBy("lang").agg(F.sum("n").alias("n_lang")).withColumnRenamed("lang", "l")
    level = F.when(F.col("n") >= least, 0).when(F.col("n_lang") >= least, 1).otherwise(2)
    pairs = pairs.join(by_lang, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "source", level.alias("level"))
    pairs = written(pairs, "quality-pairs")
    n = pairs.count()
    rows = usable.select("lang", "source", *FLOORS)
    used = {r[0] for r in pairs.select("level").distinct().collect()}  # three values at most
    parts = []
    if 0 in used:
        own = few(pairs.where("level = 0").toDF("l", "s", "level"), n)
        parts.append(rows.join(own, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s"))
    if 1 in used:
        own = few(pairs.where("level = 1").select(F.col("lang").alias("l"), "level").distinct(), n)
        parts.append(rows.join(own, F.col("lang").eqNullSafe(F.col("l"))).drop("l").withColumn("source", F.lit(None).cast("string")))
    if 2 in used:
        none = F.lit(None).cast("string")
        parts.append(rows.withColumns({"lang": none, "source": none, "level": F.lit(2)}))
    members = parts[0] if parts else rows.withColumn("level", F.lit(0))
    for p in parts[1:]:
        members = members.unionByName(p)
    return pairs, members, n


def distance(centre: dict[str, Column], covariance: dict[tuple[int, int], Column], x: list[Column]) -> Column:
    """Squared Mahalanobis distance of ``x``, by the covariance's Cholesky factor."""
    p, low, names = len(x), {}, list(FLOORS)
    for i in range(p):
        for j in range(i + 1):
            low[i, j] = (i, j)
    out = F.lit(0.0)
    y: list[Column] = []
    for i in range(p):
        value = x[i] - centre[names[i]]
        for j in range(i):
            value = value - covariance[i, j] * y[j]
        y.append(value / covariance[i, i])
        out = out + y[i] * y[i]
    return out


def factor(fit: DataFrame) -> DataFrame:
    """(lang, source, level, m_*, l_i_j): each group's centre and the Cholesky factor of its covariance, floors added."""
    names, p = list(FLOORS), len(FLOORS)
    for j in range(p):
        s = F.col(f"c_{j}_{j}") + FLOORS[names[j]] ** 2
        for k in range(j):
            s = s - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        fit = fit.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(s, F.lit(1e-9))))
        below = {}
        for i in range(j + 1, p):
            s = F.col(f"c_{i}_{j}")
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            below[f"l_{i}_{j}"] = s / F.col(f"l_{j}_{j}")
        if below:
            fit = fit.withColumns(below)
    return fit.drop(*(f"c_{i}_{j}" for i in range(p) for j in range(i + 1)))


def squared(names: list[str]) -> Column:
    p = len(names)
    return distance({n: F.col(f"m_{n}") for n in names}, {(i, j): F.col(f"l_{i}_{j}") for i in range(p) for j in range(i + 1)}, [F.col(n) for n in names])


KEY = ("lang", "source", "level")


def beside(rows: DataFrame, groups: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group."""
    other = few(groups.withColumnsRenamed({k: f"_{k}" for k in KEY}), n)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    return rows.join(other, same[0] & same[1] & same[2], how).drop(*(f"_{k}" for k in KEY))


def quantile(c: str | Column, q: float) -> Column:
    return F.percentile_approx(c, F.lit(q), F.lit(ACCURACY))


def concentrated(members: DataFrame, n: int) -> DataFrame:
    """(lang, source, level, m_*, l_i_j): each group's minimum-covariance-determinant estimate.

    Only groups whose determinant fell in the last step take another one. The floors bound it from below, so all come to an end.
    """
    names = list(FLOORS)
    medians = written(members.groupBy(*KEY).agg(*(quantile(x, 0.5).alias(f"m_{x}") for x in names)), "quality-medians")
    near = beside(members, medians, n)
    spread = near.groupBy(*KEY).agg(*(F.first(f"m_{x}").alias(f"m_{x}") for x in names), *(quantile(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5).alias(f"c_{x}") for x in names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    first = spread.select(*KEY, *(f"m_{x}" for x in names), *((F.pow(1.4826 * F.col(f"c_{names[i]}"), 2) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in pairs))
    never = F.lit(float("inf"))
    fit = written(factor(first).withColumns({"det": never, "fell": F.lit(True)}), "quality-fit")
    own = [c for c in fit.columns if c not in (*KEY, "fell")]
    while True:
        far = beside(members, fit.where("fell"), n).withColumn("d", squared(names)).select(*KEY, *names, "d")
        edge = far.groupBy(*KEY).agg(quantile("d", SHARE).alias("edge"), quantile("d", TIED).alias("low"))
        inside = beside(far, edge, n).where("d < edge or low = edge")
        moments = inside.groupBy(*KEY).agg(*(F.avg(x).alias(f"m_{x}") for x in names), *(F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs))
        det = sum((F.log(f"l_{i}_{i}") for i in range(len(names))), F.lit(0.0)) * 2
        step = factor(moments).withColumn("det", det).withColumnsRenamed({c: f"new_{c}" for c in own})
        both = beside(fit.drop("fell"), step, n, "left").withColumn("fell", F.coalesce(F.col("new_det") < F.col("det") - FALL, F.lit(False)))
        fit = written(both.select(*KEY, *(F.when(F.col("fell"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in own), "fell"), "quality-fit")
        if fit.where("fell").isEmpty():
            break
    fit = fit.drop("det", "fell")
    return fit


def cut(middle: Column, deviation: Column) -> Column:
    """The log distance of the cut from the median and the deviation of log distances."""
    least = F.log(F.lit(CHI2_FAR)) + F.greatest(F.lit(0.0), middle - F.log(F.lit(CHI2_MEDIAN)))
    return F.greatest(middle + MULTIPLE * deviation, least)


def cuts(far: DataFrame, n: int) -> DataFrame:
    """(lang, source, level, cut) from the members' log distances ``far`` (lang, source, level, u)."""
    start = far.groupBy(*KEY).agg(quantile("u", 1 / 6).alias("low"), quantile("u", 1 / 3).alias("high"))
    found = written(start.select(*KEY, cut(F.col("high"), (F.col("high") - F.col("low")) / 0.5367).alias("cut")), "quality-cuts")
    for _ in range(CUTS):
        inside = beside(far, found, n).where("u <= cut").groupBy(*KEY)
        middle = inside.agg(quantile("u", 0.5).alias("middle"), quantile("u", 0.75).alias("upper"), F.first("cut").alias("was"))
        at = cut(F.col("middle"), (F.col("upper") - F.col("middle")) / 0.6745)
        after = written(middle.select(*KEY, at.alias("cut"), "was"), "quality-cuts")
        found = after.drop("was")
        if after.where("abs(cut - was) > 0.01").isEmpty():
            break
    return found


def estimates(members: DataFrame, n: int) -> DataFrame:
    """(lang, source, level, m_*, l_i_j, cut): each group's estimate and the log distance from which its documents go."""
    fit = concentrated(members, n)
    far = written(beside(members, fit, n).select(*KEY, F.log(squared(list(FLOORS)) + LITTLE).alias("u")), "quality-distances")
    return written(beside(fit, cuts(far, n), n), "quality-estimates")


def judged(df: DataFrame, carry: list[str]) -> DataFrame:
    """(row, the statistics, base_failed, distance, kept) of every row; ``row`` holds its columns ``carry``.

    ``distance`` is null where there is no estimate.
    """
    own_columns = df.select(F.struct(*carry).alias("row"), "lang", "source", "text")
    stats = written(statistics(own_columns).drop("text").withColumns(vector()), "quality-stats")
    pairs, members, n = grouped(stats)
    fits = estimates(written(members, "quality-members"), n)
    # an estimate for every pair, at its level
    none = F.lit(None).cast("string")
    of_pair = pairs.select(
        F.col("lang").alias("of_lang"),
        F.col("source").alias("of_source"),
        F.when(F.col("level") < 2, F.col("lang")).otherwise(none).alias("lang"),
        F.when(F.col("level") < 1, F.col("source")).otherwise(none).alias("source"),
        "level",
    )
    own = few(beside(of_pair, fits, n).drop(*KEY), n)
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    out = stats.join(own, same, "left").withColumn("distance", squared(list(FLOORS)))
    kept = ~F.col("base_failed") & ~F.coalesce(F.log(F.col("distance") + LITTLE) > F.col("cut"), F.lit(False))
    return out.withColumn("kept", kept).select(*stats.columns, "distance", "kept")


def filtered(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that are kept, with its columns."""
    return judged(df, df.columns).where("kept").select("row.*")
