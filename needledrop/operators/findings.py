"""The common shape of what detectors report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop import labels
from needledrop.functions import format as show
from needledrop.rules import Rules

SIGNALS = "array<struct<text: string, level: string>>"
ALTERNATIVES = "array<struct<value: string, reason: string, current: string, proposed: string, impact: bigint>>"
TARGETS = "array<struct<artist: string, track: string, album: string>>"
EVIDENCE = "array<struct<a: string, b: string>>"
#: The forms of a name that a finding is about.
VARIANTS = "array<struct<value: string, n: bigint, first: bigint, last: bigint, canonical: boolean>>"
#: What a finding touches: kind is artist, title, empty_album, track_album, album or run (from place a to place b); a, b, c are its values.
MARKS = "array<struct<kind: string, a: string, b: string, c: string>>"
#: Forms are joined for display by this.
JOINED = "  /  "


def quoted(c: Column) -> Column:
    return F.concat(F.lit("“"), c, F.lit("”"))


def number(c: Column) -> Column:
    return F.format_number(c, 0)


def plays(n: Column) -> Column:
    return F.concat(number(n), F.lit(" play(s)"))


def span(first: Column, last: Column) -> Column:
    """From the first day to the last, or that there is no date."""
    return F.when(first.isNull(), "no date").otherwise(F.concat(show.short_date(first), F.lit(" to "), show.short_date(last)))


def item(a: Column | str, b: Column) -> Column:
    """One row of evidence."""
    return F.struct((F.lit(a) if isinstance(a, str) else a).alias("a"), b.alias("b"))


def signal(level: str, *parts: Column | str) -> Column:
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.struct(text.alias("text"), F.lit(level).alias("level"))


def signals(*each: tuple[Column | bool, Column]) -> Column:
    """The signals whose condition holds."""
    made = [F.when(F.lit(c) if isinstance(c, bool) else c, s) for c, s in each]
    return F.filter(F.array(*made), lambda s: s.isNotNull())


def target(artist: Column, track: Column | None = None, album: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(artist.alias("artist"), (track if track is not None else none).alias("track"), (album if album is not None else none).alias("album"))


def mark(kind: str, a: Column, b: Column | None = None, c: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), a.alias("a"), (b if b is not None else none).alias("b"), (c if c is not None else none).alias("c"))


def rounded(points: Column) -> Column:
    """Points from 0 to 100, halves rounded up."""
    return F.least(F.greatest(F.floor(points + 0.5), F.lit(0)), F.lit(100)).cast("int")


def log_points(n: Column, times: float, most: float) -> Column:
    return F.least(F.lit(float(most)), F.log10(1 + n) * times)


def finding(
    df: DataFrame,
    detector: int,
    kind: str,
    subtype: Column | str,
    action: Column | str,
    title: Column,
    points: Column,
    impact: Column,
    current: Column,
    proposed: Column,
    seen: Column,
    signals: Column | None = None,
    alternatives: Column | None = None,
    targets: Column | None = None,
    evidence: Column | None = None,
    marks: Column | None = None,
    warning: Column | None = None,
    informational: bool = False,
    since: Column | None = None,
    explanation: Column | None = None,
    variants: Column | None = None,
    shown: int = 14,
    beyond: Column | None = None,
) -> DataFrame:
    """One finding for each row of ``df``. ``detector`` and ``seen`` order findings that are otherwise equal.

    Of the evidence, the first ``shown`` items are kept, and ``beyond`` counts those that are not.

    ``since`` is the time that tells a finding from others about the same targets.
    """
    column = lambda c: F.lit(c) if isinstance(c, str) else c
    array = lambda c, kind: (F.array() if c is None else c).cast(kind)
    return df.select(
        F.lit(detector).alias("detector"),
        F.lit(kind).alias("type"),
        column(subtype).alias("subtype"),
        title.alias("title"),
        rounded(points).alias("points"),
        impact.cast("bigint").alias("impact"),
        column(action).alias("action"),
        current.alias("current"),
        proposed.alias("proposed"),
        F.lit(informational).alias("informational"),
        F.coalesce(column("") if warning is None else warning, F.lit("")).alias("warning"),
        array(signals, SIGNALS).alias("signals"),
        array(alternatives, ALTERNATIVES).alias("alternatives"),
        array(targets, TARGETS).alias("targets"),
        F.slice(array(evidence, EVIDENCE), 1, shown).alias("evidence"),
        (F.greatest(F.size(array(evidence, EVIDENCE)) - shown, F.lit(0)) if beyond is None else beyond).cast("bigint").alias("beyond"),
        F.coalesce(column("") if explanation is None else explanation, F.lit("")).alias("explanation"),
        array(variants, VARIANTS).alias("variants"),
        array(marks, MARKS).alias("marks"),
        seen.cast("bigint").alias("seen"),
        (F.lit(None) if since is None else since).cast("bigint").alias("since"),
    )


#: What separates the parts of a content key, and how many digits of the digest are used.
PART, DIGITS = "\x1f", 16


def content_key(f: DataFrame) -> DataFrame:
    """``f`` with ``key``: a digest of what a finding is about (type, sub-case, targets, proposal, time), wherever it stands."""
    none = F.lit("")
    one = lambda t: F.concat_ws(PART, *(F.coalesce(t[c], none) for c in ("artist", "track", "album")))
    parts = F.concat_ws(PART, "type", "subtype", "proposed", F.coalesce(F.col("since").cast("string"), none), F.array_join(F.transform("targets", one), PART))
    return f.withColumn("key", F.substring(F.sha2(parts.cast("binary"), 256), 1, DIGITS))


def confidence(points: Column, rules: Rules) -> Column:
    return F.when(points >= rules.high_threshold, "high").when(points >= rules.medium_threshold, "medium").otherwise("low")


def actionable(action: Column) -> Column:
    return ~action.isin(*labels.ADVISORY)


def canonical_score(value: Column, n: Column, last: Column, newest: Column, oldest: Column) -> Column:
    """Up to 2 for recency within the group, 1.5 for frequency, 0.5 for a complete name."""
    span = newest - oldest
    recent = F.when(last.isNull(), 0.0).when(span > 0, 2 * (1 - (newest - last) / span)).otherwise(2.0)
    return recent + F.least(F.lit(1.0), F.log10(1 + n) / 2) * 1.5 + F.least(F.lit(1.0), F.length(value) / 24) * 0.5


def preference(rules: Rules, value: Column, n: Column, last: Column, newest: Column, oldest: Column) -> Column:
    """The larger, the likelier a form is the right one, by the rule in force."""
    if rules.canonical == "recent":
        return F.coalesce(last, F.lit(0)).cast("double")
    if rules.canonical == "frequent":
        return n.cast("double")
    return canonical_score(value, n, last, newest, oldest)
