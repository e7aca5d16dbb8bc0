"""Personal data: expressions propose spans, checksums confirm them, and context words around a span adjust its score.

Only DataFrame expressions. A kind's matches and the gaps between them come from splitting a text by the kind's expression;
their lengths give the spans, so a text is never cut by position. The expressions are written with possessive repeats and
look-behinds that start a match only where a run of its characters starts (or where the last match ended), which changes no
match but keeps the search linear in very long words and digit runs. Places are running sums, taken within chunks of
``CHUNK`` matches and over the chunks, so that a text with very many matches costs little more than its length.

The base kinds (email, ip, card, phone) are always returned once their checks pass; further kinds only from a score of
``LEAST`` on. Context is the last ``NEAR`` characters outside of the kind's matches before a span, and for the further kinds
also those after it; the nearest ``NEAR`` gaps are looked at. So a word counts for each number of a list. Account numbers may
be in groups of four; of a grouped match, the longest leading part that passes mod 97 is the span. ``ORACLE`` is DuckDB SQL
for the same rows. Defined results: a null or empty text has no spans; offsets are code points, end exclusive; matches of a
kind don't overlap, and one that fails its check is dropped without another try; spans of different kinds may. Each row is
judged by its own text alone: repeated rows repeat their result, other columns play no part, whatever their names, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, NEAR, CHUNK = 0.6, 40, 256


@dataclass(frozen=True)
class Kind:
    name: str
    #: The expression for Spark, and the plain one that finds the same matches.
    pattern: str
    plain: str
    check: Callable[[Column], Column]
    #: The score of a span, without and with one of the context words (an expression on lower-case text) before it.
    score: float
    in_context: float
    words: str
    base: bool = True
    #: A text without this has no match.
    needs: str = ""
    #: The part of a match, from its start, that is the span (null: none); the whole match if not given.
    part: Callable[[Column], Column] | None = None


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def ip_check(x: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})"
    return x.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def card_check(x: Column) -> Column:
    return F.length(digits(x)).between(16, 19) & F.call_function("luhn_check", digits(x))


def mod97(x: Column) -> Column:
    """The remainder of an account number: its first four characters moved to the end, letters as 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(F.concat(F.substr(x, F.lit(5)), F.substring(x, 1, 4)), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def account(x: Column) -> Column:
    return F.length(x).between(15, 34) & (mod97(x) == 1)


def account_part(x: Column) -> Column:
    """The longest run of groups from the start that is an account number: an upper-case word may follow it."""

    def longest(groups: Column) -> Column:
        up_to = F.transform(F.sequence(F.lit(1), F.least(F.size(groups), F.lit(9))), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
        return F.get(F.reverse(F.filter(up_to, lambda p: account(F.replace(p, F.lit(" "), F.lit(""))))), F.lit(0))

    return F.when(x.contains(" "), longest(F.split(x, " "))).when(account(x), x)


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        lambda x: F.lit(True),
        0.8,
        0.95,
        "mail|contact|write",
        needs="@",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        ip_check,
        0.6,
        0.9,
        r"\bip\b|address|host|server",
        needs=".",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20-]?[0-9])+",
        card_check,
        0.8,
        0.95,
        "card|visa|credit|pay",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda x: F.length(digits(x)).between(8, 15),
        0.6,
        0.9,
        "phone|call|tel|fax|mobile",
        needs="+",
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]++|(?:\x20[A-Z0-9]{4}(?![A-Za-z0-9_]))++(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9_]))?+)",
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]+|(?:\x20[A-Z0-9]{4}\b)+(?:\x20[A-Z0-9]{1,3}\b)?)",
        lambda x: account_part(x).isNotNull(),
        0.8,
        0.95,
        "iban|account|bank",
        base=False,
        part=account_part,
    ),
    Kind(
        "ssn",
        r"(?:\G|(?<![0-9]))[0-9]++-[0-9]++-[0-9]++",
        r"[0-9]+-[0-9]+-[0-9]+",
        lambda x: x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~x.rlike("^(?:000|666|9)|-00-|-0000$"),
        0.3,
        0.8,
        "ssn|social|security",
        base=False,
        needs="-",
    ),
)
SPAN = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(steps: Column, begin: Column) -> Column:
    """``begin`` plus the sum of all steps before each step; meant for short arrays, since it is copied as it grows."""
    start = F.struct(begin.alias("at"), F.array().cast("array<bigint>").alias("before"))
    grown = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["before"], s["at"]).alias("before"))
    return F.aggregate(steps, start, grown, lambda s: s["before"])


def before(gaps: Column, i: Column) -> Column:
    """The last ``NEAR`` characters of the gaps up to the ``i``th (from 0), as far as ``NEAR`` gaps hold them."""
    own = F.get(gaps, i)
    last = F.right(F.array_join(F.slice(gaps, F.greatest(i + 2 - NEAR, F.lit(1)), F.least(i + 1, F.lit(NEAR))), ""), F.lit(NEAR))
    return F.when(F.length(own) >= NEAR, F.right(own, F.lit(NEAR))).otherwise(last)


def after(gaps: Column, i: Column) -> Column:
    """The next ``NEAR`` characters of the gaps after the ``i``th, a space between them."""
    own = F.get(gaps, i + 1)
    following = F.left(F.array_join(F.slice(gaps, i + 2, F.lit(NEAR)), " "), F.lit(NEAR))
    return F.when(F.length(own) >= NEAR, F.left(own, F.lit(NEAR))).otherwise(following)


def spans(text: Column, kind: Kind) -> Column:
    """The spans of one kind in a text that isn't null."""
    zero = F.lit(0).cast("bigint")
    length = lambda x: F.length(x).cast("bigint")

    def in_chunk(gaps: Column, lead: Column, matches: Column, starts: Column) -> Column:
        """The spans of some matches that begin at ``starts``; the gap before the first is the ``lead``th."""

        def span(m: Column, j: Column) -> Column:
            near = F.lower(before(gaps, lead + j)).rlike(kind.words)
            if not kind.base:
                near = near | F.lower(after(gaps, lead + j)).rlike(kind.words)
            score = F.when(near, kind.in_context).otherwise(kind.score)
            end = F.get(starts, j) + length(kind.part(m) if kind.part else m)
            return F.when(kind.check(m), F.struct(F.lit(kind.name).alias("kind"), F.get(starts, j).alias("start"), end.alias("end"), score.alias("score")))

        good = lambda s: s.isNotNull() if kind.base else s["score"] >= LEAST
        return F.filter(F.transform(matches, span), good)

    def of_chunk(gaps: Column, matches: Column, first: Column, begin: Column) -> Column:
        own = F.slice(matches, first + 1, F.lit(CHUNK))
        # a slice costs the length of what it is cut from, so context is looked up in the chunk's own gaps
        around = F.slice(gaps, F.greatest(first + 2 - NEAR, F.lit(1)), F.lit(CHUNK + 2 * NEAR))
        lead = F.least(first, F.lit(NEAR - 1))

        def use(m: Column, g: Column) -> Column:
            steps = F.transform(m, lambda x, j: length(x) + length(F.get(g, lead + j + 1)))
            return let(running(steps, begin + length(F.get(g, lead))), lambda starts: in_chunk(g, lead, m, starts))

        return let(own, lambda m: let(around, lambda g: use(m, g)))

    def found(gaps: Column, matches: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(matches) - 1, F.lit(CHUNK))
        total = lambda a, first: F.aggregate(F.slice(a, first + 1, F.lit(CHUNK)), zero, lambda s, x: s + F.length(x))
        begins = running(F.transform(firsts, lambda f: total(gaps, f) + total(matches, f)), zero)
        return F.flatten(F.zip_with(firsts, begins, lambda f, b: of_chunk(gaps, matches, f, b)))

    none = F.array().cast(SPAN)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    some = let(matches, lambda m: F.when(F.size(m) > 0, let(F.split(text, kind.pattern, -1), lambda g: found(g, m))).otherwise(none))
    return (F.when(text.contains(kind.needs), some).otherwise(none) if kind.needs else some).cast(SPAN)


def find(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans array<struct<kind, start, end, score>>) of every row: by kind as listed, then start."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key), F.concat(*(spans(t, k) for k in KINDS)).alias("spans"))


def digested(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from ``find``'s, and ``scores``: those of all spans, in the same order."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, shown), ",")
    base = [k.name for k in KINDS if k.base]
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long").alias(f"n_{n}")
    of_base = joined(F.filter("spans", lambda s: s["kind"].isin(base)))
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores")
    return found.select(key, *map(count, base), F.sha2(of_base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores)


def _sql() -> str:
    """The same rows in DuckDB SQL, by the plain expressions: (gap, match, text before and after) of each match, then checks."""
    part = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})"
    bare = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split({bare}, ''), lambda c, i: CASE WHEN (len({bare}) - i) % 2 = 0 THEN c::INTEGER ELSE (c::INTEGER * 2) // 10 + (c::INTEGER * 2) % 10 END)) % 10 = 0"
    values = lambda x: f"list_transform(string_split(substr({x}, 5) || left({x}, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END)"
    left_over = lambda x: f"list_reduce(list_prepend(0, {values(x)}), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END)"
    # how many leading groups of a match are an account number, at most
    groups = "array_to_string(string_split(m, ' ')[1:k], '')"
    account = f"list_max(list_filter(range(1, least(len(string_split(m, ' ')), 9) + 1), lambda k: CASE WHEN len({groups}) BETWEEN 15 AND 34 THEN {left_over(groups)} = 1 ELSE false END))"
    checks = {
        "email": "true",
        "ip": rf"regexp_full_match(m, '{part}\.{part}\.{part}\.{part}')",
        "card": f"CASE WHEN len({bare}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END",
        "phone": f"len({bare}) BETWEEN 8 AND 15",
        "iban": f"{account} IS NOT NULL",
        "ssn": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
    }
    each = []
    for n, k in enumerate(KINDS):
        p = "'" + k.plain.replace("'", "''") + "'"
        length = f"len(array_to_string(string_split(m, ' ')[1:{account}], ' '))" if k.part else "len(m)"
        near = f"regexp_matches(lower(right(array_to_string(gaps[greatest(1, i - {NEAR - 1}):i], ''), {NEAR})), '{k.words}')"
        if not k.base:
            near += f" OR regexp_matches(lower(left(array_to_string(gaps[i + 1:i + {NEAR}], ' '), {NEAR})), '{k.words}')"
        each.append(f"""
  SELECT doc_id, {n} AS place, '{k.name}' AS kind, start, start + {length} AS stop, CASE WHEN {near} THEN {k.in_context} ELSE {k.score} END AS score FROM (
    SELECT doc_id, gaps, matches[i] AS m, i,
           (list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda g: len(g))), 0))::BIGINT AS start
    FROM (SELECT doc_id, gaps, matches, unnest(range(1, len(matches) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS matches FROM texts)))
  WHERE {checks[k.name]}""")
    shown = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start)"
    base = [k for k in KINDS if k.base]
    counts = ", ".join(f"(count(*) FILTER (WHERE kind = '{k.name}'))::BIGINT AS n_{k.name}" for k in base)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, coalesce(text, '') AS t FROM documents),
spans AS (SELECT * FROM ({" UNION ALL ".join(each)}) WHERE place < {len(base)} OR score >= {LEAST})
SELECT any_value(d.id) AS doc_id, {counts}, sha256(coalesce({shown} FILTER (WHERE place < {len(base)}), '')) AS base_sha256, coalesce({shown}, '') AS spans,
       coalesce(string_agg(printf('%.2f', score::DOUBLE), ',' ORDER BY place, start), '') AS scores
FROM texts d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


ORACLE = _sql()
