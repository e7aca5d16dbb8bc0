"""Text functions as Column expressions: normal forms, comparison keys, title parts and name comparisons.

None of them is a Python function at run time, so they stay inside generated code (the ones over arrays: inside higher-order
functions). Where a text is missing they take it as empty.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are unified or dropped.
DASHES = "[\N{HYPHEN}-\N{HORIZONTAL BAR}\N{MINUS SIGN}]"
SPACES = "[\N{NO-BREAK SPACE}\N{OGHAM SPACE MARK}\N{EN QUAD}-\N{HAIR SPACE}\N{NARROW NO-BREAK SPACE}\N{MEDIUM MATHEMATICAL SPACE}\N{IDEOGRAPHIC SPACE}]"
INVISIBLE = "[\N{ZERO WIDTH SPACE}-\N{RIGHT-TO-LEFT MARK}\N{LINE SEPARATOR}\N{PARAGRAPH SEPARATOR}\N{ZERO WIDTH NO-BREAK SPACE}\N{REPLACEMENT CHARACTER}]"
SINGLE_QUOTES = "‘’‛′ʹʻʼʽʾʿ`´"
DOUBLE_QUOTES = "“”″«»"
#: Words of a video page's badge; a badge has one of the first at least.
BADGE_CORE = "official oficial audio video lyric lyrics letra letras visual visuals visualizer visualiser mv hd hq 4k 8k".split()
BADGE_MORE = "clip music full".split()
#: Words that mark another recording.
VERSIONS = (
    "live|en vivo|directo|acoustic|acustico|acustica|remix|remaster|remastered|remasterizado|instrumental|karaoke|cover|version|"
    "edicion|edit|extended|reprise|demo|mono|stereo|radio edit|soundtrack|banda sonora|orchestral|orquesta|esc version|"
    "eurovision|junior|dancebreak|spanglish|spanish|english|italiano"
)
#: Separators between artists, leading articles, featuring words, roman numerals to twenty.
SEPARATORS = r"(?i),|;|\s+&\s+|\s+y\s+|\s+vs\.?\s+|\s+feat\.?\s+|\s+featuring\s+|\s+with\s+|\s+\|\s+"
ARTICLES, FEATURING = "the|los|las|el|la|le|les|il|lo", "feat|featuring|ft|con"
ROMAN = "i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii|xiii|xiv|xv|xvi|xvii|xviii|xix|xx"
#: A word boundary between ASCII word characters only.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
BRACKETS, TAIL = r"[(\[{]([^)\]}]*)[)\]}]", r"\s+-\s+(.{2,})$"


#: The jamo that Hangul syllables are made of: leads, vowels, and tails (which a syllable may lack).
HANGUL = 0xAC00
LEADS, VOWELS, TAILS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """What is left of characters of all planes when they are decomposed and the marks from U+0300 to U+036F are dropped.

    Characters that become one other; those; and what the rest become, Hangul syllables aside, which are arithmetic.
    """
    marks, one, several = [chr(c) for c in range(0x300, 0x370)], [], {}
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xE000, 0x110000)]):
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if x not in marks)
            if bare != c and len(bare) == 1:
                one.append((c, bare))
            elif len(bare) > 1:
                several[c] = bare
    return "".join(a for a, _ in one) + "".join(marks), "".join(b for _, b in one), several


ACCENTED, BARE, SEVERAL = _decompositions()


def _replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def _decomposed(ch: Column) -> Column:
    """What one character that becomes several, or a Hangul syllable, becomes; any other one stays."""
    known = F.map_from_arrays(F.split(F.lit("|".join(SEVERAL)), r"\|"), F.split(F.lit("|".join(SEVERAL.values())), r"\|"))  # folded to a constant
    code = F.ascii(ch) - HANGUL
    pick = lambda letters, at: F.substr(F.lit(letters), (F.floor(at) + 1).cast("int"), F.lit(1))
    tail = F.when(code % 28 > 0, pick(TAILS, code % 28 - 1)).otherwise("")
    syllable = F.concat(pick(LEADS, code / 588), pick(VOWELS, code % 588 / 28), tail)
    return F.when(ch.rlike("^[\uac00-\ud7a3]$"), syllable).otherwise(F.coalesce(F.element_at(known, ch), ch))


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without the marks from U+0300 to U+036F; marks of other scripts stay, in the order they come in."""
    split = F.array_join(F.transform(F.split(c, ""), _decomposed), "")
    whole = F.when(c.rlike(f"[\uac00-\ud7a3{''.join(SEVERAL)}]"), split).otherwise(c)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(whole, ACCENTED, BARE))


def normalise(c: Column) -> Column:
    """Dashes and spaces unified, invisible characters dropped, runs of white space collapsed; null becomes empty."""
    steps = [(DASHES, "-"), (SPACES, " "), (INVISIBLE, ""), (r"\s+", " ")]
    return F.trim(reduce(lambda x, step: _replace(x, *step), steps, F.coalesce(c, F.lit(""))))


def fold_quotes(c: Column) -> Column:
    return F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def folded(c: Column) -> Column:
    """The comparison key of a text in normal form, or of a piece of one."""
    lowered = F.translate(F.lower(strip_accents(c)), SINGLE_QUOTES, " " * len(SINGLE_QUOTES))
    return F.trim(_replace(lowered, r"[^\p{L}\p{N}]+", " "))


def key(c: Column) -> Column:
    """The comparison key: no accents, lower case, letters and digits with single spaces."""
    return folded(normalise(c))


def strip_featuring(c: Column) -> Column:
    return F.trim(_replace(_replace(c, rf"{BEFORE}(?:{FEATURING}){AFTER}\.?", " "), r"\s+", " "))


def title_base(c: Column) -> Column:
    """A title without bracketed parts and without what follows the first spaced dash."""
    flat = _replace(normalise(c), BRACKETS, " ")
    tail = key(F.regexp_extract(flat, TAIL, 1))
    return F.trim(_replace(F.when(tail == "", flat).otherwise(F.regexp_replace(flat, TAIL, "")), r"\s+", " "))


def qualifiers(c: Column) -> Column:
    """The keys of a title's bracketed parts, then that of what follows the first spaced dash."""
    flat = _replace(normalise(c), BRACKETS, " ")
    inner = F.regexp_extract_all(normalise(c), F.lit(BRACKETS), F.lit(1))
    return F.filter(F.concat(F.transform(inner, key), F.array(key(F.regexp_extract(flat, TAIL, 1)))), lambda q: q != "")


def loose_key(c: Column) -> Column:
    """The key of a title without qualifiers and featuring credit; that of the whole title if nothing is left."""
    loose = key(strip_featuring(title_base(c)))
    return F.when(loose == "", key(c)).otherwise(loose)


def with_track_key(df: DataFrame, title: str = "title", name: str = "track_key") -> DataFrame:
    """``df`` with the loose key of a title, as ``loose_key`` has it, computed in steps that share their results.

    Every step is a projection of its own, so that no expression is evaluated twice for a row; this is for tables of plays.
    """
    own = df.withColumn("_n", normalise(F.col(title))).withColumn("_flat", _replace(F.col("_n"), BRACKETS, " "))
    own = own.withColumn("_tail", F.regexp_extract("_flat", TAIL, 1))
    plain = (F.col("_tail") == "") | (folded(F.col("_tail")) == "")
    own = own.withColumn("_base", F.when(plain, F.col("_flat")).otherwise(_replace(F.col("_flat"), TAIL)))
    own = own.withColumn("_loose", folded(strip_featuring(_replace(F.trim("_base"), r"\s+", " "))))
    loose = F.when(F.col("_loose") == "", folded(F.col("_n"))).otherwise(F.col("_loose"))
    return own.withColumn(name, loose).drop("_n", "_flat", "_tail", "_base", "_loose")


def is_badge(q: Column) -> Column:
    """Whether a qualifier's key is nothing but a video page's badge."""
    core, words = "|".join(BADGE_CORE), "|".join(BADGE_CORE + BADGE_MORE)
    return q.rlike(rf"^(?:{words})(?: (?:{words}))*$") & q.rlike(rf"(?:^| )(?:{core})(?: |$)")


def strip_badges(c: Column) -> Column:
    """A title without the bracketed parts and the dash tail that are badges."""
    pattern, title = r"[(\[]([^)\]]*)[)\]]", normalise(c)
    gaps, inner = F.split(title, pattern, -1), F.regexp_extract_all(title, F.lit(pattern), F.lit(0))
    kept = lambda g, b: F.concat(g, F.when(b.isNull(), "").when(is_badge(key(b)), " ").otherwise(b))
    flat = F.array_join(F.zip_with(gaps, inner, kept), "")
    cut = F.when(is_badge(key(F.regexp_extract(flat, TAIL, 1))), F.regexp_replace(flat, TAIL, "")).otherwise(flat)
    return normalise(cut)


def marks_version(k: Column) -> Column:
    """Whether a title's key names another recording (live, remix ...)."""
    return k.rlike(rf"{BEFORE}(?:{VERSIONS}){AFTER}")


def artist_key(c: Column) -> Column:
    k = _replace(key(strip_featuring(_replace(normalise(c), r"[(\[{][^)\]}]*[)\]}]", " "))), rf"^(?:{ARTICLES})\s+", "")
    return F.when(k == "", key(c)).otherwise(k)


def split_artist(c: Column) -> Column:
    """The artists that a name joins; an empty array if it looks like one."""
    bare = lambda p: F.trim(_replace(_replace(p, r"^[\s\-]+|[\s\-]+$"), r"^[(\[{]|[)\]}]$"))
    parts = F.filter(F.transform(F.split(normalise(c), SEPARATORS, -1), bare), lambda p: key(p) != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def separator(c: Column) -> Column:
    """What a joined name shows between its artists: a comma, an ampersand, or some other sign ("several")."""
    return F.when(c.contains(","), ",").when(c.rlike(r"\s&\s"), "&").otherwise("several")


def words(k: Column) -> Column:
    return F.filter(F.split(k, " "), lambda w: F.length(w) >= 2)


def contains_words(haystack: Column, needle: Column) -> Column:
    """Whether a key contains another, word for word, and isn't equal to it."""
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (needle != "") & (haystack != needle) & padded(haystack).contains(padded(needle))


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, or ``most`` + 1 beyond ``most``."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def abbreviation(a: Column, b: Column, least: int, extension: int) -> Column:
    """struct(short, long) if two keys differ in one word only, of which one is the beginning of the other; else null."""
    pairs = F.filter(F.arrays_zip(F.split(a, " ").alias("x"), F.split(b, " ").alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"]))
    one = F.get(pairs, F.lit(0))
    swap = F.length(one["x"]) <= F.length(one["y"])
    short, long = F.when(swap, one["x"]).otherwise(one["y"]), F.when(swap, one["y"]).otherwise(one["x"])
    fits = (F.size(F.split(a, " ")) == F.size(F.split(b, " "))) & (F.size(pairs) == 1) & (F.length(short) >= least)
    fits = fits & long.startswith(short) & (F.length(long) - F.length(short) >= extension)
    return F.when(fits, F.struct(short.alias("short"), long.alias("long")))


def without_ordinals(k: Column) -> Column:
    """A key without digits and roman numerals."""
    kept = F.filter(F.split(_replace(k, "[0-9]+", " "), " "), lambda w: (w != "") & ~w.rlike(f"^(?:{ROMAN})$"))
    return F.array_join(kept, " ")


def after_artist(artist: Column, title: Column) -> Column:
    """What follows the artist and a dash or colon in a title that repeats the artist; null otherwise."""
    own, whole = artist_key(artist), normalise(title)
    rest = F.substr(whole, F.length(artist) + 1)
    found = (F.length(own) >= 3) & key(title).startswith(F.concat(own, F.lit(" "))) & rest.rlike(r"^\s*[-–—:]\s*\S")
    left = normalise(_replace(rest, r"^\s*[-–—:]\s*", ""))
    return F.when(found & (left != ""), left)
