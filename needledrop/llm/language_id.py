"""Language identification of web pages by Bayesian evidence fusion.

Three kinds of evidence are added as logarithms, each page for itself:

* the text's likelihood under letter trigrams of each language, tempered because trigrams overlap;
* the declared markup language, with likelihoods P(declared | language) from grouped sums over all pages;
* a prior by host: grouped sums of the texts' own posteriors by host, without the page's own part, smoothed by those of its
  address suffix, and these by those of all pages, in proportion to ``STRENGTH``.

The trigram model is fitted on at most ``MOST_ROWS`` rows with a known language, chosen by a hash of the id; the sums for
hosts, suffixes and declared languages cover all pages. Hosts are only aggregated and joined, so a hot one can be split.
A page is read by one forward scan that remembers which closing tags no longer follow, so odd markup can't make it slow.

Defined results: a null or empty page has no text evidence and takes its prior's language; a missing declaration is no
evidence; a null or odd address has the empty host and suffix; a tie goes to the first language in code point order;
without labelled texts the language is null. Repeated pages, with the same id or not, are pages each: they count for their
host's prior and get a row each. A document id that repeats in the sample is learned from once for each language, by the text
with the least hash. Other columns play no part, whatever their names; an empty table of pages gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from needledrop.llm.common import few, map_rows, sampled, written

MOST_ROWS, GRAMS, CACHE_WORDS = 8_000, 1 << 14, 200_000
#: The weight of a trigram's evidence, and the pages that the level above counts for.
TEMPER, STRENGTH = 0.2, 5.0
#: Part of the declarations that are taken to be right before any is seen, and how many pages that belief counts for.
TRUST, TRUST_PAGES = 0.9, 10.0
WORD = re.compile(r"[^\W\d_]+")
#: Elements whose content isn't text, and those where it isn't if their class says so.
DROPPED, BOXES = {"script", "style", "nav", "footer", "aside", "noscript"}, {"div", "section", "ul"}
NAME, BOX_CLASS = re.compile(r"<([A-Za-z]+)\b"), re.compile(r"(?i)\bclass\s*=\s*[\"']?(?:ads?|menu|nav|footer|sidebar)\b")
CLOSING = {n: re.compile(rf"(?i)</{n}\s*>") for n in DROPPED | BOXES}
HTML, LANG = re.compile(r"(?i)<html\b"), re.compile(r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b")
#: Address suffixes that stand for a language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "it": "it", "nl": "nl", "pt": "pt", "pl": "pl"}


def visible(page: str | None) -> str:
    """The text of a page without comments, scripts, navigation, footers and tags, in one forward scan.

    An element or comment that is never closed loses only its tag; what no ``>`` follows is text.
    """
    page, at, out, unclosed = page or "", 0, [], set()
    while (tag := page.find("<", at)) >= 0:
        out += (page[at:tag], " ")
        if page.startswith("<!--", tag) and "!--" not in unclosed:
            at = page.find("-->", tag + 4) + 3
            if at > 2:
                continue
            unclosed.add("!--")
        end = page.find(">", tag) + 1
        if not end:
            at = tag
            break
        at, name = end, NAME.match(page, tag, end)
        kind = name[1].lower() if name else ""
        if kind not in unclosed and (kind in DROPPED or (kind in BOXES and BOX_CLASS.search(page, tag, end))):
            if close := CLOSING[kind].search(page, end):
                at = close.end()
            else:
                unclosed.add(kind)
    out.append(page[at:])
    return html.unescape("".join(out))


def declared_language(page: str | None) -> str | None:
    """The language that the first ``html`` tag with one declares."""
    page, at = page or "", 0
    while at >= 0 and (tag := HTML.search(page, at)):
        end = page.find(">", tag.end())
        if found := LANG.search(page, tag.end(), end if end >= 0 else len(page)):
            return found[1].lower()
        at = end
    return None


def grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + 3].encode()) % GRAMS for i in range(len(w) - 2)]


@dataclass
class Model:
    languages: list[str]
    #: [language, gram]: the logarithm of the gram's probability.
    logs: np.ndarray

    def reader(self) -> Callable[[str], np.ndarray]:
        """A function that gives the tempered log-likelihoods of a text by language, the best one 0.

        Words are looked up once for each task; a text is one product of its words' counts and their rows.
        """
        n, known, table = len(self.languages), {}, np.zeros((1024, len(self.languages)))

        def evidence(text: str) -> np.ndarray:
            nonlocal table
            counts = Counter(WORD.findall(text.lower()))
            if not (n and counts):
                return np.zeros(n)
            if len(known) >= CACHE_WORDS:
                known.clear()
            for word in counts:
                if word not in known:
                    if len(known) == len(table):
                        table = np.concatenate((table, np.zeros_like(table)))
                    table[len(known)] = self.logs[:, grams(word)].sum(axis=1)
                    known[word] = len(known)
            rows = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
            out = np.fromiter(counts.values(), np.float64, len(counts)) @ table[rows]
            return TEMPER * (out - out.max())

        return evidence


def learn(docs: DataFrame, most: int = MOST_ROWS) -> Model:
    """Trigram counts by language, from at most ``most`` rows (doc_id, text, lang)."""
    ids = sampled(docs.where("lang is not null"), most, "doc_id", "lang")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("lang") == F.col("of_lang"))
    own = docs.select("doc_id", "lang", F.struct(F.xxhash64("text").alias("t"), "text").alias("own"))
    own = own.join(F.broadcast(ids.toDF("of_id", "of_lang")), same)  # at most ``most`` rows
    texts = own.groupBy("doc_id", "lang").agg(F.min("own").alias("own")).select("lang", "own.text")

    def counted(langs, texts):
        out = []
        for t in texts:
            c: Counter = Counter()
            for word, n in Counter(WORD.findall((t or "").lower())).items():
                for g in grams(word):
                    c[g] += n
            out.append([{"g": g, "n": n} for g, n in c.items()])
        return [langs, out]

    pair = StructType([StructField("g", IntegerType()), StructField("n", LongType())])
    schema = StructType([StructField("lang", StringType()), StructField("c", ArrayType(pair))])
    counts = map_rows(texts, lambda: counted, schema).select("lang", F.inline("c")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # at most GRAMS rows for each language of the sample
    languages = sorted(rows["lang"].unique())
    table = np.full((len(languages), GRAMS), 0.5)
    table[rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), rows["g"].to_numpy(int)] += rows["n"].to_numpy(float)
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def read(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, host, suffix, declared, e): what each page itself says; ``e`` holds the text's evidence by language."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)

    def make():
        evidence = model.reader()

        def rows(k, hosts, suffixes, pages):
            return [k, hosts, suffixes, [declared_language(p) for p in pages], [evidence(visible(p)).tolist() for p in pages]]

        return rows

    names = [StructField(n, StringType()) for n in ("host", "suffix", "declared")]
    schema = StructType([pages.schema["page_id"], *names, StructField("e", ArrayType(DoubleType()))])
    return map_rows(pages.select("page_id", host.alias("host"), suffix.alias("suffix"), "html"), make, schema)


def sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    """By ``key``: the pages and the sums of the texts' posteriors, as an array."""
    each = rows.groupBy(key).agg(F.count("*").alias("pages"), *(F.sum(F.col("p")[i]).alias(f"s_{i}") for i in range(n)))
    return each.select(key, "pages", F.array(*(f"s_{i}" for i in range(n))).alias("sums"))


def smoothed(pages: Column, own: Column, above: Column, strength: float = STRENGTH) -> Column:
    return F.zip_with(own, above, lambda s, a: (F.greatest(s, F.lit(0.0)) + strength * a) / (pages + strength))


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) of every row of ``pages``."""
    model = learn(docs)
    languages, n = model.languages, len(model.languages)
    if not n:
        none = F.lit(None)
        return pages.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("probability"), none.cast("string").alias("text_lang"), none.cast("string").alias("declared"), none.cast("string").alias("host"))
    scale = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))
    rows = read(pages, model).withColumn("w", F.transform("e", lambda x: F.exp(x)))
    rows = written(rows.withColumn("p", scale(F.col("w"))).drop("w"), "language-pages")

    names = F.array(*map(F.lit, languages))
    total, *everywhere = rows.agg(F.count("*"), *(F.sum(F.col("p")[i]) for i in range(n))).first()
    above = F.array(*(F.lit(((s or 0.0) + 1.0) / (total + n)) for s in everywhere))
    suffixes = sums(rows, "suffix", n)
    stands_for = F.try_element_at(F.create_map(*(F.lit(x) for p in SUFFIX_LANGUAGE.items() for x in p)), F.col("suffix"))
    hinted = F.zip_with(names, above, lambda name, a: F.when(stands_for == name, TRUST).when(stands_for.isNull() | ~F.array_contains(names, stands_for), a).otherwise((1 - TRUST) * a))
    suffixes = written(suffixes.select("suffix", smoothed(F.col("pages"), F.col("sums"), hinted).alias("by_suffix")), "language-suffixes")
    n_suffixes = suffixes.count()
    hosts = written(sums(rows, "host", n).withColumnsRenamed({"pages": "host_pages", "sums": "host_sums"}), "language-hosts")
    n_hosts = hosts.count()

    # P(declared | language): sums by declared language over the sums by language
    said = rows.where("declared is not null")
    of_language = said.agg(*(F.sum(F.col("p")[i]) for i in range(n))).first()
    right = lambda d, name: F.when(d == name, TRUST).otherwise((1 - TRUST) / n)
    likely = [
        F.log((F.col("sums")[i] + TRUST_PAGES * right(F.col("declared"), name)) / F.lit((of_language[i] or 0.0) + TRUST_PAGES)) for i, name in enumerate(languages)
    ]
    declared = written(sums(said, "declared", n).select("declared", F.array(*likely).alias("by_declared")), "language-declared")
    n_declared = declared.count()

    joined = rows.join(few(hosts, n_hosts), "host", "left").join(few(suffixes, n_suffixes), "suffix", "left").join(few(declared, n_declared), "declared", "left")
    prior = smoothed(F.col("host_pages") - 1, F.zip_with("host_sums", "p", lambda s, p: s - p), F.col("by_suffix"))
    flat = F.array(*(F.lit(0.0) for _ in languages))
    logs = F.zip_with(F.zip_with(F.col("e"), prior, lambda e, p: e + F.log(p)), F.coalesce("by_declared", flat), lambda a, b: a + b)
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    out = joined.withColumn("logs", logs).withColumn("w", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    probability = F.round(F.array_max("w") / F.aggregate("w", F.lit(0.0), lambda a, v: a + v), 9)
    text_lang = F.when(F.array_max("e") > F.array_min("e"), best(F.col("e")))
    return out.select("page_id", best(F.col("logs")).alias("lang"), probability.alias("probability"), text_lang.alias("text_lang"), "declared", "host")
