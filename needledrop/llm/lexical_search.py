"""Ranked lexical search over a tiered index.

The index keeps the postings of each term in tiers: those with the highest impact first, and for each tier the largest impact
that is left below it (the residual bound). Items are looked up in the first tier; the 50th best score so far and the residual
bounds tell which terms could still bring in a document that has not been seen. An item without such a term is proven; every
other one falls through to the next tier, with just those terms, and the last tier leaves nothing. Candidates whose bound
reaches the 50th best score are then scored exactly from the documents' own terms. Tier sizes change the work, never the result.

* Null and empty texts, and texts without a term, are in no result and not counted. Rows that repeat are documents of their own.
* Items that share an id and a text count once; items that share only an id are ranked one by one. A null id is an id.
* Equal scores go by ascending id (null first), then by the order of rows.
* Empty tables give empty results. Other columns of either table are not looked at.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop.llm.common import map_rows, written
from needledrop.plans.storage import BROADCAST_ROWS, small

#: Postings of a term in all tiers down to each: so many at least, else a share of the term's; the last tier takes the rest.
TIERS = ((64, 1 / 64), (512, 1 / 8))
#: What the terms that are not read further may add, as a share of the k-th best score: the less, the more postings are read and
#: the fewer candidates are left to be scored. Below 1 every result is exact.
MARGIN = 0.7
#: Impacts are compared by steps of this much where postings are dealt to tiers.
STEP = 4096
#: Every ASCII character that is no letter or digit separates terms; only A-Z are lower-cased.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def documents_of(docs: DataFrame, wanted: list[bytes] | None = None) -> DataFrame:
    """(row, doc_id, n, terms, tfs) of every row with a term; ``terms`` only has those in ``wanted`` (None: all)."""
    only = None if wanted is None else frozenset(wanted)

    def make():
        def run(rows, ids, texts):
            out = [], [], [], [], []
            for row, doc_id, text in zip(rows, ids, texts, strict=True):
                found = terms_of(text)
                if not found:
                    continue
                counts = Counter(found if only is None else filter(only.__contains__, found))
                for column, value in zip(out, (row, doc_id, len(found), list(counts), list(counts.values())), strict=True):
                    column.append(value)
            return out

        return run

    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(own, make, f"row bigint, doc_id {kind}, n bigint, terms array<binary>, tfs array<bigint>")


@dataclass
class TieredIndex:
    """``docs`` (row, doc_id, n, terms, tfs), ``terms`` (term, w, cuts, rests) and ``postings`` (term, row, impact, tier).

    ``cuts`` are the least steps of impact in each tier, ``rests`` the largest impacts below each.
    """

    docs: DataFrame
    terms: DataFrame
    postings: DataFrame
    n_docs: int
    n_terms: int
    n_tiers: int


def _impacts(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(row, doc_id, term, impact) of each document's terms: what a term adds to a score, but for its weight."""
    each = docs.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", "doc_id", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    m = f"(50 + (50L * n * {n_docs}L) div {max(1, n_terms)}L)"
    return each.select("row", "doc_id", "term", F.expr(f"(1000000000L * tf) div (1000L * tf + 20L * {m})").alias("impact"))


def build(docs: DataFrame, wanted: DataFrame | None = None, tiers: tuple[tuple[int, float], ...] = TIERS) -> TieredIndex:
    """The index of ``docs`` (doc_id, text): of all terms, or of those in ``wanted`` (term), which a batch of items asks for.

    Counts of documents and terms are over all rows in either case. Terms to look for go along to the readers if they are few
    (they are counted first); else all are kept, and those that nobody wants go where postings meet their weights.
    """
    asked = None
    if wanted is not None:
        wanted = written(wanted.select("term").distinct(), "wanted")
        if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            asked = [bytes(r["term"]) for r in wanted.collect()]  # counted: at most BROADCAST_ROWS
    own = written(documents_of(docs, asked), "search-docs")
    sums = own.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"] or 0
    each = _impacts(own, n_docs, n_terms)
    # one row for each term and step of impact: at most a million by STEP of them for a term, however frequent it is
    steps = each.groupBy("term", F.expr(f"impact div {STEP}").alias("step")).agg(F.count("*").alias("k"), F.max("impact").alias("top"))
    if wanted is not None:
        steps = steps.join(wanted, "term", "left_semi")
    down = Window.partitionBy("term").orderBy(F.col("step").desc())
    whole = F.sum("k").over(Window.partitionBy("term"))
    steps = steps.withColumns({"above": F.sum("k").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "of": whole})
    tier = F.lit(len(tiers))
    for t, (least, share) in reversed(list(enumerate(tiers))):
        tier = F.when(F.col("above") <= F.greatest(F.lit(least), F.col("of") * share), t).otherwise(tier)
    steps = steps.withColumn("tier", tier)
    n = len(tiers) + 1
    terms = steps.groupBy("term").agg(
        F.sum("k").alias("df"),
        F.array(*(F.min(F.when(F.col("tier") <= t, F.col("step"))) for t in range(n))).alias("cuts"),
        F.array(*(F.coalesce(F.max(F.when(F.col("tier") > t, F.col("top"))), F.lit(0)) for t in range(n))).alias("rests"),
    )
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    terms = written(terms.select("term", w.alias("w"), "cuts", "rests").where("w > 0"), "search-terms")
    placed = each.join(small(terms.select("term", "cuts")), "term")
    of = F.coalesce(*(F.when(F.expr(f"impact div {STEP} >= cuts[{t}]"), t) for t in range(n)))
    postings = written(placed.select("term", "row", "impact", of.cast("int").alias("tier")), "postings", "tier")
    return TieredIndex(own, terms, postings, n_docs, n_terms, n)


def asked_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term) of every item with a term; ``item`` tells items with one id apart."""

    def make():
        def run(items, ids, texts):
            out = [], [], []
            for item, item_id, text in zip(items, ids, texts, strict=True):
                for term in dict.fromkeys(terms_of(text)):
                    for column, value in zip(out, (item, item_id, term), strict=True):
                        column.append(value)
            return out

        return run

    own = items.select("item_id", "text").distinct()
    own = own.select(F.xxhash64("text", "item_id").alias("item"), "item_id", F.col("text").cast("binary"))
    return map_rows(own, make, f"item bigint, item_id {items.schema['item_id'].dataType.simpleString()}, term binary")


def _best(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each item with their ``rank``; Spark keeps ``k`` for each item and task before it shuffles."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _exact(index: TieredIndex, can: DataFrame, asked: DataFrame) -> DataFrame:
    """(item, row, doc_id, score): the whole scores of some pairs (item, row), from the documents' own terms.

    A document comes once, with the items that it may be in. The items' terms go along to the readers if they are few (they are
    counted); else they meet the documents' terms in a join.
    """
    asked = asked.select("item", "term", "w")
    wanted = can.groupBy("row").agg(F.collect_list("item").alias("items"))  # at most all items for a row
    docs = index.docs.join(small(written(wanted, "candidate-rows")), "row")
    if asked.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        each = _impacts(docs, index.n_docs, index.n_terms).join(small(can), "row").join(asked, ["item", "term"])
        return each.groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("w") * F.col("impact")).alias("score"))
    weights: dict[int, list[tuple[bytes, int]]] = {}
    for r in asked.collect():  # counted
        weights.setdefault(r["item"], []).append((bytes(r["term"]), r["w"]))
    n_docs, n_terms = index.n_docs, max(1, index.n_terms)

    def make():
        def run(rows, ids, lengths, terms, tfs, items):
            out = [], [], [], []
            for row, doc_id, n, own, counts, wanted in zip(rows, ids, lengths, terms, tfs, items, strict=True):
                m = 50 + (50 * n * n_docs) // n_terms
                impact = {t: (1_000_000_000 * tf) // (1000 * tf + 20 * m) for t, tf in zip(own, counts, strict=True)}
                for item in wanted:
                    score = sum(w * impact[t] for t, w in weights[item] if t in impact)
                    for column, value in zip(out, (item, row, doc_id, score), strict=True):
                        column.append(value)
            return out

        return run

    kind = index.docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("row", "doc_id", "n", "terms", "tfs", "items"), make, f"item bigint, row bigint, doc_id {kind}, score bigint")


def search(index: TieredIndex, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest scores above 0.

    A round reads one more tier for the (item, term) pairs that are open. What is best so far is scored exactly, which gives a
    lower bound of the ``k``-th best score; the bounds of all that is unread are held against it.
    """
    asked = asked_terms(items).join(index.terms.select("term", "w", "rests"), "term")
    asked = written(asked.withColumn("pair", F.monotonically_increasing_id()), "asked")
    zero = F.lit(0).cast("bigint")
    pairs = asked.select("pair", "item", "term", "w", "rests", F.lit(-1).alias("read"), zero.alias("rest"), zero.alias("least"), F.lit(True).alias("open"))
    found = None
    for tier in range(index.n_tiers):
        now = small(written(pairs.where("open").select("pair", "term", "w", "read"), "open-terms"))
        hits = index.postings.where(F.col("tier") <= tier).join(now, "term").where("tier > read")
        hits = written(hits.select("pair", "row", (F.col("w") * F.col("impact")).alias("score")), "hits")
        found = hits if found is None else found.unionByName(hits)
        pairs = pairs.withColumn("read", F.when(F.col("open"), tier).otherwise(F.col("read"))).withColumn("rest", F.col("w") * F.element_at("rests", F.col("read") + 1))
        if tier < index.n_tiers - 1:
            sums = found.join(small(asked.select("pair", "item")), "pair").groupBy("item", "row").agg(F.sum("score").alias("score"))
            best = written(_best(sums, k, F.col("score").desc(), F.col("row")).select("item", "row"), "best")
            least = _exact(index, best, asked).groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).alias("found_least"))
            pairs = pairs.join(least, "item", "left").withColumn("least", F.greatest(F.coalesce("found_least", F.lit(0)), "least")).drop("found_least")
        # the terms with the least bounds, which together stay below the k-th best score, can't bring in a new document;
        # after the last tier nothing is left of the terms that were open
        up = Window.partitionBy("item").orderBy("rest", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pairs = written(pairs.withColumn("open", (F.col("rest") > 0) & (F.sum("rest").over(up) >= MARGIN * F.col("least"))), "asked")
        if pairs.where("open").isEmpty():
            break
    total = pairs.groupBy("item").agg((F.sum("rest") - F.first("least")).alias("lacks"))
    bounds = found.join(small(pairs.select("pair", "item", "rest")), "pair").groupBy("item", "row").agg(F.sum(F.col("score") - F.col("rest")).alias("bound"))
    can = bounds.join(small(written(total, "lacks")), "item").where("bound + lacks >= 0")  # score + all_rest - seen_rest >= least
    scores = _exact(index, written(can.select("item", "row"), "candidates"), asked)
    best = _best(scores.where("score > 0"), k, F.col("score").desc(), F.col("doc_id"), F.col("row"))
    return best.join(small(written(asked.select("item", "item_id").distinct(), "items")), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Every item's ``k`` best documents: an index of the terms that the items hold, and a search of it."""
    return search(build(docs, asked_terms(items)), items, k)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH words AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents)),
sizes AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM words),
postings AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, sizes GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), sizes GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
