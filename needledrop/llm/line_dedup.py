"""Lines that many documents share, taken out of all but one of them.

Lines are exploded with their positions; a line's key (stripped of white space, A-Z lower-cased) is hashed to 128 bits; for each
hash the distinct documents are counted, and keys over the threshold lose their lines but for those of the largest id that holds
them. A document is put together again from its lines and the positions that go, so lines are never grouped again, and only
hashes, ids and positions are shuffled by key. A key that many documents hold is counted from one row for each of them in two
steps, and Spark splits it where it meets its lines.

* A null text is empty, and an empty text is one empty line, which is too short to be dropped; a text of no other line keeps "".
* A null id is one document, smaller than all others. Rows that share an id are one document for the counts and each keep or
  lose the same lines; rows that repeat have equal results.
* Empty tables give empty results; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import written
from needledrop.plans.storage import small

MIN_CHARS, MIN_DOCS = 20, 3
_SPACES = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key_of(line: Column) -> Column:
    """The stripped line with A-Z lower-cased: by ``lower`` where all characters are ASCII, which is faster and the same."""
    own = F.trim(line, F.lit(_SPACES))
    return F.when(F.octet_length(own) == F.length(own), F.lower(own)).otherwise(F.translate(own, _UPPER, _UPPER.lower()))


def _hashes(name: str, *columns: Column) -> list[Column]:
    """128 bits in two columns; the second hash has another seed."""
    return [F.xxhash64(*columns).alias(f"{name}1"), F.xxhash64(F.lit(1), *columns).alias(f"{name}2")]


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, r1, r2, pos): every line that is long enough; h is its key's hash, r that of its row's id and text."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("doc_id", *_hashes("r", F.col("doc_id"), F.col("text")), F.split("text", "\n", -1).alias("lines"))
    own = own.select("doc_id", "r1", "r2", F.posexplode("lines").alias("pos", "line"))  # a row is hashed before it is exploded
    own = own.where(F.length(F.trim("line", F.lit(_SPACES))) >= min_chars).withColumn("key", key_of(F.col("line")))
    return own.select(*_hashes("h", F.col("key")), "doc_id", "r1", "r2", "pos")


def repeated_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, keeper): the keys in at least so many documents, and the largest id that holds each."""
    each = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
    return each.agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs).drop("docs")


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(r1, r2, drops): the positions, in order, of the lines that a row loses, for rows that lose any."""
    lines = keyed_lines(docs, min_chars)
    repeated = written(repeated_keys(lines, min_docs), "repeated-lines")
    gone = lines.join(small(repeated), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("drops"))  # a group: one document's lines


def _without(lines: Column, drops: Column) -> Column:
    """The lines that are not at one of the positions, joined; in time that grows with their number."""

    def upto(i: Column) -> Column:
        """Flags from behind the position before the ``i``th to it: the last one says that a line goes."""
        before = F.when(i == 0, -1).otherwise(F.get(drops, i - 1))
        return F.concat(F.array_repeat(F.lit(False), F.get(drops, i) - before - 1), F.array(F.lit(True)))

    gone = F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops) - 1), upto))
    kept = F.zip_with(lines, gone, lambda line, out: F.when(~F.coalesce(out, F.lit(False)), line))
    return F.array_join(kept, "\n")  # which leaves nulls out


def deduped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, n_lines, n_dropped, kept): ``row`` holds all columns of ``docs``, ``kept`` the text that is left."""
    drops = dropped_positions(docs, min_chars, min_docs)  # with the texts, by shuffles, at every size
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), *_hashes("r", F.col("doc_id"), text))
    joined = rows.join(drops, ["r1", "r2"], "left")
    return joined.select(
        "row",
        F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(_without(F.split("text", "\n", -1), F.col("drops"))).alias("kept"),
    )


def filtered(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with what is left of their texts; a null text becomes empty."""
    found = deduped(docs, min_chars, min_docs)
    return found.select(*(F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def digested(found: DataFrame) -> DataFrame:
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
repeated AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT l.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines l LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
