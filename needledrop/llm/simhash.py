"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits lies on a ring of ``M`` segments. If two fingerprints differ in at most ``TAU`` bits, there is a
segment from which every chain of consecutive segments differs in at most its proportional budget: floor(l * TAU / M) bits
over l segments, for l = 1 to M (the strong form of the pigeonhole principle on a ring). Along such a chain at least
``ZEROS`` segments are equal, in one of a few patterns that the budgets fix; each pattern is an exact key. Fingerprints that
share a key are candidates; the chain test from the pattern's start prunes them before the full Hamming check.

Only distinct fingerprints are compared, so copies cost one row. Within a key, a task returns a spanning forest (each member
with the least fingerprint it is connected to), never all pairs. Keys with more than ``KEY_CAP`` members are dealt again by
a second set of patterns over their remaining bits; such a finer key leaves 16 bits, so it has at most 65,536 members. No
link is lost at any size. Components then come from minimum labels with pointer jumping on a table of edges.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked like any other; repeated
rows count as one document each; rows with a null id take part, and a component's id is its least id that isn't null; other columns
play no part, whatever their names (``deduplicated`` carries them along); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import few, map_rows, written

M, TAU, ZEROS, KEY_CAP, WORDS = 8, 4, 4, 2048, 4


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    of = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(tokens) - k + 1
    for at in range(0, n, 8192):  # a bounded piece of the bit matrix at a time
        begin, end = starts[at : min(at + 8192, n)].tolist(), ends[at + k - 1 : min(at + 8192, n) + k - 1].tolist()
        h = np.array([of(joined[a:b], 42) for a, b in zip(begin, end, strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, fp bigint) of every row: the fingerprint's bits as a signed long."""
    from pyspark.sql.types import LongType, StructField, StructType

    def rows(*columns):
        return [*columns[:-1], np.array([fingerprint(t) for t in columns[-1]], np.uint64).view(np.int64).tolist()]

    own = df.select(*keys, text)
    return map_rows(own, lambda: rows, StructType([*own.schema.fields[:-1], StructField("fp", LongType())]))


def budgets(m: int = M, tau: int = TAU) -> list[int]:
    return [length * tau // m for length in range(m + 1)]


def patterns(m: int = M, tau: int = TAU, zeros: int = ZEROS) -> dict[tuple[int, ...], list[int]]:
    """Sets of ``zeros`` segments that are equal along some chain within its budgets, with the chain's possible starts.

    A chain with at most budget(l) differing bits over its first l segments has at least l - budget(l) equal segments
    among them; the earliest equal segments that this forces are the pattern.
    """
    limit, out = budgets(m, tau), {}
    for start in range(m):
        for places in combinations(range(m), zeros):
            if all(sum(p < l for p in places) >= min(zeros, l - limit[l]) for l in range(1, m + 1)):
                out.setdefault(tuple(sorted((start + p) % m for p in places)), []).append(start)
    return out


def masks(bits: int, m: int = M) -> list[int]:
    """The bits of each segment of a word of ``bits`` bits."""
    width = bits // m
    return [((1 << width) - 1) << (s * width) for s in range(m)]


def ring_chains(starts: list[int], segment: list[int], m: int = M, tau: int = TAU) -> list[list[tuple[int, int]]]:
    """For each start, (mask of the chain's segments, budget) wherever the budget differs from the next longer chain's."""
    limit, out = budgets(m, tau), []
    for s in starts:
        chain, mask = [], 0
        for length in range(1, m + 1):
            mask |= segment[(s + length - 1) % m]
            if length == m or limit[length + 1] > limit[length]:
                chain.append((mask, limit[length]))
        out.append(chain)
    return out


def keys(df: DataFrame) -> DataFrame:
    """(key, fp): every fingerprint under each of its exact keys (pattern number, the bits of the equal segments)."""
    segment = masks(64)
    each = []
    for n, places in enumerate(patterns()):
        packed = F.lit(n).cast("long")
        for s in places:
            packed = F.shiftleft(packed, 8).bitwiseOR(F.shiftrightunsigned(F.col("fp"), 8 * s).bitwiseAND(F.lit(255)))
        each.append(packed)
    assert segment[1] == 255 << 8
    return df.select(F.explode(F.array(*each)).alias("key"), F.col("fp"))


def finer_keys(df: DataFrame) -> DataFrame:
    """(key, fp) of crowded keys, split by the same patterns over eight 4-bit segments of the 32 bits that are left."""
    every = range(M)
    rest = F.lit(0).cast("long")
    chosen = list(patterns())
    for n, places in enumerate(chosen):
        bits = F.lit(0).cast("long")
        for s in (s for s in every if s not in places):
            bits = F.shiftleft(bits, 8).bitwiseOR(F.shiftrightunsigned(F.col("fp"), 8 * s).bitwiseAND(F.lit(255)))
        rest = F.when(F.shiftright(F.col("key"), 32) == n, bits).otherwise(rest)
    each = []
    for n, places in enumerate(chosen):
        packed = F.lit(n).cast("long")
        for s in places:
            packed = F.shiftleft(packed, 4).bitwiseOR(F.shiftrightunsigned(F.col("rest"), 4 * s).bitwiseAND(F.lit(15)))
        each.append(packed)
    return (
        df.withColumn("rest", rest)
        .select(F.explode(F.array(*each)).alias("fine"), "key", "fp")
        .select(F.xxhash64("key", "fine").alias("key"), "fp")
    )


def forest(members: np.ndarray, chains: list[list[tuple[int, int]]], tau: int = TAU) -> np.ndarray:
    """For each of some distinct fingerprints, the position of the least member it is connected to by links."""
    label = np.arange(len(members))
    for i in range(len(members) - 1):
        differ = members[i + 1 :] ^ members[i]
        near = np.flatnonzero(linked(differ, chains, tau)) + i + 1
        if len(near):
            joined = np.unique(label[np.append(near, i)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return label


def linked(differ: np.ndarray, chains: list[list[tuple[int, int]]], tau: int = TAU) -> np.ndarray:
    """Which differences pass the chain test from some start, and then the full Hamming check."""
    out = np.zeros(len(differ), bool)
    for chain in chains:
        left = np.flatnonzero(~out)
        for mask, limit in chain:
            left = left[np.bitwise_count(differ[left] & np.uint64(mask)) <= limit]
        out[left] = True
    return out & (np.bitwise_count(differ) <= tau)


def edges_in_keys(keyed: DataFrame, cap: int | None, ring: bool) -> DataFrame:
    """(a, b, crowded): edges of each key's forest, or (key, fp, true) for each member of a key with more than ``cap``.

    ``keyed`` must be dealt and sorted by key; a key's rows stream through, and no more than ``cap`` are held.
    """
    segment = masks(64)
    chains = [ring_chains(starts, segment) for starts in patterns().values()]
    whole = [[((1 << 64) - 1, TAU)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, crowded = None, [], False

        def closed() -> list[tuple[np.ndarray, np.ndarray, bool]]:
            if held_key is None or crowded or not held:
                return []
            fp = np.unique(np.concatenate(held))
            if len(fp) < 2:
                return []
            label = forest(fp, chains[held_key >> 32] if ring else whole)
            at = np.flatnonzero(label != np.arange(len(fp)))
            return [(fp[at], fp[label[at]], False)]

        for batch in batches:
            key = batch.column(0).to_numpy()
            fp = batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(begin, len(key)))
            out = []
            # whole runs of two, all at once; the last run may go on in the next batch
            two = begin[:-1][(size[:-1] == 2) & (key[begin[:-1]] != (held_key if held_key is not None else key[0] - 1))]
            if ring:
                for n in np.unique(key[two] >> 32):
                    at = two[key[two] >> 32 == n]
                    at = at[linked(fp[at] ^ fp[at + 1], chains[n])]
                    out.append((np.maximum(fp[at], fp[at + 1]), np.minimum(fp[at], fp[at + 1]), False))
            else:
                at = two[linked(fp[two] ^ fp[two + 1], whole)]
                out.append((np.maximum(fp[at], fp[at + 1]), np.minimum(fp[at], fp[at + 1]), False))
            more = (size > 2) | (key[begin] == held_key if held_key is not None else False)
            more[-1] = True
            for a, n in zip(begin[more].tolist(), size[more].tolist(), strict=True):
                if key[a] != held_key:
                    out += closed()
                    held_key, held, crowded = int(key[a]), [], False
                held.append(fp[a : a + n].copy())
                if cap is not None and (crowded or sum(map(len, held)) > cap):
                    rows = np.concatenate(held)
                    out.append((np.full(len(rows), held_key).astype(np.int64).view(np.uint64), rows, True))
                    held, crowded = [], True
            yield from made(out)
        yield from made(closed())

    def made(out: list) -> Iterator[pa.RecordBatch]:
        for a, b, crowded in out:
            if len(a):
                yield pa.record_batch(
                    {"a": a.view(np.int64), "b": b.view(np.int64), "crowded": np.full(len(a), crowded)}
                )

    return keyed.mapInArrow(run, "a bigint, b bigint, crowded boolean")


def dealt(keyed: DataFrame) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key", "fp")


def edges(distinct: DataFrame, cap: int = KEY_CAP) -> DataFrame:
    """(a, b), a > b as unsigned: enough links among distinct fingerprints to connect all that are connected."""
    # Every fingerprint becomes as many rows as there are patterns, so they are dealt out anew rather than left in few tasks;
    # by a hash of their own, as a second dealing by the same column would be left out.
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = written(edges_in_keys(dealt(keys(distinct.repartition(n, F.xxhash64("fp")))), cap, True).distinct(), "simhash-edges")
    crowded = first.where("crowded").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    found = first.where("not crowded").select("a", "b")
    if crowded.isEmpty():
        return found
    return found.unionByName(edges_in_keys(dealt(finer_keys(crowded)), None, False).select("a", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node (as signed) of each node's component, for all nodes that ``links`` (a, b) name.

    Each round takes the least label among a node and its neighbours, then the label of that label; the number of rounds
    grows with the logarithm of a component's diameter. Every round is a written table.
    """
    both = written(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        least = (
            both.join(labels.toDF("other", "l"), "other")
            .groupBy("node")
            .agg(F.min("l").alias("l"))
            .join(labels, "node")
            .select("node", F.least("l", "label").alias("to"), F.col("label").alias("was"))
        )
        jumped = least.join(labels.toDF("to", "further"), "to", "left").select(
            "node", F.least(F.col("to"), F.coalesce("further", "to")).alias("label"), "was"
        )
        after = written(jumped, "labels")
        labels = after.select("node", "label")
        if after.where("label <> was").isEmpty():
            return labels


def shared(firsts: DataFrame, cap: int) -> tuple[DataFrame, int]:
    """(fp, first) of the fingerprints that ``firsts`` (fp, first, n) has more than one row of or a link for, and how many.

    ``first`` becomes the least of the whole component. All other fingerprints stand for one row each and need nothing.
    """
    firsts = written(firsts, "firsts")
    labels = components(edges(firsts.select("fp"), cap)).withColumnRenamed("node", "fp")
    found = firsts.join(labels, "fp", "left").where("n > 1 or label is not null").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    found = written(found, "shared")
    least = found.groupBy("label").agg(F.min("first").alias("least"))
    n = found.count()
    return written(found.join(few(least, n), "label").select("fp", F.col("least").alias("first")), "shared"), n


def classes(docs: DataFrame, cap: int = KEY_CAP) -> DataFrame:
    """(doc_id, fp, component_id) of every row; see the module for nulls, empty texts and repeated rows."""
    prints = written(fingerprints(docs, "doc_id"), "fingerprints")
    found, n = shared(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), cap)
    return prints.join(few(found, n), "fp", "left").select("doc_id", "fp", F.coalesce("first", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, cap: int = KEY_CAP) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of the least id (null last), the first if it repeats."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "rows")
    prints = written(fingerprints(rows.select("uid", "row.doc_id", "row.text"), "uid", "doc_id"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    found, n = shared(prints.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")), cap)
    # most rows stay: only those that go are looked up, so the texts aren't dealt out for the others' sake
    gone = written(prints.join(few(found, n), "fp").where(F.col("uid") != F.col("first.uid")).select("uid"), "gone")
    return rows.join(few(gone, gone.count()), "uid", "left_anti").select("row.*")
