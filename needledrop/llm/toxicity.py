"""Toxicity by non-negative positive-unlabelled learning.

A linear model over words and word beginnings is trained from confirmed toxic documents and unlabelled ones with the
class-prior-corrected risk: pi R(positives as positive) + max(0, R(unlabelled as negative) - pi R(positives as negative)).
Where the bracket falls below zero a step goes the other way on it, which keeps the model from fitting the toxic documents
that the unlabelled text holds. The class prior pi is the share of toxic documents among the labelled rows that may be
learned from.

Features are hashed; the ``FEATURES`` whose document counts among the positives exceed those among all documents by most
standard errors are kept. The counts of all documents are summed within tasks, for the features of the positives only, and then
by grouped aggregation. Every document's counts of the kept features are then written as a table, which holds a small part of
the text's bytes; scores are read from it too, so texts are not read again.

Labelled rows are a bounded sample, ``POSITIVES`` confirmed documents by a hash of the id. Unlabelled ones are all rows that
may be learned from: ``UNLABELLED`` of them, again by a hash, give the start of the weights and the curvature, and from there
each step takes the risk and its gradient over all rows, by grouped aggregation over the table. These sums are of whole units,
so a model doesn't depend on how rows are partitioned.

Defined results: a null text is an empty one, with a score by its length alone; a null id counts as an empty one for holding
out and is never learned from; without confirmed documents every score is 0. Repeated rows get the same score each, and each
counts in the risk of the unlabelled; among the confirmed and in the start an id with several rows is learned from once, by
the text with the least hash. Other columns play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from needledrop.llm.common import SLICE_ROWS, map_rows, remainder, sampled, written

POSITIVES, UNLABELLED, FEATURES = 4_000, 8_000, 256
#: Documents with a feature among the positives, at least.
LEAST_DOCS = 3
HASHES, BEGINNINGS = 1 << 18, (4, 5, 6, 7)
#: The checksum of "=", which marks a whole word.
EQUALS = zlib.crc32(b"=")
STEPS, RATE, L2 = 300, 0.05, 1e-4
#: Steps over all rows at most, each shortened so often at most; the fall of the risk that is worth another; what is added to the curvature.
FULL_STEPS, TRIES, FALL, DAMPING = 12, 4, 1e-3, 1e-3
#: Parts of one in which sums over all rows are taken; rows that are summed at a time, so that a sum of doubles is exact.
UNIT, SUM_ROWS = 1 << 16, 8192
WORD, CACHE_WORDS = re.compile(r"[^\W\d_]+"), 300_000


def hashes(word: str) -> tuple[int, ...]:
    """The features of a word: itself and its beginnings."""
    b = word.encode()
    own = zlib.crc32(b, EQUALS) % HASHES
    if len(b) == len(word):  # bytes are characters
        return own, *[zlib.crc32(b[:n]) % HASHES for n in BEGINNINGS if len(b) >= n]
    return own, *[zlib.crc32(word[:n].encode()) % HASHES for n in BEGINNINGS if len(word) >= n]


class Words:
    """Texts as rows of counts of some features (a hash and its place each), a batch at a time.

    A word's features are looked up once for each task; words without any are known as such, so that most of a text costs
    one set operation.
    """

    def __init__(self, places: dict[int, int]) -> None:
        self.places, self.with_features, self.without = places, {}, set()

    def of(self, text: str | None) -> tuple[Counter, list[str]]:
        """A text's words with their counts, and those of them that have features."""
        counts = Counter(WORD.findall((text or "").lower()))
        if new := set(counts).difference(self.without).difference(self.with_features):
            if len(self.with_features) + len(self.without) > CACHE_WORDS:
                self.with_features.clear()
                self.without.clear()
                new = set(counts)
            for word in new:
                if at := tuple(self.places[h] for h in hashes(word) if h in self.places):
                    self.with_features[word] = at
                else:
                    self.without.add(word)
        return counts, sorted(self.with_features.keys() & counts.keys())


    def sparse(self, text: str | None) -> tuple[list[int], list[int], int]:
        """The places of a text's features, how many of its words have each, and its number of words."""
        own, found = self.of(text)
        counts: Counter = Counter()
        for word in found:
            for place in self.with_features[word]:
                counts[place] += own[word]
        at = sorted(counts)
        return at, [counts[p] for p in at], own.total()


@dataclass
class Vectors:
    """Texts as sparse vectors: of each entry its row, place and damped count; of each row its damped length."""

    row: np.ndarray
    place: np.ndarray
    value: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(at: pa.Array, n: pa.Array, words: pa.Array) -> Vectors:
        """From lists of places and counts and the numbers of words."""
        total = words.to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(total)), at.value_lengths().to_numpy(zero_copy_only=False))
        counts = n.flatten().to_numpy(zero_copy_only=False)
        value = np.log1p(counts) * 3 / (total[row] + 20) ** 0.25
        return Vectors(row, at.flatten().to_numpy(zero_copy_only=False).astype(np.int64), value, np.log(total + 10) / 10)

    def dense(self, features: int) -> np.ndarray:
        """[row, feature], the length last."""
        out = np.zeros((len(self.length), features + 1))
        out[self.row, self.place] = self.value
        out[:, -1] = self.length
        return out

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Each row's own sum, the same in whatever company."""
        return np.bincount(self.row, self.value * weights[self.place], len(self.length)) + self.length * weights[-1] + bias


@dataclass
class Model:
    #: The kept features' hashes with their places; the weights by place, the last one that of the length; the bias.
    places: dict[int, int]
    weights: np.ndarray
    bias: float

    def scores(self, x: Vectors) -> np.ndarray:
        return sigmoid(x.logits(self.weights, self.bias))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam."""
    n, m = len(positive), len(unlabelled)
    w, b = np.zeros(positive.shape[1]), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_negative_p, as_negative_u = -prior * sigmoid(zp) / n, sigmoid(zu) / m
        if negative_risk >= 0:
            gp, gu = as_negative_p - prior * sigmoid(-zp) / n, as_negative_u
        else:
            gp, gu = -as_negative_p, -as_negative_u
        g = np.append(gp @ positive + gu @ unlabelled + L2 * w, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = RATE * first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def refined(weights: np.ndarray, bias: float, sums: Callable, positive: np.ndarray, sample: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Steps from a start on the non-negative risk over all unlabelled rows.

    ``sums(weights, bias)`` gives, of all unlabelled rows: how many, the sum of their losses as negative, and that of its
    gradient (features, length, bias). A step is Newton's, by the curvature on ``sample``, shortened until the risk falls with
    a bracket that isn't negative; while the bracket is, the shortest steps lead back to where it is zero.
    """
    xp, xs = (np.column_stack((x, np.ones(len(x)))) for x in (positive, sample))

    def newton(v: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        p = sigmoid(xs @ v)
        return -np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs / len(xs) + DAMPING * np.eye(len(v)), gradient)

    def at(v: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """The risk, the bracket, and their gradients."""
        n, loss, gradient = sums(v[:-1], v[-1])
        z, w = xp @ v, np.append(v[:-1], 0)
        bracket = loss / n - prior * np.logaddexp(0, z).mean()
        of_bracket = gradient / n - prior * sigmoid(z) @ xp / len(xp)
        risk = prior * np.logaddexp(0, -z).mean() + bracket + L2 / 2 * w @ w
        return risk, bracket, of_bracket - prior * sigmoid(-z) @ xp / len(xp) + L2 * w, of_bracket

    v = np.append(weights, bias)
    now = at(v)
    for _ in range(FULL_STEPS):
        if now[1] >= 0:
            break
        v = v - 1.1 * now[1] / max(now[3] @ now[3], 1e-12) * now[3]
        now = at(v)
    for _ in range(FULL_STEPS):
        step = newton(v, now[2])
        for _ in range(TRIES):
            new = at(v + step)
            if new[1] >= 0 and new[0] < now[0]:
                break
            step = step * (0.5 if new[1] >= 0 else min(0.5, 0.9 * now[1] / (now[1] - new[1])))
        else:
            break
        fall, v, now = now[0] - new[0], v + step, new
        if fall < FALL:
            break
    return v[:-1], float(v[-1])


def vectors(docs: DataFrame, places: dict[int, int], carry: list[str], text: str = "text") -> DataFrame:
    """``docs``' columns ``carry`` with each text's (at, n, words): places of features, their counts, the number of words."""

    def make():
        words = Words(places)

        def run(*columns):
            found = [words.sparse(t) for t in columns[-1]]
            return [*columns[:-1], *(list(c) for c in zip(*found, strict=True))]

        return run

    many = ArrayType(IntegerType())
    schema = StructType([*(docs.schema[c] for c in carry), StructField("at", many), StructField("n", many), StructField("words", IntegerType())])
    return map_rows(docs.select(*carry, text), make, schema)


def sums_over(rows: DataFrame, weights: np.ndarray, bias: float) -> tuple[int, float, np.ndarray]:
    """Of all ``rows`` of (at, n, words): how many, the sum of their losses as negative, and that of its gradient.

    Values and probabilities are rounded to units, and units are summed, exactly: the order of rows and tasks plays no part.
    """
    size = len(weights)  # then the bias, the loss and the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, units = np.zeros(size + 3, np.int64), lambda x: np.rint(x * UNIT)
        for batch in batches:
            for start in range(0, batch.num_rows, SUM_ROWS):
                part = batch.slice(start, SUM_ROWS)
                x = Vectors.of(*(part.column(c) for c in ("at", "n", "words")))
                z = np.clip(x.logits(weights, bias), -30, 30)
                p = units(sigmoid(z))
                total[: size - 1] += np.bincount(x.place, units(x.value) * p[x.row], size - 1).astype(np.int64)
                total[size - 1 :] += np.array([units(x.length) @ p, p.sum() * UNIT, units(np.logaddexp(0, z)).sum() * UNIT, len(z)]).astype(np.int64)
        yield pa.record_batch({"place": np.arange(size + 3, dtype=np.int32), "total": total})

    each = rows.select("at", "n", "words").mapInArrow(run, "place int, total bigint")
    found = each.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # one for each weight
    out = [0] * (size + 3)
    for r in found:
        out[r["place"]] = int(r["total"])
    return out[-1], out[-2] / UNIT**2, np.array([t / UNIT**2 for t in out[:-2]])


def document_counts(docs: DataFrame, places: dict[int, int], text: str = "text") -> np.ndarray:
    """In how many of all documents each feature occurs: counted within tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = {}, np.zeros(len(places), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                found: list[int] = []
                for t in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    own = set(WORD.findall((t or "").lower()))
                    if new := own.difference(known):
                        if len(known) > CACHE_WORDS:
                            known.clear()
                            new = own
                        for word in new:
                            known[word] = tuple(places[h] for h in hashes(word) if h in places)
                    found += set().union(*map(known.__getitem__, own))
                total += np.bincount(np.array(found, np.int64), minlength=len(places))
        at = np.flatnonzero(total)
        yield pa.record_batch({"place": at.astype(np.int32), "n": total[at]})

    sums = docs.select(text).mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(places))  # at most HASHES rows
    out[sums["place"].to_numpy(int)] = sums["n"].to_numpy(float)
    return out


def trained(docs: DataFrame, labels: DataFrame, label: str, positives: int, unlabelled: int) -> tuple[Model, DataFrame] | None:
    """A model, and (doc_id, at, n, words) of every row of ``docs`` in a written table; None without a toxic document."""
    own = labels.where((remainder(F.col("doc_id"), 5) != 0) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    learnable = (remainder(F.col("doc_id"), 5) != 0) & F.col("doc_id").isNotNull()
    prior = own.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    toxic = sampled(own.where(F.col(label) == 1), positives, "doc_id")
    others = sampled(docs.where(learnable), unlabelled, "doc_id")
    chosen = toxic.withColumn("toxic", F.lit(True)).unionByName(others.withColumn("toxic", F.lit(False)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``positives`` and ``unlabelled`` ids
    hashed = texts.select("doc_id", "toxic", F.struct(F.xxhash64("text").alias("t"), "text").alias("own"))
    sample = written(hashed.groupBy("doc_id", "toxic").agg(F.min("own").alias("own")).select("toxic", "own.text"), "toxicity-sample")

    def found(texts):
        return [[sorted({h for w in set(WORD.findall((t or "").lower())) for h in hashes(w)}) for t in texts]]

    n_toxic = sample.where("toxic").count()
    if not n_toxic:
        return None
    each = map_rows(sample.where("toxic").select("text"), lambda: found, StructType([StructField("h", ArrayType(IntegerType()))]))
    counts = each.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("p")).where(F.col("p") >= LEAST_DOCS).orderBy("h").toPandas()
    hashed, p = counts["h"].tolist(), counts["p"].to_numpy(float)  # at most HASHES rows
    m = max(docs.count(), 1)
    u = document_counts(docs, {h: i for i, h in enumerate(hashed)})
    more = (p / n_toxic - u / m) / np.sqrt((u + 1) / m / n_toxic)
    best = np.lexsort((hashed, -more))[:FEATURES] if hashed else []
    model = Model({hashed[i]: k for k, i in enumerate(best)}, np.zeros(len(best) + 1), 0.0)
    every = written(vectors(docs, model.places, ["doc_id"]), "toxicity-vectors")
    rows = vectors(sample, model.places, ["toxic"]).toArrow().combine_chunks()  # at most ``positives`` and ``unlabelled`` rows
    assert len(rows) <= positives + unlabelled
    flags = rows["toxic"].to_numpy().astype(bool)
    x = Vectors.of(*(pa.concat_arrays(rows[c].chunks) for c in ("at", "n", "words"))).dense(len(best))
    order = np.lexsort((*x.T, flags))  # so that sums come out the same each time
    x, flags = x[order], flags[order]
    prior, start = min(max(prior, 1e-3), 0.5), x[~flags] if (~flags).any() else np.zeros((1, x.shape[1]))
    model.weights, model.bias = fit(x[flags], start, prior)
    if (~flags).any():
        rest = every.where(learnable)
        model.weights, model.bias = refined(model.weights, model.bias, lambda w, b: sums_over(rest, w, b), x[flags], start, prior)
    return model, every


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """A model from the rows of ``labels`` (doc_id, label) whose remainder by 5 isn't 0; None without a toxic one."""
    found = trained(docs, labels, label, positives, unlabelled)
    return found and found[0]


def scored(rows: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of (key, at, n, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = Vectors.of(*(batch.column(c) for c in ("at", "n", "words")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], [key, "score"])

    return rows.select(key, "at", "n", "words").mapInArrow(run, StructType([rows.schema[key], StructField("score", DoubleType())]))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    if model is None:
        return docs.select(key, F.lit(0.0).alias("score"))
    return scored(vectors(docs, model.places, [key], text), model, key)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    found = trained(docs, labels, "toxic", POSITIVES, UNLABELLED)
    scores = scored(found[1], found[0]) if found else score(docs, None)
    held = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return scores.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
