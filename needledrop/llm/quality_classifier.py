"""A quality classifier: histogram gradient-boosted trees over document statistics.

The trees grow level by level from histograms of gradients over quantile bins, in numpy, on a bounded sample of labelled
rows (``MOST_ROWS``, chosen by a hash of the id). Grown trees are complete and flattened: arrays of the feature and the
threshold of each inner node and of the value of each leaf, so that scoring walks all trees for a batch of documents with
one vectorised step a level.

Defined results: a null text is an empty one and is scored by its statistics like any other; a null id counts as an empty
one for holding out; without labels of both classes every score is the share of class 1 (0.5 without labels). Repeated rows
get the same score each; a labelled id with several rows is learned from once, by the text with the least hash, and an id with
both labels once with each. Other columns play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from needledrop.llm.common import map_rows, remainder, sampled

#: Labelled rows that a model is fitted on at most.
MOST_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 60, 4, 32, 0.2, 1.0, 1.0
MARKS = "#*$%&|<>!?.,;:-_/=\"'()[]{}"


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text: rates, so that length alone decides little."""
    t = text or ""
    words, lines, chars = t.split(), t.split("\n"), len(t)
    n = len(words)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    capitals = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    titles = sum(k for w, k in counts.items() if w[:1].isupper())
    full = [x for x in lines if x.strip()]
    most = max(counts.values(), default=0)
    one = max(n, 1)
    marks = [t.count(c) for c in MARKS]
    return [
        *(float(np.log1p(chars)), float(np.log1p(n)), (chars - n) / one, len(counts) / one, pairs / max(n - 1, 1), same / one),
        *(capitals / one, titles / one, most / one, len(set(full)) / max(len(full), 1), n / max(len(full), 1)),
        *(sum(map(t.count, "0123456789")) / max(chars, 1), sum(marks) / max(chars, 1)),
        *(k / one for k in marks),
    ]


N_FEATURES = len(statistics(""))


@dataclass
class Trees:
    prior: float
    #: [tree, inner node]: a feature's number and the threshold above which a row goes right.
    feature: np.ndarray
    threshold: np.ndarray
    #: [tree, leaf]
    value: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not len(self.value):
            return np.full(len(x), self.prior)
        depth = int(self.value.shape[1]).bit_length() - 1
        tree = np.arange(len(self.value))
        node = np.zeros((len(x), len(tree)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(depth):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return self.prior + self.value[tree, node - (self.value.shape[1] - 1)].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)))
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1])) for f in x.T]
    bins = np.stack([np.searchsorted(e, f, side="left") for e, f in zip(edges, x.T, strict=True)], axis=1)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, value = [], [], []
    logit = np.full(len(y), model.prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        f_of, t_of, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                shape = (width, k)
                sums = [np.bincount(at * k + bins[:, j], w, width * k).reshape(shape).cumsum(axis=1) for w in (g, h)]
                (gl, hl), (gt, ht) = (s[:, :-1] for s in sums), (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = -1
                cut = gain.argmax(axis=1)
                top = gain[np.arange(width), cut]
                for i in np.flatnonzero(top > best):
                    best[i], f_of[first + i], t_of[first + i] = top[i], j, e[cut[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f_of[node]] > t_of[node])
        leaf = node - inner
        v = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        logit = logit + v[leaf]
        feature.append(f_of)
        threshold.append(t_of)
        value.append(v)
    return Trees(model.prior, np.array(feature), np.array(threshold), np.array(value))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> Trees:
    """A model of ``labels`` (doc_id, label), from at most ``most`` of its rows: those whose remainder by 3 isn't 1.

    Rows of ``docs`` are brought down to one for each labelled id, within the tasks that read them first, before they are gathered.
    """
    own = labels.where((remainder(F.col("doc_id"), 3) != 1) & F.col(label).isNotNull())
    rows = sampled(own.select("doc_id", F.col(label).cast("int").alias("label")), most, "doc_id", "label")
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most ``most`` rows
    schema = StructType([docs.schema["doc_id"], StructField("label", IntegerType()), StructField("t", LongType()), StructField("x", ArrayType(DoubleType()))])
    each = texts.select("doc_id", "label", F.xxhash64("text").alias("t"), "text")
    found = map_rows(each, lambda: lambda k, y, h, t: [k, y, h, [statistics(s) for s in t]], schema)
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct("t", "x")).alias("first")).select("label", "first.x")
    found = one.toPandas()
    assert len(found) <= most
    x, y = np.array(found["x"].tolist(), np.float64).reshape(-1, N_FEATURES), found["label"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # so that sums come out the same each time
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""

    def rows(k, texts):
        return [k, model.scores(np.array([statistics(t) for t in texts], np.float64).reshape(-1, N_FEATURES)).tolist()]

    return map_rows(docs.select(F.col(key), F.col(text)), lambda: rows, StructType([docs.schema[key], StructField("score", DoubleType())]))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    scored = score(docs, learn(docs, labels))
    held = (remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
