"""Mixing of repeated rows, quality verdicts, language fusion, document statistics and the risk against plain Python."""

import random
import re
from collections import Counter

import models
import numpy as np
from pyspark.sql import functions as F
from samples import DATA, frame, real

from needledrop.llm import language_id, mixing, quality_classifier, quality_rules, toxicity
from needledrop.llm.common import sampled, table

R = random.Random(7)




def mixed_sources():
    same = "word " * 100
    data = [(1, same, "en", "a", 1)] * 400 + [(i + 10, "other " * (50 + i % 200), "en", "b", 1) for i in range(700)]
    data += [(2, "w " * 60, "en", "c", 1)] * 300 + [(i + 2000, "o " * (30 + i % 90), "en", "c", 1) for i in range(400)]
    data += [(i + 3000, "g " * 9000, "en", "c", 1) for i in range(3)]
    data += [(i + 4000, "x " * (7 + i % 13), "en", None, 1) for i in range(300)] + [(None, None, "en", "d", 0), (5, "", "en", "d", 0)]
    return data


def test_mix_of_repeated_rows_and_giants(spark):
    data = mixed_sources()
    times, sizes, targets = models.mix([(k, t, s) for k, t, _, s, _ in data])
    want = Counter((k, models.n_words(t), s, round(g, 6), models.n_words(t) * n) for (k, t, *_), n, s, g in zip(data, times, sizes, targets, strict=True))
    got = mixing.mix(frame(spark, data, clash=True)).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == want
    taken, target = Counter(), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    # the source of one repeated row comes within one row of its target, the others closer
    assert abs(taken[40_000] - target[40_000]) <= 100
    assert all(abs(taken[s] - t) <= max(5, 0.002 * t) for s, t in target.items() if s != 40_000)


def test_samples_are_bounded_and_stay(spark):
    df = spark.range(50_000).select((F.col("id") % 9_000).alias("doc_id"))
    found = sampled(df, 1_000, "doc_id")
    assert "TakeOrdered" not in found._jdf.queryExecution().toString()
    ids = {r[0] for r in found.collect()}
    assert 950 <= len(ids) == found.count() <= 1_000
    assert ids == {r[0] for r in sampled(df.repartition(7), 1_000, "doc_id").collect()}
    assert sampled(df, 9_000, "doc_id").count() == 9_000 and sampled(df.limit(0), 5, "doc_id").isEmpty()
    hot = df.withColumn("doc_id", F.when(F.col("doc_id") < 8_900, 1).otherwise(F.col("doc_id")))
    assert 50 <= sampled(hot, 60, "doc_id").count() <= 60


def test_one_labelled_id_on_many_documents(spark, monkeypatch):
    """A labelled id that a third of all rows and more carry is one row of what a model is fitted on."""
    seen = []
    for module in (quality_classifier, toxicity):
        fit = module.fit
        monkeypatch.setattr(module, "fit", lambda *a, fit=fit: seen.append(sum(len(x) for x in a[: 2 if len(a) > 2 else 1])) or fit(*a))
    data = [(k, t, *more) for k, t, *more in real(100)]
    copies = spark.range(20_000).select(F.lit(data[0][0]).alias("doc_id"), F.concat(F.lit("one and the same "), F.col("id")).alias("text"))
    docs = frame(spark, data).select("doc_id", "text").unionByName(copies)
    labels = frame(spark, data).select("doc_id", (F.col("doc_id") % 2).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    quality_classifier.learn(docs, labels, most=50)
    toxicity.learn(docs, labels, positives=20, unlabelled=40)
    assert seen[0] <= 50 and seen[1] <= 60


def test_verdicts_equal_the_plain_estimate(spark):
    """Groups with estimates of their own, by language and of all documents; copies, junk and short texts in each."""
    words = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(2000)]

    def text(n, junk=0.0):
        w = [R.choice(words) for _ in range(n)]
        return "\n".join(" ".join((x.capitalize() if R.random() < 0.1 else x) + ("#" if R.random() < junk else "!" * (R.random() < 0.03)) for x in w[i : i + 9]) for i in range(0, n, 9))

    data = []
    for lang, source, n in (("en", "a", 260), ("en", "b", 30), ("de", "a", 150), ("de", None, 90), (None, "z", 25)):
        data += [(len(data) + i, text(R.randint(40, 150), 0.3 if i % 9 == 0 else 0.0), lang, source, 1) for i in range(n)]
        data += [data[-1]] * 12
    data += [(90_001, None, "en", "a", 0), (90_002, "", None, None, 0)]
    want = Counter((k, keep) for (k, *_), keep in zip(data, models.quality([(t, lang, s) for _, t, lang, s, _ in data]), strict=True))
    got = quality_rules.judged(frame(spark, data, clash=True), ["doc_id"]).select("row.doc_id", "kept").collect()
    assert Counter(map(tuple, got)) == want
    assert 50 < sum(n for (_, keep), n in want.items() if not keep) < 400


def test_fusion_equals_plain_python(spark):
    pages, docs = table(spark, DATA, "pages").limit(300), table(spark, DATA, "documents")
    odd = [(1, None, None), (2, "https://x.de/", "<html lang=fr><p>ein Text</p>"), (2, "https://x.de/", "<html lang=fr><p>ein Text</p>"), (3, "odd", "")]
    pages = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id bigint, url string, html string"))
    model = language_id.learn(docs)
    own = [tuple(r) for r in language_id.read(pages, model).collect()]
    want = models.languages(own, model.languages, language_id.SUFFIX_LANGUAGE)
    got = [(r["page_id"], r["lang"], round(r["probability"], 6)) for r in language_id.identified(pages, docs).collect()]
    assert Counter(got) == Counter((p[0], lang, round(q, 6)) for p, (lang, q) in zip(own, want, strict=True))


def test_document_statistics():
    for _, t, *_ in [*real(40), (0, None), (0, ""), (0, "A a\n\nA a\nB! #b 12"), (0, "X X X\tYY")]:
        s, w = t or "", re.findall(r"\S+", t or "")
        lines = [x for x in s.split("\n") if re.search(r"\S", x)]
        n, one = len(w), max(len(w), 1)
        want = [
            *(np.log(len(s) + 1), np.log(n + 1), (len(s) - n) / one, len(set(w)) / one, len({(a, b) for a, b in zip(w, w[1:])}) / max(n - 1, 1)),
            *(sum(w[i] == w[i - 1] for i in range(1, n)) / one, sum(x == x.upper() != x.lower() for x in w if len(x) > 1) / one),
            *(sum(x[0] != x[0].lower() for x in w) / one, max((w.count(x) for x in set(w)), default=0) / one, len(set(lines)) / max(len(lines), 1)),
            *(n / max(len(lines), 1), len(re.findall("[0-9]", s)) / max(len(s), 1)),
        ]
        assert np.allclose(quality_classifier.statistics(t)[:12], want)
        marks = [len(re.findall(re.escape(c), s)) / one for c in "#*$%&|<>!?.,;:-_/=\"'()[]{}"]
        assert np.allclose(quality_classifier.statistics(t)[13:], marks)


def risk(w, b, positive, unlabelled, prior):
    """The non-negative risk with the logistic loss, and the weights' penalty."""
    loss = lambda z: np.log1p(np.exp(-z))
    zp, zu = positive @ w + b, unlabelled @ w + b
    return prior * loss(zp).mean() + max(0, loss(-zu).mean() - prior * loss(-zp).mean()) + toxicity.L2 / 2 * (w @ w)


def test_the_fit_has_the_least_risk_around():
    r = np.random.default_rng(4)
    positive = r.normal(1, 1, (800, 3))
    unlabelled = np.concatenate([r.normal(1, 1, (300, 3)), r.normal(-0.5, 1, (900, 3))])
    w, b = toxicity.fit(positive, unlabelled, 0.25, steps=1500)
    least = risk(w, b, positive, unlabelled, 0.25)
    assert least < risk(np.zeros(3), 0.0, positive, unlabelled, 0.25) - 0.05
    for _ in range(300):
        dw, db = r.normal(0, 0.3, 3), r.normal(0, 0.3)
        assert risk(w + dw, b + db, positive, unlabelled, 0.25) > least - 2e-3


def test_document_counts_cover_all_documents(spark):
    docs = frame(spark, clash=True)
    texts = [r["text"] for r in docs.select("text").collect()]
    own = {h for t in texts[:30] for w in toxicity.WORD.findall((t or "").lower()) for h in toxicity.hashes(w)}
    places = {h: i for i, h in enumerate(sorted(own))}
    want = np.zeros(len(places))
    for t in texts:
        for h in {h for w in toxicity.WORD.findall((t or "").lower()) for h in toxicity.hashes(w)} & own:
            want[places[h]] += 1
    assert (toxicity.document_counts(docs, places) == want).all()


def test_the_risk_covers_all_rows(spark):
    """The sums equal numpy's over dense vectors and are the same to the last bit however rows are partitioned."""
    docs = frame(spark, clash=True)
    texts = [r["text"] for r in docs.select("text").collect()]
    places = {h: i for i, h in enumerate(sorted({h for t in texts[:30] for w in toxicity.WORD.findall((t or "").lower()) for h in toxicity.hashes(w)}))}
    rows = toxicity.vectors(docs, places, ["doc_id"])
    own = np.random.default_rng(6)
    w, b = own.normal(0, 0.5, len(places) + 1), -0.3
    n, loss, gradient = toxicity.sums_over(rows, w, b)
    x = np.zeros((len(texts), len(w)))
    for i, t in enumerate(texts):
        found = toxicity.WORD.findall((t or "").lower())
        for word in found:
            for h in toxicity.hashes(word):
                if h in places:
                    x[i, places[h]] += 1
        x[i] = np.log1p(x[i]) * 3 / (len(found) + 20) ** 0.25
        x[i, -1] = np.log(len(found) + 10) / 10
    z = x @ w + b
    p = 1 / (1 + np.exp(-z))
    assert n == len(texts) and np.isclose(loss, np.log1p(np.exp(z)).sum(), rtol=1e-4)
    assert np.allclose(gradient, [*(p @ x), p.sum()], rtol=1e-3, atol=1e-2)
    for parts in (1, 7):
        again = toxicity.sums_over(rows.repartition(parts), w, b)
        assert again[:2] == (n, loss) and (again[2] == gradient).all()
    scores = [r["score"] for r in toxicity.score(docs, toxicity.Model(places, w, b)).collect()]
    assert np.allclose(scores, p)
    assert toxicity.sums_over(rows.limit(0), w, b)[:2] == (0, 0)


def test_steps_over_all_rows_from_a_sample():
    """From a start on few unlabelled rows, the risk over all of them comes to its least, and its bracket isn't negative."""
    r = np.random.default_rng(5)
    for seen in (40, 400):
        positive = r.normal(1, 1, (800, 3))
        unlabelled = np.concatenate([r.normal(1, 1, (1000, 3)), r.normal(-0.5, 1, (3000, 3))])
        sample = r.permutation(unlabelled)[:seen]

        def sums(w, b, unlabelled=unlabelled):
            z = unlabelled @ w + b
            p = toxicity.sigmoid(z)
            return len(z), np.logaddexp(0, z).sum(), np.append(p @ unlabelled, p.sum())

        start = toxicity.fit(positive, sample, 0.25)
        w, b = toxicity.refined(*start, sums, positive, sample, 0.25)
        zp, zu = positive @ w + b, unlabelled @ w + b
        assert np.logaddexp(0, zu).mean() - 0.25 * np.logaddexp(0, zp).mean() >= 0
        least = risk(w, b, positive, unlabelled, 0.25)
        assert least <= risk(*start, positive, unlabelled, 0.25) + 1e-9
        for _ in range(300):
            assert risk(w + r.normal(0, 0.3, 3), b + r.normal(0, 0.3), positive, unlabelled, 0.25) > least - 2e-3


def test_a_negative_bracket_is_led_back():
    """A prior far above the share of hidden positives: the start's bracket is negative, and the steps bring it back."""
    r = np.random.default_rng(8)
    positive, unlabelled = r.normal(2, 1, (300, 4)), r.normal(-1, 1, (3000, 4))

    def sums(w, b):
        z = unlabelled @ w + b
        return len(z), np.logaddexp(0, z).sum(), np.append(toxicity.sigmoid(z) @ unlabelled, toxicity.sigmoid(z).sum())

    def bracket(w, b):
        return np.logaddexp(0, unlabelled @ w + b).mean() - 0.5 * np.logaddexp(0, positive @ w + b).mean()

    assert bracket(np.full(4, 0.7), 0.0) < 0
    found = toxicity.refined(np.full(4, 0.7), 0.0, sums, positive, unlabelled[:500], 0.5)
    assert bracket(*found) >= 0 and (positive @ found[0] + found[1] > 0).mean() > 0.9 > 0.1 > (unlabelled @ found[0] + found[1] > 0).mean()
