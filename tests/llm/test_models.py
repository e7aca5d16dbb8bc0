"""The trained operators: held-out accuracy on the real tables, edge cases on small ones."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from samples import CLASHING, DATA, frame

from needledrop.llm import language_id, quality_classifier, toxicity
from needledrop.llm.common import table

BIG = "/root/testdata/sf0.01"


def scored(spark, module, label, modulus, held):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    rows = module.classified(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    return [(r[label], r["predicted"]) for r in rows if r["held_out"]]


def test_quality_held_out(spark):
    found = scored(spark, quality_classifier, "quality", 3, 1)
    assert sum(a == b for a, b in found) >= 0.97 * len(found)


def test_toxicity_held_out(spark):
    found = scored(spark, toxicity, "toxic", 5, 0)
    assert sum(a == b for a, b in found) >= 0.93 * len(found)


def test_labels_of_held_out_rows_have_no_part(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    for module, label, modulus, held in ((quality_classifier, "quality", 3, 1), (toxicity, "toxic", 5, 0)):
        out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held
        turned = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = (sorted(map(tuple, module.classified(docs, x).collect())) for x in (labels, turned))
        assert a == b


def test_edge_cases(spark):
    labels = table(spark, DATA, "labels")
    docs = frame(spark, clash=True)
    for module in (quality_classifier, toxicity):
        found = module.classified(docs, labels.withColumns({c: F.lit(1) for c in CLASHING})).collect()
        assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
        none = module.classified(docs, labels.limit(0)).collect()
        assert len({r["score"] for r in none}) == 1
        assert module.classified(frame(spark, []), labels).isEmpty()


def test_trees_fit_a_known_rule():
    r = np.random.default_rng(1)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = quality_classifier.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    # the flattened trees give what walking each tree by itself gives
    one, z = x[2500], model.prior
    for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(one[f[node]] > t[node])
        z += v[node - len(f)]
    assert abs(z - model.logits(x[2500:2501])[0]) < 1e-9


def test_non_negative_risk_finds_the_hidden_positives():
    r = np.random.default_rng(2)
    positive, negative = r.normal(2, 1, (3000, 2)), r.normal(-1, 1, (3000, 2))
    unlabelled = np.concatenate([positive[1000:1400], negative[:1600]])
    w, b = toxicity.fit(positive[:1000], unlabelled, 0.2)
    assert (positive[2000:] @ w + b > 0).mean() > 0.9 and (negative[2000:] @ w + b > 0).mean() < 0.05


def page(lang, body):
    return f"<html{f' lang={lang}' if lang else ''}><script>var the = 1;</script><nav>und der die das</nav><p>{body}</p></html>"


def test_languages(spark):
    pages, docs = table(spark, DATA, "pages"), table(spark, DATA, "documents")
    found = language_id.identified(pages, docs).join(pages, "page_id")
    right = found.where(F.col("lang") == F.regexp_extract("url", "//[^/]+/(..)/", 1)).count()
    assert right >= 0.98 * pages.count() == 0.98 * found.count()


def test_language_evidence(spark):
    docs = table(spark, DATA, "documents")
    german = docs.where("lang = 'de' and length(text) > 400").first()["text"]
    rows = [(i, f"https://de.example.org/{i}", page("de", german)) for i in range(20)]
    rows += [(100, "https://de.example.org/x", ""), (101, None, None), (102, "odd", page("de", "")), (103, "https://a.example.fr/", ""), (104, "https://de.example.org/y", page("en", german))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in CLASHING})
    got = {r["page_id"]: r for r in language_id.identified(pages, docs).collect()}
    assert len(got) == len(rows) and got[0]["lang"] == "de"
    assert got[100]["lang"] == "de" and got[100]["text_lang"] is None  # by its host
    assert got[101]["lang"] is not None and got[101]["host"] == ""
    assert got[103]["lang"] == "fr"  # by its suffix
    assert got[104]["lang"] == "de" and got[104]["declared"] == "en"  # the text outweighs the declaration
    assert language_id.identified(pages.limit(0), docs).isEmpty()
    assert {r["lang"] for r in language_id.identified(pages, docs.limit(0)).collect()} == {None}
