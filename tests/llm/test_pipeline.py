"""The pipeline, stage by stage, against plain Python on what its predecessor kept."""

import re
from collections import Counter

import corpus_pipeline
import models
from samples import DATA, frame
from test_corpus_operators import components, fingerprint
from test_text_operators import PATH, base_secrets
from tokenizers import Tokenizer

from needledrop.llm.common import table, written


KINDS = ["assign", "access", "hex", "hub_token", "chat_token"]
MORE = [("hub_token", "gh[oprsu]_[A-Za-z0-9]+", 40), ("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 24)]


def redacted(text):
    """A text with its secrets replaced: where spans overlap, their union is named by the first, then by the kinds' order."""
    spans = [(s, k, e) for s, k, e in base_secrets(text)]
    spans += [(m.start(), KINDS.index(n), m.end()) for n, p, least in MORE for m in re.finditer(p, text, re.A) if len(m[0]) >= least]
    out, at = "", 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += text[at:s] + f"[{KINDS[k]}]"
        at = max(at, e)
    return out + text[at:]


def test_stages(spark):
    """Each stage's rows, whole, from those of the stage before."""
    docs = table(spark, DATA, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, DATA), name)
        seen[name] = (before.collect(), docs.collect())
        assert name == "bpe" or docs.columns == columns

    before, after = seen["quality_rules"]
    keep = models.quality([(r["text"], r["lang"], r["source"]) for r in before])
    assert Counter(after) == Counter(r for r, k in zip(before, keep, strict=True) if k)

    before, after = seen["near_duplicates"]
    groups = components([(r["doc_id"], fingerprint(r["text"])) for r in before])
    assert Counter(after) == Counter(r for r in before if r["doc_id"] in {c for _, _, c in groups})

    before, after = seen["secrets"]
    changed = lambda r: (r["doc_id"], redacted(r["text"]), r["lang"], r["source"], len(redacted(r["text"])))
    assert Counter(map(tuple, after)) == Counter(map(changed, before))
    assert any("[" in r["text"] for r in after)

    before, after = seen["mixing"]
    times, *_ = models.mix([(r["doc_id"], r["text"], r["source"]) for r in before])
    assert Counter(after) == Counter({r: n for r, n in zip(before, times, strict=True) if n})

    before, after = seen["bpe"]
    library = Tokenizer.from_file(PATH)
    library.no_truncation(), library.no_padding()
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in before)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after) == want and all(len(r["ids"]) == r["n_tokens"] for r in after)


def test_edge_cases(spark):
    for data in (None, []):
        docs = frame(spark, data, clash=True)
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, DATA), name)
        assert docs.count() >= 0


def test_five_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mixing", "bpe"]
