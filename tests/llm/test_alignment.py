"""Alignment of two tokenizers against a plain model: the tokenizers' own libraries, and pairs by comparing byte ranges."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from needledrop.llm import alignment
from needledrop.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(ids and byte ranges of A, those of B), or none."""
    t, s = libraries
    if not text:
        return [], []
    data, out = b" " + text.encode(), []
    for ids, table in ((t.encode(" " + text, add_special_tokens=False).ids, alignment.ByteLevel(A).table), (s.encode(text), alignment.Pieces(B).table)):
        at, ranges = 0, []
        for i in ids:
            ranges.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != data:
            return [], []
        out.append(ranges)
    return out[0], out[1]


def overlaps(xs, ys):
    """All pairs of ids whose ranges overlap; both lists are in order."""
    out, i = [], 0
    for y, s, e in ys:
        while xs[i][2] <= s:
            i += 1
        j = i
        while j < len(xs) and xs[j][1] < e:
            out.append((y, xs[j][0]))
            j += 1
    return out


def group_line(xs, ys):
    """The tokens of both between common ends, and how many groups there are."""
    common, cut = sorted({e for _, _, e in xs} & {e for _, _, e in ys}), lambda ts: iter(ts)
    left, right, out = cut(xs), cut(ys), []
    for end in common:
        sides = []
        for ts in (left, right):
            ids = []
            for i, _, e in ts:
                ids.append(str(i))
                if e == end:
                    break
            sides.append(",".join(ids))
        out.append("|".join(sides))
    return ";".join(out), len(out)


def model(libraries, rows):
    each = [(d, *tokens(libraries, text)) for d, text in rows]
    pairs = [overlaps(xs, ys) for _, xs, ys in each]
    counts = Counter(p for ps in pairs for p in ps)
    best = {}
    for (b, _), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (d, xs, ys), ps in zip(each, pairs, strict=True):
        line, n_groups = group_line(xs, ys)
        digest = hashlib.sha256(line.encode()).hexdigest() if line else ""
        out.append((d, len(xs), len(ys), n_groups, len(ps), sum(counts[p] == best[p[0]] for p in ps), sum(counts[p] for p in ps), digest))
    return sorted(out, key=repr)


ODD = [
    (1, "The quick brown fox."), (2, None), (3, ""), (4, " "), (5, "a  b\n\n  c \t d "), (6, "<|endoftext|> <s> </s> <0x41>"), (7, "space ▁ mark"),
    (8, "中文 \U0001f600‍\U0001f525 é é"), (9, "x" * 5000), (10, "word " * 3000), (1, "The quick brown fox."), (None, "no id"), (11, "\x00\x01 　end"),
    (12, "it's we'll  'd"), (13, "▁"), (14, "tail   "), (15, "123456 7890"),
]


def found(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, key string").repartition(3)
    return sorted(map(tuple, alignment.aligned(df, A, B).collect()), key=repr)


def test_equals_the_plain_model(spark, libraries, monkeypatch):
    assert found(spark, ODD) == model(libraries, ODD)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_whole_documents(spark, libraries):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == model(libraries, rows)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abé \n\t's1,▁ 中<>") | st.characters(codec="utf-8"), max_size=40))
def test_encoders_equal_the_libraries(libraries, text):
    if text:
        own = alignment.ByteLevel(A).encoder()(text)
        assert own == libraries[0].encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert alignment.Pieces(B).encoder()(text) == libraries[1].encode(text)


def test_shards_hold_sums_over_blocks_and_batches(spark, tmp_path):
    """Runs of a key that go on over batches and blocks are summed; lookups cross shards and blocks."""
    import random

    random.seed(3)
    rows = [(random.randrange(40) << 32 | random.randrange(50), random.randrange(1, 9)) for _ in range(5000)]
    partial = spark.createDataFrame(rows, "key bigint, n bigint").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        listed = alignment.shards(partial, f"file://{tmp_path}/s").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = Counter()
    for k, n in rows:
        want[k] += n
    import numpy as np

    keys = np.array(sorted(want), np.int64)
    lookup = alignment.Lookup(f"file://{tmp_path}/s", sorted((r["first"], r["path"]) for r in listed))
    assert lookup.counts(keys).tolist() == [want[k] for k in keys.tolist()]
    most = Counter()
    for r in listed:
        for b, n in zip(r["b"], r["most"], strict=True):
            most[b] = max(most[b], n)
    assert most == {b: max(n for k, n in want.items() if k >> 32 == b) for b in {k >> 32 for k in want}}


def test_files_are_read_once_by_each_process():
    assert alignment.ByteLevel(A).table is alignment.ByteLevel(A).table
    assert alignment.Pieces(B).table is alignment.Pieces(B).table


def test_pieces_cost_no_more_than_byte_level_tokens(spark):
    """What a task hasn't seen before costs as little as on the other side: the CPU budget was missed by it."""
    import time

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").select("text").limit(1500).collect()
    spent = []
    for side in (alignment.ByteLevel(A), alignment.Pieces(B)):
        encode = side.encoder()
        encode("warm")
        start = time.process_time()
        for r in rows:
            encode(r["text"])
        spent.append(time.process_time() - start)
    assert spent[1] < 1.5 * spent[0]


def test_pieces_by_ranks_equal_the_library(libraries):
    """Runs of spaces, whose pieces share one score; characters of no piece, whole or in part; very long words."""
    import random

    encode, own = alignment.Pieces(B).encoder(), alignment._piece_ranks(B)
    assert own is not None
    random.seed(7)
    texts = [" " * i + end for i in range(1, 140) for end in ("", "x", "\n", "中", "the end ")]
    texts += [chr(c) + " a" + chr(c) + chr(c + 1) + "b" for c in range(0x80, 0x30000, 37) if not 0xD7FF <= c <= 0xDFFF and "▁" not in (chr(c), chr(c + 1))]
    texts += ["ab" * 5000, "中" * 3000, "é" * 777 + " " * 333, "\n" * 500, "<s><0x0A></s><unk>"]
    texts += ["".join(random.choices("aeinst中文日é\u4e03\U0001f600\u0c15 \n.,'10<>_-", k=60)) for _ in range(3000)]
    texts += [libraries[1].id_to_piece(i).replace("▁", " ") for i in range(libraries[1].vocab_size())]
    assert [t for t in texts if encode(t) != libraries[1].encode(t)] == []
    # some characters share their first bytes with a piece's character, but are in none
    assert any(len(x) > 1 for x in own[1])


def test_texts_with_the_mark_of_a_space_have_no_tokens_and_others_beside_them_keep_theirs(spark, libraries):
    rows = [(i, t) for i, t in enumerate(["a▁b", "plain text", "", "▁", "é▁ x", None, "more  of it\n"])]
    assert found(spark, rows) == model(libraries, rows)
