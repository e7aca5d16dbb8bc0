"""Media containers: an independent reader of boxes, and files that ask for more than they hold."""

import hashlib
import resource
import struct

import pytest

from needledrop.llm import media


def leaves(data, at=0, end=None, into=None):
    """Every box without boxes in it, by type; a reader of its own."""
    into, end = {} if into is None else into, len(data) if end is None else end
    while at < end:
        size, kind, lead = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, lead = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
            leaves(data, at + lead, at + size, into)
        else:
            into[kind] = data[at + lead : at + size]
        at += size
    return into


def numbers(body, width, at=8, each=1):
    n = int.from_bytes(body[at - 4 : at], "big")
    return [int.from_bytes(body[at + i * width : at + (i + 1) * width], "big") for i in range(n * each)]


def described(data):
    """(payload, feature) by walking chunk after chunk."""
    b = leaves(data)
    scale, ticks = struct.unpack_from(">II", b[b"mdhd"], 12)
    size, n = struct.unpack_from(">II", b[b"stsz"], 4)
    starts, runs, keys = numbers(b[b"co64"], 8), numbers(b[b"stsc"], 4, each=3), numbers(b[b"stss"], 4)
    of_run, samples = {runs[i]: runs[i + 1] for i in range(0, len(runs), 3)}, []
    held = 0
    for chunk, start in enumerate(starts, 1):
        held = of_run.get(chunk, held)
        samples += [start + k * size for k in range(held)]
    assert len(samples) == n
    ranges = [f"{samples[k - 1]}-{samples[k - 1] + size}" for k in keys]
    return b"".join(data[o : o + size] for o in samples), f"raw:{round(1000 * ticks / scale)}ms:{n}:{len(keys)}:{ranges[0]},{ranges[-1]}"


TEXTS = ["", "short", "x" * 192, "y" * 193, "é\U0001f600" * 5000, "z" * (192 * 64), "z" * (192 * 64 * 3 + 1), "short"]


def test_round_trip_by_an_independent_reader(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id bigint, text string")
    files = {r["doc_id"]: bytes(r["media"]) for r in media.stored(df).collect()}
    for r in media.round_trip(df).collect():
        data = files[r["doc_id"]]
        payload, feature = described(data)
        text = (TEXTS[r["doc_id"]] if r["doc_id"] < len(TEXTS) else "").encode()
        assert payload == text + b" " * (len(payload) - len(text)) and len(payload) == max(1, -(-len(text) // 192)) * 192
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(data), hashlib.sha256(data).hexdigest(), feature)
        assert (r["payload_bytes"], r["payload_sha256"], r["n_bytes"]) == (len(payload), hashlib.sha256(payload).hexdigest(), len(text))


def test_equal_texts_have_equal_values(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in media.round_trip(df).collect()}
    assert got[1] == got[7] and got[0] == got[99] and len(set(got.values())) == len(TEXTS) - 1


def file(stsz, stsc, stco, stss=None, data=b"d" * 64):
    box, full, num = media.box, media.full, lambda *x: b"".join(n.to_bytes(4, "big") for n in x)
    more = [full(b"stss", num(len(stss), *stss))] if stss else []
    table = box(b"stbl", full(b"stsd", num(1), box(b"raw ", bytes(8))), full(b"stsz", num(*stsz)), full(b"stsc", num(len(stsc) // 3, *stsc)), full(b"stco", num(len(stco), *stco)), *more)
    moov = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", num(0, 0, 100, 50)), box(b"minf", table))))
    return moov + box(b"mdat", data)


BAD = {
    "samples larger than the file": file((1, 0xFFFFFFFF), (1, 1, 1), (8,)),
    "a first chunk far away": file((1, 2), (1, 1, 1, 0x80000000, 1, 1), (8,)),
    "runs that go back": file((1, 2), (5, 1, 1, 2, 1, 1), (8, 9)),
    "no first run": file((1, 1), (2, 1, 1), (8, 9)),
    "more in chunks than samples": file((1, 1), (1, 0xFFFFFFFF, 1), (8,)),
    "chunks without runs": file((1, 1), (), (8,)),
    "a keyframe that is no sample": file((1, 1), (1, 1, 1), (8,), [9]),
}


@pytest.fixture
def little_memory():
    before = resource.getrlimit(resource.RLIMIT_AS)
    used = int(open("/proc/self/statm").read().split()[0]) * 4096
    resource.setrlimit(resource.RLIMIT_AS, (used + (1 << 30), before[1]))
    yield
    resource.setrlimit(resource.RLIMIT_AS, before)


@pytest.mark.parametrize("name", BAD)
def test_crafted_files_are_refused(name, little_memory):
    with pytest.raises(ValueError):
        media.probe(BAD[name])


def test_chunks_without_samples(little_memory):
    at = len(file((4, 3), (1, 0, 1, 2, 3, 1, 3, 0, 1), (0, 0, 0))) - 64
    (t,) = media.probe(data := file((4, 3), (1, 0, 1, 2, 3, 1, 3, 0, 1), (0, at, 0), data=b"abcdefghijkl" + b"." * 52))
    assert media.payload(data, t) == b"abcdefghijkl" and t.offsets.tolist() == [at, at + 4, at + 8]
    (t,) = media.probe(file((0, 0), (), ()))
    assert len(t.sizes) == 0


def test_fragments_with_endless_samples(little_memory):
    box, full, num = media.box, media.full, lambda *x: b"".join(n.to_bytes(4, "big") for n in x)
    trak = box(b"trak", full(b"tkhd", num(0, 0, 1, 0, 0)), box(b"mdia", full(b"mdhd", num(0, 0, 100, 0)), box(b"minf", box(b"stbl", full(b"stsd", num(1), box(b"raw ", bytes(8))), full(b"stsz", num(1, 0)), full(b"stsc", num(0)), full(b"stco", num(0))))))
    runs = b"".join(full(b"trun", num(300)) for _ in range(3000))
    data = box(b"moov", trak) + box(b"moof", box(b"traf", full(b"tfhd", num(1)), runs))
    with pytest.raises(ValueError):
        media.probe(data)


def test_described_gives_null(spark):
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(BAD.values())], "doc_id bigint, media binary")
    assert [r["tracks"] for r in media.described(df).collect()] == [None] * len(BAD)
