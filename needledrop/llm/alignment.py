"""Alignment of two tokenizers: which tokens of one overlap which of the other, and how often in the whole corpus.

Every text is encoded once by both; the ids are written. A pair of overlapping tokens is packed into one int64 (id of B, id of A).
Each task counts its pairs by ``np.unique``, in bounded blocks; the counts are dealt by ranges of keys, sorted, and runs of a key
are summed, so that a task turns its range into one sorted shard: an Arrow file in the shared folder. Texts then look their pairs
up by binary search in the shards, which are memory-mapped, so that a worker only holds the pages it touches. Nothing but the
shards' bounds and one number for each id of B (as many as B has tokens) goes to the driver and to tasks.

* Texts that are null, empty, or that the tokens' joined bytes don't give back have no tokens: zeros, and '' for the digest.
* Rows that repeat count each time. Empty tables give empty results. Other columns are not looked at.
* Where the shared folder is no mounted file system, a shard is read into memory when it is first needed.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import written
from needledrop.plans.storage import shared_dir

#: Fixed value: how the byte-level tokenizer cuts a text before it merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: what a piece model encodes on its own, a run of spaces and what follows it.
WORDS = " +[^ ]*"
#: Bytes of text that are aligned at a time, and pairs that a task counts at a time.
SLICE_BYTES, BLOCK_PAIRS = 2_000_000, 4_000_000
SHIFT, SPACE = 32, 0x20
#: A model that normalises texts doesn't give this one back.
PROBE = "\ufb01 \u2460  A\u030a\u212b \uff21\t\n x  "


def id_type(table: list[bytes]) -> type:
    return np.uint16 if len(table) <= 1 << 16 else np.uint32


@lru_cache(maxsize=4)
def _byte_level(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ids by bytes and bytes by id of a tokenizer's JSON file, read once by each process."""
    import json

    model = json.load(open(path, encoding="utf-8"))["model"]
    # printable bytes stand for themselves in the file, the others for the characters from U+0100 on, in order
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ids = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in byte for c in piece)}
    merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"])
    if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(model["merges"]))):
        raise ValueError(f"{path}: tokens are not numbered in the order of their merges")
    ids = {k: i for k, i in ids.items() if i < 256 + len(model["merges"])}
    table = [b""] * (max(model["vocab"].values()) + 1)
    for k, i in ids.items():
        table[i] = k
    return ids, table


@lru_cache(maxsize=4)
def _pieces(path: str) -> tuple:
    """A sentencepiece model and the bytes of its pieces, read once by each process."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    of = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
    return m, [of(i) for i in range(m.vocab_size())]


@lru_cache(maxsize=4)
def _piece_ranks(path: str) -> tuple[dict[bytes, int], list[list[int]]] | None:
    """A piece model as byte-level ranks, and each rank's ids; none for a model whose results those would not give.

    Where a piece's score is its place among the merges, the model joins the two neighbours whose piece scores highest, the
    leftmost first, and so does byte-level BPE by ranks. That starts from bytes instead of characters, so the bytes of a
    character are joined first, in order, by ranks below all pieces; what no piece holds in the end is its bytes' own pieces.
    Pieces of several spaces have no rank: they come last, with one score for all, where the leftmost of equals is joined.
    """
    m, table = _pieces(path)
    ids = range(m.vocab_size())
    raw = {table[i]: i for i in ids if m.is_byte(i)}
    pieces = {i: table[i].decode() for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    runs = {i for i, p in pieces.items() if len(p) > 1 and not p.strip(" ")}
    merged = sorted((i for i, p in pieces.items() if len(p) > 1 and i not in runs), key=lambda i: -m.get_score(i))
    scores = [m.get_score(i) for i in merged]
    words = [i for i in merged if pieces[i][0] == " "]
    if not (
        len(raw) == 256
        and len(set(pieces.values())) == len(pieces)
        and not any(m.is_unused(i) for i in pieces)
        and not any(re.search("[^ ] |  [^ ]", p) for p in pieces.values())  # a space only begins a piece, and two make it a run
        and len(set(scores)) == len(scores)
        and all(m.get_score(i) < scores[-1] for i in runs)
        and all(x == int(x) for x in scores)
        and b"".join(table[i] for i in m.encode(PROBE)) == b" " + PROBE.encode()
        and m.encode([pieces[i][1:] for i in words], num_threads=1) == [[i] for i in words]
    ):
        return None
    ranks = {bytes([k]): k for k in range(256)}
    letters = sorted({c.encode() for p in pieces.values() for c in p if c > "\x7f"})
    for n in (2, 3, 4):
        for c in letters:
            if len(c) >= n:
                ranks.setdefault(c[:n], len(ranks))
    for i in merged:
        ranks.setdefault(table[i], len(ranks))
    own = {table[i]: i for i in pieces if i not in runs}
    return ranks, [[own[x]] if x in own else [raw[bytes([k])] for k in x] for x in ranks]


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    if path.endswith(".json"):
        return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=_byte_level(path)[0], special_tokens={})
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=_piece_ranks(path)[0], special_tokens={})


@dataclass(frozen=True)
class ByteLevel:
    """Byte-level BPE from a tokenizer's JSON file; special tokens' strings are plain text."""

    path: str

    @property
    def table(self) -> list[bytes]:
        return _byte_level(self.path)[1]

    def arrays(self) -> Callable[[str], np.ndarray]:
        encode, kind = _encoding(self.path).encode_ordinary, id_type(self.table)
        return lambda text: np.array(encode(" " + text), kind)

    def encoder(self) -> Callable[[str], list[int]]:
        of = self.arrays()
        return lambda text: of(text).tolist()


@dataclass(frozen=True)
class Pieces:
    """A sentencepiece model with byte fallback, which adds the first space itself.

    No piece has a space behind another character, so a run of spaces and what follows is encoded on its own, by ranks of
    bytes (``_piece_ranks``); the library encodes texts that hold its own mark for a space, and all texts for other models.
    """

    path: str

    @property
    def table(self) -> list[bytes]:
        return _pieces(self.path)[1]

    def arrays(self) -> Callable[[str], np.ndarray]:
        plain, kind, found = _pieces(self.path)[0].encode, id_type(self.table), _piece_ranks(self.path)
        if found is None:
            return lambda text: np.array(plain(text), kind)
        ids, encode = found[1], _encoding(self.path).encode_ordinary
        one = np.array([x[0] for x in ids], kind)
        several = np.array([len(x) > 1 for x in ids])
        run = lru_cache(maxsize=256)(lambda n: plain(" " * (n - 1)) if n > 1 else ids[SPACE])

        def spread(ranks: list[int]) -> Iterator[int]:
            """The ids of ranks; spaces side by side, which no word took, are encoded together."""
            spaces = 0
            for r in ranks:
                if r == SPACE:
                    spaces += 1
                    continue
                if spaces:
                    yield from run(spaces)
                    spaces = 0
                yield from ids[r]
            if spaces:
                yield from run(spaces)

        def of(text: str) -> np.ndarray:
            if "▁" in text:
                return np.array(plain(text), kind)
            text = " " + text
            ranks = np.array(encode(text), np.uint32)
            if "  " in text or several[ranks].any():
                return np.array(list(spread(ranks.tolist())), kind)
            return one[ranks]

        return of

    def encoder(self) -> Callable[[str], list[int]]:
        of = self.arrays()
        return lambda text: of(text).tolist()


def tokenizer(path: str) -> ByteLevel | Pieces:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces between any two token ends stop, whether both tokens stop there, the packed pair of each piece, and which
    pieces A's and B's tokens end with.

    Tokens overlap in one piece at most, so each piece is one pair.
    """
    mark = np.zeros(int(ends_a[-1]) + 1, np.uint8)
    mark[ends_a] = 1
    mark[ends_b] += 2
    stops = np.flatnonzero(mark)
    kind = mark[stops]
    in_a, in_b = (kind & 1).astype(bool), kind >= 2
    at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    keys = (b[at_b].astype(np.int64) << SHIFT) | a[at_a]
    return stops, in_a & in_b, keys, np.flatnonzero(in_a), np.flatnonzero(in_b)


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``SLICE_BYTES``, or of one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _joined(each: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts one after the other, and how many each has."""
    return np.frombuffer(b"".join(each), kind), np.array([len(x) // np.dtype(kind).itemsize for x in each], np.int64)


def _upto(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _taken(values: pa.Array, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The values at some places, joined, and where each begins, with the end."""
    found = values.take(pa.array(at))
    if not len(found):
        return b"", np.zeros(1, np.int64)
    _, offsets, data = found.buffers()
    return data.to_pybytes(), np.frombuffer(offsets, np.int64, len(found) + 1)


ENCODED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, ids_a binary, ids_b binary"


def encoded(docs: DataFrame, a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, ids_a, ids_b) of every row of ``docs`` (doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(ENCODED)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [(t.arrays(), pa.array(t.table, pa.large_binary()), np.array([len(x) for x in t.table], np.int64), id_type(t.table)) for t in (a, b)]
        wide = max(len(a.table), len(b.table))
        shown = pa.array([f"{i}{sep}" for sep in ",|;" for i in range(wide)], pa.large_string())

        def side(texts: list[str | None], encode, table: pa.Array, _, kind: type) -> tuple[list[bytes], list[bool]]:
            """The ids of each text, and whether their bytes, joined, are the text behind a space."""
            each = [encode(t).tobytes() if t else b"" for t in texts]
            ids, n = _joined(each, kind)
            data, starts = _taken(table, ids)
            bounds = starts[_upto(n)].tolist()
            return each, [bool(t) and data[i:j] == b" " + t.encode() for t, i, j in zip(texts, bounds, bounds[1:], strict=False)]

        def of(texts: list[str | None]) -> list:
            (each_a, whole_a), (each_b, whole_b) = (side(texts, *s) for s in sides)
            whole = [x and y for x, y in zip(whole_a, whole_b, strict=True)]
            each_a, each_b = ([x if ok else b"" for x, ok in zip(each, whole, strict=True)] for each in (each_a, each_b))
            (ids_a, n_a), (ids_b, n_b) = _joined(each_a, sides[0][3]), _joined(each_b, sides[1][3])
            if not len(ids_a):
                none = [0] * len(texts)
                return [none, none, none, none, [""] * len(texts), each_a, each_b]
            ends_a, ends_b = np.cumsum(sides[0][2][ids_a]), np.cumsum(sides[1][2][ids_b])
            stops, both, _, at_a, at_b = links(ids_a, ids_b, ends_a, ends_b)
            from_a, from_b = _upto(n_a), _upto(n_b)
            text_ends = np.concatenate([[0], ends_a])[from_a]
            n_links = np.diff(np.searchsorted(stops, text_ends, "right"))
            n_groups = np.diff(np.searchsorted(stops[both], text_ends, "right"))
            # each group is A's tokens, then B's; a group ends where both do
            group = np.cumsum(both) - both
            group_a, group_b = group[at_a], group[at_b]
            in_a, in_b = np.bincount(group_a), np.bincount(group_b)
            codes = np.empty(len(ids_a) + len(ids_b), np.int64)
            codes[np.arange(len(ids_a)) + _upto(in_b)[group_a]] = ids_a + np.where(both[at_a], wide, 0)
            codes[np.arange(len(ids_b)) + _upto(in_a)[group_b + 1]] = ids_b + np.where(both[at_b], 2 * wide, 0)
            lines, starts = _taken(shown, codes)
            bounds = starts[from_a + from_b].tolist()
            digests = [hashlib.sha256(lines[i : j - 1]).hexdigest() if i < j else "" for i, j in zip(bounds, bounds[1:], strict=False)]
            return [n_a, n_b, n_groups, n_links, digests, each_a, each_b]

        for batch in batches:
            for i, j in _slices(_lengths(batch.column(1))):
                out = of(batch.column(1).slice(i, j - i).to_pylist())
                columns = [batch.column(0).slice(i, j - i)] + [pa.array(v, type=f.type) for v, f in zip(out, list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _lengths(values: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(values), 0).to_pylist()


def _keys(tables: tuple, ids_a: pa.Array, ids_b: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch, the packed pairs of their texts, and how many pairs each text has."""
    (len_a, kind_a), (len_b, kind_b) = tables
    for i, j in _slices(_lengths(ids_a)):
        (a, n_a), (b, _) = _joined(ids_a.slice(i, j - i).to_pylist(), kind_a), _joined(ids_b.slice(i, j - i).to_pylist(), kind_b)
        if not len(a):
            yield i, j, np.empty(0, np.int64), np.zeros(j - i, np.int64)
            continue
        ends_a = np.cumsum(len_a[a])
        stops, _, keys, _, _ = links(a, b, ends_a, np.cumsum(len_b[b]))
        yield i, j, keys, np.diff(np.searchsorted(stops, np.concatenate([[0], ends_a])[_upto(n_a)], "right"))


def _tables(a, b) -> tuple:
    return tuple((np.array([len(x) for x in t.table], np.int64), id_type(t.table)) for t in (a, b))


COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _batches(keys: np.ndarray, n: np.ndarray, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), rows):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + rows]), pa.array(n[i : i + rows])], schema=COUNTS)


def partial_counts(found: DataFrame, a, b) -> DataFrame:
    """(key, n) of each task's blocks of pairs; a key comes once for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, size = _tables(a, b), [], 0
        for batch in batches:
            for _, _, keys, _ in _keys(tables, *batch.columns):
                held.append(keys)
                size += len(keys)
                if size >= BLOCK_PAIRS:
                    yield from _batches(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if size:
            yield from _batches(*np.unique(np.concatenate(held), return_counts=True))

    return found.where("n_a > 0").select("ids_a", "ids_b").mapInArrow(run, "key bigint, n bigint")


def _store(uri: str):
    """A folder's file system and the path in it."""
    return pa.fs.FileSystem.from_uri(uri)


SHARDS = "path string, first bigint, b array<bigint>, most array<bigint>"


def shards(partial: DataFrame, folder: str) -> DataFrame:
    """(path, first, b, most): the sorted files of summed counts, each with its least key and the highest count of each id of B.

    The file of an attempt that doesn't end is in no row; rows are few: one for each range.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        path = f"{top}/shard-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.arrow"
        file = writer = None
        first, last_key, last_n, best = None, None, 0, {}

        def put(keys: np.ndarray, n: np.ndarray) -> None:
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], schema=COUNTS))
            b = keys >> SHIFT
            starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            for i, most in zip(b[starts].tolist(), np.maximum.reduceat(n, starts).tolist(), strict=True):
                best[i] = max(best.get(i, 0), most)

        for batch in batches:
            keys, n = (c.to_numpy() for c in batch.columns)
            if not len(keys):
                continue
            if writer is None:
                store.create_dir(top, recursive=True)
                file = store.open_output_stream(path)
                writer = pa.ipc.new_file(file, COUNTS)
                first = int(keys[0])
            else:
                keys, n = np.concatenate([[last_key], keys]), np.concatenate([[last_n], n])
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[starts], np.add.reduceat(n, starts)
            last_key, last_n = keys[-1], n[-1]  # the next batch may go on with this key
            if len(keys) > 1:
                put(keys[:-1], n[:-1])
        if writer is not None:
            put(np.array([last_key], np.int64), np.array([last_n], np.int64))
            writer.close()
            file.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first": [first], "b": [list(best)], "most": [list(best.values())]}, schema=pa.schema([("path", pa.string()), ("first", pa.int64()), ("b", pa.list_(pa.int64())), ("most", pa.list_(pa.int64()))]))

    return partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, SHARDS)


class Lookup:
    """The shards as one sorted table; a shard is mapped when it is first needed."""

    def __init__(self, folder: str, files: list[tuple[int, str]]) -> None:
        self.store = _store(folder)[0]
        self.local = isinstance(self.store, pyarrow.fs.LocalFileSystem)
        self.firsts, self.paths, self.open = np.array([f for f, _ in files], np.int64), [p for _, p in files], {}

    def _blocks(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if k not in self.open:
            source = pa.memory_map(self.paths[k]) if self.local else self.store.open_input_file(self.paths[k])
            reader = pa.ipc.open_file(source)
            blocks = [reader.get_batch(i) for i in range(reader.num_record_batches)]
            self.open[k] = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in blocks]  # views of the mapped file
        return self.open[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted ``keys``, all of which are there."""
        out, at = np.empty(len(keys), np.int64), np.searchsorted(keys, self.firsts[1:]).tolist()
        for k, (i, j) in enumerate(zip([0, *at], [*at, len(keys)], strict=True)):
            if i == j:
                continue
            blocks = self._blocks(k)
            inner = (i + np.searchsorted(keys[i:j], [b[0][0] for b in blocks[1:]])).tolist()
            for (own, n), x, y in zip(blocks, [i, *inner], [*inner, j], strict=True):
                out[x:y] = n[np.searchsorted(own, keys[x:y])]
        return out


RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark, a, b = docs.sparkSession, tokenizer(path_a), tokenizer(path_b)
    found = written(encoded(docs, a, b), "encoded", compression="zstd")
    folder = f"{shared_dir(spark)}/needledrop-shards-{uuid.uuid4().hex}"
    if "://" not in folder and ":/" not in folder:
        folder = f"file://{folder}"
    listed = written(shards(written(partial_counts(found, a, b), "pair-counts"), folder), "shards")
    files = sorted((r["first"], r["path"]) for r in listed.select("first", "path").collect())  # one for each range
    best = np.zeros(len(b.table), np.int64)
    each = listed.select(F.explode(F.arrays_zip("b", "most")).alias("x")).groupBy("x.b").agg(F.max("x.most").alias("most"))
    for r in each.collect():  # at most one for each token of B
        best[r["b"]] = r["most"]
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(RESULT)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, lookup = _tables(a, b), Lookup(folder, files)
        for batch in batches:
            for i, j, keys, n_links in _keys(tables, batch.column("ids_a"), batch.column("ids_b")):
                distinct = pa.array(keys).dictionary_encode()
                own, back = distinct.dictionary.to_numpy(), distinct.indices.to_numpy()
                order, counts = np.argsort(own), np.zeros(len(own), np.int64)
                if len(own):
                    counts[order] = lookup.counts(own[order])
                top = counts == best[own >> SHIFT]
                upto = _upto(n_links)
                n_best, sums = _upto(top[back])[upto], _upto(counts[back])[upto]
                part = batch.slice(i, j - i)
                more = {"n_best": pa.array(np.diff(n_best)), "count_sum": pa.array(np.diff(sums))}
                yield pa.RecordBatch.from_arrays([more[f.name] if f.name in more else part.column(f.name) for f in arrow], schema=arrow)

    return found.mapInArrow(run, schema)
