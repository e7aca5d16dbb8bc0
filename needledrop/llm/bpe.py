"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list has a *sufficient lookahead*: a number L such that a token which ends at least L bytes before the last byte
read so far can no longer change, whatever follows. ``MergeTable`` computes L from the merges alone; ``WordTransducer``
reads a word in pieces, emits the tokens that are stable and keeps only the rest, so its memory doesn't grow with the
word. Decoding is an incremental state machine from bytes to text that holds back an unfinished character.

Defined results: a null text is encoded as an empty text (no ids, empty decoded text); strings of special tokens in a
text become their ids, as the tokenizers library does by default; every other text is encoded whole. Repeated
rows repeat their result, other columns play no part, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import map_rows

#: Characters of a text that are read at a time; a piece is cut before white space only.
PIECE_CHARS = 1 << 16
#: Words of at most this many bytes are remembered with their ids, up to CACHE_WORDS of them.
CACHED_BYTES, CACHE_WORDS = 48, 300_000
WHITE, CONTROL = regex.compile(r"\p{White_Space}+"), re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself, or the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class MergeTable:
    """Vocabulary and merges of a tokenizers JSON file, by id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        steps = json.dumps(spec["normalizer"])
        self.lower, self.nfc = "Lowercase" in steps, '"NFC"' in steps
        self.pattern = regex.compile(self._pattern(spec["pre_tokenizer"]))
        symbols = byte_symbols()
        self.inner = [vocab[c] for c in symbols]
        self.last = [vocab[c + self.suffix] for c in symbols]
        self.surface = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault((x, y), (rank, z))
            self.parts.setdefault(z, (x, y))
        self.made = [0] * len(merges)
        self.ranks: dict[int, int] = {}
        for (x, y), (rank, z) in self.pairs.items():
            self.made[rank] = z
            self.ranks[x << 20 | y] = rank
        self.size = {i: len(s.removesuffix(self.suffix) if self.suffix else s) for s, i in vocab.items()}
        raw = {c: bytes([b]) for b, c in enumerate(symbols)}
        self.raw = {
            i: b"".join(raw[c] for c in (s.removesuffix(self.suffix) if self.suffix else s))
            + (b" " if self.suffix and s.endswith(self.suffix) else b"")
            for s, i in vocab.items()
        } | {i: s.encode() for s, i in self.special.items()}
        self.lookahead = self.sufficient_lookahead()

    @staticmethod
    def _pattern(spec: dict) -> str:
        for x in spec.get("pretokenizers", [spec]):
            if x["type"] == "Split":
                # the file's engine takes \s as the Unicode property White_Space
                return x["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
        raise ValueError("the vocabulary file has no split pattern")

    def sufficient_lookahead(self) -> int:
        """Bytes from the end of what is read to the nearest token that later bytes can still change.

        Suppose two inputs agree up to position p. Take the merges in order of rank. The first difference left of p can
        only come from a merge (a, b) whose ``a`` ends at p; the zone of difference then begins where ``a`` begins. The
        zone grows again only by a later merge (a', b') whose ``b'`` begins there, so ``a`` is on the left spine of
        ``b'`` (``b'`` itself, its left part, that one's left part ...). The longest such chain, by the bytes of its left
        parts, is therefore an upper bound; one pass over the merges in order finds it.
        """
        chain: dict[int, int] = {}
        made = set(self.inner) | set(self.last)
        most = 0
        for (a, b), (_, z) in sorted(self.pairs.items(), key=lambda p: p[1][0]):
            if a not in made or b not in made:
                raise ValueError("a merge uses a token that no earlier merge makes")
            made.add(z)
            longest, x = 0, b
            while True:
                longest = max(longest, chain.get(x, 0))
                if x not in self.parts:
                    break
                x = self.parts[x][0]
            longest += self.size[a]
            chain[a] = max(chain.get(a, 0), longest)
            most = max(most, longest)
        return most

    def merged(self, ids: list[int]) -> list[int]:
        """Apply the merges to a sequence of symbols: lowest rank first, then leftmost."""
        if len(ids) <= 64:
            ranks, made, none = self.ranks, self.made, len(self.made)
            rank = [ranks.get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
            while rank and (best := min(rank)) < none:
                i = rank.index(best)
                ids[i] = made[best]
                del ids[i + 1], rank[i]
                if i < len(rank):
                    rank[i] = ranks.get(ids[i] << 20 | ids[i + 1], none)
                if i:
                    rank[i - 1] = ranks.get(ids[i - 1] << 20 | ids[i], none)
            return ids
        pairs = self.pairs
        n = len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := pairs.get((z, ids[k])):
                    heapq.heappush(heap, (m[0], i, z, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := pairs.get((ids[h], z))):
                heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [x for x in ids if x >= 0]


class WordTransducer:
    """Encodes one word that arrives in pieces of bytes, in memory bounded by the merge list's lookahead."""

    def __init__(self, merges: MergeTable) -> None:
        self.merges, self.held = merges, bytearray()
        self.window = 4 * merges.lookahead + 256

    def feed(self, data: bytes) -> Iterator[int]:
        """Yield the tokens that have become stable."""
        t = self.merges
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) <= 2 * t.lookahead + 1:
                continue
            # The last byte may be the word's last and then has another symbol: keep it out of what is settled.
            stable, end = len(self.held) - 1 - t.lookahead, 0
            for x in t.merged([t.inner[b] for b in self.held]):
                if end + t.size[x] > stable:
                    break
                end += t.size[x]
                yield x
            del self.held[:end]

    def finish(self) -> list[int]:
        """The rest of the tokens, at the word's end."""
        t, held = self.merges, self.held
        if not held:
            return []
        out = t.merged([*(t.inner[b] for b in held[:-1]), t.last[held[-1]]])
        self.held = bytearray()
        return out


class Encoder:
    """Encodes texts piece by piece; ``pieces`` yields lists of ids."""

    def __init__(self, merges: MergeTable) -> None:
        self.merges, self.words = merges, {}
        self.split = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        #: What all special tokens begin with: a piece without it holds none.
        self.mark = commonprefix(list(merges.special))

    def word(self, word: str) -> tuple[int, ...]:
        data, t = word.encode(), self.merges
        if len(data) > t.lookahead:
            transducer = WordTransducer(t)
            return (*transducer.feed(data), *transducer.finish())
        ids = [t.inner[b] for b in data]
        ids[-1] = t.last[data[-1]]
        out = t.merged(ids)
        if len(data) <= CACHED_BYTES:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = out
        return out

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a run without white space: no token crosses white space."""
        if chunk.isalpha():
            return self.word(chunk)
        known, body = self.words.get, chunk[:-1]
        if body.isalpha() and chunk[-1] in ".,:;!?":
            parts = body, chunk[-1]
        else:
            parts = self.merges.pattern.findall(chunk)
        return tuple(i for w in parts for i in known(w) or self.word(w))

    def _plain(self, text: str) -> list[int]:
        if self.merges.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.merges.lower:
            text = text.replace("Σ", "σ").lower()  # each character by itself: no final sigma
        # str.split() takes four control characters as white space that the vocabulary's pattern doesn't
        chunks = WHITE.split(text) if CONTROL.search(text) else text.split()
        ids: list[int] = []
        known, extend = self.words.get, ids.extend
        for c in chunks:
            extend(known(c) or self.chunk(c))
        return ids

    def pieces(self, text: str) -> Iterator[list[int]]:
        for piece in cut(text):
            if self.split is None or self.mark not in piece:
                yield self._plain(piece)
                continue
            at = 0
            for m in self.split.finditer(piece):
                yield self._plain(piece[at : m.start()])
                yield [self.merges.special[m.group()]]
                at = m.end()
            yield self._plain(piece[at:])


def cut(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of about ``size`` characters, cut before a space or line break: no token or character crosses those."""
    at, n = 0, len(text)
    while n - at > size:
        ends = [i for c in " \n" if (i := text.find(c, at + size)) >= 0]
        end = min(ends, default=n)
        yield text[at:end]
        at = end
    yield text[at:]


class Decoder:
    """Ids to text, a piece at a time: a state machine over the bytes of tokens that holds an unfinished character.

    ``joined=True`` gives what the tokenizers library gives for a file without a decoder, the tokens' own symbols joined
    by a space; ``joined=False`` gives the bytes that the tokens stand for, word ends as a space.
    """

    def __init__(self, merges: MergeTable, joined: bool = False) -> None:
        self.bytes = {i: s.encode() for i, s in merges.surface.items()} if joined else merges.raw
        self.gap, self.first = b" " if joined else b"", True
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = self.gap.join(map(self.bytes.__getitem__, ids))
        if data and not self.first:
            data = self.gap + data
        self.first = self.first and not data
        return self.state.decode(data)

    def finish(self) -> str:
        out, self.first = self.state.decode(b"", True), True
        self.state.reset()
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> MergeTable:
    return MergeTable(path)


def encode(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row; ``vocabulary`` is a path that every executor can open."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    def make():
        encoder = Encoder(loaded(vocabulary))
        return lambda k, texts: [k, [[i for p in encoder.pieces(t or "") for i in p] for t in texts]]

    schema = StructType([df.schema[key], StructField("ids", ArrayType(IntegerType()))])
    return map_rows(df.select(F.col(key), F.col(text)), make, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of every row of ids; null ids give an empty text."""
    from pyspark.sql.types import StringType, StructField, StructType

    def make():
        table = loaded(vocabulary)

        def one(x) -> str:
            d = Decoder(table)
            return d.feed(x or []) + d.finish()

        return lambda k, rows: [k, [one(x) for x in rows]]

    schema = StructType([df.schema[key], StructField("text", StringType())])
    return map_rows(df.select(F.col(key), F.col(ids)), make, schema)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]): encode, decode what was encoded, and digest both as they stream."""
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    def make():
        table = loaded(vocabulary)
        encoder, decoder = Encoder(table), Decoder(table, joined=True)
        shown = [str(i) for i in range(max(table.surface) + 1)]

        def one(t: str) -> tuple:
            n, ids_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []
            for ids in encoder.pieces(t):
                if ids:
                    ids_hash.update(((" " if n else "") + " ".join(map(shown.__getitem__, ids))).encode())
                    text_hash.update(decoder.feed(ids).encode())
                    n += len(ids)
                    if with_ids:
                        kept += ids
            text_hash.update(decoder.finish().encode())
            return (n, ids_hash.hexdigest(), text_hash.hexdigest(), *([kept] if with_ids else []))

        return lambda k, texts: [k, *(map(list, zip(*(one(t or "") for t in texts), strict=True)) if texts else columns)]

    schema = StructType(
        [
            df.schema[key],
            StructField("n_tokens", LongType()),
            StructField("ids_sha256", StringType()),
            StructField("decoded_sha256", StringType()),
        ]
        + [StructField("ids", ArrayType(IntegerType()))] * with_ids
    )
    columns = [[]] * (len(schema) - 1)
    return map_rows(df.select(F.col(key), F.col(text)), make, schema)
