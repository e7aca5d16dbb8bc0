"""Secret scans with one combined deterministic automaton.

The rules' expressions (a small regular language: classes, groups, ``| ? * + {m,} {m}``) are compiled to one
nondeterministic automaton, made deterministic by subset construction over byte classes, minimised, and laid out as one
transition array. A text's UTF-8 bytes then pass through it once, for all rules together; where a rule stops accepting, a
second, reversed automaton of that rule walks back over the match to its leftmost start.

Matches are leftmost and longest, without overlap within a kind; a match that fails its rule's length is dropped and its
characters are not tried again. Every rule must end in a repeated class (as all of ``RULES`` do), so that the longest match
from a start is where the automaton stops accepting.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive. Each row is judged by its own text
alone: repeated rows repeat their result, other columns play no part, whatever their names (``redact`` carries them along), and
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import SLICE_ROWS, map_rows, spans_sql


@dataclass(frozen=True)
class Rule:
    kind: str
    #: What comes before the measured part, and the measured part's class with its repetition.
    head: str
    tail: str
    #: Least length of the measured part (``of="tail"``) or of the whole match.
    least: int
    of: str = "match"
    nocase_head: bool = False
    base: bool = False


#: The first three are the base kinds, in their order.
RULES = (
    Rule(
        "assign",
        "(pass(word|wd)|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?",
        "[A-Za-z0-9+/_.=-]+",
        12,
        "tail",
        nocase_head=True,
        base=True,
    ),
    Rule("access", "AKIA", "[A-Z0-9]+", 18, base=True),
    Rule("hex", "", "[0-9a-f]{16,}", 16, base=True),
    Rule("hub_token", "gh[oprsu]_", "[A-Za-z0-9]+", 40),
    Rule("chat_token", "xox[abprs]-", "[A-Za-z0-9-]+", 24),
)


def parse(text: str, nocase: bool = False):
    """The syntax tree of an expression: ("set", frozenset), ("cat", [..]), ("alt", [..]), ("rep", x, least, most)."""
    at = 0

    def one() -> int:
        nonlocal at
        c = text[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = text[at]
        at += 1
        if c == "x":
            at += 2
            return int(text[at - 2 : at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def chars(found: set[int]):
        if nocase:
            found |= {ord(chr(c).swapcase()) for c in found if chr(c).isalpha()}
        return "set", frozenset(found)

    def atom():
        nonlocal at
        if text[at] == "(":
            at += 1
            x = alternatives()
            at += 1
            return x
        if text[at] == "[":
            at += 1
            negated = text[at] == "^"
            at += negated
            found: set[int] = set()
            while text[at] != "]":
                low = high = one()
                if text[at] == "-" and text[at + 1] != "]":
                    at += 1
                    high = one()
                found |= {*range(low, high + 1)}
            at += 1
            return chars({*range(256)} - found if negated else found)
        return chars({one()})

    def repeated():
        nonlocal at
        x = atom()
        while at < len(text) and text[at] in "?*+{":
            c = text[at]
            at += 1
            if c == "{":
                end = text.index("}", at)
                low, _, high = text[at:end].partition(",")
                most = int(low) if "," not in text[at:end] else int(high) if high else None
                x, at = ("rep", x, int(low), most), end + 1
            else:
                x = "rep", x, int(c == "+"), 1 if c == "?" else None
        return x

    def sequence():
        out = []
        while at < len(text) and text[at] not in "|)":
            out.append(repeated())
        return "cat", out

    def alternatives():
        nonlocal at
        out = [sequence()]
        while at < len(text) and text[at] == "|":
            at += 1
            out.append(sequence())
        return "alt", out

    return alternatives()


class Nfa:
    def __init__(self) -> None:
        self.silent: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.silent.append([])
        self.moves.append([])
        return len(self.silent) - 1

    def add(self, tree, start: int, reverse: bool) -> int:
        """Add what ``tree`` matches after ``start``; returns the state reached."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for x in reversed(tree[1]) if reverse else tree[1]:
                start = self.add(x, start, reverse)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                begin = self.state()
                self.silent[start].append(begin)
                self.silent[self.add(x, begin, reverse)].append(end)
            return end
        _, x, least, most = tree
        for _ in range(least):
            start = self.add(x, start, reverse)
        end = self.state()
        self.silent[start].append(end)
        if most is None:
            loop = self.state()
            self.silent[start].append(loop)
            self.silent[self.add(x, loop, reverse)] += [loop, end]
        else:
            for _ in range(most - least):
                start = self.add(x, start, reverse)
                self.silent[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.silent[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """``step[state * 256 + byte]`` is 256 times the next state; states from ``first`` on (times 256) accept ``accepts``."""

    step: list[int]
    start: int
    first: int
    accepts: list[frozenset[int]]
    #: The state (times 256) from which nothing is accepted any more, or -1.
    dead: int


def compiled(trees: list, search: bool, reverse: bool = False) -> Automaton:
    """Subset construction, then minimisation by partition refinement; ``search`` lets a match begin anywhere."""
    nfa = Nfa()
    origin = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        begin = nfa.state()
        nfa.silent[origin].append(begin)
        ends[nfa.add(tree, begin, reverse)] = k
    # bytes that no class tells apart are one symbol
    kinds: dict[tuple, int] = {}
    sets = list(dict.fromkeys(s for moves in nfa.moves for s, _ in moves))
    of_byte = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
    example = {k: b for b, k in reversed(list(enumerate(of_byte)))}
    begin = nfa.closed([origin])
    number, todo, rows = {begin: 0}, [begin], []
    while todo:
        state = todo.pop()
        row = []
        for k in range(len(kinds)):
            to = {t for s in state for chars, t in nfa.moves[s] if example[k] in chars}
            to = nfa.closed(to | {origin} if search else to)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append((number[state], row))
    table = [r for _, r in sorted(rows)]
    accepts = [frozenset(ends[s] for s in state if s in ends) for state in number]
    block = [sorted(set(accepts), key=sorted).index(a) for a in accepts]
    while True:
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((block[s], *(block[t] for t in table[s])), len(seen)) for s in range(len(table))]
        if len(seen) == len(set(block)):
            break
        block = new
    # accepting blocks get the highest numbers, so that one comparison tells them
    of_block = {block[s]: s for s in reversed(range(len(table)))}
    order = sorted(of_block, key=lambda b: (bool(accepts[of_block[b]]), b != block[0], b))
    place = {b: i for i, b in enumerate(order)}
    step = [place[block[table[of_block[b]][of_byte[c]]]] * 256 for b in order for c in range(256)]
    found = [accepts[of_block[b]] for b in order]
    first = next((i for i, a in enumerate(found) if a), len(order)) * 256
    dead = next((i * 256 for i, a in enumerate(found) if not a and all(t == i * 256 for t in step[i * 256 : i * 256 + 256])), -1)
    return Automaton(step, place[block[0]] * 256, first, found, dead)


class Scanner:
    """Finds the spans of all rules in one pass over a text's bytes."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        trees = [("cat", [parse(r.head, r.nocase_head), parse(r.tail)]) for r in rules]
        self.forward = compiled(trees, search=True)
        self.back = [compiled([t], search=False, reverse=True) for t in trees]
        self.heads = [compiled([parse(r.head, r.nocase_head)], search=False) for r in rules]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, rule) wherever a rule stops accepting, in order."""
        a = self.forward
        step, first, accepts = a.step, a.first, a.accepts
        out, state, on = [], a.start, frozenset()
        for at, b in enumerate(data):
            state = step[state + b]
            if state >= first or on:
                now = accepts[state >> 8]
                if now is not on:
                    out += [(at, k) for k in sorted(on - now)]
                    on = now
        return out + [(len(data), k) for k in sorted(on)]

    def begin(self, data: bytes, rule: int, end: int, bound: int) -> int | None:
        """The leftmost start, from ``bound`` on, of a match that ends at ``end``."""
        a, best = self.back[rule], None
        step, first, dead, state = a.step, a.first, a.dead, a.start
        for at in range(end - 1, bound - 1, -1):
            state = step[state + data[at]]
            if state >= first:
                best = at
            elif state == dead:
                break
        return best

    def head_end(self, data: bytes, rule: int, start: int, end: int) -> int:
        """Where the longest head that begins at ``start`` ends."""
        a = self.heads[rule]
        state, out = a.start, start
        for at in range(start, end):
            state = a.step[state + data[at]]
            if state >= a.first:
                out = at + 1
            elif state == a.dead:
                break
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, by start, then rule."""
        data = text.encode("utf-8", "surrogatepass")
        taken = [0] * len(self.rules)
        found = []
        for end, k in self.ends(data):
            start = self.begin(data, k, end, taken[k])
            if start is None:
                continue
            taken[k] = end
            r = self.rules[k]
            if end - (self.head_end(data, k, start, end) if r.of == "tail" else start) >= r.least:
                found.append((start, k, end))
        if found and len(data) != len(text):
            places = sorted({x for s, _, e in found for x in (s, e)})
            at, n, chars = 0, 0, {}
            for p in places:
                n += len(data[at:p].decode("utf-8", "surrogatepass"))
                at, chars[p] = p, n
            found = [(chars[s], k, chars[e]) for s, k, e in found]
        return sorted(found)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def find(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans array<struct<kind, start, end>>, n_assign, n_access, n_hex, base_sha256, shown) of every row."""
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    base = [k for k, r in enumerate(rules) if r.base]

    def make():
        scan = scanner(rules)
        show = lambda found: ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in found)

        def rows(ids, texts):
            found = [scan.spans(t or "") for t in texts]
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
            counts = [[sum(k == b for _, k, _ in x) for x in found] for b in base]
            digest = [hashlib.sha256(show([y for y in x if rules[y[1]].base]).encode()).hexdigest() for x in found]
            return [ids, spans, *counts, digest, [show(x) for x in found]]

        return rows

    schema = StructType(
        [df.schema[key], StructField("spans", ArrayType(span))]
        + [StructField(f"n_{rules[k].kind}", LongType()) for k in base]
        + [StructField("base_sha256", StringType()), StructField("shown", StringType())]
    )
    return map_rows(df.select(F.col(key), F.col(text)), make, schema)


def redacted(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[str | None]:
    """Texts with every secret replaced by ``[kind]``; of overlapping spans the union goes, named by the first."""
    scan, out = scanner(rules), []
    for t in texts:
        if not t or not (found := scan.spans(t)):
            out.append(t)
            continue
        parts, at = [], 0
        for s, k, e in found:
            if e <= at:
                continue
            if s >= at:
                parts += [t[at:s], f"[{rules[k].kind}]"]
            at = e
        out.append("".join([*parts, t[at:]]))
    return out


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``df`` with the secrets in ``text`` replaced; all other columns and rows stay as they are."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                columns = list(part.columns)
                columns[at] = pa.array(redacted(columns[at].to_pylist(), rules), type=columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)


def _sql() -> str:
    """The rows of the query in DuckDB SQL, by each rule's own expression."""
    either = lambda head: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = []
    for r in RULES:
        head, names = r.head, "(pass(word|wd)|secret|token|api_?key)"
        if r.nocase_head:
            head = either(names) + head.removeprefix(names)
        head = head.replace("(", "(?:")
        measured = f"regexp_extract(m, {quote(head + '(' + r.tail + ')')}, 1)" if r.of == "tail" else "m"
        # a lower bound of a repetition is checked as a length, so that shorter runs are matched and dropped alike
        kinds.append((r.kind, head + r.tail.replace("{16,}", "+"), f"len({measured}) >= {r.least}"))
    shown = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)"
    base = [r.kind for r in RULES if r.base]
    counts = ", ".join(f"(count(*) FILTER (WHERE kind = '{k}'))::BIGINT AS n_{k}" for k in base)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({spans_sql(kinds)})
SELECT d.doc_id, {counts}, sha256(coalesce({shown} FILTER (WHERE place < {len(base)}), '')) AS base_sha256, coalesce({shown}, '') AS spans
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


ORACLE = _sql()
