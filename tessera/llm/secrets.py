"""Secret scan with a trigram inverted index.

Every rule's regular expression is parsed and turned into a Boolean query over the
trigrams that any match must contain (AND over a sequence, OR over alternatives).
The documents of an index segment are entered into postings, trigram -> documents,
for the trigrams that the queries name; each query intersects and unites postings
and only its candidates are verified with the regular expression. A rule without a
mandatory trigram is scanned over the whole segment. A segment is a bounded slice
of an Arrow batch, so the index never leaves the task that holds the texts.

Defined cases: a null or empty text has no spans; offsets are code points, end
exclusive; equal spans of one kind count once; spans with one start come in the order
of the kinds; repeated rows each get a row; a text of any length is scanned whole, in
time linear in its length; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec
from tessera.llm.scratch import small_batches
from tessera.llm.spans import Span, ordered

ALL = ("all",)
Query = tuple


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``accept`` judges a match; failing matches are dropped without a retry."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    accept: Callable[[re.Match], bool] = lambda m: True
    spans: Callable[[str], Iterator[tuple[int, int]]] | None = None  # in place of the pattern, for the same matches

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        return self.spans(text) if self.spans else (m.span() for m in self.regex.finditer(text) if self.accept(m))

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern, self.flags)


#: A whole run of token characters with two more of eight or longer after it, each behind one dot.
CHAIN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?=\.([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{8,}+))", re.ASCII)
TOKEN_HEAD = re.compile(r"\beyJ", re.ASCII)


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the jwt pattern, each run of characters read a fixed number of times.

    The pattern itself begins anew at every ``-eyJ`` of a run and reads on to its end.
    """
    end = 0
    for m in CHAIN.finditer(text):
        if m.start() >= end and (head := TOKEN_HEAD.search(text, m.start(), m.end())) and m.end() - head.start() >= 11:
            end = m.end(2)
            yield head.start(), end


BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", accept=lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]+", accept=lambda m: len(m[0]) >= 24),
]
MORE_RULES = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", spans=tokens),
    Rule("bearer", r"\bBearer [A-Za-z0-9._~+/-]{16,}=*"),
    Rule("uri_login", r"[a-z][a-z0-9+]{2,11}://[^\s:/@]{1,64}:[^\s/@]{3,64}@"),
]


def disjoin(a: Query, b: Query) -> Query:
    return ALL if ALL in (a, b) else a if a == b else ("or", a, b)


def conjoin(a: Query, b: Query) -> Query:
    return b if a == ALL else a if b == ALL or a == b else ("and", a, b)


def of_strings(strings: set[str]) -> Query:
    """Trigrams that a text holding one of the strings must contain."""
    out: Query | None = None
    for s in sorted(strings):
        q: Query = ALL
        raw = s.encode()
        for i in range(len(raw) - 2):
            q = conjoin(q, ("tri", raw[i : i + 3]))
        out = q if out is None else disjoin(out, q)
    return out or ALL


MOST_STRINGS = 16


@dataclass
class Facts:
    """Of a subexpression: all strings it can match if few (else None), and its query."""

    exact: set[str] | None
    query: Query


def trigram_query(pattern: str, flags: int) -> Query:
    fold = bool(flags & re.IGNORECASE)
    facts = sequence(parser.parse(pattern, flags), fold)
    return conjoin(facts.query, of_strings(facts.exact)) if facts.exact is not None else facts.query


def sequence(items, fold: bool) -> Facts:
    run: set[str] | None = {""}
    query: Query = ALL
    whole = True
    for item in items:
        part = one(item, fold)
        query = conjoin(query, part.query)
        if part.exact is not None and run is not None and len(run) * len(part.exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in part.exact}
            continue
        if run is not None:
            query = conjoin(query, of_strings(run))
        run = part.exact
        whole = False
    if whole:
        return Facts(run, ALL)
    return Facts(None, conjoin(query, of_strings(run)) if run is not None else query)


def one(item, fold: bool) -> Facts:
    op, arg = item
    if op is rc.LITERAL:
        return Facts({lower(chr(arg), fold)}, ALL)
    if op is rc.SUBPATTERN:
        return sequence(arg[3], fold)
    if op is rc.BRANCH:
        found = [sequence(x, fold) for x in arg[1]]
        if all(f.exact is not None for f in found) and len(merged := set().union(*[f.exact for f in found])) <= MOST_STRINGS:
            return Facts(merged, ALL)
        query: Query | None = None
        for f in found:
            q = conjoin(f.query, of_strings(f.exact)) if f.exact is not None else f.query
            query = q if query is None else disjoin(query, q)
        return Facts(None, query or ALL)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, body = arg
        inner = sequence(body, fold)
        if (low, high) == (0, 1) and inner.exact is not None:
            return Facts(inner.exact | {""}, ALL)
        if low == 0:
            return Facts(None, ALL)
        return Facts(None, conjoin(inner.query, of_strings(inner.exact)) if inner.exact is not None else inner.query)
    if op is rc.AT:
        return Facts({""}, ALL)
    if op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 4:
        return Facts({lower(chr(x), fold) for _, x in arg}, ALL)
    return Facts(None, ALL)


def lower(c: str, fold: bool) -> str:
    return c.lower() if fold and c.isascii() else c


def named(query: Query) -> set[bytes]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*[named(q) for q in query[1:]]) if len(query) > 1 else set()


class Segment:
    """Postings of a slice of texts for a vocabulary of trigrams, ASCII letters folded."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, vocabulary: list[bytes]):
        self.rows = len(offsets) - 1
        low = FOLD[buf].astype(np.int32)
        if not held_table:
            held_table.append(np.zeros(1 << 24, bool))
        wanted = held_table[0]
        codes = [code(t) for t in vocabulary]
        wanted[codes] = True
        grams = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.int32)
        at = np.flatnonzero(wanted[grams])
        wanted[codes] = False
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        keys = np.unique(grams[at[inside]].astype(np.int64) << 32 | row[inside])
        trigram, row = keys >> 32, keys & 0xFFFFFFFF
        self.postings = {t: row[np.searchsorted(trigram, c) : np.searchsorted(trigram, c, side="right")] for t, c in zip(vocabulary, codes, strict=True)}

    def rows_of(self, query: Query) -> np.ndarray:
        if query == ALL:
            return np.arange(self.rows)
        if query[0] == "tri":
            return self.postings[folded(query[1])]
        parts = [self.rows_of(q) for q in query[1:]]
        return np.intersect1d(*parts, assume_unique=True) if query[0] == "and" else np.union1d(*parts)


held_table: list[np.ndarray] = []
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def folded(trigram: bytes) -> bytes:
    return trigram.lower()


def code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


def spans_in(texts: pa.Array, rules: list[Rule], vocabulary: list[bytes]) -> list[list[Span]]:
    """Spans of every text of a slice, in order."""
    segment, kinds = Segment(*textvec.utf8(texts), vocabulary), [r.kind for r in rules]
    values = texts.to_pylist()
    spans: list[list[Span]] = [[] for _ in values]
    for rule in rules:
        for i in segment.rows_of(rule.query).tolist():
            if values[i]:
                spans[i] += [(rule.kind, a, b) for a, b in rule.places(values[i])]
    return [ordered(s, kinds) if s else s for s in spans]


def words_of(rules: list[Rule]) -> list[bytes]:
    """The trigrams that the rules' queries name."""
    return sorted({folded(t) for r in rules for t in named(r.query)})


def scan(docs: DataFrame, rules: list[Rule], keep: list[str], out: str = "found") -> DataFrame:
    """``keep`` columns of ``docs`` and ``out``: every row's spans (kind, start, end), in order."""
    data = small_batches(docs).select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    schema = ", ".join(["found array<struct<kind:string,start:long,end:long>>", *[f"k{i} {data.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words_of(rules)
        for batch in batches:
            for part in textvec.slices(batch, 0):
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans_in(part.column(0), rules, vocabulary)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, kind), *part.columns[1:]], ["found", *part.schema.names[1:]])

    return data.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("found").alias(out))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), BASE_RULES + MORE_RULES, ["doc_id"])
    base = [r.kind for r in BASE_RULES]
    text = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(text(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def marked(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with each of ``spans``, in order, replaced by ``mark``; spans that overlap by one mark. Linear in both."""
    pieces, at = [], 0
    for _, start, end in spans:
        if start >= at:
            pieces += [text[at:start], mark]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; overlapping spans become one mark."""
    rules, at = BASE_RULES + MORE_RULES, docs.columns.index("text")
    rows = small_batches(docs.withColumn("text", F.col("text").cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words_of(rules)
        for batch in batches:
            for part in textvec.slices(batch, at):
                texts = part.column(at)
                spans = spans_in(texts, rules, vocabulary)
                hit = [i for i, s in enumerate(spans) if s]
                if hit:
                    values = texts.to_pylist()
                    for i in hit:
                        values[i] = marked(values[i], spans[i], mark)
                    texts = pa.array(values, texts.type)
                yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(part.columns)], part.schema.names)

    return rows.mapInArrow(run, rows.schema)
