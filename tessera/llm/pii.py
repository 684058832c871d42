"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Each kind's pattern proposes spans; a validator (octet range, Luhn, digit count,
mod-97) confirms or drops them; words near a span raise or lower its score from the
kind's starting value. The base kinds need confirmation only and always stay; the
further kinds are kept from a score of ``KEEP`` on.

Defined cases: a null or empty text has no spans; offsets are code points, end
exclusive; spans with one start come in the order of the kinds; repeated rows each
get a row; a text of any length is scanned whole, in time linear in its length; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec
from tessera.llm.scratch import small_batches

KEEP = 0.5
#: Code points on either side of a span in which context words count.
NEAR = 48


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(s: str) -> bool:
    """ISO 13616 check of an account number with its country code first."""
    moved = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def card(s: str) -> bool:
    found = digits(s)
    return 12 <= len(found) <= 19 and luhn(found)


def octets(s: str) -> bool:
    bare = [p.lstrip("0") or "0" for p in s.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in bare)


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of LOCAL+ @ DOMAIN, from each @ outwards: linear in long runs without one."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    confirm: Callable[[str], bool]
    hint: str  # text without it holds no match; empty: always search
    base: bool = False
    start: float = 0.5
    context: re.Pattern | None = None
    against: re.Pattern | None = None
    spans: Callable[[str], Iterator[tuple[int, int]]] | None = None  # in place of the pattern, for the same matches

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        return self.spans(text) if self.spans else (m.span() for m in self.pattern.finditer(text))


KINDS = [
    Kind("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True, "@", True, 0.9, spans=emails),
    Kind("ip", re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), octets, ".", True, 0.7, re.compile(r"(?ai)\b(?:ip|host|server|address)\b"), re.compile(r"(?ai)\bversion\b")),
    Kind("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), card, "", True, 0.7, re.compile(r"(?ai)\b(?:card|visa|credit|debit|payment)\b")),
    Kind("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(digits(s)) <= 15, "+", True, 0.7, re.compile(r"(?ai)\b(?:phone|tel|call|mobile|fax)\b")),
    Kind("iban", re.compile(r"(?a)\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"), lambda s: mod97(s.replace(" ", "")), "", False, 0.6, re.compile(r"(?ai)\b(?:iban|account|bank|bic)\b"), re.compile(r"(?ai)\b(?:part|serial|model)\b")),
    Kind("ssn", re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), lambda s: True, "-", False, 0.3, re.compile(r"(?ai)\b(?:ssn|social security|tax id)\b"), re.compile(r"(?ai)\b(?:order|part|ref)\b")),
]
BASE = [k.name for k in KINDS if k.base]
ANY_DIGIT = re.compile("[0-9]")


def score(kind: Kind, text: str, start: int, end: int) -> float:
    """Start value of the kind, adjusted by the words around the span."""
    near = text[max(0, start - NEAR) : start] + " \n " + text[end : end + NEAR]
    up = 0.3 if kind.context and kind.context.search(near) else 0.0
    down = 0.3 if kind.against and kind.against.search(near) else 0.0
    return min(1.0, max(0.0, kind.start + up - down))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """Confirmed spans (kind, start, end, score) of a text, kind by kind."""
    out = []
    if not text:
        return out
    numbers = ANY_DIGIT.search(text) is not None
    for kind in KINDS:
        if kind.hint not in text or kind.name != "email" and not numbers:
            continue
        for start, end in kind.places(text):
            if kind.confirm(text[start:end]) and ((s := score(kind, text, start, end)) >= KEEP or kind.base):
                out.append((kind.name, start, end, s))
    return out


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, found) with found: array of (kind, start, end, score) in order of start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    rank = {k.name: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch):
                rows = []
                for t in part.column(1):
                    spans = sorted(find(t.as_py()), key=lambda s: (s[1], rank[s[0]]))
                    rows.append([{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) for every row of ``docs``.

    ``scores``: that of each span, in tenths, in their order.
    """
    text = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return detect(docs).select("doc_id", *[count(k) for k in BASE], F.sha2(text(F.filter("found", lambda x: x["kind"].isin(BASE))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), F.concat_ws(",", F.transform("found", lambda x: F.round(x["score"] * 10).cast("int").cast("string"))).alias("scores"))
