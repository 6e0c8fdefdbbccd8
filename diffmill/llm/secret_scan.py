"""Secret scans with multipart credential linking.

Single-part rules report their matches as they are. Weak parts (names of accesses, secret-like strings, endpoints) mean
nothing alone; an interval join within a scope links them, and a weak part is reported only where parts that complement it
lie near. The scopes are texts, so the join runs where a text is read, over sorted starts: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.llm.common import table

#: Fixed patterns of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "weak_endpoint")
#: Cheap tests that a text has to pass before a base rule runs: each match of ASSIGN holds one of these words.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")

#: Weak parts. An access identifier, a secret and an endpoint complement one another.
#: A secret is a run of 32 characters or more with a digit and letters of both cases, also right after "="; each run is read once.
WEAK = {
    "weak_access": re.compile(r"(?<![A-Za-z0-9_])(?:(?:access|account|client|user|login)[_-]?(?:key[_-]?id|id|name)|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,64})", re.ASCII | re.IGNORECASE),
    "weak_secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{32})(?=[A-Z+/_a-z-]*[0-9])(?=[0-9+/_a-z-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]+={0,2}", re.ASCII),
    "weak_endpoint": re.compile(r"\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]{1,5})?", re.ASCII),
}
#: Code points between two parts at most for them to complement each other.
WINDOW = 400
#: What each weak kind needs near it: one of each set.
NEEDS = {
    "weak_access": ({"weak_secret", "assign", "hex"},),
    "weak_secret": ({"access", "weak_access"},),
    "weak_endpoint": ({"access", "weak_access"}, {"weak_secret", "assign", "hex"}),
}
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the base rules: leftmost and non-overlapping in each kind, those that are too short left out."""
    found: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts outside the base spans. Without a possible access part no weak part can complete, so none is looked for."""
    parts: list[Span] = []
    accesses = [("weak_access", m.start(), m.end()) for m in WEAK["weak_access"].finditer(text)] if any(x in text for x in "=:") else []
    if not accesses and not any(k == "access" for k, _, _ in base):
        return []
    parts += accesses
    for kind in ("weak_secret", "weak_endpoint"):
        parts += [(kind, m.start(), m.end()) for m in WEAK[kind].finditer(text)]
    own = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in own]
    reach = list(accumulate((b for _, b in own), max))  # how far any of the spans up to here goes

    def inside(a: int, b: int) -> bool:
        at = bisect_left(starts, b)
        return at > 0 and reach[at - 1] > a

    return [p for p in parts if not inside(p[1], p[2])]


def linked(base: list[Span], weak: list[Span], window: int = WINDOW) -> list[Span]:
    """The weak parts near which complementary parts lie: an interval join over starts, kind by kind."""
    by_kind: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in [*base, *weak]:
        by_kind.setdefault(kind, []).append((a, b))
    firsts, reach = {}, {}
    for kind, spans in by_kind.items():
        spans.sort()
        firsts[kind], reach[kind] = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def near(kind: str, a: int, b: int) -> bool:
        """Whether a part of the kind lies within the window of [a, b): of those that start in reach, the furthest end does."""
        at = bisect_right(firsts[kind], b + window) if kind in firsts else 0
        return at > 0 and reach[kind][at - 1] >= a - window

    return [(kind, a, b) for kind, a, b in weak if all(any(near(k, a, b) for k in group) for group in NEEDS[kind])]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            more = linked(base, weak_spans(text, base))
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. base_sha256 is of the base spans alone;
    spans also has the weak parts that linking reports, and n_linked counts those. A weak part has to lie outside all base
    spans. Null and empty texts have no spans, and the digest of the empty string. Repeated rows and null ids are returned
    as they are; no rows give none. Other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the whole documents table."""
    return secret_scan(table(spark, sf_dir, "documents"))
