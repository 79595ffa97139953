"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hex) are reported wherever they are. Weak
candidates - bare secrets (letters and digits of enough entropy, or a UUID), account names,
endpoints - are too common to report alone. They are reported when complementary parts meet in a scope: an interval join
of the document's candidates by position links an identifier or endpoint with a secret if
at most `reach` code points lie between them and no blank line does.

The join is a sweep over candidates sorted by start; it emits for each candidate whether it
has a partner, never the pairs, so its work follows the number of candidates. A
document is scanned whole by one task; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_slices

REACH = 200

#: Kinds in the order in which spans of equal start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal: shorter ones hold no match

IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+|\b(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.:/-]{4,})""", re.IGNORECASE | re.ASCII)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.ASCII)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


def entropy(text: str) -> float:
    """Bits a character, by the text's own frequencies."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the strong patterns, in code points."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    out += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    return out + [("secret", *m.span()) for m in BARE.finditer(text) if _UUID.fullmatch(m[0]) or _MIXED.match(m[0]) and entropy(m[0]) >= 3.5]


class Side:
    """One side of the interval join: sorted, disjoint intervals."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = _disjoint(spans)
        self.starts, self.ends = [s for s, _ in self.spans], [e for _, e in self.spans]

    def meets(self, start: int, end: int, breaks: list[int], reach: int) -> bool:
        """Whether one of the intervals lies within reach of [start, end), with no break
        between them."""
        for k in range(bisect_left(self.ends, start - reach), bisect_right(self.starts, end + reach)):
            a, b = (self.ends[k], start) if self.ends[k] <= start else (end, self.starts[k])
            if a >= b or bisect_left(breaks, a) == bisect_left(breaks, b):
                return True
        return False

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and end <= self.ends[k]


def linked_spans(text: str, strong: list[tuple[str, int, int]], reach: int = REACH) -> list[tuple[str, int, int]]:
    """The weak candidates that have complementary parts: secrets near an identifier or an
    endpoint, and identifiers and endpoints near a secret. Access identifiers count as
    identifiers; assignments and hex as secrets. A weak secret inside a strong span is not
    one of its own."""
    known = Side([(s, e) for _, s, e in strong])
    weak = [w for w in weak_spans(text) if w[0] != "secret" or not known.holds(w[1], w[2])]
    if not weak:
        return []
    secrets = Side([(s, e) for k, s, e in strong if k != "access"] + [(s, e) for k, s, e in weak if k == "secret"])
    others = Side([(s, e) for k, s, e in strong if k == "access"] + [(s, e) for k, s, e in weak if k != "secret"])
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    return [(kind, s, e) for kind, s, e in weak if (others if kind == "secret" else secrets).meets(s, e, breaks, reach)]


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted union of intervals."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find(text: str | None, reach: int = REACH) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and kind. A null text has none."""
    text = text or ""
    strong = base_spans(text)
    return sorted(set(strong) | set(linked_spans(text, strong, reach)), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) for each row of docs.
    Null and empty texts have no spans; repeated rows are repeated."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, reach)] for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(found, SPANS)], ["doc_id", "spans"])

    return map_slices(id_text(docs, id_col, text_col), "text", run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def report(docs: DataFrame, **options) -> DataFrame:
    """The scan as one digest row for each document."""
    got = scan(docs, **options)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return got.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact_text(text: str, spans: list[tuple[str, int, int]], mark: str = "[{}]") -> str:
    """The text with each group of overlapping spans replaced by the mark of its first kind."""
    out, at = [], 0
    for kind, s, e in spans:
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], mark.format(kind)]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, reach: int = REACH, text_col: str = "text") -> DataFrame:
    """docs with the secrets in their text replaced by marks; all other columns and all rows
    stay as they are, and nulls stay null."""
    at = docs.columns.index(text_col)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        new = [t if t is None or not (s := find(t, reach)) else redact_text(t, s) for t in part.column(at).to_pylist()]
        return part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return map_slices(docs, text_col, run, docs.schema)
