r"""Secret scan with multipart credential linking.

A first look at each text finds parts with exact patterns:

* strong parts, always reported: ``assign`` (a secret-like name assigned a value of 8 or
  more characters), ``access`` (an access identifier), ``hex`` (32 or more hex digits);
* weak parts, reported only when complementary parts lie in the same scope: ``keyid`` (an
  account or client name assigned a value), ``blob`` (a random-looking token, bare, after an
  equals sign or at the end of a sentence),
  ``endpoint`` (a service address).

Linking is an interval join inside the document: parts are sorted by start, a scope is a
paragraph (blank lines part scopes) and at most WINDOW code points between two parts. Each
weak part looks only at its nearest neighbours of each role on either side (a bisection in
the role's sorted bounds), so a text with many parts costs n log n, never all pairs. Parts
that overlap never complement each other, and a blob inside a keyid or endpoint is that
part's own text, no candidate.

* ``blob`` needs an identifier: an access part, or a keyid with an endpoint as well;
* ``keyid`` needs a secret: an assign or hex part, or a linked blob;
* ``endpoint`` needs an identifier and a secret.

Offsets are code points, ends are exclusive. Texts stay where they are: one Arrow pass, no
shuffle; very long texts cost time and memory in proportion to their own length (patterns
enter a run of characters once).

Defined results: NULL is an empty text without spans (the digest of an empty string);
repeated rows give equal rows; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Code points between two parts of one credential, at most.
WINDOW = 400
#: A blob's least length and bits of entropy a character.
BLOB_CHARS, BLOB_BITS = 20, 3.5

#: Fixed patterns of the contract (letters of the names in either case, ASCII only).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

KEYID = re.compile(r"""(?:access_?key_?id|client_?id|account_?(?:id|name)|user_?(?:id|name)|login)["']?\x20*[:=]\x20*"""
                   r"""["']?[A-Za-z0-9@._-]{4,}""", re.IGNORECASE | re.ASCII)
BLOB = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-]|\.[A-Za-z0-9+/_=-])")
#: A host is entered at the start of its run of labels alone, so a run is read once.
ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|"
                      r"(?<![\w-])(?<![\w-]\.)[\w-]++(?:(?:\.[\w-]++)++:[0-9]{2,5}\b|(?:\.[\w-]++)*\.amazonaws\.com\b))")
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "keyid", "blob", "endpoint")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; an assignment's short values are
    dropped after matching. (A run of 12 or 32 and more is matched exactly where the
    unbounded run would be.)"""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def entropy_bits(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _clear_of(parts: list[Span], others: list[Span]) -> list[Span]:
    """The parts that overlap none of the others."""
    taken = sorted((s, e) for _, s, e in others)
    starts = [s for s, _ in taken]
    ends: list[int] = []
    for _, e in taken:
        ends.append(max(e, ends[-1]) if ends else e)

    def clear(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        return i == 0 or ends[i - 1] <= s

    return [x for x in parts if clear(x[1], x[2])]


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates that do not overlap a strong part; blobs that overlap neither a keyid
    nor an endpoint."""
    out = [("keyid", m.start(), m.end()) for m in KEYID.finditer(text)]
    if "." in text or "://" in text:
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    out = _clear_of(out, base)
    blobs = []
    for m in BLOB.finditer(text):
        s = m.group()
        if (any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and len(s) >= BLOB_CHARS
                and entropy_bits(s) >= BLOB_BITS):
            blobs.append(("blob", m.start(), m.end()))
    return out + _clear_of(blobs, base + out)


def link(text: str, base: list[Span], weak: list[Span], window: int = WINDOW) -> list[Span]:
    """The weak parts that complementary parts in their scope confirm."""
    breaks = [m.start() for m in SCOPE_END.finditer(text)]
    scope = lambda at: bisect_left(breaks, at)
    # parts of one kind never overlap, so their ends are in order as well
    bounds = {}

    def put(kind: str, parts: list[Span]) -> None:
        at = sorted((s, e) for k, s, e in parts if k == kind)
        bounds[kind] = [s for s, _ in at], [e for _, e in at]

    for k in KINDS:
        put(k, [*base, *weak])

    def near(part: Span, *kinds: str) -> bool:
        for k in kinds:
            starts, ends = bounds[k]
            left, right = bisect_right(ends, part[1]) - 1, bisect_left(starts, part[2])
            if left >= 0 and part[1] - ends[left] <= window and scope(starts[left]) == scope(part[1]):
                return True
            if right < len(starts) and starts[right] - part[2] <= window and scope(starts[right]) == scope(part[1]):
                return True
        return False

    blobs = [p for p in weak if p[0] == "blob"
             and (near(p, "access") or (near(p, "keyid") and near(p, "endpoint")))]
    put("blob", blobs)
    names = [p for p in weak if p[0] == "keyid" and near(p, "assign", "hex", "blob")]
    put("keyid", names)
    places = [p for p in weak if p[0] == "endpoint" and near(p, "access", "keyid") and near(p, "assign", "hex", "blob")]
    return blobs + names + places


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak parts kept)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                t = t or ""
                base = base_spans(t)
                weak = weak_parts(t, base)
                more = link(t, base, weak, window) if weak and (base or len(weak) > 1) else []
                kinds = Counter(k for k, _, _ in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"],
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    src = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInPandas(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                "spans string, n_linked long")
