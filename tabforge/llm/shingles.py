"""Word-shingle sets of texts as sorted arrays of 64-bit hashes, vectorised over many texts.

A-Z count as a-z; words are runs of anything but ASCII white space. A text's set holds its
distinct 5-word shingles; a text of one to four words has one shingle, the whole sequence;
a text without words has the empty set. Two different shingles of a pair of documents share
a hash with a chance of about 2^-64 each, so set sizes and intersections are those of the
shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
CHUNK = 250_000  # bytes of text hashed at once (a longer text is a chunk of its own)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _tables(seed: int = 20240229):
    rng = np.random.default_rng(seed)
    letter = rng.integers(0, 2 ** 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    letter[65:91] = letter[97:123]
    white = np.zeros(256, dtype=bool)
    white[list(b" \t\n\x0b\x0c\r")] = True
    mult = rng.integers(0, 2 ** 62, SHINGLE + 1, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    return letter, white, mult


LETTER, WHITE, MULT = _tables()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n and their inverses modulo 2^64."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(n, CHUNK) + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, dtype=_U)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=_U)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _chunk_sets(raws: list[bytes]) -> list[np.ndarray]:
    body = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
    white = WHITE[body]
    edge = np.diff(white.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(body))
    total = np.cumsum(LETTER[body] * up[:len(body)], dtype=_U)
    before = np.where(starts > 0, total[starts - 1], _U(0))
    words = mix((total[ends - 1] - before) * down[starts])
    # which words belong to which text
    borders = np.cumsum([len(r) + 1 for r in raws])
    cut = np.searchsorted(starts, borders)
    n = len(words)
    if n >= SHINGLE:
        h = np.zeros(n - SHINGLE + 1, dtype=_U)
        for k in range(SHINGLE):
            h += words[k:n - SHINGLE + 1 + k] * MULT[k]
        h = mix(h)
    out, at = [], 0
    for end in cut.tolist():
        m = end - at
        if m >= SHINGLE:
            s = np.sort(h[at:end - SHINGLE + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif m:
            few = np.append(words[at:end] * MULT[:m], np.array([m], dtype=_U) * MULT[SHINGLE])
            out.append(mix(few.sum(dtype=_U, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=_U))
        at = end
    return out


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The set of each text in turn: sorted distinct hashes (uint64)."""
    raws: list[bytes] = []
    size = 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        if raws and size + len(raw) > CHUNK:
            yield from _chunk_sets(raws)
            raws, size = [], 0
        raws.append(raw)
        size += len(raw) + 1
    if raws:
        yield from _chunk_sets(raws)
