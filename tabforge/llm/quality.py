"""Quality rules: base counts, and divergence from language references.

Base counts of a text (words are runs of non-white characters): code points in words,
symbol characters, repeated lines, and words inside 5-word windows that occur twice or
more. A text with under MIN_WORDS words, or with more than REPEAT_PERCENT of its words in
repeated windows, fails.

The method's rule compares two histograms of the text with references of its language by
Jensen-Shannon distance (base 2, so 0 .. 1): character classes, and the language's common
words (all others share one bin). A reference is the mean of the normalised histograms of
ALL documents of the language, each document counting once. A document is rejected when a
distance is above its threshold. The first histogram judges texts of GUARD_CHARS characters
and more; the second judges texts of any length, with a limit that widens below GUARD_WORDS
words by WORD_NOISE * (1/sqrt(words) - 1/sqrt(GUARD_WORDS)), as the noise of a short sample
does. The thresholds are wide: only texts far from anything their language shows are rejected.

Scale: two passes over the texts and no shuffle of text. The first emits one row per task
and language, summed into at most len(COMMON_WORDS) + 1 references of fixed width; that
bounded table goes along with the second pass.

Defined results: NULL and empty texts have no words and fail the base rule; an unknown or
NULL language uses the reference of all documents together; an empty table gives an empty
result; repeated rows are judged alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import free_names
from tabforge.session import small_batches

MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
GUARD_CHARS, GUARD_WORDS = 400, 300
CHAR_LIMIT, WORD_LIMIT, WORD_NOISE = 0.32, 0.28, 1.25
SYMBOLS = b"#*$%&|<>"
#: Common words by language (public stop-word knowledge); any list can be passed instead.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on",
           "not", "he", "are", "this", "or", "at", "from", "an"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a",
           "par", "plus", "pas", "au", "sur", "ne", "se", "ce"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem",
           "nicht", "ein", "eine", "als", "auch", "es", "an", "er", "so"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su",
           "para", "es", "al", "lo", "como", "o", "si"],
}
OTHER = ""
#: Character classes by first UTF-8 byte; continuation bytes count for none.
CLASSES = ("lower", "upper", "digit", "white", "stop", "symbol", "punct", "control", "latin", "far")


def _class_table() -> np.ndarray:
    t = np.full(256, len(CLASSES), dtype=np.int64)
    for b in range(128):
        c = chr(b)
        t[b] = (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if b in b" \t\n\x0b\x0c\r"
                else 4 if c in ".,;:!?'\"-" else 5 if b in SYMBOLS else 7 if b < 32 or b == 127 else 6)
    t[0xC2:0xCA] = 8  # two-byte characters up to U+024F, mostly Latin letters
    t[0xCA:0xF8] = 9
    return t


CLASS_OF = _class_table()


def class_counts(raw: bytes) -> np.ndarray:
    n = len(CLASSES)
    return np.bincount(CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=n + 1)[:n] if raw else np.zeros(n, np.int64)


def repeated_words(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window found twice or more. Windows are told apart exactly:
    they are numbered pair by pair, and renumbered before a number could overflow."""
    n = len(ids)
    if n <= window:
        return 0
    top = int(ids.max()) + 1
    h, most = ids[:n - window + 1].astype(np.int64), top
    for k in range(1, window):
        if most * top >= 1 << 62:
            values, h = np.unique(h, return_inverse=True)
            most = len(values)
        h = h * top + ids[k:n - window + 1 + k]
        most *= top
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def repeated_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) between rows of counts ``p`` and ``q``."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip(kl / 2, 0, 1))


def references(docs: DataFrame, text: str = "text", lang: str = "lang",
               common: dict[str, list[str]] = COMMON_WORDS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language (and OTHER: all documents) the mean character-class and common-word
    histograms over every document with words."""
    width = max(map(len, common.values())) + 1
    nc = len(CLASSES)
    cols = [f"c{i}" for i in range(nc)] + [f"w{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for t, la in zip(pdf["text"], pdf["lang"]):
                raw = t.encode() if t else b""
                ws = raw.lower().split()
                if not ws:
                    continue
                counts = class_counts(raw)
                row = np.zeros(nc + width)
                row[:nc] = counts / counts.sum()
                words = common.get(la)
                if words:
                    have = Counter(ws)
                    some = [have.get(w.encode(), 0) for w in words]
                    row[nc:nc + len(some)] = some
                    row[nc + width - 1] = len(ws) - sum(some)
                    row[nc:] /= len(ws)
                for key in (la, OTHER) if words else (OTHER,):
                    sums[key] = sums.get(key, 0) + row
        yield pd.DataFrame([[k, *v] for k, v in sums.items()], columns=["lang", *cols])

    small_batches(docs.sparkSession)
    src = docs.selectExpr(f"`{text}` AS text", f"`{lang}` AS lang")
    out = src.mapInPandas(run, "lang string, " + ", ".join(f"{c} double" for c in cols))
    rows = out.groupBy("lang").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    return {r["lang"]: (np.array([r[c] for c in cols[:nc]]), np.array([r[c] for c in cols[nc:]])) for r in rows}


def judge(docs: DataFrame, refs: dict[str, tuple[np.ndarray, np.ndarray]], text: str = "text", lang: str = "lang",
          common: dict[str, list[str]] = COMMON_WORDS, char_limit: float = CHAR_LIMIT,
          word_limit: float = WORD_LIMIT) -> DataFrame:
    """Adds a struct column ``quality`` (its name is made free of clashes): n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance (NULL for short texts in the first, without words or a known language in the
    second), kept."""
    fields = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, char_distance double, word_distance double, kept boolean")
    names = [f.split()[0] for f in fields.split(", ")]
    width = max(map(len, common.values())) + 1
    drop_symbols = bytes(SYMBOLS)

    @F.pandas_udf(fields)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs in batches:
            rows, chars, words = [], [], []
            for t, la in zip(texts, langs):
                raw = t.encode() if t else b""
                ws = raw.split()
                number: dict[bytes, int] = {}
                ids = np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int64)
                counts = class_counts(raw)
                n, rep = len(ws), repeated_words(ids)
                some = common.get(la)
                hist = np.zeros(width)
                if some:
                    have = np.bincount(ids, minlength=len(number)) if n else ids
                    # a capitalised word is the same common word
                    hist[:len(some)] = [sum(have[number[f]] for f in {w.encode(), w.capitalize().encode(), w.upper().encode()}
                                            if f in number) for w in some]
                    hist[width - 1] = n - hist.sum()
                rows.append((n, int(counts.sum() - counts[3]), len(raw) - len(raw.translate(None, drop_symbols)),
                             repeated_lines(raw), rep, n < MIN_WORDS or 100 * rep > REPEAT_PERCENT * n))
                chars.append(counts)
                words.append(hist)
            out = pd.DataFrame(rows, columns=names[:6])
            if not rows:
                yield out.reindex(columns=names)
                continue
            known = [la if la in refs else OTHER for la in langs]
            cd = _distances(np.array(chars, dtype=float), known, refs, 0)
            wd = _distances(np.array(words), known, refs, 1)
            cd[np.array([c.sum() < GUARD_CHARS for c in chars])] = np.nan
            n_words = np.maximum(out["n_words"].to_numpy(), 1)
            wd[(out["n_words"].to_numpy() == 0) | np.array([k == OTHER for k in known])] = np.nan
            wide = word_limit + WORD_NOISE * np.maximum(0, n_words ** -0.5 - GUARD_WORDS ** -0.5)
            with np.errstate(invalid="ignore"):
                out["char_distance"], out["word_distance"] = cd, wd
                out["kept"] = ~out["base_failed"] & ~(cd > char_limit) & ~(wd > wide)
            yield out

    small_batches(docs.sparkSession)
    (name,) = free_names(docs.columns, "quality")
    return docs.withColumn(name, run(F.col(text), F.col(lang)))


def _distances(rows: np.ndarray, keys: list[str], refs: dict, which: int) -> np.ndarray:
    if not refs:
        return np.full(len(rows), np.nan)
    fallback = np.zeros_like(next(iter(refs.values()))[which])
    return js_distance(rows, np.array([refs[k][which] if k in refs else fallback for k in keys]))
