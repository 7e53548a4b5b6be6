"""Phrase collocations from an FM-index per shard over word ids.

Texts are cut into pieces at punctuation, pieces into words. A task gathers the pieces of
one language into shards of about SHARD_TOKENS words and builds, per shard, the
Burrows-Wheeler transform of its pieces (each with a terminator of its own) over local word
ids. Every phrase is an interval of sorted suffixes. Extension to the left moves each
position by the LF mapping; the position it reaches lies in the interval of the phrase's
first words, so one step knows both the interval extended to the left (the rest) and the
one extended to the right (the first part), and splits all intervals of a depth at once.

Counts of a depth are summed across shards, phrases below the least count go, and only
phrases whose first part and rest are both frequent are extended in the next round. The
frequent phrases of a depth are counted; up to BROADCAST_ROWS of them are sent to the tasks,
which lead each shard's transform through the known depths again (nothing but counts is
shuffled), and beyond that they meet the shards in a join and each shard's live rows are
written. A
phrase is named by the numbers of its first part and its rest, so no hash stands for
a phrase and counts are exact. Left and right extensions come out of the same
table: a phrase of depth d + 1 is the right extension of its first part and the left
extension of its rest.

Memory and skew: a task holds one shard; a piece longer than a slice is cut, and a slice
repeats the four words that follow it as positions that count for nothing, so phrases over
the cut are counted once. A frequent phrase has at most one row per shard, summed with
map-side combining.

Defined results: NULL and empty texts have no words; a NULL language is ``und``; repeated
rows count each; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import materialize

MIN_COUNT, MAX_WORDS = 100, 5
SHARD_TOKENS = 300_000
#: Up to this many frequent phrases of a depth (counted; three numbers or a word each) are broadcast.
BROADCAST_ROWS = 200_000
SLICE_BYTES = 1 << 20

#: Fixed values of the contract: A-Z count as a-z; these characters end a piece; tab is a space.
_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\x0b\x0c\r":
    _TABLE[_c] = 10
_TABLE[9] = 32
TABLE = bytes(_TABLE)


# ---- words --------------------------------------------------------------------------------
def slices(text: str | None, size: int = SLICE_BYTES, ahead: int = MAX_WORDS - 1) -> Iterator[tuple[bytes, bytes]]:
    """The text as (own, next): own parts of about ``size`` bytes that end at the border of a
    word; next holds up to ``ahead`` following words where the cut lies inside a piece."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(TABLE)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > size:
            end = max(data.rfind(b"\n", at, at + size), data.rfind(b" ", at, at + size)) + 1
            if end <= at:  # one word fills the slice
                stops = [x for x in (data.find(b"\n", at + size), data.find(b" ", at + size)) if x >= 0]
                end = min(stops) + 1 if stops else len(data)
        following = b""
        if end < len(data) and data[end - 1] != 10:
            stop = data.find(b"\n", end)
            stop, words, here = len(data) if stop < 0 else stop, [], end
            while here < stop and len(words) < ahead:
                to = data.find(b" ", here, stop)
                to = stop if to < 0 else to
                if to > here:
                    words.append(data[here:to])
                here = to + 1
            following = b" ".join(words)
        yield data[at:end], following
        at = end


# ---- index of one shard -------------------------------------------------------------------
def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of ``symbols`` (0 = terminator; every terminator is its own symbol, ordered
    by place, before all words; the last symbol is one). Prefix doubling that sorts only
    positions which are still tied."""
    n = len(symbols)
    ends = symbols == 0
    first = np.where(ends, np.cumsum(ends) - 1, ends.sum() + symbols.astype(np.int64))
    sa = np.argsort(first, kind="stable")
    key = first[sa]

    def starts(key: np.ndarray) -> np.ndarray:
        return np.concatenate(([True], key[1:] != key[:-1]))

    new = starts(key)
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    slots = np.flatnonzero(~alone)
    step = 1
    while len(slots):
        at = sa[slots]
        # a tied suffix has no terminator in its first `step` symbols, so at + step exists
        key = rank[at] * n + rank[at + step]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        new = starts(key)
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        step *= 2
    return sa


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, Burrows-Wheeler transform) of ``symbols``; terminators stay 0."""
    sa = suffix_array(symbols)
    return sa, symbols[sa - 1]


def lf_of(bwt: np.ndarray) -> np.ndarray:
    """LF[j]: row of the suffix one symbol longer to the left: rows of a symbol begin after those of
    all smaller symbols, in the order of the symbol's occurrences in the transform. (After a
    terminator it points at some terminator's row: no phrase goes on there.)"""
    lf = np.empty(len(bwt), dtype=np.int32)
    lf[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    return lf


def pack(ascending: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    return zlib.compress(np.diff(ascending, prepend=0).astype(np.int32).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.int32), dtype=np.int32)


def extend(rows: np.ndarray, lf: np.ndarray, own: np.ndarray, gid: np.ndarray):
    """One extension of all intervals of a depth. ``rows``: ascending rows of the index that are
    alive, with their LF, whether they count, and the number of their phrase (negative: no
    longer frequent). Returns the rows alive at the next depth (rows, lf, own), the end of
    each interval among them, and the intervals' (first part, rest, count)."""
    live = gid >= 0
    rows, lf, own, gid = rows[live], lf[live], own[live], gid[live]
    at = np.searchsorted(rows, lf)
    inside = at < len(rows)
    inside[inside] = rows[at[inside]] == lf[inside]
    source, target = np.flatnonzero(inside), at[inside]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    part, rest = gid[target], gid[source]
    new = np.ones(len(part), dtype=bool)
    new[1:] = (part[1:] != part[:-1]) | (rest[1:] != rest[:-1])
    begin = np.flatnonzero(new)
    count = np.add.reduceat(own[target].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    return (rows[target], lf[target], own[target]), np.append(begin[1:], len(part))[:len(begin)], (part[begin], rest[begin], count)


class Live(NamedTuple):
    """A depth of one shard: live rows with their LF and whether they count; the end of each
    interval among them; the intervals' names (words, or first part and rest) and counts."""
    rows: np.ndarray
    lf: np.ndarray
    own: np.ndarray
    ends: np.ndarray
    names: tuple
    count: np.ndarray

    def longer(self, gid: np.ndarray) -> Live:
        """The next depth, given the number of each interval's phrase (negative: not frequent)."""
        (rows, lf, own), ends, (part, rest, count) = extend(
            self.rows, self.lf, self.own, np.repeat(gid, np.diff(self.ends, prepend=0)))
        return Live(rows, lf, own, ends, (part, rest), count)

    def written(self, shard: int) -> dict:
        part, rest = self.names
        return {"shard": shard, "part": part, "rest": rest, "count": self.count, "rows": pack(self.rows),
                "lf": self.lf.astype(np.int32).tobytes(), "own": zlib.compress(self.own.tobytes(), 1), "ends": pack(self.ends)}


def read_live(row) -> Live:
    """A written depth; the first holds the transform itself."""
    own, ends = np.frombuffer(zlib.decompress(row["own"]), np.uint8), unpack(row["ends"])
    if "bwt" in row:
        raw, first = zlib.decompress(row["bwt"]), int(row["first"])
        words = row["names"].split("\n")
        lf = lf_of(np.frombuffer(raw, np.uint16 if len(raw) == 2 * (first + len(own)) else np.int32))
        return Live(np.arange(first, len(lf), dtype=np.int32), lf[first:], own, ends, (words,), np.zeros(len(words), np.int64))
    return Live(unpack(row["rows"]), np.frombuffer(row["lf"], np.int32), own, ends, (row["part"], row["rest"]), np.asarray(row["count"]))


class WordNumbers:
    """Numbers of frequent words, by language."""

    def __init__(self, rows: list) -> None:
        self.ids = {(r["lang"], r["words"][0]): r["gid"] for r in rows}

    def __call__(self, lang: str, live: Live) -> np.ndarray:
        return np.array([self.ids.get((lang, w), -1) for w in live.names[0]], dtype=np.int64)


class PhraseNumbers:
    """Numbers of frequent phrases, by their first part and rest."""

    def __init__(self, rows: list) -> None:
        part, rest, gid = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("part", "rest", "gid"))
        self.parts, self.rests = np.unique(part), np.unique(rest)
        key = np.searchsorted(self.parts, part) * len(self.rests) + np.searchsorted(self.rests, rest)
        order = np.argsort(key)
        self.keys, self.gid = key[order], gid[order]

    def __call__(self, lang: str, live: Live) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(live.count), -1, dtype=np.int64)
        part, rest = (np.asarray(x, dtype=np.int64) for x in live.names)
        i = np.minimum(np.searchsorted(self.parts, part), len(self.parts) - 1)
        j = np.minimum(np.searchsorted(self.rests, rest), len(self.rests) - 1)
        key = i * len(self.rests) + j
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.parts[i] == part) & (self.rests[j] == rest) & (self.keys[at] == key), self.gid[at], -1)


class _Shard:
    """Words of one language on their way into a shard."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(lambda: len(self.ids) + 1)
        self.ids[b"\n"] = 0
        self.ids[b""] = -1
        self.parts: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.size = 0

    def add(self, own: bytes, ahead: bytes) -> None:
        words = own.replace(b"\n", b" \n ").split(b" ")
        more = ahead.split(b" ") if ahead else []
        x = np.fromiter(map(self.ids.__getitem__, words + more + [b"\n"]), dtype=np.int32, count=len(words) + len(more) + 1)
        counts = np.ones(len(x), dtype=np.uint8)
        counts[len(words):] = 0
        # no blanks, and one terminator where several meet
        keep = x >= 0
        x, counts = x[keep], counts[keep]
        keep = (x > 0) | np.append(False, x[:-1] > 0)
        self.parts.append(x[keep])
        self.own.append(counts[keep])
        self.size += int(keep.sum())

    def row(self, shard: int, lang: str) -> dict:
        x, own = np.concatenate(self.parts), np.concatenate(self.own)
        names = [w.decode("utf-8", "surrogatepass") for w, i in self.ids.items() if i > 0]
        sa, bwt = transform(x)
        first = int((x == 0).sum())
        sa = sa[first:]
        word, own = x[sa], own[sa]
        new = np.ones(len(word), dtype=bool)
        new[1:] = word[1:] != word[:-1]
        begin = np.flatnonzero(new)
        # local ids: blank and terminator hold two places of the dictionary
        names = [names[i - 3] for i in word[begin]]
        return {"shard": shard, "lang": lang, "names": "\n".join(names),
                "count": np.add.reduceat(own.astype(np.int64), begin), "first": first,
                "bwt": zlib.compress((bwt.astype(np.uint16) if len(self.ids) < 1 << 16 else bwt).tobytes(), 1),
                "own": zlib.compress(own.tobytes(), 1), "ends": pack(np.append(begin[1:], len(word)))}


def _shards(docs: DataFrame, tokens: int, slice_bytes: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def flush(lang: str) -> pd.DataFrame:
            nonlocal made
            made += 1
            return pd.DataFrame([held.pop(lang).row(base + made, lang)])

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                for own, ahead in slices(text, slice_bytes):
                    held.setdefault(lang, _Shard()).add(own, ahead)
                    if sum(s.size for s in held.values()) >= tokens:
                        yield flush(max(held, key=lambda x: held[x].size))
        for lang in list(held):
            if held[lang].size:
                yield flush(lang)

    return docs.mapInPandas(run, "shard long, lang string, names string, count array<long>, "
                                 "first int, bwt binary, own binary, ends binary")


# ---- rounds --------------------------------------------------------------------------------
def _numbered(phrases: DataFrame, order: list[str], name: str, few: int) -> DataFrame:
    """The phrases with a number each (``gid``), written. Up to ``few`` of them (counted) are numbered
    0, 1, ... in ``order`` by one window: small numbers keep the counted rows of the next depth
    short. More get numbers that need no common order."""
    found = materialize(phrases, f"{name}-found")
    if found.count() <= few:
        gid = F.row_number().over(Window.orderBy(*order)).cast("long") - 1
    else:
        gid = F.monotonically_increasing_id()
    return materialize(found.withColumn("gid", gid), name)


_LIVE = "shard long, part array<long>, rest array<long>, count array<long>, rows binary, lf binary, own binary, ends binary"


def _narrow(base: DataFrame) -> DataFrame:
    """What tasks need of a shard: its words as one text (a line each), split one shard at a time."""
    return base.drop("count") if "names" in base.columns else base


def _counts(base: DataFrame, numbers: list) -> DataFrame:
    """(part, rest, count) of every interval, after the depths that ``numbers`` (broadcast) lead through."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                live = read_live(row)
                for x in numbers:
                    live = live.longer(x.value(row.get("lang"), live))
                part, rest = live.names
                yield pd.DataFrame({"part": part, "rest": rest, "count": live.count})

    return _narrow(base).mapInPandas(run, "part long, rest long, count long")


def _written(base: DataFrame, numbers: list) -> DataFrame:
    """The depth that ``numbers`` lead to, as a table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                live = read_live(row)
                for x in numbers:
                    live = live.longer(x.value(row.get("lang"), live))
                yield pd.DataFrame([live.written(row["shard"])])

    return materialize(_narrow(base).mapInPandas(run, _LIVE), "phrase-rows") if numbers else base


def _extended(base: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """The next depth where the frequent phrases are too many to broadcast: they meet the
    shards' intervals in a join, and each shard meets its own."""
    names = ["part", "rest"] if "part" in base.columns else ["words"]
    if "names" in base.columns:
        base = base.withColumn("words", F.split("names", "\n"))
    groups = base.select("shard", *(["lang"] if names == ["words"] else []), F.posexplode(F.arrays_zip(*names)).alias("grp", "x"))
    groups = groups.select("*", "x.*").withColumnRenamed("words", "word")
    alive = groups.join(known.select(*on, "gid"), on).select(F.col("shard").alias("of"), "grp", "gid")

    def run(shard: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in shard.to_dict("records"):
            live = read_live(row)
            gid = np.full(len(live.count), -1, dtype=np.int64)
            gid[kept["grp"].to_numpy()] = kept["gid"].to_numpy()
            out.append(live.longer(gid).written(row["shard"]))
        return pd.DataFrame(out, columns=["shard", "part", "rest", "count", "rows", "lf", "own", "ends"])

    return materialize(_narrow(base.drop("words")).groupBy("shard").cogroup(alive.groupBy("of")).applyInPandas(run, _LIVE), "phrase-rows")


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
             shard_tokens: int = SHARD_TOKENS, slice_bytes: int = SLICE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> tuple[list[DataFrame], DataFrame]:
    """Per depth 1 .. ``max_words`` the phrases found at least ``min_count`` times: gid, lang,
    words, f, part and rest (numbers of the phrase without its last and without its first word),
    firsts (counts of its first 1, 2, ... words) and rests (counts without its first 1, 2, ...
    words); and (lang, n), all words by language."""
    src = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    spark = docs.sparkSession
    base = materialize(_shards(src, shard_tokens, slice_bytes), "phrase-shards")
    words = base.select("lang", F.explode(F.arrays_zip(F.split("names", "\n").alias("words"), "count")).alias("w")).select(
        "lang", F.col("w.words").alias("word"), F.col("w.count").alias("count"))
    totals = words.groupBy("lang").agg(F.sum("count").alias("n"))
    known = words.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= min_count)
    none = F.lit(None).cast("long")
    known = _numbered(known.select("lang", "word", "f", none.alias("part"), none.alias("rest"),
                                   F.array().cast("array<long>").alias("firsts"), F.array().cast("array<long>").alias("rests")),
                      ["lang", "word"], "phrase-words", broadcast_rows).withColumn("words", F.array("word")).drop("word")
    found, numbers = [known], []
    for depth in range(2, max_words + 1):
        if known.count() <= broadcast_rows:
            make = WordNumbers if depth == 2 else PhraseNumbers
            rows = known.select(*(["lang", "words"] if depth == 2 else ["part", "rest"]), "gid").collect()
            numbers.append(spark.sparkContext.broadcast(make(rows)))
        else:
            on = ["lang", "word"] if depth == 2 else ["part", "rest"]
            base = _extended(_written(base, numbers), known.withColumn("word", F.col("words")[0]), on)
            numbers = []
        many = _counts(base, numbers).groupBy("part", "rest").agg(F.sum("count").alias("f")).where(F.col("f") >= min_count)
        one = known.select(F.col("gid").alias("part"), "lang", F.col("words").alias("w1"), F.col("f").alias("f1"), F.col("firsts").alias("c1"))
        two = known.select(F.col("gid").alias("rest"), F.col("words").alias("w2"), F.col("f").alias("f2"), F.col("rests").alias("c2"))
        longer = many.join(one, "part").join(two, "rest").select(
            "lang", F.concat("w1", F.slice("w2", -1, 1)).alias("words"), "f", "part", "rest",
            F.concat("c1", F.array("f1")).alias("firsts"), F.concat(F.array("f2"), "c2").alias("rests"))
        known = _numbered(longer, ["part", "rest"], f"phrase-depth{depth}", broadcast_rows)
        found.append(known)
    return found, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, **limits) -> DataFrame:
    """Each language's first ``top`` phrases by score: lang, rank, phrase, a (its count), l and r
    (counts of the two parts of its lowest-scoring cut), n, score, left_ext and right_ext (its
    most frequent extensions' counts, 0 below the least count or at the greatest depth).

    score = floor(1000 a n / (l r)) of the lowest cut (ties: the smallest). A phrase that a
    longer one holds as often as it occurs goes. Arithmetic is on 38-digit decimals."""
    found, totals = frequent(docs, text, lang, **limits)
    out = None
    for depth, phrases in enumerate(found[1:], 2):
        if depth < len(found):
            longer = found[depth]
            ext = (longer.select(F.explode(F.array(F.struct(F.col("part").alias("gid"), F.col("f").alias("right"), F.lit(0).cast("long").alias("left")),
                                                   F.struct(F.col("rest").alias("gid"), F.lit(0).cast("long").alias("right"), F.col("f").alias("left")))).alias("x"))
                   .groupBy("x.gid").agg(F.max("x.left").alias("left_ext"), F.max("x.right").alias("right_ext")))
            phrases = phrases.join(ext, "gid", "left").fillna(0, ["left_ext", "right_ext"]).where(
                F.greatest("left_ext", "right_ext") < F.col("f"))
        else:
            phrases = phrases.withColumns({"left_ext": F.lit(0).cast("long"), "right_ext": F.lit(0).cast("long")})
        phrases = phrases.select("lang", "words", "f", "firsts", "rests", "left_ext", "right_ext")
        out = phrases if out is None else out.unionByName(phrases)
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    cut = F.expr(f"""array_min(transform(sequence(1, size(firsts)), k -> struct(
        (CAST(1000 AS DECIMAL(4,0)) * ({wide('f')} * {wide('n')}) div ({wide('firsts[k - 1]')} * {wide('rests[k - 1]')})) AS score,
        k AS k, firsts[k - 1] AS l, rests[k - 1] AS r)))""")
    scored = out.join(totals, "lang").withColumn("cut", cut).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", "left_ext", "right_ext")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "left_ext", "right_ext")
