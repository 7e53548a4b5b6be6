"""Packing documents into token sequences, best-fit decreasing.

1. Each document becomes token ids plus an end id. A document longer than a sequence is
   first cut into full windows; what remains is one piece shorter than a window.
2. Best-fit decreasing puts the pieces, longest first, into the open sequence with the
   least remaining capacity that still holds them. A segment tree indexed by remaining
   capacity finds that sequence. The decisions depend only on how many pieces each length
   has, so the packing of the WHOLE corpus is computed from one histogram of at most
   ``window`` rows: equal pieces are placed as runs, and each run becomes one row of a
   placement plan (length, rank range -> sequence range, offset).
3. A piece finds its place by its rank among the pieces of its length: a range lookup in
   the plan.

Scale: texts are read and tokenized once. Words repeat, so ids are cached per word and
only new words reach the tokenizer, many at a time. Ranks inside a length that a third of
all pieces share are spread over hash buckets. The plan is bounded by the window, not by
the corpus, and its size is checked before it is broadcast.

Defined results: NULL and empty texts are one end id; repeated rows are packed one by one;
very long texts become many full windows; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator
from itertools import compress, filterfalse, repeat
from operator import not_
from unicodedata import normalize

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import ranked_in_groups
from tabforge.session import materialize, small_batches

WINDOW, END_ID = 2048, 1
#: Most rows of the placement plan that are broadcast; a larger plan is joined by range.
MAX_PLAN_ROWS = 500_000
#: Words a worker keeps; beyond that the cache starts anew.
CACHE_WORDS = 600_000
PUNCT = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe: 's, 't ... are tokens


class WordTokenizer:
    """Ids of whole texts (as little-endian 32-bit bytes), the same as the tokenizer's
    ``encode(text, add_special_tokens=False).ids``, through a cache of words.

    White space parts tokens in this tokenizer, and ASCII capitals are lower-cased, so a
    text's ids are its words' ids in turn. A word that is letters between ASCII
    punctuation splits there as well. New all-letter cores are encoded many at once in one
    string: each is exactly one pre-token, whose last id ends a word. Everything else goes
    to the tokenizer as it is, and a text that may hold a special token as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, s: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([s], add_special_tokens=False)[0].ids, dtype="<u4")  # no offsets kept

    def _learn(self, fresh: set[bytes]) -> None:
        cache = self.cache
        cores = set(filter(bytes.isalpha, fresh))
        rest = list(fresh - cores)
        inner = list(map(bytes.strip, rest, repeat(PUNCT)))
        # letters that stay letters in the tokenizer's normal form
        letters = [c.isalpha() and (c.isascii() or normalize("NFC", c).lower().isalpha()) for c in map(bytes.decode, inner)]
        for w in compress(rest, map(not_, letters)):
            cache[w] = self._ids(w.decode()).tobytes()
        cores.update(filterfalse(cache.__contains__, compress(inner, letters)))
        todo = list(cores)
        for i in range(0, len(todo), 4096):
            some = todo[i:i + 4096]
            ids = self._ids(b" ".join(some).decode())
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(some):  # each is one pre-token (a letter gives one at least)
                raw = ids.tobytes()
                cache.update(zip(some, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
            else:
                for c in some:
                    cache[c] = self._ids(c.decode()).tobytes()
        for w, core in zip(compress(rest, letters), compress(inner, letters)):
            if core is not w:
                at = 0 if w.startswith(core) else w.index(core)
                ids = cache[core] + self._piece(w[at + len(core):])
                cache[w] = self._piece(w[:at]) + ids if at else ids

    def _piece(self, s: bytes) -> bytes:
        x = self.cache.get(s)
        if x is None:
            x = self.cache[s] = self._ids(s.decode()).tobytes() if s else b""
        return x

    def batch(self, texts: list[str | None]) -> list[bytes]:
        get = self.cache.get
        out: list[bytes] = []
        late: list[tuple[int, list[bytes], list[bytes | None], list[int]]] = []  # texts with new words, and where
        fresh: set[bytes] = set()
        for t in texts:
            if t and "<|" in t:
                out.append(self._ids(t).tobytes())
                continue
            ws = t.encode("utf-8").lower().split() if t else []
            found = list(map(get, ws))
            new = [i for i, x in enumerate(found) if x is None]
            if new:
                fresh.update(map(ws.__getitem__, new))
                late.append((len(out), ws, found, new))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if fresh:
            if len(self.cache) + len(fresh) > CACHE_WORDS:  # start anew, with this batch's new words
                self.cache = {}
            self._learn(fresh)
            ids = self.cache.__getitem__
            for at, ws, found, new in late:
                for i in new:
                    found[i] = ids(ws[i])
                out[at] = b"".join(found)
        return out


def tokenizer_in_worker(path: str) -> WordTokenizer:
    """One tokenizer per worker process. Its word cache starts empty with every task and is
    given back at the end, so that idle workers hold no memory."""
    kept = sys.modules.setdefault("_word_tokenizers", types.ModuleType("_word_tokenizers"))
    if not hasattr(kept, "by_path"):
        kept.by_path = {}
    if path not in kept.by_path:
        kept.by_path[path] = WordTokenizer(path)
    kept.by_path[path].cache = {}
    return kept.by_path[path]


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, doc_tokens, start, length, ids_crc32 (and ids): full windows, then the rest."""
    src = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, doc_tokens long, start long, length int, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer_in_worker(path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            keys, texts = pdf["doc_id"].array, pdf["text"].tolist()
            # small groups of texts bound the ids held at once, however long the texts are
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars < 1_500_000):
                    chars += len(texts[upto] or "")
                    upto += 1
                rows: list[tuple] = []
                who: list[int] = []
                for j, ids in enumerate(tok.batch(texts[at:upto]), at):
                    ids += end
                    for s in range(0, len(ids) // 4, window):
                        cut = ids[4 * s:4 * (s + window)]
                        who.append(j)
                        rows.append((len(ids) // 4, s, len(cut) // 4, zlib.crc32(cut))
                                    + ((np.frombuffer(cut, "<i4"),) if with_ids else ()))
                out = pd.DataFrame(rows, columns=["doc_tokens", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
                out.insert(0, "doc_id", keys[who])
                yield out
                at = upto
        tok.cache = {}

    return src.mapInPandas(run, schema)


class CapacityTree:
    """Open sequences by remaining capacity. A segment tree over the capacities marks
    which are in use; ``tightest(x)`` descends to the smallest capacity >= x in use.
    A leaf holds runs (first sequence, number of sequences)."""

    def __init__(self, window: int):
        self.n = 1 << window.bit_length()
        self.used = bytearray(2 * self.n)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, first: int, many: int) -> None:
        if capacity <= 0 or many <= 0:
            return
        self.runs[capacity].append((first, many))
        i = self.n + capacity
        while i and not self.used[i]:
            self.used[i] = 1
            i >>= 1

    def pop(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        if not self.runs[capacity]:
            i = self.n + capacity
            self.used[i] = 0
            while i > 1:
                i >>= 1
                self.used[i] = self.used[2 * i] or self.used[2 * i + 1]
        return run

    def tightest(self, x: int) -> int | None:
        i = self.n + x
        if self.used[i]:
            return x
        while i > 1:  # up to the first used right sibling, then down its left edge
            if not i & 1 and self.used[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.n:
            i = 2 * i if self.used[2 * i] else 2 * i + 1
        return i - self.n


def placement_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (pieces by length). Rows (length, first rank,
    pieces, per sequence, first sequence, offset): the pieces of ``length`` ranked from
    ``first rank`` fill sequences from ``first sequence`` on, ``per sequence`` each, the
    first at ``offset``. Equal pieces in a row stay in the sequence they have just
    tightened while they fit, as one-by-one placement would do."""
    tree, plan, opened = CapacityTree(window), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            cap = tree.tightest(length)
            if cap is None:
                per = window // length
                many = -(-left // per)
                first, free = opened, window
                opened += many
            else:
                first, many = tree.pop(cap)
                per, free = cap // length, cap
            full = min(many, left // per)
            offset = window - free
            if full:
                plan.append((length, rank, full * per, per, first, offset))
                tree.add(free - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < many:  # the last pieces share one more sequence
                plan.append((length, rank, left, left, first + full, offset))
                tree.add(free - left * length, first + full, 1)
                rank, full, left = rank + left, full + 1, 0
            if full < many and cap is not None:
                tree.add(free, first + full, many - full)
    return plan


def assign(cut: DataFrame, window: int = WINDOW, seed: int = 42) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, start, length, ...)."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = placement_plan(counts, window)
    plan_df = spark.createDataFrame(plan, "p_length int, p_rank long, p_pieces long, p_per long, p_seq long, p_offset long")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("start"), F.col("ids_crc32"))
    ranked = ranked_in_groups(cut.withColumn("_order", order), ["length"],
                              [F.col("_order"), F.col("doc_id"), F.col("start")],
                              F.shiftrightunsigned(F.col("_order"), 20), "_rank", buckets=256)
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1)
    on = ((F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_rank"))
          & (F.col("_rank") < F.col("p_rank") + F.col("p_pieces")))
    placed = ranked.join(F.broadcast(plan_df) if len(plan) <= MAX_PLAN_ROWS else plan_df, on, "left")
    k = F.col("_rank") - F.col("p_rank")
    return (placed.withColumn("sequence_id", F.col("p_seq") + F.floor(k / F.col("p_per")).cast("long"))
            .withColumn("offset", (F.col("p_offset") + (k % F.col("p_per")) * F.col("length")).cast("long"))
            .select(*cut.columns, "sequence_id", "offset"))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id",
         text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, doc_tokens, start, length, ids_crc32 (ids), sequence_id,
    offset. A sequence's pieces lie one after another from offset 0."""
    small_batches(docs.sparkSession)
    cut = materialize(pieces(docs, path, window, end_id, doc_id, text, with_ids), "pack-pieces")
    return assign(cut, window)


def sequences(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, tokens, pieces, padded_to: a sequence is padded to ``window`` unless
    its tokens are a power of two."""
    s = packed.groupBy("sequence_id").agg(F.sum("length").cast("long").alias("tokens"),
                                          F.count(F.lit(1)).alias("pieces"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return s.withColumn("padded_to", F.when(power, F.col("tokens")).otherwise(F.lit(window)).cast("long"))
