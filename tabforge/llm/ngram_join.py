"""N-gram Jaccard self-join of documents by rare-first prefix filtering.

Two documents link when ``100 * |intersection| >= 75 * |union|`` of their sets of 5-word
shingles. All shingles have one common order, rare first. If two documents link, their
prefixes - the first ``n - ceil(0.75 n) + 1`` shingles of each - share a shingle, so
candidates come from a join on prefix shingles alone. Candidates pass the length filter and
the positional filter (what can still be shared after this position). The suffix filter
bounds a pair's intersection by the sum, over equal parts of the hash range, of the smaller
of the two counts; a document's counts are a few bytes per hundred of its set, so pairs that
cannot link are dropped before any set is moved. What is left is verified once, exactly.

The order: a counting sketch of SLOTS counters over the shingles of ALL documents estimates
how frequent a shingle is; frequent classes come last, hash order breaks ties. Any common
order gives the same links, so the estimate touches speed only.

Groups of copies cost linear work. Documents with equal sets share one key, and one task
emits a key once. Inside a bucket (documents sharing a prefix shingle) each document meets
the bucket's shortest and its neighbour in length; over all its buckets, the first round
compares it with the FIRST_PARTNERS it met most often. Links found there join documents into
components. While a bucket's members outside its main component would make many pairs,
sampled rounds, linear in the rows left, deal each bucket by a hash of the document into hands
of about SHARE rows (SHARE times as many each round), and a member tries the hand-mates it met
most often: near copies that differ among themselves soon meet one they link with, and leave
the rows that are left. The last round compares exactly those pairs of a bucket whose documents
are still not in one component: members outside the bucket's main component against all. Every
pair that passes the filters is thus either verified or already connected, so components are
those of all links, whatever was sampled before. A frequent shingle's bucket is salted by its
estimate into parts of about SALT_ROWS rows whose first rows are linked in turn.

Texts are read twice (sketch and keys, prefixes) and once more in each round that needs sets
not written yet; they are never shuffled. Broadcast are the sketch (SLOTS counters) and a bitmap of the documents that
verification needs (NEED_BITS bits; a false positive ships a set in vain). A finished round's
tables are deleted.

Defined results: a NULL or white text has the empty set, links with nothing, and is its own
component; a NULL doc_id is never a component's name while another member has one;
repeated rows share a component; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import free_names
from tabforge.llm.shingles import shingle_sets
from tabforge.operators.density import connected_min_labels
from tabforge.session import materialize, release, small_batches

PERCENT = 75
SLOTS, BLOCKS, SALTS = 1 << 18, 16, 1024
SALT_ROWS = 20_000
FIRST_PARTNERS = 2
SHARE = 8  # rows of a hand in the first sampled round, and partners a member tries of it
FEW_PAIRS = 4  # pairs a row that the exact round takes without sampling first
GROWTH = 16  # sampling goes on while a round adds a document to this many linked ones
FLUSH = 100_000  # shingles a worker holds before it hands rows on
NEED_BITS = 1 << 24
FILE_ROWS = 100_000  # rows of a written table for which a file more than one a core is worth while
SET_ROWS = 20  # such rows that a set counts for


# ---- arithmetic of the filters ------------------------------------------------------------
def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles that two linked documents cannot both avoid sharing."""
    return n - (percent * n + 99) // 100 + 1


def required(n1, n2, percent: int = PERCENT):
    """Least intersection of linked sets of sizes n1 and n2."""
    return (percent * (n1 + n2) + 99 + percent) // (100 + percent)


def may_link(n1, pos1, n2, pos2, percent: int = PERCENT):
    """Length and positional filter; works on numbers, arrays and (through SQL) columns."""
    least, most = np.minimum(n1, n2), np.maximum(n1, n2)
    left = 1 + np.minimum(n1 - pos1 - 1, n2 - pos2 - 1)
    return (100 * least >= percent * most) & (left >= required(n1, n2, percent))


def may_link_sql(a: str, b: str, percent: int = PERCENT) -> Column:
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND "
        f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= ({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent}")


def part_counts(s: np.ndarray) -> bytes:
    """Shingles in each of 2^b equal parts of the hash range (2 to 4 a part on average),
    one byte each; 255 stands for 255 or more."""
    b = max(0, (len(s) - 1).bit_length() - 2)
    if b == 0:
        return bytes([min(len(s), 255)])
    counts = np.bincount((s >> np.uint64(64 - b)).astype(np.int64), minlength=1 << b)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def suffix_bound(a: bytes, b: bytes) -> int | None:
    """Upper bound of the intersection from two documents' part counts (the finer one is
    summed up to the coarser); None if a part is too full to tell."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if (len(x) and x.max() == 255) or (len(y) and y.max() == 255):
        return None
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(axis=1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1)
    return int(np.minimum(x, y).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Do two sorted sets link?"""
    need = required(len(a), len(b), percent)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) >= need


def slot_of(s: np.ndarray) -> np.ndarray:
    """Counter of each shingle: its top bits."""
    return (s >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def short_id(key: bytes) -> int:
    """64 bits of the key: documents that share them by chance only cost extra candidates."""
    return int.from_bytes(key[:8], "little", signed=True)


# ---- pass 1: keys and the frequency sketch ----------------------------------------------------
def _profile(src: DataFrame) -> DataFrame:
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for pdf in batches:
            keys, ids, parts, sizes, slots, held = [], [], [], [], [], 0
            for s in shingle_sets(pdf["text"].tolist()):
                sizes.append(len(s))
                key = set_key(s) if len(s) else None
                keys.append(key.hex() if key else None)
                ids.append(short_id(key) if key else None)
                parts.append(part_counts(s) if key else None)
                slots.append(slot_of(s))
                held += len(s)
                if held > FLUSH:
                    counts += np.bincount(np.concatenate(slots), minlength=SLOTS)
                    slots, held = [], 0
            if slots:
                counts += np.bincount(np.concatenate(slots), minlength=SLOTS)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "set_key": keys, "id": pd.array(ids, dtype="Int64"), "n": sizes,
                                "parts": parts, "block": None, "counts": None})
        size = SLOTS // BLOCKS
        yield pd.DataFrame({"doc_id": pd.Series([None] * BLOCKS), "set_key": None, "id": None, "n": None, "parts": None, "block": range(BLOCKS),
                            "counts": [counts[i * size:(i + 1) * size].tobytes() for i in range(BLOCKS)]})

    return src.mapInPandas(run, f"doc_id {kind}, set_key string, id long, n long, parts binary, block int, counts binary")


def _sketch(profile: DataFrame) -> np.ndarray:
    """The SLOTS counters, summed in two levels so that no group holds all tasks' parts."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [total.tobytes()]})

    parts = profile.where("block IS NOT NULL").select("block", "counts")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
    # fewer partial sums than SALTS need no first level
    if parts.count() > BLOCKS * SALTS:
        parts = parts.groupBy("block", "salt").applyInPandas(add, "block int, counts binary")
    rows = parts.groupBy("block").applyInPandas(add, "block int, counts binary").orderBy("block").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]) if rows else np.zeros(SLOTS, np.int64)


def frequency_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per slot: class (0 = no more than chance, else the logarithm of the excess) and the
    number of salts of a bucket that large."""
    mean = counts.mean()
    extra = np.maximum(counts - mean, 0)
    stands_out = extra > 6 * np.sqrt(mean + 1) + 4
    level = np.where(stands_out, np.floor(np.log2(np.maximum(extra, 1))) + 1, 0).astype(np.int8)
    return level, np.where(stands_out, extra // SALT_ROWS + 1, 1).astype(np.int32)


# ---- pass 2: prefixes, buckets and first candidates -------------------------------------------
def _prefixes(src: DataFrame, level, salts, percent: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cls = level.value
        seen: set[bytes] = set()
        for pdf in batches:
            h, who, n, pos, held = [], [], [], [], 0
            for s in shingle_sets(pdf["text"].tolist()):
                if not len(s):
                    continue
                key = set_key(s)
                if key in seen:
                    continue
                seen.add(key)
                if held > FLUSH:
                    yield rows(h, who, n, pos)
                    h, who, n, pos, held = [], [], [], [], 0
                c = cls[slot_of(s)]
                p = prefix_length(len(s), percent)
                # s is in hash order already: rare first is a stable sort by class
                first = s[:p] if not c.any() else s[np.argsort(c, kind="stable")[:p]]
                h.append(first)
                who.append(np.full(p, short_id(key)))
                n.append(np.full(p, len(s), dtype=np.int32))
                pos.append(np.arange(p, dtype=np.int32))
                held += p
            if h:
                yield rows(h, who, n, pos)

    def rows(h: list, who: list, n: list, pos: list) -> pd.DataFrame:
        hh, ids = np.concatenate(h), np.concatenate(who)
        k = salts.value[slot_of(hh)]
        return pd.DataFrame({"h": hh.view(np.int64), "salt": (ids % k).astype(np.int32), "salts": k, "id": ids,
                             "n": np.concatenate(n), "pos": np.concatenate(pos)})

    return src.mapInPandas(run, "h long, salt int, salts int, id long, n int, pos int")


def _live(prefixes: DataFrame, percent: int) -> DataFrame:
    """Rows of buckets that hold two documents or more, with the partners of the first
    round: the bucket's first row and the row before, where they pass the filters."""
    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prefixes.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "n", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            # the last bucket may go on in the next batch
            h, salt = pdf["h"].to_numpy(), pdf["salt"].to_numpy()
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])))
            last = int(np.flatnonzero(new)[-1])
            held = pdf.iloc[last:]
            if last:
                yield buckets(pdf.iloc[:last], new[:last])
        if held is not None and len(held):
            yield buckets(held, np.arange(len(held)) == 0)

    def buckets(pdf: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
        ids, n, pos = pdf["id"].to_numpy(), pdf["n"].to_numpy().astype(np.int64), pdf["pos"].to_numpy().astype(np.int64)
        # a copy of the same set, emitted by another task
        again = np.zeros(len(pdf), dtype=bool)
        again[1:] = (ids[1:] == ids[:-1]) & ~new[1:]
        if again.any():
            pdf, new = pdf[~again], new[~again]
            ids, n, pos = ids[~again], n[~again], pos[~again]
        start = np.maximum.accumulate(np.where(new, np.arange(len(pdf)), 0))
        alone = new & np.append(new[1:], True)
        before = np.maximum(np.arange(len(pdf)) - 1, 0)
        hub_ok = ~new & may_link(n, pos, n[start], pos[start], percent)
        prev_ok = ~new & (before != start) & may_link(n, pos, n[before], pos[before], percent)
        out = pdf.assign(first=new, hub=pd.array(np.where(hub_ok, ids[start], 0), dtype="Int64"),
                         prev=pd.array(np.where(prev_ok, ids[before], 0), dtype="Int64"))
        out.loc[~hub_ok, "hub"] = pd.NA
        out.loc[~prev_ok, "prev"] = pd.NA
        return out[~alone | (pdf["salts"].to_numpy() > 1)][
            ["h", "salts", "id", "n", "pos", "first", "hub", "prev"]]

    return rows.mapInPandas(run, "h long, salts int, id long, n int, pos int, first boolean, hub long, prev long")


def _first_round(live: DataFrame) -> DataFrame:
    """(a, b): each document with the partners it shares most buckets with. (Which pairs go
    first is a matter of speed: the second round compares whatever is not connected then.)"""
    met = (live.select(F.col("id").alias("a"), F.explode(F.array("hub", "prev")).alias("b")).where("b IS NOT NULL")
           .groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("k"), "b"))
    return met.withColumn("r", rank).where(F.col("r") <= FIRST_PARTNERS).select("a", "b")


def _pairs(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return (out.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _screened(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs that pass the suffix filter."""
    @F.pandas_udf("boolean")
    def check(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
        out = []
        for x, n1, y, n2 in zip(a, na, b, nb):
            bound = suffix_bound(x, y)
            out.append(bound is None or bound >= required(n1, n2, percent))
        return pd.Series(out, dtype=bool)

    one = parts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa"))
    two = parts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))
    return pairs.join(one, "a").join(two, "b").where(check("pa", "na", "pb", "nb")).select("a", "b").distinct()


# ---- pass 3: verification -----------------------------------------------------------------------
def _sets(src: DataFrame, pairs: DataFrame, known: list[DataFrame], rows: int) -> list[DataFrame]:
    """The written tables (id, set_key, body) that hold the sets of the candidate pairs:
    those ``known`` and, where ids are missing there, one more."""
    spark = src.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    for t in known:
        ids = ids.join(t.select("id"), "id", "left_anti")
    slot = F.col("id").bitwiseAND(F.lit(NEED_BITS - 1)) + 1
    needed = ids.select(slot.alias("s")).distinct()
    blocks = needed.groupBy(F.bitmap_bucket_number("s").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()  # at most NEED_BITS / 32768 rows
    if not blocks:
        return known
    bits = np.zeros(NEED_BITS // 8, dtype=np.uint8)
    for r in blocks:
        bits[(r["k"] - 1) * 4096:r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    need = spark.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask, seen = need.value, set()
        for pdf in batches:
            ids, keys, bodies, held = [], [], [], 0
            for s in shingle_sets(pdf["text"].tolist()):
                if not len(s):
                    continue
                if held > FLUSH:
                    yield pd.DataFrame({"id": ids, "set_key": keys, "body": bodies})
                    ids, keys, bodies, held = [], [], [], 0
                key = set_key(s)
                x = short_id(key)
                at = x & (NEED_BITS - 1)
                if mask[at >> 3] >> (at & 7) & 1 and key not in seen:
                    seen.add(key)
                    ids.append(x)
                    keys.append(key.hex())
                    bodies.append(s.tobytes())
                    held += len(s)
            if ids:
                yield pd.DataFrame({"id": ids, "set_key": keys, "body": bodies})

    found = src.mapInPandas(sets, "id long, set_key string, body binary").dropDuplicates(["id", "set_key"])
    for t in known:  # ids that share a place of the bitmap
        found = found.join(t.select("id"), "id", "left_anti")
    return [*known, _written(found, "ngram-sets", SET_ROWS * rows)]


def _verified(pairs: DataFrame, sets: list[DataFrame], percent: int) -> DataFrame:
    """Links (key_a, id_a, key_b, id_b) among candidate pairs (a, b) of short ids."""
    found = sets[0]
    for t in sets[1:]:
        found = found.unionByName(t)
    one = found.select(F.col("id").alias("a"), F.col("set_key").alias("key_a"), F.col("body").alias("body_a"))
    two = found.select(F.col("id").alias("b"), F.col("set_key").alias("key_b"), F.col("body").alias("body_b"))

    @F.pandas_udf("boolean")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)],
                         dtype=bool)

    return (pairs.join(one, "a").join(two, "b").where(check("body_a", "body_b"))
            .select("key_a", F.col("a").alias("id_a"), "key_b", F.col("b").alias("id_b")))


def _written(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``materialize`` for a table of ``rows`` rows or so: one file a core, and one for each
    FILE_ROWS rows beyond. A round's tables are small and many, and a file for every shuffle
    partition costs more (on a local file system a process started to set its mode) than its rows."""
    return materialize(df.coalesce(_files(df, rows)), name)


def _files(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def _labels(edges: DataFrame, rows: int) -> DataFrame:
    """(node, label) of the nodes of edges (a, b), by connected component."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return connected_min_labels(nodes, edges, _files(edges, rows))


def _key_edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def _more_labels(labels: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """The labels after further links: components of the components."""
    edges = _key_edges(links)
    for side in ("a", "b"):
        named = labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
        edges = edges.join(named, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    edges = _written(edges.select("a", "b", "la", "lb"), "ngram-edges2", rows)
    over = _labels(edges.select(F.col("la").alias("a"), F.col("lb").alias("b")), rows).select(
        F.col("node").alias("label"), F.col("label").alias("top"))
    new = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("la").alias("label")),
                                         F.struct(F.col("b").alias("node"), F.col("lb").alias("label")))).alias("x")).select("x.*")
    return (labels.select("node", "label").unionByName(new).distinct().join(over, "label", "left")
            .select("node", F.coalesce("top", "label").alias("label")))


def _by_id(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) of the linked documents."""
    known = links.select(F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("key_a").alias("node")),
                                           F.struct(F.col("id_b").alias("id"), F.col("key_b").alias("node")))).alias("x"))
    return known.select("x.*").distinct().join(labels, "node").select("id", "label").dropDuplicates(["id"])


def _labelled(live: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows (h, id, n, pos) with their component's label, their own id where they have none."""
    return (live.select("h", "id", "n", "pos").join(labels, "id", "left")
            .withColumn("label", F.coalesce("label", F.col("id").cast("string"))))


def _all(links: list[DataFrame], none: DataFrame) -> DataFrame:
    for t in links:
        none = none.unionByName(t)
    return none


def _mixed(live: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that still hold several components (h, id, n, pos, label, main: the
    label of most rows, rows: the bucket's size)."""
    rows = _labelled(live, labels)
    per = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k"))
    main = (per.groupBy("h").agg(F.max(F.struct("k", "label")).alias("m"), F.count(F.lit(1)).alias("labels"), F.sum("k").alias("rows"))
            .where("labels > 1").select("h", F.col("m.label").alias("main"), "rows"))
    return rows.join(main, "h")


def _apart(mixed: DataFrame, percent: int, share: int | None = None, turn: int = 0) -> DataFrame:
    """(a, b): pairs of one bucket whose documents are in different components, members outside
    the main component against all others. With ``share`` a bucket is dealt by a hash of the id
    (new each ``turn``) into hands of about that many rows and pairs are made in a hand; the
    hands are nested, so two documents of one hand meet in all buckets of that size. Of these
    a member tries the ``share`` it met most often."""
    hands = F.lit(1)
    if share is not None:
        hands = F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.col("rows") / F.lit(share))), F.lit(0))).cast("long")
    dealt = mixed.withColumn("hand", F.pmod(F.xxhash64("id", F.lit(turn)), hands))
    o, r = dealt.where("label != main").alias("o"), dealt.alias("r")
    met = (o.join(r, (F.col("o.h") == F.col("r.h")) & (F.col("o.hand") == F.col("r.hand")))
           .where((F.col("o.label") != F.col("r.label"))
                  & ((F.col("r.label") == F.col("r.main")) | (F.col("o.id") < F.col("r.id"))) & may_link_sql("o", "r", percent))
           .select(F.col("o.id").alias("a"), F.col("r.id").alias("b")))
    if share is None:
        return met
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("k"), "b"))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).withColumn("r", rank).where(F.col("r") <= share).select("a", "b")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_key (equal for equal sets, NULL for the
    empty set), component_id (smallest doc_id reachable by links), n_links (links of its set
    found in verification; a lower bound inside groups of copies), root (a set key that names
    the component, also where components share a doc_id or have none)."""
    src = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    spark = docs.sparkSession
    small_batches(spark)
    profile = materialize(_profile(src), "ngram-profile")
    counts = _sketch(profile)
    level, salts = frequency_classes(counts)
    prefixes = _prefixes(src, spark.sparkContext.broadcast(level), spark.sparkContext.broadcast(salts), percent)
    # a prefix is the share of a set that may be missing, and one shingle more
    live = _written(_live(prefixes, percent), "ngram-live", int(counts.sum()) * (100 - percent) // 100 + profile.count())

    salted = live.where("first AND salts > 1")  # one row per part of a frequent bucket
    hubs = salted.groupBy("h").agg(F.min(F.struct("n", "id", "pos")).alias("top"))
    across = (salted.alias("s").join(hubs.select("h", "top.*").alias("t"), F.col("s.h") == F.col("t.h"))
              .where(may_link_sql("s", "t", percent)).select(F.col("s.id").alias("a"), F.col("t.id").alias("b")))
    suffixes = _written(profile.where("set_key IS NOT NULL").select("id", "set_key", "n", "parts")
                        .dropDuplicates(["id", "set_key"]).select("id", "n", "parts"), "ngram-suffixes", profile.count())
    n_sets, n_live = suffixes.count(), live.count()  # footers only
    none = spark.createDataFrame([], "key_a string, id_a long, key_b string, id_b long")
    links, bodies, tried = [], [], []

    def verify(pairs: DataFrame, rows: int) -> DataFrame | None:
        """Screens and verifies new pairs (``rows`` or so); the links found, None if there are none."""
        nonlocal bodies
        tried.append(_written(pairs, "ngram-pairs", rows))
        screened = _written(_screened(tried[-1], suffixes, percent), "ngram-screened", tried[-1].count())
        if screened.isEmpty():
            release(screened)
            return None
        bodies = _sets(src, screened, bodies, n_sets)
        found = _verified(screened, bodies, percent)
        # dealt, not coalesced: a task that verifies several partitions keeps all their Python queues
        found = materialize(found.repartition(_files(found, screened.count())), "ngram-links")
        release(screened)
        links.append(found)
        return None if found.isEmpty() else found

    found = verify(_pairs(_first_round(live), across), FIRST_PARTNERS * n_sets)
    labels = _written(_labels(_key_edges(none if found is None else found), n_sets), "ngram-labels", n_sets)
    share, nodes, grown = SHARE, labels.count(), None
    while True:
        mixed = _written(_mixed(live, _by_id(_all(links, none), labels)), "ngram-mixed", n_live)
        size, most = mixed.agg(F.count(F.lit(1)), F.sum(F.when(F.col("label") != F.col("main"), F.col("rows")))).first()
        # the pairs that are left are few, or the last sampled round joined few documents
        whole = (most or 0) <= FEW_PAIRS * size or (grown is not None and GROWTH * grown < nodes)
        near = _pairs(_apart(mixed, percent, None if whole else share, share))
        for t in tried:
            near = near.join(t, ["a", "b"], "left_anti")
        found = verify(near, int(most or 0) if whole else min(int(most or 0), share * n_sets))
        release(mixed)
        if found is not None:
            older, labels = labels, _written(_more_labels(labels, found, n_sets), "ngram-labels", n_sets)
            release(older)
        if whole:
            break
        share, grown = share * SHARE, labels.count() - nodes
        nodes += grown
    release(live, suffixes, *tried, *bodies)

    sets = profile.where("block IS NULL")
    degree = (_key_edges(_all(links, none)).select(F.explode(F.array("a", "b")).alias("node"))
              .groupBy("node").agg(F.count(F.lit(1)).alias("n_links")))
    named = labels.join(degree, "node").withColumnRenamed("node", "set_key")
    keys = (sets.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("least"))
            .join(named, "set_key", "left").withColumn("root", F.coalesce("label", "set_key")))
    keys = _written(keys, "ngram-keys", n_sets)
    roots = keys.groupBy("root").agg(F.min("least").alias("component_id"))
    keys = keys.join(roots, "root").select("set_key", "component_id", "n_links", "root")
    return (sets.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(keys, "set_key", "left")
            .select("doc_id", "n_shingles", "set_key",
                    F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), "root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
             slots: int = 1 << 18) -> DataFrame:
    """The documents without all but one of each component: of the rows that carry the
    component's smallest doc_id, the one with the smallest set key. Components that share a
    doc_id, or have none, each keep their own. Documents with the empty set stay. All columns
    are kept.

    Only documents that may be in a group of two or more rows are shuffled: the ids of such
    groups are hashed to at most ``slots`` numbers, a bounded broadcast table; rows outside
    stay where they are, rows inside meet the exact list in a join."""
    groups = components(docs, doc_id, text, percent)
    groups = _written(groups, "ngram-groups", docs.count())
    grouped = groups.where("set_key IS NOT NULL")
    # NULL ids hash like any other value, so they meet the exact list too
    sizes = grouped.groupBy("root").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "set_key")).alias("stay"))
    many = sizes.where("k > 1")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)).cast("int")
    members = grouped.join(many.select("root"), "root", "left_semi")
    flagged = F.broadcast(members.select(slot(F.col("doc_id")).alias("slot")).distinct())

    (key, at) = free_names(docs.columns, "_set_key", "_slot")
    marked = docs.withColumn(at, slot(F.col(doc_id)))
    outside = marked.join(flagged, F.col(at) == F.col("slot"), "left_anti").select(*docs.columns)
    inside = marked.join(flagged, F.col(at) == F.col("slot"), "left_semi").select(*docs.columns)

    @F.pandas_udf("string")
    def key_of(texts: pd.Series) -> pd.Series:
        return pd.Series([set_key(s).hex() if len(s) else None for s in shingle_sets(texts.tolist())], dtype=object)

    inside = inside.withColumn(key, key_of(F.col(text)))
    stay = sizes.select(F.col("stay.doc_id").alias("stay_id"), F.col("stay.set_key").alias("stay_key"))
    chosen = (inside.join(stay, F.col(doc_id).eqNullSafe(F.col("stay_id")) & (F.col(key) == F.col("stay_key")), "left_semi")
              .dropDuplicates([doc_id, key]))
    chosen = chosen.coalesce(_files(chosen, SET_ROWS * groups.count()))  # whole rows
    empty = inside.where(F.col(key).isNull())
    return outside.unionByName(chosen.select(*docs.columns)).unionByName(empty.select(*docs.columns))
