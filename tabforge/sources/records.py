"""CSV records from files that stay split (S1): quoted line breaks by a prefix scan.

What a line does is a function on two states: outside or inside a quoted field. A quote opens
a field at its beginning only, two quotes inside stand for one, and after the closing quote the
field runs to the separator. Functions on two states compose, so two passes read the splits in
parallel. The first composes each split's lines into one function (a short row per split); a
window over these rows, in file order, tells each split whether it begins inside a quoted field
and in which earlier split that record began. The second joins lines into records inside each
split and writes them once; only the pieces of records that cross splits are shuffled, and
joined by the split they began in. Quotes and separators are single ASCII bytes in every
charset that ``charset`` knows but UTF-16, so lines are scanned as bytes and whole records are
decoded.

Records end at ``\\n`` (a ``\\r`` before it goes). Blank lines between records are skipped. A
quote that is never closed makes the rest of its file one record, as in other CSV readers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.session import materialize
from tabforge.sources.charset import byte_lines

#: Splits that begin inside a quoted field are sent to the tasks as a table up to this many
#: (some 100 bytes each); beyond, lines are joined with them.
BROADCAST_SPLITS = 100_000
#: Bytes of records that a worker holds before it hands them on.
PIECE_BYTES = 4_000_000


def ends_inside(line: bytes, sep: bytes, inside: bool) -> bool:
    """Does the line, begun inside a quoted field or not, end inside one?"""
    at = 0
    if not inside:
        if not line.startswith(b'"'):
            at = line.find(sep + b'"')
            if at < 0:
                return False
            at += len(sep)
        at += 1
    while True:
        end = line.find(b'"', at)
        if end < 0:
            return True
        if line[end + 1:end + 2] == b'"':
            at = end + 2
            continue
        at = line.find(sep + b'"', end + 1)
        if at < 0:
            return False
        at += len(sep) + 1


def split_functions(lines: DataFrame, sep: str) -> DataFrame:
    """file, block, out_to, in_to (the state after the split's lines, 1 inside, by the state
    before them) and closes (does a field open before them close in them?). Lines without
    quotes change nothing and stay in the JVM."""
    mark = sep.encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, states, closes = None, (False, True), False
        for pdf in batches:
            out = []
            for file, block, value in zip(pdf["file"], pdf["block"], pdf["value"]):
                if (file, block) != place:
                    if place is not None:
                        out.append((*place, *states, closes))
                    place, states, closes = (file, block), (False, True), False
                line = bytes(value)
                states = ends_inside(line, mark, states[0]), ends_inside(line, mark, states[1])
                closes = closes or not states[1]
            if out:
                yield frame(out)
        if place is not None:
            yield frame([(*place, *states, closes)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file", "block", "out_to", "in_to", "closes"]).astype(
            {"out_to": int, "in_to": int, "closes": bool})

    quoted = F.decode("value", "ISO-8859-1").contains('"')
    return (lines.where(quoted).select("file", "block", "value")
            .mapInPandas(run, "file string, block long, out_to int, in_to int, closes boolean"))


def open_splits(functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """file, block, origin: the splits (of ``blocks``) that begin inside a quoted field, and the
    split in which that record began. Windows over one short row per split of a file: the last
    constant function settles the state, swaps since then turn it."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    rows = (blocks.join(functions, ["file", "block"], "left")
            .select("file", "block", F.coalesce("out_to", F.lit(0)).alias("out_to"), F.coalesce("in_to", F.lit(1)).alias("in_to"),
                    F.coalesce("closes", F.lit(False)).alias("closes")))
    constant = F.col("out_to") == F.col("in_to")
    swaps = rows.withColumn("swaps", F.sum((F.col("out_to") > F.col("in_to")).cast("long")).over(upto))
    state = (swaps.withColumn("settled", F.last(F.when(constant, F.struct("out_to", "swaps")), ignorenulls=True).over(before))
             .withColumn("seen", F.last("swaps").over(before))
             .withColumn("inside", F.pmod(F.coalesce("settled.out_to", F.lit(0)) + F.coalesce("seen", F.lit(0))
                                          - F.coalesce("settled.swaps", F.lit(0)), F.lit(2))))
    after = F.when(F.col("inside") == 1, F.col("in_to")).otherwise(F.col("out_to"))
    begins = (after == 1) & ((F.col("inside") == 0) | F.col("closes"))
    return (state.withColumn("origin", F.last(F.when(begins, F.col("block")), ignorenulls=True).over(before))
            .where("inside = 1").select("file", "block", "origin"))


def decoded(col: str, encoding: str) -> Column:
    """Binary column as text, malformed bytes as U+FFFD. The charsets that most files have are
    decoded without Python."""
    if encoding.lower() == "utf-8":
        return F.make_valid_utf8(F.col(col).cast("string"))
    latin = F.decode(F.col(col), "ISO-8859-1")
    if encoding.lower() == "iso-8859-1":
        return latin
    if encoding.lower() == "cp1252":  # ISO-8859-1 but for 0x80 to 0x9F
        there = bytes(range(0x80, 0xa0))
        return F.when(latin.rlike(r"[\x80-\x9f]"), F.translate(latin, there.decode("iso-8859-1"), there.decode("cp1252", "replace"))).otherwise(latin)

    @F.pandas_udf("string")
    def text(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: bytes(b).decode(encoding, "replace"))

    return text(col)


def csv_records(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """The records of a CSV file or folder: ``record`` (decoded text, line breaks inside quotes
    kept) and ``header`` (is it its file's first one?)."""
    lines = byte_lines(spark, path)
    mark = sep.encode()
    inside = materialize(open_splits(split_functions(lines, sep), lines.select("file", "block").distinct()), "csv-open-splits")
    if inside.count() <= BROADCAST_SPLITS:
        tagged = lines.join(F.broadcast(inside), ["file", "block"], "left")
    else:
        # the join deals lines anew, so their places go along
        placed = lines.withColumn("at", F.monotonically_increasing_id())
        tagged = (placed.join(inside, ["file", "block"], "left")
                  .repartition("file", "block").sortWithinPartitions("file", "block", "at").drop("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held, state = None, [], {}

        def piece(closed: bool) -> tuple:
            """One row from the held lines: a whole record has no ``began``."""
            if closed and not state["head"]:
                return None, None, None, b"\n".join(held), state["first"]
            return place[0], state["origin"] if state["head"] else place[1], place[1], b"\n".join(held), state["first"]

        for pdf in batches:
            out, size = [], 0
            for file, block, origin, value in zip(pdf["file"], pdf["block"], pdf["origin"], pdf["value"]):
                if (file, block) != place:
                    if held:
                        out.append(piece(False))
                    place, held = (file, block), []
                    known = not pd.isna(origin)
                    state = {"head": known, "open": known, "origin": int(origin) if known else None,
                             "first": block == 0}
                value = bytes(value)
                if not state["open"] and not held and not value.strip(b"\r"):
                    continue
                held.append(value)
                state["open"] = ends_inside(value, mark, state["open"]) if b'"' in value else state["open"]
                if not state["open"]:
                    out.append(piece(True))
                    held, state["head"], state["first"] = [], False, False
                    size += len(out[-1][3])
                    if size > PIECE_BYTES:
                        yield frame(out)
                        out, size = [], 0
            if out:
                yield frame(out)
        if held:
            yield frame([piece(False)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=["file", "began", "block", "body", "header"])
        return pdf.astype({"began": "Int64", "block": "Int64"})

    pieces = materialize(tagged.select("file", "block", "origin", "value").mapInPandas(
        run, "file string, began long, block long, body binary, header boolean"), "csv-pieces")

    # a record that crosses splits: its pieces in file order
    crossing = (pieces.where("began IS NOT NULL").groupBy("file", "began")
                .agg(F.sort_array(F.collect_list(F.struct("block", "body", "header"))).alias("p"))
                .select(F.expr("aggregate(slice(p, 2, size(p)), p[0].body, (a, x) -> a || X'0A' || x.body)").alias("body"),
                        F.expr("p[0].header").alias("header")))
    whole = pieces.where("began IS NULL").select("body", "header")
    return whole.unionByName(crossing).select(F.regexp_replace(decoded("body", encoding), "\r$", "").alias("record"), "header")
