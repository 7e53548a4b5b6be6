"""URL filter: a trie over reversed host labels, then path segments.

A rule is (verdict, host, path). It fits its host and every subdomain when the url's path
starts with the rule's path. The most specific rule wins: the longest host, then the
longest path; equal rules: block before allow. No rule: the ``default`` verdict.

The trie of the rules is broadcast when its rules number at most MAX_BROADCAST_RULES and
their text at most MAX_BROADCAST_BYTES; more rules are matched by an equi-join of each
url's possible (host suffix, path prefix) keys with the rules, which gives the same rows.
Urls stay where they are (one Arrow pass, no shuffle) in the first case.

Defined results: a NULL url, or one without ``://``, has empty host and path, and no rule
can fit; hosts are compared after lower-casing A-Z; empty labels (``a..b``) are labels;
no rules: every url gets the default; an empty table gives an empty result. All columns are
kept; a column of the input named ``host``, ``path``, ``rule`` or ``verdict`` stays under that
name with underscores added (``host_``). Repeated rows get equal rows; very long urls cost
their length in the trie, their host's rule lengths in the join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import free_names

MAX_BROADCAST_RULES, MAX_BROADCAST_BYTES = 200_000, 16_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path
RESULT = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _with_parts(pages: DataFrame, url: str) -> DataFrame:
    """The table with host and path added; its own columns of the result's names renamed."""
    clash = [c for c in pages.columns if c.lower() in RESULT]
    room = dict(zip(clash, free_names([*pages.columns, *RESULT], *clash)))
    base = pages.toDF(*[room.get(c, c) for c in pages.columns])
    at = F.col(f"`{room.get(url, url)}`")
    return base.withColumns({"host": host_of(at), "path": path_of(at)})


class Trie:
    """Nodes are dicts. A host node has its children under ``("h", label)`` and, when it
    is a rule's host, path nodes under ``"p"``; a path node has children under ``("s",
    segment)`` (a segment is complete: a slash follows) and ``"t"``: {unfinished last
    segment: (verdict, rule)}."""

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
                node = node.setdefault(("h", label), {})
            node = node.setdefault("p", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(("s", segment), {})
            old = node.setdefault("t", {}).get(tail)
            if old is None or verdict == "block":
                node["t"][tail] = (verdict, host + path)

    @staticmethod
    def _path(node: dict, path: str):
        """The rule with the longest path that ``path`` starts with."""
        best = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            for tail, found in node.get("t", {}).items() if len(node.get("t", {})) <= len(segment) else (
                    (segment[:k], node["t"].get(segment[:k])) for k in range(len(segment) + 1)):
                if found and segment.startswith(tail) and (best is None or i > best[0] or len(tail) >= best[1]):
                    best = (i, len(tail), found)
            if i == len(segments) - 1:
                break
            node = node.get(("s", segment))
            if node is None:
                break
        return best[2] if best else None

    def match(self, host: str, path: str):
        """(verdict, rule) of the most specific rule that fits, or None."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            if "p" in node:
                best = self._path(node["p"], path) or best
        return best


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow",
          max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule, verdict. ``rules`` is a list; a larger set than fits a
    driver can be given as DataFrame to ``judge_by_join``."""
    size = sum(len(h) + len(p) for _, h, p in rules)
    if len(rules) > max_broadcast or size > MAX_BROADCAST_BYTES:
        spark = pages.sparkSession
        return judge_by_join(pages, spark.createDataFrame(list(rules), "verdict string, host string, path string"),
                             url, default)
    trie = pages.sparkSession.sparkContext.broadcast(json.dumps([list(r) for r in rules]))

    @F.pandas_udf("rule string, verdict string")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t = Trie(json.loads(trie.value))
        for hosts, paths in batches:
            found = [t.match(h, p) if h else None for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [f[1] if f else None for f in found],
                                "verdict": [f[0] if f else default for f in found]})

    base = _with_parts(pages, url)
    (m,) = free_names(base.columns, "_match")
    return base.withColumn(m, match("host", "path")).select("*", f"{m}.rule", f"{m}.verdict").drop(m)


def judge_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The same rows for any number of rules: each distinct (host, path) is exploded into its
    host suffixes; a suffix that has rules brings the lengths of its rules' paths (distinct
    numbers, at most as many as its longest path has characters), and the path's prefixes of
    those lengths are joined with the rules on equality; the longest key wins. A suffix that
    most urls share (``com``) is one hot key on the urls' side of the joins alone, which
    adaptive execution splits."""
    rows = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict",
                        F.concat("host", "path").alias("rule"))
    rows = rows.groupBy("r_host", "r_path").agg(F.max(F.struct("verdict", "rule")).alias("r"))
    lengths = rows.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    base = _with_parts(pages, url)
    pairs = base.select("host", "path").where(F.col("host") != "").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = pairs.withColumn("r_host", F.explode(suffixes)).join(lengths, "r_host")
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")),
                           lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = keys.select("host", "path", "r_host", F.explode(prefixes).alias("r_path"))
    h, p, best_of = free_names(base.columns, "_host", "_path", "_best")
    best = (keys.join(rows, ["r_host", "r_path"])
            .groupBy(F.col("host").alias(h), F.col("path").alias(p))
            .agg(F.max(F.struct(F.length("r_host").alias("h"), F.length("r_path").alias("p"), "r")).alias(best_of)))
    return (base.join(best, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
            .withColumns({"rule": F.col(f"{best_of}.r.rule"), "verdict": F.coalesce(F.col(f"{best_of}.r.verdict"), F.lit(default))})
            .drop(h, p, best_of))
