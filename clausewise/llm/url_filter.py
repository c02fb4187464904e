"""URL filter: a trie over reversed host labels and path segments (operator 1).

A rule is an action (``allow`` or ``block``), a host and a path.  It fits its
host and all subdomains of it, when the path of the url starts with the path
of the rule.  Of the rules that fit, the longest (characters of host plus path)
decides; between equally long ones the longer host, then ``block``.  A url that
no rule fits gets ``default``.

The rules are a small table: they are checked against ``MAX_RULES``, turned
into one trie on the driver and broadcast; urls are judged in Arrow batches
without a shuffle.  More rules than that go through :func:`judge_by_join`,
which shuffles urls to the rules of their host suffixes and gives the same
verdicts.

Defined cases: a null url, or one without ``://``, has empty host and path and
gets the default; repeated rows are judged alike; extra columns are kept, but
for columns named host, path, rule and verdict, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import LOWER, UPPER, fresh
from clausewise.session import ship_package

#: The trie of so many rules of ordinary length stays below about 50 MB.
MAX_RULES = 200_000


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple[int, int, bool]:
        return len(self.text), len(self.host), self.action == "block"


class _Node:
    """``labels``: the next host label; ``paths``: where the path trie of this host begins."""

    __slots__ = ("ends", "labels", "paths", "segments")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.paths: _Node | None = None
        self.segments: dict[str, _Node] = {}
        self.ends: dict[str, Rule] = {}


class UrlTrie:
    """Host labels from the top-level domain down, then whole path segments; the last
    segment of a rule is a prefix, so a node keeps the prefixes that end there."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.labels.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            # the piece before the first slash is empty for every rooted path
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            kept = node.ends.get(last)
            if kept is None or rule.rank > kept.rank:
                node.ends[last] = rule

    def find(self, host: str, path: str) -> Rule | None:
        best: Rule | None = None
        pieces = path.split("/")
        node: _Node | None = self.root
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            if node.paths is None:
                continue
            at = node.paths
            for piece in pieces:
                for prefix, rule in at.ends.items():
                    if piece.startswith(prefix) and (best is None or rule.rank > best.rank):
                        best = rule
                at = at.segments.get(piece)
                if at is None:
                    break
        return best


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (text of the deciding rule or null) and ``verdict``.

    ``rules``: a list, or a table (action, host, path) whose size is counted first."""
    if isinstance(rules, DataFrame):
        if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
            return judge_by_join(urls, rules, url, default)
        rules = [Rule(r.action, r.host or "", r.path or "") for r in rules.select("action", "host", "path").collect()]
    elif len(rules) > MAX_RULES:
        return judge_by_join(urls, urls.sparkSession.createDataFrame(rules, "action string, host string, path string"),
                             url, default)
    spark = urls.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(list(rules))
    tries: list[UrlTrie] = []

    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        if not tries:
            tries.append(UrlTrie(shared.value))
        found = [tries[0].find(h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": [r.text if r else None for r in found],
                             "verdict": [r.action if r else default for r in found]}, dtype="object")

    decided = F.pandas_udf(decide, "rule string, verdict string")
    parsed = urls.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    (judged,) = fresh(parsed, "_judged")
    out = parsed.withColumn(judged, decided("host", "path"))
    return out.withColumns({"rule": F.col(judged)["rule"], "verdict": F.col(judged)["verdict"]}).drop(judged)


def judge_by_join(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The same verdicts for a rule table of any size: every url meets the rules of its
    host suffixes by an equi-join (popular hosts are split by Spark's skew handling)."""
    own = urls.columns
    parsed = urls.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    hosts = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = hosts.withColumn("_suffix", F.explode(suffixes))
    rows = rules.select(F.col("action").alias("_action"), F.coalesce("host", F.lit("")).alias("_host"),
                        F.coalesce("path", F.lit("")).alias("_path"))
    fits = wide.join(rows, (F.col("_suffix") == F.col("_host")) & F.col("path").startswith(F.col("_path")))
    text = F.concat("_host", "_path")
    rank = F.struct(F.length(text), F.length("_host"), F.col("_action") == "block")
    (won,) = fresh(parsed, "_best")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(text.alias("rule"), F.col("_action").alias("verdict")), rank).alias(won))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select(*[F.col(c) for c in own if c not in ("host", "path", "rule", "verdict")], "host", "path",
                      F.col(won)["rule"].alias("rule"), F.coalesce(F.col(won)["verdict"], F.lit(default)).alias("verdict"))
