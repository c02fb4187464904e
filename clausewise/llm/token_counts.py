"""Token counts through a two-tier lookup of pre-tokens (operator 6).

A tokenizer of the kind normalise - split into pre-tokens - BPE gives a
pre-token the same number of tokens wherever it stands.  So a text's count is
the sum of its pre-tokens' counts, and a pre-token is looked up, first in a
broadcast table of frequent ones, then in a cache of the worker, and only a miss
in both is encoded by the library.  Nothing is shuffled.

The frequent table is built from the pre-tokens of a bounded sample of texts
(``SAMPLE_ROWS``; at most ``FREQUENT`` entries are broadcast); it is a cache:
the counts do not depend on it.  The worker's cache is emptied when it exceeds
``CACHE`` entries, and pre-tokens longer than ``LONG`` are not kept in it.

Pre-tokens are found with the pattern and the normalisers that the tokenizer
file itself names, for texts of characters below U+0250 other than a few that
lower-case to more than one character; any other text, and any text that
contains an added token, is encoded whole by the library.  Both ways agree (a
test holds them against each other); a tokenizer file of another kind is always
encoded whole.

Defined cases: a null text is empty and has no tokens; repeated rows are counted
alike; other columns are kept.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.session import ship_package

SAMPLE_ROWS = 2_000
FREQUENT = 50_000
CACHE = 200_000
LONG = 64
#: Texts whose misses are encoded together.
CHUNK = 64

#: Texts of these characters are normalised and split the same way by Python and by the library.
_PLAIN = regex.compile(r"[\u0000-įı-ɏ‐-‧‰-⁞€]*")


class PreTokenizer:
    """The normaliser and the splitting pattern of a tokenizer file, when they are of the known kind."""

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        self.added = [t["content"] for t in d.get("added_tokens", [])]
        self.pattern = None
        steps = (d.get("normalizer") or {}).get("normalizers", [])
        split = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
                 and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
                 and [s["type"] for s in split] == ["Split", "ByteLevel"]
                 and (split[0]["behavior"], split[0]["invert"]) == ("Removed", True)
                 and not split[1]["add_prefix_space"] and not split[1]["use_regex"] and not d.get("post_processor"))
        if known:
            self.pattern = regex.compile(split[0]["pattern"]["Regex"])

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens of the text, or None when it is left to the library."""
        if self.pattern is None or not (text.isascii() or _PLAIN.fullmatch(text)) or any(a in text for a in self.added):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.lower())


class Counts:
    """Token counts of texts in one worker."""

    def __init__(self, spec: str, frequent: dict[str, int]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pre = PreTokenizer(spec)
        self.frequent = frequent
        self.cache: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def lengths(self, pre_tokens: Iterable[str]) -> dict[str, int]:
        """Token counts of distinct pre-tokens, encoded by the library in one call."""
        each = list(pre_tokens)
        return {p: len(e.ids) for p, e in zip(each, self.tokenizer.encode_batch_fast(each, add_special_tokens=False), strict=True)}

    def count(self, texts: Sequence[str]) -> list[int]:
        """Token counts of the texts; their misses are encoded together and cached."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        split = [self.pre.split(t) for t in texts]
        known, cached = self.frequent, self.cache
        misses = {p for parts in split for p in set(parts or ()) if p not in known and p not in cached}
        cached.update(self.lengths(misses))
        out = [self.whole(t) if parts is None else sum([known[p] if p in known else cached[p] for p in parts])
               for t, parts in zip(texts, split, strict=True)]
        for p in misses:
            if len(p) > LONG:
                del cached[p]
        return out


def frequent_lengths(texts: Iterable[str], spec: str, size: int = FREQUENT) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of the texts."""
    counts = Counts(spec, {})
    seen: Counter[str] = Counter()
    for t in texts:
        seen.update(p for p in counts.pre.split(t) or () if len(p) <= LONG)
    return counts.lengths(p for p, _ in seen.most_common(size))


def token_counts(docs: DataFrame, tokenizer_file: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """All columns of ``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    body = F.coalesce(F.col(text), F.lit(""))
    # a bounded sample that only warms the broadcast table: the first 4,000 characters of a few texts;
    # take() reads partitions until it has enough and shuffles none
    few = docs.select(F.substring(body, 1, 4000).alias("t")).take(SAMPLE_ROWS)
    shared = spark.sparkContext.broadcast((spec, frequent_lengths((r["t"] for r in few), spec)))

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker = Counts(*shared.value)
        for texts in parts:
            found: list[int] = []
            for at in range(0, len(texts), CHUNK):
                found += worker.count(texts.iloc[at:at + CHUNK].tolist())
            yield pd.Series(found, dtype="int64")

    count.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = docs.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_tokens": F.pandas_udf(count, "bigint")(body)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
