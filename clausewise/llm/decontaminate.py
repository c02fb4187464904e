"""Benchmark decontamination: a broadcast hash set of test n-grams (operator 2, DataFrame functions only).

Texts are normalised to lower-case words.  The benchmark gives windows: every
run of ``n`` consecutive words of an item, or the whole item when it is
shorter.  Their hashes, with words and item ids, form a table that is broadcast.
Its size is counted first: a table of more than ``max_windows`` rows is split by
hash, and each part is broadcast for a pass of its own.  Documents are scanned:
each window of a document is hashed in its row and probed; a hit is verified
word by word.  Every document also probes one sentinel, so that documents
without hits come out of the same scan and nothing is joined back.

Defined cases: a null or wordless text has no words and no hits; items without
words give no window; items with a null id hit but are not listed; documents
that repeat id and text get one result row each; empty tables are fine.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import bind, fresh, lower_ascii, row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words, and what lies between them, in a text that is not lower-cased yet.
WORD_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
N = 10
#: A window of ten words takes about 300 bytes: 60 MB when broadcast.
MAX_WINDOWS = 200_000
_SENTINEL = 0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, n: int = N, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``h``, ``len``, ``window`` (words) and ``items`` (ids, as a set)."""
    def runs(w: Column) -> Column:
        size = F.least(F.size(w), F.lit(n))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.slice(w, i, size)))

    return (items.select(F.col(item_id).alias("item"), F.explode(bind(words(F.col(text)), runs)).alias("window"))
             .groupBy("window").agg(F.collect_set("item").alias("items"))
             .select(F.xxhash64("window").alias("h"), F.size("window").alias("len"), "window", "items"))


def _probe(docs: DataFrame, windows: DataFrame, n: int, max_windows: int, keep: list[str], text: str) -> DataFrame:
    """One row for each document (``len`` 0) and one for each verified hit (``start``, 1-based, ``len``, ``items``)."""
    spark = docs.sparkSession
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most n rows
    lengths = sorted(sizes, reverse=True) or [n]
    sentinel = spark.range(1).select(F.lit(_SENTINEL).cast("long").alias("h"), F.lit(0).alias("len"),
                                     F.array().cast("array<string>").alias("window"),
                                     F.array().cast(windows.schema["items"].dataType).alias("items"))
    table = windows.unionByName(sentinel)
    parts = max(1, math.ceil(sum(sizes.values()) / max(max_windows, 1)))
    count = F.size("w")

    def runs(w: Column, k: int) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))),
                             lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))
        return F.when(F.size(w) >= k, hashes).otherwise(F.array().cast("array<bigint>"))

    def scan(w: Column) -> Column:
        return F.struct(w.alias("w"), F.concat(F.array(F.lit(_SENTINEL).cast("long")), *[runs(w, k) for k in lengths]).alias("runs"))

    scanned = docs.withColumn("s", bind(words(F.col(text)), scan))
    probes = scanned.select(*keep, F.col("s.w").alias("w"), F.posexplode("s.runs").alias("p", "h"))
    # position in the row's list of hashes -> first word of the window
    start, before = F.lit(None).cast("int"), F.lit(0)
    cases = []
    for k in lengths:
        cases.append((k, F.col("p") - before))
        before = before + F.greatest(count - (k - 1), F.lit(0))
    for k, value in cases:
        start = F.when(F.col("len") == k, value).otherwise(start)
    # one broadcast of bounded size per pass over the documents; nearly always there is one
    passes = [probes.join(F.broadcast(table.filter(F.pmod("h", F.lit(parts)) == i) if parts > 1 else table), "h") for i in range(parts)]
    hits = reduce(DataFrame.unionByName, passes).withColumn("start", start)
    real = (F.col("len") > 0) & (F.slice("w", F.greatest(F.col("start"), F.lit(1)), F.col("len")) == F.col("window"))
    return hits.filter(((F.col("len") == 0) & (F.col("p") == 0)) | real).select(
        *keep, count.alias("n_words"), "start", "len", "items")


def _merged(spans: Column) -> Column:
    """Sorted spans (start, end exclusive) as few disjoint ones."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                          F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, empty, add)


def contamination(docs: DataFrame, items: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: id, ``row_key``, ``n_words``, ``n_hit``, ``spans`` (merged hit spans in words,
    0-based, end exclusive), ``items`` (ids as sorted strings), ``contaminated``."""
    windows = benchmark_windows(items, n, item_id, item_text)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = rows.withColumn("_key", row_key(F.col("_id"), F.col("_text")))
    found = _probe(rows, windows, n, max_windows, ["_id", "_key"], "_text")
    span = F.when(F.col("len") > 0, F.struct((F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.col("len")).alias("end")))
    grouped = found.groupBy("_id", "_key", "n_words").agg(
        F.count(F.when(F.col("len") == 0, 1)).alias("_copies"), F.sort_array(F.collect_set(span)).alias("_spans"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string"))).alias("items"))
    spans = F.when(F.size("_spans") == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(_merged(F.col("_spans")))
    out = grouped.withColumn("spans", spans)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(
        F.col("_id").alias(doc_id), F.col("_key").alias("row_key"), F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "drop", n: int = N, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` (all columns) without contaminated documents (``mode="drop"``) or with the hit
    words and the gaps after them cut out of their texts (``mode="cut"``)."""
    if mode not in ("drop", "cut"):
        raise ValueError(f"mode must be drop or cut, not {mode}")
    other, key, spans = fresh(docs, "_id", "_key", "_spans")
    found = (contamination(docs, items, n, doc_id, text, item_id, item_text, max_windows).filter("contaminated")
             .select(F.col(doc_id).alias(other), F.col("row_key").alias(key), F.col("spans").alias(spans)).dropDuplicates([other, key]))
    on = docs[doc_id].eqNullSafe(found[other]) & (row_key(docs[doc_id], docs[text]) == found[key])
    if mode == "drop":
        return docs.join(found, on, "left_anti")
    pieces = F.regexp_extract_all(docs[text], F.lit(f"{WORD_ANY}{GAP}*"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists(found[spans], lambda s: (i >= s["start"]) & (i < s["end"])))
    cut = F.concat(F.regexp_extract(docs[text], f"^{GAP}*", 0), F.array_join(kept, ""))
    own = [F.when(found[spans].isNotNull(), cut).otherwise(docs[c]).alias(c) if c == text else docs[c] for c in docs.columns]
    return docs.join(found, on, "left").select(*own)
