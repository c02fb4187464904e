"""Phrase collocations by vertically partitioned suffix trees (operator 13).

The corpus is a text of words; a phrase's count is the number of leaves below its
node in the tree of all word suffixes, truncated at ``MAX_WORDS`` words.  The tree
is built in independent parts, each a set of word prefixes that fits a budget:

1. Counts of words by language, then of the pairs of frequent words
   (``MIN_COUNT``) and of the triples of frequent pairs, each pre-aggregated where
   it is read; pairs and triples by their 64-bit hashes, packed into one row for each
   bucket of them.  A bitmap of the hashes of the frequent ones, of a fixed size, tells
   the next pass what it may leave out.  A bitmap that fills up lets more through
   and loses nothing.
2. The truncated suffixes: at each position the words up to the first pair or
   triple that is infrequent, the end of the piece or ``MAX_WORDS``.  No frequent
   phrase goes over such a place.  Equal suffixes are summed where they are read,
   packed into one row for each bucket of their hashes, and summed over all by
   bucket: the leaves.
3. Vertical partitioning: a word prefix with more than ``PREFIX`` leaves is
   extended by a word, again and again; a leaf belongs to its shortest prefix
   within the budget, and prefixes are dealt over groups of about ``GROUP`` leaves.
   The extended prefixes are few (at most leaves / budget), and their counts are
   the sums taken in extending them.
4. Every group is sorted (Spark spills) and read as a stream; the open path of
   the subtree, ``MAX_WORDS`` nodes at most, takes up the counts of its leaves.

The frequent phrases so counted are exact.  Their cuts look up the counts of the
parts in the same table, in integer arithmetic of 38 digits.

Texts are cut into words in Arrow batches, by language, with numpy over the bytes;
a worker holds a slice of ``SLICE`` bytes, or one text if that is longer.

Defined cases: a null text is empty; a null lang is ``und``, together with that
name; repeated rows count again; empty tables give no phrases; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.session import cut_lineage, ship_package

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: Bits of the filters of frequent words, and of pairs and triples: 1 MB and 8 MB at most.
WORD_BITS, PAIR_BITS = 23, 26
#: Leaves of a prefix that is not extended, and of a group of prefixes.
PREFIX, GROUP = 50_000, 400_000
#: Buckets of hashes at least; as many as shuffle partitions if those are more, so that a bucket is a partition's share at most.
BUCKETS = 512
#: Bytes of text that a worker cuts into words at once.
SLICE = 6_000_000
_EXTENDED = 100_000

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[9] = 32
_BYTES[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10


# ---------------------------------------------------------------- words of a batch

def cut_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Codes of all words, the number of each word's piece, and the distinct words."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    b = _BYTES[raw]
    if not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), pa.array([], pa.string())
    begins = np.zeros(len(b), dtype=bool)
    begins[(at[:-1] - at[0])[at[:-1] < at[-1]]] = True
    apart = (b == 32) | (b == 10)
    first = ~apart
    last = first.copy()
    first[1:] &= apart[:-1] | begins[1:]
    last[:-1] &= apart[1:] | begins[1:]
    start = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - start)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(b[~apart])).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero((b == 10) | begins), start, side="right")
    return words.indices.to_numpy().astype(np.int64), piece, words.dictionary


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.StringArray]]:
    """Language, codes, pieces and distinct words of slices of about ``SLICE`` bytes of batches (lang, text)."""
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        codes = lang.indices.to_numpy()
        for i, name in enumerate(lang.dictionary.to_pylist()):
            texts = batch.column(1).filter(pa.array(codes == i))
            sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            begin = 0
            while begin < len(texts):
                done = sizes[begin - 1] if begin else 0
                end = max(int(np.searchsorted(sizes, done + SLICE, side="right")), begin + 1)
                yield (name, *cut_words(texts.slice(begin, end - begin)))
                begin = end


# ---------------------------------------------------------------- filters

def bitmap(hashes: DataFrame, column: str, bits: int) -> bytes:
    """A filter of ``2**bits`` bits: those of the hashes' low bits are set.  Its size does not depend on the rows."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + 1
    rows = (hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("no"))
                  .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    out = bytearray((1 << bits) // 8)
    for r in rows:
        begin = (r["no"] - 1) * 4096
        out[begin:begin + 4096] = r["bits"]
    return bytes(out)


def _holds(filter_bits: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes & np.uint64((1 << bits) - 1)
    return (filter_bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_hashes(lang: str, words: pa.StringArray) -> np.ndarray:
    """The same as Spark's ``xxhash64(lang, word)``."""
    seed = xxhash.xxh64_intdigest(lang, seed=42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def _pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- passes over the texts

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, codes, _, words in slices(batches):
        n = np.bincount(codes, minlength=len(words))
        # a row without word: how many words there are
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) + 1), pa.string()), pa.concat_arrays([words, pa.array([None], pa.string())]),
                                          pa.array(np.append(n, len(codes)), pa.int64())], ["lang", "word", "n"])


def _candidate_pairs(lang: str, codes: np.ndarray, piece: np.ndarray, words: pa.StringArray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose word and next word may be frequent, in one piece; and the hashes of the distinct words."""
    hashes = word_hashes(lang, words)
    may = _holds(frequent, hashes, WORD_BITS)[codes]
    return np.flatnonzero(may[:-1] & may[1:] & (piece[:-1] == piece[1:])), hashes


def _pairs_on(lang: str, codes: np.ndarray, piece: np.ndarray, words: pa.StringArray, frequent: np.ndarray,
              bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where a pair that may be frequent begins; where two such pairs overlap, and the hash of that triple; the words' hashes."""
    at, hashes = _candidate_pairs(lang, codes, piece, words, frequent)
    named = _pair_hashes(hashes[codes[at]], hashes[codes[at + 1]])
    may = _holds(bound, named, PAIR_BITS)
    at, named = at[may], named[may]
    on = np.zeros(len(codes) + 1, dtype=bool)
    on[at] = True
    three = on[at + 1]
    return on[:-1], at[three], _pair_hashes(named[three], hashes[codes[at[three] + 2]]), hashes


def truncated_suffixes(codes: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes of two words and more: codes (-1 beyond their end), lengths and counts.

    A suffix at ``i`` has two words if ``pairs[i]``, and goes on from its k-th word to
    the one after the next as long as ``triples`` holds there."""
    go = np.append(triples, np.zeros(MAX_WORDS, dtype=bool))
    at = np.flatnonzero(pairs)
    run, length = go[at], np.full(len(at), 2)
    for k in range(1, MAX_WORDS - 1):
        length += run
        run = run & go[at + k]
    padded = np.append(codes, np.full(MAX_WORDS, -1))
    table = np.stack([np.where(k < length, padded[at + k], -1) for k in range(MAX_WORDS)], axis=1)
    width = int(codes.max(initial=0)) + 2
    name = np.zeros(len(at), dtype=np.int64)
    for k in range(MAX_WORDS):  # exact names of rows, a column at a time
        _, name = np.unique(name * width + table[:, k] + 1, return_inverse=True)
    _, first, n = np.unique(name, return_index=True, return_counts=True)
    return table[first], length[first], n


def frequent_words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, word, f`` of words that are frequent; and a row without word for each lang: the number of its words."""
    counted = docs.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    return cut_lineage(counted.filter((F.col("f") >= min_count) | F.col("word").isNull()))


_PACKED = "bucket bigint, h array<bigint>, n array<int>"


def _packed(named: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Counts of hashes as one row for each bucket of them."""
    bucket = (named >> np.uint64(33)) % np.uint64(buckets)
    order = np.lexsort((named, bucket))
    bucket = bucket[order]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(n)) if len(n) else np.zeros(1, dtype=np.int64)
    at = pa.array(cuts, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(named[order].view(np.int64))),
                                       pa.ListArray.from_arrays(at, pa.array(n[order], pa.int32()))], ["bucket", "h", "n"])


def _often(packed: DataFrame, parts: int, min_count: int) -> DataFrame:
    """Hashes whose counts add up to ``min_count`` and more; a bucket is summed at a time."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, counts = None, [], []

        def ready() -> pa.RecordBatch:
            named, which = np.unique(np.concatenate(names), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(named[np.bincount(which, np.concatenate(counts)) >= min_count])], ["h"])

        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != at:
                    if names:
                        yield ready()
                    at, names, counts = bucket, [], []
                names.append(batch.column(1)[i].values.to_numpy())
                counts.append(batch.column(2)[i].values.to_numpy())
        if names:
            yield ready()

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(summed, "h bigint")


def suffix_leaves(docs: DataFrame, words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, words, n``: the distinct truncated suffixes and how often they occur."""
    sc = docs.sparkSession.sparkContext
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS, parts)
    known = sc.broadcast(bitmap(words.filter("word IS NOT NULL").select(F.xxhash64("lang", "word").alias("h")), "h", WORD_BITS))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(known.value, dtype=np.uint8)
        for lang, codes, piece, distinct in slices(batches):
            at, hashes = _candidate_pairs(lang, codes, piece, distinct, frequent)
            keys, n = np.unique(codes[at] * len(distinct) + codes[at + 1], return_counts=True)
            yield _packed(_pair_hashes(hashes[keys // max(len(distinct), 1)], hashes[keys % max(len(distinct), 1)]), n, buckets)

    linked = sc.broadcast(bitmap(_often(docs.mapInArrow(pairs, _PACKED), parts, min_count), "h", PAIR_BITS))

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, bound = np.frombuffer(known.value, dtype=np.uint8), np.frombuffer(linked.value, dtype=np.uint8)
        for lang, codes, piece, distinct in slices(batches):
            named, n = np.unique(_pairs_on(lang, codes, piece, distinct, frequent, bound)[2], return_counts=True)
            yield _packed(named, n, buckets)

    chained = sc.broadcast(bitmap(_often(docs.mapInArrow(triples, _PACKED), parts, min_count), "h", PAIR_BITS))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, bound, onward = (np.frombuffer(f.value, dtype=np.uint8) for f in (known, linked, chained))
        for lang, codes, piece, distinct in slices(batches):
            on, at, named, hashes = _pairs_on(lang, codes, piece, distinct, frequent, bound)
            go = np.zeros(len(codes), dtype=bool)
            go[at[_holds(onward, named, PAIR_BITS)]] = True
            table, length, n = truncated_suffixes(codes, on, go)
            if not len(n):
                continue
            named = hashes[table[:, 0]]
            for k in range(1, MAX_WORDS):
                named = np.where(k < length, _pair_hashes(named, hashes[table[:, k]]), named)
            bucket = (named >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            table, length, n, bucket = table[order], length[order], n[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(n))
            before = np.append(0, np.cumsum(length))
            values = distinct.take(pa.array(table[np.arange(MAX_WORDS) < length[:, None]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(cuts) - 1), pa.string()), pa.array(bucket[cuts[:-1]].astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(before[cuts], pa.int32()), values),
                 pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(length, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(n, pa.int64()))], ["lang", "bucket", "words", "sizes", "n"])

    packed = docs.mapInArrow(suffixes, "lang string, bucket bigint, words array<string>, sizes array<int>, n array<bigint>")
    dealt = packed.repartition(parts, "lang", "bucket").sortWithinPartitions("lang", "bucket")
    return cut_lineage(dealt.mapInArrow(_summed, "lang string, words array<string>, n bigint"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the suffixes of packed rows, a bucket at a time."""
    at, sums = None, Counter()

    def ready() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at and at[0]] * len(sums), pa.string()), pa.array(list(map(list, sums)), pa.list_(pa.string())),
                                           pa.array(list(sums.values()), pa.int64())], ["lang", "words", "n"])

    for batch in batches:
        for lang, bucket, words, sizes, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (lang, bucket) != at:
                if sums:
                    yield ready()
                at, sums = (lang, bucket), Counter()
            begin = 0
            for size, times in zip(sizes, n, strict=True):
                sums[tuple(words[begin:begin + size])] += times
                begin += size
    yield ready()


# ---------------------------------------------------------------- subtrees

def _subtree(min_count: int):
    """Frequent nodes of the sorted leaves of one group: a stream with one open path."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang: str | None = None
        path: list[str] = []
        sums: list[int] = []
        least: list[int] = []
        out: list[tuple[str, list[str], int]] = []

        def close(depth: int) -> None:
            while len(path) > depth:
                n, d = sums.pop(), len(path)
                if sums:
                    sums[-1] += n
                if n >= min_count and d >= max(least.pop(), 2):
                    out.append((lang, path[:d], n))
                path.pop()

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.int64()))],
                                               ["lang", "words", "f"])
            out.clear()
            return batch

        for batch in batches:
            for of, words, n, route in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                same = 0
                if of == lang:
                    while same < min(len(path), len(words)) and path[same] == words[same]:
                        same += 1
                close(same)
                lang = of
                for w in words[same:]:
                    path.append(w)
                    sums.append(0)
                    least.append(route)
                sums[-1] += n
            yield ready()
        close(0)
        yield ready()

    return grow


def frequent_phrases(leaves: DataFrame, min_count: int = MIN_COUNT, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """``lang, words, f`` of the nodes of two words and more that are frequent."""
    spark = leaves.sparkSession
    total = leaves.count()
    budget = max(prefix, total // _EXTENDED)
    routed = leaves.withColumn("route", F.lit(1))
    extended: list[DataFrame] = []
    for k in range(1, MAX_WORDS):
        begin = F.slice("words", 1, k)
        heavy = (routed.filter((F.col("route") == k) & (F.size("words") >= k)).groupBy("lang", begin.alias("begin"))
                       .agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("f")).filter(F.col("leaves") > budget))
        heavy = cut_lineage(heavy.select(F.col("lang").alias("of"), "begin", "f"))  # at most total / budget rows
        if heavy.isEmpty():
            break
        extended.append(heavy.filter(F.size("begin") > 1).select(F.col("of").alias("lang"), F.col("begin").alias("words"), "f"))
        hit = routed.join(F.broadcast(heavy.drop("f")), (F.col("lang") == F.col("of")) & (begin == F.col("begin")), "left")
        routed = hit.withColumn("route", F.when(F.col("of").isNotNull(), F.lit(k + 1)).otherwise(F.col("route"))).drop("of", "begin")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group))
    dealt = routed.withColumn("begin", F.slice("words", F.lit(1), F.col("route"))).repartition(groups, "lang", "begin").sortWithinPartitions("lang", "words")
    grown = dealt.select("lang", "words", "n", "route").mapInArrow(_subtree(min_count), "lang string, words array<string>, f bigint")
    return reduce(DataFrame.unionByName, [e.filter(F.col("f") >= min_count) for e in extended], grown)


# ---------------------------------------------------------------- scores

def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) in exact arithmetic; 1000 a n and l r must be below 10**38."""
    wide = "decimal(19,0)"
    over = (F.lit(1000).cast("decimal(4,0)") * (a.cast(wide) * n.cast(wide))).cast("decimal(38,0)")
    # what is left of the exact remainder cannot round the quotient up
    under = l.cast(wide) * r.cast(wide)
    return ((over - over % under) / under).cast("decimal(38,0)").cast("long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
                 prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = frequent_words(texts, min_count)
    phrases = cut_lineage(frequent_phrases(suffix_leaves(texts, words, min_count), min_count, prefix, group))
    n = words.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    counts = phrases.unionByName(words.filter("word IS NOT NULL").select("lang", F.array("word").alias("words"), "f"))

    size = F.size("words")
    inside = phrases.filter(size > 2).select("lang", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), "f")
    longer = inside.groupBy("lang", "words").agg(F.max("f").alias("longer"))
    kept = phrases.join(longer, ["lang", "words"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).drop("longer")

    cuts = kept.join(n, "lang").select("lang", "words", F.col("f").alias("a"), "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("one"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("two"))
    for part, name in (("one", "l"), ("two", "r")):
        cuts = cuts.join(counts.select("lang", F.col("words").alias(part), F.col("f").alias(name)), ["lang", part])
    cuts = cuts.select("lang", "words", "a", "n", F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    best = cuts.groupBy("lang", "words").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    best = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))  # no task ranks all phrases of a language
    few = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
