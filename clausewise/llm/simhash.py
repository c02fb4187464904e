"""SimHash near-duplicates through deletion-variant signatures (operator 5).

A fingerprint has a bit set when over half of the shingle hashes have it.
Two fingerprints link at ``max_bits`` (3) or fewer differing bits.  Cut into two
segments, such a pair differs in at most one bit of one of them.  So every
distinct fingerprint is indexed, for each segment, under the segment itself and
under its variants with one bit wildcarded; an equality join of the index with
itself proposes pairs, which are verified by their bit distance.  A variant
joins only fingerprints whose wildcarded bit differs (the others already meet
under the exact segment).

A bucket of more than ``BUCKET`` fingerprints is not paired up: its members
are cut again inside the remaining half (where a pair also differs in at most
three bits), 64 -> 32 -> 16 bits.  What is left of a fingerprint below the last
cut is so short that no bucket can hold more than a few thousand distinct ones.
No candidate is dropped at any level.

Links between distinct fingerprints become components by rounds of
smallest-neighbour exchange with pointer jumping over checkpointed tables;
documents get the component of their fingerprint by a join.

Defined cases: a null or empty text has no words and fingerprint zero, which
links like any other; fewer words than a shingle count as one shingle; null ids
never are the smallest (a component of null ids only has a null id); rows that
repeat an id are each a row of the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import bind, fresh, lower_ascii, row_key
from clausewise.session import cut_lineage, ship_package

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 3
MAX_BITS = 3
#: Fingerprints in one bucket that are compared pair by pair; larger buckets are cut again.
BUCKET = 64
#: Bits below which buckets are compared whatever their size (see above).
LAST_WIDTH = 16


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every shingle of the lower-cased words, repeats included."""

    def hashes(w: Column) -> Column:
        runs = F.greatest(F.size(w) - (shingle - 1), F.lit(1))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), runs),
                                                 lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(shingle)), " "))))

    found = F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))
    return F.coalesce(bind(found, hashes), F.array().cast("array<bigint>"))


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of one document's hashes, counted in bounded slices."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, lists of hashes, by fingerprints."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        made = [majority(values[a:b]) if b > a else 0 for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.int64())], [*batch.schema.names[:-1], "fp"])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with the fingerprint ``fp``.

    The hashes are made by Spark and counted in Arrow batches: as a step of its own, since
    this Spark version does not always extract a Python function whose argument holds a lambda."""
    ship_package(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    rows = docs.select(*kept, shingle_hashes(F.col(text), shingle).alias("fp"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_fingerprints, ", ".join([*types, "fp bigint"]))


def _index(members: DataFrame, width: int) -> DataFrame:
    """Index rows of ``members`` (fp, bucket, low), whose ``width`` bits from ``low`` are cut in two.

    ``key`` names the new bucket, ``side`` is the wildcarded bit (null under the exact
    segment), ``rest`` is where the half that was not looked at begins."""
    half = width // 2
    each = F.explode(F.sequence(F.lit(0), F.lit(2 * (half + 1) - 1))).alias("i")
    x = members.select("fp", "bucket", "low", each)
    part, bit = F.floor(F.col("i") / (half + 1)).cast("int"), (F.col("i") % (half + 1) - 1).cast("int")
    x = x.select("fp", "bucket", (F.col("low") + part * half).cast("int").alias("at"),
                 (F.col("low") + (1 - part) * half).cast("int").alias("rest"), bit.alias("bit"))
    x = x.withColumn("segment", F.expr("shiftrightunsigned(fp, at)").bitwiseAND(F.lit((1 << half) - 1).cast("long")))
    # a shift by -1 sets bit 63, which no segment has: the exact segment stays whole
    return x.select("fp", "rest", F.expr("CASE WHEN bit >= 0 THEN CAST(shiftright(segment, bit) & 1 AS INT) END").alias("side"),
                    F.xxhash64("bucket", "at", "bit", F.expr("segment & ~shiftleft(1L, bit)")).alias("key"))


def _near(a: str, b: str, max_bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def near_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` (up to 3) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments of which one differs by at most one bit need max_bits of 0 to 3")
    # few and narrow rows that become many: spread over all tasks
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = fps.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("low")).repartition(tasks)
    found, width = [], 64
    while True:
        index = _index(members, width)
        sizes = (index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"),
                                          F.min("side").alias("zero"), F.max("side").alias("one"))
                      .filter((F.col("n") > 1) & (F.col("zero").isNull() | (F.col("zero") < F.col("one")))))
        sizes = cut_lineage(sizes)
        found.append(sizes.filter((F.col("n") == 2) & _near("a", "b", max_bits)).select("a", "b"))
        # always a sort-merge join: a broadcast would hold as many keys as the corpus has shared segments
        several = cut_lineage(index.join(sizes.filter("n > 2").select("key", "n").hint("merge"), "key"))
        last = width <= LAST_WIDTH
        packed = (several.filter(F.lit(last) | (F.col("n") <= BUCKET)).groupBy("key")
                         .agg(F.collect_set(F.struct("fp", "side")).alias("m")))
        one = packed.select("m", F.explode("m").alias("x")).filter("x.side IS NULL OR x.side = 0")
        # compared inside the row: only links leave it
        linked = F.filter("m", lambda y: (F.bit_count(F.col("x.fp").bitwiseXOR(y["fp"])) <= max_bits)
                          & ((y["side"].isNull() & (F.col("x.fp") < y["fp"])) | (y["side"] == 1)))
        two = one.select("x", F.explode_outer(linked).alias("y")).filter("y IS NOT NULL")
        found.append(two.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")))
        if last or sizes.filter(F.col("n") > BUCKET).isEmpty():
            break
        members = several.filter(F.col("n") > BUCKET).select("fp", F.col("key").alias("bucket"), F.col("rest").alias("low"))
        width //= 2
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node of the pairs ``a``, ``b``."""
    both = cut_lineage(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
                            .unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("root"))
    labels = cut_lineage(labels)
    while True:
        offers = (both.join(labels.select(F.col("node").alias("v"), "root"), "v")
                      .groupBy(F.col("u").alias("node")).agg(F.min("root").alias("offer")))
        nearer = labels.join(offers, "node").select("node", F.col("root").alias("was"), F.least("root", "offer").alias("to"))
        # the smallest root that the chosen root itself has reached
        onward = labels.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        after = cut_lineage(nearer.join(onward, "to").select("node", "was", F.least("to", "beyond").alias("root")))
        labels = after.select("node", "root")
        if after.filter("root < was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, ``row_key``, ``fingerprint`` (signed 64 bits), ``class`` (a
    fingerprint that names the component) and ``component_id`` (smallest id reachable)."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), row_key(F.col(doc_id), F.col(text)).alias("row_key"))
    rows = cut_lineage(with_fingerprint(rows, "_text", shingle, ["_id", "row_key"]))
    fps = rows.groupBy("fp").agg(F.min("_id").alias("least"))
    labels = components(near_pairs(fps.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    linked = fps.join(labels, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.select("fp", "root").join(least, "root")
    classes = fps.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("class"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"))
    return rows.join(classes, "fp").select(F.col("_id").alias(doc_id), "row_key", F.col("fp").alias("fingerprint"),
                                           "class", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with its smallest id (null ids
    last, then by row key); of equal rows one stays."""
    found = near_duplicates(docs, doc_id, text, shingle, max_bits)
    first = found.groupBy("class").agg(F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id).alias("id"), F.col("row_key").alias("key"))).alias("k"))
    row, key, other = fresh(docs, "_row", "_key", "_id")
    keep = first.select(F.col("k.id").alias(other), F.col("k.key").alias(key))
    keyed = docs.withColumn(row, row_key(docs[doc_id], docs[text]))
    kept = keyed.join(keep, (F.col(row) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(other)), "left_semi")
    return kept.dropDuplicates([row, doc_id]).drop(row)
