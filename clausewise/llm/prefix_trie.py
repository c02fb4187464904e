"""Prefix trie of conversations with subtree totals by parallel tree contraction (operator 12).

A node is a distinct sequence of first turns; it is named by two 64-bit sums over
its turns of a hash of position, role and text.  Sums can be formed in any order,
so the positions and prefixes of a conversation come from the scan with carry
(:mod:`clausewise.operators.scan`): no task holds a whole conversation, however long.

``subtree_totals`` sums weights over every subtree of any forest.  A round

* rakes the leaves: their totals are final and go to their parents in one
  pre-aggregated sum;
* compresses unary chains: a node with one child left is taken out when its mark
  says so and its parent's mark says no, so that no two neighbours go at once;
  its child hangs on its parent, on an edge that carries what the node held.
  A mark says whether the lowest set bit of the depth is the k-th, k rising with the
  round, which halves every chain; where that takes out few nodes, the next round's marks are hash coins,
  which take out a quarter of them as expected, whatever the tree.

A leaf goes in its round, so there are O(log n) rounds, each of two joins on
unique keys, checkpointed.
Then the contracted nodes are put back: each knows what it held above its child's
total, and a child that was contracted later leads on to its own, by pointer
doubling, until a raked node, whose total is known, is reached.

The ids of the conversations that end in a node are packed in ascending order,
a string for every range of ids, and hashed as a stream: a node where a third of
all conversations end sends a few packed rows to one task.

Defined cases: rows without conv_id belong to no conversation; a null role or
text is empty; a null turn comes first; turns of equal number are ordered by role,
then text, and all count; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.operators.scan import running
from clausewise.session import cut_lineage, ship_package

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that share a base, and how many of its turns one may take at most.
FAMILY = 20
BORROWED = 3
_LOW = 0xFFFFFFFF


# ---------------------------------------------------------------- tree contraction

def _mark(a: str, b: str, depth: str, turn: int, bit: int | None) -> Column:
    """Of a node, by its depth while ``bit`` is given: whether that is its lowest set bit."""
    if bit is not None:
        return F.col(depth).bitwiseAND(F.lit((2 << bit) - 1).cast("long")) == (1 << bit)
    return F.xxhash64(F.col(a), F.col(b), F.lit(turn)) % 2 == 0


def subtree_totals(tree: DataFrame, weights: Sequence[str]) -> DataFrame:
    """``tree`` (``a, b``: unique id; ``pa, pb``: the parent's, null at a root; ``depth``; ``weights``: long columns)
    -> ``a, b`` and, under the same names, the sums of the weights over the node and all below it."""
    k = range(len(weights))
    grown = tree.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n")).filter("pa IS NOT NULL").select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n")
    # depth of the node and of its parent: those of the tree at first
    alive = cut_lineage(tree.select("a", "b", "pa", "pb", "depth", (F.col("depth") - 1).alias("pd"), *[F.coalesce(F.col(w), F.lit(0)).cast("long").alias(f"w{i}") for i, w in enumerate(weights)],
                                    *[F.lit(0).cast("long").alias(f"e{i}") for i in k])
                            .join(grown, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0))))
    raked: list[DataFrame] = []
    spliced: list[DataFrame] = []
    ids, turn, more, bit, bits = ["a", "b"], 0, True, 0, 0
    while more:
        raked.append(alive.filter("n = 0").select("a", "b", *[f"w{i}" for i in k]))
        turn += 1
        # what the raked children hold, and the only child that is left, if there is but one
        held = (alive.filter("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"))
                     .agg(F.count(F.when(F.col("n") > 0, 1)).alias("left"), F.min(F.when(F.col("n") > 0, F.struct("a", "b"))).alias("only"),
                          *[F.coalesce(F.sum(F.when(F.col("n") == 0, F.col(f"w{i}") + F.col(f"e{i}"))), F.lit(0)).alias(f"s{i}") for i in k],
                          *[F.coalesce(F.sum(F.when(F.col("n") > 0, F.col(f"e{i}"))), F.lit(0)).alias(f"o{i}") for i in k]))
        unary = F.col("pa").isNotNull() & (F.col("left") == 1)
        go = unary & _mark("a", "b", "depth", turn, bit) & ~_mark("pa", "pb", "pd", turn, bit)
        rest = (alive.filter("n > 0").join(held, ids)
                     .select("a", "b", "pa", "pb", "depth", "pd", F.col("left").alias("n"), "only", F.coalesce(go, F.lit(False)).alias("go"),
                             *[(F.col(f"w{i}") + F.col(f"s{i}")).alias(f"w{i}") for i in k], *[f"e{i}" for i in k], *[f"o{i}" for i in k]))
        past = rest.filter("go").select(F.col("only.a").alias("a"), F.col("only.b").alias("b"), F.lit(True).alias("moved"), F.col("pa").alias("qa"),
                                        F.col("pb").alias("qb"), F.col("pd").alias("qd"), *[(F.col(f"w{i}") + F.col(f"e{i}")).alias(f"g{i}") for i in k])
        after = cut_lineage(rest.join(past, ids, "left")
                                .select("a", "b", F.when(F.col("moved"), F.col("qa")).otherwise(F.col("pa")).alias("pa"),
                                        F.when(F.col("moved"), F.col("qb")).otherwise(F.col("pb")).alias("pb"), "depth",
                                        F.when(F.col("moved"), F.col("qd")).otherwise(F.col("pd")).alias("pd"), "n", "go", "only",
                                        *[f"w{i}" for i in k], *[f"o{i}" for i in k],
                                        *[(F.col(f"e{i}") + F.coalesce(F.col(f"g{i}"), F.lit(0))).alias(f"e{i}") for i in k]))
        left, out, single = after.agg(F.count(F.when(~F.col("go"), 1)), F.count(F.when(F.col("go"), 1)),
                                      F.count(F.when(F.col("pa").isNotNull() & (F.col("n") == 1), 1))).first()
        if out:
            spliced.append(after.filter("go").select("a", "b", F.col("only.a").alias("ca"), F.col("only.b").alias("cb"),
                                                     *[(F.col(f"w{i}") + F.col(f"o{i}")).alias(f"w{i}") for i in k]))
        bits += bit is not None
        bit = bits % 32 if bit is None or out * 8 >= single else None
        alive, more = after.filter("NOT go").drop("go", "only", *[f"o{i}" for i in k]), left > 0
    known = reduce(DataFrame.unionByName, raked)
    if spliced:
        known = cut_lineage(known)
        totals = known.select(F.col("a").alias("ca"), F.col("b").alias("cb"), *[F.col(f"w{i}").alias(f"t{i}") for i in k])
        back = _resolved(reduce(DataFrame.unionByName, spliced), k).join(totals, ["ca", "cb"])
        known = known.unionByName(back.select("a", "b", *[(F.col(f"w{i}") + F.col(f"t{i}")).alias(f"w{i}") for i in k]))
    return known.select("a", "b", *[F.col(f"w{i}").alias(w) for i, w in enumerate(weights)])


def _resolved(spliced: DataFrame, k: Sequence[int]) -> DataFrame:
    """Contracted nodes (``a, b``; child ``ca, cb``; ``w``: what is above the child's total) with their nearest
    raked descendant as child.  A child may itself have been contracted in a later round; the steps to a raked
    one, at most one a round, are halved each time."""
    while True:
        spliced = cut_lineage(spliced)
        ahead = spliced.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("ca").alias("na"), F.col("cb").alias("nb"),
                               *[F.col(f"w{i}").alias(f"g{i}") for i in k])
        joined = spliced.join(ahead, ["ca", "cb"], "left")
        if joined.filter("na IS NOT NULL").isEmpty():
            return spliced
        spliced = joined.select("a", "b", F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb"),
                                *[(F.col(f"w{i}") + F.coalesce(F.col(f"g{i}"), F.lit(0))).alias(f"w{i}") for i in k])


# ---------------------------------------------------------------- ids of a node in one hash

def joined_sha256(rows: DataFrame, keys: Sequence[str], number: str, out: str) -> DataFrame:
    """Per ``keys`` (two long columns) the SHA-256 of its numbers, ascending, as decimals joined by commas."""
    spark = rows.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = (rows.select(*keys, F.col(number).alias("_no")).repartitionByRange(parts, "_no").withColumn("_part", F.spark_partition_id())
                  .groupBy(*keys, "_part").agg(F.min("_no").alias("_from"), F.array_join(F.sort_array(F.collect_list("_no")).cast("array<string>"), ",").alias("_list")))
    ordered = packed.drop("_part").repartition(parts, *keys).sortWithinPartitions(*keys, "_from").select(*keys, "_list")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for a, b, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (a, b) != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (a, b), hashlib.sha256(text.encode("ascii"))
                else:
                    state.update(b"," + text.encode("ascii"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()), strict=True)], [*keys, out])
                done = []
        if at is not None:
            yield pa.RecordBatch.from_pydict({keys[0]: [at[0]], keys[1]: [at[1]], out: [state.hexdigest()]})

    return ordered.mapInArrow(digest, f"{keys[0]} bigint, {keys[1]} bigint, {out} string")


# ---------------------------------------------------------------- conversations

def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``c``, ``pos`` (from 1), ``words`` and two hashes of role and text of every turn."""
    x = conversations.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                             F.coalesce(F.col(text), F.lit("")).alias("text")).filter("c IS NOT NULL")
    x = running(x, ["c"], [F.col("turn").asc_nulls_first(), "role", "text"], {"pos": F.lit(1)})
    return x.select("c", "pos", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
                    F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "role", "text").alias("y"))


def _taken(c: Column) -> Column:
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % (BORROWED + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations of numbered turns: their ids (``c``) and their turns (``c``, ``d`` from 1, ``words``, ``x``, ``y``)."""
    sizes = turns.groupBy("c").agg(F.max("pos").alias("n"))
    base = F.col("c") - F.col("c") % FAMILY
    ids = sizes.select("c", base.alias("base"), _taken(F.col("c")).alias("h"))
    ids = cut_lineage(ids.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("there")), "base", "left")
                         .select("c", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("m")))
    lead = turns.filter(F.col("pos") <= BORROWED).withColumnRenamed("c", "base")
    first = lead.join(ids, "base").filter(F.col("pos") <= F.col("h")).select("c", F.col("pos").alias("d"), "words", "x", "y")
    own = (turns.filter(F.col("pos") > _taken(F.col("c"))).join(ids.select("c", "h", "m"), "c")
                .select("c", (F.col("pos") - F.col("h") + F.col("m")).alias("d"), "words", "x", "y"))
    return ids.select("c"), first.unionByName(own)


def _lanes(seed: int) -> list[Column]:
    """The hash of a turn at its position as two numbers of 32 bits, which can be summed without overflow."""
    h = F.xxhash64(F.lit(seed), "d", "x", "y")
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(_LOW))]


def _id(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    ids, turns = rebuilt(cut_lineage(numbered_turns(conversations, conv_id, turn, role, text)))
    lanes = [*_lanes(1), *_lanes(2)]
    steps = turns.select("c", "d", "words", *[c.alias(f"l{i}") for i, c in enumerate(lanes)])
    steps = running(steps, ["c"], ["d"], {f"s{i}": F.col(f"l{i}") for i in range(4)})

    def name(back: bool) -> list[Column]:
        s = [F.col(f"s{i}") - F.col(f"l{i}") if back else F.col(f"s{i}") for i in range(4)]
        return [_id(s[0], s[1]), _id(s[2], s[3])]

    (a, b), (up_a, up_b) = name(False), name(True)
    steps = cut_lineage(steps.select("c", "d", "words", a.alias("a"), b.alias("b"), up_a.alias("pa"), up_b.alias("pb")))
    zero = F.lit(0).cast("long")
    root = ids.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
        "conv_id", zero.alias("depth"), "n_convs", zero.alias("words"))
    nodes = steps.groupBy("a", "b").agg(F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.min("c").alias("conv_id"),
                                        F.max("d").cast("long").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = root.unionByName(nodes)
    kids = nodes.filter("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    weighed = nodes.select("a", "b", "pa", "pb", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(weighed, ["n_leaves", "saved_tokens"])
    last = steps.groupBy("c").agg(F.max_by(F.struct("a", "b"), "d").alias("end"))
    ends = ids.join(last, "c", "left").select("c", F.coalesce("end.a", zero).alias("a"), F.coalesce("end.b", zero).alias("b"))
    ended = joined_sha256(ends, ["a", "b"], "c", "ends_sha256")
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(above, ["pa", "pb"], "left").join(totals, ["a", "b"]).join(ended, ["a", "b"], "left")
                 .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                         F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
