"""Sharding: a hierarchical weighted hash tree (operator 3, DataFrame functions only).

A cluster is a tree: regions hold racks, racks hold shards; a shard has a
weight and a node weighs as much as its shards.  A key descends from the root:
at each node every child draws ``-ln(u) / weight`` with ``u`` hashed from the
key and the path of the child, and the smallest draw wins.  A draw depends on
nothing but the key, the child and its weight; so when weights change, a node
that keeps its weight keeps its order against all other unchanged nodes, and
keys move only into or out of the subtrees whose weights change.

:func:`grid` lays shards out region by region.  Growing a grid whose regions
are full opens a new region: its draw competes with unchanged ones, so all keys
that move go to the new shard (the ``key`` law).

Defined cases: a null key is hashed as no value and goes to one fixed shard; a
null text has no bytes and checksum 0; rows that repeat a key share its shard
and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import fresh, uniform
from clausewise.session import cut_lineage


@dataclass(frozen=True)
class Node:
    """A shard (``shard`` set) or an inner node (``children`` set)."""

    name: str
    own_weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def grid(shards: int, racks: int = 2, per_rack: int = 4, weights: Sequence[float] | None = None) -> Node:
    """Shards 0..n-1 in racks of ``per_rack``, ``racks`` of them to a region; ``weights`` by shard (default 1)."""
    if shards < 1:
        raise ValueError("a tree needs at least one shard")
    leaf = [Node(f"shard{i}", 1.0 if weights is None else weights[i], shard=i) for i in range(shards)]
    rack = [Node(f"rack{i // per_rack}", children=tuple(leaf[i:i + per_rack])) for i in range(0, shards, per_rack)]
    region = [Node(f"region{i // racks}", children=tuple(rack[i:i + racks])) for i in range(0, len(rack), racks)]
    return Node("root", children=tuple(region))


def _pick(key: Column, node: Node, path: str) -> Column:
    """Number of the child whose weighted draw is smallest."""
    live = [(i, c) for i, c in enumerate(node.children) if c.weight > 0]
    if not live:
        raise ValueError(f"{node.name} has no child with a weight")
    if len(live) == 1:
        return F.lit(live[0][0])
    draws = [F.struct((-F.log(uniform(F.xxhash64(key, F.lit(f"{path}/{c.name}")))) / F.lit(float(c.weight))).alias("d"),
                      F.lit(i).alias("i")) for i, c in live]
    return F.array_min(F.array(*draws))["i"]


def descend(df: DataFrame, key: Column, tree: Node, out: str) -> DataFrame:
    """Adds ``out``: the shard of ``key``.  One column per level holds the node chosen so far."""
    level: list[tuple[Node, str]] = [(tree, "")]
    at, name = fresh(df, "_at", "_name")
    df = df.withColumns({at: F.lit(0), name: key.cast("string")})
    while any(n.children for n, _ in level):
        below: list[tuple[Node, str]] = []
        cases = []
        for number, (node, path) in enumerate(level):
            first = len(below)
            if node.children:
                below += [(c, f"{path}/{c.name}") for c in node.children]
                cases.append((number, _pick(F.col(name), node, path) + F.lit(first)))
            else:
                below.append((node, path))
                cases.append((number, F.lit(first)))
        chosen = reduce(lambda w, c: w.when(F.col(at) == c[0], c[1]), cases[1:], F.when(F.col(at) == cases[0][0], cases[0][1]))
        df = df.withColumn(at, chosen)
        level = below
    shard_of = F.array(*[F.lit(n.shard) for n, _ in level])
    return df.withColumn(out, F.get(shard_of, F.col(at))).drop(at, name)


def with_slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Numbers the rows of each shard 0, 1, 2, ... without a task that sees a whole shard.

    The rows are written to the checkpoint folder with the number of the input
    partition they came from; rows are numbered inside (partition, shard), and
    counts of those groups (one row per partition and shard) give the offsets."""
    part, n, off, local = fresh(df, "_part", "_n", "_off", "_local")
    x = cut_lineage(df.withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(part, shard).orderBy(*order)
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (x.groupBy(part, shard).agg(F.count(F.lit(1)).alias(n))
                .select(part, shard, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off)))
    numbered = x.withColumn(local, F.row_number().over(inside) - 1)
    return (numbered.join(offsets, [part, shard])
                    .withColumn(out, (F.col(off) + F.col(local)).cast("long")).drop(part, off, local))


def shard_rows(docs: DataFrame, tree: Node, grown: Node | None = None, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``key``, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``shard``, ``slot`` and, with ``grown``, ``grown_shard``."""
    body = F.coalesce(F.col(text), F.lit(""))
    x = docs.select(F.col(key), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
                    F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    x = descend(x, F.col(key), tree, "shard")
    x = descend(x, F.col(key), grown, "grown_shard") if grown else x.withColumn("grown_shard", F.lit(None).cast("int"))
    return with_slots(x, "shard", [key, "text_crc32", "size"])


def with_shard(docs: DataFrame, tree: Node, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """All columns of ``docs`` and the shard; no shuffle."""
    return descend(docs, F.col(key), tree, out)


def place(docs: DataFrame, tree: Node, path: str, key: str = "doc_id") -> None:
    """Writes ``docs`` as one folder per shard; each task appends to the folders of its rows."""
    with_shard(docs, tree, key).write.partitionBy("shard").mode("overwrite").parquet(path)
