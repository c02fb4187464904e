"""Running sums and last values per key without a task per key.

``Window.partitionBy(key)`` puts every row of a key into one task.  Here the rows
are range-partitioned on the key *and* the order, so that a key with a third of
all rows is split over many tasks.  Every partition works out its own running
values, and what flows from one partition into the next is a carry table of one
row a partition (a size bounded by the number of partitions), broadcast:

1. sort by range on (keys, order); the numbered rows are written to the
   checkpoint folder, so that a lost executor cannot deal them anew;
2. windows over (partition, key), at most one partition's rows each;
3. of every partition the totals of its last key, summed over the partitions
   that end in the same key: the carry of the partition that follows;
4. the carry is added to the rows of the partition's first key, if it is that key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.session import written


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column] | None = None,
            lasts: Mapping[str, Column] | None = None, num_partitions: int | None = None) -> DataFrame:
    """``df`` with the running sum (``sums``) and the last non-null value (``lasts``) of expressions.

    Equal to ``sum`` and ``last(ignorenulls)`` over ``Window.partitionBy(keys).orderBy(order)
    .rowsBetween(unboundedPreceding, 0)``.  Keys are compared null-safely; a sum of
    nulls alone is null; names must be new; ``order`` should be total, as for a window."""
    sums, lasts = dict(sums or {}), dict(lasts or {})
    names = [*sums, *lasts]
    taken = {c.lower() for c in df.columns}
    if clash := [n for n in names if n.lower() in taken]:
        raise ValueError(f"columns are there already: {', '.join(clash)}")
    mark = "_scan"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    at, part, key, end, before = (f"{mark}{n}" for n in ("at", "part", "key", "end", "before"))
    sort = [F.col(c).asc_nulls_first() for c in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # computed before the rows are dealt, so that expressions are evaluated once
    x = df.withColumns({f"{mark}v{i}": c for i, c in enumerate([*sums.values(), *lasts.values()])})
    x = x.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    x = written(x.withColumn(at, F.monotonically_increasing_id()))
    x = x.withColumn(part, F.shiftright(at, 33))
    same = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])
    total = {n: F.sum(f"{mark}v{i}") if n in sums else F.last(f"{mark}v{i}", ignorenulls=True) for i, n in enumerate(names)}
    held = {n: F.sum(f"{mark}v{i}") if n in sums else F.max_by(f"{mark}v{i}", F.when(F.col(f"{mark}v{i}").isNotNull(), F.col(at)))
            for i, n in enumerate(names)}

    # one row a partition: its last key and what it holds of it
    ends = x.groupBy(part).agg(F.max_by(same, at).alias(end))
    tails = (x.join(F.broadcast(ends), part).filter(same.eqNullSafe(F.col(end)))
              .groupBy(part).agg(F.first(end).alias(end), *[c.alias(n) for n, c in held.items()]))
    along = Window.partitionBy(end).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    flow = tails.select(part, end, *[(F.sum(n) if n in sums else F.last(n, ignorenulls=True)).over(along).alias(n) for n in names])
    onward = Window.orderBy(part)
    carry = flow.select(part, F.lag(end).over(onward).alias(key), *[F.lag(n).over(onward).alias(f"{before}{i}") for i, n in enumerate(names)])

    local = Window.partitionBy(part, *keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    y = x.select("*", *[c.over(local).alias(n) for n, c in total.items()]).join(F.broadcast(carry), part, "left")
    carried = {}
    for i, n in enumerate(names):
        old = F.when(F.col(key).isNotNull() & same.eqNullSafe(F.col(key)), F.col(f"{before}{i}"))
        carried[n] = F.coalesce(F.col(n) + old, F.col(n), old) if n in sums else F.coalesce(F.col(n), old)
    return y.select(*df.columns, *[c.alias(n) for n, c in carried.items()])
