"""Precursors (W1-W4): the rows that precede a trigger.

Semantics (of the original selection loop): a row is a precursor when a
trigger follows it within the next ``n`` rows of the same partition, and no
trigger lies in between (so every precursor belongs to exactly one trigger,
its nearest following one).  A trigger row is itself never a precursor, except
the first row of a partition when ``include_leading_trigger`` is set.

Three physical forms with identical results:

* :func:`precursors` - any table: one window, partitioned by the sequence key
  and ordered by the explicit order columns; all frames share one sort, so the
  plan is scan -> exchange -> sort -> window -> filter (one shuffle).
* :func:`precursors_indexed` (``strategy="indexed"``) - skew-proof form for
  sequences where one key may hold a large share of all rows: a range
  partition on ``(key, order)`` splits even a single hot key over many tasks,
  every row gets a consecutive global index, and each trigger is matched to
  the ``n`` indices before it with an equi-join on that unique index.
* :func:`with_precursor_array` - a report already held in one row (clauses made by
  :mod:`clausewise.operators.segment`): the same rule with array functions,
  no shuffle at all, and it runs unchanged on streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.constants import PRECURSOR_WINDOW, TOPIC_STOP_WORDS
from clausewise.functions.text import remove_words


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def precursors(df: DataFrame, partition: Sequence[str | Column], order: Sequence[str | Column],
               is_trigger: Column, n: int = PRECURSOR_WINDOW, include_leading_trigger: bool = True,
               trigger_id: str | Column | None = None, strategy: str = "window") -> DataFrame:
    """W1 + W3 over a table.

    Adds ``precursor_distance`` (rows to the trigger, 1..n) and, when
    ``trigger_id`` is given, ``trigger_of`` (the id of that trigger).  Returns
    only the precursor rows.  ``strategy="indexed"`` selects the skew-proof
    plan (see :func:`precursors_indexed`); the order must be total (unique).
    """
    if strategy == "indexed":
        return precursors_indexed(df, partition, order, is_trigger, n, include_leading_trigger, trigger_id)
    w = Window.partitionBy(*_cols(partition)).orderBy(*_cols(order))
    ahead = w.rowsBetween(1, n)
    trig = F.coalesce(is_trigger, F.lit(False))
    out = (df.withColumn("_trig", trig)
             .withColumn("_rn", F.row_number().over(w))
             .withColumn("_next", F.min(F.when(F.col("_trig"), F.col("_rn"))).over(ahead)))
    if trigger_id is not None:
        tid = F.col(trigger_id) if isinstance(trigger_id, str) else trigger_id
        out = out.withColumn("trigger_of", F.first(F.when(F.col("_trig"), tid), ignorenulls=True).over(ahead))
    keep = F.col("_next").isNotNull() & (~F.col("_trig") | (F.lit(include_leading_trigger) & (F.col("_rn") == 1)))
    return (out.filter(keep)
               .withColumn("precursor_distance", (F.col("_next") - F.col("_rn")).cast("long"))
               .drop("_trig", "_rn", "_next"))


def sequence_index(df: DataFrame, partition: Sequence[str], order: Sequence[str],
                   num_partitions: int | None = None) -> DataFrame:
    """Consecutive global index ``_g`` over the rows sorted by ``(partition, order)``.

    Range partitioning samples the full sort key, so a hot key is split across
    tasks.  Inside a sorted partition ``monotonically_increasing_id`` is
    ``partition << 33 | local index``; the per-partition row counts (one row
    per partition: a proven size bound) give the offsets.  The indexed rows are
    written to the checkpoint folder, so a lost executor cannot renumber them.
    """
    from clausewise.session import cut_lineage
    keys = [*partition, *order]
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    x = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), 33)
    x = x.withColumn("_p", pid).withColumn("_local", F.col("_mid") - F.shiftleft(pid, 33))
    counts = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return (x.join(F.broadcast(offsets), "_p", "inner")
             .withColumn("_g", F.col("_off") + F.col("_local")).drop("_p", "_local", "_off", "_mid"))


def precursors_indexed(df: DataFrame, partition: Sequence[str], order: Sequence[str], is_trigger: Column,
                       n: int = PRECURSOR_WINDOW, include_leading_trigger: bool = True,
                       trigger_id: str | Column | None = None) -> DataFrame:
    """W1 + W3 without a per-key window (skew-proof).

    Each trigger at index ``g_t`` proposes itself to the indices
    ``g_t - 1 .. g_t - n`` of the same key (``n`` rows per trigger); a row keeps
    the nearest proposal.  All shuffles are keyed on the unique index.
    """
    part = list(partition)
    x = sequence_index(df.withColumn("_trig", F.coalesce(is_trigger, F.lit(False))), part, list(order))
    tid = (F.col(trigger_id) if isinstance(trigger_id, str) else trigger_id) if trigger_id is not None else F.lit(None)
    # all joins are on the unique index; sequence keys are compared null-safely beside it
    key = F.struct(*[F.col(c) for c in part])
    trig = x.filter("_trig").select(key.alias("_key_t"), F.col("_g").alias("_gt"), tid.alias("_tid"))
    cand = trig.select("_key_t", "_gt", "_tid", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k")) \
               .withColumn("_g", F.col("_gt") - F.col("_k"))
    nearest = cand.groupBy("_g", "_key_t").agg(F.min("_gt").alias("_gt"), F.min_by("_tid", "_gt").alias("trigger_of"))
    prev = x.select((F.col("_g") + 1).alias("_g"), key.alias("_key_p"), F.lit(True).alias("_has"))
    hit = x.withColumn("_key", key).join(nearest, "_g", "inner").filter(F.col("_key").eqNullSafe(F.col("_key_t"))).join(prev, "_g", "left")
    first = F.col("_has").isNull() | ~F.col("_key_p").eqNullSafe(F.col("_key"))
    keep = ~F.col("_trig") | (F.lit(include_leading_trigger) & first)
    out = hit.filter(keep).withColumn("precursor_distance", (F.col("_gt") - F.col("_g")).cast("long"))
    drop = ["_trig", "_g", "_gt", "_key", "_key_t", "_key_p", "_has"] + (["trigger_of"] if trigger_id is None else [])
    return out.drop(*drop)


def with_precursor_array(df: DataFrame, items: str, is_trigger, n: int = PRECURSOR_WINDOW,
                         include_leading_trigger: bool = True, out_col: str = "precursors") -> DataFrame:
    """W1 + W3 inside one row.

    ``items`` names an ordered array-of-struct column, ``is_trigger`` maps the
    struct to a boolean Column.  Adds ``out_col``: the precursor structs, each
    as ``item`` with ``precursor_distance`` and ``trigger_index`` (1-based
    position of its trigger in ``items``).  The trigger flags are materialised
    once per row, so the cost is ``len(items) x n``.
    """
    flags = F.transform(items, lambda x: F.coalesce(is_trigger(x), F.lit(False)))
    x = df.withColumn("_flags", flags)

    def mark(it: Column, k: Column) -> Column:
        d = F.array_position(F.slice(F.col("_flags"), k + 2, n), True)   # elements k+2 .. k+1+n (1-based)
        own = F.element_at(F.col("_flags"), k + 1)
        keep = (d > 0) & (~own | (F.lit(include_leading_trigger) & (k == 0)))
        return F.struct(it.alias("item"), keep.alias("keep"), d.cast("long").alias("precursor_distance"),
                        (k + 1 + d).cast("long").alias("trigger_index"))

    marked = F.filter(F.transform(items, mark), lambda m: m["keep"])
    return x.withColumn(out_col, F.transform(marked, lambda m: m.dropFields("keep"))).drop("_flags")


def trigger_of_precursor(df: DataFrame, partition: Sequence[str | Column], order: Sequence[str | Column],
                         is_trigger: Column, trigger_id: str | Column, n: int = PRECURSOR_WINDOW,
                         include_leading_trigger: bool = True) -> DataFrame:
    """Which trigger each precursor leads to, and at what distance."""
    return precursors(df, partition, order, is_trigger, n, include_leading_trigger, trigger_id)


def precursor_text(df: DataFrame, text_col: str, stop_words: Sequence[str] = TOPIC_STOP_WORDS,
                   out_col: str = "doc") -> DataFrame:
    """W2 + N7: precursor text stripped of spaces, with the topic stop words removed."""
    return df.withColumn(out_col, remove_words(F.trim(F.col(text_col)), stop_words))
