"""Token -> clause annotation projection.

Token annotations come one row per token; clauses one row per clause.  The
k-th clause of a report covers the next ``len(words)`` tokens of the report.
Both sides get a position in the report (running window sums); then clause
start markers and token rows are merged in position order and one running
window hands every token to the last clause that started before it (if the
token lies inside that clause's span).  No clause is exploded to its
positions, so the data stays linear even for very long clauses.

``strategy="window"`` works with windows by report, one exchange for reports of
the size of a document.  ``strategy="scan"`` gives the same rows through the scan
with carry (:mod:`clausewise.operators.scan`), which splits a report that holds a
large share of all rows.  Token and clause order must be total.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.functions.text import word_list
from clausewise.operators.scan import running


def token_ids(tokens: DataFrame, sent_col: str = "sent_id", token_col: str = "token_id",
              out_col: str = "token_key") -> DataFrame:
    """A1: ``sent-token`` identifier."""
    return tokens.withColumn(out_col, F.concat_ws("-", F.col(sent_col), F.col(token_col)))


def filter_tokens(tokens: DataFrame, text_col: str = "token", drop: Sequence[str] = (" ", ",")) -> DataFrame:
    """A2: drop the tokens the clause splitter consumed (spaces and commas)."""
    return tokens.filter(~F.col(text_col).isin(*drop))


def _spans(clauses: DataFrame, report_col: str, clause_order: Sequence[str], clause_col: str, strategy: str) -> DataFrame:
    words = clauses.withColumn("n_words", F.size(word_list(F.col(clause_col))).cast("long"))
    if strategy == "scan":
        x = running(words, [report_col], clause_order, {"span_end": F.col("n_words")})
    else:
        wc = Window.partitionBy(report_col).orderBy(*clause_order).rowsBetween(Window.unboundedPreceding, 0)
        x = words.withColumn("span_end", F.sum("n_words").over(wc))
    return x.withColumn("span_start", F.col("span_end") - F.col("n_words"))


def _ranked_tokens(tokens: DataFrame, report_col: str, token_order: Sequence[str], strategy: str) -> DataFrame:
    if strategy == "scan":
        return running(tokens, [report_col], token_order, {"pos": F.lit(1).cast("long")})
    wt = Window.partitionBy(report_col).orderBy(*token_order)
    return tokens.withColumn("pos", F.row_number().over(wt).cast("long"))


def _owned_tokens(clauses: DataFrame, tokens: DataFrame, report_col: str, clause_order: Sequence[str],
                  token_order: Sequence[str], clause_col: str, strategy: str) -> DataFrame:
    """Union of clause markers (``_kind = 1``) and tokens (``_kind = 0``) with ``_own``:
    the owning clause (a struct of its columns and span) or null."""
    if strategy not in ("window", "scan"):
        raise ValueError(f"no strategy {strategy!r}")
    cl = _spans(clauses, report_col, clause_order, clause_col, strategy)
    ccols = [c for c in clauses.columns]
    own = F.struct(*[F.col(c) for c in ccols], "n_words", "span_end")
    tk = _ranked_tokens(tokens, report_col, token_order, strategy)
    tcols = [c for c in tk.columns if c not in (report_col, "pos")]
    marker = cl.select(report_col, F.col("span_start").alias("_key"), F.lit(1).alias("_kind"), own.alias("_c"),
                       *[F.lit(None).cast(tk.schema[c].dataType).alias(c) for c in tcols])
    tok = tk.select(report_col, F.col("pos").alias("_key"), F.lit(0).alias("_kind"),
                    F.lit(None).cast(marker.schema["_c"].dataType).alias("_c"), *tcols)
    u = marker.unionByName(tok)
    order = [F.col("_key"), F.col("_kind"), *[F.col("_c")[c] for c in clause_order]]
    if strategy == "scan":
        u = running(u, [report_col], order, lasts={"_last": F.col("_c")})
    else:
        w = Window.partitionBy(report_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_last", F.last("_c", ignorenulls=True).over(w))
    u = u.withColumn("_own", F.when(F.col("_kind") == 1, F.col("_c")).otherwise(F.col("_last"))).drop("_last")
    inside = (F.col("_kind") == 1) | (F.col("_own").isNotNull() & (F.col("_key") <= F.col("_own")["span_end"]))
    return u.withColumn("_own", F.when(inside, F.col("_own")))


def align_tokens(clauses: DataFrame, tokens: DataFrame, report_col: str = "report_id",
                 clause_order: Sequence[str] = ("sent_no", "clause_no"),
                 token_order: Sequence[str] = ("sent_id", "token_id"), clause_col: str = "clause",
                 strategy: str = "window") -> DataFrame:
    """A3: one row per (clause, covered token): ``report, clause_id, pos`` + the token's columns.

    Clauses get ``n_words`` and a span ``(span_start, span_end]`` from a running
    sum; tokens get their rank in the report.  A clause with no words covers no
    token (it is kept by the projection, not dropped).
    """
    u = _owned_tokens(clauses, tokens, report_col, clause_order, token_order, clause_col, strategy)
    tcols = [c for c in tokens.columns if c != report_col]
    return u.filter((F.col("_kind") == 0) & F.col("_own").isNotNull()).select(
        report_col, F.col("_own")["clause_id"].alias("clause_id"), F.col("_key").alias("pos"), *tcols)


def project_labels(clauses: DataFrame, aligned: DataFrame, label_cols: dict[str, str],
                   key: str = "clause_id", pos: str = "pos", neg: str = "neg") -> DataFrame:
    """A4: a clause is ``pos`` for a label when any covered token is ``pos``.

    ``label_cols`` maps output column -> token label column, e.g.
    ``{"aggression": "agressie", "cause": "aanleiding"}``.
    """
    agg = aligned.groupBy(key).agg(*[F.bool_or(F.col(src) == pos).alias(out) for out, src in label_cols.items()],
                                   F.count(F.lit(1)).alias("n_tokens"))
    out = clauses.join(agg, key, "left")
    for name in label_cols:
        out = out.withColumn(name, F.when(F.coalesce(F.col(name), F.lit(False)), F.lit(pos)).otherwise(F.lit(neg)))
    return out.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("long"))


def alignment_mismatches(projected: DataFrame, clause_col: str = "clause") -> DataFrame:
    """A5: clauses whose covered-token count differs from their word count."""
    return (projected.withColumn("n_words", F.size(word_list(F.col(clause_col))).cast("long"))
                     .filter(F.col("n_tokens") != F.col("n_words")))


def annotated_clauses(projected: DataFrame, report_col: str = "report_id") -> DataFrame:
    """The gold clause table ``report_id, clause_id, clause, aggression, cause`` (+ order columns)."""
    return projected.select(report_col, "sent_no", "clause_no", "clause_id", "clause", "aggression", "cause")


def project_annotations(clauses: DataFrame, tokens: DataFrame, report_col: str = "report_id",
                        token_text: str = "token", labels: dict[str, str] | None = None,
                        clause_order: Sequence[str] = ("sent_no", "clause_no"),
                        token_order: Sequence[str] = ("sent_id", "token_id"), clause_col: str = "clause",
                        pos: str = "pos", neg: str = "neg", strategy: str = "window") -> DataFrame:
    """A2 -> A3 -> A4 in one pass over clauses and tokens.

    Tokens are numbered in their report, as flags without text.  Positions are
    gapless, so a clause's token count follows from its span and the report's number
    of tokens; only tokens with a label are handed to their clause by the position
    merge.  One aggregation per clause gives its labels, and the clause columns
    travel on the clause's own marker row (no second read of the clause table).
    """
    labels = labels or {"aggression": "agressie", "cause": "aanleiding"}
    if strategy not in ("window", "scan"):
        raise ValueError(f"no strategy {strategy!r}")
    marks = [F.coalesce(F.col(src) == pos, F.lit(False)) for src in labels.values()]
    names = [f"_m{i}" for i in range(len(marks))]
    narrow = filter_tokens(tokens, token_text).select(report_col, *token_order, *[m.alias(n) for m, n in zip(marks, names, strict=True)])
    tk = _ranked_tokens(narrow, report_col, token_order, strategy)
    cl = _spans(clauses, report_col, clause_order, clause_col, strategy)
    own = F.struct(*[F.col(c) for c in clauses.columns], "span_start", "span_end")
    marker = cl.select(report_col, F.col("span_start").alias("_key"), F.lit(1).alias("_kind"), own.alias("_c"), F.lit(None).cast("long").alias("_t"),
                       *[F.lit(False).alias(n) for n in names])

    def rows(key: Column, kind: int, total: Column) -> Column:
        return F.struct(key.alias("_key"), F.lit(kind).alias("_kind"), total.alias("_t"), *names)

    marked = reduce(lambda a, b: a | b, [F.col(n) for n in names], F.lit(False))
    nothing = F.lit(None).cast("long")
    if strategy == "scan":
        ends = narrow.groupBy(report_col).agg(F.count(F.lit(1)).alias("pos"), *[F.lit(False).alias(n) for n in names])
        few = tk.filter(marked).select(report_col, rows(F.col("pos"), 0, nothing).alias("r")).unionByName(
            ends.select(report_col, rows(F.lit(-1).cast("long"), 2, F.col("pos")).alias("r")))
        few = few.select(report_col, "r.*")
    else:
        # of the tokens only the marked ones go on, and from the last of a report how many it has
        wt = Window.partitionBy(report_col).orderBy(*token_order)
        last = F.lead(F.lit(1)).over(wt).isNull()
        few = tk.withColumn("_end", last).filter(marked | F.col("_end")).select(report_col, F.inline(F.filter(F.array(
            F.when(marked, rows(F.col("pos"), 0, nothing)), F.when(F.col("_end"), rows(F.lit(-1).cast("long"), 2, F.col("pos")))), lambda r: r.isNotNull())))
    u = marker.unionByName(few.withColumn("_c", F.lit(None).cast(marker.schema["_c"].dataType)))
    order = [F.col("_key"), F.col("_kind"), *[F.col("_c")[c] for c in clause_order]]
    if strategy == "scan":
        u = running(u, [report_col], order, lasts={"_last": F.col("_c"), "_total": F.col("_t")})
    else:
        w = Window.partitionBy(report_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_last", F.last("_c", ignorenulls=True).over(w)).withColumn("_total", F.last("_t", ignorenulls=True).over(w))
    mine = F.col("_kind") == 1
    u = u.withColumn("_own", F.when(mine, F.col("_c")).when((F.col("_kind") == 0) & (F.col("_key") <= F.col("_last")["span_end"]), F.col("_last")))
    covered = F.greatest(F.least(F.col("_own")["span_end"], F.col("_total")) - F.col("_own")["span_start"], F.lit(0).cast("long"))
    aggs = [F.first(F.when(mine, F.col("_own")), ignorenulls=True).alias("_c")]
    aggs += [F.bool_or(n).alias(out) for out, n in zip(labels, names, strict=True)]
    aggs += [F.sum(F.when(mine & F.col("_total").isNotNull(), covered)).alias("n_tokens")]
    # a clause is within its report, by which the windows have dealt the rows already
    by = [] if strategy == "scan" else [report_col]
    out = u.filter(F.col("_own").isNotNull()).groupBy(*by, F.col("_own")["clause_id"].alias("_id")).agg(*aggs)
    keep = list(clauses.columns)
    # the report as it was grouped by, so that rows are known to lie where they do
    out = out.select(*[F.col(c) if c in by else F.col("_c")[c].alias(c) for c in keep], *labels, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    for name in labels:
        out = out.withColumn(name, F.when(F.coalesce(F.col(name), F.lit(False)), F.lit(pos)).otherwise(F.lit(neg)))
    return out
