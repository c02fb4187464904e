"""Segmentation: reports -> sentences -> clauses.

A report is one row, so all of its sentences and clauses are produced inside
that row with array functions and exploded at the end: the whole segmentation
is narrow (no shuffle, no window), and the row order of a report is carried by
explicit numeric ``sent_no`` / ``clause_no`` columns (never by string ids).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.constants import CONJUNCTIONS
from clausewise.functions.text import comma_parts, normalize_text, sentences

CLAUSE_FIELDS = ("sent_no", "clause_no", "clause")


def _clause_struct(sent_no: Column, clause_no: Column, clause: Column) -> Column:
    return F.struct(sent_no.cast("long").alias("sent_no"), clause_no.cast("long").alias("clause_no"),
                    clause.alias("clause"))


def clause_array(text: Column) -> Column:
    """Array<struct<sent_no, clause_no, clause>> of one report, in report order.

    G1 sentences, G2 comma parts: an empty part yields no clause and no number,
    numbers restart per sentence and run across parts.
    """
    return F.flatten(F.transform(
        sentences(text),
        lambda s, i: F.transform(comma_parts(s), lambda p, j: _clause_struct(i + 1, j + 1, p)),
    ))


def surface_clause_array(text: Column, conjunctions: Column) -> Column:
    """Like :func:`clause_array`, but each comma part is split again before
    every coordinating conjunction word (a parse-free stand-in for conj
    subtrees).  ``conjunctions`` is an array<string> column (per language)."""
    mark = F.lit("\u0001")

    def split_part(p: Column) -> Column:
        words = F.split(p, " ", -1)
        marked = F.array_join(
            F.transform(words, lambda w, k: F.when((k > 0) & F.array_contains(conjunctions, w), F.concat(mark, w))
                        .otherwise(w)), " ")
        return F.filter(F.transform(F.split(marked, "\u0001", -1), lambda x: F.trim(x)), lambda x: x != F.lit(""))

    return F.flatten(F.transform(
        sentences(text),
        lambda s, i: F.transform(F.flatten(F.transform(comma_parts(s), split_part)),
                                 lambda p, j: _clause_struct(i + 1, j + 1, p)),
    ))


def conjunction_column(lang: Column, table: Mapping[str, Sequence[str]] = CONJUNCTIONS) -> Column:
    """array<string> of conjunctions for the row's language (empty when unknown)."""
    out = F.array().cast("array<string>")
    for code, words in table.items():
        out = F.when(lang == F.lit(code), F.array(*[F.lit(w) for w in words])).otherwise(out)
    return out


def explode_structs(df: DataFrame, array_col: str, keep: list[str]) -> DataFrame:
    """One row per struct of ``array_col`` (fields become columns).

    Uses the outer generator plus a filter on the first field: a plain
    ``inline`` makes the optimizer add ``size(array) > 0`` below the generator,
    which evaluates the (expensive) array expression twice."""
    out = df.select(*keep, F.inline_outer(array_col))
    first = [c for c in out.columns if c not in keep][0]
    return out.filter(F.col(first).isNotNull())


def with_ids(df: DataFrame, report_col: str = "report_id") -> DataFrame:
    """Dash-joined hierarchical ids ``report-sent`` and ``report-sent-clause``."""
    return (df.withColumn("sentence_id", F.concat_ws("-", F.col(report_col), F.col("sent_no")))
              .withColumn("clause_id", F.concat_ws("-", F.col(report_col), F.col("sent_no"), F.col("clause_no"))))


def read_reports_as_clauses(df: DataFrame, id_col: str, text_col: str, normalize: bool = True,
                            report_col: str = "report_id") -> DataFrame:
    """Reports -> one row per report with its clause array (column ``clauses``)."""
    text = normalize_text(F.col(text_col)) if normalize else F.col(text_col)
    return df.select(F.col(id_col).alias(report_col), clause_array(text).alias("clauses"))


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize: bool = True,
                    report_col: str = "report_id") -> DataFrame:
    """G1: one row per sentence: report, ``sent_no`` (1-based), ``sentence``."""
    text = normalize_text(F.col(text_col)) if normalize else F.col(text_col)
    return (df.select(F.col(id_col).alias(report_col), F.posexplode_outer(sentences(text)).alias("pos", "sentence"))
              .filter(F.col("pos").isNotNull())
              .select(report_col, (F.col("pos") + 1).cast("long").alias("sent_no"), "sentence"))


def split_clauses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize: bool = True,
                  report_col: str = "report_id") -> DataFrame:
    """G1 + G2 + G5 + G6: the clause table, one row per clause."""
    arr = read_reports_as_clauses(df, id_col, text_col, normalize, report_col)
    return with_ids(explode_structs(arr, "clauses", [report_col]), report_col)


def split_clauses_surface(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          lang_col: str = "lang", conjunctions: Mapping[str, Sequence[str]] = CONJUNCTIONS,
                          normalize: bool = True, report_col: str = "report_id") -> DataFrame:
    """Clause table with an extra split before coordinating conjunctions."""
    text = normalize_text(F.col(text_col)) if normalize else F.col(text_col)
    arr = df.select(F.col(id_col).alias(report_col),
                    surface_clause_array(text, conjunction_column(F.col(lang_col), conjunctions)).alias("clauses"))
    return with_ids(explode_structs(arr, "clauses", [report_col]), report_col)
