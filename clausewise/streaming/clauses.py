"""Structured Streaming versions of the report pipeline.

Normalisation, segmentation, lexicon triggers and the in-row precursor rule
are stateless per report (a report is one row), so the batch code runs on a
streaming DataFrame unchanged: no watermark or state store is needed.
W1 over single events of an unbounded sequence keeps state by key:
:mod:`clausewise.streaming.events`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausewise.constants import AGGRESSIVE_VERBS, PRECURSOR_WINDOW, TOPIC_STOP_WORDS
from clausewise.functions.text import normalize_text, remove_words
from clausewise.operators.parse import lexicon_hit
from clausewise.operators.precursors import with_precursor_array
from clausewise.operators.segment import clause_array, explode_structs, with_ids


def read_report_stream(spark: SparkSession, folder: str, glob: str | None = None, id_col: str = "doc_id",
                       text_col: str = "text", max_files_per_trigger: int | None = None) -> DataFrame:
    """Reports arriving as Parquet files in ``folder`` (only names matching ``glob``
    when given); the schema is taken from the files present at start."""
    from clausewise.session import ship_package
    ship_package(spark)
    batch = spark.read.option("pathGlobFilter", glob).parquet(folder) if glob else spark.read.parquet(folder)
    reader = spark.readStream.schema(batch.select(id_col, text_col).schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder).select(F.col(id_col).alias("report_id"), F.col(text_col).alias("text"))


def clause_stream(reports: DataFrame) -> DataFrame:
    """Streaming clause table (G1, G2, G5, G6 on normalised text)."""
    arr = reports.select("report_id", clause_array(normalize_text(F.col("text"))).alias("clauses"))
    return with_ids(explode_structs(arr, "clauses", ["report_id"]))


def precursor_stream(reports: DataFrame, lexicon: Sequence[str] = AGGRESSIVE_VERBS, n: int = PRECURSOR_WINDOW,
                     stop_words: Sequence[str] = TOPIC_STOP_WORDS) -> DataFrame:
    """Streaming precursors: clauses before each lexicon trigger, in-row per report."""
    arr = reports.select("report_id", F.transform(
        clause_array(normalize_text(F.col("text"))),
        lambda c: c.withField("trigger", lexicon_hit(c["clause"], lexicon))).alias("clauses"))
    arr = with_precursor_array(arr, "clauses", lambda c: c["trigger"], n)
    rows = arr.select("report_id", "clauses", F.inline_outer("precursors")).filter(F.col("item").isNotNull())
    trig = F.element_at(F.col("clauses"), F.col("trigger_index").cast("int"))
    return rows.select(
        "report_id", F.col("item.sent_no").alias("sent_no"), F.col("item.clause_no").alias("clause_no"),
        F.concat_ws("-", "report_id", "item.sent_no", "item.clause_no").alias("clause_id"),
        remove_words(F.trim(F.col("item.clause")), stop_words).alias("doc"),
        F.concat_ws("-", "report_id", trig["sent_no"], trig["clause_no"]).alias("trigger_clause_id"),
        "precursor_distance")


def write_parquet_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the stream to Parquet with exactly-once file commits (checkpointed)."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
          .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
