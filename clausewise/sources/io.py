"""Sources and sinks.

Explicit schemas everywhere (no inference); Parquet is the default storage,
pipe-delimited CSV with a header is kept for interchange with the original
tool's files.  Excel and pickle are not supported: convert them to Parquet or
CSV first.
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAUSE_SCHEMA = T.StructType([
    T.StructField("VIM id", T.LongType()),
    T.StructField("Sentence identifier", T.StringType()),
    T.StructField("Chunk identifier", T.StringType()),
    T.StructField("Chunk", T.StringType()),
])
PREDICTION_SCHEMA = T.StructType(CLAUSE_SCHEMA.fields + [T.StructField("Prediction", T.StringType())])
ANNOTATION_SCHEMA = T.StructType([
    T.StructField("VIM id", T.LongType()),
    T.StructField("Chunk identifier", T.StringType()),
    T.StructField("Chunk", T.StringType()),
    T.StructField("Aggression", T.StringType()),
    T.StructField("Cause", T.StringType()),
])

# snake_case names used inside the library for the interchange columns above
RENAMES = {"VIM id": "report_id", "Sentence identifier": "sentence_id", "Chunk identifier": "clause_id",
           "Chunk": "clause", "Prediction": "prediction", "Aggression": "aggression", "Cause": "cause",
           "True label": "true_label"}


def _snake(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(RENAMES.get(c, c)) for c in df.columns])


def read_reports(spark: SparkSession, path: str, id_col: str = "report_id", text_col: str = "text",
                 fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    """Reports as ``report_id BIGINT, text STRING`` (only those two columns are read).

    ``multi_line=False`` for delimited files without line breaks inside fields: a large file is then split."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField(text_col, T.StringType())])
        df = spark.read.csv(path, header=True, schema=schema, multiLine=multi_line, escape='"')
    return df.select(F.col(id_col).cast("long").alias("report_id"), F.col(text_col).alias("text"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One word per line (CRLF tolerated) -> distinct ``word``."""
    return (spark.read.text(path)
            .select(F.regexp_replace("value", "\r$", "").alias("word"))
            .filter(F.col("word") != "").distinct())


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``"a, b, c"`` text -> one ``report_id`` per id."""
    return (spark.read.text(path)
            .select(F.explode(F.split(F.col("value"), ",")).alias("v"))
            .select(F.trim("v").alias("v")).filter(F.col("v") != "")
            .select(F.col("v").cast("long").alias("report_id")))


#: Both ways of interchange files: quotes are doubled, blanks are kept, an empty text is "" and a null is nothing.
_CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Stands for an unquoted empty field while it is read; no text holds it.
_NOTHING = "\x00null\x00"


def read_delimited(spark: SparkSession, path: str, schema: T.StructType = CLAUSE_SCHEMA,
                   sep: str = "|", snake_case: bool = True, multi_line: bool = True) -> DataFrame:
    """Pipe-delimited table with a header (clauses or predictions); quoted fields may hold
    separators, quotes (doubled) and line breaks.

    ``multi_line=False`` for files without line breaks inside fields: a large file is then
    split over many tasks, where else each file is read by one."""
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=False, multiLine=multi_line, emptyValue="",
                        nullValue=_NOTHING, **_CSV)
    return _snake(df) if snake_case else df


def read_clauses(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_delimited(spark, path, CLAUSE_SCHEMA, multi_line=multi_line)


def read_predictions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_delimited(spark, path, PREDICTION_SCHEMA, multi_line=multi_line)


def read_annotations(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """Gold clause labels ``report_id, clause_id, clause, aggression, cause``."""
    if fmt == "parquet":
        return _snake(spark.read.parquet(path))
    return read_delimited(spark, path, ANNOTATION_SCHEMA, multi_line=multi_line)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = "|", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet by default; ``fmt='csv'`` writes pipe-delimited files with a header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.csv(path, sep=sep, header=True, emptyValue='""', nullValue="", **_CSV)
    else:
        w.parquet(path)


def write_embeddings(df: DataFrame, path: str, id_col: str = "clause_id", vec_col: str = "embedding") -> None:
    """Id -> ``array<float>`` store in Parquet."""
    df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("embedding")) \
      .write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_embedding_table(df: DataFrame, table: str, id_col: str = "clause_id", vec_col: str = "embedding", buckets: int = 64) -> None:
    """S7 laid out by key: a table of the warehouse, bucketed and sorted by ``id``.

    Joins of the stored vectors on their id (E6, E8, F4, F9, Q1, Q3) then shuffle only the
    other side.  The rows are dealt by the same hash first, so that a bucket is one file."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("embedding"))
    (rows.repartition(buckets, "id").write.mode("overwrite").format("parquet").bucketBy(buckets, "id").sortBy("id").saveAsTable(table))


def read_embedding_table(spark: SparkSession, table: str, id_col: str = "id") -> DataFrame:
    """The bucketed store, its id under any name (a renamed key keeps the layout)."""
    return spark.table(table).select(F.col("id").alias(id_col), "embedding")


def write_topic_report(labels: DataFrame, sizes: DataFrame, keywords: DataFrame, path: str) -> None:
    """The three topic outputs side by side under one folder."""
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    keywords.write.mode("overwrite").parquet(f"{path}/keywords")


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model or pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """A fitted Spark ML model or pipeline of any kind; its class is read from its own metadata."""
    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession
    metadata = DefaultParamsReader.loadMetadata(path, SparkSession.active())
    name = metadata["class"].replace("org.apache.spark", "pyspark")
    module, _, kind = name.rpartition(".")
    if module == "pyspark.ml" and kind in ("PipelineModel", "Pipeline"):
        module = "pyspark.ml.pipeline"
    return getattr(importlib.import_module(module), kind).load(path)
