"""A corpus pipeline of the operators in ``clausewise.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` writes each result as Parquet into the shared checkpoint
folder and rereads it as the next stage's documents, so that a lost executor
costs one stage at most and no stage repeats another's work.

quality          documents that the ranking classifier rejects go
near_duplicates  one document of each SimHash component stays
decontamination  documents that hold a benchmark window go
mixing           no clean document goes: rates are at least one, so documents of
                 domains below their target share are repeated
sharding         every row gets its shard, its slot there and its shard with one more

Null ids and texts, empty and very long texts, repeated rows, empty tables and
extra columns are handled as the operators define it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import decontaminate, mixing, quality, sharding, simhash
from clausewise.llm.common import table
from clausewise.llm.queries import MIX, SHARDS, labelled_domains
from clausewise.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), MIX, low=1.0)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(docs, sharding.grid(SHARDS), sharding.grid(SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can express neither the ranking classifier nor the 64-bit hashes of the other stages.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this run in whatever store the checkpoint folder lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, f"{folder}/{before}")
        before = name
    return docs
