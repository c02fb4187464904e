"""The corpus pipeline and the registration of the queries."""

import collections
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausewise.llm import decontaminate, mixing, quality, sharding, simhash
from clausewise.llm.queries import MIX, labelled_domains

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_do_what_their_operators_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = stage["quality"](spark, docs, SF).cache()
    assert ids(good) == ids(quality.classify(docs, labels).filter("predicted = 1")) and good.columns == COLUMNS
    once = stage["near_duplicates"](spark, good, SF).cache()
    assert ids(once) == sorted({r.component_id for r in simhash.near_duplicates(good).collect()}) and once.columns == COLUMNS
    clean = stage["decontamination"](spark, once, SF).cache()
    assert ids(clean) == ids(decontaminate.contamination(once, items).filter("NOT contaminated")) and clean.columns == COLUMNS
    mixed = stage["mixing"](spark, clean, SF).cache()
    rated, _ = mixing.mix(clean, labelled_domains(clean, labels), MIX, low=1.0)
    want = {r["_id"]: r.copies for r in rated.collect()}
    assert collections.Counter(ids(mixed)) == want and min(want.values()) >= 1 and mixed.columns == COLUMNS
    shards = stage["sharding"](spark, mixed, SF)
    assert ids(shards) == ids(mixed)
    placed = {r.doc_id: r.shard for r in sharding.with_shard(mixed, sharding.grid(24)).collect()}
    assert all(placed[r.doc_id] == r.shard for r in shards.collect())


def test_sharding_stage_shows_the_growth(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = dict(corpus_pipeline.STAGES)["sharding"](spark, docs, SF).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    assert any(r.grown_shard == 24 for r in rows) and any(r.grown_shard == r.shard for r in rows)


def test_run_keeps_extra_columns_and_survives_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (7, None, "de", None, 1)],
                                docs.schema)
    for name, df in (("odd", docs.unionByName(odd).withColumn("_key", F.lit("mine"))), ("empty", docs.limit(0))):
        d = str(tmp_path / name)
        df.write.parquet(f"{d}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
        at = spark.read.parquet(f"{d}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, at, d).write.parquet(f"{d}/{step}")
            at = spark.read.parquet(f"{d}/{step}")
            assert at.columns == df.columns
        rows = corpus_pipeline.run(spark, d)
        assert rows.count() == at.count()


@pytest.mark.parametrize("gone", [("clausewise.llm", "corpus_pipeline"), ("corpus_pipeline",), ("public_tokenizers",), ("zstandard",), ()])
def test_entry_without_the_optional_part(gone):
    code = textwrap.dedent(f"""
        import importlib.abc, sys
        class Gone(importlib.abc.MetaPathFinder):
            def find_spec(self, name, path=None, target=None):
                if name in {gone!r}:
                    raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        print(sum(n.startswith("op") or n == "pipeline" for n in e.queries()), len(e.queries()) > 50, set(e.oracle_sql()) <= set(e.queries()))
    """)
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["0" if gone else "14", "True", "True"], out.stderr
    assert ("are not registered" in out.stderr) == (gone in (("public_tokenizers",), ("zstandard",)))
