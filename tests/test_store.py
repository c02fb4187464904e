"""The embedding store laid out by key: joins do not shuffle the vectors."""

import uuid

from clausewise.operators import embeddings as E
from clausewise.operators import similarity as Q
from clausewise.sources import io


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bucketed_store_round_trip_and_joins(spark):
    name = "store_" + uuid.uuid4().hex
    rows = [(f"c{i}", [float(i), 0.5, -1.0]) for i in range(300)] + [(None, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "clause_id string, embedding array<double>").repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        io.write_embedding_table(vectors, name, buckets=8)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        stored = io.read_embedding_table(spark, name, "clause_id")
        assert sorted(map(str, stored.select("clause_id", "embedding").collect())) == sorted(map(str, vectors.collect()))
        clauses = spark.createDataFrame([(f"c{i % 320}", i) for i in range(900)], "clause_id string, at int").repartition(3)
        attached = E.attach_hidden_states(clauses, stored=stored, key="clause_id", how="left")
        looked_up = Q.lookup_vectors(clauses.select("clause_id"), stored, "clause_id")
        for df, count in ((attached, 900), (looked_up, 300)):
            assert df.count() == count
        # only the clauses are shuffled; with the plain store the vectors are too
        plain = E.attach_hidden_states(clauses, stored=vectors, key="clause_id", how="left")
        assert (exchanges(attached), exchanges(plain)) == (1, 2) and "hashpartitioning(clause_id" in attached._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 8 out of 8" in attached._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
