"""Sources and sinks (S1-S9) round trips in a scratch folder."""

import os

from pyspark.sql import functions as F

from clausewise.sources import io


def test_lexicon_and_id_list(spark, tmp_dir):
    lex = os.path.join(tmp_dir, "lex.txt")
    with open(lex, "wb") as f:
        f.write(b"slaan\r\nschoppen\r\nslaan\r\nbijten")
    assert sorted(r.word for r in io.read_lexicon(spark, lex).collect()) == ["bijten", "schoppen", "slaan"]
    ids = os.path.join(tmp_dir, "ids.txt")
    with open(ids, "w") as f:
        f.write("1008, 2040, 2053")
    assert sorted(r.report_id for r in io.read_id_list(spark, ids).collect()) == [1008, 2040, 2053]


def test_pipe_csv_round_trip(spark, tmp_dir):
    rows = [(1008, "1008-1", "1008-1-1", "huisbezoek bij meisje", "neg"), (1008, "1008-2", "1008-2-1", "a|b", "pos")]
    df = spark.createDataFrame(rows, io.PREDICTION_SCHEMA)
    path = os.path.join(tmp_dir, "pred")
    io.write_table(df, path, fmt="csv")
    back = io.read_predictions(spark, path)
    assert back.columns == ["report_id", "sentence_id", "clause_id", "clause", "prediction"]
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_reports_embeddings_topics_models(spark, tmp_dir):
    docs = spark.createDataFrame([(1, "Een tekst.")], "doc_id long, text string")
    docs.write.parquet(os.path.join(tmp_dir, "docs"))
    r = io.read_reports(spark, os.path.join(tmp_dir, "docs"), id_col="doc_id").first()
    assert (r.report_id, r.text) == (1, "Een tekst.")
    emb = spark.createDataFrame([("a", [1.0, 2.0])], "clause_id string, embedding array<double>")
    io.write_embeddings(emb, os.path.join(tmp_dir, "emb"))
    e = io.read_embeddings(spark, os.path.join(tmp_dir, "emb")).first()
    assert e.id == "a" and list(e.embedding) == [1.0, 2.0]
    lab = spark.createDataFrame([("x", 0)], "doc string, topic long")
    io.write_topic_report(lab, lab.groupBy("topic").count(), lab, os.path.join(tmp_dir, "topics"))
    assert spark.read.parquet(os.path.join(tmp_dir, "topics", "sizes")).count() == 1
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    data = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(data)
    io.save_model(model, os.path.join(tmp_dir, "model"))
    loaded = io.load_model(os.path.join(tmp_dir, "model"))
    assert loaded.transform(data).select(F.col("v")).first().v.toArray().tolist() == [1.0, 2.0]


def test_fourier_svm_pipeline_persists(spark, tmp_dir):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType

    from clausewise.operators import models as M
    schema = StructType([StructField("features", VectorUDT()), StructField("y", DoubleType())])
    data = spark.createDataFrame([(Vectors.dense([float(i % 2), 1.0]), float(i % 2)) for i in range(40)], schema)
    model = M.fit_rbf_svm(data, gamma=0.5, n_components=32)
    acc = M.predict(model, data).filter((F.col("prediction") == "pos") == (F.col("y") == 1.0)).count() / 40
    assert acc >= 0.9
    io.save_model(model, os.path.join(tmp_dir, "svm"))
    again = io.load_model(os.path.join(tmp_dir, "svm"))
    assert again.transform(data).count() == 40


def test_csv_round_trip_of_any_text(spark, tmp_dir):
    """Line breaks, quotes, separators, blanks, empty against null."""
    import random
    rnd = random.Random(3)
    marks = ["a", " ", "|", '"', "\n", "\\", "'", ",", "é", "#", "\t"]
    texts = [None, "", " ", '"', '""', "a|b", 'x"|"y', " lead", "trail ", "two\nlines", "\\", '\\"', "#no comment"]
    texts += ["".join(rnd.choice(marks) for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "report_id long, clause string")
    path = f"{tmp_dir}/any"
    io.write_table(df, path, fmt="csv")
    schema = "report_id long, clause string"
    back = {r.report_id: r.clause for r in io.read_delimited(spark, path, schema, snake_case=False).collect()}
    assert back == dict(enumerate(texts))
