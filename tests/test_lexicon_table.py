"""Lexicons as tables give the rows of the alternation, at any size."""

import random
import time

from pyspark.sql import functions as F

from clausewise.operators import lexicon as LX
from clausewise.operators.parse import classify_clauses_lexicon
from clausewise.sources import io


def test_table_equals_alternation(spark):
    draw = random.Random(9)
    marks = ["slaan", "sla", "été", "a1", "_", "x", "go", "away", '"', "!!", "-", "'", ".", "(", "\\E"]
    texts = ["".join(draw.choice(marks) + draw.choice(["", " ", " ", " "]) for _ in range(draw.randint(0, 7))) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "clause_id int, clause string").withColumns({c: F.lit("extra") for c in ("key", "text", "_hit", "run")}).repartition(3)
    for words, threats in ((["slaan", "été", "go away", "!!", "a1-x", "x\\E go"], ["sla", "("]), (["x"], []), (["go  away", "'", "_"], ["été été"])):
        table = spark.createDataFrame([(w,) for w in [*words, *words, "", None]], "word string")
        other = spark.createDataFrame([(w,) for w in threats], "word string")
        want = {r.clause_id: r.prediction for r in classify_clauses_lexicon(df, lexicon=words, threat_words=threats).collect()}
        got = LX.classify_clauses_table(df, table, other if threats else None).collect()
        assert {r.clause_id: r.prediction for r in got} == want and len(got) == len(texts) and "pos" in want.values()
    assert set(LX.classify_clauses_table(df, table.limit(0)).select("prediction").distinct().collect()) == {("neg",)}


def test_a_lexicon_of_100000_words_from_a_file(spark, tmp_path):
    path = str(tmp_path / "words.txt")
    with open(path, "w") as f:
        f.write("".join(f"word{i}\r\n" for i in range(100_000)))
    lexicon = io.read_lexicon(spark, path)
    df = spark.range(4_000).select(F.col("id").alias("clause_id"), F.concat(F.lit("some words and word"), (F.col("id") * 50).cast("string"), F.lit(" again")).alias("clause"))
    began = time.time()
    got = {r.clause_id for r in LX.rows_with_word(df, lexicon).collect()}
    assert got == {i for i in range(4_000) if i * 50 < 100_000} and time.time() - began < 60
