"""Trained sentence boundaries: planted abbreviations are found and no longer end a sentence."""

import random

from pyspark.sql import functions as F

from clausewise.operators import abbreviations as AB
from clausewise.operators import segment as G


def test_planted_abbreviations(spark):
    draw = random.Random(4)
    plain = ["the", "client", "walked", "to", "his", "room", "and", "sat", "there", "again", "quiet"]
    short = ["dr", "nr", "z.o", "ca"]
    texts = []
    for i in range(120):
        words = [draw.choice(plain) for _ in range(30)]
        for at in range(6, 30, 7):
            words[at] += "."
        words[draw.randrange(1, 6)] = draw.choice(short) + "."
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame([*texts, (900, None), (901, ""), (902, "...")], "doc_id int, text string").repartition(3)
    stats = AB.abbreviation_statistics(df)
    known = AB.abbreviations(stats)
    assert set(known) == set(short)
    assert {r.word: (r.n_stop, r.n_plain) for r in stats.collect()}["room"][1] > 0
    trained = AB.split_sentences_trained(df, known, normalize=False)
    rule = G.split_sentences(df, normalize=False)
    ends = [r.sentence.split(" ")[-1].rstrip(".") for r in trained.collect() if r.sentence]
    assert not set(ends) & set(short) and trained.count() < rule.count()
    # nothing but boundaries changes, and without a table nothing at all
    whole = lambda d: {r.report_id: r.t for r in d.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))), lambda s: s["sentence"]), " ").alias("t")).collect()}
    assert whole(trained) == whole(rule)
    assert sorted(AB.split_sentences_trained(df, [], normalize=False).collect()) == sorted(rule.collect())
    assert AB.abbreviation_statistics(df.limit(0)).collect() == []
