"""The marks of a sentence count in its mean and are no words of its map."""

from clausewise.operators import embeddings as E


def test_marks_are_averaged_and_then_dropped(spark):
    pieces = [("s", 0, "[CLS]", 8.0), ("s", 1, "un", 2.0), ("s", 2, "##it", 4.0), ("s", 3, "two", 1.0), ("s", 4, "unit", 5.0), ("s", 5, "[SEP]", -3.0),
              ("t", 0, "[CLS]", 1.0), ("t", 1, "[SEP]", 3.0)]
    df = spark.createDataFrame([(s, i, p, [v, -v]) for s, i, p, v in pieces], "sentence_id string, i int, piece string, vector array<double>")
    words = E.merge_word_pieces(df, ["sentence_id"], ["i"])
    means = {r.sentence_id: (list(r.embedding), r.n_words) for r in E.sentence_embedding(words, ["sentence_id"]).collect()}
    assert means == {"s": ([14 / 5, -14 / 5], 5), "t": ([2.0, -2.0], 2)}
    marked = {(r.sentence_id, r.word): list(r.vector) for r in E.word_vectors(words, pos_col="word_idx", value_col="vector", marks=E.SENTENCE_MARKS).collect()}
    assert marked == {("s", "unit"): [5.0, -5.0], ("s", "two"): [1.0, -1.0]}   # a repeated word keeps the last
    assert len(E.word_vectors(words, pos_col="word_idx", value_col="vector").collect()) == 6
