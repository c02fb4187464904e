"""Words and clauses travel as ids of stored vectors: same results as with the vectors themselves, and texts are dealt once."""

import pytest
from pyspark.sql import functions as F

from clausewise.functions.vectors import norm, vsum
from clausewise.operators import embeddings as E


def exchanges(df):
    """Hash exchanges of the plan of ``df``."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def folded(spark):
    rows = [(s, p, piece, h) for s, pieces in {"one": [("a", 1), ("##b", 2), ("##c", 3), ("d", 1), ("##e", 9)], "two": [("f", 4), ("g", 9), ("h", 2), ("##i", 1), ("##j", 3), ("##k", 5), ("##l", 2)],
                                               "none": [("m", 9)], "twice": [("n", 6), ("##o", 2)]}.items() for p, (piece, h) in enumerate(pieces)]
    stored = [(h, [float(h), h * h / 3, -1.0 / h]) for h in (1, 2, 3, 5)] + [(4, None), (6, [0.5, 0.25, 2.0]), (6, [8.0, -1.0, 0.125])]
    return (spark.createDataFrame(rows, "s string, p int, piece string, h0 int").repartition(3), spark.createDataFrame(stored, "h0 int, vector array<double>"))


def test_folding_by_reference_equals_folding_vectors(folded):
    pieces, stored = folded
    tagged = E.word_index(pieces, ["s"], ["p"])
    lists = E.piece_lists(tagged, ["s"], ["p"])
    want = E.fold_pieces(tagged.join(stored, "h0"), ["s"], ["p"])
    got = {(r.s, r.word_idx): (r.word, r.total, r.squares) for r in E.fold_stored(lists, stored).collect()}
    sums = {(r.s, r.word_idx): (r.word, r.t, r.q) for r in want.select("s", "word_idx", "word", vsum("vector").alias("t"), (norm("vector") * norm("vector")).alias("q")).collect()}
    assert set(got) == set(sums) and got["two", 1] == ("f", None, None) and ("none", 1) not in got
    for k, (word, *numbers) in sums.items():
        assert got[k][0] == word and (numbers == [None, None] or list(got[k][1:]) == pytest.approx(numbers))
    means = {r.s: (r.n_words, list(r.embedding)) for r in E.sentence_embedding(want, ["s"]).collect()}
    mine = {r.s: (r.n_words, list(r.embedding)) for r in E.sentence_embedding(lists, ["s"], "pieces", stored=stored).collect()}
    assert set(mine) == set(means) == {"one", "two", "twice"}
    assert all(mine[s][0] == n and mine[s][1] == pytest.approx(v) for s, (n, v) in means.items())


def test_no_vector_of_a_piece_is_shuffled(spark, monkeypatch):
    """Only lists of ids meet stored vectors: the rows that are dealt over blocks hold no vector."""
    from clausewise.plans import catalog as C
    seen = []
    blocks = E.over_stored
    monkeypatch.setattr(E, "over_stored", lambda rows, *a, **k: seen.append(rows.schema.simpleString()) or blocks(rows, *a, **k))
    for query in (C.q_merge_pieces, C.q_sentence_embedding, C.q_compare_embeddings):
        query(spark, "/root/testdata/sf0.001")
    assert len(seen) == 4 and not any("double" in s or "float" in s for s in seen)


def test_texts_are_dealt_once(spark):
    """Sentences and clauses lie within a report: dealing texts by report is the only exchange of their words."""
    from clausewise.plans import catalog as C
    sf = "/root/testdata/sf0.001"
    assert exchanges(C.q_word_vectors(spark, sf)) == exchanges(C.q_token_ancestors(spark, sf)) == 1


def test_words_without_a_vector_are_not_joined(spark):
    words = spark.createDataFrame([(r, s, w) for r, s, w in [(1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (1, "b", "x"), (None, "c", "z"), (None, "c", "x"), (2, "d", None)]], "r int, s string, word string")
    wmap = spark.createDataFrame([(1, "a", "x", 5), (None, "c", "z", 6), (2, "d", None, 7), (3, "e", "y", 8)], "r int, s string, word string, vec_id int")
    want = {(r.word, r["count"]) for r in words.join(wmap, ["s", "word"], "left_anti").groupBy("word").count().collect()}
    for near in ((), ("r",)):
        got = E.oov_counts(words, wmap, "s", near=near)
        assert {(r.word, r.n) for r in got.collect()} == want and "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_parse_is_joined_as_one_row(spark):
    from clausewise.operators import parse as P
    tokens = spark.createDataFrame([("go on", 0, "go"), ("go on", 1, "on"), ("no", 0, "no"), (None, 0, "lost")], "clause string, i int, text string")
    clauses = spark.createDataFrame([(1, "go on"), (2, "go on"), (3, "no"), (4, None), (5, "new")], "clause_id int, clause string")
    out = P.attach_tokens(clauses, tokens=tokens, key="clause")
    assert out.columns == ["clause", "i", "text", "clause_id"]
    assert sorted((r.clause_id, r.i, r.text) for r in out.collect()) == [(1, 0, "go"), (1, 1, "on"), (2, 0, "go"), (2, 1, "on"), (3, 0, "no")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # tokens are made again above the join


def test_words_are_not_shuffled_for_a_short_lexicon(spark):
    from clausewise.operators import lexicon as LX
    df = spark.createDataFrame([(1, "a stone"), (2, "no"), (3, 'a "stone"')], "clause_id int, clause string")
    out = LX.classify_clauses_table(df, spark.createDataFrame([("stone",)], "word string"))
    assert {(r.clause_id, r.prediction) for r in out.collect()} == {(1, "pos"), (2, "neg"), (3, "neg")}
    assert "hashpartitioning(run" not in out._jdf.queryExecution().executedPlan().toString()
