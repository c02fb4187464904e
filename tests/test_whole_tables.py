"""Queries that once read a part of their table give every row of it."""

from clausewise.operators import embeddings as E
from clausewise.plans import catalog as C
from clausewise.plans import derived as D

SF = "/root/testdata/sf0.001"


def words_of(clause):
    return [(i, w) for i, w in enumerate(clause.split(" ")) if w]


def test_every_clause_gets_its_tokens(spark):
    want = [(c.clause_id, i, w) for c in D.clauses(spark, SF).select("clause_id", "clause").collect()
            for i, w in enumerate(w for _, w in words_of(c.clause))]
    got = [(r.clause_id, r.i, r.text) for r in C.q_attach_tokens(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_every_clause_comes_back_with_its_stored_vector(spark):
    stored = {r.vec_id: sum(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()}
    want = {c.clause_id: (len(c.clause) * 31 + ord(c.clause[0]) * 7 + c.clause_no) % len(stored)
            for c in D.clauses(spark, SF).select("clause_id", "clause", "clause_no").collect()}
    got = C.q_attach_vectors(spark, SF).collect()
    assert {r.clause_id: r.vec_id for r in got} == want and len(got) == len(want)
    assert all((r.vec_sum is None) == (r.vec_id not in stored) and (r.vec_sum is None or abs(r.vec_sum - stored[r.vec_id]) < 1e-4) for r in got)


def test_stored_rows_may_be_missing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    kept = E.attach_hidden_states(rows, stored=spark.createDataFrame([(1, 0.5)], "k int, v double"), key="k", how="left")
    assert sorted((r.x, r.v) for r in kept.collect()) == [("a", 0.5), ("b", None), ("c", None)]


def test_pieces_are_of_every_word(spark):
    words = {}
    for r in D.clause_word_rows(D.clauses(spark, SF)).filter("word <> ''").collect():
        words.setdefault(r.sentence_id, []).append((r.clause_no, r.i, r.word))
    got, spelled = {}, {}
    for r in C.q_merge_pieces(spark, SF).collect():
        got.setdefault(r.sentence_id, []).append((r.word_idx, r.word))
    assert {s: [w for _, _, w in sorted(x)] for s, x in words.items()} == {s: [w for _, w in sorted(x)] for s, x in got.items()}
    assert any(w[2].startswith("##") for x in words.values() for w in x) and any(not w[2][0].isascii() for x in words.values() for w in x)
    for r in C.q_sum_layers(spark, SF).collect():
        spelled.setdefault((r.sentence_id, r.clause_no, r.i), []).append((r.j, r.piece))
    assert {(s, n, i): w for s, x in words.items() for n, i, w in x} == {
        k: "".join(p.removeprefix("##") if j else p for j, p in sorted(x)) for k, x in spelled.items()}
    assert {s: len(x) for s, x in words.items()} == {r.sentence_id: r.n_words for r in C.q_sentence_embedding(spark, SF).collect()}
    assert not any(r.cosine_b is None for r in C.q_compare_embeddings(spark, SF).collect())
