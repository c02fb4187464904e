"""Descendants are worked out in the clause's row: one exchange, that of the tokens."""

from clausewise.operators import parse as P

TOKENS = "clause_id string, i int, text string, lemma string, dep string, head int"


def test_subtree_in_the_row(spark):
    rows = [("a", 0, "x", "x", "ROOT", 0), ("a", 1, "y", "y", "obj", 0), ("a", 2, '"', "z", "obj", 1), ("a", 3, None, "z", "obj", 0),
            ("b", 0, "x", "x", "ROOT", 0), ("c", 0, "x", "x", "ROOT", 2), ("c", 1, "x", "x", "obj", 2), ("c", 2, "x", "x", "ROOT", 2)]
    st = P.subtree(spark.createDataFrame(rows, TOKENS))
    got = {(r.clause_id, r.head): (r.descendants, r.quoted, r.n_descendants) for r in st.collect()}
    assert got == {("a", 0): ([1, 2, 3], True, 3), ("a", 1): ([2], True, 1), ("c", 2): ([0, 1], False, 2)}
    plan = st._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Aggregate") == 2  # partial and final, of the tokens
