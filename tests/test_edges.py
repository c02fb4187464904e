"""Edge cases called out in the inventory, one per quirk."""

import math

from pyspark.sql import functions as F

from clausewise.functions import text as N
from clausewise.operators import annotate as A
from clausewise.operators import embeddings as E
from clausewise.operators import evaluate as V
from clausewise.operators import features as FT
from clausewise.operators import parse as P
from clausewise.operators import precursors as W
from clausewise.operators import segment as G
from clausewise.operators import stats as X


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first().o


def test_normalize_abbreviations(spark):
    assert one(spark, N.strip_initial_dots, "Meneer A.B. zei o.a. dat") == "Meneer AB zei o.a. dat"
    assert one(spark, N.normalize_text, "Meneer A.B. zei o.a. dat") == "meneer ab zei oa dat"
    assert one(spark, N.normalize_text, "hij stopt.") == "hij stoclient"
    assert one(spark, N.normalize_text, "de medecl. en og. en o.g. x") == "de medeclient en ondergetekende en begeleider x"
    assert one(spark, N.normalize_text, "a b") == "a b"
    assert one(spark, N.normalize_text, None) is None
    assert one(spark, N.normalize_text, "") == ""


def test_single_letter_dot_lookbehind(spark):
    assert one(spark, N.strip_single_letter_dots, "a.b.c. x.y é.z. 1.q.") == "abc xy é.z 1.q"


def test_remove_words_keeps_empty_tokens(spark):
    assert one(spark, lambda c: N.remove_words(c, ["client"]), "de client  sliep client") == "de  sliep"


def test_empty_part_takes_no_number(spark):
    df = spark.createDataFrame([(1, "c d, ,e! f")], "doc_id long, text string")
    rows = G.split_clauses(df, normalize=False).orderBy("sent_no", "clause_no").collect()
    assert [(r.sent_no, r.clause_no, r.clause) for r in rows] == [(1, 1, "c d"), (1, 2, "e!"), (2, 1, "f")]
    assert rows[1].clause_id == "1-1-2"


def test_surface_split_before_conjunctions(spark):
    df = spark.createDataFrame([(1, "x and and y, z but q", "en")], "doc_id long, text string, lang string")
    rows = G.split_clauses_surface(df, normalize=False).orderBy("clause_no").collect()
    assert [r.clause for r in rows] == ["x", "and", "and y", "z", "but q"]


def test_precursor_edge_cases(spark):
    # adjacent triggers; trigger first; short report; no trigger; trigger last
    seqs = {1: [0, 1, 1, 0, 1], 2: [1, 0, 0, 1], 3: [0, 1], 4: [0, 0, 0], 5: [0, 0, 0, 0, 0, 0, 0, 0, 0, 1]}
    rows = [(k, i, bool(v)) for k, s in seqs.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "r long, i long, t boolean")
    got = sorted((r.r, r.i, r.precursor_distance) for r in W.precursors(df, ["r"], ["i"], F.col("t"), 7).collect())
    assert got == [(1, 0, 1), (1, 3, 1), (2, 0, 3), (2, 1, 2), (2, 2, 1), (3, 0, 1)] + [(5, i, 9 - i) for i in range(2, 9)]


def test_ancestors_and_subtree(spark):
    toks = spark.createDataFrame([("c", i, f"w{i}", f"w{i}", "dep", h) for i, h in enumerate([1, 1, 1, 2, 2])],
                                 "clause_id string, i int, text string, lemma string, dep string, head int")
    anc = {r.i: r.ancestors for r in P.token_ancestors(toks).collect()}
    assert anc[3] == [2, 1] and anc[1] == [] and anc[0] == [1]
    sub = {r.head: r.descendants for r in P.subtree(toks).collect()}
    assert sub[1] == [0, 2, 3, 4] and sub[2] == [3, 4]


def test_verb_frame_last_role_wins_and_rules(spark):
    # 0:ROOT verb 'slaan', 1 and 2 nsubj (last wins), 3 obj under 0
    rows = [("c", 0, "sloeg", "slaan", "ROOT", 0), ("c", 1, "hij", "hij", "nsubj", 0),
            ("c", 2, "arts", "arts", "nsubj", 0), ("c", 3, "bal", "bal", "obj", 0)]
    toks = spark.createDataFrame(rows, "clause_id string, i int, text string, lemma string, dep string, head int")
    fr = P.verb_frames(toks).first()
    assert fr.nsubj == "arts" and fr.obj == "bal" and fr.lemma == "slaan" and fr.head_lemma == "slaan"
    judged = P.apply_role_rules(P.verb_frames(toks)).first()
    assert judged.passes is False            # R1: subject is staff
    rows[2] = ("c", 2, "man", "man", "nsubj", 0)
    toks = spark.createDataFrame(rows, "clause_id string, i int, text string, lemma string, dep string, head int")
    assert P.apply_role_rules(P.verb_frames(toks)).first().passes is True
    rows.append(("c", 4, '"', '"', "punct", 3))   # R6: quote among the descendants
    toks = spark.createDataFrame(rows, "clause_id string, i int, text string, lemma string, dep string, head int")
    assert P.apply_role_rules(P.verb_frames(toks)).first().passes is False


def test_clauses_from_parse_conj_subtrees(spark):
    # root 0; 1 conj child of root with child 3; 2 other child
    rows = [("s", "p", 1, 0, "a", "a", "ROOT", 0), ("s", "p", 1, 1, "b", "b", "conj", 0),
            ("s", "p", 1, 2, "c", "c", "obj", 0), ("s", "p", 1, 3, "d", "d", "obj", 1)]
    toks = spark.createDataFrame(rows, "sentence_id string, clause_id string, clause_no long, i int, text string, "
                                       "lemma string, dep string, head int")
    out = [(r.parse_clause_no, r.clause) for r in P.clauses_from_parse(toks).orderBy("parse_clause_no").collect()]
    assert out == [(1, "a c"), (2, "b d")]


def test_merge_three_pieces(spark):
    rows = [("s", 0, "ab", [1.0, 2.0]), ("s", 1, "##c", [3.0, 4.0]), ("s", 2, "##d", [5.0, 6.0]),
            ("s", 3, "e", [7.0, 8.0])]
    df = spark.createDataFrame(rows, "sentence_id string, p int, piece string, vector array<double>")
    out = {r.word: r.vector for r in E.merge_word_pieces(df, ["sentence_id"], ["p"]).collect()}
    assert out["abcd"] == [((1 + 3) / 2 + 5) / 2, ((2 + 4) / 2 + 6) / 2] and out["e"] == [7.0, 8.0]


def test_merge_more_pieces(spark):
    """Repeated passes over neighbours: four, five, six and seven pieces."""
    rows = [(f"s{n}", i, ("##" if i else "") + "abcdefg"[i], [float(2 ** i)]) for n in range(1, 8) for i in range(n)]
    df = spark.createDataFrame(rows, "sentence_id string, p int, piece string, vector array<double>")
    out = {r.sentence_id: (r.word, r.vector[0]) for r in E.merge_word_pieces(df, ["sentence_id"], ["p"]).collect()}
    m = lambda x, y: (x + y) / 2
    a, b, c, d, e, f, g = (float(2 ** i) for i in range(7))
    assert out["s1"] == ("a", a) and out["s2"] == ("ab", m(a, b)) and out["s3"] == ("abc", m(m(a, b), c))
    assert out["s4"] == ("abcd", m(m(a, b), m(c, d))) and out["s5"] == ("abcde", m(m(m(a, b), m(c, d)), e))
    assert out["s6"] == ("abcdef", m(m(m(a, b), m(c, d)), m(e, f)))
    assert out["s7"] == ("abcdefg", m(m(m(a, b), m(c, d)), m(m(e, f), g)))


def test_sum_last_layers(spark):
    df = spark.createDataFrame([([[1.0, 1.0], [2.0, 3.0], [4.0, 5.0]],)], "layers array<array<double>>")
    assert E.sum_last_layers(df, k=2).first().vector == [6.0, 8.0]


def test_repeated_word_last_vector_and_double_count(spark):
    occ = spark.createDataFrame([("s", "x", 1, 0, 10), ("s", "x", 2, 0, 20), ("s", "y", 1, 1, 30)],
                                "sentence_id string, word string, clause_no int, i int, vec_id int")
    wmap = E.word_vectors(occ, pos_col=F.struct("clause_no", "i"))
    assert {r.word: r.vec_id for r in wmap.collect()} == {"x": 20, "y": 30}
    words = spark.createDataFrame([("s", "c1", "x"), ("s", "c1", "x"), ("s", "c1", "y"), ("s", "c1", "zz")],
                                  "sentence_id string, clause_id string, word string")
    vecs = spark.createDataFrame([(20, [1.0, 0.0]), (30, [4.0, 3.0])], "vec_id int, embedding array<double>")
    ce = E.clause_embedding(words, wmap, vecs).first()
    assert ce.n_vec == 3 and ce.embedding == [2.0, 1.0]
    assert [r.word for r in E.oov_counts(words, wmap).collect()] == ["zz"]


def test_default_vector_and_zero_norm(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "clause_id string")
    emb = spark.createDataFrame([("a", [0.0, 0.0])], "clause_id string, embedding array<double>")
    out = {r.clause_id: (r.has_vec, r.embedding) for r in E.with_default_vector(ids, emb, 2).collect()}
    assert out == {"a": (True, [0.0, 0.0]), "b": (False, [0.0, 0.0])}
    cen = spark.createDataFrame([([1.0, 0.0],)], "centroid array<double>")
    assert FT.centroid_similarity(emb, cen).first().similarity == 0.0


def test_one_hot_unseen_category(spark):
    train = spark.createDataFrame([("a", "subject=ggz", 1.0), ("a", "similarity score", 0.5)],
                                  "clause_id string, name string, value double")
    vocab = FT.fit_one_hot(train)
    test = spark.createDataFrame([("b", "subject=unknown", 1.0), ("b", "similarity score", 0.2)],
                                 "clause_id string, name string, value double")
    assert [(r.name, r["index"]) for r in FT.one_hot(test, vocab).collect()] == [("similarity score", 0)]


def test_kappa_undefined_when_pe_is_one(spark):
    pairs = spark.createDataFrame([("pos", "pos")] * 3, "ann1 string, ann2 string")
    assert V.cohen_kappa(pairs).first().kappa is None
    pairs = spark.createDataFrame([("pos", "pos"), ("neg", "neg"), ("pos", "neg"), ("neg", "neg")],
                                  "ann1 string, ann2 string")
    k = V.cohen_kappa(pairs).first().kappa
    assert math.isclose(k, (0.75 - 0.5) / 0.5)


def _ann(spark, rows):
    return spark.createDataFrame(rows, "report_id long, sent_no long, clause_no long, clause_id string, "
                                       "aggression string, cause string")


def test_cause_distance_ties_and_segments(spark):
    # one trigger at row 3 (sent 2); causes in sent 1 (first row 1) and sent 3 (first row 4): distances -2 and +1
    rows = [(1, 1, 1, "1-1-1", "neg", "pos"), (1, 1, 2, "1-1-2", "neg", "neg"), (1, 2, 1, "1-2-1", "pos", "neg"),
            (1, 3, 1, "1-3-1", "neg", "pos")]
    # tie: trigger at row 2; causes at sent-first rows 1 and 3 -> distances -1 and +1, first wins
    rows += [(2, 1, 1, "2-1-1", "neg", "pos"), (2, 2, 1, "2-2-1", "pos", "neg"), (2, 3, 1, "2-3-1", "neg", "pos")]
    # two triggers; causes after the last trigger are ignored
    rows += [(3, 1, 1, "3-1-1", "neg", "pos"), (3, 2, 1, "3-2-1", "pos", "neg"), (3, 3, 1, "3-3-1", "pos", "neg"),
             (3, 4, 1, "3-4-1", "neg", "pos")]
    # a trigger without causes
    rows += [(4, 1, 1, "4-1-1", "pos", "neg")]
    out = {(r.report_id, r.trigger_clause_id): r.distance for r in X.cause_distances(_ann(spark, rows)).collect()}
    assert out == {(1, "1-2-1"): "-2", (2, "2-2-1"): "-1", (3, "3-2-1"): "-1", (4, "4-1-1"): "Not present"}


def test_bucket_folding(spark):
    d = [("0",)] * 8 + [("1",)] * 7 + [("-2",)] * 9
    out = {r.bucket: r["count"] for r in X.bucket_distances(spark.createDataFrame(d, "distance string")).collect()}
    assert out == {"Same sentence": 8, "Other": 7, "-2": 9}
    d = [("0",)] * 8
    out = {r.bucket: r["count"] for r in X.bucket_distances(spark.createDataFrame(d, "distance string")).collect()}
    assert out == {"Same sentence": 8, "Other": 0}


def test_position_thirds(spark):
    rows = [(1, s, 1, f"1-{s}-1", "pos" if s in (1, 2, 3) else "neg", "pos" if s == 5 else "neg") for s in range(1, 6)]
    out = {(r.type, r.position): r["count"] for r in X.position_thirds(_ann(spark, rows)).collect()}
    assert out == {("Aggression", "first part"): 1, ("Aggression", "middle part"): 2, ("Cause", "last part"): 1}


def test_alignment_keeps_empty_clause(spark):
    cl = spark.createDataFrame([(1, 1, 1, "1-1-1", "a b"), (1, 1, 2, "1-1-2", ""), (1, 1, 3, "1-1-3", "c")],
                               "report_id long, sent_no long, clause_no long, clause_id string, clause string")
    tk = spark.createDataFrame([(1, 1, 1, "a", "neg", "neg"), (1, 1, 2, ",", "neg", "neg"), (1, 1, 3, "b", "pos", "neg"),
                                (1, 1, 4, "c", "neg", "pos")],
                               "report_id long, sent_id long, token_id long, token string, agressie string, aanleiding string")
    out = {r.clause_id: (r.aggression, r.cause, r.n_tokens) for r in A.project_annotations(cl, tk).collect()}
    assert out == {"1-1-1": ("pos", "neg", 2), "1-1-2": ("neg", "neg", 0), "1-1-3": ("neg", "pos", 1)}


def test_annotator_and_encoder_are_made_once_per_task(spark):
    """P1 and E1 with functions of the caller (stand-ins, made by a factory)."""
    import pandas as pd
    clauses = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "z")], "clause_id string, clause string").coalesce(1)

    def make_annotator():
        made = []

        def annotate(b):
            made.append(1)
            rows = [(c, i, w) for c, t in zip(b["clause_id"], b["clause"]) for i, w in enumerate((t or "").split())]
            return pd.DataFrame(rows, columns=["clause_id", "i", "text"]).assign(calls=len(made))
        return annotate

    toks = P.attach_tokens(clauses, make_annotator, "clause_id string, i long, text string, calls long").collect()
    assert [(t.clause_id, t.i, t.text) for t in toks] == [("a", 0, "x"), ("a", 1, "y"), ("c", 0, "z")]

    def make_encoder():
        return lambda b: pd.DataFrame({"clause_id": b["clause_id"], "vector": [[float(len(c or ""))] for c in b["clause"]]})

    enc = E.attach_hidden_states(clauses, make_encoder, "clause_id string, vector array<double>").collect()
    assert [r.vector for r in enc] == [[3.0], [0.0], [1.0]]
    stored = spark.createDataFrame([("a", [1.0])], "clause_id string, vector array<double>")
    assert [r.vector for r in E.attach_hidden_states(clauses, stored=stored, key="clause_id").collect()] == [[1.0]]


def test_lexicon_word_edges(spark):
    from clausewise.functions.text import lexicon_regex
    df = spark.createDataFrame([("an idiot!",), ("idiotë",), ("idiot2",), ("éidiot",), ("idiot",)], "c string")
    assert [r[0] for r in df.select(F.col("c").rlike(lexicon_regex(["idiot"]))).collect()] == [True, False, False, False, True]


def test_lexicon_as_a_table(spark):
    toks = spark.createDataFrame([("a", "hit"), ("a", "x"), ("b", "x"), ("c", None)], "clause_id string, lemma string")
    words = spark.createDataFrame([("hit",), ("hit",), ("kick",)], "word string")
    key = lambda rows: sorted(map(tuple, rows))
    assert key(FT.lexicon_flags(toks, words, ["x"]).collect()) == key(FT.lexicon_flags(toks, ["hit", "kick"], ["x"]).collect())


def test_last_prediction_of_a_key_counts(spark):
    gold = spark.createDataFrame([("a", "pos"), ("b", "neg")], "clause_id string, aggression string")
    pred = spark.createDataFrame([("a", "neg", 1), ("a", "pos", 2), ("b", "neg", 1)], "clause_id string, prediction string, n int")
    assert sorted((r.clause_id, r.pred) for r in V.gold_vs_pred(gold, pred, order_col="n").collect()) == [("a", "pos"), ("b", "neg")]
