"""Golden values from the original tool's committed sample outputs."""

import math

from pyspark.sql import functions as F

from clausewise.operators import evaluate as V
from clausewise.operators import precursors as W
from clausewise.operators import topics as T

# Sample predictions (report -> clauses "sent-clause", * = predicted pos), in file order.
SAMPLE = {
    1008: "1-1 2-1 2-2 2-3 3-1 4-1 5-1 5-2 5-3* 6-1 7-1 7-2 8-1 8-3 8-4 8-5 9-1 10-1 10-2* 10-3 11-1 11-2 11-3* "
          "11-4 12-1 12-2 12-3 13-1",
    2040: "1-1* 1-2 2-1* 3-1 3-2* 4-1",
    2053: "1-1 1-2 2-1* 2-2 2-3 2-4 2-5* 3-1* 4-1",
    1038: "1-1 1-2 2-1 2-2 2-3 2-4 3-1 3-2 3-3 4-1 4-2 4-3 4-4 4-5 4-6 5-1 6-1 6-2 6-3 7-1 8-1 8-2 9-1 9-2 10-1 "
          "10-2 10-3 11-2 11-3 11-4 11-5 11-6 11-7 12-1 13-1 13-2 14-1 15-1",
    1337: "1-1 2-1 2-2 3-1 4-1* 5-1 6-1 6-2 7-1 7-2 8-1* 8-2 8-3* 9-1 9-2* 10-1 11-1 11-2 12-1 12-2 13-1 14-1 "
          "14-2 14-3 15-1 15-2 16-1 17-1 18-1",
}
EXPECTED = set("""1008-2-1 1008-2-2 1008-2-3 1008-3-1 1008-4-1 1008-5-1 1008-5-2 1008-7-2 1008-8-1 1008-8-3 1008-8-4
1008-8-5 1008-9-1 1008-10-1 1008-10-3 1008-11-1 1008-11-2 1337-1-1 1337-2-1 1337-2-2 1337-3-1 1337-5-1 1337-6-1
1337-6-2 1337-7-1 1337-7-2 1337-8-2 1337-9-1 2040-1-1 2040-1-2 2040-3-1 2053-1-1 2053-1-2 2053-2-2 2053-2-3
2053-2-4""".split())


def sample_rows():
    rows = []
    for rep, items in SAMPLE.items():
        for it in items.split():
            pos = it.endswith("*")
            s, c = it.rstrip("*").split("-")
            rows.append((rep, int(s), int(c), f"{rep}-{s}-{c}", pos))
    return rows


def test_precursors_window_golden(spark):
    df = spark.createDataFrame(sample_rows(), "report_id long, sent_no long, clause_no long, clause_id string, pos boolean")
    out = W.precursors(df, ["report_id"], ["sent_no", "clause_no"], F.col("pos"), 7)
    ids = {r.clause_id for r in out.collect()}
    assert len(ids) == 36 and ids == EXPECTED


def test_precursors_window_without_leading_rule(spark):
    df = spark.createDataFrame(sample_rows(), "report_id long, sent_no long, clause_no long, clause_id string, pos boolean")
    out = W.precursors(df, ["report_id"], ["sent_no", "clause_no"], F.col("pos"), 7, include_leading_trigger=False)
    ids = {r.clause_id for r in out.collect()}
    assert ids == EXPECTED - {"2040-1-1"}


def test_precursors_array_golden(spark):
    rows = sample_rows()
    df = spark.createDataFrame(rows, "report_id long, sent_no long, clause_no long, clause_id string, pos boolean")
    arr = df.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("sent_no", "clause_no", "clause_id", "pos")))
                                      .alias("items"))
    out = W.with_precursor_array(arr, "items", lambda x: x["pos"], 7)
    ids = {r.id for r in out.select(F.explode("precursors.item.clause_id").alias("id")).collect()}
    assert ids == EXPECTED


def _scores(spark, tp, fn, fp, tn):
    cells = spark.createDataFrame([(tp, fn, fp, tn)], "tp long, fn long, fp long, tn long")
    return V.macro_prf_from_cells(cells).first()


def test_macro_scores_golden(spark):
    r = _scores(spark, 1, 2, 1, 63)
    assert round(r.precision, 4) == 0.7346 and round(r.recall, 4) == 0.6589 and round(r.f1, 4) == 0.6884
    r = _scores(spark, 1, 2, 2, 61)
    assert round(r.precision, 4) == round(r.recall, 4) == round(r.f1, 4) == 0.6508


def test_macro_scores_match_pairs(spark):
    pairs = [("pos", "pos")] + [("pos", "neg")] * 2 + [("neg", "pos")] + [("neg", "neg")] * 63
    df = spark.createDataFrame(pairs, "gold string, pred string")
    cm = {r.gold_label: (r.pos, r.neg) for r in V.confusion_matrix(df).collect()}
    assert cm == {"pos": (1, 2), "neg": (1, 63)}
    r = V.macro_prf(df).first()
    assert round(r.f1, 4) == 0.6884


def test_topic_keyword_weights_golden(spark):
    words = ["de"] * 9 + ["haar"] * 5 + ["kamer"] * 3 + ["tijdens"] * 2 + [f"w{i:03d}x" for i in range(228)]
    assert len(words) == 247
    df = spark.createDataFrame([(-1, " ".join(words))], "topic long, doc string")
    w = {r.word: r.weight for r in T.topic_word_weights(df).collect()}
    assert math.isclose(w["de"], 0.12068612888107619, rel_tol=1e-12)
    assert math.isclose(w["haar"], 0.07894636486222423, rel_tol=1e-12)
    assert math.isclose(w["kamer"], 0.05357217872016033, rel_tol=1e-12)
    assert math.isclose(w["tijdens"], 0.03899790409771686, rel_tol=1e-12)
