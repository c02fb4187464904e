"""One report with most of the rows: the scan forms give the rows of the window forms, without a window by report."""

import random

import pytest

from clausewise.operators import annotate as A
from clausewise.operators import stats as X


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(11)
    clauses, tokens = [], []
    for report in ["hot"] * 1 + [f"r{i}" for i in range(12)]:
        for sent in range(1, 260 if report == "hot" else draw.randint(2, 5)):
            for no in range(1, draw.randint(2, 4)):
                clauses.append((report, sent, no, f"{report}-{sent}-{no}", " ".join("w" * draw.randint(0, 2) for _ in range(draw.randint(0, 4)))))
            for at in range(1, draw.randint(1, 7)):
                tokens.append((report, sent, at, draw.choice(["w", ",", "ww"]), draw.choice(["pos"] + ["neg"] * 9), draw.choice(["pos"] + ["neg"] * 4)))
    return (spark.createDataFrame(clauses, "report_id string, sent_no int, clause_no int, clause_id string, clause string").repartition(3),
            spark.createDataFrame(tokens, "report_id string, sent_id int, token_id int, token string, agressie string, aanleiding string").repartition(3))


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_alignment_and_labels(tables):
    clauses, tokens = tables
    assert rows(A.align_tokens(clauses, tokens, strategy="scan")) == rows(A.align_tokens(clauses, tokens))
    scan, window = (A.project_annotations(clauses, tokens, strategy=s) for s in ("scan", "window"))
    assert rows(scan) == rows(window) and scan.filter("aggression = 'pos'").count() > 5
    with pytest.raises(ValueError):
        A.align_tokens(clauses, tokens, strategy="other")


def test_statistics(spark, tables):
    ann = A.project_annotations(*tables)
    for of in (ann, ann.filter("report_id = 'hot'"), ann.filter("report_id <> 'hot'"), ann.limit(0)):
        assert rows(X.cause_distances(of, "scan")) == rows(X.cause_distances(of))
        assert rows(X.position_thirds(of, "scan")) == rows(X.position_thirds(of))
    assert len(rows(X.cause_distances(ann, "scan"))) > 10


def test_no_window_holds_a_report(tables):
    clauses, tokens = tables
    for df in (A.project_annotations(clauses, tokens, strategy="scan"), X.cause_distances(A.project_annotations(clauses, tokens), "scan")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if " Window [" in line and "report_id" in line.split("specifiedwindowframe")[-1]]
        assert all("_scan" in line for line in windows)
