"""The toxicity classifier: kernel against its definition, cutting against plain Python, held-out accuracy."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewise.llm import toxicity

SF = "/root/testdata/sf0.1"


def symbols(word):
    out = []
    for c in word.lower():
        if "a" <= c <= "z":
            out.append(ord(c) - 96)
        elif c in "0123456789":
            out.append(31)
        elif ord(c) > 127:
            out += [27 + (b - 128) % 4 for b in c.encode()[1:]]
    return bytes(out)


def kernel(s, t):
    """By definition: subsequences of three in both, weighted by what they skip."""
    def parts(w):
        return [(w[i], w[j], w[k], toxicity.DECAY ** (k - i - 2)) for i, j, k in itertools.combinations(range(len(w)), 3) if k - i < toxicity.SPAN]
    return sum(a[3] * b[3] for a in parts(s) for b in parts(t) if a[:3] == b[:3])


def test_kernel_is_its_definition():
    draw = random.Random(1)
    words = [symbols("".join(draw.choice("abca1é") for _ in range(draw.randint(0, 14)))) for _ in range(60)] + [symbols("idiot"), symbols("idxiot")]
    marks = [w for w in words if len(w) >= 3][:6] + [symbols("idiot")]
    got = toxicity.Landmarks(marks).of_words(pa.array(words, pa.binary()))
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            own = kernel(w, w) * kernel(m, m)
            assert got[i, j] == pytest.approx((kernel(w, m) / own ** 0.5) ** toxicity.SHARP if own else 0.0, abs=2e-4)
    assert got[-2, -1] == pytest.approx(1, abs=1e-4) and got[-1, -1] > 0.3 > got[0, -1]


def test_a_long_word_counts_by_its_best_window():
    marks = toxicity.Landmarks([symbols("idiot")])
    long = symbols("x" * 50 + "idiot" + "y" * 30_000)
    part = [long[i:i + toxicity.WINDOW] for i in [*range(0, len(long) - toxicity.WINDOW, toxicity.STRIDE), len(long) - toxicity.WINDOW]]
    assert marks.of_words(pa.array([long], pa.binary()))[0, 0] == pytest.approx(marks.of_words(pa.array(part, pa.binary())).max(), abs=1e-6)


def brute_cut(text):
    """Sentences of a text as lists of words; single letters in a row are one word."""
    out = []
    for sentence in re.split(r"\n|(?<=[.!?])(?=[\t\x0b-\r ])", text):
        words, last = [], False
        for w in re.split(r"[\t-\r ]+", sentence):
            s = symbols(w)
            if s:
                words, last = ([*words[:-1], words[-1] + s], True) if len(s) == 1 and last else ([*words, s], len(s) == 1)
        if words:
            out.append(words)
    return out


def test_cut_is_plain_splitting(monkeypatch):
    draw = random.Random(2)
    texts = ["".join(draw.choice(list("abé1.!?-  \n\t")) for _ in range(draw.randint(0, 50))) for _ in range(150)]
    texts += ["", "you i d i o t.", "id-i.ot! x", " ", "end", "a", "b"]
    column = pa.array(["cut off", *texts, "too"]).slice(1, len(texts))
    words, first, text = toxicity.cut(column)
    flat = words.dictionary.take(words.indices).to_pylist()
    cuts = [*first.tolist(), len(flat)]
    got = [(int(t), flat[cuts[i]:cuts[i + 1]]) for i, t in enumerate(text)]
    assert got == [(i, s) for i, t in enumerate(texts) for s in brute_cut(t)]
    # the worst sentence, whatever the slices
    marks = toxicity.Landmarks([b"\x01\x02\x01", b"\x02\x02\x1f"])
    weights = np.array([1.0, -0.5])
    want = toxicity.worst_sentences(column, marks, weights)
    for i, t in enumerate(texts):
        each = [marks.of_words(pa.array(s, pa.binary())).max(axis=0) for s in brute_cut(t)]
        assert want[i] @ weights == pytest.approx(max((e @ weights for e in each), default=0.0), abs=1e-5)
    monkeypatch.setattr(toxicity, "SLICE", 20)
    assert np.allclose(toxicity.worst_sentences(column, marks, weights) @ weights, want @ weights, atol=1e-6)


def test_machine_is_at_the_minimum_of_its_loss():
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(80, 3)), (draw.random(80) < 0.3).astype(int)
    x[y == 1] += 0.8
    w, b = toxicity.fit_machine(x, y)

    def loss(w, b):
        short = np.maximum(1 - np.where(y == 1, 1, -1) * (x @ w + b), 0) ** 2
        return w @ w / 2 + 1e-3 * b * b / 2 + 300 / 2 * (short[y == 1].mean() + short[y == 0].mean())

    least = loss(w, b)
    assert all(loss(w + d[:3], b + d[3]) >= least - 1e-9 for d in draw.normal(size=(200, 4)) * 1e-3)


def test_held_out_documents_and_altered_insults(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = (toxicity.with_score(docs.join(labels.select("doc_id", "toxic"), "doc_id"), model)
            .select("doc_id", "toxic", toxicity.held_out(F.col("doc_id")).alias("held"), "score").collect())
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held]
    good, bad = ([r.score for r in held if r.toxic == v] for v in (0, 1))
    # a tenth of the toxic labels are noise, and some languages have a dozen to learn from
    assert np.mean([g < b for g in good for b in bad]) > 0.9
    assert np.mean([s >= 0.7 for s in bad]) > 0.6 and np.mean([s < 0.7 for s in good]) > 0.95
    insults = ["idiot", "moron", "pathetic", "worthless", "disgusting", "stupid"]
    draw = random.Random(5)
    spaced = [f"Plain words of it. You {' '.join(w)} there." for w in insults]
    signed = [f"You {'-'.join(w[i:i + 2] for i in range(0, len(w), 2))} there" for w in insults]
    put_in = [f"You {w[:3] + draw.choice('xzq') + w[3:]} there" for w in insults if len(w) > 5]
    clean = ["Plain words of the text, as they are.", "", None, "The edition in the station, and more of them."]
    got = [r.score for r in toxicity.with_score(spark.createDataFrame([(i, t) for i, t in enumerate(spaced + signed + put_in + clean)], "doc_id int, text string")
                                                .repartition(1), model).orderBy("doc_id").collect()]
    n = len(clean)
    # every altered insult above every clean text, and most of them far above
    assert max(got[-n:]) < min(got[:-n]) and np.median(got[:-n]) > 2 * max(got[-n:])


def test_defined_cases(spark):
    rows = [(i, "you are a moron today" + " too" * i) for i in range(9)] + [(20 + i, "fair words of the day" + " now" * i) for i in range(30)]
    rows += [(100, None), (100, None), (None, ""), (101, "x" * 100_000), (102, "you are a moron today " * 8_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("extra") for c in ("_id", "_y", "h", "score", "word")}).repartition(3)
    marks = [(i, 1 if i < 9 else 0) for i in [*range(9), *range(20, 50)]] + [(20, 1), (100, None), (None, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    out = toxicity.classify(docs, labels)
    assert out.count() == len(rows) and set(docs.columns) <= set(out.columns)
    score = {r.text: r.score for r in out.collect()}
    assert score["you are a moron today " * 8_000] >= 0.7 > score["fair words of the day"] and score[None] == score[""] < 0.7
    assert {(r.score, r.predicted) for r in toxicity.classify(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert toxicity.classify(docs.limit(0), labels).collect() == []
