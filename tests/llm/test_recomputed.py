"""Classifiers and digests worked out a second time, by hand."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from clausewise.llm import mixing, pii, quality, queries

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


# ---------------------------------------------------------------- 4

def plain_features(text):
    data, words = text.encode(), text.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    kind = lambda test: sum(map(test, data)) / len(data)
    upper, lower, other = kind(lambda b: 65 <= b <= 90), kind(lambda b: 97 <= b <= 122), kind(lambda b: b > 126 or b < 33 and b not in (9, 10, 11, 12, 13, 32))
    signs = kind(lambda b: 33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ",.")
    lines = [x for x in text.split("\n") if x]
    n = len(words)
    return [upper / (upper + lower + other) if upper + lower + other else 0.0, kind(lambda b: 48 <= b <= 57), signs, kind(lambda b: chr(b) in ",."),
            kind(lambda b: b in (9, 10, 11, 12, 13, 32)), sum(1 for w in words if len(w) < 4 and not any(c.isalnum() for c in w)) / n,
            sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ",.") / n, sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / n,
            len(set(words)) / n, sum(1 for w in words if len(w) < 4) / n, min(len(text) / n, 50), math.log(1 + n), 1 - len(set(lines)) / len(lines)]


def test_quality_features_by_hand():
    draw = random.Random(2)
    texts = ["".join(draw.choice("aBé1 ,.!%-\n\t ") for _ in range(draw.randint(0, 60))) for _ in range(300)] + ["", " ", "a", "Ab cd\nAb cd\n"]
    for t in texts:
        assert np.allclose(quality.features(t), plain_features(t)), repr(t)


def test_pairwise_weights_are_at_the_minimum():
    draw = np.random.default_rng(4)
    good, bad = draw.normal(size=(40, 5)) + 0.5, draw.normal(size=(30, 5))
    w = quality.fit_pairs(good, bad, pairs=5_000)
    again = np.random.default_rng(7)
    d = good[again.integers(40, size=5_000)] - bad[again.integers(30, size=5_000)]

    def loss(w):
        return np.log1p(np.exp(-d @ w)).mean() + 1e-3 * w @ w / 2

    assert all(loss(w + 1e-3 * v) >= loss(w) for v in draw.normal(size=(200, 5)))


def test_quality_threshold_is_the_quantile_of_bad_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.with_score(docs.join(labels.select("doc_id", "quality"), "doc_id"), model).filter(~quality.held_out(docs["doc_id"])).collect()
    assert sum(r.score < quality.KEEP_SCORE for r in rows) == sum(r.quality == 0 for r in rows)
    for r in rows[:50]:
        strength = (np.array(plain_features(r.text)) - model.mean) / model.scale @ model.weights
        assert r.score == pytest.approx(1 / (1 + math.exp(-(strength - model.threshold + math.log(0.7 / 0.3)))), abs=1e-6)


# ---------------------------------------------------------------- 8

def test_posteriors_by_hand(spark):
    draw = random.Random(6)
    words = {"x": ["red", "Blue", "green", "é"], "y": ["one", "two", "red", "four"]}
    text = lambda d, n: " ".join(draw.choice(words[d]) for _ in range(n))
    learned = [(d, text(d, draw.randint(1, 9))) for d in "xxxy" for _ in range(6)] + [("x", None), (None, "one two")]
    docs = [(i, text(draw.choice("xy"), draw.randint(0, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "unknown words")]
    docs += docs[:3]
    labelled = spark.createDataFrame(learned, "domain string, text string").repartition(3)
    model = mixing.fit(labelled)
    got = {(r["_id"], r["n_tokens"]): (r["p0"], r["p1"], r["times"]) for r in mixing.posteriors(spark.createDataFrame(docs, "doc_id int, text string").repartition(3), model).collect()}

    def bucket(word):
        return xxhash.xxh64_intdigest(word.translate(A_Z), seed=42) & (mixing.BUCKETS - 1)

    once = dict.fromkeys((d, t) for d, t in learned if d)   # rows that repeat a text share its weight
    counts = {d: collections.Counter(bucket(w) for e, t in once if e == d for w in (t or "").split()) for d in "xy"}
    share = {d: sum(e == d for e, _ in learned) for d in "xy"}
    repeated = collections.Counter(docs)
    for i, t in docs:
        found = (t or "").split()
        soft = mixing.EFFECTIVE / max(len(found), mixing.EFFECTIVE)
        log = {d: math.log(share[d] / sum(share.values())) + soft * sum(math.log((counts[d][bucket(w)] + 0.1) / (sum(counts[d].values()) + 0.1 * mixing.BUCKETS)) for w in found)
               for d in "xy"}
        p = 1 / (1 + math.exp(log["y"] - log["x"]))
        assert got[i, len(found)] == pytest.approx((p, 1 - p, repeated[i, t]), abs=1e-8)


def test_rates_that_do_not_settle_are_told(spark):
    draw = np.random.default_rng(3)
    rows = [(1, int(n), *map(float, p)) for n, p in zip(draw.integers(1, 200, size=60), draw.dirichlet([0.4, 0.4], size=60), strict=True)]
    df = spark.createDataFrame(rows, "times bigint, n_tokens bigint, p0 double, p1 double")
    have = sum(r[1] * np.array(r[2:]) for r in rows)
    with pytest.warns(UserWarning, match="miss the targets by"):
        assert mixing.fit_rates(df, list(have * [0.05, 9.0]), 0.5, 2.0, max_steps=1).count() == 60


# ---------------------------------------------------------------- 9

def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_query_by_hand(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_personal_data(spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_phone + r.n_email + r.n_ip + r.n_card for r in rows) > 20
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_a_long_sequence_is_scored_in_slices(monkeypatch):
    draw = np.random.default_rng(1)
    field = pii.Field({}, draw.normal(size=(7, 9)), draw.normal(size=(9, 9)))
    batch = [[[int(x) for x in draw.integers(0, 6, size=3)] for _ in range(n)] for n in (50, 3, 17)]
    want = field.scores(batch)
    monkeypatch.setattr(pii, "_SCORED", 20)
    assert np.allclose(field.scores(batch), want)
    assert np.allclose(want[0, 7], sum(field.emission[k] for k in batch[0][7]))
