"""Phrase collocations against a count of every phrase."""

import collections
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from clausewise.llm import phrases

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(A_Z))]


def counts(rows):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f[lang].update(tuple(w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least, top):
    f, n = counts(rows)
    out = []
    for lang in f:
        c = [p for p, x in f[lang].items() if len(p) > 1 and x >= least]
        gone = {p[i:i + k] for p in c for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * f[lang][p] >= 100 * f[lang][p[i:i + k]]}
        found = []
        for p in c:
            if p not in gone:
                s, k = min((1000 * f[lang][p] * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -f[lang][p], " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_collocations_equal_a_count_of_every_phrase(spark):
    draw = random.Random(4)
    words = ["the", "The", "of", "État", "x\x01", "x", "ß", "new", "york", "città\xa0", "a" * 60]
    rows = [(draw.choice(["en", "en", "de", None, "und"]), "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ". ", "!", "\r\n", "\x0b", "  "])
                                                             for _ in range(draw.randint(0, 60)))) for _ in range(200)]
    rows += [("en", "new york city hall park ") for _ in range(60)] + [("en", None), (None, None), ("fr", ""), ("en", "one " * 30_000), ("und", "x"), ("en", ". . ,")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("extra") for c in ("words", "n", "f", "word", "rank")}).repartition(3)
    want = brute(rows, 8, 25)
    assert len(want) > 60
    # whole subtrees; and prefixes extended to several levels, over several groups
    for limits in ({}, {"prefix": 5, "group": 20}, {"prefix": 1, "group": 7}):
        assert sorted(map(tuple, phrases.collocations(df, min_count=8, top=25, **limits).collect())) == want
    assert phrases.collocations(df.limit(0)).collect() == []


def test_words_of_slices_are_the_words_of_the_texts(monkeypatch):
    draw = random.Random(6)
    texts = ["".join(draw.choice("aB é.,\t\n!ß1") for _ in range(draw.randint(0, 40))) for _ in range(80)] + ["", "", "end", " "]
    batch = pa.record_batch({"lang": pa.array([draw.choice(["u", "v"]) for _ in texts]), "text": pa.array(texts)})
    for size in (1, 50, 10_000):
        monkeypatch.setattr(phrases, "SLICE", size)
        got = collections.defaultdict(list)
        for lang, codes, piece, distinct in phrases.slices(iter([batch.slice(3, 70), batch.slice(0, 3), batch.slice(73)])):
            runs = collections.defaultdict(list)
            for c, p in zip(codes, piece, strict=True):
                runs[p].append(distinct[c].as_py())
            got[lang] += runs.values()
        for lang in "uv":
            want = [w for x, t in zip(batch.column(0).to_pylist(), texts, strict=True) if x == lang for w in pieces(t) if w]
            assert sorted(got[lang]) == sorted(want)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    rows = [("en", f"a b c d w{i % 7} a b. c d a b c") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, 40, 100)
    monkeypatch.setattr(phrases, "bitmap", lambda _, __, bits: b"\xff" * (1 << bits >> 3))
    assert sorted(map(tuple, phrases.collocations(df, min_count=40, top=100).collect())) == want


def test_score_is_exact_beyond_64_bits(spark):
    draw = random.Random(2)
    rows = [tuple(draw.randint(1, 10 ** draw.randint(1, 17)) for _ in range(4)) for _ in range(400)]
    rows = [(min(a, left, right), n, left, right) for a, n, left, right in rows]
    rows = [r for r in rows if 1000 * r[0] * r[1] // (r[2] * r[3]) < 2 ** 63]
    rows += [(10 ** 16, 10 ** 18, 10 ** 16, 10 ** 16), (10 ** 16 - 1, 10 ** 18 - 1, 10 ** 16 - 1, 10 ** 16 + 7)]
    df = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint")
    got = df.select("a", "n", "l", "r", phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in got)
