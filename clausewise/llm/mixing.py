"""Mixing sources to target weights by soft membership (operator 8, DataFrame functions only).

1. A naive Bayes classifier over hashed words is counted from a labelled table
   (at most ``MAX_LABELLED`` distinct texts of a domain, those with the smallest
   hash, chosen on hashes alone; the texts are counted where they are read) and
   predicts every document's posterior over the domains.  A document speaks with
   the weight of at most ``EFFECTIVE`` words, so that long mixed texts stay soft.
2. Document rates ``r`` between ``low`` and ``high`` (0 and infinity by default)
   minimise the squared distance of the expected tokens of the domains,
   ``T_d = sum_i r_i n_i p_i(d)``, from their targets, measured by
   ``H = sum_i n_i p_i p_i'``.  A projected gradient step under the scaling
   ``n_i`` is ``r_i <- clip(r_i - p_i . H^-1 (T - t))``; in this scaling the
   gradient has Lipschitz constant one, so the full step always descends.  A step
   with the H of the documents at no bound is tried first, and taken when it
   descends, as it needs far fewer of them.  Each step is one aggregation of
   D + D^2 sums over a narrow checkpointed table; the driver holds those
   numbers, and a rate is an expression of the posterior alone.  Steps go on
   until the totals settle, ``MAX_STEPS`` at most; what is then still missing is
   warned of with its size.
3. ``copies`` rounds a rate at random by a hash of the document, so that its
   expectation is the rate.

Domains are at most ``MAX_DOMAINS``; the broadcast word table has at most
``BUCKETS`` rows.

Defined cases: a null or wordless text has no tokens, the prior as posterior and
a rate like any other; a null domain is not learned from; without labelled rows
there is one domain, named null; rows that repeat id and text share their rate
and copies; a domain without a target has target 0; a target of a domain without
labelled rows cannot be met, which is warned of; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import fresh, lower_ascii, row_key, uniform
from clausewise.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1 << 14
MAX_DOMAINS = 64
MAX_LABELLED = 2_000
#: Columns of a labelled table that is itself a sample: rows of the domain before it, for the prior, and
#: the rows that share a text's weight.
ROWS_OF, SHARED = "rows_of_domain", "rows_of_id"
MAX_STEPS = 400
EFFECTIVE = 20.0
_SETTLED = 1e-6
#: Steps after which the rates are written, so that their expression stays short.
_STEPS = 16


def _buckets(text: Column) -> Column:
    """Hash buckets of the words, led by -1 for the document itself."""
    found = F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(-1).cast("long")), F.transform(found, lambda w: F.xxhash64(w).bitwiseAND(F.lit(BUCKETS - 1).cast("long"))))


@dataclass
class Model:
    domains: list[str | None]
    table: DataFrame  # bucket, one column l0, l1, ... of log likelihoods per domain
    unseen: list[float]
    prior: list[float]


def fit(labelled: DataFrame, domain: str = "domain", text: str = "text", max_labelled: int = MAX_LABELLED, smooth: float = 0.1) -> Model:
    """Word counts of the labelled rows (``domain``, ``text``) by domain.

    A table with the column ``ROWS_OF`` is a sample already and is taken whole."""
    sampled = ROWS_OF in labelled.columns
    rows = labelled.select(F.col(domain).cast("string").alias("d"), F.col(text).alias("t"), (F.col(ROWS_OF) if sampled else F.lit(1)).alias("n"),
                           (1 / F.col(SHARED) if SHARED in labelled.columns else F.lit(1.0)).alias("w")).filter("d IS NOT NULL")
    size = F.max("n") if sampled else F.count(F.lit(1))
    sizes = {r["d"]: r["n"] for r in rows.groupBy("d").agg(size.alias("n")).orderBy("d").limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains = sorted(sizes)
    spark = labelled.sparkSession
    if not domains:
        empty = spark.createDataFrame([], "bucket bigint, l0 double")
        return Model([None], empty, [0.0], [0.0])
    if not sampled:
        hashes = cut_lineage(rows.groupBy("d", F.xxhash64("t").alias("h")).agg((1 / F.count(F.lit(1))).alias("w")))
        few = reduce(DataFrame.unionByName, [hashes.filter(F.col("d") == d).orderBy("h").limit(max_labelled) for d in domains])
        rows = rows.drop("w").withColumn("h", F.xxhash64("t")).join(F.broadcast(few), ["d", "h"])
    words = rows.select("d", "w", F.explode(_buckets(F.col("t"))).alias("bucket")).filter("bucket >= 0")
    counted = words.groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("d") == d, F.col("w"))), F.lit(0.0)).alias(f"c{i}") for i, d in enumerate(domains)])
    counted = cut_lineage(counted)
    totals = counted.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(len(domains))]).first()
    below = [totals[i] + smooth * BUCKETS for i in range(len(domains))]
    logs = [F.log((F.col(f"c{i}") + smooth) / F.lit(b)).alias(f"l{i}") for i, b in enumerate(below)]
    n = sum(sizes.values())
    return Model(domains, counted.select("bucket", *logs), [math.log(smooth / b) for b in below], [math.log(sizes[d] / n) for d in domains])


def posteriors(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct documents: ``_id``, ``_key``, ``times`` (rows with this id and text), ``n_tokens``, ``p0``, ``p1``, ..."""
    k = range(len(model.domains))
    probes = docs.select(F.col(doc_id).alias("_id"), row_key(F.col(doc_id), F.col(text)).alias("_key"), _buckets(F.col(text)).alias("b"))
    probes = probes.select("_id", "_key", F.explode("b").alias("bucket")).join(F.broadcast(model.table), "bucket", "left")
    logs = [F.sum(F.when(F.col("bucket") >= 0, F.coalesce(F.col(f"l{i}"), F.lit(model.unseen[i])))).alias(f"l{i}") for i in k]
    summed = probes.groupBy("_id", "_key").agg(F.count(F.when(F.col("bucket") < 0, 1)).alias("times"),
                                               F.count(F.when(F.col("bucket") >= 0, 1)).alias("all"), *logs)
    n = (F.col("all") / F.col("times")).cast("long")
    soft = F.lit(EFFECTIVE) / F.greatest(n.cast("double"), F.lit(EFFECTIVE)) / F.col("times")
    scored = summed.select("_id", "_key", "times", n.alias("n_tokens"),
                           *[(F.coalesce(F.col(f"l{i}"), F.lit(0.0)) * soft + F.lit(model.prior[i])).alias(f"s{i}") for i in k])
    top = F.greatest(*[F.col(f"s{i}") for i in k]) if len(k) > 1 else F.col("s0")
    scored = scored.select("*", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in k])
    total = reduce(Column.__add__, [F.col(f"e{i}") for i in k])
    # rounded, so that the order in which words were summed does not show
    return scored.select("_id", "_key", "times", "n_tokens", *[F.round(F.col(f"e{i}") / total, 9).alias(f"p{i}") for i in k])


def fit_rates(members: DataFrame, targets: Sequence[float], low: float = 0.0, high: float | None = None, start: float = 1.0,
              max_steps: int = MAX_STEPS) -> DataFrame:
    """``members`` (times, n_tokens, p0, ...) with ``rate``."""
    k = range(len(targets))
    t = np.asarray(targets, dtype=float)
    weight = F.col("times") * F.col("n_tokens")
    sums = members.agg(*[F.coalesce(F.sum(weight * F.col(f"p{i}") * F.col(f"p{j}")), F.lit(0.0)).alias(f"h{i}_{j}") for i in k for j in k]).first()
    inverse = np.linalg.pinv(np.array(list(sums), dtype=float).reshape(len(t), len(t)), hermitian=True)

    def clip(c: Column) -> Column:
        c = F.greatest(c, F.lit(float(low)))
        return c if high is None else F.least(c, F.lit(float(high)))

    def measure(now: DataFrame, rate: Column) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected tokens of the domains, H of the documents whose rate is at no bound, and the loss."""
        free = rate > low if high is None else (rate > low) & (rate < high)
        tokens = [F.sum(weight * rate * F.col(f"p{i}")) for i in k]
        inner = [F.sum(F.when(free, weight * F.col(f"p{i}") * F.col(f"p{j}"))) for i in k for j in k]
        row = now.agg(*[F.coalesce(c, F.lit(0.0)).alias(f"m{n}") for n, c in enumerate([*tokens, *inner])]).first()
        x = np.array(list(row), dtype=float)
        off = x[:len(t)] - t
        return x[:len(t)], x[len(t):].reshape(len(t), len(t)), float(off @ inverse @ off)

    now, rate, steps = members.withColumn("rate", clip(F.lit(float(start)))), F.col("rate"), 0
    totals, inner, loss = measure(now, rate)
    while True:
        for metric in (np.linalg.pinv(inner, hermitian=True), inverse):
            g = metric @ (totals - t)
            onward = clip(rate - reduce(Column.__add__, [F.col(f"p{i}") * F.lit(float(g[i])) for i in k]))
            after, inner, less = measure(now, onward)
            if less < loss:
                break
        else:
            break
        moved = np.abs(after - totals).max()
        rate, totals, loss = onward, after, less
        if moved <= _SETTLED * max(t.sum(), 1.0):
            break
        steps += 1
        if steps >= max_steps:
            warnings.warn(f"the totals still moved by {moved:.6g} tokens after {steps} steps; they miss the targets by {np.abs(totals - t).max():.6g} at most",
                          stacklevel=2)
            break
        if steps % _STEPS == 0:
            now, rate = cut_lineage(now.withColumn("rate", rate)), F.col("rate")
    return now.withColumn("rate", F.round(rate, 6))


def copies(rate: Column, key: Column, seed: str = "mix") -> Column:
    """The rate rounded down or up by a hash of the document."""
    whole = F.floor(rate)
    return (whole + (uniform(F.xxhash64(key, F.lit(seed))) <= rate - whole).cast("long")).cast("long")


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], doc_id: str = "doc_id", text: str = "text",
        domain: str = "domain", low: float = 0.0, high: float | None = None, tokens: float | None = None) -> tuple[DataFrame, list[str | None]]:
    """Distinct documents with posterior, ``rate`` and ``copies``; and the names of the domains.

    ``weights``: target shares by domain; ``tokens``: target of all tokens, by
    default as many as the documents have or, when rates may not fall below one
    (``low=1``), the least with which no domain would have to shrink."""
    model = fit(labelled, domain, text)
    unknown = sorted(d for d, w in weights.items() if w > 0 and d not in model.domains)
    if unknown:
        warnings.warn(f"no labelled rows of {', '.join(unknown)}: the targets of these domains are shared out among the others", stacklevel=2)
    members = cut_lineage(posteriors(docs, model, doc_id, text))
    k = range(len(model.domains))
    share = np.array([float(weights.get(d, 0.0)) if d is not None else 1.0 for d in model.domains])
    share = share / share.sum() if share.sum() else share
    weight = F.col("times") * F.col("n_tokens")
    row = members.agg(*[F.coalesce(F.sum(weight * F.col(f"p{i}")), F.lit(0.0)).alias(f"t{i}") for i in k]).first()
    have = np.array(list(row), dtype=float)
    if tokens is None:
        tokens = have.sum() if low < 1 else max([h / s for h, s in zip(have, share, strict=True) if s > 0], default=0.0)
    rated = fit_rates(members, list(share * tokens), low, high)
    return rated.withColumn("copies", copies(F.col("rate"), F.col("_key"))), model.domains


def resample(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], doc_id: str = "doc_id", text: str = "text",
             domain: str = "domain", low: float = 0.0, high: float | None = None, tokens: float | None = None) -> DataFrame:
    """``docs``, each row as often as its rate says."""
    rated, _ = mix(docs, labelled, weights, doc_id, text, domain, low, high, tokens)
    row, key, other, n, copy = fresh(docs, "_row", "_key", "_id", "_copies", "_copy")
    keyed = docs.withColumn(row, row_key(F.col(doc_id), F.col(text)))
    drawn = rated.select(F.col("_id").alias(other), F.col("_key").alias(key), F.col("copies").alias(n)).filter(F.col(n) > 0)
    joined = keyed.join(drawn, (F.col(row) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(other)))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias(copy)).drop(copy)
