"""Quality classifier by Bradley-Terry pairwise ranking (operator 4).

A document's strength is a linear score of features of its whole text.  Every
pair of a good and a bad labelled document is a preference; the weights minimise
the logistic loss of the feature differences of such pairs (the intercept
cancels).  The threshold is a quantile of the strengths of the labelled rows:
the one below which as many of them lie as are labelled bad.  The strength is
reported as a score in (0, 1) that is 0.7 at this threshold.

The fit takes every labelled row that is not held out (of rows that repeat an id,
the text with the smallest hash speaks for it) and every pair of a good and a bad
one: each Newton step is an aggregation of the rows' features by label and a narrow
bin of the strength, whose rows take the bin's mean strength.  The threshold is the
exact quantile of all strengths.  The driver holds sums of bins.  Scoring covers
every document, in Arrow batches without a shuffle.  Labels, ids, languages and sources are no features.

Defined cases: a null text is empty; an empty text has all shares zero and is
scored like any other; null labels, and ids whose labels disagree, are not
learned from; without labels of both kinds every document scores 0.7 and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import fresh
from clausewise.session import ship_package, written

#: Bins of a unit of strength, and strengths beyond which there is one bin each side.
BINS, REACH = 32, 32
#: Ridge, Newton steps at most, the step that ends them, and values that the driver sorts at most.
RIDGE, STEPS, CLOSE, FEW = 1e-3, 25, 1e-4, 10_000
KEEP_SCORE = 0.7

_CLASS = np.zeros(256, dtype=np.int64)  # of a byte: 0 other, 1 A-Z, 2 a-z, 3 digit, 4 white space, 5 comma or stop, 6 other ASCII sign
_CLASS[33:127] = 6
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[44, 46]] = 5

FEATURES = ("upper", "digits", "signs", "stops", "space", "bare signs", "signs at end", "repeated next", "distinct words",
            "short words", "word length", "log words", "repeated lines")


def features(text: str) -> np.ndarray:
    """Shares of kinds of bytes, words and lines; see ``FEATURES``."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    words = text.split()
    if not words:
        return np.zeros(len(FEATURES))
    kinds = np.bincount(_CLASS, np.bincount(data, minlength=256), minlength=7) / len(data)
    letters = kinds[0] + kinds[1] + kinds[2]
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    return np.array([
        kinds[1] / letters if letters else 0.0, kinds[3], kinds[6], kinds[5], kinds[4],
        sum(not any(map(str.isalnum, w)) for w in words if len(w) < 4) / n,
        sum(not w[-1].isalnum() and w[-1] not in ",." for w in words) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(words)) / n, sum(len(w) < 4 for w in words) / n,
        min(len(text) / n, 50.0), np.log1p(n), 1 - len(set(lines)) / len(lines)])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        at = np.log(KEEP_SCORE / (1 - KEEP_SCORE)) + 1e-9
        strength = (rows - self.mean) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(strength - self.threshold + at, -700, 700)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = 100_000, ridge: float = RIDGE, seed: int = 7) -> np.ndarray:
    """The same weights from drawn pairs of a few rows, by Newton steps (:func:`fit_weights` takes all pairs)."""
    draw = np.random.default_rng(seed)
    d = good[draw.integers(len(good), size=pairs)] - bad[draw.integers(len(bad), size=pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance that the pair is ranked wrongly
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def pair_sums(z: np.ndarray, w: np.ndarray, y: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Rows by label and bin of their strength: number, sum and sum of products of their features."""
    bins = np.clip(np.floor(z @ w * BINS), -BINS * REACH, BINS * REACH).astype(np.int64)
    out = {}
    for k in (0, 1):
        rows, at = z[y == k], bins[y == k]
        for b in np.unique(at):
            some = rows[at == b]
            out[k, int(b)] = np.concatenate([[len(some)], some.sum(axis=0), (some.T @ some).ravel()])
    return out


def newton_step(sums: dict[tuple[int, int], np.ndarray], w: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """A Newton step of the logistic loss of ``good - bad`` over every pair of a good and a bad row.

    The rows of a bin take its mean strength, so the sums over all pairs are sums over pairs of bins."""
    d = len(w)
    bad, good = (np.array([v for (k, _), v in sums.items() if k == y]).reshape(-1, 1 + d + d * d) for y in (0, 1))
    (nb, sb, qb), (ng, sg, qg) = ((x[:, 0], x[:, 1:1 + d], x[:, 1 + d:].reshape(-1, d, d)) for x in (bad, good))
    p = 1 / (1 + np.exp(np.clip((sg @ w / ng)[:, None] - (sb @ w / nb)[None, :], -500, 500)))  # chance that a pair is ranked wrongly
    h, pairs = p * (1 - p), ng.sum() * nb.sum()
    cross = sg.T @ h @ sb
    hessian = np.tensordot(h @ nb, qg, 1) + np.tensordot(ng @ h, qb, 1) - cross - cross.T
    gradient = (p @ nb) @ sg - (ng @ p) @ sb
    return np.linalg.solve(hessian / pairs + ridge * np.eye(d), gradient / pairs - ridge * w)


def fit_weights(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights of the Bradley-Terry model from all ``rows`` (``y``, ``x``): each step is one aggregation over them."""
    width = len(mean)
    w = np.zeros(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            z = (np.asarray(b.column("x").flatten()).reshape(-1, width) - mean) / scale
            for k, v in pair_sums(z, w, np.asarray(b.column("y"))).items():
                sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int64()),
                                          pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], ["y", "bin", "v"])

    for _ in range(STEPS):
        parts = rows.mapInArrow(partial, "y int, bin long, v array<double>").groupBy("y", "bin").agg(F.sort_array(F.collect_list("v")).alias("l"))
        total = F.aggregate(F.slice("l", 2, F.size("l")), F.element_at("l", 1), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
        step = newton_step({(r["y"], r["bin"]): np.array(r["v"]) for r in parts.select("y", "bin", total.alias("v")).orderBy("y", "bin").collect()}, w)
        w = w + step
        if np.abs(step).max() < CLOSE:
            break
    return w


def at_rank(values: DataFrame, rank: int, few: int = FEW) -> float:
    """The value ``s`` with ``rank`` smaller or equal ones before it (0-based), of any number: ranges that hold it
    are cut into parts and counted until one holds a few."""
    while True:
        lo, hi, n = values.agg(F.min("s"), F.max("s"), F.count("s")).first()
        if lo == hi:
            return float(lo)
        if n <= few:
            return float(sorted(r["s"] for r in values.select("s").collect())[rank])
        part = F.floor((F.col("s") - lo) / (hi - lo) * 1024)
        for r in values.groupBy(part.alias("part")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("s").alias("n")).orderBy("part").collect():
            if rank < r["n"]:
                values = values.filter(F.col("s").between(r["lo"], r["hi"]))
                break
            rank -= r["n"]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _rows(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or "") for t in texts]).reshape(len(texts), len(FEATURES))


def _feature_lists(texts: pa.Array) -> pa.Array:
    return pa.array(list(_rows(texts)), pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Model:
    ship_package(docs.sparkSession)
    known = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y"))
                   .filter(F.col("y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
                   .groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("_z")).filter("y = _z").drop("_z"))
    # features are worked out beside the texts, so that these are not shuffled to their labels
    seen = docs.filter(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(
        F.col(doc_id).alias("_id"), F.struct(F.xxhash64(text), F.arrow_udf(_feature_lists, "array<double>")(text).alias("x")).alias("_one"))
    rows = written(seen.join(known, "_id").groupBy("_id", "y").agg(F.min("_one").alias("_one")).select("y", "_one.x"))
    width = range(len(FEATURES))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(len(width)), np.ones(len(width)), np.zeros(len(width)), 0.0)
    both = rows.agg(*[F.avg(F.col("x")[j]) for j in width], *[F.stddev_pop(F.col("x")[j]) for j in width]).first()
    mean, scale = np.array(both[:len(width)]), np.array(both[len(width):])
    scale[scale == 0] = 1.0
    weights = fit_weights(rows, mean, scale)

    def strength(x: pa.Array) -> pa.Array:
        return pa.array((np.asarray(x.flatten()).reshape(-1, len(weights)) - mean) / scale @ weights, pa.float64())

    strengths = written(rows.select(F.arrow_udf(strength, "double")("x").alias("s")))
    # quantile of the strengths at the share of bad labels
    return Model(mean, scale, weights, (at_rank(strengths, sizes[0] - 1) + at_rank(strengths, sizes[0])) / 2)


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(_rows(texts)), pa.float64())

    return docs.withColumn(out, F.arrow_udf(score, "double")(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``score`` and ``predicted`` (1: good; columns of these names are replaced)."""
    out = with_score(docs, fit(docs, labels, label, doc_id, text), text)
    return out.withColumns({"held_out": held_out(F.col(doc_id)), "predicted": (F.col("score") >= KEEP_SCORE).cast("int")})


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    (score,) = fresh(docs, "_score")
    scored = with_score(docs, fit(docs, labels, label, doc_id, text), text, score)
    return scored.filter(F.col(score) >= KEEP_SCORE).drop(score)
