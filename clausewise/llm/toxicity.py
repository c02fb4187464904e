"""Toxicity by a support vector machine over a subsequence string kernel (operator 11).

The kernel compares two strings by their subsequences of three symbols, each
weighted by ``DECAY`` for every symbol it skips (at most ``SPAN`` symbols wide),
normalised to 1 for equal strings and taken to the power ``SHARP``, which again is
a kernel.  So a word with a character put in, left out or set apart stays near its
original.  Symbols are a-z, four classes of other letters and one of digits; signs
are skipped, and single letters that stand alone in a row are read as one word
(``i d-i o t``).

A sentence is represented by its best match with each of ``LANDMARKS + COMMON`` landmark
strings, mapped by the inverse square root of the landmarks' kernel matrix
(Nystroem); a linear machine on that decides.  Landmarks are the words that speak
most for toxic documents, but for those too like one before them, and the most
common words of the others.  As labels are
of documents, a toxic one is learned from by the sentence that the machine so far
finds worst, and so is a clean one; ``PASSES`` passes settle them.  A document's
score is that of its worst sentence, in (0, 1), and 0.7 at the threshold that
separates the labelled documents best.

The fit takes at most ``MAX_LABELLED`` labelled ids of each label, those with the
smallest hash, each distinct text once; what the driver holds is one vector of
each and the landmarks.  Scoring reads whole texts in Arrow batches without a
shuffle and works out the kernel once for every distinct word of ``SLICE`` bytes
of text.  Labels, ids, languages and sources are no features.

Defined cases: a null text is empty; a text without words has no matches, is
scored as such and is among the examples that are not toxic; null labels, ids and texts whose labels disagree are not learned
from; without labels of both kinds every score is 0; words of more than
``WINDOW`` symbols count by their best window of that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.session import cut_lineage, ship_package

MAX_LABELLED = 3_000
#: Landmarks that speak for toxic documents, and common ones of the others.
LANDMARKS, COMMON = 48, 16
#: Candidates for the former, and the kernel with a landmark from which a candidate is too like it.
CANDIDATES, ALIKE = 480, 0.5
PASSES = 3
FLAG_SCORE = 0.7
DECAY, SPAN, SHARP = 0.8, 6, 3
WINDOW, STRIDE = 16, 8
SLICE = 5_000_000
#: Rows that one step of the kernel takes.
_ROWS = 20_000
#: Words whose matches are looked up at once.
_WORDS = 100_000

# Of a byte: 0 skipped, 1-26 a letter, 27-30 another letter (by the last byte of its code), 31 a digit, 32 white space.
_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:192] = 27 + np.arange(64) % 4
_SYMBOL[48:58] = 31
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 32


# ---------------------------------------------------------------- kernel

def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the subsequences of three in a string of this length, and their weights."""
    at = [(i, j, k) for i in range(length) for j in range(i + 1, length) for k in range(j + 1, min(i + SPAN, length))]
    return np.array(at, dtype=np.int64).reshape(-1, 3), np.array([DECAY ** (k - i - 2) for i, _, k in at], dtype=np.float32)


def _codes(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    s = symbols.astype(np.int32)
    return s[:, at[:, 0]] << 10 | s[:, at[:, 1]] << 5 | s[:, at[:, 2]]


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each row with itself."""
    n, width = codes.shape
    if not n or not width:
        return np.zeros(n, dtype=np.float32)
    order = np.argsort(codes, axis=1)
    ordered = np.take_along_axis(codes, order, axis=1)
    new = np.ones((n, width), dtype=bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.flatnonzero(new)
    each = np.add.reduceat(weights[order].ravel(), first)
    return np.sqrt(np.bincount(first // width, each * each, minlength=n)).astype(np.float32)


def _folded(first: np.ndarray, end: int, take, op: np.ufunc) -> np.ndarray:
    """Rows ``take(i)`` of each run of ``i`` (from one of ``first`` to the next, the last to ``end``) folded by ``op``.

    The same as ``op.reduceat`` over rows, which is slow: here the j-th rows of all runs are folded at once,
    and runs of more than 256 each by itself."""
    size = np.diff(np.append(first, end))
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[order]
    long = int(np.searchsorted(-size, -256))
    parts = []
    for b, n in zip(begin[:long], size[:long], strict=True):
        parts.append(op.reduce([op.reduce(take(np.arange(at, min(at + _ROWS, b + n))), axis=0) for at in range(b, b + n, _ROWS)], axis=0))
    out = take(begin[long:])
    for j in range(1, int(size[long]) if long < len(size) else 0):
        m = int(np.searchsorted(-size[long:], -j))
        op(out[:m], take(begin[long:long + m] + j), out=out[:m])
    back = np.empty_like(out, shape=(len(first), out.shape[1]))
    back[order[:long]] = np.array(parts).reshape(long, out.shape[1])
    back[order[long:]] = out
    return back


class Landmarks:
    """Landmark strings as a table from a subsequence to its weight in each of them."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.table = np.zeros((1 << 15, len(words)), dtype=np.float32)
        for i, w in enumerate(words):
            at, weights = _triples(len(w))
            codes = _codes(np.frombuffer(w, dtype=np.uint8)[None, :], at)
            np.add.at(self.table[:, i], codes[0], weights)
            self.table[:, i] /= max(float(_norms(codes, weights)[0]), 1e-9)
        self.known = self.table.any(axis=1)

    def match(self, symbols: np.ndarray) -> np.ndarray:
        """Kernel of strings of one length (rows of symbols) with every landmark."""
        at, weights = _triples(symbols.shape[1])
        out = np.zeros((len(symbols), len(self.words)), dtype=np.float32)
        if not len(weights):
            return out
        for begin in range(0, len(symbols), _ROWS):
            codes = _codes(symbols[begin:begin + _ROWS], at)
            row, which = np.nonzero(self.known[codes])  # few subsequences are in any landmark
            if not len(row):
                continue
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            rows = row[first]
            code, weight = codes[row, which], weights[which][:, None]
            sums = _folded(first, len(row), lambda i, c=code, w=weight: w[i] * self.table[c[i]], np.add)
            out[begin + rows] = sums / _norms(codes[rows], weights)[:, None]
        sharp = out.copy()
        for _ in range(SHARP - 1):
            sharp *= out
        return sharp

    def of_words(self, words: pa.BinaryArray) -> np.ndarray:
        """Kernel of words with every landmark; of a long one, its best window's."""
        sizes = np.diff(np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + len(words) + 1])
        begin = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + len(words)]
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        out = np.zeros((len(words), len(self.words)), dtype=np.float32)
        for length in range(3, WINDOW + 1):
            at = np.flatnonzero(sizes == length)
            if len(at):
                out[at] = self.match(data[begin[at][:, None] + np.arange(length)])
        for i in np.flatnonzero(sizes > WINDOW):
            starts = np.append(np.arange(0, sizes[i] - WINDOW, STRIDE), sizes[i] - WINDOW)
            for few in range(0, len(starts), _ROWS):
                windows = data[begin[i] + starts[few:few + _ROWS][:, None] + np.arange(WINDOW)]
                out[i] = np.maximum(out[i], self.match(windows).max(axis=0))
        return out

    def nystroem(self) -> np.ndarray:
        """The inverse square root of the landmarks' kernel matrix."""
        kernel = self.of_words(pa.array(self.words, pa.binary())).astype(np.float64)
        values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
        return vectors @ np.diag(np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0.0)) @ vectors.T


# ---------------------------------------------------------------- words and sentences

def cut(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words of texts as strings of symbols, where each sentence begins in them, and its text's number."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    s = _SYMBOL[raw]
    begins = np.zeros(len(s) + 1, dtype=bool)
    begins[at[:-1] - at[0]] = True
    white = s == 32
    # a sentence ends in a new line, and after a sign before white space
    ends = raw == 10
    ends[1:] |= white[1:] & np.isin(raw[:-1], np.frombuffer(b".!?", dtype=np.uint8))
    letters = np.flatnonzero((s > 0) & ~white).astype(np.int32)
    # a word: letters without white space or a text's beginning between them
    block = np.cumsum(white | begins[:-1], dtype=np.int32)[letters]
    start = np.flatnonzero(np.append(True, block[1:] != block[:-1])[:len(letters)])
    of = np.searchsorted(np.flatnonzero(begins[:-1] | ends), letters[start], side="right")
    alone = np.diff(np.append(start, len(letters))) == 1
    joined = np.append(False, alone[1:] & alone[:-1] & (of[1:] == of[:-1]))[:len(start)]
    start, of = start[~joined], of[~joined]
    ends_at = np.append(start, len(letters)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends_at), pa.py_buffer(np.ascontiguousarray(s[letters]))])
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[:len(of)])
    text = np.searchsorted(at[:-1] - at[0], letters[start[first]], side="right") - 1
    return words.dictionary_encode(), first, text


def slices(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]).astype(np.int64))
    begin = 0
    while begin < len(texts):
        end = max(int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE, side="right")), begin + 1)
        yield texts.slice(begin, end - begin)
        begin = end


@dataclass(frozen=True)
class Model:
    words: list[bytes]
    weights: np.ndarray
    bias: float
    threshold: float

    def score(self, decision: np.ndarray) -> np.ndarray:
        at = np.log(FLAG_SCORE / (1 - FLAG_SCORE)) + 1e-9
        return 1 / (1 + np.exp(-np.clip(2 * (decision - self.threshold) + at, -700, 700)))


def worst_sentences(texts: pa.StringArray, landmarks: Landmarks, weights: np.ndarray) -> np.ndarray:
    """Of each text, the matches of the sentence whose weighted sum is largest; zeros without words."""
    out = np.zeros((len(texts), len(landmarks.words)), dtype=np.float32)
    done = 0
    for part in slices(texts):
        words, first, text = cut(part)
        if len(first):
            of = landmarks.of_words(words.dictionary)
            codes = words.indices.to_numpy()
            best = np.zeros((len(first), of.shape[1]), dtype=np.float32)
            some = np.flatnonzero(of.any(axis=1)[codes])  # words that match at all
            sentence = np.searchsorted(first, some, side="right") - 1
            step = 0
            while step < len(some):  # about so many words at once, whole sentences
                stop = len(some) if step + _WORDS >= len(some) else int(np.searchsorted(sentence, sentence[step + _WORDS], side="right"))
                cuts = np.flatnonzero(np.append(True, sentence[step + 1:stop] != sentence[step:stop - 1]))
                at = codes[some[step:stop]]
                best[sentence[step + cuts]] = _folded(cuts, len(at), lambda i, at=at: of[at[i]], np.maximum)
                step = stop
            value = best @ weights.astype(np.float32)
            order = np.lexsort((value, text))
            last = np.flatnonzero(np.append(text[order][1:] != text[order][:-1], True))
            out[done + text[order[last]]] = best[order[last]]
        done += len(part)
    return out


# ---------------------------------------------------------------- fit

def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 300.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine: squared hinge loss, labels weighted alike, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    sign = np.where(y == 1, 1.0, -1.0)
    each = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum()) * cost
    ridge = np.diag(np.append(np.ones(x.shape[1]), 1e-3))

    def loss(w: np.ndarray) -> float:
        return float(w @ ridge @ w / 2 + (each * np.maximum(1 - sign * (z @ w), 0) ** 2).sum() / 2)

    w = np.zeros(z.shape[1])
    for _ in range(60):
        short = np.maximum(1 - sign * (z @ w), 0)
        on = short > 0
        gradient = ridge @ w - z.T @ (each * sign * short)
        step = np.linalg.solve(ridge + (z[on] * each[on, None]).T @ z[on], gradient)
        size = 1.0
        while size > 1e-8 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() * size < 1e-7:
            break
    return w[:-1], float(w[-1])


def best_threshold(decision: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Between the two decisions where the F1 of what lies above is largest."""
    order = np.argsort(-decision, kind="stable")
    d, hit = decision[order], np.where(y[order] == 1, weight[order], 0)
    good, all_ = np.cumsum(hit), np.cumsum(weight[order])
    f1 = 2 * good / (all_ + hit.sum())
    f1[:-1][d[:-1] == d[1:]] = -1
    at = int(np.argmax(f1))
    return float((d[at] + d[at + 1]) / 2) if at + 1 < len(d) else float(d[at] - 1e-6)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, max_labelled: int) -> tuple[DataFrame, dict[int, int]]:
    """``text, y`` of a bounded sample of labelled documents, each distinct text once; and how many ids each label has."""
    known = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
                   .filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
                   .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z").drop("_z"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("_id").cast("string"))
    sample = known.filter("_y = 0").orderBy(order).limit(max_labelled).unionByName(known.filter("_y = 1").orderBy(order).limit(max_labelled))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "_id")
    once = rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("_y").alias("y"), F.max("_y").alias("z"), F.first("text").alias("text"))
    return cut_lineage(once.filter("y = z").select("h", "text", "y")), sizes


def choose_landmarks(sample: DataFrame, count: int = LANDMARKS, common: int = COMMON) -> tuple[list[bytes], list[bytes]]:
    """The words of three symbols and more that speak most for label 1, and the most common ones of label 0."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                distinct = cut(pa.array([text.as_py()], pa.string()))[0].dictionary
                yield pa.RecordBatch.from_arrays([distinct, pa.array([y] * len(distinct), pa.int32())], ["word", "y"])

    found = (sample.select("text", "y").mapInArrow(seen, "word binary, y int").filter((F.length("word") >= 3) & (F.length("word") <= WINDOW))
                   .groupBy("word").agg(F.count(F.when(F.col("y") == 1, 1)).alias("n1"), F.count(F.when(F.col("y") == 0, 1)).alias("n0")))
    found = cut_lineage(found.filter("n1 + n0 > 2"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = F.log((F.col("n1") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("n0") + 0.5) / (sizes.get(0, 0) + 1))
    speak = found.filter("n1 > 2").withColumn("s", F.round(F.col("n1") * odds, 6)).filter("s > 0")
    likely = [bytes(r["word"]) for r in speak.orderBy(F.desc("s"), "word").limit(CANDIDATES).collect()]
    alike = Landmarks(likely).of_words(pa.array(likely, pa.binary()))
    chosen: list[int] = []
    for i in range(len(likely)):
        if len(chosen) < count and (alike[i, chosen] < ALIKE).all():
            chosen.append(i)
    rest = found.filter(~F.col("word").isin(likely)) if likely else found
    return [likely[i] for i in chosen], [bytes(r["word"]) for r in rest.orderBy(F.desc("n0"), "word").limit(common).collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
        max_labelled: int = MAX_LABELLED) -> Model:
    ship_package(docs.sparkSession)
    sample, sizes = labelled_texts(docs, labels, label, doc_id, text, max_labelled)
    toxic, clean = choose_landmarks(sample)
    if not toxic or not clean:
        return Model([], np.zeros(0), 0.0, 1e9)
    words = toxic + clean
    half = Landmarks(words).nystroem()
    shared = docs.sparkSession.sparkContext.broadcast(words)
    along, bias = np.repeat([1.0, 0.0], [len(toxic), len(clean)]), 0.0
    for turn in range(PASSES + 1):

        def worst(batches: Iterator[pa.RecordBatch], along: np.ndarray = along) -> Iterator[pa.RecordBatch]:
            landmarks = Landmarks(shared.value)
            for batch in batches:
                z = worst_sentences(batch.column(1), landmarks, along)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(z), pa.list_(pa.float32()))], ["h", "y", "z"])

        rows = sorted(sample.mapInArrow(worst, "h string, y int, z array<float>").collect())  # at most 2 * max_labelled rows
        z, y = np.array([r["z"] for r in rows], dtype=float), np.array([r["y"] for r in rows])
        if turn == PASSES:
            break
        # what has no words is not toxic: a twentieth of the examples that are not
        blank = max(int((y == 0).sum()) // 20, 1)
        w, bias = fit_machine(np.vstack([z, np.zeros((blank, z.shape[1]))]) @ half, np.append(y, np.zeros(blank, dtype=int)))
        along = half @ w
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    return Model(words, along, bias, best_threshold(z @ along + bias, y, weight))


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    ship_package(docs.sparkSession)
    if not model.words:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        landmarks = Landmarks(known.words)
        for texts in batches:
            decision = worst_sentences(texts, landmarks, known.weights) @ known.weights + known.bias
            yield pa.array(known.score(decision), pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(score, "double")(F.coalesce(F.col(text), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``score`` and ``predicted`` (1: toxic; columns of these names are replaced)."""
    out = with_score(docs, fit(docs, labels, label, doc_id, text), text)
    return out.withColumns({"held_out": held_out(F.col(doc_id)), "predicted": (F.col("score") >= FLAG_SCORE).cast("int")})
