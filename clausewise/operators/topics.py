"""Topics (T1-T8): clustering precursor texts and describing the clusters.

* T1 ``cluster_density`` - exact density clustering: a vector with at least
  ``min_pts`` vectors within ``eps`` (itself among them) is a core; cores within
  ``eps`` are one topic; any other vector within ``eps`` of a core joins the
  smallest core label near it; the rest are outliers (``-1``).  Neighbours come from
  the blocked join of :mod:`clausewise.operators.neighbours`, whose groups return
  counts and spanning edges, and components from min-label propagation with
  lineage cut by reliable checkpoints.
* T2/T3/T8 - Spark ML ``PCA`` / ``KMeans`` and repeated fits over seeds; k-means
  without chance (``cluster_lloyd``), and the agreement of repeated fits.
* W4 ``precursor_job`` - precursors, their embeddings, topics and descriptions in one job.
* T4-T7 - labels, sizes and class-based TF-IDF keywords per topic, all
  aggregations and one top-k window per topic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.constants import TOPIC_TOP_N
from clausewise.functions.text import KEYWORD_TOKEN
from clausewise.operators import neighbours as N
from clausewise.session import cut_lineage

OUTLIER = -1


# ---------------------------------------------------------------- T1 density clustering
def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``nodes`` (``node``), ``edges`` (``u, v``) -> ``node, label`` (the smallest node).

    Each round takes the smallest label among a node's neighbours and then that
    label's own label (pointer jumping), so the rounds grow with the logarithm
    of a component's diameter.  Rounds go on until no label changes; each is
    written to the checkpoint folder, and one emptiness test is the only driver
    action."""
    both = cut_lineage(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    while True:
        offers = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("to"))
        near = labels.withColumnRenamed("label", "was").join(offers, "node", "left").select("node", "was", F.least("was", "to").alias("to"))
        onward = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        new = cut_lineage(near.join(onward, "to").select("node", "was", F.least("to", "beyond").alias("label")))
        labels = new.select("node", "label")
        if new.filter("label < was").isEmpty():
            return labels


def _forest(near: np.ndarray, square: bool) -> np.ndarray:
    """Per row, then per column, the first member of its component; a square matrix is of one set with itself."""
    n, m = near.shape
    label = np.arange(n if square else n + m)
    while True:
        new = label.copy()
        to = label if square else label[n:]
        for k in N.strips(n):
            new[k] = np.minimum(label[k], np.where(near[k], to[None, :], n + m).min(axis=1, initial=n + m))
        if not square:
            for k in N.strips(n):
                new[n:] = np.minimum(new[n:], np.where(near[k], new[k, None], n + m).min(axis=0, initial=n + m))
        if (new == label).all():
            return label
        label = new


def cluster_density(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", eps: float = 0.5, min_pts: int = 5,
                    block: int | None = None) -> DataFrame:
    """``(id, topic)``; topics are numbered by size (largest first, then by smallest label), outliers ``-1``.

    Equal vectors are one weighted point until the end.  Rows without a vector
    are outliers; rows that repeat an id come back as often."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = cut_lineage(df.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda v: v.cast("double")).alias("vec")))
    known = rows.filter("vec IS NOT NULL")
    block = block or N.block_size(known.count())
    points, pairs = N.blocked(known.groupBy("vec").agg(F.min("id").alias("vid"), F.count(F.lit(1)).alias("w")), eps, block=block)
    points, pairs = cut_lineage(points), cut_lineage(pairs)
    e = float(eps)

    def count(left: pa.Table, right: pa.Table | None) -> pa.Table:
        x, w = N.matrix(left), left.column("w").to_numpy()
        y, v = (x, w) if right is None else (N.matrix(right), right.column("w").to_numpy())
        here, there = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        for k in N.strips(len(x)):
            near = N.within(x[k], y, e)
            here[k] = near @ v
            there += near.T @ w[k]
        if right is None:
            return pa.table({"vid": left.column("vid"), "n": pa.array(here)})
        n = np.append(here, there)
        return pa.table({"vid": pa.concat_arrays(left.column("vid").chunks + right.column("vid").chunks), "n": pa.array(n)})

    counts = N.over_pairs(points, pairs, count, f"vid {kind}, n bigint").groupBy("vid").agg(F.sum("n").alias("n"))
    marked = cut_lineage(points.join(counts, "vid").select("vid", "vec", "bid", (F.col("n") >= min_pts).alias("core")))

    def link(left: pa.Table, right: pa.Table | None) -> pa.Table:
        """Spanning edges of the cores; and, of the others, each core near them: fewer than ``min_pts``."""
        square = right is None
        right = left if square else right
        near = N.within(N.matrix(left), N.matrix(right), e)
        a, b = left.column("core").to_numpy(), right.column("core").to_numpy()
        at, bt = np.flatnonzero(a), np.flatnonzero(b)
        first = _forest(near[np.ix_(at, bt)], square)
        nodes = at if square else np.append(at, bt + len(left))
        off = np.flatnonzero(first != np.arange(len(first)))
        u, v = [nodes[off]], [nodes[first[off]]]
        i, j = np.nonzero(near & ~a[:, None] & b[None, :])
        u, v = [*u, i], [*v, j + (0 if square else len(left))]
        if not square:
            i, j = np.nonzero(near & a[:, None] & ~b[None, :])
            u, v = [*u, j + len(left)], [*v, i]
        vid = pa.chunked_array(left.column("vid").chunks + ([] if square else right.column("vid").chunks))
        ends = [pa.array(np.concatenate(c).astype(np.int64)) for c in (u, v)]
        return pa.table({"u": vid.take(ends[0]), "v": vid.take(ends[1]), "inner": pa.array(np.arange(len(ends[0])) < len(off))})

    links = cut_lineage(N.over_pairs(marked, pairs, link, f"u {kind}, v {kind}, inner boolean"))
    cores = connected(marked.filter("core").select(F.col("vid").alias("node")), links.filter("inner")).withColumnRenamed("node", "vid")
    border = (links.filter("NOT inner").join(cores.withColumnRenamed("vid", "v"), "v")
                   .groupBy(F.col("u").alias("vid")).agg(F.min("label").alias("label")))
    label = cut_lineage(cores.unionByName(border).join(points.select("vid", "vec", "w"), "vid"))
    sizes = label.groupBy("label").agg(F.sum("w").alias("size"))
    # topic numbers by size (largest first): a distributed consecutive index, no single-task window
    from clausewise.operators.precursors import sequence_index
    ranked = sequence_index(sizes.withColumn("_neg", -F.col("size")), [], ["_neg", "label"]).select("label", F.col("_g").cast("long").alias("topic"))
    topics = label.join(ranked, "label").select("vec", "topic")
    return rows.join(topics, "vec", "left").select(F.col("id").alias(id_col), F.coalesce("topic", F.lit(OUTLIER).cast("long")).alias("topic"))


def precursor_job(precursors: DataFrame, embeddings: DataFrame, key: str = "clause_id", text_col: str = "doc",
                  vec_col: str = "embedding", top_n: int = TOPIC_TOP_N, resolve: Callable[..., DataFrame] | None = None,
                  **density) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Precursor clauses -> their embeddings -> density topics -> labels (T4), sizes (T5), keywords.

    Precursors without an embedding have no topic and are left out, as in the
    original, which clusters only embedded clauses.  With ``resolve`` the embeddings are
    references, turned into vectors for the precursors alone."""
    vectors = precursors.select(key).distinct().join(embeddings.select(key, vec_col), key)
    vectors = resolve(vectors, vec_col) if resolve else vectors
    labelled = cut_lineage(topic_labels(precursors, cluster_density(vectors, key, vec_col, **density), key))
    return labelled, topic_sizes(labelled), topic_keywords(labelled, text_col, "topic", top_n)


# ---------------------------------------------------------------- T2, T3, T8 (Spark ML)
def reduce_dims(df: DataFrame, vec_col: str = "embedding", k: int = 5, out_col: str = "reduced"):
    """PCA projection to ``k`` dimensions (returns the fitted model and the projected rows)."""
    x = df.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(x)
    return model, model.transform(x).withColumn(out_col, vector_to_array("_p")).drop("_v", "_p")


def cluster_kmeans(df: DataFrame, vec_col: str = "embedding", k: int = 8, seed: int = 42, max_iter: int = 20):
    """K-means topics (no outliers); returns (model, rows with ``topic``)."""
    x = df.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="topic").fit(x)
    return model, model.transform(x).withColumn("topic", F.col("topic").cast("long")).drop("_v")


def topic_runs(df: DataFrame, seeds: Sequence[int] = (1, 2, 3, 4, 5), **kw) -> DataFrame:
    """The same fit repeated over seeds, stacked with a ``run`` column."""
    out = None
    for s in seeds:
        _, r = cluster_kmeans(df, seed=s, **kw)
        r = r.withColumn("run", F.lit(s))
        out = r if out is None else out.unionByName(r)
    return out


#: Squared distances and centres are rounded to so many digits, so that the order of summation decides nothing.
DIGITS = 9


def _squares(vec: Column, centres: np.ndarray) -> list[Column]:
    """Rounded squared distances of a vector to each centre."""
    out = []
    for c in centres:
        there = F.array(*[F.lit(float(v)) for v in c])
        out.append(F.round(F.aggregate(F.zip_with(vec, there, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v), DIGITS))
    return out


def cluster_lloyd(df: DataFrame, key: str, vec_col: str = "embedding", k: int = 8, start: int = 0, max_iter: int = 20) -> tuple[np.ndarray, DataFrame]:
    """T3 without chance: ``(centres, rows (key, topic))``.

    The first centre is the vector with the ``start``-th smallest id, each further one the
    vector farthest from those before it (ties: smallest id); then Lloyd steps until no
    centre changes, ``max_iter`` at most.  A vector goes to its nearest centre (ties: the
    first); a centre without vectors stays.  Each step is one aggregation whose result is
    ``k`` centres, all that the driver holds.  Ids must be unique; rows without a vector
    have no topic; with fewer vectors than ``k`` there are fewer centres."""
    rows = df.select(F.col(key).alias("id"), F.transform(vec_col, lambda v: v.cast("double")).alias("vec"))
    known = cut_lineage(rows.filter("vec IS NOT NULL"))
    first = known.orderBy("id").limit(start + 1).collect()
    if len(first) <= start:
        return np.zeros((0, 0)), rows.select(F.col("id").alias(key), F.lit(None).cast("long").alias("topic"))
    centres = np.array([first[start]["vec"]])
    while len(centres) < k:
        far = F.least(*_squares(F.col("vec"), centres)) if len(centres) > 1 else _squares(F.col("vec"), centres)[0]
        best = known.select(F.struct((-far).alias("far"), "id", "vec").alias("r")).agg(F.min("r").alias("r")).first()["r"]
        if best["far"] == 0:
            break
        centres = np.vstack([centres, best["vec"]])

    def topic(now: np.ndarray) -> Column:
        nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).cast("long").alias("i")) for i, d in enumerate(_squares(F.col("vec"), now))]))
        return nearest["i"]

    for _ in range(max_iter):
        means = known.groupBy(topic(centres).alias("i")).agg(F.array(*[F.round(F.avg(F.col("vec")[j]), DIGITS) for j in range(centres.shape[1])]).alias("c")).collect()
        moved = centres.copy()
        for r in means:
            moved[r["i"]] = r["c"]
        if (moved == centres).all():
            break
        centres = moved
    placed = F.when(F.col("vec").isNotNull(), topic(centres))
    return centres, rows.select(F.col("id").alias(key), placed.alias("topic"))


def run_agreement(runs: DataFrame, key: str, run_col: str = "run", topic_col: str = "topic") -> DataFrame:
    """Adjusted Rand index of every pair of runs, ``(run_a, run_b, n, agreement)``, from their contingency tables.

    1 for the same partition, about 0 for unrelated ones; 1 when both put all rows, or
    none, together.  Rows without a topic are left out."""
    x = runs.select(F.col(key).alias("id"), F.col(run_col).alias("run"), F.col(topic_col).alias("topic")).filter("topic IS NOT NULL")
    other = x.select("id", F.col("run").alias("run_b"), F.col("topic").alias("topic_b"))
    cells = x.join(other, "id").filter("run < run_b").groupBy(F.col("run").alias("run_a"), "run_b", "topic", "topic_b").agg(F.count(F.lit(1)).alias("n"))
    cells = cut_lineage(cells)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    by = ["run_a", "run_b"]
    both = cells.groupBy(by).agg(F.sum("n").alias("n"), pairs("n").alias("both"))
    one = cells.groupBy(*by, "topic").agg(F.sum("n").alias("m")).groupBy(by).agg(pairs("m").alias("one"))
    two = cells.groupBy(*by, "topic_b").agg(F.sum("n").alias("m")).groupBy(by).agg(pairs("m").alias("two"))
    chance = F.col("one") * F.col("two") / (F.col("n") * (F.col("n") - 1) / 2)
    index = (F.col("both") - chance) / ((F.col("one") + F.col("two")) / 2 - chance)
    x = both.join(one, by).join(two, by)
    same = (F.col("n") < 2) | ((F.col("one") == F.col("two")) & (F.col("one") == F.col("both")))
    return x.select(*by, "n", F.when(same, F.lit(1.0)).otherwise(index).alias("agreement"))


# ---------------------------------------------------------------- T4-T7 descriptions
def topic_labels(docs: DataFrame, topics: DataFrame, key: str) -> DataFrame:
    """T4: documents with their topic label."""
    return docs.join(topics, key, "inner")


def topic_sizes(labelled: DataFrame, topic_col: str = "topic", drop_outliers: bool = False) -> DataFrame:
    """T5: number of documents per topic, largest first."""
    x = labelled.filter(F.col(topic_col) != OUTLIER) if drop_outliers else labelled
    return x.groupBy(topic_col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), topic_col)


def topic_word_weights(labelled: DataFrame, text_col: str = "doc", topic_col: str = "topic") -> DataFrame:
    """Class-based TF-IDF of every (topic, word): ``tf / T_topic * ln(A / f_word)``
    with ``T_topic`` the words of the topic, ``f_word`` the word's count over all
    topics and ``A`` the mean number of words per topic."""
    toks = labelled.select(topic_col, F.explode(F.regexp_extract_all(F.lower(F.col(text_col)),
                                                                        F.lit(KEYWORD_TOKEN), 0)).alias("word"))
    tf = toks.groupBy(topic_col, "word").agg(F.count(F.lit(1)).alias("tf"))
    per_topic = tf.groupBy(topic_col).agg(F.sum("tf").alias("T"))
    per_word = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    avg_words = per_topic.select(F.avg("T")).scalar()
    return (tf.join(per_topic, topic_col).join(per_word, "word")
              .withColumn("weight", (F.col("tf") / F.col("T")) * F.log(avg_words / F.col("f"))))


def topic_keywords(labelled: DataFrame, text_col: str = "doc", topic_col: str = "topic",
                   top_n: int = TOPIC_TOP_N) -> DataFrame:
    """The ``top_n`` words of each topic by weight (ties: alphabetical), rank 0-based."""
    w = topic_word_weights(labelled, text_col, topic_col)
    # a limit on the row number lets Spark keep only the first rows of each task before the shuffle
    rk = Window.partitionBy(topic_col).orderBy(F.desc("weight"), "word")
    top = w.withColumn("_n", F.row_number().over(rk)).filter(F.col("_n") <= top_n)
    return top.select(topic_col, (F.col("_n") - 1).cast("long").alias("rank"), "word", "tf", "weight")


def topic_keywords_wide(keywords: DataFrame, topic_col: str = "topic", top_n: int = TOPIC_TOP_N) -> DataFrame:
    """One row per topic with ``Word{j}`` and ``Word{j}_probability`` columns."""
    p = keywords.groupBy(topic_col).pivot("rank", list(range(top_n))).agg(
        F.first("word").alias("w"), F.first("weight").alias("p"))
    cols = [F.col(topic_col).alias("Topic")]
    for j in range(top_n):
        cols += [F.col(f"{j}_w").alias(f"Word{j}"), F.col(f"{j}_p").alias(f"Word{j}_probability")]
    return p.select(*cols)
