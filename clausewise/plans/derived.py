"""Derived tables over the driver's parquet tables (the Spark side).

Each loader selects only the columns it needs, so the parquet scans carry a
pruned ``ReadSchema``.  The same recipes are written in DuckDB SQL in
:mod:`clausewise.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.constants import CAUSE_WORDS, TEST_LEXICON
from clausewise.functions.text import normalize_text, word_list
from clausewise.operators.segment import clause_array, explode_structs, with_ids
from clausewise.session import dealt, ship_package, spread

DEV_SHARE = 7   # dev/test split of reports: doc_id % 10 < 7 is dev, the rest is test


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str, heavy: bool | None = None) -> DataFrame:
    """Pruned scan.  Scans that carry long texts are spread over the default
    parallelism when they arrive in fewer partitions (see :func:`spread`)."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*cols) if cols else df
    if heavy is None:
        heavy = name in TEXT_TABLES and (not cols or "text" in cols)
    return spread(df) if heavy else df


def trigger_expr(clause: Column, lexicon=TEST_LEXICON) -> Column:
    """P9 on the test tables: lexicon word present, no quote, (no threat word)."""
    from clausewise.operators.parse import lexicon_hit
    return lexicon_hit(clause, lexicon)


def report_clause_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ``report_id``, ``clauses`` (array of struct), with trigger flags."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    arr = clause_array(normalize_text(F.col("text")))
    flagged = F.transform(arr, lambda c: c.withField("trigger", trigger_expr(c["clause"])))
    return docs.select(F.col("doc_id").alias("report_id"), flagged.alias("clauses"))


def clauses(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Clause table: report_id, sent_no, clause_no, clause, trigger, sentence_id, clause_id.
    ``together``: the rows of one report lie in one task (see :func:`dealt`)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", heavy=not together)
    docs = dealt(docs, "doc_id") if together else docs
    arr = docs.select(F.col("doc_id").alias("report_id"), clause_array(normalize_text(F.col("text"))).alias("clauses"))
    # the trigger as a column of its own, which is not worked out where nobody asks for it
    return with_ids(explode_structs(arr, "clauses", ["report_id"]).withColumn("trigger", trigger_expr(F.col("clause"))))


def is_dev(report: Column) -> Column:
    return (report % 10) < DEV_SHARE


def clause_words(clauses_df: DataFrame) -> DataFrame:
    """One row per clause word (split on single spaces, empties dropped), 0-based ``i``."""
    return clauses_df.select("report_id", "sent_no", "clause_no", "clause_id", "sentence_id",
                             F.posexplode_outer(word_list(F.col("clause"))).alias("i", "word")).filter("i IS NOT NULL")


def doc_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report-level prediction: pos when any clause triggers (no shuffle: the clauses are in the row)."""
    arr = report_clause_arrays(spark, sf_dir)
    hit = F.exists("clauses", lambda c: c["trigger"])
    return arr.select("report_id", F.when(hit, F.lit("pos")).otherwise(F.lit("neg")).alias("prediction"))


def doc_gold(spark: SparkSession, sf_dir: str, col: str = "toxic", out: str = "aggression") -> DataFrame:
    """Report-level gold labels from ``labels`` (1 -> pos, 0 -> neg)."""
    lab = table(spark, sf_dir, "labels", "doc_id", col)
    return lab.select(F.col("doc_id").alias("report_id"),
                      F.when(F.col(col) == 1, F.lit("pos")).when(F.col(col) == 0, F.lit("neg")).alias(out))


def test_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    return docs.filter(~is_dev(F.col("doc_id"))).select(F.col("doc_id").alias("report_id"))


def dev_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    return docs.filter(is_dev(F.col("doc_id"))).select(F.col("doc_id").alias("report_id"))


TOKEN_BREAK = "[ \t\n\r\f]+"


def report_tokens(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Token annotations (D7) of the test reports: every sentence split on whitespace
    with commas as tokens of their own; ``agressie`` = lexicon token, ``aanleiding`` =
    cause word.  ``together``: the rows of one report lie in one task (see :func:`dealt`)."""
    from clausewise.operators.segment import split_sentences
    docs = table(spark, sf_dir, "documents", "doc_id", "text", heavy=not together)
    sents = split_sentences(dealt(docs, "doc_id") if together else docs)
    toks = F.filter(F.split(F.replace(F.col("sentence"), F.lit(","), F.lit(" , ")), TOKEN_BREAK, -1),
                    lambda x: x != F.lit(""))
    lex = F.array(*[F.lit(w) for w in TEST_LEXICON])
    cause = F.array(*[F.lit(w) for w in CAUSE_WORDS])
    out = sents.select("report_id", F.col("sent_no").alias("sent_id"),
                       F.posexplode_outer(toks).alias("p", "token")).filter("p IS NOT NULL")
    return out.select(
        "report_id", "sent_id", (F.col("p") + 1).cast("long").alias("token_id"), "token",
        F.when(F.array_contains(lex, F.col("token")), F.lit("pos")).otherwise(F.lit("neg")).alias("agressie"),
        F.when(F.array_contains(cause, F.col("token")), F.lit("pos")).otherwise(F.lit("neg")).alias("aanleiding"))


def annotations(spark: SparkSession, sf_dir: str, strategy: str = "window") -> DataFrame:
    """Gold clause annotations (A2 -> A3 -> A4 over the token annotations).  For the windows by
    report the texts are dealt by report, once for clauses and tokens."""
    from clausewise.operators.annotate import project_annotations
    together = strategy == "window"
    return project_annotations(clauses(spark, sf_dir, together), report_tokens(spark, sf_dir, together), strategy=strategy)


# ---------------------------------------------------------------- vectors of the test tables
PIECE_LEN = 6


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding")


def n_vectors(spark: SparkSession, sf_dir: str) -> Column:
    """Row count of ``embeddings`` as a scalar subquery (evaluated once, inlined)."""
    return table(spark, sf_dir, "embeddings", "vec_id").select(F.count(F.lit(1))).scalar()


def vec_hash(text: Column, n: Column, extra: Column | None = None) -> Column:
    h = F.length(text).cast("long") * 31 + F.ascii(text).cast("long") * 7
    if extra is not None:
        h = h + extra
    return (h % n).cast("long")


def clause_word_rows(cl: DataFrame) -> DataFrame:
    """Every space-separated word of every clause (empty words kept, as in the original split)."""
    return cl.select("report_id", "sentence_id", "clause_id", "clause_no",
                     F.posexplode_outer(F.split(F.col("clause"), " ", -1)).alias("i", "word")).filter("i IS NOT NULL")


#: Words that the vocabulary of the out-of-vocabulary queries knows.
KNOWN_WORD = "^[a-z]"


def has_vector(word: Column, known_only: bool) -> Column:
    """Every word has a vector; for the queries about missing ones only those that begin with a-z."""
    return word.rlike(KNOWN_WORD) if known_only else word != ""


def word_occurrences(spark: SparkSession, sf_dir: str, cl: DataFrame | None = None, known_only: bool = False) -> DataFrame:
    """Words with a vector; the vector id depends on the word and its clause, so a
    repeated word in a sentence can carry different vectors."""
    cl = cl if cl is not None else clauses(spark, sf_dir)
    w = clause_word_rows(cl).filter(has_vector(F.col("word"), known_only))
    return w.withColumn("vec_id", vec_hash(F.col("word"), n_vectors(spark, sf_dir), F.col("clause_no")))


def piece_keys(spark: SparkSession, sf_dir: str, cl: DataFrame | None = None) -> DataFrame:
    """Word pieces of every non-empty word: 6-letter slices, later ones prefixed ``##``
    (a word that itself begins with ``##`` has its first sign as first piece, so that
    it is not taken for the rest of the word before it), with the key ``h0`` of their
    hidden layers."""
    occ = clause_word_rows(cl if cl is not None else clauses(spark, sf_dir)).filter("word <> ''")
    # letters that the first piece is short of a full one
    short = F.when(F.col("word").startswith("##"), F.lit(PIECE_LEN - 1)).otherwise(F.lit(0))
    k = F.floor((F.length("word") + short + PIECE_LEN - 1) / PIECE_LEN).cast("int")
    pieces = occ.select("report_id", "sentence_id", "clause_id", "clause_no", "i", F.posexplode(F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda j: F.when(j > 0, F.concat(F.lit("##"), F.substr(F.col("word"), j * PIECE_LEN + 1 - short, F.lit(PIECE_LEN))))
                   .otherwise(F.substr(F.col("word"), F.lit(1), PIECE_LEN - short)))).alias("j", "piece"))
    return pieces.withColumn("h0", vec_hash(F.col("piece"), n_vectors(spark, sf_dir)))


def stored_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hidden layers of every key ``h0``: two of them, the vectors h0 and h0 + 1."""
    v = vectors(spark, sf_dir)
    first = v.select(F.col("vec_id").alias("h0"), F.col("embedding").alias("l0"), ((F.col("vec_id") + 1) % n_vectors(spark, sf_dir)).alias("h1"))
    return first.join(v.select(F.col("vec_id").alias("h1"), F.col("embedding").alias("l1")), "h1").select("h0", F.array("l0", "l1").alias("layers"))


def word_pieces(spark: SparkSession, sf_dir: str, cl: DataFrame | None = None, index_by: list | None = None,
                order: list | None = None) -> DataFrame:
    """Word pieces (:func:`piece_keys`) with the key ``h0`` of their hidden layers.
    With ``index_by``/``order`` the word index is computed, on these narrow rows."""
    pieces = piece_keys(spark, sf_dir, cl)
    if index_by is not None:
        from clausewise.operators.embeddings import word_index
        pieces = word_index(pieces, index_by, order)
    return pieces


# ---------------------------------------------------------------- synthetic parse of the test clauses
DEPS = ["nsubj", "obj", "conj", "obl:agent", "nsubj:pass", "iobj", "advmod", "punct"]


def parse_tokens(spark: SparkSession, sf_dir: str, cl: DataFrame | None = None) -> DataFrame:
    """Deterministic token table (D8) for the clause words: a heap-ordered tree
    (``head = (i - 1) div 2``, root ``i = 0``), relations cycling by word length
    and position, lemma = the word's letters.  No parser is involved."""
    cl = cl if cl is not None else clauses(spark, sf_dir)
    w = cl.select("report_id", "sentence_id", "clause_id", "sent_no", "clause_no",
                  F.posexplode_outer(word_list(F.col("clause"))).alias("i", "text")).filter("i IS NOT NULL")
    deps = F.array(*[F.lit(d) for d in DEPS])
    return w.select(
        "report_id", "sentence_id", "clause_id", "sent_no", "clause_no", F.col("i").cast("int").alias("i"), "text",
        F.regexp_replace("text", r"[^\p{L}]", "").alias("lemma"),
        F.when(F.col("i") == 0, F.lit("ROOT")).otherwise(
            F.element_at(deps, ((F.length("text") + F.col("i")) % 8 + 1).cast("int"))).alias("dep"),
        F.when(F.col("i") == 0, F.lit(0)).otherwise(F.floor((F.col("i") - 1) / 2)).cast("int").alias("head"))
