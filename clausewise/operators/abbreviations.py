"""Sentence boundaries that know the corpus's abbreviations (G1, trained).

A word is an abbreviation when it stands before a stop far more often than words
do at large.  One aggregation counts every word with and without a stop after it;
the score is the log-likelihood ratio of "a stop nearly always follows" against the
corpus's own rate of stops, weighed down by the word's length and by every time it
stands without one, and up by stops inside it.  Words that end sentences often also
stand elsewhere, so they score low.

The table of abbreviations that a splitter uses is bounded (``MOST``, by score); its
words are part of the plan.  Without a table the splitter is the rule of G1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions.text import normalize_text, sentences

#: Chance that a stop follows an abbreviation, and the least score of one.
ALWAYS, LEAST = 0.99, 0.3
MOST = 5_000
BLANKS = "[ \t\n\r\f]+"


def abbreviation_statistics(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n_stop, n_plain, score`` of every word that a stop follows at least once.

    Words are lower-cased, of letters and inner stops; a null text has none."""
    tokens = reports.select(F.explode(F.split(F.lower(F.col(text_col)), BLANKS, -1)).alias("t"))
    stop = F.col("t").endswith(".")
    word = F.when(stop, F.expr("left(t, length(t) - 1)")).otherwise(F.regexp_replace("t", r"[,;:!?]+$", ""))
    words = tokens.select(word.alias("word"), stop.alias("stop")).filter(F.col("word").rlike(r"^\p{L}[\p{L}.]*$"))
    counts = words.groupBy("word").agg(F.count_if("stop").alias("n_stop"), F.count_if(~F.col("stop")).alias("n_plain"))
    rate = counts.select((F.sum("n_stop") / F.sum(F.col("n_stop") + F.col("n_plain"))).alias("r")).scalar()
    k, rest = F.col("n_stop"), F.col("n_plain")
    ratio = 2 * (k * F.log(F.lit(ALWAYS) / rate) + rest * F.log(F.lit(1 - ALWAYS) / F.greatest(1 - rate, F.lit(1e-12))))
    letters = F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    score = ratio * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -rest)
    return counts.filter("n_stop > 0").select("word", "n_stop", "n_plain", score.alias("score"))


def abbreviations(statistics: DataFrame, least: float = LEAST, most: int = MOST) -> list[str]:
    """The words that score ``least`` and more, ``most`` at most."""
    rows = statistics.filter(F.col("score") >= least).orderBy(F.desc("score"), "word").limit(most).collect()
    return [r["word"] for r in rows]


def trained_sentences(text: Column, known: list[str]) -> Column:
    """G1 of a text, but no sentence ends in one of the known abbreviations (pieces are joined by a blank)."""
    if not known:
        return sentences(text)
    words = F.array(*[F.lit(w) for w in known])

    def grow(out: Column, piece: Column) -> Column:
        last = F.element_at(out, -1)
        token = F.element_at(F.split(F.lower(last), BLANKS, -1), -1)
        goes_on = F.coalesce(token.endswith(".") & F.array_contains(words, F.regexp_replace(token, r"\.$", "")), F.lit(False))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, F.lit(" "), piece)))
        return F.when(F.size(out) == 0, F.array(piece)).when(goes_on, joined).otherwise(F.array_append(out, piece))

    return F.aggregate(sentences(text), F.array().cast("array<string>"), grow)


def split_sentences_trained(df: DataFrame, known: list[str], id_col: str = "doc_id", text_col: str = "text", normalize: bool = True,
                            report_col: str = "report_id") -> DataFrame:
    """One row per sentence as :func:`clausewise.operators.segment.split_sentences`, with known abbreviations."""
    text = normalize_text(F.col(text_col)) if normalize else F.col(text_col)
    return (df.select(F.col(id_col).alias(report_col), F.posexplode_outer(trained_sentences(text, known)).alias("pos", "sentence"))
              .filter(F.col("pos").isNotNull())
              .select(report_col, (F.col("pos") + 1).cast("long").alias("sent_no"), "sentence"))
