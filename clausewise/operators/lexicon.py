"""Lexicon rules (P5, P9, F1) with the lexicon as a table of any size.

``lexicon_hit`` of :mod:`clausewise.operators.parse` is one alternation over all
words, which is right for a short list.  Here the distinct words of a clause probe
the table by an equi-join (Spark broadcasts a lexicon below its measured threshold
and shuffles a larger one), so the cost of a clause does not depend on how many
words the table has.  The entries are written first: the size of a file is known before
the join, so the words of the clauses are not shuffled for a lexicon that can be sent to
them.  Rows meet the keys found without their texts.  An entry of several words is probed by its first word and
then looked for as it stands; the few entries without any word character are an
alternation of at most ``SIGNS``.

A word is a run of word characters, as in the alternation, so both ways give the
same rows.  Null and empty entries are no words; a null clause has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.functions.text import WORD_CHAR, lexicon_regex
from clausewise.session import written

SIGNS = 1_000
_RUN = f"{WORD_CHAR}+"
_EDGE = WORD_CHAR.replace("[", "[^", 1)


def rows_with_word(df: DataFrame, lexicon: DataFrame, key: str = "clause_id", text_col: str = "clause", word_col: str = "word") -> DataFrame:
    """The distinct ``key`` of rows that hold an entry of the lexicon as whole words."""
    entries = lexicon.select(F.col(word_col).alias("entry")).filter(F.col("entry") != "").distinct()
    entries = written(entries.withColumn("first", F.regexp_extract("entry", _RUN, 0)))
    signs = [r["entry"] for r in entries.filter("first = ''").select("entry").limit(SIGNS + 1).collect()]
    if len(signs) > SIGNS:
        raise ValueError(f"more than {SIGNS} entries without a word character")
    rows = df.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0)))
    words = entries.filter("first = entry").select(F.col("entry").alias("run"))
    found = rows.select("key", F.explode(runs).alias("run")).join(words, "run", "left_semi").select("key")
    several = entries.filter("first <> entry AND first <> ''")
    any_several = not several.isEmpty()
    quoted = F.concat(F.lit(f"(^|{_EDGE})\\Q"), F.replace("entry", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E({_EDGE}|$)"))
    if any_several:
        candidates = rows.select("key", "text", F.explode(runs).alias("run")).join(several, F.col("run") == F.col("first"))
        found = found.unionByName(candidates.filter(F.regexp_like("text", quoted)).select("key"))
    if signs:
        found = found.unionByName(rows.filter(F.col("text").rlike(lexicon_regex(signs))).select("key"))
    return found.distinct().withColumnRenamed("key", key)


def classify_clauses_table(df: DataFrame, lexicon: DataFrame, threats: DataFrame | None = None, key: str = "clause_id", clause_col: str = "clause",
                           word_col: str = "word", out_col: str = "prediction") -> DataFrame:
    """P9 with tables: ``pos`` when a lexicon entry occurs, no threat entry does and the clause holds no double quote.

    ``key`` must be unique."""
    hit, threat, plain = (c + "_" * any(x.startswith(c) for x in df.columns) for c in ("_hit", "_threat", "_plain"))
    # looked at before the join: who needs no text behind it has none shuffled
    out = df.withColumn(plain, F.instr(clause_col, '"') == 0)
    out = out.join(rows_with_word(df, lexicon, key, clause_col, word_col).withColumn(hit, F.lit(True)), key, "left")
    rule = F.col(hit).isNotNull() & F.col(plain)
    if threats is not None:
        out = out.join(rows_with_word(df, threats, key, clause_col, word_col).withColumn(threat, F.lit(True)), key, "left")
        rule = rule & F.col(threat).isNull()
    out = out.withColumn(out_col, F.when(F.coalesce(rule, F.lit(False)), F.lit("pos")).otherwise(F.lit("neg")))
    return out.drop(hit, plain, *([threat] if threats is not None else []))
