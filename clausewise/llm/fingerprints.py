"""Document fingerprints by consistent weighted sampling (operator 10, DataFrame functions only).

A text is a weighted set: its terms are lower-cased words, weighted by how often
they occur.  Sample k draws, for every term, from hashes of the term and k alone,
``r`` and ``c`` from Gamma(2, 1) and ``beta`` from the uniform distribution; a
term of weight w is quantised to ``t = floor(ln w / r + beta)`` and scored
``ln a = ln c - r (t - beta + 1)``; the smallest score is the sample.  A score
depends only on (term, t, k), so two texts share a sample exactly when they
chose the same term at the same quantised weight, which happens with the
probability of their generalised Jaccard similarity (sum of the smaller weights
over sum of the larger).  A fingerprint is ``SAMPLES`` codes of 16 bits in hex;
the share of equal codes estimates the similarity with a standard error of at
most ``0.5 / sqrt(SAMPLES)``.

Terms are rows: one grouping counts them, one more takes the minimum of a block
of samples per document, both inside the partitioning that the documents
already have, on fixed-width keys and doubles (no lists, no Python).

:func:`neighbours` gives every document the one that follows it by id, without a
task that sees all ids: keys are indexed by a range partition and matched on the
index; only the part of the following text that is needed travels.

Defined cases: a null text is empty; an empty text has the fingerprint of zeros
and is fully like another empty one; documents that repeat id and text are one
document with as many result rows; documents that repeat an id follow each
other by row key; a null id sorts first; a lone document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import lower_ascii, row_key
from clausewise.operators.precursors import sequence_index
from clausewise.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SAMPLES = 32
#: Samples drawn per row between the two groupings: wide enough to share the row's cost, small enough to be compiled.
BLOCK = 8
_CODE = 4


def term_hashes(text: Column) -> Column:
    found = F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))
    return F.coalesce(F.transform(found, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _unit(h: Column, low: int, bits: int) -> Column:
    """``bits`` bits of ``h`` from ``low`` as a double inside (0, 1)."""
    part = F.shiftrightunsigned(h, low) if low else h
    if low + bits < 64:
        part = part.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return (part.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -bits)


def signatures(terms: DataFrame, keys: list[str], weights: list[str], term: str = "h", samples: int = SAMPLES) -> DataFrame:
    """``terms``: one row per ``keys`` and ``term`` (a hash) with one or more ``weights``.

    Adds for each weight column ``w`` the fingerprint ``fp_w`` of its weighted set, grouped by ``keys``."""
    if samples % BLOCK:
        raise ValueError(f"samples must be a multiple of {BLOCK}")
    logs = [f"_ln_{w}" for w in weights]
    x = terms.select(*keys, term, *[F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))).alias(ln) for w, ln in zip(weights, logs, strict=True)],
                     F.explode(F.sequence(F.lit(0), F.lit(samples // BLOCK - 1))).alias("_block"))
    draws = []
    for j in range(BLOCK):
        one = F.xxhash64(term, F.col("_block") * BLOCK + j)
        two = F.xxhash64(term, F.col("_block") * BLOCK + j, F.lit(1))
        draws += [(-F.log(_unit(one, 32, 32) * _unit(one, 0, 32))).alias(f"_r{j}"),
                  F.log(-F.log(_unit(two, 43, 21) * _unit(two, 22, 21))).alias(f"_c{j}"), _unit(two, 0, 22).alias(f"_b{j}")]
    x = x.select(*keys, "_block", *logs, *draws)
    scores = []
    for ln in logs:
        for j in range(BLOCK):
            r, c, b = F.col(f"_r{j}"), F.col(f"_c{j}"), F.col(f"_b{j}")
            scores.append(F.min(c - r * (F.floor(F.col(ln) / r + b).cast("double") - b + F.lit(1.0))).alias(f"{ln}_{j}"))
    blocks = x.groupBy(*keys, "_block").agg(*scores)

    def code(score: Column) -> Column:
        bits = F.xxhash64(score).bitwiseAND(F.lit(0xFFFF).cast("long"))
        return F.when(score.isNull(), "0" * _CODE).otherwise(F.lower(F.lpad(F.hex(bits), _CODE, "0")))

    parts = [F.concat(*[code(F.col(f"{ln}_{j}")) for j in range(BLOCK)]).alias(ln) for ln in logs]
    listed = blocks.select(*keys, "_block", *parts).groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.struct("_block", ln))).alias(ln) for ln in logs])
    return listed.select(*keys, *[F.array_join(F.col(f"{ln}.{ln}"), "").alias(f"fp_{w}") for w, ln in zip(weights, logs, strict=True)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal codes of two fingerprints."""
    at = F.sequence(F.lit(0), F.lit(samples - 1))
    equal = F.filter(at, lambda k: F.substr(a, k * _CODE + 1, F.lit(_CODE)) == F.substr(b, k * _CODE + 1, F.lit(_CODE)))
    return F.size(equal).cast("double") / F.lit(float(samples))


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Distinct documents ``doc`` (id, text) under two 64-bit keys, with how often each occurs (``copies``).

    Id and text are one column, and both uses look at ``copies``, so that the two plans
    are the same and the texts are shuffled once."""
    x = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    x = x.withColumns({"k1": row_key(F.col("id"), F.col("text")), "k2": F.xxhash64(F.lit(2), "text", "id")})
    return x.groupBy("k1", "k2").agg(F.first(F.struct("id", "text")).alias("doc"), F.count(F.lit(1)).alias("copies")).filter("copies > 0")


def neighbours(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """For each distinct document ``k1, k2`` the keys ``n1, n2`` of the next by id (the last is followed by the
    first) and its length ``chars``."""
    x = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = x.select("id", row_key(F.col("id"), F.col("text")).alias("k1"), F.xxhash64(F.lit(2), "text", "id").alias("k2"),
                    F.char_length("text").alias("chars")).groupBy("id", "k1", "k2").agg(F.first("chars").alias("chars"))
    at = sequence_index(keys, [], ["id", "k1", "k2"]).select("_g", "k1", "k2", "chars")
    last = at.agg(F.max("_g")).first()[0]
    after = at.select(F.when(F.col("_g") == 0, F.lit(last)).otherwise(F.col("_g") - 1).alias("_g"),
                      F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    return cut_lineage(at.join(after, "_g").select("k1", "k2", "n1", "n2", "chars"))


def with_next_part(docs: DataFrame, links: DataFrame, doc_id: str, text: str, part) -> DataFrame:
    """``docs`` as distinct documents (``k1, k2, id, text, copies``) with ``piece``: the first ``part(chars)``
    code points of the next document."""
    own = _documents(docs, doc_id, text)
    cut = links.select("k1", "k2", "n1", "n2", part(F.col("chars")).alias("need"))
    cut = cut.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "need")
    pieces = own.join(cut, ["k1", "k2"]).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"),
                                                F.substr("doc.text", F.lit(1), F.col("need")).alias("piece"))
    return own.join(pieces, ["k1", "k2"]).select("k1", "k2", "doc.id", "doc.text", "copies", "piece")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each document and of an edit of it, and how like they are.

    The edit replaces the last quarter of the code points by the first ones of the
    next document.  Columns: id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``."""
    links = neighbours(docs, doc_id, text)
    quarter = lambda chars: F.floor(chars / 4).cast("int")
    both = with_next_part(docs, links, doc_id, text, quarter)
    chars = F.char_length("text")
    edited = F.concat(F.substr("text", F.lit(1), chars - quarter(chars)), F.col("piece"))
    both = both.select("k1", "k2", "id", "copies", "text", edited.alias("edited"))
    facts = both.select("k1", "k2", "id", "copies", F.char_length("text").cast("long").alias("n_chars"),
                        F.sha2("edited", 256).alias("edited_sha256"))
    # the lowest bit of a term tells the text from the edit; a first row keeps texts without terms
    even, odd = F.lit(-2).cast("long"), F.lit(1).cast("long")
    marked = F.concat(F.transform(term_hashes(F.col("text")), lambda h: h.bitwiseAND(even)),
                      F.transform(term_hashes(F.col("edited")), lambda h: h.bitwiseOR(odd)))
    rows = both.select("k1", "k2", marked.alias("all")).select("k1", "k2", F.explode_outer("all").alias("v"))
    side = F.col("v").bitwiseAND(odd)
    terms = rows.select("k1", "k2", F.col("v").bitwiseAND(even).alias("h"), side.alias("side")).groupBy("k1", "k2", "h").agg(
        F.sum(1 - F.col("side")).alias("text"), F.sum("side").alias("edited"))
    made = signatures(terms, ["k1", "k2"], ["text", "edited"], "h", samples)
    # every fingerprint goes to its own document and to the one before it
    before = links.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    none = F.lit(None).cast("string")
    sent = made.join(before, ["k1", "k2"]).select(F.explode(F.array(
        F.struct("k1", "k2", F.col("fp_text").alias("own"), F.col("fp_edited").alias("edited"), none.alias("next")),
        F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"), none.alias("own"), none.alias("edited"), F.col("fp_text").alias("next")))).alias("s")).select("s.*")
    met = sent.groupBy("k1", "k2").agg(F.max("own").alias("fingerprint"), F.max("edited").alias("edited_fingerprint"), F.max("next").alias("next"))
    out = facts.join(met, ["k1", "k2"]).select(
        F.col("id").alias(doc_id), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next"), samples).alias("near_next"), "copies")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies")
