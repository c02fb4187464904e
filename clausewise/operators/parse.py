"""Parse-table operators.

The dependency parser is an input, not part of the library.  Its contract is
a token table ``clause_id, i INT, text, lemma, dep, head INT`` (the root has
``head = i``).  Tokens of one clause are gathered into one row (a clause is a
small, bounded group) and all tree work is done inside that row with array
functions; the rest is joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.constants import AGGRESSIVE_VERBS, THREAT_VERBS
from clausewise.functions.text import bind, lexicon_regex


def lexicon_hit(clause: Column, lexicon: Sequence[str] = AGGRESSIVE_VERBS,
                threat_words: Sequence[str] = THREAT_VERBS) -> Column:
    """P9 (parse-free re-aim of the role rules): true when a lexicon word occurs
    as a whole word, the clause holds no double quote (R6) and no threatening
    verb (R5)."""
    hit = clause.rlike(lexicon_regex(lexicon))
    quoted = F.instr(clause, '"') > 0
    threat = clause.rlike(lexicon_regex(threat_words)) if threat_words else F.lit(False)
    return F.coalesce(hit & ~quoted & ~threat, F.lit(False))


def classify_clauses_lexicon(df, clause_col: str = "clause", lexicon: Sequence[str] = AGGRESSIVE_VERBS,
                             threat_words: Sequence[str] = THREAT_VERBS, out_col: str = "prediction"):
    """P9 as a DataFrame operator: adds ``prediction`` in {pos, neg}; a null clause is ``neg``."""
    hit = lexicon_hit(F.col(clause_col), lexicon, threat_words)
    return df.withColumn(out_col, F.when(hit, F.lit("pos")).otherwise(F.lit("neg")))


# ---------------------------------------------------------------- token table -> tree work
from pyspark.sql import DataFrame, Window  # noqa: E402

from clausewise.constants import (  # noqa: E402
    FRAME_RELATIONS, REFLEXIVE_OBJECTS, STAFF_WORDS)

TOKEN_FIELDS = ("i", "text", "lemma", "dep", "head")


def attach_tokens(clauses: DataFrame, make_annotator=None, schema: str | None = None,
                  tokens: DataFrame | None = None, key: str = "clause_id") -> DataFrame:
    """A token table for the clauses.

    Either equi-join an existing token table on ``key`` (an id, or the clause text
    itself, so that equal clauses share one parse; columns of the token table come
    first, those of the clauses it lacks after them; the tokens of a key, a bounded
    group, are joined as one row), or run a user-supplied
    annotator inside the executors with ``mapInPandas``: ``make_annotator`` is
    called once per task (it loads the model) and returns a function from a
    pandas batch of clauses to a pandas batch of token rows with ``schema``.
    """
    if make_annotator is not None:
        from clausewise.session import ship_package
        ship_package(clauses.sparkSession)

        def run(batches):
            annotate = make_annotator()
            for b in batches:
                yield annotate(b)
        return clauses.mapInPandas(run, schema=schema)
    if tokens is None:
        raise ValueError("give an annotator or a token table")
    fields, lacked = [c for c in tokens.columns if c != key], [c for c in clauses.columns if c not in tokens.columns and c != key]
    parses = tokens.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("_parse"))
    both = parses.join(clauses.select(key, *lacked), key)
    return both.select(key, *lacked, F.explode("_parse").alias("_t")).select(key, *[F.col(f"_t.`{c}`").alias(c) for c in fields], *lacked)


def token_arrays(tokens: DataFrame, key: str = "clause_id", carry: Sequence[str] = ()) -> DataFrame:
    """Tokens of a clause gathered into one row, sorted by ``i`` (a clause is a
    group bounded by one sentence).  ``carry`` columns are constant per clause
    and ride along as grouping keys.

    Token indices are positions ``0..n-1`` inside the clause, the root points to itself.
    """
    st = F.struct(F.col("i").cast("int").alias("i"), "text", "lemma", "dep", F.col("head").cast("int").alias("head"))
    return tokens.groupBy(key, *carry).agg(F.sort_array(F.collect_list(st)).alias("tokens"))


def _ancestor_history(toks: DataFrame) -> DataFrame:
    """Adds ``hist``: ``hist[s][t]`` is the ancestor of token t at distance s+1 (a root
    stays at itself).  All tokens walk up together, one level per step; once every
    pointer sits on a root the remaining steps are no-ops, so the cost is n x depth."""
    x = toks.withColumn("H", F.transform("tokens", lambda t: t["head"]))

    def parent(p):
        return F.element_at(F.col("H"), p + 1)

    init = F.struct(F.col("H").alias("ptr"), F.array(F.col("H")).alias("hist"),
                    F.forall("H", lambda p: parent(p) == p).alias("done"))

    def step(acc, _k):
        nxt = F.transform(acc["ptr"], parent)
        return F.when(acc["done"], acc).otherwise(F.struct(
            nxt.alias("ptr"), F.array_append(acc["hist"], nxt).alias("hist"),
            F.forall(nxt, lambda p: parent(p) == p).alias("done")))

    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("H"), F.lit(1))), init, step)
    return x.withColumn("hist", walk["hist"])


def _ancestors_of(t: Column) -> Column:
    return F.array_distinct(F.filter(F.transform("hist", lambda h: F.element_at(h, t + 1)), lambda a: a != t))


def token_ancestors(tokens: DataFrame, key: str = "clause_id", near: Sequence[str] = ()) -> DataFrame:
    """Every token with its ancestors, nearest first (``ancestors array<int>``).
    ``near``: columns that the key determines and by which the tokens already lie
    together (then they are not exchanged)."""
    h = _ancestor_history(token_arrays(tokens, key, near))
    per = F.transform("tokens", lambda t: F.struct(t["i"].alias("i"), _ancestors_of(t["i"]).alias("ancestors")))
    return h.select(key, F.inline(per))


def closure(tokens: DataFrame, key: str = "clause_id") -> DataFrame:
    """Transitive ancestor edges ``(key, i, a, d)``: ``a`` is an ancestor of ``i`` at distance ``d``."""
    anc = token_ancestors(tokens, key)
    return anc.select(key, "i", F.posexplode("ancestors").alias("d", "a")).withColumn("d", F.col("d") + 1)


def _descendant_runs() -> Column:
    """Descendants of every token that has any, worked out in the clause's row: its pairs
    (ancestor, token) are sorted, and each run of one ancestor is an element (none: null)."""
    edges = F.sort_array(F.flatten(F.transform("tokens", lambda t: F.transform(
        _ancestors_of(t["i"]), lambda a: F.struct(a.alias("a"), t["i"].alias("u"), F.coalesce(t["text"] == '"', F.lit(False)).alias("quote"))))))

    def runs(e: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.get(e, i)["a"] != F.get(e, i - 1)["a"]))
        return bind(starts, lambda s: F.transform(s, lambda at, k: F.slice(e, at + 1, F.coalesce(F.get(s, k + 1), F.size(e)) - at)))

    return bind(edges, lambda e: F.when(F.size(e) > 0, runs(e)))


def subtree(tokens: DataFrame, key: str = "clause_id", near: Sequence[str] = (),
            of_ids: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """All transitive children of every token that has any:
    ``(key, head, descendants array<int>, quoted boolean, n_descendants)``, and for each
    ``column: function`` of ``of_ids`` what it makes of the descendants in the clause's row,
    where the column ``tokens`` is at hand.  ``near``: see :func:`token_ancestors`.

    The lists hold one number for every token and ancestor, tokens x depth of a
    clause in all, and the work is as large as they are: small for sentences,
    the square of the tokens for a parse that is one chain."""
    rows = _ancestor_history(token_arrays(tokens, key, near))

    def row(run: Column) -> Column:
        below = F.transform(run, lambda x: x["u"])
        return F.struct(F.get(run, F.lit(0))["a"].alias("head"), below.alias("descendants"), F.exists(run, lambda x: x["quote"]).alias("quoted"),
                        F.size(run).cast("long").alias("n_descendants"), *[f(below).alias(c) for c, f in (of_ids or {}).items()])

    return rows.select(key, F.inline_outer(F.transform(_descendant_runs(), row))).filter(F.col("head").isNotNull())


def tokens_by_ids(tokens_col: Column, ids: Column) -> Column:
    """Texts of the given token ids, in the order of the id list."""
    return F.transform(ids, lambda i: F.element_at(tokens_col, i + 1)["text"])


def verb_frames(tokens: DataFrame, rels: Sequence[str] = FRAME_RELATIONS, key: str = "clause_id", near: Sequence[str] = ()) -> DataFrame:
    """One frame per head that has children in ``rels``: per relation the text of
    the last such child, the head's lemma, the lemma of the head's own head (itself
    for a root), and the head's descendants.

    The token table is read once: relation children (head lemmas looked up in the row)
    and the descendants, from the same row's ancestor arrays, are exploded together and
    grouped per head; nothing is joined and all is linear in the clause length.  ``near``:
    columns that the key determines and by which the tokens already lie together (then
    they are not exchanged); they stay in the result."""
    rows = _ancestor_history(token_arrays(tokens, key, near))

    def tok(i):
        return F.try_element_at(F.col("tokens"), (i + 1).cast("int"))

    def is_rel(t):
        return t["dep"].isin(*rels) & (t["head"] != t["i"])

    none = F.lit(None)
    # relation children with their head's lemma and the head's head's lemma (looked up in the row)
    kids = F.transform(F.filter("tokens", is_rel), lambda t: F.struct(
        t["head"].alias("head"), t["i"].alias("i"), t["text"].alias("text"), t["dep"].alias("dep"),
        tok(t["head"])["lemma"].alias("lemma"), tok(tok(t["head"])["head"])["lemma"].alias("head_lemma"),
        none.cast("array<int>").alias("descendants"), none.cast("boolean").alias("quoted")))
    below = F.transform(_descendant_runs(), lambda r: F.struct(
        F.get(r, F.lit(0))["a"].alias("head"), none.cast("int").alias("i"), none.cast("string").alias("text"), none.cast("string").alias("dep"),
        none.cast("string").alias("lemma"), none.cast("string").alias("head_lemma"),
        F.transform(r, lambda x: x["u"]).alias("descendants"), F.exists(r, lambda x: x["quote"]).alias("quoted")))
    # all in the generator: a projection below it would be worked out again for every token
    edges = rows.select(*near, key, F.inline_outer(F.concat(kids, F.coalesce(below, F.filter(kids, lambda _: F.lit(False)))))).filter(F.col("head").isNotNull())
    roles = [F.max_by(F.when(F.col("dep") == r, F.col("text")), F.when(F.col("dep") == r, F.col("i"))).alias(
        r.replace(":", "_")) for r in rels]
    frames = edges.groupBy(*near, key, "head").agg(
        *roles, *[F.first(c, ignorenulls=True).alias(c) for c in ("lemma", "head_lemma", "descendants", "quoted")],
        F.count("dep").alias("_kids")).filter("_kids > 0").drop("_kids")
    return (frames.withColumn("descendants", F.coalesce("descendants", F.array().cast("array<int>")))
                  .withColumn("quoted", F.coalesce("quoted", F.lit(False)))
                  .withColumn("n_descendants", F.size("descendants").cast("long")))


def apply_role_rules(frames: DataFrame, lexicon: Sequence[str] | DataFrame = AGGRESSIVE_VERBS,
                     staff: Sequence[str] = STAFF_WORDS, reflexive: Sequence[str] = REFLEXIVE_OBJECTS,
                     threats: Sequence[str] = THREAT_VERBS) -> DataFrame:
    """P5: ``passes`` iff the head lemma is in the lexicon and none of the excluding
    rules holds (as coded in the original, R3 and R4 included):

    R1 subject is staff; R2 object is reflexive; R3 passive subject is staff;
    R4 an agent is present and is not staff; R5 the verb's head has a threatening
    lemma; R6 a descendant token is a double quote.  The lexicon may be a table
    with a column ``word``.
    """
    from clausewise.operators.features import marked
    own = frames.columns
    frames, known = marked(frames, lexicon)
    def isin(c, words):
        return F.coalesce(F.col(c).isin(*words), F.lit(False))
    rules = {
        "r1": isin("nsubj", staff),
        "r2": isin("obj", reflexive),
        "r3": isin("nsubj_pass", staff),
        "r4": F.col("obl_agent").isNotNull() & ~isin("obl_agent", staff),
        "r5": isin("head_lemma", threats),
        "r6": F.col("quoted"),
    }
    excluded = rules["r1"] | rules["r2"] | rules["r3"] | rules["r4"] | rules["r5"] | rules["r6"]
    return frames.withColumn("passes", known & ~excluded).select(*own, "passes")


def classify_clauses_rules(clauses: DataFrame, judged: DataFrame, key: str = "clause_id", near: Sequence[str] = ()) -> DataFrame:
    """P6 + P7: clause ``pos`` iff any frame passes (null or frameless clause: ``neg``),
    with the union of head and descendant ids of the passing frames.  ``near``: columns of
    both that the key determines and by which their rows already lie together (then they
    meet in a window, without an exchange)."""
    ok = judged.filter("passes").select(*near, key, F.concat(F.array(F.col("head").cast("int")), "descendants").alias("ids"))
    per = ok.groupBy(*near, key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("aggressive_ids"))
    if near:
        both = clauses.withColumn("_own", F.lit(True)).unionByName(per, allowMissingColumns=True)
        found = F.first("aggressive_ids", ignorenulls=True).over(Window.partitionBy(*near, key))
        # a missing key is equal to nothing
        out = both.withColumn("aggressive_ids", F.when(F.col(key).isNotNull(), found)).filter("_own").drop("_own")
    else:
        out = clauses.join(per, key, "left")
    return (out.withColumn("prediction", F.when(F.col("aggressive_ids").isNotNull() & F.col("clause").isNotNull(),
                                                F.lit("pos")).otherwise(F.lit("neg")))
               .withColumn("aggressive_ids", F.coalesce("aggressive_ids", F.array().cast("array<int>"))))


def rule_job(clauses: DataFrame, tokens: DataFrame, lexicon: Sequence[str] | DataFrame = AGGRESSIVE_VERBS,
             staff: Sequence[str] = STAFF_WORDS, reflexive: Sequence[str] = REFLEXIVE_OBJECTS,
             threats: Sequence[str] = THREAT_VERBS, key: str = "clause_id", near: Sequence[str] = ()) -> DataFrame:
    """Clauses + tokens -> frames -> rules -> clause predictions (``near``: see :func:`classify_clauses_rules`)."""
    judged = apply_role_rules(verb_frames(tokens, key=key, near=near), lexicon, staff, reflexive, threats)
    return classify_clauses_rules(clauses, judged, key, near)


def clauses_from_parse(tokens: DataFrame, key: str = "clause_id", group: Sequence[str] = ("sentence_id",),
                       order: Sequence[str] = ("clause_no",), near: Sequence[str] = ()) -> DataFrame:
    """G3 + G5: split a parsed span into clauses: every child of a root with relation
    ``conj`` makes a clause of its subtree, the remaining tokens form the root clause;
    clauses are ordered by head index.  Numbers run per ``group`` across spans in
    ``order``; a clause that is empty after stripping is dropped but keeps its number.

    ``tokens`` carries ``key`` plus the ``group``/``order`` columns of its span.  ``near``:
    columns that the group determines and by which the tokens already lie together (then
    they are not exchanged).
    """
    near = [c for c in near if c not in (*group, *order)]
    h = _ancestor_history(token_arrays(tokens, key, carry=[*near, *group, *order]))
    idx = F.sequence(F.lit(0), F.size("tokens") - 1)

    def chead(t):
        path = F.concat(F.array(t), _ancestors_of(t))
        root = F.element_at(path, -1)
        top = F.when(F.size(path) >= 2, F.element_at(path, -2)).otherwise(t)
        return F.when((top != root) & (F.element_at(F.col("tokens"), top + 1)["dep"] == "conj"), top).otherwise(root)

    h = h.withColumn("ch", F.when(F.size("tokens") > 0, F.transform(idx, chead)).otherwise(F.array().cast("array<int>")))
    heads = F.array_sort(F.array_distinct("ch"))
    chunks = F.transform(heads, lambda hd: F.struct(hd.alias("clause_head"), F.trim(F.array_join(F.transform(
        F.filter(idx, lambda t: F.element_at(F.col("ch"), t + 1) == hd),
        lambda t: F.trim(F.element_at(F.col("tokens"), t + 1)["text"])), " ")).alias("text")))
    parts = h.select(key, *near, *group, *order, F.posexplode_outer(chunks).alias("sub_no", "c")).filter("c IS NOT NULL")
    w = Window.partitionBy(*near, *group).orderBy(*order, "sub_no")
    numbered = parts.withColumn("parse_clause_no", F.row_number().over(w).cast("long"))
    return numbered.filter(F.col("c.text") != "").select(
        *group, key, "parse_clause_no", F.col("c.clause_head").cast("long").alias("clause_head"),
        F.col("c.text").alias("clause"))
