"""DuckDB SQL for the derived tables (the oracle side of every query).

Same recipes as :mod:`clausewise.plans.derived`, in DuckDB's dialect: it has
no lookbehind, so the sentence split uses a sentinel and N4 walks characters.
"""

from __future__ import annotations

from clausewise.constants import CAUSE_WORDS, REPLACEMENT_RULES, TEST_LEXICON, THREAT_VERBS, TOPIC_STOP_WORDS
from clausewise.functions.text import lexicon_regex


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm_sql(expr: str) -> str:
    """N1 -> N2 -> N3 -> N4 -> N5 in DuckDB."""
    out = f"lower(regexp_replace({expr}, '([A-Z])\\.', '\\1', 'g'))"
    for old, new in REPLACEMENT_RULES:
        out = f"replace({out}, {q(old)}, {q(new)})"
    # N4 over characters: a dot after a lone lowercase letter that does not follow a word character.
    n4 = ("array_to_string(list_transform(cs, lambda c, i: CASE WHEN c = '.' AND i > 1 "
          "AND cs[i-1] BETWEEN 'a' AND 'z' AND (i = 2 OR NOT regexp_full_match(cs[i-2], '[\\p{L}\\p{N}_]')) "
          "THEN '' ELSE c END), '')")
    return f"replace(list_transform([string_split({out}, '')], lambda cs: {n4})[1], chr(160), ' ')"


def lexicon_hit_sql(expr: str, lexicon=TEST_LEXICON, threats=THREAT_VERBS) -> str:
    return (f"coalesce(regexp_matches({expr}, {q(lexicon_regex(lexicon))}) AND strpos({expr}, '\"') = 0 "
            f"AND NOT regexp_matches({expr}, {q(lexicon_regex(threats))}), false)")


def remove_words_sql(expr: str, words=TOPIC_STOP_WORDS) -> str:
    lst = ", ".join(q(w) for w in words)
    return f"array_to_string(list_filter(string_split({expr}, ' '), lambda x: NOT list_contains([{lst}], x)), ' ')"


SENT_SPLIT = "string_split(regexp_replace({t}, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1))"
PARTS = "list_filter(list_transform(string_split({s}, ','), lambda x: trim(x)), lambda x: x <> '')"


def docs_cte(norm: bool = True) -> str:
    text = norm_sql("text") if norm else "text"
    return f"docs AS MATERIALIZED (SELECT doc_id AS report_id, {text} AS t FROM documents)"


SENTS_CTE = ("sents AS MATERIALIZED (SELECT report_id, s.sent_no::BIGINT AS sent_no, s.sentence FROM docs, "
             f"unnest({SENT_SPLIT.format(t='t')}) WITH ORDINALITY AS s(sentence, sent_no))")

CLAUSES_CTE = ("clauses AS MATERIALIZED (SELECT report_id, sent_no, p.clause_no::BIGINT AS clause_no, p.clause, "
               f"{lexicon_hit_sql('p.clause')} AS trigger, "
               "concat_ws('-', report_id, sent_no) AS sentence_id, "
               "concat_ws('-', report_id, sent_no, p.clause_no) AS clause_id "
               f"FROM sents, unnest({PARTS.format(s='sentence')}) WITH ORDINALITY AS p(clause, clause_no))")


def with_clauses(*more: str) -> str:
    """``WITH docs, sents, clauses[, more...]``."""
    return "WITH " + ",\n".join([docs_cte(), SENTS_CTE, CLAUSES_CTE, *more]) + "\n"


WORDS_CTE = ("words AS (SELECT report_id, sent_no, clause_no, clause_id, sentence_id, "
             "(w.i - 1)::BIGINT AS i, w.word FROM clauses, "
             "unnest(list_filter(string_split(clause, ' '), lambda x: x <> '')) WITH ORDINALITY AS w(word, i))")


DOCPRED_CTE = ("docpred AS (SELECT d.report_id, CASE WHEN coalesce(bool_or(c.trigger), false) THEN 'pos' ELSE 'neg' END "
               "AS prediction FROM docs d LEFT JOIN clauses c USING (report_id) GROUP BY d.report_id)")
GOLD_CTE = ("gold AS (SELECT doc_id AS report_id, CASE WHEN toxic = 1 THEN 'pos' WHEN toxic = 0 THEN 'neg' END "
            "AS aggression FROM labels)")
TEST_CTE = "testids AS (SELECT doc_id AS report_id FROM documents WHERE NOT (doc_id % 10 < 7))"
PAIRS_CTE = ("pairs AS (SELECT g.report_id, g.aggression AS gold, p.prediction AS pred FROM gold g "
             "JOIN docpred p USING (report_id) WHERE g.report_id IN (SELECT report_id FROM testids))")
CELLS_CTE = ("cells AS (SELECT count_if(gold='pos' AND pred='pos') AS tp, count_if(gold='pos' AND pred='neg') AS fn, "
             "count_if(gold='neg' AND pred='pos') AS fp, count_if(gold='neg' AND pred='neg') AS tn FROM pairs)")


def sdiv(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) END, 0.0)"


def macro_sql(cells: str = "cells") -> str:
    p_pos, r_pos = sdiv("tp", "tp + fp"), sdiv("tp", "tp + fn")
    p_neg, r_neg = sdiv("tn", "tn + fn"), sdiv("tn", "tn + fp")
    f_pos = sdiv(f"2 * {p_pos} * {r_pos}", f"{p_pos} + {r_pos}")
    f_neg = sdiv(f"2 * {p_neg} * {r_neg}", f"{p_neg} + {r_neg}")
    hp, hn = "(CASE WHEN tp + fn + fp > 0 THEN 1 ELSE 0 END)", "(CASE WHEN tn + fn + fp > 0 THEN 1 ELSE 0 END)"
    k = f"({hp} + {hn})"
    return (f"SELECT round({sdiv(f'{p_pos} * {hp} + {p_neg} * {hn}', k)}, 6) AS precision, "
            f"round({sdiv(f'{r_pos} * {hp} + {r_neg} * {hn}', k)}, 6) AS recall, "
            f"round({sdiv(f'{f_pos} * {hp} + {f_neg} * {hn}', k)}, 6) AS f1 FROM {cells}")



def sql_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


TOKENS_CTE = (
    "tokens AS MATERIALIZED (SELECT report_id, sent_no AS sent_id, t.token_id::BIGINT AS token_id, t.token, "
    f"CASE WHEN list_contains({sql_list(TEST_LEXICON)}, t.token) THEN 'pos' ELSE 'neg' END AS agressie, "
    f"CASE WHEN list_contains({sql_list(CAUSE_WORDS)}, t.token) THEN 'pos' ELSE 'neg' END AS aanleiding "
    "FROM sents, unnest(list_filter(string_split_regex(replace(sentence, ',', ' , '), '[ \t\n\r\f]+'), "
    "lambda x: x <> '')) WITH ORDINALITY AS t(token, token_id))")
ALIGN_CTES = [
    TOKENS_CTE,
    "tokpos AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY sent_id, token_id)::BIGINT AS pos "
    "FROM tokens WHERE token NOT IN (' ', ','))",
    "cw AS (SELECT *, len(list_filter(string_split(clause, ' '), lambda x: x <> ''))::BIGINT AS n_words FROM clauses)",
    "cspan AS (SELECT *, sum(n_words) OVER (PARTITION BY report_id ORDER BY sent_no, clause_no "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS span_end FROM cw)",
    "cpos AS (SELECT report_id, clause_id, unnest(range(span_end - n_words + 1, span_end + 1)) AS pos FROM cspan WHERE n_words > 0)",
    "aligned AS (SELECT c.report_id, c.clause_id, t.pos, t.sent_id, t.token_id, t.token, t.agressie, t.aanleiding "
    "FROM tokpos t JOIN cpos c ON t.report_id = c.report_id AND t.pos = c.pos)",
    "tagg AS (SELECT clause_id, bool_or(agressie = 'pos') AS a, bool_or(aanleiding = 'pos') AS c, count(*) AS n "
    "FROM aligned GROUP BY clause_id)",
    "annot AS MATERIALIZED (SELECT cw.report_id, cw.sent_no, cw.clause_no, cw.clause_id, cw.clause, cw.n_words, "
    "CASE WHEN coalesce(tagg.a, false) THEN 'pos' ELSE 'neg' END AS aggression, "
    "CASE WHEN coalesce(tagg.c, false) THEN 'pos' ELSE 'neg' END AS cause, coalesce(tagg.n, 0)::BIGINT AS n_tokens "
    "FROM cw LEFT JOIN tagg USING (clause_id))",
]


#: Coordinates of the vectors of the test tables.
WIDTH = 64


def vec_ctes(has_vector: str) -> list[str]:
    return [
        "cwords AS (SELECT report_id, sentence_id, clause_id, clause_no, (w.i - 1)::BIGINT AS i, w.word FROM clauses, "
        "unnest(string_split(clause, ' ')) WITH ORDINALITY AS w(word, i))",
        "nvec AS (SELECT count(*) AS n FROM embeddings)",
        "occ AS (SELECT cwords.*, ((length(word) * 31 + ascii(word) * 7 + clause_no) % (SELECT n FROM nvec))::BIGINT "
        f"AS vec_id FROM cwords WHERE {has_vector})",
        "wmap AS (SELECT sentence_id, word, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id, word "
        "ORDER BY clause_no DESC, i DESC) AS k FROM occ) WHERE k = 1)",
        "vecs AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
        "hits AS (SELECT c.clause_id, c.sentence_id, v.e FROM cwords c JOIN wmap m USING (sentence_id, word) "
        "JOIN vecs v USING (vec_id))",
        f"cmean AS (SELECT clause_id, [{', '.join(f'avg(e[{k}])' for k in range(1, WIDTH + 1))}] AS e FROM hits GROUP BY clause_id)",
        "cemb AS MATERIALIZED (SELECT clause_id, e, round(list_sum(e), 6) + 0.0 AS emb_sum, "
        "round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS emb_norm FROM cmean)",
        "cnt AS (SELECT clause_id, count(*)::BIGINT AS n_vec FROM hits GROUP BY clause_id)",
    ]


VEC_CTES = vec_ctes("word <> ''")
#: Only words that begin with a-z have a vector: for the queries about missing ones.
KNOWN_VEC_CTES = vec_ctes("regexp_matches(word, '^[a-z]')")

PIECE_CTES = [
    # a word that begins with ## has its first sign as first piece
    "pword AS (SELECT sentence_id, clause_id, clause_no, i, word, CASE WHEN starts_with(word, '##') THEN 5 ELSE 0 END AS short "
    "FROM cwords WHERE word <> '')",
    "pieces0 AS (SELECT sentence_id, clause_id, clause_no, i, p.j::BIGINT AS j, CASE WHEN p.j > 0 "
    "THEN '##' || substr(word, (p.j * 6 + 1 - short)::INTEGER, 6) ELSE substr(word, 1, (6 - short)::INTEGER) END AS piece "
    "FROM pword, unnest(range(0, (floor((length(word) + short + 5) / 6))::BIGINT)) AS p(j))",
    "pieces AS (SELECT *, ((length(piece) * 31 + ascii(piece) * 7) % (SELECT n FROM nvec))::BIGINT AS h0 FROM pieces0)",
    "pv AS (SELECT p.sentence_id, p.clause_id, p.clause_no, p.i, p.j, p.piece, "
    "list_transform(list_zip(v0.e, v1.e), lambda q: q[1] + q[2]) AS v FROM pieces p "
    "JOIN vecs v0 ON v0.vec_id = p.h0 JOIN vecs v1 ON v1.vec_id = (p.h0 + 1) % (SELECT n FROM nvec))",
]


def vsum_sql(e: str) -> str:
    return f"(round(list_sum({e}), 6) + 0.0)"


def vnorm_sql(e: str) -> str:
    return f"round(sqrt(list_sum(list_transform({e}, lambda x: x * x))), 6)"


#: Weight of piece ``i`` (0-based) of ``n``: halved at each level of pairwise averaging at which it has a partner.
_WEIGHT_SQL = ("power(0.5, len(list_filter(range(0, 16), lambda l: ((n + (1 << l) - 1) >> l) > 1 AND NOT "
               "((i >> l) = ((n + (1 << l) - 1) >> l) - 1 AND ((n + (1 << l) - 1) >> l) % 2 = 1))))")


def merged_cte(name: str, group: str, order: str) -> str:
    return (f"{name}0 AS (SELECT *, sum(CASE WHEN starts_with(piece, '##') THEN 0 ELSE 1 END) OVER "
            f"(PARTITION BY {group} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT "
            f"AS word_idx FROM pv), "
            f"{name}1 AS (SELECT *, (row_number() OVER (PARTITION BY {group}, word_idx ORDER BY {order}) - 1)::INTEGER AS pi, "
            f"count(*) OVER (PARTITION BY {group}, word_idx)::INTEGER AS pn FROM {name}0), "
            f"{name}2 AS (SELECT {group}, word_idx, pi, piece, CASE WHEN pn = 1 THEN v ELSE list_transform(v, lambda x: x * wt) END AS v "
            f"FROM (SELECT *, {_WEIGHT_SQL.replace('(n ', '(pn ').replace('(i ', '(pi ')} AS wt FROM {name}1)), "
            f"{name} AS (SELECT {group}, word_idx, string_agg(regexp_replace(piece, '^##', ''), '' ORDER BY pi) AS word, "
            f"list_reduce(list(v ORDER BY pi), lambda acc, x: list_transform(list_zip(acc, x), lambda q: q[1] + q[2])) AS v "
            f"FROM {name}2 GROUP BY {group}, word_idx)")


DEPS_SQL = "['nsubj', 'obj', 'conj', 'obl:agent', 'nsubj:pass', 'iobj', 'advmod', 'punct']"
PARSE_CTES = [
    "tok AS (SELECT report_id, sentence_id, clause_id, sent_no, clause_no, (w.i - 1)::INTEGER AS i, w.word AS text, "
    "regexp_replace(w.word, '[^\\p{L}]', '', 'g') AS lemma, "
    f"CASE WHEN w.i = 1 THEN 'ROOT' ELSE {DEPS_SQL}[((length(w.word) + w.i - 1) % 8) + 1] END AS dep, "
    "(CASE WHEN w.i = 1 THEN 0 ELSE (w.i - 2) // 2 END)::INTEGER AS head "
    "FROM clauses, unnest(list_filter(string_split(clause, ' '), lambda x: x <> '')) WITH ORDINALITY AS w(word, i))",
    "anc(clause_id, i, a, d) AS (SELECT clause_id, i, head, 1 FROM tok WHERE head <> i UNION ALL "
    "SELECT anc.clause_id, anc.i, t.head, anc.d + 1 FROM anc JOIN tok t ON t.clause_id = anc.clause_id AND t.i = anc.a "
    "WHERE t.head <> t.i)",
    "sub AS (SELECT anc.clause_id, anc.a AS head, string_agg(anc.i::VARCHAR, ',' ORDER BY anc.i) AS descendants, "
    "bool_or(t.text = '\"') AS quoted, count(*)::BIGINT AS n_descendants FROM anc JOIN tok t "
    "ON t.clause_id = anc.clause_id AND t.i = anc.i GROUP BY anc.clause_id, anc.a)",
]


def frames_cte(rels) -> str:
    roles = ", ".join(f"arg_max(text, i) FILTER (WHERE dep = {q(r)}) AS {r.replace(':', '_')}" for r in rels)
    inlist = ", ".join(q(r) for r in rels)
    return (f"fr0 AS (SELECT clause_id, head, {roles} FROM tok WHERE dep IN ({inlist}) AND head <> i "
            "GROUP BY clause_id, head), "
            "frames AS (SELECT f.*, h.lemma, hh.lemma AS head_lemma, coalesce(s.descendants, '') AS descendants, "
            "coalesce(s.quoted, false) AS quoted, coalesce(s.n_descendants, 0)::BIGINT AS n_descendants "
            "FROM fr0 f JOIN tok h ON h.clause_id = f.clause_id AND h.i = f.head "
            "LEFT JOIN tok hh ON hh.clause_id = f.clause_id AND hh.i = h.head "
            "LEFT JOIN sub s ON s.clause_id = f.clause_id AND s.head = f.head)")
