"""DuckDB SQL building blocks for the oracle side of the registered queries.

Each registered query has an equivalent plain-SQL form run by DuckDB on the
same parquet tables (pre-registered as views). These helpers keep the
fixture CTEs and the text expressions in one place so that both engines use
the same definitions.
"""

from __future__ import annotations

from paircraft.schema import (BAD_CHR_RE, HTML_RE, JACCARD_TOKEN_RE, MATH_RE, TOKEN_RE,
                              ascii_fold_tables, stop_words)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def R(expr: str) -> str:
    """Round a double to 6 decimals (matches the Spark side)."""
    x = f"CAST({expr} AS DOUBLE)"
    return f"(CASE WHEN abs({x}) < 1e12 THEN floor({x} * 1000000.0 + 0.5) / 1000000.0 ELSE {x} END)"


def str_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def num_list(xs) -> str:
    return "[" + ", ".join(repr(float(x)) for x in xs) + "]"


STOP = None


def stop_list() -> str:
    global STOP
    if STOP is None:
        STOP = str_list(stop_words())
    return STOP


def not_stop(var: str) -> str:
    return f"NOT list_contains({stop_list()}, {var})"


# ---------------------------------------------------------------- text
def ascii_fold(expr: str) -> str:
    src, dst, multi = ascii_fold_tables()
    t = f"translate(coalesce({expr}, ''), {lit(src)}, {lit(dst)})"
    if multi:
        chain = t
        for ch, rep in multi:
            chain = f"replace({chain}, {lit(ch)}, {lit(rep)})"
        cls = "[" + "".join(ch for ch, _ in multi) + "]"
        t = f"(CASE WHEN regexp_matches({t}, {lit(cls)}) THEN {chain} ELSE {t} END)"
    return f"lower(regexp_replace({t}, '[^\\x00-\\x7F]', '', 'g'))"


def clean_tokens(expr: str) -> str:
    t = ascii_fold(expr)
    t = f"regexp_replace({t}, {lit(MATH_RE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(HTML_RE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(BAD_CHR_RE)}, ' ', 'g')"
    toks = f"regexp_extract_all({t}, {lit(TOKEN_RE)})"
    return f"list_filter({toks}, lambda tk: {not_stop('tk')})"


def clean_nostem(expr: str) -> str:
    return f"array_to_string({clean_tokens(expr)}, ' ')"


def jaccard_set(expr: str) -> str:
    toks = f"regexp_extract_all(lower(coalesce({expr}, '')), {lit(JACCARD_TOKEN_RE)})"
    return f"list_distinct(list_filter({toks}, lambda tk: {not_stop('tk')}))"


def set_jaccard(a: str, b: str) -> str:
    return (f"(len(list_intersect({a}, {b}))::DOUBLE / "
            f"greatest(len(list_distinct(list_concat({a}, {b}))), 1))")


def set_containment(a: str, b: str) -> str:
    return (f"(CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END)")


def word_count(expr: str) -> str:
    return (f"CAST(len(list_filter(regexp_split_to_array(coalesce({expr}, ''), '\\s+'), "
            f"lambda w: w <> '')) AS BIGINT)")


def char_count(expr: str) -> str:
    return f"CAST(length({expr}) AS BIGINT)"


WORD_TOKEN = r"[\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}\p{Me}\p{Pc}]{2,}"


def word_tokens(expr: str) -> str:
    """The default vectorizer token rule: two or more word characters."""
    return f"regexp_extract_all(lower(coalesce({expr}, '')), {lit(WORD_TOKEN)})"


# ---------------------------------------------------------------- fixtures
DOC_PAIRS = """
_d AS (SELECT doc_id, text, lang, source FROM documents),
_qb AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS blk
        FROM documents WHERE text IS NOT NULL),
_cand AS (
  SELECT least(a, b) AS qid1, greatest(a, b) AS qid2
  FROM (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY blk ORDER BY doc_id) AS b FROM _qb)
  WHERE b IS NOT NULL
  UNION
  SELECT least(a, b) AS qid1, greatest(a, b) AS qid2
  FROM (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) AS b FROM _d)
  WHERE b IS NOT NULL),
doc_pairs AS (
  SELECT concat(c.qid1, '-', c.qid2) AS pair_id, c.qid1, c.qid2, d1.text AS question1,
         d2.text AS question2, CAST(d1.text = d2.text AS INTEGER) AS is_duplicate
  FROM _cand c JOIN _d d1 ON d1.doc_id = c.qid1 JOIN _d d2 ON d2.doc_id = c.qid2)
"""

DOC_PAIRS_NULL = DOC_PAIRS + """,
doc_pairs_null AS (
  SELECT p.pair_id, p.qid1, p.qid2, p.question1,
         CASE WHEN t.doc_id IS NOT NULL THEN NULL ELSE p.question2 END AS question2, p.is_duplicate
  FROM doc_pairs p LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = p.qid2)
"""

TURN_PAIRS = """
_c AS (SELECT conv_id, turn, role, text,
              lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS turn2 FROM conversations),
turn_pairs AS (
  SELECT concat(u.conv_id, '-', u.turn) AS pair_id, u.conv_id, u.turn AS turn1, u.turn2,
         u.text AS question1, a.text AS question2
  FROM _c u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn2
  WHERE u.role = 'user' AND a.role = 'assistant')
"""

VECTOR_PAIRS = """
vector_pairs AS (
  SELECT concat(a.vec_id, '-', b.vec_id) AS pair_id, a.vec_id AS qid1, b.vec_id AS qid2,
         a.embedding AS u, b.embedding AS v, CAST(a.label = b.label AS INTEGER) AS is_duplicate
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
"""

EVENT_SCORES = """
event_scores AS (
  SELECT event_id, least(floor(value) / 500.0, 1.0) AS p, CAST(event_type = 'purchase' AS INTEGER) AS y
  FROM events)
"""

RUNS = """
_types AS (SELECT list_sort(list_distinct(list(event_type))) AS types FROM events),
_g AS (SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) AS c_sum, count(*) AS n_events,
              min(CAST(round(value * 100) AS BIGINT)) AS c_min FROM events GROUP BY user_id),
runs AS (
  SELECT user_id AS run_id,
         array_to_string(list_filter(list_transform(range(0, len(types)),
             lambda i: CASE WHEN ((user_id % 31 + 1) >> i) % 2 = 1 THEN types[i + 1] END),
             lambda m: m IS NOT NULL), '+') AS model,
         CAST(CASE user_id % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 0.01 ELSE 0.05 END AS DOUBLE) AS lr,
         CAST(CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END AS INTEGER) AS epochs,
         CAST(c_sum AS DOUBLE) / 100.0 AS seconds, CAST(c_sum AS DOUBLE) / n_events / 50000.0 AS test_LL,
         1.0 - CAST(c_sum AS DOUBLE) / n_events / 50000.0 AS test_ACC, CAST(c_min AS DOUBLE) / 50000.0 AS test_F1, n_events
  FROM _g, _types)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes if c.strip())


EDA_BASE = """
_base AS (SELECT pair_id, qid1, qid2, question1, question2, is_duplicate FROM doc_pairs
          WHERE question1 IS NOT NULL AND question2 IS NOT NULL),
_freq AS (SELECT qid, count(*) AS freq FROM (SELECT qid1 AS qid FROM _base UNION ALL SELECT qid2 FROM _base)
          GROUP BY qid),
_sides AS (SELECT pair_id, 1 AS side, question1 AS t FROM _base UNION ALL SELECT pair_id, 2, question2 FROM _base),
_tk AS (SELECT pair_id, side, unnest(list_filter(WORDTOK, lambda tk: NOTSTOP)) AS term FROM _sides),
_etf AS (SELECT pair_id, side, term, count(*) AS tf FROM _tk GROUP BY pair_id, side, term),
_nq AS (SELECT count(*) AS n FROM _base),
_evoc AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM _etf, _nq WHERE side = 1 GROUP BY term),
_ew0 AS (SELECT pair_id, side, term, tf * idf AS w FROM _etf JOIN _evoc USING (term)),
_ew AS (SELECT pair_id, side, term, w / sqrt(sum(w * w) OVER (PARTITION BY pair_id, side)) AS w FROM _ew0),
_edot AS (SELECT a.pair_id, sum(a.w * b.w) AS dot FROM _ew a JOIN _ew b
          ON a.pair_id = b.pair_id AND a.term = b.term AND a.side = 1 AND b.side = 2 GROUP BY a.pair_id),
_eda AS (SELECT b.pair_id, b.qid1, b.qid2, b.question1, b.question2, b.is_duplicate,
                CHARQ1 AS q1_len, CHARQ2 AS q2_len, WORDQ1 AS q1_words, WORDQ2 AS q2_words,
                abs(CHARQ1 - CHARQ2) AS len_diff, JACC AS jaccard,
                coalesce(d.dot, 0.0) AS cosine,
                least(coalesce(f1.freq, 0), coalesce(f2.freq, 0)) AS min_freq
         FROM _base b LEFT JOIN _edot d USING (pair_id)
         LEFT JOIN _freq f1 ON f1.qid = b.qid1 LEFT JOIN _freq f2 ON f2.qid = b.qid2)
"""


def eda_base() -> str:
    return (EDA_BASE.replace("WORDTOK", word_tokens("t")).replace("NOTSTOP", not_stop("tk"))
            .replace("CHARQ1", char_count("b.question1")).replace("CHARQ2", char_count("b.question2"))
            .replace("WORDQ1", word_count("b.question1")).replace("WORDQ2", word_count("b.question2"))
            .replace("JACC", set_jaccard(jaccard_set("b.question1"), jaccard_set("b.question2"))))
