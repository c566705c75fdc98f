"""The SQL that the registered queries are held against."""

from __future__ import annotations

import re

from ..operators.evaluate import LEVELS
from . import registry as R
from .query import FULL, PLAIN, Analyzer, parse_query

LOWER_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"

TOK = f"""
tok AS (
  SELECT doc_id, i - 1 AS pos, w[i] AS term
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {LOWER_WORDS.format("text")} AS w FROM documents))
)"""
#: Consonants and vowels of a word.
KINDS = "regexp_replace(regexp_replace({}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g')"
for _ in range(4):
    KINDS = f"regexp_replace(regexp_replace({KINDS}, '(^|v)y', '\\1c', 'g'), 'cy', 'cv', 'g')"
INITIALS = r"""
ini1 AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS c FROM documents),
ini2 AS (SELECT doc_id, trim(array_to_string(list_filter(c, lambda x, i: NOT (x = '.' AND i > 1 AND regexp_matches(c[i - 1], '^[a-zA-Z]$') AND (i = 2 OR c[i - 2] IN (' ', '.')))), '')) AS s FROM ini1),
ini3 AS (SELECT doc_id, string_split(trim(regexp_replace(s, '(?i)^([a-z]) ([a-z])($| )', '\1\2 ')), ' ') AS t FROM ini2),
ini4 AS (SELECT doc_id, i, t[i] AS w, i > 1 AND regexp_matches(t[i], '^[a-zA-Z]$') AS single FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM ini3)),
ini5 AS (SELECT doc_id, i, w, single AND (i - max(CASE WHEN NOT single THEN i END) OVER (PARTITION BY doc_id ORDER BY i)) % 2 = 0 AS glued FROM ini4),
ini AS (SELECT doc_id, trim(substr(string_agg(CASE WHEN glued THEN w ELSE ' ' || w END, '' ORDER BY i), 2)) AS s FROM ini5 GROUP BY doc_id)"""
TOK_FULL = f"""{INITIALS},
raw AS (
  SELECT doc_id, i - 1 AS pos, w[i] AS word
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(lower(replace(replace(strip_accents(s), 'º', ' u186 '), 'ª', ' u170 ')), '[a-z0-9]+') AS w FROM ini))
),
st1 AS (SELECT DISTINCT word FROM raw),
st2 AS (SELECT word, CASE WHEN len(word) < 3 THEN word WHEN word LIKE '%sses' OR word LIKE '%ies' THEN word[:-3] WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN word[:-2] ELSE word END AS w FROM st1),
st3 AS (
  SELECT word, w, CASE WHEN len(word) < 3 THEN NULL WHEN w LIKE '%eed' THEN NULL
         WHEN w LIKE '%ed' AND contains({KINDS.format("left(w, len(w) - 2)")}, 'v') THEN left(w, len(w) - 2)
         WHEN w LIKE '%ing' AND contains({KINDS.format("left(w, len(w) - 3)")}, 'v') THEN left(w, len(w) - 3) END AS t
  FROM st2
),
st4 AS (SELECT *, {KINDS.format("t")} AS k FROM st3),
stems AS (
  SELECT word, CASE
    WHEN t IS NULL THEN CASE WHEN len(word) > 2 AND w LIKE '%eed' AND contains({KINDS.format("left(w, len(w) - 3)")}, 'vc') THEN left(w, len(w) - 1) ELSE w END
    WHEN t LIKE '%at' OR t LIKE '%bl' OR t LIKE '%iz' THEN t || 'e'
    WHEN len(t) > 1 AND right(t, 1) = substr(t, len(t) - 1, 1) AND k LIKE '%c' THEN CASE WHEN right(t, 1) IN ('l', 's', 'z') THEN t ELSE left(t, len(t) - 1) END
    WHEN regexp_matches(k, '^c*v+c$') AND k LIKE '%cvc' AND right(t, 1) NOT IN ('w', 'x', 'y') THEN t || 'e'
    ELSE t END AS term
  FROM st4
),
tok AS (SELECT doc_id, pos, term FROM raw JOIN stems USING (word))"""
TF = TOK + """,
tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY term, doc_id),
terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tf GROUP BY term),
n AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(ctf) FROM terms) AS n_tokens),
stops AS (SELECT term, ctf FROM terms ORDER BY ctf DESC, term LIMIT 70),
idf AS (SELECT term, 1 + ln(n_docs::DOUBLE / df) / ln(2.0) AS idf FROM terms, n),
stats AS (SELECT doc_id, sum(tf)::BIGINT AS size, sum((tf * idf) * (tf * idf)) AS norm2 FROM tf JOIN idf USING (term) GROUP BY doc_id)"""


TF_FULL = TF.replace(TOK, TOK_FULL)


def _values(rows: list[tuple], names: str) -> str:
    def literal(x) -> str:
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"


def _query_ctes(queries: list[tuple[int, str]], analyzer: Analyzer = PLAIN) -> str:
    terms, phrases = [], []
    for q, text in queries:
        parsed = parse_query(text, analyzer)
        flat = [t for p in parsed.phrases.values() for t in p]
        for t in dict.fromkeys(parsed.tokens + flat):
            terms.append((q, t, (parsed.tokens + flat).count(t), parsed.tokens.count(t)))
        phrases += [(q, k, i, t) for k, p in enumerate(parsed.phrases.values()) for i, t in enumerate(p)]
    return f"qt AS {_values(terms, 'query_id, term, qtf, token_tf')}, qp AS {_values(phrases, 'query_id, phrase_id, o, term')}"


MATCH = """
ph AS (
  SELECT query_id, phrase_id, doc_id, count(*) AS starts
  FROM (SELECT query_id, phrase_id, doc_id, pos - o AS s, count(*) AS c FROM tok JOIN qp USING (term) GROUP BY ALL)
  JOIN (SELECT query_id, phrase_id, count(*) AS len FROM qp GROUP BY ALL) USING (query_id, phrase_id)
  WHERE c = len GROUP BY ALL
),
ops AS (SELECT query_id, term FROM qt WHERE token_tf > 0 AND term NOT IN (SELECT term FROM stops)),
need AS (
  SELECT query_id, sum(c) AS need FROM (
    SELECT query_id, count(*) AS c FROM ops GROUP BY ALL
    UNION ALL SELECT query_id, count(DISTINCT phrase_id) FROM qp GROUP BY ALL) GROUP BY ALL
),
met AS (
  SELECT query_id, doc_id, sum(c) AS met FROM (
    SELECT query_id, doc_id, count(*) AS c FROM tf JOIN ops USING (term) GROUP BY ALL
    UNION ALL SELECT query_id, doc_id, count(*) FROM ph GROUP BY ALL) GROUP BY ALL
),
cand AS (SELECT query_id, doc_id FROM met JOIN need USING (query_id) WHERE met = need)"""
COSINE = """
q2 AS (SELECT query_id, sum((qtf * idf) * (qtf * idf)) AS q2 FROM qt JOIN idf USING (term) GROUP BY query_id),
dots AS (SELECT query_id, doc_id, sum(qtf * idf * tf * idf) AS dot FROM qt JOIN idf USING (term) JOIN tf USING (term) WHERE term NOT IN (SELECT term FROM stops) GROUP BY ALL),
cos AS (SELECT query_id, doc_id, coalesce(dot, 0) / sqrt(q2 * norm2) AS score FROM cand LEFT JOIN dots USING (query_id, doc_id) JOIN stats USING (doc_id) JOIN q2 USING (query_id))"""
LIKELY = """
ql AS (
  SELECT query_id, doc_id, coalesce(sum(token_tf * ln(0.5 * CASE WHEN term IN (SELECT term FROM stops) THEN 0 ELSE coalesce(tf, 0) END / size + 0.5 * ctf / n_tokens)), 0) AS score
  FROM cand LEFT JOIN (SELECT query_id, term, token_tf, ctf FROM qt JOIN terms USING (term) WHERE token_tf > 0) w USING (query_id)
  JOIN stats USING (doc_id) LEFT JOIN tf USING (term, doc_id), n GROUP BY ALL
)"""
GRAPH = """
clicks AS (SELECT event_id, ts, user_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type = 'click'),
edges AS (SELECT src, dst FROM (SELECT k AS src, lead(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM clicks) WHERE dst IS NOT NULL),
nodes AS (SELECT DISTINCT k AS node FROM clicks)"""
PAGERANK = """
parts AS (SELECT src, count(*) AS o FROM edges GROUP BY src),
shares AS (SELECT DISTINCT src, dst, o FROM edges JOIN parts USING (src)),
size AS (SELECT count(*) AS n FROM nodes),
r1 AS (SELECT node, 0.9 * coalesce((SELECT sum(1.0::DOUBLE / n / o) FROM shares, size WHERE dst = node), 0) + 0.1 / (SELECT n FROM size) AS r FROM nodes),
r2 AS (SELECT node, 0.9 * coalesce((SELECT sum(r / o) FROM shares JOIN r1 s ON s.node = src WHERE dst = nodes.node), 0) + 0.1 / (SELECT n FROM size) AS page_rank FROM nodes)"""
VIEWS = """
views AS (
  SELECT doc_id, coalesce(v, 0)::BIGINT AS views FROM documents
  LEFT JOIN (SELECT (props->>'$.k')::BIGINT AS doc_id, count(*) AS v FROM events WHERE event_type = 'view' GROUP BY ALL) USING (doc_id)
)"""
VALUES = "pr AS (SELECT node AS key, round(page_rank, 9) AS value FROM r2), nv AS (SELECT doc_id AS key, views AS value FROM views)"


def _top(scores: str, digits: int = 6, k: int = 10) -> str:
    return f"""SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM (SELECT query_id, doc_id, round(score, {digits}) AS score FROM {scores})) WHERE rank <= {k}"""


def _renamed(sql: str) -> str:
    """The same tables a second time, over the expanded queries."""
    return re.sub(r"\b(qt|qp|ph|ops|need|met|cand|q2|dots|cos)\b(?=[\s,.()]|$)", r"\1_2", sql).replace("qt_2", "qt2").replace("qp_2", "qp2").replace("cos_2", "cos2").replace("q2_2", "q22")


def _judged(final: str) -> str:
    return f"""WITH {TF}, {_query_ctes(R.QUERIES)}, {MATCH}, {COSINE}, run AS ({_top("cos")}),
g AS (SELECT doc_id, max(CASE WHEN quality <> 1 THEN 0 WHEN toxic = 1 THEN 1 ELSE 5 END)::DOUBLE AS gain FROM labels GROUP BY doc_id),
j AS (SELECT query_id AS query, rank, doc_id, coalesce(gain, 0) AS gain, (coalesce(gain, 0) > 1)::INT AS rel FROM run LEFT JOIN g USING (doc_id)),
e AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS hits, sum(rel) OVER (PARTITION BY query) AS all_hits FROM j),
m AS (SELECT *, hits / rank AS p, CASE WHEN all_hits > 0 THEN hits / all_hits ELSE 0 END AS r FROM e) {final}"""


def _at(k: int) -> tuple[str, str]:
    h = f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END)"
    return f"({h} / {k}.0)", f"(CASE WHEN sum(rel) > 0 THEN {h} / sum(rel) ELSE 0 END)"


def statements() -> dict[str, str]:
    batch = f"{TF}, {_query_ctes(R.QUERIES)}"
    signals = f"{GRAPH}, {PAGERANK}, {VIEWS}, sig AS (SELECT doc_id, coalesce(page_rank, 0) AS page_rank, views FROM views LEFT JOIN r2 ON node = doc_id)"
    matched = f"WITH {batch}, {MATCH}"
    positional = "SELECT term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS ps FROM tok GROUP BY term, doc_id"
    length = lambda v: f"CASE WHEN {v} < 128 THEN 1 WHEN {v} < 16384 THEN 2 WHEN {v} < 2097152 THEN 3 WHEN {v} < 268435456 THEN 4 ELSE 5 END"
    prf = f"""prf AS (
  SELECT query_id, term, c AS count, c / sum(c) OVER (PARTITION BY query_id) AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, term) AS r FROM (
      SELECT query_id, term, sum(tf)::BIGINT AS c FROM run JOIN tf USING (doc_id) WHERE term NOT IN (SELECT term FROM stops) GROUP BY ALL)) WHERE r <= 10
)"""
    cosine_run = f"{matched}, {COSINE}, run AS ({_top('cos')})"
    fixed = _values(R.FIXED_HTML, "url, html")
    whole = f"(SELECT url, html FROM {fixed} UNION ALL SELECT page_id::VARCHAR, html FROM pages)"
    histogram = lambda source, ladder: f"SELECT decade, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM {source}), 6) AS percent, (SELECT min(value) FROM {source}) AS least, (SELECT max(value) FROM {source}) AS most FROM (SELECT CASE {ladder} END AS decade FROM {source}) WHERE decade IS NOT NULL GROUP BY decade"
    tens = lambda k: f"1e{k}"
    pr_ladder = " ".join(f"WHEN value >= {tens(-k)} AND value <= {tens(1 - k)} THEN {-k}" for k in range(2, 7))
    nv_ladder = " ".join(f"WHEN value >= {0 if k == 0 else 10**k} AND value < {10 ** (k + 1)} THEN {k}" for k in range(6))
    ties = lambda source: f"SELECT key, value, rank() OVER (ORDER BY value DESC) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rank FROM {source}"
    discount = lambda gain, rank, k: f"sum(CASE WHEN {rank} <= {k} THEN {gain} / CASE WHEN {rank} = 1 THEN 1 ELSE ln({rank}) / ln(2.0) END ELSE 0 END)"
    ideal = ", ".join(f"CASE WHEN rank <= {k} THEN row_number() OVER (PARTITION BY query, rank <= {k} ORDER BY gain DESC, rank) END AS i{k}" for k in (1, 5, 10))
    ks = (1, 5, 10)
    f_one = lambda k: f"CASE WHEN {_at(k)[0]} = 0 OR {_at(k)[1]} = 0 THEN 0 ELSE 1 / (0.5 / {_at(k)[0]} + 0.5 / {_at(k)[1]}) END"
    interpolated = ", ".join(f"coalesce(max(CASE WHEN rel = 1 AND r >= {level} THEN p END), 0) AS ip_{i}" for i, level in enumerate(LEVELS))

    closure = """moved(url, target) AS (
  SELECT url, regexp_extract(html, 'http-equiv="refresh".*content=".*url=(.*)">', 1) FROM fixed WHERE html LIKE '%http-equiv="refresh"%'
), hop(url, target, n) AS (
  SELECT url, target, 1 FROM moved UNION ALL SELECT h.url, m.target, n + 1 FROM hop h JOIN moved m ON m.url = h.target WHERE n < 100
), closed AS (SELECT url, target FROM hop WHERE target NOT IN (SELECT url FROM moved))"""
    page_links = """l AS (
  SELECT url, unnest(regexp_extract_all(line, '<[a|A].*?href="([^ /#]*)".*?>', 1)) AS target
  FROM (SELECT url, unnest(string_split(html, chr(10))) AS line FROM fixed WHERE url NOT IN (SELECT url FROM moved))
)"""

    out = {
        "corpus_stats": f"WITH {TF} SELECT n_docs, (SELECT count(*) FROM terms) AS n_terms, n_tokens::BIGINT AS n_tokens FROM n",
        "term_stats": f"WITH {TF} SELECT * FROM terms",
        "postings_positional": f"WITH {TOK} SELECT term, doc_id, tf, array_to_string(ps, ',') AS positions FROM ({positional})",
        "postings_doconly": f"WITH {TOK} SELECT DISTINCT term, doc_id FROM tok",
        "forward_topk": f"WITH {TF} SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank, term, tf FROM tf) WHERE rank <= 5",
        "forward_no_stopwords": f"WITH {TF} SELECT doc_id, term, tf FROM tf WHERE term NOT IN (SELECT term FROM stops)",
        "stopwords_topn": f"WITH {TF} SELECT * FROM stops",
        "doc_norms": f"WITH {TF} SELECT doc_id, size, round(norm2, 4) AS norm2 FROM stats",
        "postings_delta_vbyte_size": f"""WITH {TOK}, p AS ({positional}),
c AS (SELECT term, doc_id, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM p),
g AS (SELECT pos - coalesce(lag(pos) OVER (PARTITION BY term, doc_id ORDER BY pos), 0) AS gap FROM tok)
SELECT (4 * count(*))::BIGINT AS doconly_bytes, (4 * sum(tf + 2))::BIGINT AS positional_bytes,
       (sum({length("gap")} + {length("tf")}) + (SELECT sum({length("gap")}) FROM g))::BIGINT AS compressed_bytes FROM c""",
        "match_and": f"{matched} SELECT query_id, doc_id FROM cand",
        "match_or": f"WITH {batch} SELECT DISTINCT query_id, doc_id FROM tf JOIN qt USING (term) WHERE term NOT IN (SELECT term FROM stops)",
        "match_phrase": f"{matched} SELECT query_id, phrase_id, doc_id, starts FROM ph",
        "match_phrase_doconly": f"""WITH {batch} SELECT query_id, phrase_id, doc_id FROM (SELECT query_id, phrase_id, doc_id, count(*) AS c FROM tf JOIN (SELECT DISTINCT query_id, phrase_id, term FROM qp) USING (term) GROUP BY ALL)
JOIN (SELECT query_id, phrase_id, count(DISTINCT term) AS len FROM qp GROUP BY ALL) USING (query_id, phrase_id) WHERE c = len""",
        "fullscan_title": f"""WITH {_query_ctes(R.TITLE_QUERIES).replace(", qp AS (SELECT * FROM (VALUES ) AS t(query_id, phrase_id, o, term))", "")},
t AS (SELECT doc_id, {LOWER_WORDS.format("string_split(text, chr(10))[1]")} AS w FROM documents)
SELECT query_id, doc_id, max(CASE WHEN list_contains(w, term) THEN 1.0::DOUBLE ELSE 0 END) AS score FROM t, qt GROUP BY ALL""",
        "rank_cosine": f"{matched}, {COSINE} {_top('cos')}",
        "rank_ql": f"{matched}, {LIKELY} {_top('ql')}",
        "rank_conjunctive": f"{matched} {_top('(SELECT query_id, doc_id, 1.0::DOUBLE AS score FROM cand)')}",
        "rank_linear": f"{matched}, {COSINE}, {LIKELY}, {signals}, lin AS (SELECT cos.query_id, doc_id, cos.score / 0.8 + ql.score / 9 + views / 20000.0 AS score FROM cos JOIN ql USING (query_id, doc_id) JOIN sig USING (doc_id)) {_top('lin')}",
        "rank_comprehensive": f"""{matched}, {COSINE}, {signals}, com AS (SELECT query_id, doc_id, 0.75 * score + 0.25 * (1e-6 * (page_rank - 1.0040161e-5) / (0.01712521 - 1.0040161e-5) + (1 - 1e-6) * views / 420930.0) AS score
FROM cos JOIN sig USING (doc_id)) {_top('com')}""",
        "rank_numviews": f"{matched}, {VIEWS} {_top('(SELECT query_id, doc_id, views::DOUBLE AS score FROM cand JOIN views USING (doc_id))')}",
        "rank_bigram": f"""WITH {TF}, b AS {_values(R.BIGRAMS, "query_id, first, second")}, s AS (
  SELECT query_id, x.doc_id, count(*)::DOUBLE AS score FROM b JOIN tok x ON x.term = first JOIN tok y ON y.term = second AND y.doc_id = x.doc_id AND y.pos = x.pos + 1 GROUP BY ALL
  UNION ALL SELECT query_id, doc_id, tf::DOUBLE FROM b JOIN tf ON term = first WHERE second IS NULL) {_top('s')}""",
        "prf_terms": f"{cosine_run}, {prf} SELECT query_id, term, count, round(p, 6) AS prob FROM prf",
        "query_bhattacharyya": f"""{cosine_run}, {prf}, d AS (SELECT query_id, term, round(p, 6) AS prob FROM prf), ids AS (SELECT DISTINCT query_id FROM d)
SELECT a.query_id AS query_a, b.query_id AS query_b, round(coalesce((SELECT sum(sqrt(x.prob * y.prob)) FROM d x JOIN d y USING (term) WHERE x.query_id = a.query_id AND y.query_id = b.query_id), 0), 4) AS similarity
FROM ids a, ids b WHERE a.query_id <> b.query_id""",
        "links_extracted": f"""WITH fixed AS {fixed}, raw AS (
  SELECT page_id::VARCHAR AS url, unnest(regexp_extract_all(line, '<[aA]\\b[^>]*?href="([^"]*)"', 1)) AS target FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages)
  UNION ALL SELECT url, unnest(regexp_extract_all(line, '<[a|A].*?href="([^ /#]*)".*?>', 1)) FROM (SELECT url, unnest(string_split(html, chr(10))) AS line FROM fixed)
) SELECT url, target, count(*) AS n FROM raw GROUP BY ALL""",
        "redirect_closure": f"WITH RECURSIVE fixed AS {whole}, {closure} SELECT url, target FROM closed",
        "pagerank_pages": f"""WITH RECURSIVE fixed AS {whole}, {closure}, {page_links},
nodes AS (SELECT url AS node FROM fixed WHERE url NOT IN (SELECT url FROM moved)),
edges AS (SELECT l.url AS src, coalesce(c.target, l.target) AS dst FROM l LEFT JOIN closed c ON c.url = l.target WHERE coalesce(c.target, l.target) IN (SELECT node FROM nodes)),
{PAGERANK} SELECT node, round(page_rank, 9) AS page_rank FROM r2""",
        "pagerank_2iter": f"WITH {GRAPH}, {PAGERANK} SELECT node, round(page_rank, 9) AS page_rank FROM r2",
        "num_views": f"WITH {VIEWS} SELECT doc_id::VARCHAR AS url, views FROM views",
        "click_counts": f"WITH {GRAPH} SELECT k AS doc_id, count(*) AS clicks, count(DISTINCT user_id) AS users FROM clicks GROUP BY k",
        "rank_avg_ties": f"WITH {VIEWS}, nv AS (SELECT doc_id AS key, views AS value FROM views) {ties('nv')}",
        "rank_tiebreak": f"WITH {VIEWS} SELECT doc_id AS key, views AS value, row_number() OVER (ORDER BY views DESC, doc_id) AS rank FROM views",
        "spearman": f"""WITH {GRAPH}, {PAGERANK}, {VIEWS}, {VALUES}, a AS (SELECT * FROM pr SEMI JOIN nv USING (key)), b AS (SELECT * FROM nv SEMI JOIN pr USING (key)),
x AS ({ties('a')}), y AS ({ties('b')}) SELECT round(corr(x.rank, y.rank), 6) AS rho, count(*) AS n FROM x JOIN y USING (key)""",
        "pagerank_histogram": f"WITH {GRAPH}, {PAGERANK}, {VIEWS}, {VALUES} {histogram('pr', pr_ladder)}",
        "numviews_histogram": f"WITH {GRAPH}, {PAGERANK}, {VIEWS}, {VALUES} {histogram('nv', nv_ladder)}",
        "query_log_consolidated": "SELECT rtrim(regexp_replace(p_name, '[^a-zA-Z0-9.]+', ' ', 'g')) AS query, count(*) AS cnt FROM part GROUP BY 1",
        "autocomplete_topk": f"""WITH c AS (SELECT p_name AS query, count(*) AS cnt FROM part WHERE p_name LIKE '{R.SUGGEST}%' GROUP BY 1)
SELECT row_number() OVER (ORDER BY cnt DESC) AS rank, substr(query, {len(R.SUGGEST) + 1}) AS suggestion, cnt FROM (SELECT cnt, min(query) AS query FROM c GROUP BY cnt ORDER BY cnt DESC LIMIT 5)""",
        "eval_precision": _judged("SELECT query, " + ", ".join(f"round({_at(k)[0]}, 6) AS p_{k}" for k in ks) + " FROM m GROUP BY query"),
        "eval_recall": _judged("SELECT query, " + ", ".join(f"round({_at(k)[1]}, 6) AS r_{k}" for k in ks) + " FROM m GROUP BY query"),
        "eval_f": _judged("SELECT query, " + ", ".join(f"round({f_one(k)}, 6) AS f_{k}" for k in ks) + " FROM m GROUP BY query"),
        "eval_interp11": _judged(f"SELECT query, {', '.join(f'round(ip_{i}, 6) AS ip_{i}' for i in range(11))} FROM (SELECT query, {interpolated} FROM m GROUP BY query)"),
        "eval_ap": _judged("SELECT query, round(coalesce(avg(CASE WHEN rel = 1 THEN p END), 0), 6) AS ap FROM m GROUP BY query"),
        "eval_rr": _judged("SELECT query, round(coalesce(1 / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS rr FROM m GROUP BY query"),
        "eval_ndcg": _judged(
            f", o AS (SELECT *, {ideal} FROM m) SELECT query, "
            + ", ".join(f"round(CASE WHEN {discount('gain', f'i{k}', k)} > 0 THEN {discount('gain', 'rank', k)} / {discount('gain', f'i{k}', k)} ELSE 0 END, 6) AS ndcg_{k}" for k in ks)
            + " FROM o GROUP BY query"
        ),
        "eval_map": _judged(
            f", ap AS (SELECT query, coalesce(avg(CASE WHEN rel = 1 THEN p END), 0) AS ap FROM m GROUP BY query), ip AS (SELECT query, {interpolated} FROM m GROUP BY query) "
            f"SELECT count(*) AS queries, round(avg(ap), 6) AS map, {', '.join(f'round(avg(ip_{i}), 6) AS ip_{i}' for i in range(11))} FROM ap JOIN ip USING (query)"
        ),
        "rank_favorite": f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (WITH {batch}, {MATCH}, {COSINE} {_top('cos', 10)})",
        "rank_batch": f"""WITH {batch}, {MATCH}, {VIEWS}, a AS ({_top('(SELECT query_id, doc_id, 1.0::DOUBLE AS score FROM cand)', 6, 5)}), b AS ({_top('(SELECT query_id, doc_id, views::DOUBLE AS score FROM cand JOIN views USING (doc_id))', 6, 5)})
SELECT 'conjunctive' AS ranker, * FROM a UNION ALL SELECT 'numviews', * FROM b""",
        "rank_combined": f"""{matched}, {COSINE}, {LIKELY}, {signals}, b AS {_values(R.BIGRAMS, "query_id, first, second")}, near AS (
  SELECT query_id, x.doc_id, count(*)::DOUBLE AS b FROM b JOIN tok x ON x.term = first JOIN tok y ON y.term = second AND y.doc_id = x.doc_id AND y.pos = x.pos + 1 GROUP BY ALL
  UNION ALL SELECT query_id, doc_id, tf::DOUBLE FROM b JOIN tf ON term = first WHERE second IS NULL),
lin AS (SELECT cos.query_id, cos.doc_id, cos.score / 0.8 + ql.score / 9 + views / 20000.0 + coalesce(b, 0) / 300 AS score FROM cos JOIN ql USING (query_id, doc_id) JOIN sig USING (doc_id) LEFT JOIN near USING (query_id, doc_id)) {_top('lin')}""",
        "rank_plain_cosine": f"""WITH {batch}, i AS (SELECT term, 1 + ln(floor(n_docs / df)) / ln(2.0) AS idf FROM terms, n), q2 AS (SELECT query_id, sum((qtf * idf) ^ 2) AS q2 FROM qt JOIN i USING (term) GROUP BY ALL),
nm AS (SELECT doc_id, sum((tf * idf) ^ 2) AS norm2 FROM tf JOIN i USING (term) GROUP BY ALL), dt AS (SELECT query_id, doc_id, sum(qtf * idf * tf * idf) AS dot FROM qt JOIN i USING (term) JOIN tf USING (term) GROUP BY ALL),
s AS (SELECT q.query_id, documents.doc_id, coalesce(dot / sqrt(q2 * norm2), 0) AS score FROM (SELECT DISTINCT query_id FROM qt) q, documents LEFT JOIN dt ON dt.query_id = q.query_id AND dt.doc_id = documents.doc_id LEFT JOIN q2 ON q2.query_id = q.query_id LEFT JOIN nm ON nm.doc_id = documents.doc_id) {_top('s')}""",
        "rank_plain_ql": f"""WITH {batch}, w AS (SELECT query_id, term, token_tf, ctf FROM qt JOIN terms USING (term) WHERE token_tf > 0),
s AS (SELECT q.query_id, documents.doc_id, coalesce(sum(token_tf * ln(0.5 * coalesce(tf, 0) / coalesce(size, 1) + 0.5 * ctf / n_tokens)), 0) AS score
  FROM (SELECT DISTINCT query_id FROM qt) q, documents LEFT JOIN w ON w.query_id = q.query_id LEFT JOIN tf ON tf.term = w.term AND tf.doc_id = documents.doc_id LEFT JOIN stats ON stats.doc_id = documents.doc_id, n GROUP BY ALL) {_top('s')}""",
        "rank_cosine_full": f"WITH {TF_FULL}, {_query_ctes(R.QUERIES, FULL)}, {MATCH}, {COSINE} {_top('cos')}",
        "match_phrase_full": f"WITH {TF_FULL}, {_query_ctes(R.QUERIES, FULL)}, {MATCH} SELECT query_id, phrase_id, doc_id, starts FROM ph",
        "analyze_full": f"WITH {TF_FULL} SELECT * FROM terms",
        "initials": f"WITH {INITIALS} SELECT doc_id, md5(s) AS text FROM ini",
        "prf_search": f"""{cosine_run.replace(_top('cos'), _top('cos', 10))}, {prf}, base AS {_values([(q, t) for q, t in R.QUERIES], "query_id, text")},
grown AS (SELECT query_id, list_reduce(list_prepend(replace(lower(text), '"', ' '), coalesce(more, [])), lambda t, x: CASE WHEN contains(t, x) THEN t ELSE t || ' ' || x END) AS text
  FROM base LEFT JOIN (SELECT query_id, list(term ORDER BY p DESC, term) AS more FROM prf WHERE p >= 0.05 GROUP BY ALL) USING (query_id)),
qt2 AS (SELECT query_id, term, count(*) AS qtf, count(*) AS token_tf FROM (SELECT query_id, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS term FROM grown) GROUP BY ALL), qp2 AS (SELECT * FROM qp WHERE false),
{_renamed(f"{MATCH}, {COSINE}")} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({_top('cos2', 10)})""",
        "eval_report": _judged(
            f", ap AS (SELECT query, round(coalesce(avg(CASE WHEN rel = 1 THEN p END), 0), 6) AS ap, round(coalesce(1 / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS rr, round({_at(5)[0]}, 6) AS p_5, round({_at(5)[1]}, 6) AS r_5, round({f_one(5)}, 6) AS f_5, round(ip_5, 6) AS ip_5 "
            f"FROM m JOIN (SELECT query, {interpolated} FROM m GROUP BY query) USING (query) GROUP BY query, ip_5), o AS (SELECT *, {ideal} FROM m), "
            f"g5 AS (SELECT query, round(CASE WHEN {discount('gain', 'i5', 5)} > 0 THEN {discount('gain', 'rank', 5)} / {discount('gain', 'i5', 5)} ELSE 0 END, 6) AS ndcg_5 FROM o GROUP BY query) "
            "SELECT query, p_5, r_5, f_5, ndcg_5, ip_5, ap, rr FROM ap JOIN g5 USING (query)"
        ),
        "eval_case_sensitive": "SELECT 1 AS query, doc_id, max(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 5 END)::DOUBLE AS gain FROM labels GROUP BY doc_id",
        "postings_roundtrip": f"WITH {TOK} SELECT term, doc_id, tf, array_to_string(ps, ',') AS positions FROM ({positional})",
        "merged_partials": f"WITH {TF} SELECT term, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id % 2, doc_id) AS items FROM tf GROUP BY term",
        "equal_keys": f"WITH {GRAPH}, {PAGERANK}, {VIEWS}, {VALUES} SELECT key, pr.value AS x, nv.value AS y FROM pr JOIN nv USING (key)",
        "page_titles": "SELECT page_id, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages",
        "short_urls": "SELECT page_id, CASE WHEN len(p) > 5 THEN array_to_string(p[1:3], '/') || '/.../' || array_to_string(p[-2:], '/') ELSE url END AS short, url_decode(replace(url, '+', ' ')) AS decoded FROM (SELECT *, string_split(url, '/') AS p FROM pages)",
        "known_pages": "SELECT DISTINCT url AS name FROM pages WHERE url LIKE '%/en/%'",
        "suggestions_by_query": f"""WITH c AS (SELECT p_name AS query, count(*) AS cnt FROM part WHERE p_name LIKE '{R.SUGGEST}%' GROUP BY 1)
SELECT row_number() OVER (ORDER BY cnt DESC, query) AS rank, substr(query, {len(R.SUGGEST) + 1}) AS suggestion, cnt FROM c ORDER BY cnt DESC, query LIMIT 50""",
    }
    return out
