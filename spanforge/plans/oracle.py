"""DuckDB SQL for the registered queries: named common table expressions and a body each."""

from __future__ import annotations

from ..functions import text as T
from ..operators import discovery, lifecycle, smells
from . import model as M

WORD = r"[\p{L}\p{N}_]+"
K = {
    "regions": r"""regions AS (
  SELECT 'd' || doc_id AS doc_id, printf('P%02d', i) AS region_id, 'd' || doc_id || ':' || printf('P%02d', i) AS ref, i AS ordinal, line AS text, lang, source
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
  WHERE regexp_matches(line, '\S'))""",
    "tok": f"tok AS (SELECT ref, doc_id, source, ordinal, regexp_extract_all(lower(text), '{WORD}') AS t FROM regions)",
    "tf": "tf AS (SELECT ref, doc_id, source, len, token, count(*) AS tf FROM (SELECT ref, doc_id, source, len(t) AS len, unnest(t) AS token FROM tok) GROUP BY ALL)",
    "st": "st AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM tok)",
    "idf": "idf AS (SELECT token, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, st GROUP BY token)",
    "q": f"q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM benchmark)",
    "sc": """sc AS (
  SELECT query_id, ref, any_value(doc_id) AS doc_id, any_value(source) AS source, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(avg_len, 1e-6)))) AS score
  FROM q JOIN tf USING (token) JOIN idf USING (token), st GROUP BY query_id, ref)""",
    "ranked": "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ref) AS rank FROM sc)",
    "hits": "hits AS (SELECT query_id, rank, ref, score FROM ranked WHERE rank <= 10)",
    "gold": """gold AS (
  SELECT DISTINCT b.item_id AS query_id, r.ref FROM regions r
  JOIN (SELECT item_id, unnest(string_split(text, chr(10))) AS l FROM benchmark) b ON length(b.l) >= 20 AND contains(r.text, b.l))""",
    "ex": "ex AS (SELECT item_id AS query_id, CASE WHEN length(text) < 150 THEN 'short' ELSE 'long' END AS style FROM benchmark)",
    "g": "g AS (SELECT query_id, list_sort(list(ref)) AS gold_refs FROM gold GROUP BY query_id)",
    "pos": "pos AS (SELECT ref, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS pos FROM regions)",
    "old": "old AS (SELECT doc_id AS path, ref, ordinal, text FROM regions)",
    "new": """new AS (
  SELECT path, ordinal, text, path || ':' || printf('P%02d', ordinal) AS ref FROM (
    SELECT path, text, row_number() OVER (PARTITION BY path ORDER BY o) AS ordinal FROM (
      SELECT CASE WHEN k = 3 THEN 'moved_' || path ELSE path END AS path, ordinal AS o,
        CASE k WHEN 1 THEN text || ' revised wording' WHEN 2 THEN 'lead ' || text ELSE text END AS text
      FROM (SELECT *, (CAST(substr(path, 2) AS BIGINT) * 31 + ordinal) % 10 AS k FROM old) WHERE k <> 0)))""",
    "dtok": f"""dtok AS (
  SELECT ref, doc_id, ordinal, list_filter(list_transform(regexp_extract_all(text, '{discovery.TOKEN}'), lambda x: lower(x)),
    lambda x: length(x) > 3 AND NOT regexp_matches(x, '[0-9]') AND x NOT IN ({", ".join(f"'{w}'" for w in discovery.GENERIC)}) AND NOT regexp_matches(x, '^[a-z]+-[a-z]+-[a-z0-9-]+$')) AS t FROM regions)""",
}


def results(hits: str = "hits", name: str = "res") -> str:
    """E1 over a table of hits with the hit itself as context."""
    return f"""{name} AS (
  SELECT *, len(list_intersect(context, gold_refs)) AS common_refs FROM (
    SELECT e.query_id, e.style, coalesce(g.gold_refs, []) AS gold_refs, coalesce(p.context, []) AS context, p.first_hit, p.top_ref, p.top_score, p.second_score,
      CASE WHEN coalesce(len(g.gold_refs), 0) <= 1 THEN 'single' ELSE 'distributed' END AS mode,
      CAST(coalesce(len(p.context), 0) AS BIGINT) AS n_context, CAST(coalesce(len(g.gold_refs), 0) AS BIGINT) AS n_gold,
      coalesce(p.first_hit = 1, false) AS hit_at_1, p.first_hit IS NOT NULL AS hit_at_k, coalesce(1.0 / p.first_hit, 0.0) AS rr,
      round(p.top_score, 9) - round(p.second_score, 9) AS margin, round((round(p.top_score, 9) - round(p.second_score, 9)) / greatest(abs(round(p.top_score, 9)), 1e-9), 9) AS margin_ratio
    FROM ex e LEFT JOIN g USING (query_id) LEFT JOIN (
      SELECT h.query_id, list(h.ref ORDER BY h.rank) AS context, min(CASE WHEN list_contains(g.gold_refs, h.ref) THEN h.rank END) AS first_hit,
        max(CASE WHEN h.rank = 1 THEN h.ref END) AS top_ref, max(CASE WHEN h.rank = 1 THEN h.score END) AS top_score, max(CASE WHEN h.rank = 2 THEN h.score END) AS second_score
      FROM {hits} h LEFT JOIN g USING (query_id) WHERE h.rank <= 10 GROUP BY h.query_id) p USING (query_id)))"""


K["res"] = results()
COV = "CASE WHEN n_gold > 0 THEN common_refs / n_gold ELSE 0.0 END"
PRE = "CASE WHEN n_context > 0 THEN common_refs / n_context ELSE 0.0 END"
MEANS = f"""count(*) AS n, round(avg(hit_at_1::INT), 6) AS hit_at_1, round(avg(hit_at_k::INT), 6) AS hit_at_k, round(avg(rr), 6) AS mrr,
  round(avg({COV}), 6) AS coverage, round(avg({PRE}), 6) AS precision, round(avg(n_context), 6) AS avg_context"""
BM = ["regions", "tok", "tf", "st", "idf", "q", "sc", "ranked", "hits"]
EV = [*BM, "gold", "ex", "g", "res"]


def sql(ctes, body: str) -> str:
    return "WITH " + ",\n".join(K.get(c, c) for c in ctes) + "\n" + body


K["tree"] = """tree AS (
  SELECT query_id, rank, ref, score, doc_id, group_score FROM (
    SELECT s.*, group_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s.score, 9) DESC, s.ref) AS rank
    FROM sc s JOIN (SELECT query_id, unit AS doc_id, score AS group_score FROM gr WHERE rank <= {docs}) b USING (query_id, doc_id)) WHERE rank <= 10)"""


def group_ctes(unit: str, docs: int) -> list[str]:
    """BM25 over groups of regions (their tokens together), and regions inside the best groups."""
    return [
        f"gtf AS (SELECT {unit} AS unit, token, sum(tf) AS tf FROM tf GROUP BY ALL)",
        f"glen AS (SELECT {unit} AS unit, sum(len(t)) AS len FROM tok GROUP BY ALL)",
        "gst AS (SELECT count(*) AS n, avg(len) AS avg_len FROM glen)",
        "gidf AS (SELECT token, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM gtf, gst GROUP BY token)",
        """gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit) AS rank FROM (
  SELECT query_id, unit, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(avg_len, 1e-6)))) AS score
  FROM q JOIN gtf USING (token) JOIN gidf USING (token) JOIN glen USING (unit), gst GROUP BY query_id, unit))""",
        K["tree"].replace("{docs}", str(docs)).replace("doc_id", unit),
    ]


BIGRAMS = "CASE WHEN len({t}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])) END"
RERANK = [
    f"""cand AS (
  SELECT r.query_id, r.ref, r.score, max(r.score) OVER (PARTITION BY r.query_id) AS top, regexp_extract_all(lower(b.text), '{WORD}') AS qt, regexp_extract_all(lower(x.text), '{WORD}') AS rt,
    regexp_extract_all(lower(array_to_string(string_split(trim(regexp_replace(x.text, '\\s+', ' ', 'g')), ' ')[1:42], ' ')), '{WORD}') AS vt
  FROM ranked r JOIN benchmark b ON b.item_id = r.query_id JOIN regions x USING (ref) WHERE r.rank <= 30)""",
    f"""again AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ref) AS rank, ref, score FROM (
  SELECT query_id, ref, score / top + 0.18 * (len(list_intersect(qt, rt)) / greatest(len(list_distinct(qt)), 1)) + 0.12 * (len(list_intersect(qt, vt)) / greatest(len(list_distinct(qt)), 1))
    + 0.08 * (CASE WHEN len(qt) < 2 THEN 0.0 ELSE len(list_intersect({BIGRAMS.format(t="qt")}, {BIGRAMS.format(t="rt")})) / greatest(len({BIGRAMS.format(t="qt")}), 1) END) AS score
  FROM cand) QUALIFY rank <= 10)""",
]
STRAT = [*BM, *group_ctes("doc_id", 5), *RERANK]
TFIDF = [
    "w AS (SELECT token, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, st GROUP BY token)",
    "dn AS (SELECT ref, sqrt(sum(tf * idf * tf * idf)) AS dn FROM tf JOIN w USING (token) GROUP BY ref)",
    f"qv AS (SELECT query_id, token, count(*) * any_value(idf) AS qw FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM benchmark) JOIN w USING (token) GROUP BY ALL)",
    "qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qv GROUP BY query_id)",
    "cs AS (SELECT query_id, ref, sum(tf * idf * qw) / any_value(dn * qn) AS score FROM qv JOIN tf USING (token) JOIN w USING (token) JOIN dn USING (ref) JOIN qn USING (query_id) GROUP BY query_id, ref)",
    "cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ref) AS rank FROM cs)",
]


def fuse(parts: list[tuple[str, float]], places: int = 9) -> str:
    """RRF of ranked tables."""
    union = " UNION ALL ".join(f"SELECT query_id, ref, {w} / (60 + rank) AS s FROM {t}" for t, w in parts)
    return f"""SELECT query_id, rank, ref, round(score, {places}) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ref) AS rank FROM (SELECT query_id, ref, sum(s) AS score FROM ({union}) GROUP BY ALL)) WHERE rank <= 10"""


def _case(pairs: dict, x: str, other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE {other} END"


STEM = _case(
    T.ALIGN_ALIAS,
    "x",
    "CASE WHEN x LIKE '%ies' AND length(x) > 4 THEN x[:length(x)-3] || 'y' WHEN x LIKE '%ing' AND length(x) > 5 THEN x[:length(x)-3] "
    "WHEN x LIKE '%ed' AND length(x) > 4 THEN x[:length(x)-2] WHEN x LIKE '%s' AND length(x) > 4 THEN x[:length(x)-1] ELSE x END",
)


def align_terms(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.ALIGN_STOP)
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower({text}), '[A-Za-z0-9_]{{2,}}'), lambda x: {STEM}), lambda x: x NOT IN ({stop}))))"


def smell_terms(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.SMELL_STOP)
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({text}), '{WORD}'), lambda x: length(x) >= 4 AND x NOT IN ({stop}))))"


def cues(text: str, lexicon: dict) -> str:
    hits = [f"CASE WHEN {' OR '.join(f'contains(lower({text}), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{name}' END" for name, ws in sorted(lexicon.items())]
    return f"list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL)"


def opposed(a: str, b: str, pairs) -> str:
    lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return "(" + " OR ".join(f"(list_has_any({a}, {lst(x)}) AND list_has_any({b}, {lst(y)})) OR (list_has_any({a}, {lst(y)}) AND list_has_any({b}, {lst(x)}))" for x, y in pairs) + ")"


SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
WORDS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x))"
digest = lambda x: f"substr(sha256({x}), 1, 16)"
rhash = lambda x: digest(SQUEEZED.format(x))
quote = lambda x, n: f"array_to_string(({WORDS.format(x)})[1:{n}], ' ')"

S: dict[str, str] = {}

S["c_line_regions"] = sql(["regions"], f"""SELECT doc_id, ref, ordinal, ordinal AS start_line, ordinal AS end_line, {rhash("text")} AS hash,
  lag(ref) OVER w AS prev_ref, lead(ref) OVER w AS next_ref FROM regions WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)""")
S["c_ten_line_regions"] = rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
c AS (SELECT doc_id, ls, unnest(range(0, (len(ls) + 9) // 10)) AS i FROM l),
t AS (SELECT doc_id, i, len(ls) AS n, array_to_string(ls[i * 10 + 1 : i * 10 + 10], chr(10)) AS text FROM c)
SELECT 'd' || doc_id || ':' || printf('P%02d', i + 1) AS ref, i * 10 + 1 AS start_line, least(i * 10 + 10, n) AS end_line, {rhash("text")} AS hash FROM t WHERE regexp_matches(text, '\S')"""
S["c_min_terms"] = sql(["regions"], f"""SELECT ref, lag(ref) OVER w AS prev_ref, lead(ref) OVER w AS next_ref FROM regions WHERE len({align_terms("text")}) >= 8
WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)""")
S["c_word_windows"] = rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 120) / 60.0)) AS BIGINT) + 1)) AS i FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, i, w[i * 60 + 1 : i * 60 + 120] AS x FROM i)
SELECT 'd' || doc_id AS doc_id, printf('P%03d', i + 1) AS region_id, i * 60 AS start_word, len(x) AS n_words, {digest("array_to_string(" + WORDS.format("array_to_string(x, ' ')") + ", ' ')")} AS fingerprint FROM t"""
HEADED = "headed AS (SELECT doc_id, ref, ordinal, CASE WHEN (ordinal - 1) % 4 = 0 THEN 1 + ((ordinal - 1) // 4) % 3 ELSE 0 END AS level FROM regions)"
PARENT = "par AS (SELECT h.*, (SELECT max_by(p.ref, p.ordinal) FROM headed p WHERE p.doc_id = h.doc_id AND p.ordinal < h.ordinal AND p.level > 0 AND (h.level = 0 OR p.level < h.level)) AS parent_ref FROM headed h)"
S["c_heading_parents"] = sql(["regions", HEADED, PARENT], "SELECT ref, level, parent_ref FROM par")
S["c_sections"] = sql(["regions", HEADED, PARENT, "stops AS (SELECT h.*, (SELECT min(p.ordinal) FROM headed p WHERE p.doc_id = h.doc_id AND p.ordinal > h.ordinal AND p.level > 0 AND p.level <= h.level) AS stop FROM par h WHERE h.level > 0)"],
    """SELECT s.ref AS heading_ref, s.level, s.parent_ref, max_by(r.ref, r.ordinal) AS end_ref, count(*) AS n_refs
FROM stops s JOIN regions r ON r.doc_id = s.doc_id AND r.ordinal >= s.ordinal AND (s.stop IS NULL OR r.ordinal < s.stop) GROUP BY ALL""")
S["c_neighbour_units"] = sql(["regions"], "SELECT ref, array_to_string(list(ref) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ',') AS context_refs FROM regions")
S["c_coarse_ranges"] = sql(["regions", "tok", "r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1) // 5 AS range_no FROM tok)"],
    "SELECT doc_id, range_no, min_by(ref, ordinal) AS start_ref, max_by(ref, ordinal) AS end_ref, count(*) AS n_refs, CAST(sum(len(t)) AS BIGINT) AS tokens FROM r GROUP BY ALL")
S["c_target_shapes"] = sql(["regions", "x AS (SELECT doc_id, ref, lead(ref, 1) OVER w AS n1, lead(ref, 3) OVER w AS n3, row_number() OVER w - 1 AS pos FROM regions WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))"],
    """SELECT doc_id, 'single' AS shape, ref AS gold_refs FROM x UNION ALL SELECT doc_id, 'adjacent', ref || ',' || n1 FROM x WHERE n1 IS NOT NULL
UNION ALL SELECT doc_id, 'disjoint', ref || ',' || n3 FROM x WHERE n3 IS NOT NULL AND pos % 5 = 0""")
S["c_budget_prefix"] = sql(["regions", "tok"], """SELECT source, pos, ref, tokens, used FROM (
  SELECT source, ref, CAST(len(t) AS BIGINT) AS tokens, row_number() OVER w AS pos, CAST(sum(len(t)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
  FROM tok WINDOW w AS (PARTITION BY source ORDER BY ref)) WHERE used <= 5000 OR pos = 1""")
S["s_page_paragraphs"] = rf"""WITH b AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)(?:</p>|<p>|</article>|$)', 1) AS x FROM pages),
p AS (SELECT page_id, unnest(range(1, len(x) + 1)) AS ordinal, {SQUEEZED.format("regexp_replace(unnest(x), '<[^>]*>', ' ', 'g')")} AS text FROM b)
SELECT page_id, ordinal, {digest("text")} AS hash, length(text) AS n_chars FROM p WHERE text <> ''"""

S["t_token_stats"] = f"""SELECT lang, count(*) AS tokens, count(DISTINCT token) AS vocabulary, round(avg(length(token)), 6) AS mean_length
FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM documents) GROUP BY lang"""
KSTOP = ", ".join(f"'{w}'" for w in T.KEYWORD_STOP)
S["t_keywords"] = f"""WITH t AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents)),
c AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first FROM t WHERE length(token) > 2 AND token NOT IN ({KSTOP}) GROUP BY ALL)
SELECT doc_id, rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 12"""
S["t_local_view"] = sql(["regions"], f"""SELECT ref, {digest("array_to_string(string_split(" + SQUEEZED.format("text") + ", ' ')[1:42], ' ')")} AS summary_hash,
  greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS approx_tokens FROM regions""")
S["t_alignment_terms"] = sql(["regions", f"a AS (SELECT ref, {align_terms('text')} AS t FROM regions)"], "SELECT ref, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms FROM a")
S["t_cues"] = sql(["regions"], f"SELECT ref, array_to_string({cues('text', M.LEXICON)}, ',') AS cues FROM regions")
S["t_quote_selectors"] = sql(["regions"], f"SELECT quote, count(*) AS n FROM (SELECT {quote('text', 20)} AS quote FROM regions) WHERE quote <> '' GROUP BY quote")

CITE = ["regions", "cite AS (SELECT 'd' || doc_id AS key FROM documents)"]
S["r_citations"] = sql(CITE, """SELECT key, 0::BIGINT AS pos, key AS doc, 'P02' AS start_id, key AS end_doc, 'P04' AS end_id, true AS is_range, true AS ok FROM cite
UNION ALL SELECT key, 1, key, 'P01', key, 'P01', false, true FROM cite""")
S["r_expand_refs"] = sql(CITE, """SELECT DISTINCT r.doc_id AS key, r.ref FROM regions r
WHERE region_id = 'P01' OR (ordinal BETWEEN 2 AND 4 AND EXISTS (SELECT 1 FROM regions a WHERE a.doc_id = r.doc_id AND a.ordinal = 2) AND EXISTS (SELECT 1 FROM regions a WHERE a.doc_id = r.doc_id AND a.ordinal = 4))""")
S["r_validate_refs"] = sql([*CITE, "asked AS (SELECT key || ':P04' AS ref FROM cite UNION ALL SELECT key || ':P01' FROM cite UNION ALL (SELECT DISTINCT 'p' || user_id FROM events))",
    "bare AS (SELECT region_id, count(DISTINCT doc_id) AS docs, min(ref) AS single FROM regions GROUP BY region_id)",
    "norm AS (SELECT ref, CASE WHEN regexp_matches(ref, '^[A-Za-z]+\\d+$') THEN upper(regexp_extract(ref, '^([A-Za-z]+)', 1)) || printf('%02d', CAST(regexp_extract(ref, '(\\d+)$', 1) AS INT)) ELSE upper(ref) END AS id FROM asked)"],
    """SELECT n.ref, CASE WHEN r.ref IS NOT NULL THEN 'exact' WHEN docs = 1 THEN 'bare' WHEN docs > 1 THEN 'ambiguous' ELSE 'missing' END AS state,
  coalesce(r.ref, CASE WHEN docs = 1 THEN single END) AS resolved FROM norm n LEFT JOIN regions r ON r.ref = n.ref LEFT JOIN bare b ON b.region_id = n.id""")
CTX = [*BM, "pos", "ctx AS (SELECT DISTINCT h.query_id, x.ref FROM ranked h JOIN pos p USING (ref) JOIN pos x ON x.doc_id = p.doc_id AND x.pos BETWEEN p.pos - 1 AND p.pos + 1 WHERE h.rank <= 5)"]
S["r_context"] = sql(CTX, "SELECT query_id, ref FROM ctx")
S["r_context_pack"] = sql([*CTX, "pk AS (SELECT query_id, count(*) AS n_refs, string_agg('[' || ref || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id, ordinal) AS text FROM ctx JOIN regions USING (ref) GROUP BY query_id)"],
    rf"SELECT query_id, n_refs, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS token_estimate, {digest('text')} AS hash FROM pk")
SCORED = [*BM, "gold", "ex", "g",
    "pd AS (SELECT query_id, list(ref) AS predicted FROM ranked WHERE rank <= 3 GROUP BY query_id)",
    "b0 AS (SELECT e.query_id, e.style, coalesce(len(predicted), 0) AS p, coalesce(len(gold_refs), 0) AS g, coalesce(len(list_intersect(predicted, gold_refs)), 0) AS o FROM ex e LEFT JOIN pd USING (query_id) LEFT JOIN g USING (query_id))",
    "b1 AS (SELECT *, p = 0 AND g = 0 AS none, CASE WHEN p = 0 AND g = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE o / p END AS precision, CASE WHEN p = 0 AND g = 0 THEN 1.0 WHEN g = 0 THEN 0.0 ELSE o / g END AS recall FROM b0)",
    """b2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, CASE WHEN none THEN 1.0 ELSE o / (p + g - o) END AS jaccard,
  CASE WHEN none THEN 1.0 WHEN g = 0 THEN p::DOUBLE ELSE p / g END AS breadth, o = p AND o = g AS exact, o = g AS cover, p > o AS overcite, g > o AS undercite, o = 0 AND NOT none AS wrong FROM b1)""",
    "b3 AS (SELECT *, CASE WHEN wrong THEN 0.0 ELSE least(1.0, greatest(0.0, 0.55 * f1 + 0.35 * cover::INT + 0.2 * exact::INT - 0.15 * greatest(breadth - 1, 0.0) - 0.2 * undercite::INT)) END AS reward FROM b2)"]
S["r_score_sets"] = sql(SCORED, """SELECT query_id, style, o AS overlap, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(jaccard, 6) AS jaccard, round(breadth, 6) AS breadth,
  exact, cover, overcite, undercite, wrong, round(reward, 6) AS reward FROM b3""")
S["r_score_summary"] = sql(SCORED, "SELECT style, count(*) AS n, " + ", ".join(f"round(avg({c}{'::INT' if c in ('exact', 'cover', 'overcite', 'undercite', 'wrong') else ''}), 6) AS {c}" for c in ("precision", "recall", "f1", "jaccard", "breadth", "exact", "cover", "overcite", "undercite", "wrong", "reward")) + " FROM b3 GROUP BY style")

S["x_index_stats"] = sql(["regions", "tok", "tf", "st", "idf"], "SELECT token, df, round(idf, 6) AS idf FROM idf")
S["x_postings"] = sql(["regions", "tok", "tf", "st", "idf"], f"SELECT token, df, round(round(idf, 8), 6) AS idf, {digest('p')} AS hash FROM idf JOIN (SELECT token, string_agg(ref || ':' || tf, ',' ORDER BY ref || ':' || tf) AS p FROM tf GROUP BY token) USING (token)")
S["x_search"] = sql(BM, "SELECT query_id, rank, ref, round(score, 6) AS score FROM hits")
S["x_search_hierarchical"] = sql([*BM, *group_ctes("doc_id", 5)], "SELECT query_id, rank, ref, round(score, 6) AS score, doc_id, round(group_score, 6) AS group_score FROM tree")
S["x_area_router"] = sql([*BM, *group_ctes("source", 3)], "SELECT query_id, rank, ref, round(score, 6) AS score, source, round(group_score, 6) AS group_score FROM tree")
S["x_rerank"] = sql([*BM, *RERANK], "SELECT query_id, rank, ref, round(score, 6) AS score FROM again")
S["x_tfidf"] = sql([*BM[:4], *TFIDF], "SELECT query_id, rank, ref, round(score, 6) AS score FROM cr WHERE rank <= 10")
S["x_rrf"] = sql([*BM, *RERANK], fuse([("hits", 1.0), ("again", 0.5)]))
FIELD = [f"ftok AS (SELECT ref, regexp_extract_all(lower(array_to_string(string_split({SQUEEZED.format('text')}, ' ')[1:42], ' ')), '{WORD}') AS t FROM regions)",
    "ftf AS (SELECT ref, len, token, count(*) AS tf FROM (SELECT ref, len(t) AS len, unnest(t) AS token FROM ftok) GROUP BY ALL)", "fst AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM ftok)",
    "fidf AS (SELECT token, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM ftf, fst GROUP BY token)",
    """frank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ref) AS rank FROM (
  SELECT query_id, ref, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(avg_len, 1e-6)))) AS score FROM q JOIN ftf USING (token) JOIN fidf USING (token), fst GROUP BY query_id, ref))""",
    "l1 AS (SELECT * FROM ranked WHERE rank <= 50)", "l2 AS (SELECT * FROM frank WHERE rank <= 50)"]
S["x_fielded_rrf"] = sql([*BM, *FIELD], fuse([("l1", 1.0), ("l2", 0.6)]))
S["x_hybrid"] = sql([*BM, *TFIDF, "a AS (SELECT query_id, ref, score / max(score) OVER (PARTITION BY query_id) AS a FROM ranked WHERE rank <= 50)",
    "b AS (SELECT query_id, ref, CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 0.0 END AS b FROM cr WHERE rank <= 50 WINDOW p AS (PARTITION BY query_id))",
    "f AS (SELECT query_id, ref, 0.7 * coalesce(a, 0.0) + (1 - 0.7) * coalesce(b, 0.0) AS score FROM a FULL OUTER JOIN b USING (query_id, ref))"],
    "SELECT query_id, rank, ref, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ref) AS rank FROM f) WHERE rank <= 10")
S["x_weight_grid"] = sql([*STRAT, "gold", "grid AS (SELECT a.w AS wa, b.w AS wb FROM (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS w) a, (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS w) b)",
    "rk AS (SELECT query_id, ref, h.rank AS ra, t.rank AS rb FROM hits h FULL OUTER JOIN tree t USING (query_id, ref))",
    "fz AS (SELECT *, row_number() OVER (PARTITION BY wa, wb, query_id ORDER BY round(score, 9) DESC, ref) AS rank FROM (SELECT wa, wb, query_id, ref, coalesce(wa / (60 + ra), 0.0) + coalesce(wb / (60 + rb), 0.0) AS score FROM rk, grid))",
    "fi AS (SELECT wa, wb, query_id, min(rank) AS first FROM fz JOIN gold USING (query_id, ref) WHERE rank <= 10 GROUP BY ALL)", "nn AS (SELECT count(DISTINCT query_id) AS n FROM gold)"],
    "SELECT wa, wb, round(count(*) / any_value(n), 6) AS hit_at_10, round(sum(1.0 / first) / any_value(n), 6) AS mrr FROM fi, nn GROUP BY wa, wb")
S["x_gated"] = sql([*BM, *RERANK, "t AS (SELECT unnest([1.2, 1.35])::DOUBLE AS threshold)", "best AS (SELECT query_id, max(score) AS best FROM again GROUP BY query_id)"],
    """SELECT threshold, query_id, rank, ref FROM hits LEFT JOIN best USING (query_id), t WHERE coalesce(best, 0) < threshold
UNION ALL SELECT threshold, query_id, rank, ref FROM again JOIN best USING (query_id), t WHERE best >= threshold""")
VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
S["x_dense_top_k"] = sql([VEC, "s AS (SELECT a.vec_id AS query_id, b.vec_id AS unit, list_cosine_similarity(a.v, b.v) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id)"],
    "SELECT query_id, rank, unit, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit) AS rank FROM s) WHERE rank <= 5")
LONG = "lng AS (SELECT label, vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v)"
S["x_centroids"] = sql([VEC, LONG, "c AS (SELECT label AS predicted, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM lng GROUP BY ALL) GROUP BY label)",
    "s AS (SELECT vec_id, label, predicted, list_cosine_similarity(v, c) AS score FROM v, c)"],
    "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(predicted AS BIGINT) AS predicted, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, predicted) = 1")
S["x_top_variance"] = sql([VEC, LONG, "a AS (SELECT i AS dim, var_pop(x) AS variance, max(abs(x)) / 127 AS scale FROM lng GROUP BY i)"],
    "SELECT dim, rank, round(variance, 9) AS variance, round(scale, 9) AS scale FROM (SELECT *, row_number() OVER (ORDER BY round(variance, 9) DESC, dim) AS rank FROM a) WHERE rank <= 16")
S["x_signatures"] = f"""WITH t AS (SELECT lang AS unit, list_filter(regexp_extract_all(lower(text), '{WORD}'), lambda x: length(x) > 2 AND x NOT IN ({KSTOP})) AS t FROM documents),
p AS (SELECT unit, unnest(t) AS phrase, 1 AS words FROM t UNION ALL SELECT unit, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), 2 FROM t),
c AS (SELECT unit, phrase, words, count(*) AS count FROM p GROUP BY ALL), f AS (SELECT phrase, count(*) AS df FROM c GROUP BY phrase), n AS (SELECT count(DISTINCT lang) AS a FROM documents),
s AS (SELECT unit, phrase, count, df, count * ln((a + 1) / (df + 0.5)) * (1 + 0.12 * (words - 1)) AS score FROM c JOIN f USING (phrase), n)
SELECT unit, rank, phrase, count, df, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(score, 9) DESC, phrase) AS rank FROM s) WHERE rank <= 10"""
S["x_expansion_terms"] = f"""WITH t AS (SELECT unit, token, count(*) AS tf FROM (SELECT doc_id AS unit, unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM documents) GROUP BY ALL),
n AS (SELECT count(*) AS a FROM documents), f AS (SELECT token, count(*) AS df FROM t GROUP BY token),
s AS (SELECT unit, token, tf, df, tf * a / df AS score FROM t JOIN f USING (token), n WHERE df / a <= 0.12)
SELECT unit, rank, token, tf, df, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(score, 9) DESC, token) AS rank FROM s) WHERE rank <= 8"""

S["e_results"] = sql(EV, f"""SELECT query_id, style, array_to_string(gold_refs, ',') AS gold_refs, array_to_string(context, ',') AS context, first_hit, top_ref, hit_at_1, hit_at_k, round(rr, 6) AS rr,
  round({COV}, 6) AS coverage, round({PRE}, 6) AS precision, n_context, n_gold, round(margin, 6) AS margin, round(margin_ratio, 6) AS margin_ratio, mode FROM res""")
S["e_summary"] = sql(EV, f"SELECT {MEANS} FROM res")
S["e_by_style_and_mode"] = sql(EV, f"SELECT style, mode, {MEANS} FROM res GROUP BY GROUPING SETS ((style), (mode))")
S["e_style_gap"] = sql([*EV, "m AS (SELECT style, avg(hit_at_1::INT) AS hit_at_1, avg(hit_at_k::INT) AS hit_at_k, avg(rr) AS mrr FROM res GROUP BY style)", "u AS (UNPIVOT m ON hit_at_1, hit_at_k, mrr INTO NAME metric VALUE v)"],
    "SELECT metric, round(max(v) - min(v), 6) AS gap, (min({'v': v, 'style': style})).style AS weakest FROM u GROUP BY metric")
HEAT = "heat AS (SELECT ref, count(*) AS n, count(*) FILTER (NOT hit_at_1) AS miss_at_1, count(*) FILTER (NOT hit_at_k) AS miss_at_k FROM (SELECT unnest(gold_refs) AS ref, hit_at_1, hit_at_k FROM res) GROUP BY ref)"
CONF = "conf AS (SELECT gold_refs[1] AS gold_ref, top_ref, count(*) AS n FROM res WHERE len(gold_refs) > 0 AND top_ref IS NOT NULL AND NOT list_contains(gold_refs, top_ref) GROUP BY ALL)"
S["e_heatmap"] = sql([*EV, HEAT], "SELECT * FROM heat")
S["e_confusions"] = sql([*EV, CONF], "SELECT * FROM conf")
S["e_jump_curve"] = sql([*EV, "rk AS (SELECT margin_ratio AS x, row_number() OVER (ORDER BY margin_ratio) - 1 AS i, count(*) OVER () AS n FROM res WHERE margin_ratio IS NOT NULL AND top_ref IS NOT NULL)",
    "th AS (SELECT 0.0::DOUBLE AS threshold UNION SELECT floor(x * 1e6) / 1e6 FROM rk WHERE i IN (round_even((n - 1) * 0.25, 0), round_even((n - 1) * 0.5, 0), round_even((n - 1) * 0.75, 0), round_even((n - 1) * 0.9, 0)))",
    "ok AS (SELECT threshold, hit_at_1, hit_at_k, coalesce(margin_ratio >= threshold AND top_ref IS NOT NULL, false) AS ok FROM res, th)"],
    """SELECT round(threshold, 6) AS threshold, count(*) FILTER (ok) AS accepted, round(avg(ok::INT), 6) AS coverage, round(coalesce(avg(hit_at_1::INT) FILTER (ok), 0.0), 6) AS precision_at_1,
  round(coalesce(avg(hit_at_k::INT) FILTER (ok), 0.0), 6) AS hit_at_k FROM ok GROUP BY threshold""")
ALL3 = [*STRAT, "gold", "ex", "g", results("hits", "res1"), results("tree", "res2"), results("again", "res3")]
RAW = MEANS.replace("round(", "(").replace(", 6)", ")")
SUM3 = "sums AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, {RAW} FROM {t}" for n, t in (("flat", "res1"), ("hierarchical", "res2"), ("reranked", "res3"))) + ")"
S["e_compare_strategies"] = sql([*ALL3, SUM3], """SELECT strategy, n, round(hit_at_1, 6) AS hit_at_1, round(hit_at_k, 6) AS hit_at_k, round(mrr, 6) AS mrr, round(coverage, 6) AS coverage, round(precision, 6) AS precision, round(avg_context, 6) AS avg_context,
  row_number() OVER (ORDER BY round(hit_at_k, 9) DESC, round(hit_at_1, 9) DESC, round(mrr, 9) DESC, round(coverage, 9) DESC, round(precision, 9) DESC, round(avg_context, 9), strategy) AS place FROM sums""")
S["e_deltas"] = sql([*ALL3, SUM3], "SELECT a.strategy, " + ", ".join(f"round(a.{c} - b.{c}, 6) AS d_{c}" for c in ("hit_at_1", "hit_at_k", "mrr", "coverage", "precision", "avg_context")) + " FROM sums a, sums b WHERE b.strategy = 'flat'")
S["e_ci_status"] = sql([*EV, f"m AS (SELECT {RAW} FROM res)", "u AS (SELECT 'hit_at_1' AS metric, hit_at_1 AS value, 0.2::DOUBLE AS minimum FROM m UNION ALL SELECT 'hit_at_k', hit_at_k, 0.4 FROM m UNION ALL SELECT 'mrr', mrr, 0.9 FROM m)"],
    "SELECT metric, round(value, 6) AS value, minimum, CASE WHEN value >= minimum THEN 'pass' WHEN value >= minimum - 0.05 THEN 'warn' ELSE 'fail' END AS status FROM u")
S["e_rank_summary"] = sql(EV, "SELECT count(*) AS n, " + ", ".join(f"round(avg(coalesce(first_hit <= {k}, false)::INT), 4) AS hit_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / first_hit, 0.0)), 4) AS mrr FROM res")
S["e_neighbour_windows"] = sql([*BM, "gold", "pos", "near AS (SELECT h.query_id, h.rank, abs(a.pos - b.pos) AS gap FROM hits h JOIN pos a USING (ref) JOIN gold g ON g.query_id = h.query_id JOIN pos b ON b.ref = g.ref AND b.doc_id = a.doc_id)",
    "w AS (SELECT unnest([0, 1, 2, 5])::BIGINT AS width)", "f AS (SELECT width, q.query_id, (SELECT min(rank) FROM near n WHERE n.query_id = q.query_id AND gap <= width) AS first FROM (SELECT DISTINCT query_id FROM gold) q, w)"],
    "SELECT width, count(*) AS n, round(avg((first IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM f GROUP BY width")
LAB = "lab AS (SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id))"
S["e_auc"] = sql([LAB], """SELECT (SELECT count(*) FROM lab WHERE quality = 1) AS positives, (SELECT count(*) FROM lab WHERE quality = 0) AS negatives,
  round((SELECT avg(CASE WHEN p.n_chars > q.n_chars THEN 1.0 WHEN p.n_chars = q.n_chars THEN 0.5 ELSE 0.0 END) FROM lab p, lab q WHERE p.quality = 1 AND q.quality = 0), 6) AS auc""")
S["e_calibration"] = sql([LAB], "SELECT bucket, count(*) AS n, round(avg(n_chars), 6) AS mean_score, round(avg(quality), 6) AS positive_rate FROM (SELECT *, ntile(10) OVER (ORDER BY n_chars, doc_id) AS bucket FROM lab) GROUP BY bucket")
S["e_split"] = """SELECT doc_id, CASE WHEN pos <= CASE WHEN size < 2 THEN 0 ELSE least(size - 1, greatest(1, floor(size * 0.3))) END THEN 'eval' ELSE 'train' END AS part FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('split' || doc_id), doc_id) AS pos, count(*) OVER (PARTITION BY source) AS size FROM documents)"""
S["e_range_scores"] = sql([*BM, "gold", "rng AS (SELECT ref, doc_id || '#' || ((row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1) // 5) AS rng FROM regions)",
    "hr AS (SELECT query_id, rng, min(rank) AS rank FROM hits JOIN rng USING (ref) GROUP BY ALL)", "gr2 AS (SELECT DISTINCT query_id, rng FROM gold JOIN rng USING (ref))"],
    "SELECT query_id, count(*) AS ranges, count(rank) AS found, min(rank) AS first FROM gr2 LEFT JOIN hr USING (query_id, rng) GROUP BY query_id")

ALIGN = ["regions", f"src AS (SELECT 'b' || item_id AS source_ref, text, {align_terms('text')} AS t FROM benchmark)", f"tgt AS (SELECT ref AS target_ref, doc_id, region_id, ordinal, text, {align_terms('text')} AS t FROM regions)",
    "pr AS (SELECT source_ref, target_ref, doc_id, region_id, count(*) AS shared, round(count(*) / (any_value(sn) + any_value(tn) - count(*)), 4) AS score FROM (SELECT source_ref, len(t) AS sn, unnest(t) AS term FROM src) JOIN (SELECT target_ref, doc_id, region_id, len(t) AS tn, unnest(t) AS term FROM tgt) USING (term) GROUP BY ALL)",
    "al AS (SELECT *, row_number() OVER (PARTITION BY source_ref ORDER BY score DESC, doc_id, region_id) AS rank FROM pr)"]
S["a_align"] = sql(ALIGN, "SELECT source_ref, rank, target_ref, score, shared FROM al WHERE rank <= 3")
NUMS = "(?:^|[^a-z0-9_])([0-9]+)"
S["d_exact_duplicates"] = sql(["regions", "tok", "n AS (SELECT ref, doc_id, array_to_string(t, ' ') AS norm FROM tok)"], "SELECT sha256(norm) AS digest, count(*) AS n, count(DISTINCT doc_id) AS docs, min(ref) AS first_ref FROM n WHERE length(norm) >= 40 GROUP BY norm HAVING count(*) > 1")
NEAR = [f"sets AS (SELECT ref, t FROM (SELECT ref, {smell_terms('text')} AS t FROM regions) WHERE len(t) >= 6)",
    "nd AS (SELECT a, b, shared / (an + bn - shared) AS jaccard, shared / least(an, bn) AS containment FROM (SELECT x.ref AS a, y.ref AS b, any_value(x.n) AS an, any_value(y.n) AS bn, count(*) AS shared FROM (SELECT ref, len(t) AS n, unnest(t) AS term FROM sets) x JOIN (SELECT ref, len(t) AS n, unnest(t) AS term FROM sets) y ON x.term = y.term AND x.ref < y.ref GROUP BY x.ref, y.ref) WHERE shared / (an + bn - shared) >= 0.86 OR shared / least(an, bn) >= 0.94)"]
S["d_near_duplicates"] = sql(["regions", *NEAR], "SELECT a AS left_ref, b AS right_ref, round(jaccard, 4) AS jaccard, round(containment, 4) AS containment FROM nd")
OVER = ["sz AS (SELECT ref, CAST(len(t) AS BIGINT) AS tokens FROM tok)", "md AS (SELECT quantile_cont(tokens, 0.5) AS median FROM sz)", "ov AS (SELECT ref, tokens, median FROM sz, md WHERE tokens > greatest(900.0, 3.5 * median))"]
S["d_oversized"] = sql(["regions", "tok", *OVER], "SELECT * FROM ov")
CNF = [f"cf AS (SELECT ref, t, cues, list_filter(t, lambda x: length(x) >= 5)[1:8] AS topic FROM (SELECT ref, {smell_terms('text')} AS t, {cues('text', M.LEXICON)} AS cues FROM regions) WHERE len(cues) > 0)",
    f"cp AS (SELECT a.ref AS left_ref, b.ref AS right_ref, a.cues AS lc, b.cues AS rc FROM cf a JOIN cf b ON a.topic = b.topic AND a.ref < b.ref AND len(a.topic) > 0 AND {opposed('a.cues', 'b.cues', M.PAIRS)} AND len(list_intersect(a.t, b.t)) >= SHARED)"]
S["d_conflicts"] = sql(["regions", *[c.replace("SHARED", "5") for c in CNF]], "SELECT left_ref, right_ref, array_to_string(lc, ',') AS left_cues, array_to_string(rc, ',') AS right_cues FROM cp")
MARK = " OR ".join(f"contains(h, '{m}')" for m in T.LEDGER_MARKS)
LEDG = " + ".join(f"contains(h, '{m}')::INT" for m in T.LEDGER_TERMS)
MAG = f"mag AS (SELECT ref FROM (SELECT ref, lower(doc_id || ' ' || array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:42], ' ') || ' ' || substr(text, 1, 240)) AS h FROM regions) WHERE {MARK} OR {LEDG} >= 3)"
W_ = smells.WEIGHTS
SPARSE = f"spr AS (SELECT ref FROM tok WHERE len(list_filter(t, lambda x: length(x) > 2 AND x NOT IN ({', '.join(chr(39) + w + chr(39) for w in T.KEYWORD_STOP)}))) = 0)"
S["d_index_smells"] = sql(["regions", "tok", MAG, SPARSE, *OVER, *NEAR, *[c.replace("SHARED", "5") for c in CNF], "dup AS (SELECT array_to_string(t, ' ') AS norm FROM tok WHERE length(array_to_string(t, ' ')) >= 40 GROUP BY norm HAVING count(*) > 1)",
    "cn AS (SELECT (SELECT count(*) FROM regions) AS regions, (SELECT count(*) FROM mag) AS query_magnets, (SELECT count(*) FROM ov) AS oversized, (SELECT count(*) FROM spr) AS sparse, (SELECT count(*) FROM dup) AS exact_duplicates, (SELECT count(*) FROM nd) AS near_duplicates, (SELECT count(*) FROM cp) AS conflicts)",
    "scd AS (SELECT *, round(least(" + " + ".join(f"least({k} / regions, 1.0) * {W_[k]}" for k in ("query_magnets", "oversized", "sparse", "exact_duplicates", "near_duplicates", "conflicts")) + ", 1.0), 4) AS score FROM cn)"],
    "SELECT *, CASE WHEN score >= 0.35 THEN 'high' WHEN score >= 0.12 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'clean' END AS severity FROM scd")


STALE = ["old", "new", f"""dfs AS (SELECT ref, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS state
FROM (SELECT ref, {rhash("text")} AS h FROM old) a FULL OUTER JOIN (SELECT ref, {rhash("text")} AS h FROM new) b USING (ref))""",
    "stl AS (SELECT query_id, coalesce(list(ref ORDER BY ref) FILTER (state = 'removed'), []) AS missing, coalesce(list(ref ORDER BY ref) FILTER (state = 'changed'), []) AS changed FROM gold JOIN dfs USING (ref) WHERE state IN ('removed', 'changed') GROUP BY query_id)"]


def run_smells(res: str, name: str, most: str = " ORDER BY l, r LIMIT 20") -> list[str]:
    stop = ", ".join(f"'{w}'" for w in T.SMELL_STOP)
    heat, conf = HEAT.replace("FROM res", f"FROM {res}").replace("heat AS", f"heat{name} AS"), CONF.replace("FROM res", f"FROM {res}").replace("conf AS", f"conf{name} AS")
    low = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{4,}}'), lambda x: x NOT IN ({stop})))"
    against = [
        f"ct{name} AS (SELECT ref, t, cues FROM (SELECT ref, {low} AS t, {cues('text', M.LEXICON)} AS cues FROM regions) WHERE len(t) >= 5 AND len(cues) > 0)",
        f"cu{name} AS (SELECT ref, cues, unnest(t) AS term FROM ct{name})",
        f"""cd{name} AS (SELECT a.ref AS l, b.ref AS r, count(*) AS shared FROM cu{name} a JOIN cu{name} b ON a.term = b.term AND a.ref < b.ref AND {opposed('a.cues', 'b.cues', M.PAIRS)}
  GROUP BY ALL HAVING count(*) >= 5{most})""",
    ]
    return [*STALE, heat, conf, *against, f"""sm{name} AS (
  SELECT 'hard_ref' AS type, CASE WHEN miss_at_k = n THEN 'high' ELSE 'medium' END AS severity, ref AS refs, miss_at_k AS n FROM heat{name} WHERE miss_at_k > 0
  UNION ALL SELECT 'confusion_pair', CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END, gold_ref || ',' || top_ref, n FROM conf{name}
  UNION ALL SELECT 'query_style_gap', CASE WHEN gap >= 0.5 THEN 'high' ELSE 'medium' END, '', 1 FROM (SELECT max(v) - min(v) AS gap FROM (SELECT avg(hit_at_1::INT) AS v FROM {res} GROUP BY style)) WHERE gap >= 0.25
  UNION ALL SELECT 'undercitation', 'high', '', count(*) FROM {res} WHERE common_refs < n_gold HAVING count(*) > 0
  UNION ALL SELECT 'overcitation', 'medium', '', count(*) FROM {res} WHERE common_refs < n_context AND {PRE} < 0.5 HAVING count(*) > 0
  UNION ALL SELECT 'low_confidence', 'medium', '', count(*) FROM {res} WHERE margin_ratio < 0.08 HAVING count(*) > 0
  UNION ALL SELECT 'query_magnet', 'medium', top_ref, count(*) FROM {res} WHERE top_ref IS NOT NULL GROUP BY top_ref HAVING count(*) >= greatest(4, floor((SELECT count(*) FROM {res}) * 0.15)) AND avg(hit_at_1::INT) < 0.8
  UNION ALL SELECT 'stale_label', CASE WHEN len(missing) > 0 THEN 'high' ELSE 'medium' END, array_to_string(list_concat(changed, missing), ','), len(changed) + len(missing) FROM stl
  UNION ALL SELECT 'gold_mode_gap', 'medium', weakest, 1 FROM (SELECT max(v) - min(v) AS gap, arg_min(mode, {{'v': v, 'm': mode}}) AS weakest, count(*) AS n FROM (SELECT mode, avg({COV}) AS v FROM {res} GROUP BY mode)) WHERE n > 1 AND gap >= 0.25
  UNION ALL SELECT 'contradictory_support', 'medium', l || ',' || r, shared FROM cd{name}
  UNION ALL SELECT 'duplicate_support', 'medium', min(ref), count(*) FROM (SELECT ref, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 4 AND x NOT IN ({stop})), ' ') AS w FROM regions) WHERE length(w) >= 40 GROUP BY w HAVING count(*) > 1
  UNION ALL SELECT 'uncovered_region', CASE WHEN n / total >= 0.4 THEN 'medium' ELSE 'low' END, '', n FROM (SELECT count(*) FILTER (ref NOT IN (SELECT ref FROM gold)) AS n, count(*) AS total FROM regions) WHERE n > 0)"""]


S["d_run_smells"] = sql([*EV, *run_smells("res", "1")], "SELECT type, severity, refs, CAST(n AS BIGINT) AS n FROM sm1")
RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in smells.RULES) + ") r(type, action, adaptation_type))"
S["d_adaptation_plan"] = sql([*EV, *run_smells("res", "1", ""), RULES], "SELECT DISTINCT action, adaptation_type, CASE WHEN severity = 'high' THEN 'high' ELSE 'medium' END AS priority, refs FROM sm1 JOIN rules USING (type)")
S["d_compare_reports"] = sql([*ALL3, *run_smells("res1", "1", ""), *run_smells("res3", "2", "")[len(STALE) :], "j AS (SELECT type, refs, a.x, b.y FROM (SELECT DISTINCT type, refs, 1 AS x FROM sm1) a FULL OUTER JOIN (SELECT DISTINCT type, refs, 1 AS y FROM sm2) b USING (type, refs))"],
    "SELECT type, count(*) FILTER (x IS NULL) AS new, count(*) FILTER (y IS NULL) AS resolved, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS persistent FROM j GROUP BY type")

FE = ["fe AS (SELECT event_id, ts, 'query ' || user_id AS query, 'r' || (k % 20) AS top_ref, CASE WHEN event_type = 'purchase' THEN 'r' || (k % 5) WHEN event_type = 'click' THEN 'r' || (k * 7 % 20) END AS target_ref, event_type = 'error' AS negative, event_type = 'signup' AS no_answer FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"]
FC = [*FE, "known AS (SELECT DISTINCT 'r' || (CAST(json_extract_string(props, '$.k') AS INT) % 15) AS ref FROM events)",
    "fb AS (SELECT query, count(*) AS n, count(*) FILTER (no_answer) AS no_answer, count(*) FILTER (negative) AS negative FROM fe GROUP BY query HAVING count(*) >= 2)",
    "ft AS (SELECT query, top_ref AS top, n AS top_n FROM (SELECT query, top_ref, count(*) AS n, min(event_id) AS f FROM fe GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, f) = 1)",
    "fg AS (SELECT query, target_ref, count(*) AS n, min(event_id) AS f FROM fe WHERE target_ref IS NOT NULL GROUP BY ALL)",
    "fh AS (SELECT query, target_ref AS target, n AS target_n, count(*) OVER (PARTITION BY query) AS target_kinds FROM fg QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, f) = 1)",
    "fm AS (SELECT query, count(*) AS missing FROM (SELECT query, top_ref AS ref FROM fe UNION SELECT query, target_ref FROM fe WHERE target_ref IS NOT NULL) WHERE ref NOT IN (SELECT ref FROM known) GROUP BY query)",
    "fc AS (SELECT query, n, no_answer, negative, top, top_n, target, target_n, coalesce(target_kinds, 0) AS target_kinds, coalesce(missing, 0) AS missing FROM fb LEFT JOIN ft USING (query) LEFT JOIN fh USING (query) LEFT JOIN fm USING (query))"]
S["f_clusters"] = sql(FC, "SELECT * FROM fc")
FA = """fa AS (SELECT query, n, unnest(CASE WHEN len(a) = 0 THEN ['track_feedback_cluster'] ELSE a END) AS action FROM (SELECT query, n, list_filter([
  CASE WHEN target IS NOT NULL AND (top IS NULL OR target <> top) THEN 'add_shadow_alias_or_doc2query' END, CASE WHEN target <> top THEN 'record_confusion_pair' END,
  CASE WHEN top IS NOT NULL AND negative >= greatest(2, n // 2) AND target IS NULL THEN 'review_query_magnet' END, CASE WHEN no_answer >= greatest(2, n // 2) THEN 'review_no_answer_or_missing_coverage' END,
  CASE WHEN target_kinds >= 2 THEN 'review_ambiguous_query' END], lambda x: x IS NOT NULL) AS a FROM fc))"""
S["f_actions"] = sql([*FC, FA], "SELECT * FROM fa")
S["f_ordered"] = sql([*FC, FA], "SELECT query, n, min(CASE action WHEN 'add_shadow_alias_or_doc2query' THEN 0 WHEN 'record_confusion_pair' THEN 1 WHEN 'review_query_magnet' THEN 2 WHEN 'review_no_answer_or_missing_coverage' THEN 3 WHEN 'review_ambiguous_query' THEN 4 ELSE 9 END)::BIGINT AS best FROM fa GROUP BY query, n ORDER BY best, n DESC, query LIMIT 25")
S["f_windows"] = sql(FE, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, query, count(*) AS n, count(*) FILTER (no_answer) AS no_answer, count(*) FILTER (negative) AS negative FROM fe GROUP BY ALL")

S["l_revision_diff"] = sql(["regions", "old", "new"], f"""SELECT ref, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS state
FROM (SELECT ref, {rhash("text")} AS h FROM old) a FULL OUTER JOIN (SELECT ref, {rhash("text")} AS h FROM new) b USING (ref)""")
S["l_stale_examples"] = sql(["regions", "gold", "old", "new", f"j AS (SELECT query_id, {rhash('o.text')} AS saved, CASE WHEN n.text IS NOT NULL THEN {rhash('n.text')} END AS now FROM gold JOIN old o USING (ref) LEFT JOIN new n USING (ref))"],
    "SELECT query_id, count(*) FILTER (now IS NULL) AS missing, count(*) FILTER (now <> saved) AS changed FROM j GROUP BY query_id HAVING count(*) FILTER (now IS NULL) > 0 OR count(*) FILTER (now <> saved) > 0")


def prep(src: str, name: str) -> str:
    return f"{name} AS (SELECT *, {digest(chr(97) + 'rray_to_string(w, ' + repr(' ') + ')')} AS fp, list_distinct(w) AS tok, array_to_string(w[1:20], ' ') AS quote, array_to_string(w[1:8], ' ') AS quote8 FROM (SELECT path, ref, ordinal, text, {WORDS.format('text')} AS w FROM {src}))"


MIG = ["regions", "old", "new", prep("old", "pa"), prep("new", "pb"),
    "ex1 AS (SELECT a.ref, a.path, a.tok, a.fp, (SELECT max_by(b.ref, b.ordinal) FROM pb b WHERE b.path = a.path AND b.fp = a.fp) AS same_ref FROM pa a)",
    "mv AS (SELECT a.ref, arg_min(b.ref, (b.path, b.ordinal)) AS moved_ref FROM ex1 a JOIN pb b ON b.fp = a.fp AND b.path <> a.path WHERE a.same_ref IS NULL GROUP BY a.ref)",
    "ex2 AS (SELECT ref, path, tok, same_ref, moved_ref FROM ex1 LEFT JOIN mv USING (ref))",
    "rest AS (SELECT ref, path, tok FROM ex2 WHERE same_ref IS NULL AND moved_ref IS NULL)",
    "fz AS (SELECT ref, path, cand, cpath, shared / (n + m - shared) AS sim FROM (SELECT x.ref, x.path, y.ref AS cand, y.path AS cpath, x.n, y.m, count(*) AS shared FROM (SELECT ref, path, len(tok) AS n, unnest(tok) AS t FROM rest) x JOIN (SELECT ref, path, len(tok) AS m, unnest(tok) AS t FROM pb) y USING (t) WHERE m >= floor(n * 0.82) AND m <= floor(n / 0.82) + 1 GROUP BY ALL) WHERE shared / (n + m - shared) >= 0.82)",
    "fb1 AS (SELECT ref, cand, sim FROM fz QUALIFY row_number() OVER (PARTITION BY ref ORDER BY round(sim, 9) DESC, (path <> cpath)::INT, cand) = 1)",
    "rest2 AS (SELECT * FROM rest WHERE ref NOT IN (SELECT ref FROM fb1))",
    "sp AS (SELECT ref, cand, row_number() OVER (PARTITION BY ref ORDER BY shared DESC, cand) AS r FROM (SELECT x.ref, y.ref AS cand, count(*) AS shared FROM (SELECT ref, unnest(tok) AS t FROM rest2) x JOIN (SELECT ref, unnest(tok) AS t FROM pb) y USING (t) GROUP BY ALL) QUALIFY r <= 3)",
    "sg AS (SELECT s.ref, string_agg(cand, ',' ORDER BY r) AS cands, count(*) AS k, len(list_intersect(any_value(a.tok), flatten(list(b.tok)))) / greatest(len(any_value(a.tok)), 1) AS coverage FROM sp s JOIN rest2 a ON a.ref = s.ref JOIN pb b ON b.ref = s.cand GROUP BY s.ref)",
    "ss AS (SELECT * FROM sg WHERE k >= 2 AND coverage >= 0.82)",
    """mg AS (SELECT ref, CASE WHEN same_ref IS NOT NULL THEN 'same_file_exact' ELSE 'moved_exact' END AS status, coalesce(same_ref, moved_ref) AS candidate, 1.0::DOUBLE AS confidence FROM ex2 WHERE same_ref IS NOT NULL OR moved_ref IS NOT NULL
  UNION ALL SELECT ref, 'fuzzy', cand, sim FROM fb1 UNION ALL SELECT ref, 'split_support', cands, coverage FROM ss
  UNION ALL SELECT ref, 'stale', NULL, 0.0 FROM rest2 WHERE ref NOT IN (SELECT ref FROM ss))"""]
S["l_migration"] = sql(MIG, "SELECT ref, status, candidate, round(confidence, 6) AS confidence FROM mg")
STATE = "CASE status WHEN 'same_file_exact' THEN CASE WHEN candidate = ref THEN 'unchanged' ELSE 'moved' END WHEN 'moved_exact' THEN 'moved' WHEN 'fuzzy' THEN 'rewritten' WHEN 'split_support' THEN 'split_support' ELSE 'deleted' END"
S["l_decisions"] = sql([*MIG, f"dc AS (SELECT {STATE} AS state FROM mg)"], "SELECT state, " + _case({k: v[0] for k, v in lifecycle.DECISIONS.items()}, "state", "NULL") + " AS next_action, " + _case({k: v[1] for k, v in lifecycle.DECISIONS.items()}, "state", "NULL") + " AS priority, count(*) AS n FROM dc GROUP BY state")
JAC = "(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"
MET = [*MIG, "fo AS (SELECT path, sha256(string_agg(fp, chr(10) ORDER BY ordinal)) AS f FROM pa GROUP BY path)", "fn AS (SELECT path, sha256(string_agg(fp, chr(10) ORDER BY ordinal)) AS f FROM pb GROUP BY path)",
    "qi AS (SELECT quote, count(*) AS hits, arg_min(tok, ref) AS qtok FROM pb WHERE quote <> '' GROUP BY quote)",
    f"""mm AS (SELECT a.ref, m.status <> 'stale' AS v, c.fp IS NOT NULL AS have, coalesce(c.fp = a.fp, false) AS same, coalesce(fo.f = fn.f, false) AS file, coalesce(hits, 0) AS hits,
    c.fp IS NOT NULL AND a.quote8 <> '' AND a.quote8 = c.quote8 AND {JAC.format(a="a.tok", b="c.tok")} >= 0.95 AS near, c.fp IS NOT NULL AND {JAC.format(a="a.tok", b="c.tok")} >= 0.82 AS alike, hits = 1 AND {JAC.format(a="a.tok", b="qi.qtok")} >= 0.82 AS qalike
  FROM pa a JOIN mg m USING (ref) JOIN fo ON fo.path = a.path LEFT JOIN fn ON fn.path = a.path LEFT JOIN pb c ON c.path = a.path AND c.ordinal = a.ordinal LEFT JOIN qi ON qi.quote = a.quote)""",
    """mo AS (SELECT 'path_ordinal' AS method, CASE WHEN NOT have THEN 'missing' WHEN same OR alike THEN 'correct' ELSE 'silent_wrong' END AS outcome FROM mm
  UNION ALL SELECT 'id_hash', CASE WHEN same THEN 'preserved' WHEN v THEN 'false_stale_alert' ELSE 'true_stale_alert' END FROM mm
  UNION ALL SELECT 'source_hash', CASE WHEN file THEN 'preserved' WHEN v THEN 'false_stale_alert' ELSE 'true_stale_alert' END FROM mm
  UNION ALL SELECT 'hash_quote', CASE WHEN same THEN 'preserved' WHEN hits = 1 THEN CASE WHEN v THEN 'preserved' ELSE 'silent_wrong' END WHEN hits > 1 THEN 'review_needed' WHEN v THEN 'false_stale_alert' ELSE 'true_stale_alert' END FROM mm
  UNION ALL SELECT 'layered', CASE WHEN same THEN 'preserved' WHEN near THEN CASE WHEN v THEN 'preserved' ELSE 'silent_wrong' END WHEN qalike THEN CASE WHEN v THEN 'preserved' ELSE 'silent_wrong' END WHEN v THEN 'review_needed' ELSE 'true_stale_alert' END FROM mm)"""]
S["l_method_table"] = sql(MET, "SELECT method, outcome, n, round(n / sum(n) OVER (PARTITION BY method), 4) AS rate FROM (SELECT method, outcome, count(*) AS n FROM mo GROUP BY ALL)")
S["l_files"] = sql(["regions", "old", "new"], "SELECT (SELECT count(*) FROM (SELECT path FROM old INTERSECT SELECT path FROM new)) AS kept, (SELECT count(*) FROM (SELECT path FROM old EXCEPT SELECT path FROM new)) AS deleted, (SELECT count(*) FROM (SELECT path FROM new EXCEPT SELECT path FROM old)) AS added")


def top_terms(tokens: str, n: int) -> list[str]:
    return [f"tt AS (SELECT ref, doc_id, ordinal, unnest(t) AS term, unnest(range(len(t))) AS pos FROM {tokens})",
        "tn AS (SELECT term, count(*) AS n, count(DISTINCT ref) AS df, min({'d': doc_id, 'o': ordinal, 'p': pos}) AS f FROM tt GROUP BY term)",
        f"tr AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS rank FROM tn QUALIFY rank <= {n})",
        "rf AS (SELECT term, string_agg(ref, ',' ORDER BY ref) AS refs FROM (SELECT term, ref FROM (SELECT DISTINCT term, ref FROM tt WHERE term IN (SELECT term FROM tr)) QUALIFY row_number() OVER (PARTITION BY term ORDER BY ref) <= 12) GROUP BY term)"]


S["v_top_terms"] = sql(["regions", "dtok", *top_terms("dtok", 40)], "SELECT rank, term, n, df, refs FROM tr JOIN rf USING (term)")
ABB = r"abt AS (SELECT ref, doc_id, ordinal, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_-]+'), lambda x: regexp_matches(x, '^[A-Z][A-Z0-9-]{2,}$')) AS t FROM regions)"
S["v_abbreviations"] = sql(["regions", ABB, *top_terms("abt", 30)], "SELECT rank, term, n, df, refs FROM tr JOIN rf USING (term)")
S["v_range_candidates"] = sql(["regions", "dtok", "x AS (SELECT ref, list_distinct(t) AS t, lead(ref) OVER w AS next_ref, lead(list_distinct(t)) OVER w AS nt FROM dtok WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))"],
    "SELECT ref, next_ref, CAST(len(list_intersect(t, nt)) AS BIGINT) AS shared FROM x WHERE next_ref IS NOT NULL AND len(list_intersect(t, nt)) >= 2")
MENU = " + ".join(f"contains(low, '{m}')::INT" for m in discovery.MENU)
ROLES = [MAG, ABB, f"""ro AS (SELECT ref, CASE WHEN len(r) = 0 THEN ['content'] ELSE r END AS roles FROM (SELECT ref, list_filter([
  CASE WHEN ref IN (SELECT ref FROM mag) THEN 'query_magnet' END,
  CASE WHEN starts_with(t, '#') OR (len(regexp_split_to_array(t, '\\s+')) <= 10 AND NOT regexp_matches(t, '[.;:]$') AND NOT contains(low, ' means ')) THEN 'heading' END,
  CASE WHEN contains(low, 'table of contents') OR starts_with(low, 'contents') THEN 'navigation_only' END,
  CASE WHEN na >= 8 OR {MENU} >= 5 THEN 'boilerplate' END,
  CASE WHEN contains(low, ' means ') OR ends_with(low, ' means') THEN 'definition' END,
  CASE WHEN contains(low, 'shall') OR contains(low, 'must') OR contains(low, 'required') OR contains(low, 'requirement') THEN 'obligation' END,
  CASE WHEN contains(low, 'except') OR contains(low, 'unless') OR contains(low, 'exempt') THEN 'exception' END,
  CASE WHEN contains(low, 'for example') OR contains(low, 'e.g.') OR contains(low, 'example') THEN 'example' END], lambda x: x IS NOT NULL) AS r
  FROM (SELECT r.ref, trim(r.text) AS t, lower(trim(r.text)) AS low, len(a.t) AS na FROM regions r JOIN abt a USING (ref))))"""]
S["v_roles"] = sql(["regions", *ROLES], "SELECT role, count(*) AS n FROM (SELECT unnest(roles) AS role FROM ro) GROUP BY role")
APX = "greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT))"
S["v_doc_clusters"] = sql(["regions", "dtok", "tt AS (SELECT doc_id, ordinal, unnest(t) AS term, unnest(range(len(t))) AS pos FROM dtok)", "tc AS (SELECT doc_id, term, count(*) AS n, min({'o': ordinal, 'p': pos}) AS f FROM tt GROUP BY ALL)",
    "tk AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM tc QUALIFY r <= 12)", "ts AS (SELECT doc_id, string_agg(term, ',' ORDER BY r) AS terms FROM tk GROUP BY doc_id)"],
    f"SELECT doc_id, count(*) AS regions, CAST(sum({APX}) AS BIGINT) AS tokens, coalesce(any_value(terms), '') AS terms FROM regions LEFT JOIN ts USING (doc_id) GROUP BY doc_id")
S["v_tree_clusters"] = sql(["regions"], f"SELECT lang, source, count(DISTINCT doc_id) AS docs, count(*) AS regions, CAST(sum({APX}) AS BIGINT) AS tokens, CAST(grouping(lang, source) AS BIGINT) AS level FROM regions GROUP BY ROLLUP (lang, source)")
TAG = ["dtok", "su AS (SELECT DISTINCT ref, unnest(t) AS term FROM dtok)", "to_ AS (SELECT count(*) AS total FROM regions)", "dd AS (SELECT term, count(*) AS df FROM su GROUP BY term)",
    "ch AS (SELECT term, df FROM dd, to_ WHERE df >= 2 AND df <= greatest(2, floor(total * 0.16)) QUALIFY row_number() OVER (ORDER BY df DESC, term) <= 80)",
    "bt AS (SELECT ref, arg_min(term, {'a': -df, 'b': term}) AS tag FROM su JOIN ch USING (term) GROUP BY ref)",
    "kp AS (SELECT tag FROM (SELECT tag, count(*) AS n FROM bt GROUP BY tag), to_ WHERE n >= greatest(2, total // 120) QUALIFY row_number() OVER (ORDER BY n DESC, tag) < 40)",
    "tg AS (SELECT r.ref, CASE WHEN tag IN (SELECT tag FROM kp) THEN 'tag:' || tag ELSE 'tag:other' END AS cluster FROM regions r LEFT JOIN bt USING (ref))"]
S["v_tag_graph"] = sql(["regions", *TAG], "SELECT ref, cluster FROM tg")
S["v_windowed_terms"] = sql(["regions", "dtok", "wt AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1) // 50 AS win, t FROM dtok)", "wc AS (SELECT doc_id, win, unnest(t) AS term FROM wt)",
    "wg AS (SELECT term, count(*) AS n, count(DISTINCT (doc_id, win)) AS windows FROM wc GROUP BY term)"], "SELECT term, n, windows, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS rank FROM wg) WHERE rank <= 40")
PLAN = "plan AS (SELECT ref, style, 1::BIGINT AS n FROM ro, (SELECT unnest(['adversarial', 'concern', 'direct']) AS style) WHERE NOT list_contains(roles, 'query_magnet') AND (style = 'direct' OR NOT list_has_any(roles, ['navigation_only', 'boilerplate'])))"
S["v_question_plan"] = sql(["regions", *ROLES, PLAN], "SELECT * FROM plan")
S["v_local_questions"] = sql(["regions", *ROLES, PLAN, "dtok", "tu AS (SELECT ref, term, min(pos) AS pos FROM (SELECT ref, unnest(t) AS term, unnest(range(len(t))) AS pos FROM dtok) GROUP BY ALL)",
    "tp AS (SELECT ref, string_agg(term, ', ' ORDER BY pos) AS topic FROM (SELECT * FROM tu QUALIFY row_number() OVER (PARTITION BY ref ORDER BY pos) <= 3) GROUP BY ref)"],
    """SELECT ref, style, CASE style WHEN 'direct' THEN 'What does this section explain about ' || coalesce(topic, '') || '?' WHEN 'concern' THEN 'Where should I look if I have a practical problem involving ' || coalesce(topic, '') || '?'
  ELSE 'Which part covers the rule or behaviour behind this topic?' END AS query FROM plan LEFT JOIN tp USING (ref)""")
S["v_review"] = sql(["regions", *ROLES, PLAN, *TAG, "cz AS (SELECT cluster, count(*) AS n FROM tg GROUP BY cluster)"], """SELECT 'unclustered_region' AS issue, (SELECT count(*) FROM regions WHERE ref NOT IN (SELECT ref FROM tg)) AS n
UNION ALL SELECT 'unplanned_region', (SELECT count(*) FROM regions WHERE ref NOT IN (SELECT ref FROM plan)) UNION ALL SELECT 'single_region_cluster', (SELECT count(*) FROM cz WHERE n = 1)
UNION ALL SELECT 'dominant_cluster', (SELECT count(*) FROM cz, to_ WHERE n > total * 0.5)""")

S["p_evidence_metrics"] = sql([*EV, r"wd AS (SELECT ref, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM regions)", "su2 AS (SELECT query_id, greatest(1, sum(w)) AS support FROM (SELECT query_id, unnest(context) AS ref FROM res) JOIN wd USING (ref) GROUP BY query_id)"],
    """SELECT count(*) AS n, round(avg(hit_at_1::INT), 6) AS hit_at_1, round(avg(rr), 6) AS mrr, round(avg(n_context - common_refs), 6) AS avg_overcitation, round(avg(n_gold - common_refs), 6) AS avg_undercitation, round(avg(coalesce(support, 0)), 6) AS avg_support_tokens
FROM res LEFT JOIN su2 USING (query_id)""")
S["p_qrels"] = sql(["regions", "gold"], "SELECT printf('q%04d', query_id) AS query_id, 'run' AS iteration, ref AS document_id, 1::BIGINT AS relevance FROM gold")
S["p_document_metadata"] = sql(["regions"], f"SELECT ref, doc_id, ordinal, {rhash('text')} AS hash, lag(ref) OVER w AS prev_ref, lead(ref) OVER w AS next_ref FROM regions WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)")
S["p_trace_events"] = sql(EV, f"SELECT {digest(repr('run:') + ' || query_id')} AS event_id, query_id, hit_at_1, hit_at_k, array_to_string(gold_refs, ',') AS gold_refs, coalesce(top_ref, '') AS top_ref FROM res")
SIDE = lambda c, n: f"{n}_ AS (SELECT query_id, {digest('string_agg(text, chr(10) ORDER BY ref)')} AS {n}, count(*) AS n_{n} FROM (SELECT query_id, unnest({c}) AS ref FROM res) JOIN regions USING (ref) GROUP BY query_id)"
S["p_answer_rows"] = sql([*EV, SIDE("context", "contexts"), SIDE("gold_refs", "references")], 'SELECT query_id, contexts, n_contexts, "references", n_references FROM res LEFT JOIN contexts_ USING (query_id) LEFT JOIN references_ USING (query_id)').replace("AS references,", 'AS "references",')
S["m_mark_and_strip"] = "SELECT doc_id, true AS same FROM documents"

S["r_section_of"] = sql(["regions", HEADED, "spn AS (SELECT h.doc_id, h.ref, h.ordinal, (SELECT min(p.ordinal) FROM headed p WHERE p.doc_id = h.doc_id AND p.ordinal > h.ordinal AND p.level > 0 AND p.level <= h.level) AS stop FROM headed h WHERE h.level > 0)"],
    "SELECT r.ref, arg_min(s.ref, s.ordinal) AS section_ref FROM regions r JOIN spn s ON s.doc_id = r.doc_id AND r.ordinal >= s.ordinal AND (s.stop IS NULL OR r.ordinal < s.stop) GROUP BY r.ref")
S["c_sliding_areas"] = """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT source, doc_id, a AS area FROM d, (SELECT unnest(range(0, (SELECT max(pos) // 5 + 1 FROM d))) AS a) WHERE a * 5 <= pos AND pos < a * 5 + 10"""
S["c_distractors"] = sql(["regions"], f"SELECT CASE WHEN k = 0 THEN ref ELSE 'distractor' || k || '_' || ref END AS ref, {digest('text')} AS hash FROM regions, (SELECT unnest([0, 1, 2]) AS k)")
S["t_hashed_features"] = f"""WITH t AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM documents) GROUP BY ALL),
h AS (SELECT doc_id, tf, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS h FROM t)
SELECT doc_id, h % 64 AS bucket, round(sum(CASE WHEN (h >> 20) % 2 = 0 THEN 1.0 ELSE -1.0 END * (1 + ln(tf))), 6) AS weight FROM h GROUP BY ALL"""
S["e_even_sample"] = """WITH d AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS size FROM documents)
SELECT doc_id, lang FROM d WHERE size <= 50 OR pos IN (SELECT CAST(round(i * (s - 1) / 49.0) AS BIGINT) FROM (SELECT count(*) AS s FROM documents), (SELECT unnest(range(50)) AS i))"""
S["l_rates"] = sql(MET, """SELECT (SELECT count(*) FROM mg) AS labels, (SELECT round(avg((status IN ('same_file_exact', 'moved_exact'))::INT), 4) FROM mg) AS auto_rate,
  (SELECT round(avg((status IN ('fuzzy', 'split_support'))::INT), 4) FROM mg) AS review_rate, (SELECT round(avg((status = 'stale')::INT), 4) FROM mg) AS stale_rate,
  (SELECT round(avg((have AND NOT (same OR alike))::INT), 4) FROM mm) AS naive_silent_wrong_rate""")
S["p_tool_summary"] = sql(EV, """SELECT (SELECT count(*) FROM regions) AS regions, (SELECT count(DISTINCT doc_id) FROM regions) AS documents, (SELECT count(DISTINCT query_id) FROM gold) AS labelled,
  (SELECT count(DISTINCT ref) FROM gold) AS gold_refs, count(*) AS examples, round(avg(hit_at_k::INT), 6) AS hit_at_k, round(avg(rr), 6) AS mrr FROM res""")
