"""DuckDB SQL for the queries, each written from the definitions rather than from the code."""

from __future__ import annotations

from ..functions.minhash import SEED, permutations
from .queries import SCRUB, VOCAB, WEIGHTS

W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"
TOKENS = f"""t AS (SELECT doc_id, regexp_extract_all(text, '{W}') toks FROM documents),
tk AS MATERIALIZED (SELECT doc_id, i, tok, length(tok) tl FROM (SELECT doc_id, unnest(toks) tok, unnest(range(1, len(toks) + 1)) i FROM t))"""


def repetition(num_top: int = 4, num_dup: int = 10) -> str:
    parts, joins, cols = [], [], []
    for n in range(1, num_dup + 1):
        lags = range(1, n)
        gram = " || chr(31) || ".join(["tok", *(f"lag(tok, {k}) OVER w" for k in lags)])
        size = " + ".join(["tl", *(f"lag(tl, {k}) OVER w" for k in lags)])
        parts.append(f"b{n} AS MATERIALIZED (SELECT doc_id, i, tl, {gram} g, {size} gl FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY i))")
        if n <= num_top:
            parts.append(f"s{n} AS (SELECT doc_id, max(s) v FROM (SELECT doc_id, g, sum(gl) s FROM b{n} WHERE g IS NOT NULL GROUP BY doc_id, g) GROUP BY doc_id)")
        else:
            parts.append(
                f"s{n} AS (SELECT doc_id, sum(CASE WHEN cov THEN tl ELSE 0 END) v FROM (SELECT doc_id, tl, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) cov "
                f"FROM (SELECT *, g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 dup FROM b{n})) GROUP BY doc_id)"
            )
        joins.append(f"LEFT JOIN s{n} ON s{n}.doc_id = d.doc_id")
        cols.append(f"(coalesce(s{n}.v, 0)::DOUBLE / greatest(1, coalesce(total.v, 0)))::FLOAT AS {'top' if n <= num_top else 'dup'}_{n}_gram_char_ratio")
    return f"WITH {TOKENS}, total AS (SELECT doc_id, sum(tl) v FROM tk GROUP BY doc_id), {', '.join(parts)} SELECT d.doc_id, {', '.join(cols)} FROM documents d LEFT JOIN total ON total.doc_id = d.doc_id {' '.join(joins)}"


def minhash(buckets: int, bsize: int, window: int, final: str) -> str:
    a, b, _ = permutations(SEED, buckets * bsize)
    rows = ", ".join(f"({k}, {x}::HUGEINT, {y}::HUGEINT)" for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    gram = " || ".join(["tok || chr(31)", *(f"lag(tok, {k}) OVER w || chr(31)" for k in range(1, window))])
    return f"""WITH {TOKENS}, p(k, a, b) AS (VALUES {rows}),
h AS MATERIALIZED (SELECT DISTINCT doc_id, ('0x' || substr(md5(g), 1, 15))::BIGINT h FROM (SELECT doc_id, {gram} g FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL),
m AS (SELECT doc_id, k, min((a * h + b) % 2305843009213693951) v FROM h, p GROUP BY doc_id, k),
e AS (SELECT d.doc_id, p.k, coalesce(m.v::VARCHAR, '18446744073709551615') v FROM documents d CROSS JOIN p LEFT JOIN m ON m.doc_id = d.doc_id AND m.k = p.k),
q AS (SELECT doc_id, k // {bsize} no, md5(string_agg(v, ',' ORDER BY k)) b FROM e GROUP BY doc_id, k // {bsize})
{final}"""


def scrub() -> str:
    spans = " UNION ALL ".join(
        f"SELECT doc_id, sum(length(gap) + length(hit)) OVER w - length(hit) s, sum(length(gap) + length(hit)) OVER w e FROM (SELECT doc_id, unnest(gaps[1:len(hits)]) gap, unnest(hits) hit, unnest(range(len(hits))) i FROM "
        f"(SELECT doc_id, regexp_split_to_array(text, '{p}') gaps, regexp_extract_all(text, '{p}') hits FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
        for p in SCRUB
    )
    return f"""WITH sp AS ({spans}),
o AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM sp),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) grp FROM o),
g AS (SELECT doc_id, grp, min(s) s, max(e) e FROM n GROUP BY doc_id, grp),
f AS (SELECT g.doc_id, grp, substr(text, (coalesce(lag(e) OVER v, 0) + 1)::BIGINT, (s - coalesce(lag(e) OVER v, 0))::BIGINT) || 'REDACTED' piece, CASE WHEN lead(s) OVER v IS NULL THEN substr(text, (e + 1)::BIGINT) ELSE '' END tail
      FROM g JOIN documents d ON d.doc_id = g.doc_id WINDOW v AS (PARTITION BY g.doc_id ORDER BY grp)),
r AS (SELECT doc_id, string_agg(piece || tail, '' ORDER BY grp) text FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.text, d.text) AS text FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id"""


def tokenize() -> str:
    vocab = ", ".join(f"('{w}', {i + 1})" for i, w in enumerate(VOCAB))
    return f"""WITH v(w, id) AS (VALUES {vocab}),
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z\\s]')) w, unnest(range(len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z\\s]')))) i FROM documents),
x AS (SELECT doc_id, string_agg(coalesce(v.id, 0)::VARCHAR, ' ' ORDER BY i) ids FROM p LEFT JOIN v ON v.w = p.w GROUP BY doc_id)
SELECT d.doc_id, coalesce(x.ids, '') AS ids FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id"""


def fasttext() -> str:
    weights = ", ".join(f"('{w}', {a - b})" for w, (a, b) in WEIGHTS.items() if w != "</s>")
    return f"""WITH w(w, d) AS (VALUES {weights}),
t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n\\r\\t\\v\\f]+')) w FROM documents),
s AS (SELECT doc_id, sum(d) d FROM t JOIN w ON w.w = t.w GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(s.d, 0) + 1 >= 0 THEN '__label__en' ELSE '__label__de' END AS top_label, true AS top_leads, true AS total_is_one FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id"""


def fasttext_scores() -> str:
    weights = ", ".join(f"('{w}', {a}, {b})" for w, (a, b) in WEIGHTS.items() if w != "</s>")
    a, b = WEIGHTS["</s>"]
    return f"""WITH w(w, a, b) AS (VALUES {weights}),
t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n\\r\\t\\v\\f]+')) w FROM documents),
s AS (SELECT doc_id, sum(a) a, sum(b) b, count(*) n FROM t JOIN w ON w.w = t.w GROUP BY doc_id),
m AS (SELECT d.doc_id, 1 / (1 + exp((coalesce(b, 0) + {b} - coalesce(a, 0) - {a})::DOUBLE / (coalesce(n, 0) + 1))) p FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id)
SELECT doc_id, round(greatest(p, 1 - p) + 1e-5, 3) AS top_score, round(p + 1e-5, 3) AS en, round(1 - p + 1e-5, 3) AS de FROM m"""


def minhash_shape() -> str:
    grams = "list_sort(list_distinct(list_transform(range(1, len(toks) - 3), lambda i: array_to_string(toks[i:i + 4], ' '))))"
    return f"""WITH {TOKENS}, g AS (SELECT doc_id, len(toks) < 5 short, CASE WHEN len(toks) < 5 THEN [] ELSE {grams} END grams FROM t)
SELECT doc_id, true AS is_hex, short AS is_constant, min(doc_id) OVER (PARTITION BY grams) AS first_alike FROM g"""


_SCRIPT = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s]+"
ORACLES = {
    "repetition_signals": repetition(),
    "repetition_top_only": repetition(3, 3),
    "repetition_dup_only": repetition(0, 3),
    "minhash_md5": minhash(14, 8, 5, "SELECT doc_id, string_agg(b, '' ORDER BY no) AS minhash FROM q GROUP BY doc_id"),
    "minhash_buckets": minhash(4, 2, 5, "SELECT doc_id, " + ", ".join(f"max(b) FILTER (WHERE no = {k}) AS bucket_{k}" for k in range(4)) + " FROM q GROUP BY doc_id"),
    "minhash_shape": minhash_shape(),
    "stored_sizes": "SELECT doc_id, n + 5 * (n // 32768 + 1) - 2 AS size, round((n::FLOAT / (n + 5 * (n // 32768 + 1) - 2)::FLOAT), 4) AS ratio FROM (SELECT doc_id, strlen(text) n FROM documents)",
    "deflated_bounds": "SELECT doc_id, true AS not_above, true AS not_below, true AS ratio_fits FROM documents",
    "namespace_methods": f"SELECT s.doc_id, len(regexp_extract_all(d.text, '{W}'))::BIGINT AS n_tokens, s.text, r.top_1_gram_char_ratio FROM ({scrub()}) s JOIN ({repetition(1, 1)}) r ON r.doc_id = s.doc_id JOIN documents d ON d.doc_id = s.doc_id",
    "streamed_signals": f"SELECT s.doc_id, len(regexp_extract_all(d.text, '{W}'))::BIGINT AS n_tokens, s.text FROM ({scrub()}) s JOIN documents d ON d.doc_id = s.doc_id",
    "many_signals": f"SELECT s.doc_id, len(regexp_extract_all(d.text, '{W}'))::BIGINT AS n_tokens, s.text AS scrubbed, regexp_replace(regexp_replace(d.text, '{_SCRIPT}', ' ', 'g'), '[\\t\\f\\r \\x0b]+', ' ', 'g') AS normalized FROM ({scrub()}) s JOIN documents d ON d.doc_id = s.doc_id",
    "repeated_text_leads": "SELECT 10::BIGINT AS n_signals, true AS repeated_leads",
    "fasttext_scores": fasttext_scores(),
    "random_columns": "SELECT doc_id, true AS byte_in_range, true AS uuid_valid FROM documents",
    "scrub": scrub(),
    "scrub_native": scrub(),
    "tokenize": tokenize(),
    "fasttext": fasttext(),
    "tokens": f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{W}'), '|') AS tokens FROM documents",
    "normalize": f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '{_SCRIPT}', ' ', 'g'), '\\n', ' ', 'g'), '[\\t\\f\\r \\x0b]+', ' ', 'g') AS text FROM documents",
    "normalize_partial": f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_SCRIPT}', ' ', 'g'), '[\\t\\f\\r \\x0b]+', ' ', 'g') AS text FROM documents",
}
ORACLES["sql_functions"] = f"""SELECT s.doc_id, len(regexp_extract_all(d.text, '{W}'))::INTEGER AS n_tokens, s.text, n.text AS normalized, t.ids, f.top_label, r.top_1_gram_char_ratio, 448::INTEGER AS n_digits, true AS has_size, true AS drawn
FROM ({scrub()}) s JOIN documents d ON d.doc_id = s.doc_id JOIN ({ORACLES["normalize"]}) n ON n.doc_id = s.doc_id JOIN ({tokenize()}) t ON t.doc_id = s.doc_id
JOIN ({fasttext()}) f ON f.doc_id = s.doc_id JOIN ({repetition(1, 1)}) r ON r.doc_id = s.doc_id"""
