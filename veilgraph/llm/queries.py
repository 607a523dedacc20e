"""Query registry of this subpackage: one opN_<name> per operator, over whole tables."""

from __future__ import annotations

from veilgraph.llm.op1_line_dedup import op1_line_dedup
from veilgraph.llm.op2_html import op2_html
from veilgraph.llm.op3_sentencepiece import op3_sentencepiece
from veilgraph.llm.op4_wavelet import op4_wavelet
from veilgraph.llm.op5_substring import op5_substring
from veilgraph.llm.op6_decontaminate import op6_decontaminate
from veilgraph.llm.op7_kneser_ney import op7_kneser_ney
from veilgraph.llm.op8_quality_rules import base_rules, op8_quality_rules
from veilgraph.llm.op9_separators import op9_separators
from veilgraph.llm.op10_simhash import op10_simhash
from veilgraph.llm.op11_heap_lloyd import op11_heap_lloyd
from veilgraph.llm.op12_secrets import op12_secrets
from veilgraph.llm.op13_ranked import op13_ranked

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html": op2_html,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_wavelet": op4_wavelet,
    "op5_substring": op5_substring,
    "op6_decontaminate": op6_decontaminate,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_quality_rules": op8_quality_rules,
    "op9_separators": op9_separators,
    "op10_simhash": op10_simhash,
    "op11_heap_lloyd": op11_heap_lloyd,
    "op12_secrets": op12_secrets,
    "op13_ranked": op13_ranked,
    "base_rules": base_rules,
}

_SPACE_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_REPEATS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORDS}') AS ws FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
hit AS (SELECT g.doc_id, g.i FROM g JOIN (SELECT h, min(doc_id) AS low FROM g GROUP BY h) USING (h) WHERE g.doc_id > low),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS k FROM hit)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_HITS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_ALNUM_WORDS}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_ALNUM_WORDS}') AS ws FROM benchmark WHERE item_id IS NOT NULL),
z AS (SELECT item, ws, least(10, len(ws)) AS s FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, s, array_to_string(ws[i : i + s - 1], ' ') AS win FROM (SELECT item, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM z)),
dw AS (SELECT doc_id, s, i, array_to_string(ws[i : i + s - 1], ' ') AS win FROM (SELECT doc_id, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM z) WHERE len(ws) >= s)),
hit AS (SELECT doc_id, i, s, item FROM dw JOIN iw USING (s, win)),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, s)) AS k FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_BASE = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORDS}') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE_WORDS}')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 2], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM r) GROUP BY doc_id),
x AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM t LEFT JOIN c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x"""



def _lloyd(rounds: int) -> str:
    """Plain Lloyd rounds over all parts and entries, without bounds."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT r, k, x, arg_min(e, dist * 1000 + e) AS e, min(dist) AS dist FROM (SELECT r, k, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM p JOIN c{i} USING (k)) GROUP BY r, k, x)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT k, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS c FROM (SELECT k, e, j, sum(x[j]) AS s, count(*) AS n FROM d{i}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS j) GROUP BY k, e, j) GROUP BY k, e),
c{i + 1} AS MATERIALIZED (SELECT k, e, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k, e))""")
    return ",\n".join(steps)


_CODES = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, k, x[k * len(x) // 16 + 1 : (k + 1) * len(x) // 16] AS x FROM v, (SELECT unnest(range(0, 16)) AS k)),
c0 AS MATERIALIZED (SELECT k, r AS e, x AS c FROM p WHERE r < 64),
{_lloyd(2)},
w AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY k) AS code, CAST(sum(dist) AS BIGINT) AS error FROM d2 GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN w USING (r), b"""



def _spans(kind: int, pattern: str, group: int, least: int, base: bool = True) -> str:
    """Matches of a pattern with their places: the lengths of what lies between them and of the matches before."""
    p = pattern.replace("'", "''")
    return f"""SELECT r, doc_id, source, {kind} AS kind, {base} AS base, CAST(list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0) AS INTEGER) AS s, length(ms[i]) AS n, vs[i] AS value
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, doc_id, source, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS gaps FROM t WHERE regexp_matches(text, '{p}'))) WHERE length(vs[i]) >= {least}"""


_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"""({_ANY_CASE})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_PLACEHOLDERS = "example|placeholder|changeme|dummy|sample|yourtoken|yourkey|xxxx|0123456789|1234567890|abcdef0123"
_KINDS = "['assign', 'access', 'hex', 'live'][kind]"
_SECRETS = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
b AS MATERIALIZED ({_spans(1, _ASSIGN, 2, 8)} UNION ALL {_spans(2, "AKIA[A-Z0-9]+", 0, 16)} UNION ALL {_spans(3, "[0-9a-f]+", 0, 32)}),
k AS (SELECT * FROM ({_spans(4, "[A-Za-z0-9_+=-]{20,}", 0, 20, False)}) k WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = k.r AND b.s < k.s + k.n AND k.s < b.s + b.n)),
f AS (SELECT *, regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= 10 AND NOT regexp_matches(lower(value), '{_PLACEHOLDERS}') AS live FROM (FROM b UNION ALL FROM k)),
c AS (SELECT * FROM f WHERE base OR live),
o AS (SELECT value, count(DISTINCT coalesce('.' || split_part(source, '/', 1), '')) AS owners, count(DISTINCT coalesce('.' || source, '')) AS repositories FROM c GROUP BY value),
j AS (SELECT *, owners = 1 AND repositories <= 3 AND live AS own, {_KINDS} || ':' || s || ':' || (s + n) AS span FROM c JOIN o USING (value)),
g AS (SELECT r, count(*) FILTER (kind = 1) AS n_assign, count(*) FILTER (kind = 2) AS n_access, count(*) FILTER (kind = 3) AS n_hex, string_agg(span, ',' ORDER BY s, kind) FILTER (base) AS held, string_agg(span, ',' ORDER BY s, kind) FILTER (base OR own) AS spans, count(*) FILTER (own) AS n_live, count(*) FILTER (owners >= 3) AS n_copied FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(held, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN g USING (r)"""

_RANKED = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_ALNUM_WORDS}') AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(ts)) AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
b AS (SELECT i, item_id, term, count(*) AS qtf FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_ALNUM_WORDS}')) AS term FROM benchmark) GROUP BY i, item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
m AS (SELECT r, doc_id, CAST(75 + (25 * len(ts) * n_docs) // n_terms AS BIGINT) AS m FROM d, s),
x AS (SELECT i, item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score FROM b JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0) WHERE rank <= 20"""

#: DuckDB SQL where it can express the operator; the others are tested against brute force.
ORACLES: dict[str, str] = {"op5_substring": _REPEATS, "op6_decontaminate": _HITS, "base_rules": _BASE, "op11_heap_lloyd": _CODES, "op12_secrets": _SECRETS, "op13_ranked": _RANKED}
