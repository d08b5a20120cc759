"""The same results in DuckDB SQL, for the operators whose results SQL can say."""

from __future__ import annotations

import math
import re

from .license_scan import NOT_WORD, PHRASES, TEMPLATES, template_words, words_needed
from .secret_scan import ACCESS, ALPHABET, ASSIGN, BACKING, CANDIDATE, HEX, IDENTIFIER, KINDS, LEAST_VALUE, MARGIN, SMOOTHING, TOKEN

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {AZ})) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {AZ}) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
common AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
k AS (SELECT l.doc_id, pos, line, common.key IS NOT NULL AND l.doc_id <> common.last AS drops FROM l LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drops) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drops), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""


ARCHIVES = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""


def ngram_join(k: int = 4, percent: int = 85) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(len(ws) - {k - 1}, 1) + 1), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) END) AS sh FROM w),
u AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * shared >= {percent} * (na + nb - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(sh) AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_scan(threshold: float = 0.8) -> str:
    places = [
        f"list_filter(range(1, len(w) - {len(ws)} + 2), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(ws)) + f") AS p{n}"
        for n, ws in enumerate(p.split() for p, _ in PHRASES)
    ]
    # label, distinct words, how many are needed, and the words that a notice may take: its template's and a quarter more
    sets = [(label, template_words(text), math.ceil(len([w for w in re.split(NOT_WORD, text.lower()) if w]) * 1.25 - 1e-9)) for label, text in TEMPLATES]
    rows = ", ".join(f"({i}, '{label}', {_list(ws)}, {words_needed(ws, threshold)}, {span})" for i, (label, ws, span) in enumerate(sets))
    starts = " || ".join(f"p{n}" for n in range(len(PHRASES)))
    base = "[" + ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, (_, label) in enumerate(PHRASES)) + "]"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH t(id, label, ws, need, span) AS (VALUES {rows}),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{word}') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {', '.join(places)} FROM d),
n AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS pos FROM d),
o AS (SELECT doc_id, id, label, len(ws) AS size, need, span, pos, x FROM n JOIN (SELECT *, unnest(ws) AS x FROM t) USING (x)),
l AS (SELECT doc_id, label, size, need, len(list_distinct(list(x) OVER (PARTITION BY doc_id, id ORDER BY pos RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING))) AS n FROM o),
h AS (SELECT doc_id, label, n / size AS share FROM l WHERE n >= need),
m AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM h GROUP BY doc_id),
b AS (SELECT doc_id, n_words, {starts} AS starts, list_filter({base}, lambda x: x IS NOT NULL) AS base FROM p)
SELECT b.doc_id, n_words, len(starts) AS n_base, list_min(starts) - 1 AS first_word, list_max(starts) - 1 AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN m USING (doc_id)
"""


def mixing(seed: int = 42, limit: int = 3) -> str:
    size = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    return f"""
WITH d AS (SELECT doc_id, source, {size} AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY {limit} * source_size / w, source IS NULL, source) AS n FROM s),
r AS (SELECT *, sum(source_size) OVER () - coalesce(sum({limit} * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS have,
  sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM o),
c AS (SELECT min(n) AS cut FROM r WHERE have * w <= {limit} * source_size * heavy),
t AS (SELECT source, source_size, CASE WHEN n >= cut THEN (have0 * w)::DOUBLE / heavy0 ELSE ({limit} * source_size)::DOUBLE END AS target
  FROM r, c, (SELECT have AS have0, heavy AS heavy0 FROM r, c WHERE n = cut)),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM t),
f AS (SELECT d.*, q.source_size, q.target, CASE WHEN q.source_size > 0 THEN words // q.source_size ELSE 0 END AS full_, CASE WHEN q.source_size > 0 THEN words % q.source_size ELSE 0 END AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (SELECT *, upto <= rest AS extra, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM f),
x AS (SELECT *, row_number() OVER (PARTITION BY source, extra OR NOT abs(size - gap) < gap ORDER BY abs(size - gap), key, doc_id, size) AS nth FROM e)
SELECT doc_id, size, source_size, target, (size * (full_ + CASE WHEN rest > 0 AND (extra OR (abs(size - gap) < gap AND nth = 1)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""


def secret_scan() -> str:
    quoted = lambda p: p.replace("'", "''")
    assign, token = quoted(ASSIGN), quoted(TOKEN)
    candidate = f"{token}{{{CANDIDATE},}}"
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda s: length(s))), 0)"
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, unnest(range(1, len(m) + 1)) AS i, p, m, v FROM (SELECT doc_id, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}') AS m, "
        f"regexp_extract_all(text, '{p}', {g}) AS v FROM d WHERE regexp_matches(text, '{p}'))"
        for k, p, g in ((1, assign, 2), (2, ACCESS, 0), (3, HEX, 0), (4, candidate, 0))
    )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    listed = f"string_agg({names}[kind] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT true AS random, unnest(regexp_extract_all(v, '{candidate}')) AS word
  FROM (SELECT unnest(regexp_extract_all(text, '{assign}', 2) || regexp_extract_all(text, '{ACCESS}') || regexp_extract_all(text, '{HEX}')) AS v FROM d)
  UNION ALL SELECT false, unnest(regexp_extract_all(regexp_replace(text, '{assign}|{ACCESS}|{HEX}', ' ', 'g'), '{token}{{{IDENTIFIER},}}')) FROM d),
pairs AS MATERIALIZED (SELECT random, substr(word, i, 2) AS pair, count(*) AS n FROM (SELECT random, word, unnest(range(1, length(word))) AS i FROM w WHERE regexp_matches(word, '[A-Za-z]')) GROUP BY ALL),
firsts AS (SELECT random, pair[1] AS a, sum(n) AS n FROM pairs GROUP BY ALL),
seconds AS (SELECT random, pair[2] AS b, sum(n) AS n FROM pairs GROUP BY ALL),
alls AS (SELECT random, sum(n) AS n FROM pairs GROUP BY ALL),
letters AS (SELECT unnest(string_split('{ALPHABET}', '')) AS c),
shares AS (
  SELECT r.random, a.c || b.c AS pair,
    (coalesce(p.n, 0) + {BACKING} * ((coalesce(s.n, 0) + {SMOOTHING}::DOUBLE) / (coalesce(t.n, 0) + {SMOOTHING} * {len(ALPHABET)}))) / (coalesce(f.n, 0) + {BACKING}) AS share
  FROM letters a CROSS JOIN letters b CROSS JOIN (VALUES (true), (false)) r(random)
  LEFT JOIN pairs p ON p.random = r.random AND p.pair = a.c || b.c LEFT JOIN firsts f ON f.random = r.random AND f.a = a.c
  LEFT JOIN seconds s ON s.random = r.random AND s.b = b.c LEFT JOIN alls t ON t.random = r.random),
weights AS MATERIALIZED (SELECT s.pair, round(1000 * (ln(0.5 * s.share + 0.5 / {len(ALPHABET)}) - ln(o.share)))::BIGINT AS weight FROM shares s JOIN shares o ON s.pair = o.pair AND s.random AND NOT o.random),
f AS ({found}),
spans AS MATERIALIZED (SELECT doc_id, kind, ({size('p[1:i]')} + {size('m[1:i - 1]')})::BIGINT AS start, length(m[i]) AS size, v[i] AS value FROM f),
likely AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, value, unnest(range(1, length(value))) AS i FROM spans WHERE kind = 4 AND regexp_matches(value, '[A-Za-z]')) JOIN weights ON pair = substr(value, i, 2)
  GROUP BY doc_id, start HAVING sum(weight) >= {MARGIN} * count(*)),
kept AS (
  SELECT doc_id, kind, start, start + size AS stop FROM spans WHERE kind IN (2, 3) OR kind = 1 AND length(value) >= {LEAST_VALUE}
  UNION ALL SELECT doc_id, kind, start, start + size FROM spans SEMI JOIN likely USING (doc_id, start) WHERE kind = 4)
SELECT d.doc_id, count(*) FILTER (kind = 1) AS n_assign, count(*) FILTER (kind = 2) AS n_access, count(*) FILTER (kind = 3) AS n_hex,
  sha256(coalesce({listed} FILTER (kind < 4), '')) AS base_sha256, coalesce({listed}, '') AS spans
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


def lexical_search(k: int = 20) -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH t AS (SELECT doc_id, {terms} AS ts FROM documents),
d AS MATERIALIZED (SELECT doc_id, len(ts) AS n, ts FROM t WHERE len(ts) > 0),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf CROSS JOIN c GROUP BY term),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM d CROSS JOIN c),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}
"""
