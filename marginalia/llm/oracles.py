"""SQL for DuckDB of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from marginalia.llm import licenses

# A-Z and a-z; the contracts lower-case ASCII letters only.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}')"


#: All pairs of documents that share a shingle, compared on full sets, then components by label propagation.
OP1 = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM t),
n AS MATERIALIZED (SELECT t.doc_id, count(s) AS n FROM t LEFT JOIN g ON g.doc_id = t.doc_id GROUP BY t.doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
cc(doc_id, c) USING KEY (doc_id) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.a, min(f.c) FROM cc f JOIN e ON e.b = f.doc_id JOIN recurring.cc r ON r.doc_id = e.a WHERE f.c < r.c GROUP BY e.a)
SELECT n.doc_id, n.n AS n_shingles, c AS component_id, c = n.doc_id AS kept FROM n JOIN cc ON cc.doc_id = n.doc_id"""

#: Payloads grouped by value; base 32 from the hexadecimal digest, five digits to four letters.
OP2 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, lower(trim(coalesce(url, ''))) AS u FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
x AS (SELECT p.*, first, sha1(p.h) AS hex, split_part(regexp_replace(u, '^[a-z][a-z0-9+.-]*://', ''), '#', 1) AS rest FROM p JOIN f ON f.h = p.h),
k AS (SELECT *, regexp_replace(regexp_replace(split_part(rest, '/', 1), ':(80|443)$', ''), '^www[0-9]*\\.', '') AS host, CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/') + 1) ELSE '' END AS tail FROM x)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * (i // 4) + 1)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')/' || regexp_replace(split_part(tail, '?', 1), '/+$', '') || CASE WHEN contains(tail, '?') THEN '?' || array_to_string(list_sort(string_split(substr(tail, strpos(tail, '?') + 1), '&')), '&') ELSE '' END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM k"""

_TEMPLATES = ", ".join(f"({n}, '{label}', {str(n < len(licenses.BASE)).lower()}, '{phrase}')" for n, (phrase, label) in enumerate([*licenses.BASE.items(), *licenses.NOTICES.items()]))
_K = licenses.K
_GRAM = "w[{0}] || ' ' || w[{0} + 1] || ' ' || w[{0} + 2]"
#: The same votes by the words themselves instead of their hashes.
OP7 = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({_lower("text")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
tw AS (SELECT template, label, is_base, string_split(phrase, ' ') AS w FROM (VALUES {_TEMPLATES}) AS v(template, label, is_base, phrase)),
tg AS MATERIALIZED (SELECT template, label, is_base, len(w) AS size, i - 1 AS place, {_GRAM.format("i")} AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM tw)),
g AS (SELECT doc_id, i - 1 AS pos, {_GRAM.format("i")} AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
v AS MATERIALIZED (SELECT doc_id, template, label, is_base, size, pos - place AS diagonal, list(DISTINCT place) AS ats FROM g JOIN tg USING (gram) GROUP BY ALL),
j AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {licenses.NEIGHBOUR} THEN 1 ELSE 0 END AS jumped FROM v WHERE NOT is_base WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
i AS (SELECT *, sum(jumped) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM j),
m AS (SELECT doc_id, label, size, len(list_distinct(flatten(list(ats)))) / (size - {_K - 1}) AS share, max(diagonal + list_max(ats) + {_K}) - min(diagonal + list_min(ats)) AS width FROM i GROUP BY doc_id, template, label, size, island),
found AS (SELECT doc_id, label, true AS is_base, diagonal AS first_word, 1.0::DOUBLE AS score FROM v WHERE is_base AND len(ats) = size - {_K - 1}
  UNION ALL SELECT doc_id, label, false, NULL, share FROM m WHERE CASE WHEN size <= {licenses.SHORT} THEN share >= 1 ELSE share >= {licenses.SHARE} END AND width <= 1.5 * size + {licenses.NEIGHBOUR}),
a AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(first_word) FILTER (is_base) AS first_word, max(first_word) FILTER (is_base) AS last_word, array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (is_base), [])), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score FROM found GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM w LEFT JOIN a ON a.doc_id = w.doc_id"""

#: The given pages hold their text in one article element without inner blocks of other kinds; its mark-up goes by patterns.
OP10 = r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS h FROM pages),
p AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(?:p|h1|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS h FROM a),
t AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM p)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""

#: Every run of words counted by its words; a phrase's contiguous parts from its list of words.
OP11 = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower("text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, (len(w) - k + 2)::BIGINT), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k AS size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, size, f AS a, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
s AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
i AS (SELECT lang, f, unnest(list_concat([array_to_string(w[j:j + 1], ' ') for j in range(1, size)], [array_to_string(w[j:j + 2], ' ') for j in range(1, size - 1) if size = 4])) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 3)),
m AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY ALL),
k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 80 * a))
SELECT k.lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM k JOIN t ON t.lang = k.lang WHERE rank <= 2000"""

#: Every kept term in every group, without grouping by vectors.
OP12 = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_lower("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
k AS MATERIALIZED (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
o AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
e AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN k ON k.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
t AS (SELECT lang, source, sum(n) AS t FROM e GROUP BY ALL),
p AS MATERIALIZED (SELECT e.lang, e.source, e.term, e.n, (1 + (1000000000::HUGEINT * (e.n + 5)::HUGEINT) // (t.t + 5 * v.v)::HUGEINT)::BIGINT AS p FROM e JOIN t ON t.lang = e.lang AND t.source = e.source JOIN v ON v.lang = e.lang),
q AS (SELECT x.lang, x.term, (1 + (1000000000::HUGEINT * (x.n + 5)::HUGEINT) // (y.t + 5 * v.v)::HUGEINT)::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM e GROUP BY ALL) x JOIN (SELECT lang, sum(t) AS t FROM t GROUP BY lang) y ON y.lang = x.lang JOIN v ON v.lang = x.lang),
g AS (SELECT DISTINCT lang, source FROM d),
r AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM r UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u) WHERE part = 'pair' OR rank <= 50"""

#: Every window by its words, with the first document in which it starts.
OP13 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(range(1, (len(w) - 11)::BIGINT)) AS i, unnest(list_transform(range(1, (len(w) - 11)::BIGINT), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) AS s FROM d WHERE len(w) >= 13),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
c AS (SELECT g.doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM g JOIN f ON f.s = g.s WHERE first < g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(coalesce(gone, []))::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i] for i in range(1, (len(w) + 1)::BIGINT) if NOT list_contains(gone, i)] END, ' ')) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id"""

ORACLES = {"op1_minhash": OP1, "op2_warc": OP2, "op7_licenses": OP7, "op10_html": OP10, "op11_phrases": OP11, "op12_divergence": OP12, "op13_repeats": OP13}
