"""Queries over scalar functions, spans and vectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import cites, spans, text, vectors
from marginalia.plans import tables as T

CATALOG: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return keep


# White space in DuckDB's patterns, and word count and content words in its SQL.
_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_CONTENT = r"list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z''\-]+'), lambda x: lower(x)), lambda x: len(x) > 2 AND NOT list_contains(" + _STOP + ", x)))"


@query("identifier", "SELECT p_partkey AS id, regexp_replace(lower(coalesce(p_type, '')), '[^a-z0-9]', '', 'g') AS norm FROM part")
def _(spark, d):
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.identifier(F.col("p_type")).alias("norm"))


@query("url_normalize", r"SELECT page_id, regexp_replace(split_part(lower(trim(url)), '#', 1), '/+$', '') AS url_norm FROM pages")
def _(spark, d):
    return T.read(spark, d, "pages").select("page_id", text.url_normal(F.col("url")).alias("url_norm"))


@query("html_escape", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM documents")
def _(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.md5(text.html_escape(F.col("text")).cast("binary")).alias("escaped_md5"))


_PATH = "n_name || CASE n_nationkey % 4 WHEN 0 THEN ' > ' WHEN 1 THEN ' › ' WHEN 2 THEN ', ' ELSE '' END || r_name || CASE WHEN n_nationkey % 4 = 0 THEN ' >  > x, y' ELSE '' END"


@query("header_path", f"""WITH p AS (SELECT n_nationkey, {_PATH} AS p FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, array_to_string(list_filter(list_transform(
  CASE WHEN contains(p, ' > ') THEN string_split(p, ' > ') WHEN contains(p, ' › ') THEN string_split(p, ' › ') WHEN contains(p, '›') THEN string_split(p, '›') WHEN contains(p, ',') THEN string_split(p, ',') ELSE [p] END,
  lambda x: trim(x)), lambda x: x <> ''), ' › ') AS path FROM p""")
def _(spark, d):
    joined = T.read(spark, d, "nation").join(T.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", text.breadcrumb(text.header_path(F.expr(_PATH))).alias("path"))


@query("heading_side", """WITH h AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '---' || o_orderpriority WHEN 1 THEN 'The Negative ' || o_orderpriority WHEN 2 THEN 'AFF' WHEN 3 THEN '  ' ELSE NULL END AS h FROM orders),
b AS (SELECT o_orderkey, trim(replace(coalesce(h, ''), '---', '')) AS b FROM h)
SELECT o_orderkey, CASE WHEN contains(lower(b), 'negative') OR lower(b) = 'neg' THEN 'Neg' WHEN contains(lower(b), 'affirmative') OR lower(b) = 'aff' THEN 'Aff' WHEN b = '' THEN 'Other' ELSE b END AS side FROM b""")
def _(spark, d):
    h = F.expr("CASE o_orderkey % 5 WHEN 0 THEN '---' || o_orderpriority WHEN 1 THEN 'The Negative ' || o_orderpriority WHEN 2 THEN 'AFF' WHEN 3 THEN '  ' ELSE NULL END")
    return T.read(spark, d, "orders").select("o_orderkey", text.heading_side(h).alias("side"))


@query("snippet", """WITH h AS (SELECT doc_id, text, instr(lower(text), 'tion') AS pos, length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN pos > 0 THEN (CASE WHEN pos - 1 - 60 > 0 THEN '…' ELSE '' END) || substr(text, greatest(0, pos - 61) + 1, least(n, pos - 1 + 4 + 180) - greatest(0, pos - 61)) || (CASE WHEN pos - 1 + 4 + 180 < n THEN '…' ELSE '' END)
  ELSE substr(text, 1, 240) || CASE WHEN n > 240 THEN '…' ELSE '' END END AS snip FROM h""")
def _(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), F.lit("tion")).alias("snip"))


@query("minutes", "SELECT l_orderkey, l_linenumber, (greatest(0, s) // 60)::VARCHAR || ':' || lpad((greatest(0, s) % 60)::VARCHAR, 2, '0') AS mmss FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 7 % 4000 - 100)::BIGINT AS s FROM lineitem)")
def _(spark, d):
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.minutes((F.col("l_partkey") * 7) % 4000 - 100).alias("mmss"))


@query("safe_filename", r"SELECT page_id, CASE WHEN f = '' THEN 'workspace' ELSE f END || '.docx' AS filename FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS f FROM pages)")
def _(spark, d):
    return T.read(spark, d, "pages").select("page_id", text.safe_filename(F.col("url")).alias("filename"))


_NEXT = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '/' || page_id::STRING WHEN 2 THEN '//evil.example' WHEN 3 THEN '/login?x=1' WHEN 4 THEN NULL ELSE '/a?next=/login' END"


@query("safe_redirect", f"""SELECT page_id, CASE WHEN r IS NOT NULL AND starts_with(r, '/') AND NOT starts_with(r, '//') AND NOT starts_with(r, '/\\') AND regexp_replace(split_part(r, '?', 1), '/+$', '') NOT IN ('/login', '/register', '/logout') THEN r ELSE '/workspaces' END AS safe
FROM (SELECT page_id, {_NEXT.replace('STRING', 'VARCHAR')} AS r FROM pages)""")
def _(spark, d):
    return T.read(spark, d, "pages").select("page_id", text.safe_redirect(F.expr(_NEXT)).alias("safe"))


_FILE = "c_name || '-' || c_mktsegment || '-' || CASE WHEN c_custkey % 7 = 0 THEN 'Side' WHEN c_custkey % 2 = 0 THEN 'Aff' ELSE 'Neg' END || '-' || CASE c_custkey % 5 WHEN 0 THEN '01---The-Cup-Round-' || (c_custkey % 9)::STRING WHEN 1 THEN '3.-Open-Finals' WHEN 2 THEN 'State-semis' WHEN 3 THEN '12-Plain-Name' ELSE 'Solo' END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.docx' END"


@query("disclosure_name", f"""WITH f AS (SELECT c_custkey, regexp_replace({_FILE.replace('STRING', 'VARCHAR').replace("c_name", "replace(c_name, '#', '')").replace("'-'", "'-'")}, '\\.docx$', '') AS stem FROM customer WHERE NOT contains(replace(c_name, '#', ''), '-')),
p AS (SELECT c_custkey, string_split(stem, '-') AS a, stem FROM f),
r AS (SELECT c_custkey, a[1] AS school, a[2] AS team, a[3] AS side, array_to_string(a[4:], '-') AS rest FROM p WHERE len(a) >= 4 AND a[3] IN ('Aff', 'Neg')),
b AS (SELECT *, nullif(regexp_extract(rest, '^(\\d{{1,3}})\\.?(---|--|-)(.+)$', 1), '') AS sort_prefix, CASE WHEN regexp_matches(rest, '^\\d{{1,3}}\\.?(---|--|-).+$') THEN regexp_extract(rest, '^\\d{{1,3}}\\.?(---|--|-)(.+)$', 2) ELSE rest END AS body FROM r)
SELECT c_custkey, school, team, side,
  trim(replace(CASE WHEN regexp_matches(body, '^.+?-Round-\\d+$') THEN regexp_extract(body, '^(.+?)-Round-\\d+$', 1) WHEN regexp_matches(body, '(?i)^.+?-({'|'.join(text.ROUNDS)})$') THEN regexp_extract(body, '(?i)^(.+?)-({'|'.join(text.ROUNDS)})$', 1) ELSE body END, '-', ' ')) AS tournament,
  CASE WHEN regexp_matches(body, '^.+?-Round-\\d+$') THEN 'Round ' || regexp_extract(body, '^(.+?)-Round-(\\d+)$', 2) WHEN regexp_matches(body, '(?i)^.+?-({'|'.join(text.ROUNDS)})$') THEN regexp_extract(body, '(?i)^(.+?)-({'|'.join(text.ROUNDS)})$', 2) END AS round_name, sort_prefix FROM b""")
def _(spark, d):
    c = T.read(spark, d, "customer").withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit("")))
    c = c.where(~F.contains("c_name", F.lit("-"))).select("c_custkey", text.disclosure_name(F.expr(_FILE)).alias("m"))
    return c.where("m is not null").select("c_custkey", "m.*")


_TAG = "CASE doc_id % 6 WHEN 0 THEN 'BLOCK---' || text WHEN 1 THEN '[a] ' || text WHEN 2 THEN '2. ' || source || ' and three words' WHEN 3 THEN source WHEN 4 THEN 'SCREAMING CAPITALS ' || text || '.' ELSE '' END"
_SCORE = rf"""CASE WHEN coalesce(tag, '') = '' THEN 0.0 ELSE greatest(0.0, least(1.0, 0.5::DOUBLE + CASE WHEN contains(tag, '---') THEN -0.4::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(tag, '^\s*\[[^\]]{{0,4}}\]\s') THEN -0.25::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(tag, '^\s*\d{{1,2}}[.)\-]\s') THEN -0.15::DOUBLE ELSE 0 END + CASE WHEN trim(tag) = source THEN -0.3::DOUBLE ELSE 0 END
  + CASE WHEN n BETWEEN 6 AND 30 THEN 0.2::DOUBLE WHEN n < 4 THEN -0.15::DOUBLE WHEN n > 50 THEN -0.1::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(tag, '^\p{{Lu}}') THEN 0.05::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(tag, '[.?!”"]$') THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(regexp_split_to_array(tag, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z]{{6,}}$'))) >= 2 THEN -0.15::DOUBLE ELSE 0 END)) END"""


@query("score_tag", rf"SELECT doc_id, round({_SCORE}, 6)::DOUBLE AS score FROM (SELECT doc_id, source, tag, {_WORDS.format('tag')} AS n FROM (SELECT doc_id, source, {_TAG} AS tag FROM documents))")
def _(spark, d):
    docs = T.read(spark, d, "documents")
    return docs.select("doc_id", F.round(text.tag_quality(F.expr(_TAG), F.concat("source", F.lit(".docx"))), 6).alias("score"))


_CITE = "CASE p_partkey % 6 WHEN 0 THEN 'Smith ' || (p_size % 100)::STRING WHEN 1 THEN 'Van Der Berg et al., 1999' WHEN 2 THEN 'x' WHEN 3 THEN p_name || ' and a long heading that goes on ' || p_type || ' for sixty' WHEN 4 THEN 'Jones and Clark 0' || (p_size % 10)::STRING ELSE NULL END"


@query("score_cite", rf"""WITH c AS (SELECT p_partkey, trim({_CITE.replace('STRING', 'VARCHAR')}) AS c, 1900 + p_size AS y FROM part)
SELECT p_partkey, round(CASE WHEN coalesce(c, '') = '' THEN 0.0 ELSE greatest(0.0, least(1.0, 0.5::DOUBLE + CASE WHEN regexp_matches(c, '^[A-Z][A-Za-z''\-]+(\s+(et al\.?|and\s+[A-Z][A-Za-z''\-]+))?,?\s*''?\d{{2,4}}') THEN 0.3::DOUBLE ELSE -0.1::DOUBLE END
  + CASE WHEN NOT regexp_matches(c, '\d') THEN -0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(c, '(^|[^A-Za-z0-9_])(' || lpad((y % 100)::VARCHAR, 2, '0') || '|' || y::VARCHAR || ')([^A-Za-z0-9_]|$)') THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN len(regexp_extract_all(c, '[A-Za-z][A-Za-z''\-]+')) >= 3 THEN 0.07::DOUBLE ELSE 0 END + CASE WHEN length(c) > 60 THEN -0.15::DOUBLE ELSE 0 END + CASE WHEN length(c) < 4 THEN -0.2::DOUBLE ELSE 0 END)) END, 6)::DOUBLE AS score FROM c""")
def _(spark, d):
    return T.read(spark, d, "part").select("p_partkey", F.round(text.cite_quality(F.expr(_CITE), 1900 + F.col("p_size")), 6).alias("score"))


@query("tag_tokens", rf"SELECT doc_id, array_to_string(list_sort({_CONTENT.format('text')}), ' ') AS tokens FROM documents")
def _(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(text.content_words(F.col("text"))), " ").alias("tokens"))


_RAW = "CASE p_partkey % 5 WHEN 0 THEN 'Smith et al. ''' || lpad((p_size % 100)::STRING, 2, '0') || ' (professor of ' || p_type || ' at the ' || p_brand || ' school, \"' || p_name || ' on things\", https://x.example/' || p_partkey::STRING || ').' WHEN 1 THEN 'Jones and Clark ' || (1950 + p_size)::STRING || ', “' || p_name || ' again and again”' WHEN 2 THEN 'no author here at all ' || p_name WHEN 3 THEN 'Lee 3/14/' || (10 + p_size)::STRING ELSE 'Brown, 1776 and 2024;' END"


@query("cite_year", r"""WITH c AS (SELECT p_partkey, """ + _RAW.replace("STRING", "VARCHAR") + r""" AS raw FROM part),
y AS (SELECT p_partkey, raw, list_filter(list_transform(regexp_extract_all(raw, '(?:^|[^0-9])(\d{4})(?:[^0-9]|$)', 1), lambda x: x::INTEGER), lambda x: x BETWEEN 1900 AND 2030) AS four, regexp_extract(raw, '[''’](\d{2})', 1) AS two, regexp_extract(raw, '\b(\d{1,2})[/\-](\d{1,2})[/\-]?(\d{2,4})?', 3) AS day FROM c)
SELECT p_partkey, (CASE WHEN len(four) > 0 THEN four[1] WHEN two <> '' THEN CASE WHEN two::INTEGER < 50 THEN 2000 + two::INTEGER ELSE 1900 + two::INTEGER END WHEN day <> '' THEN CASE WHEN length(day) = 4 THEN day::INTEGER ELSE 2000 + day::INTEGER END END)::INTEGER AS year,
  nullif(regexp_replace(regexp_extract(raw, 'https?://[^\s)\]\\"<>]+'), '[.,;)\\\]]+$', ''), '') AS url FROM y""")
def _(spark, d):
    return T.read(spark, d, "part").select("p_partkey", cites.parse_cite(F.expr(_RAW)).alias("c")).select("p_partkey", "c.year", "c.url")


# The cite patterns as DuckDB writes them: its word characters are ASCII, as these cites are.
_SHORT = cites.SHORT.replace("(?U)", "").replace("'", "''")
_NAMES = cites.NAMES.replace("'", "''")


@query("cite_parse", rf"""WITH c AS (SELECT p_partkey, trim({_RAW.replace("STRING", "VARCHAR")}) AS raw, 0 AS z FROM part),
m AS (SELECT *, regexp_extract(raw, '{_SHORT}', 1) AS hit, array_to_string(list_filter(string_split(regexp_replace(raw, '\s+', ' ', 'g'), ' '), lambda w: w <> '')[1:4], ' ') AS few, regexp_replace(regexp_extract(raw, '^({_NAMES})', 1), '^[ ,]+|[ ,]+$', '', 'g') AS names,
  regexp_replace(regexp_extract(raw, 'https?://[^\s)\]\\"<>]+'), '[.,;)\\\]]+$', '') AS url, regexp_extract_all(raw, '[“"]([^“”"]{{8,300}})[”"]', 1) AS titles, regexp_extract(raw, '[(\[]([^()\[\]]{{20,1000}}[^()\[\]]{{0,500}})[)\]]', 1) AS inside,
  list_filter(list_transform(regexp_extract_all(raw, '(?:^|[^0-9])(\d{{4}})(?:[^0-9]|$)', 1), lambda x: x::INTEGER), lambda x: x BETWEEN 1900 AND 2030) AS four, regexp_extract(raw, '[''’](\d{{2}})', 1) AS two, regexp_extract(raw, '\b(\d{{1,2}})[/\-](\d{{1,2}})[/\-]?(\d{{2,4}})?', 3) AS day FROM c),
s AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN hit <> '' THEN hit ELSE few END, '\s+', ' ', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g') AS short, coalesce(titles[list_position(list_transform(titles, lambda t: length(t)), list_max(list_transform(titles, lambda t: length(t))))], '') AS title FROM m)
SELECT p_partkey, CASE WHEN short = '' THEN '(unknown)' ELSE short END AS cite_short, coalesce(nullif(regexp_replace(CASE WHEN names <> '' THEN names ELSE string_split(short, ' ')[1] END, '\s+and\s+', ' & ', 'g'), ''), '(unknown)') AS author,
  (CASE WHEN len(four) > 0 THEN four[1] WHEN two <> '' THEN CASE WHEN two::INTEGER < 50 THEN 2000 + two::INTEGER ELSE 1900 + two::INTEGER END WHEN day <> '' THEN CASE WHEN length(day) = 4 THEN day::INTEGER ELSE 2000 + day::INTEGER END END)::INTEGER AS year, nullif(url, '') AS url, nullif(title, '') AS title,
  nullif(regexp_replace(regexp_replace(replace(replace(CASE WHEN url <> '' THEN replace(inside, url, '') ELSE inside END, CASE WHEN title <> '' THEN '"' || title || '"' ELSE '§none§' END, ''), CASE WHEN title <> '' THEN '“' || title || '”' ELSE '§none§' END, ''), '\s+', ' ', 'g'), '^[ ,.;]+|[ ,.;]+$', '', 'g'), '') AS qualifications, raw AS raw_cite FROM s""")
def _(spark, d):
    return T.read(spark, d, "part").select("p_partkey", cites.parse_cite(F.expr(_RAW)).alias("c")).select("p_partkey", "c.*")


_LOOSE = "CASE p_partkey % 8 WHEN 0 THEN 'Smith,  ' || (p_size % 100)::STRING WHEN 1 THEN 'Jones ET. AL 0' || (p_size % 10)::STRING || ' ,; ' WHEN 2 THEN 'Clark and Park, 19' WHEN 3 THEN 'Mark  Smith 22' WHEN 4 THEN 'Bartholomew Lee, ' || p_size::STRING WHEN 5 THEN 'Lee et al 7' WHEN 6 THEN 'Brown 3/14/' || (10 + p_size)::STRING ELSE p_name || ', ' END"
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, ',\s+', ' ', 'g'), '(?i)\bet\.\s+al\b', 'et al.', 'g'), '[,;\s]+$', ''), '\s+', ' ', 'g'))"""


@query("clean_cite", rf"""WITH c AS (SELECT p_partkey, regexp_replace({_CLEAN.format(_LOOSE.replace("STRING", "VARCHAR"))}, '\b(\w+)\s+and\s+(\w+)\s*,?\s*(\d)', '\1 & \2 \3', 'g') AS c FROM part),
f AS (SELECT p_partkey, c, regexp_extract(c, '^([A-Z][a-z]+)\s+[A-Z][\w''’\-]+(?:\s+(?:&|and|et\s+al\.?)\s+[A-Z][\w''’\-]+)?\s*[,\s]\s*\S.*$', 1) AS first, regexp_replace(c, '^[A-Z][a-z]+\s+([A-Z][\w''’\-]+(?:\s+(?:&|and|et\s+al\.?)\s+[A-Z][\w''’\-]+)?)\s*[,\s]\s*(\S.*)$', '\1 \2') AS rest FROM c),
o AS (SELECT p_partkey, CASE WHEN first <> '' AND (first IN ({", ".join(f"'{n}'" for n in text.FIRST_NAMES)}) OR length(first) < 8) THEN trim(rest) ELSE c END AS cite FROM f)
SELECT p_partkey, cite, trim(regexp_replace(cite, '\s*[''’]?\d{{1,4}}(?:[/\-]\d{{1,2}}(?:[/\-]\d{{2,4}})?)?$', '')) AS author FROM o""")
def _(spark, d):
    cite = text.cleaned_cite(F.expr(_LOOSE))
    return T.read(spark, d, "part").select("p_partkey", cite.alias("cite"), text.author_without_year(cite).alias("author"))


@query("noisy_tags", rf"SELECT doc_id, tag FROM (SELECT doc_id, {_TAG} AS tag FROM documents) WHERE contains(tag, '<<') OR contains(lower(tag), 'insert') OR regexp_matches(tag, '^[A-Z0-9 ]{{3,15}}---')")
def _(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.expr(_TAG).alias("tag")).where(text.noisy_tag(F.col("tag")))


@query("display", "SELECT doc_id, CASE WHEN length(text) > 90 THEN substr(text, 1, 90) || '…' ELSE text END AS title, printf('%.3f', (doc_id % 997) / 997.0) AS distance FROM documents")
def _(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.shorten(F.col("text"), 90).alias("title"), F.format_string("%.3f", (F.col("doc_id") % 997) / 997.0).alias("distance"))


# Spans: line items as mark-up, in SQL rows (id, s, e, k, line).
_SPANS = "SELECT l_orderkey AS id, l_linenumber AS line, (l_partkey % 100)::INTEGER AS s, (l_partkey % 100 + l_quantity::INTEGER)::INTEGER AS e, CASE WHEN l_returnflag = 'N' THEN 'underline' ELSE 'highlight' END AS k FROM lineitem"
_MERGE = """, g AS (SELECT id, s, e, k, CASE WHEN s <= max(e) OVER (PARTITION BY id, k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {0} WHERE s < e),
h AS (SELECT id, k, s, e, sum(fresh) OVER (PARTITION BY id, k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM g),
m AS (SELECT id, k, min(s)::INTEGER AS start, max(e)::INTEGER AS "end" FROM h GROUP BY id, k, isl)"""


@query("span_normalize", f"WITH x AS ({_SPANS}){_MERGE.format('x')} SELECT id, start, \"end\", k AS kind FROM m")
def _(spark, d):
    return T.span_lists(spark, d).select("id", F.inline(spans.normalize(F.col("spans"))))


@query("span_subtract", f"""WITH x0 AS ({_SPANS}), x AS (SELECT id, s, least(e, 30) AS e, k FROM x0 WHERE s < 30 UNION ALL SELECT id, greatest(s, 60) AS s, e, k FROM x0 WHERE e > 60){_MERGE.format('x')}
SELECT id, start, "end", k AS kind FROM m""")
def _(spark, d):
    return T.span_lists(spark, d).select("id", F.inline(spans.apply_op(F.col("spans"), F.lit("clear"), F.lit(30), F.lit(60), F.lit(None).cast("string"))))


@query("span_union", f"""WITH x AS (SELECT id, s, e, k FROM ({_SPANS}) UNION ALL SELECT DISTINCT l_orderkey, 10, 40, 'underline' FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 90, 95, 'highlight' FROM lineitem){_MERGE.format('x')}
SELECT id, start, "end", k AS kind FROM m""")
def _(spark, d):
    more = F.array(spans.span(10, 40, "underline"), spans.span(90, 95, "highlight"))
    return T.span_lists(spark, d).select("id", F.inline(spans.union(F.col("spans"), more)))


@query("span_add_highlight", f"""WITH x AS (SELECT id, s, e, k FROM ({_SPANS}) UNION ALL SELECT DISTINCT l_orderkey, 20, 50, 'underline' FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 20, 50, 'highlight' FROM lineitem){_MERGE.format('x')}
SELECT id, start, "end", k AS kind FROM m""")
def _(spark, d):
    return T.span_lists(spark, d).select("id", F.inline(spans.apply_op(F.col("spans"), F.lit("add"), F.lit(20), F.lit(50), F.lit("highlight"))))


@query("span_jaccard", f"""WITH x AS (SELECT DISTINCT id, s, e, k FROM ({_SPANS})), a AS (SELECT id, count(*) AS n, count(*) FILTER (k = 'underline') AS u FROM x GROUP BY id)
SELECT id, CASE WHEN u = 0 THEN 0.0 ELSE u / n END::DOUBLE AS j FROM a""")
def _(spark, d):
    lines = F.filter("spans", lambda s: s["kind"] == "underline")
    return T.span_lists(spark, d).select("id", spans.jaccard(F.col("spans"), lines).alias("j"))


@query("span_covers", f"""WITH x AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY line, s, e, k) AS line, s, e, k FROM ({_SPANS})), w AS (SELECT * FROM x WHERE line = 1), l AS (SELECT * FROM x WHERE line > 1)
SELECT o.id, coalesce(bool_and(EXISTS (SELECT 1 FROM w WHERE w.id = l.id AND w.k = l.k AND w.s <= l.s AND w.e >= l.e)) FILTER (l.id IS NOT NULL), true) AS covered FROM (SELECT DISTINCT id FROM x) o LEFT JOIN l ON o.id = l.id GROUP BY o.id""")
def _(spark, d):
    s = F.col("spans")
    return T.span_lists(spark, d).select("id", spans.covers(F.slice(s, 1, 1), F.slice(s, F.lit(2), F.size(s))).alias("covered"))


@query("segment_partition", f"""WITH x AS ({_SPANS}), b AS (SELECT id, 0 AS p FROM x UNION SELECT id, 120 FROM x UNION SELECT id, s FROM x UNION SELECT id, e FROM x),
g AS (SELECT id, p AS a, lead(p) OVER (PARTITION BY id ORDER BY p) AS b FROM b)
SELECT g.id, a::INTEGER AS start, b::INTEGER AS "end", bool_or(k = 'highlight') AS highlighted, bool_or(k = 'underline') AS underlined
FROM (SELECT g.id, g.a, g.b, x.k FROM g LEFT JOIN x ON x.id = g.id AND x.s <= g.a AND x.e >= g.b WHERE g.b IS NOT NULL) g GROUP BY g.id, a, b""".replace("bool_or(k = 'highlight')", "coalesce(bool_or(k = 'highlight'), false)").replace("bool_or(k = 'underline') AS", "coalesce(bool_or(k = 'underline'), false) AS"))
def _(spark, d):
    return T.span_lists(spark, d).select("id", F.inline(spans.segments(F.rpad(F.lit("x"), 120, "x"), F.col("spans"))))


_BODY = "SELECT o_orderkey AS id, repeat('word ' || o_orderstatus || ' & more <of> it ', 8) AS body FROM orders"


@query("speech_stats", f"""WITH x AS ({_SPANS}), b AS ({_BODY}), h AS (SELECT x.id, string_agg(substr(body, s + 1, e - s), ' ' ORDER BY s, line, e) AS t FROM x JOIN b USING (id) WHERE k = 'highlight' GROUP BY x.id),
w AS (SELECT o.id, coalesce({_WORDS.format("coalesce(t, '')")}, 0) AS words FROM (SELECT DISTINCT id FROM x) o LEFT JOIN h USING (id))
SELECT id, words::INTEGER AS words, (CASE WHEN words = 0 THEN 0 ELSE greatest(1, round_even(words * 60 / 270.0, 0)) END)::BIGINT AS seconds FROM w""")
def _(spark, d):
    body = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("repeat('word ' || o_orderstatus || ' & more <of> it ', 8)").alias("body"))
    rows = T.span_lists(spark, d).join(body, "id").withColumn("words", spans.reading_words(F.col("body"), F.col("spans")))
    return rows.select("id", F.col("words").cast("int"), spans.reading_seconds(F.col("words")).alias("seconds"))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_DOTS = "' <span class=\"ellipsis\">…</span> '"


@query("render_modes", f"""WITH x AS ({_SPANS}), b AS ({_BODY}), t AS (SELECT x.*, body, length(body) AS n, row_number() OVER (PARTITION BY x.id ORDER BY line, s, e, k) AS rn FROM x JOIN b USING (id)),
areas AS (SELECT DISTINCT id, 0 AS area, 0 AS lo, n AS hi, body FROM t UNION ALL SELECT id, rn, s, e, substr(body, s + 1, e - s) FROM t WHERE k = 'underline'),
inner_spans AS (SELECT a.id, a.area, t.s, t.e, t.k FROM areas a JOIN t ON t.id = a.id WHERE a.area = 0 UNION ALL SELECT id, area, 0, hi - lo, 'underline' FROM areas WHERE area > 0
  UNION ALL SELECT a.id, a.area, greatest(t.s, a.lo) - a.lo, least(t.e, a.hi) - a.lo, t.k FROM areas a JOIN t ON t.id = a.id AND t.k = 'highlight' WHERE a.area > 0 AND greatest(t.s, a.lo) < least(t.e, a.hi)),
ends AS (SELECT id, area, 0 AS p FROM areas UNION SELECT id, area, length(body) FROM areas UNION SELECT id, area, s FROM inner_spans UNION SELECT id, area, e FROM inner_spans),
cuts AS (SELECT id, area, p AS u, lead(p) OVER (PARTITION BY id, area ORDER BY p) AS v FROM ends),
parts AS (SELECT c.id, c.area, u, v, substr(any_value(a.body), u + 1, v - u) AS chunk, coalesce(bool_or(i.k = 'highlight'), false) AS hl, coalesce(bool_or(i.k = 'underline'), false) AS ul FROM cuts c JOIN areas a ON a.id = c.id AND a.area = c.area LEFT JOIN inner_spans i ON i.id = c.id AND i.area = c.area AND i.s <= u AND i.e >= v WHERE v IS NOT NULL GROUP BY c.id, c.area, u, v),
html AS (SELECT id, area, string_agg(CASE WHEN hl THEN '<mark class="hl">' || {_ESC.format('chunk')} || '</mark>' WHEN ul THEN '<u class="ul">' || {_ESC.format('chunk')} || '</u>' ELSE {_ESC.format('chunk')} END, '' ORDER BY u) AS h FROM parts GROUP BY id, area),
full_ AS (SELECT id, h FROM html WHERE area = 0), lines AS (SELECT h.id, string_agg(coalesce(h.h, ''), {_DOTS} ORDER BY t.s, t.rn) AS h FROM html h JOIN t ON t.id = h.id AND t.rn = h.area GROUP BY h.id),
lights AS (SELECT id, string_agg('<mark class="hl">' || {_ESC.format('substr(body, s + 1, e - s)')} || '</mark>', {_DOTS} ORDER BY s, rn) AS h FROM t WHERE k = 'highlight' GROUP BY id)
SELECT b.id, f.h AS "full", coalesce(g.h, '') AS highlight_only, coalesce(l.h, '') AS underline_only, {_ESC.format('body')} AS plain FROM b JOIN full_ f ON f.id = b.id LEFT JOIN lights g ON g.id = b.id LEFT JOIN lines l ON l.id = b.id""")
def _(spark, d):
    body = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("repeat('word ' || o_orderstatus || ' & more <of> it ', 8)").alias("body"))
    rows = T.span_lists(spark, d).join(body, "id")
    return rows.select("id", *(spans.render(F.col("body"), F.col("spans"), m).alias(m.replace("-", "_")) for m in ("full", "highlight-only", "underline-only", "plain")))


@query("markup_counts", f"SELECT id, count(*) FILTER (k = 'highlight') AS highlights, count(*) FILTER (k = 'underline') AS underlines FROM ({_SPANS}) GROUP BY id")
def _(spark, d):
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return T.span_lists(spark, d).select("id", n("highlight").alias("highlights"), n("underline").alias("underlines"))


@query("cosine_distance", "SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)::DOUBLE AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10")
def _(spark, d):
    e = T.read(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), "label"), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), F.col("label").alias("l2"))
    met = a.join(b, (F.col("label") == F.col("l2")) & (F.col("b") == F.col("a") + 10))
    return met.select("a", "b", F.round(vectors.cosine_distance(F.col("x"), F.col("y")), 6).alias("distance"))
