"""Queries over search, hierarchies, lists and relational pages, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import hierarchy as H
from marginalia.operators import lists as L
from marginalia.operators import neighbours as N
from marginalia.operators import search as S
from marginalia.plans import tables as T

CATALOG: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return keep


# The corpus' postings in SQL: source is the A field, text the B field.
_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
_POST = f"""f AS (SELECT doc_id, 1.0::DOUBLE AS weight, {_TOK.format('source')} AS t FROM documents UNION ALL SELECT doc_id, 0.4::DOUBLE, {_TOK.format('text')} FROM documents),
w AS (SELECT doc_id, weight, len(t) AS doc_len, unnest(t) AS term, unnest(range(len(t))) AS pos FROM f),
p AS (SELECT doc_id, term, weight, count(*) AS tf, max(doc_len) AS doc_len FROM w GROUP BY ALL)"""
_RANK = "r AS (SELECT doc_id, sum(weight * (1 + ln(tf)) / (1 + ln(doc_len))) AS rank FROM p WHERE term IN ({0}) GROUP BY doc_id)"
_VEC = "SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7"
_DIST = f"LEFT JOIN (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], list_transform(({_VEC}), lambda x: round(x, 6))) AS distance FROM embeddings) e ON e.vec_id = d.doc_id"
_HYBRID = f"""WITH {_POST}, {_RANK.format("'the', 'ther'")}, hit AS (SELECT DISTINCT doc_id FROM p WHERE term = 'ther' INTERSECT SELECT DISTINCT doc_id FROM p WHERE term = 'the'),
x AS (SELECT d.doc_id, coalesce(rank, 0.0) AS rank, distance, CASE WHEN distance IS NOT NULL THEN 0.5 * coalesce(rank, 0.0) + 0.5 * (1 - distance) ELSE coalesce(rank, 0.0) END AS score
  FROM documents d LEFT JOIN r USING (doc_id) {_DIST} WHERE d.doc_id IN (SELECT doc_id FROM hit) OR distance < 0.6)"""
_SHOWN = "doc_id, round(rank, 6)::DOUBLE AS rank, round(distance, 6)::DOUBLE AS distance, round(score, 6)::DOUBLE AS score"


def _index(spark, d):
    return S.postings(T.read(spark, d, "documents"), "doc_id", {"source": "A", "text": "B"})


def _vector(spark, d) -> list[float]:
    return [float(x) for x in T.read(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]]


def hybrid(spark, d):
    """The flagship: words or nearness, blended order."""
    return S.hybrid(T.cards(spark, d), _index(spark, d), "the ther", _vector(spark, d), radius=0.6)


def _show(df):
    return df.select("doc_id", F.round("rank", 6).alias("rank"), F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("search_hybrid", f"{_HYBRID} SELECT {_SHOWN} FROM x ORDER BY score DESC, doc_id DESC LIMIT 50")
def _(spark, d):
    return _show(S.page(hybrid(spark, d)))


@query("search_page2", f"{_HYBRID} SELECT {_SHOWN} FROM x ORDER BY score DESC, doc_id DESC LIMIT 50 OFFSET 50")
def _(spark, d):
    return _show(S.page(hybrid(spark, d), 2))


@query("search_count", f"{_HYBRID} SELECT count(*) AS total, greatest(1, ceil(count(*) / 50.0))::BIGINT AS pages FROM x")
def _(spark, d):
    return hybrid(spark, d).agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 50)).cast("long"))


@query("search_keyword", rf"""WITH {_POST}, {_RANK.format("'ther', 'anea', 'attion', 'to'")},
ph AS (SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.weight = b.weight AND b.pos = a.pos + 1 WHERE a.term = 'attion' AND b.term = 'to'),
hit AS (SELECT doc_id FROM documents WHERE (doc_id IN (SELECT doc_id FROM p WHERE term = 'ther') OR doc_id IN (SELECT doc_id FROM ph)) AND doc_id IN (SELECT doc_id FROM p WHERE term = 'anea') AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'idiot'))
SELECT doc_id, round(coalesce(rank, 0.0), 6)::DOUBLE AS rank FROM hit LEFT JOIN r USING (doc_id) ORDER BY rank DESC, doc_id DESC LIMIT 50""")
def _(spark, d):
    found = S.hybrid(T.read(spark, d, "documents"), _index(spark, d), 'ther or "attion to" anea -idiot')
    return S.page(found.withColumn("rank", F.round("rank", 6)), order=("rank",)).select("doc_id", "rank")


def _no_provider(texts):
    raise RuntimeError("no network")


# The provider of query vectors fails, so the words alone decide.
@query("search_fallback", f"""WITH {_POST}, {_RANK.format("'the', 'ther'")}, hit AS (SELECT DISTINCT doc_id FROM p WHERE term = 'ther' INTERSECT SELECT DISTINCT doc_id FROM p WHERE term = 'the')
SELECT doc_id, round(rank, 6)::DOUBLE AS rank, NULL::DOUBLE AS distance, round(rank, 6)::DOUBLE AS score FROM hit JOIN r USING (doc_id) ORDER BY score DESC, doc_id DESC LIMIT 50""")
def _(spark, d):
    from marginalia.operators.providers import query_vector

    found = S.hybrid(T.cards(spark, d), _index(spark, d), "the ther", query_vector("the ther", _no_provider), radius=0.6)
    return _show(S.page(found.withColumn("score", F.round("score", 6))))


@query("search_substring_wildcard", "SELECT p_partkey FROM part WHERE p_type ILIKE '%a%n_%' OR p_name ILIKE '%a%n_%'")
def _(spark, d):
    return S.matching_any(T.read(spark, d, "part"), "a%n_", ["p_type", "p_name"]).select("p_partkey")


@query("vector_radius", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], list_transform(({_VEC}), lambda x: round(x, 6))), 6)::DOUBLE AS distance FROM embeddings WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], list_transform(({_VEC}), lambda x: round(x, 6))) < 0.9")
def _(spark, d):
    return S.near_vector(T.read(spark, d, "embeddings"), _vector(spark, d)).where("distance < 0.9").select("vec_id", F.round("distance", 6).alias("distance"))


@query("analyticals_top", f"WITH {_POST}, {_RANK.format("'the'")} SELECT doc_id, round(rank, 6)::DOUBLE AS rank FROM r ORDER BY round(rank, 6) DESC, doc_id DESC LIMIT 20")
def _(spark, d):
    ranked = S.rank(_index(spark, d), S.parse_query("the")).withColumn("rank", F.round("rank", 6))
    return S.page(ranked, order=("rank",), size=20)


@query("postings", f"WITH {_POST} SELECT doc_id, term, weight, tf, doc_len::INTEGER AS doc_len FROM p")
def _(spark, d):
    return S.every_posting(T.read(spark, d, "documents"), "doc_id", {"source": "A", "text": "B"}).drop("positions", "longest")


# Topics: the five regions, the third is current.
def _topics(spark, d):
    return T.read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("slug"), (F.col("r_regionkey") == 2).alias("is_current"))


@query("topic_scope", "SELECT 'current' AS scope, count(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'all', count(*) FROM nation UNION ALL SELECT 'unknown', count(*) FROM nation UNION ALL SELECT 'one', count(*) FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = (SELECT min(r_name) FROM region))")
def _(spark, d):
    n, t = T.read(spark, d, "nation"), _topics(spark, d)
    one = t.agg(F.min("slug")).first()[0]
    parts = [S.scope_topic(n, t, w, "n_regionkey").agg(F.count("*").alias("n")).select(F.lit(k).alias("scope"), "n") for k, w in (("current", None), ("all", "all"), ("unknown", "no such"), ("one", one))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_TAGS = "tags AS (SELECT r_regionkey::BIGINT AS tag_id, NULL::BIGINT AS parent_id, r_name AS label FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name FROM nation)"
_LINKS = "links AS (SELECT c_custkey AS card_id, c_nationkey + 100 AS tag_id FROM customer UNION ALL SELECT c_custkey, c_custkey % 5 FROM customer WHERE c_custkey % 3 = 0)"
_USED = "used AS (SELECT tag_id, (SELECT count(*) FROM links l WHERE l.tag_id = t.tag_id) + (SELECT count(*) FROM supplier s WHERE s.s_nationkey + 100 = t.tag_id) AS own FROM tags t)"
_CLOSE = "c(ancestor, descendant, depth) AS (SELECT tag_id, tag_id, 0 FROM tags UNION ALL SELECT c.ancestor, t.tag_id, c.depth + 1 FROM c JOIN tags t ON t.parent_id = c.descendant)"
_TOTAL = "tot AS (SELECT ancestor AS tag_id, sum(own)::BIGINT AS total FROM c JOIN used ON used.tag_id = c.descendant GROUP BY 1)"


@query("tag_closure", f"WITH RECURSIVE {_TAGS}, {_CLOSE} SELECT ancestor, descendant, depth::INTEGER AS depth FROM c")
def _(spark, d):
    return H.closure(T.tags(spark, d))


@query("tag_descendants", f"WITH RECURSIVE {_TAGS}, {_CLOSE} SELECT descendant AS tag_id, depth::INTEGER AS depth FROM c WHERE ancestor = 2")
def _(spark, d):
    T.tags(spark, d).createOrReplaceTempView("marginalia_tags")
    return H.descendants(spark, "marginalia_tags", 2)


@query("tag_usage", f"WITH {_TAGS}, {_LINKS}, {_USED} SELECT * FROM used")
def _(spark, d):
    return H.usage(T.tags(spark, d), T.card_links(spark, d), T.argument_links(spark, d))


@query("tag_rollup", f"WITH RECURSIVE {_TAGS}, {_LINKS}, {_USED}, {_CLOSE}, {_TOTAL} SELECT * FROM tot")
def _(spark, d):
    t = T.tags(spark, d)
    return H.rollup(H.closure(t), H.usage(t, T.card_links(spark, d), T.argument_links(spark, d)))


@query("tag_sidebar", f"WITH RECURSIVE {_TAGS}, {_LINKS}, {_USED}, {_CLOSE}, {_TOTAL} SELECT c.ancestor AS root_id, c.descendant AS tag_id, t.label, tot.total, c.depth::INTEGER AS depth FROM c JOIN tags t ON t.tag_id = c.descendant JOIN tot ON tot.tag_id = c.descendant JOIN tags r ON r.tag_id = c.ancestor AND r.parent_id IS NULL WHERE depth <= 1")
def _(spark, d):
    t = T.tags(spark, d)
    closed = H.closure(t)
    return H.sidebar(t, closed, H.rollup(closed, H.usage(t, T.card_links(spark, d), T.argument_links(spark, d))))


@query("tag_filtered_cards", f"WITH {_TAGS}, {_LINKS} SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT card_id FROM links WHERE tag_id = 1 OR tag_id IN (SELECT tag_id FROM tags WHERE parent_id = 1))")
def _(spark, d):
    t = T.tags(spark, d).withColumn("slug", F.col("tag_id").cast("string"))
    return S.tagged(T.read(spark, d, "customer"), T.card_links(spark, d), H.closure(t), t, "1", "c_custkey").select("c_custkey")


@query("tag_unknown_slug", "SELECT c_custkey FROM customer")
def _(spark, d):
    t = T.tags(spark, d).withColumn("slug", F.col("tag_id").cast("string"))
    return S.tagged(T.read(spark, d, "customer"), T.card_links(spark, d), H.closure(t), t, "none", "c_custkey").select("c_custkey")


@query("school_filter", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_mktsegment) = lower('BuIlDiNg')")
def _(spark, d):
    up = T.read(spark, d, "customer").select(F.col("c_custkey").alias("upload_id"), F.col("c_mktsegment").alias("school"))
    return S.of_school(T.read(spark, d, "orders"), up, "BuIlDiNg", "o_custkey").select("o_orderkey")


@query("chips", f"WITH {_TAGS}, {_LINKS} SELECT card_id, string_agg(label, ',' ORDER BY label) AS chips FROM links JOIN tags USING (tag_id) GROUP BY card_id")
def _(spark, d):
    named = T.card_links(spark, d).join(T.tags(spark, d), "tag_id")
    return named.groupBy("card_id").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("chips"))


@query("proposed_review", f"WITH {_TAGS}, l AS (SELECT c_custkey AS card_id, c_nationkey + 100 AS tag_id FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, c_custkey % 5 FROM customer WHERE c_custkey % 3 = 0) SELECT label, count(*) AS n, string_agg(card_id::VARCHAR, ',' ORDER BY card_id) AS cards FROM l JOIN tags USING (tag_id) GROUP BY label")
def _(spark, d):
    named = T.card_links(spark, d).where("status = 'proposed'").join(T.tags(spark, d), "tag_id")
    return named.groupBy("label").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("card_id")), lambda x: x.cast("string")), ",").alias("cards"))


@query("headline_counts", "SELECT (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS cards, (SELECT count(*) FROM supplier) AS analyticals, (SELECT count(*) FROM part) AS sources, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS tags")
def _(spark, d):
    parts = {"cards": T.read(spark, d, "documents").where("doc_id % 3 <> 0"), "analyticals": T.read(spark, d, "supplier"), "sources": T.read(spark, d, "part"), "tags": T.tags(spark, d)}
    named = reduce(DataFrame.union, [df.select(F.lit(name).alias("of")) for name, df in parts.items()])
    return named.agg(*(F.count_if(F.col("of") == name).alias(name) for name in parts))


@query("source_counts", "SELECT p_partkey AS source_id, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50")
def _(spark, d):
    used = T.read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("m"))
    out = T.read(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("source_id"), F.coalesce("m", F.lit(0)).alias("n"))
    return out.orderBy(F.col("n").desc(), "source_id").limit(50)


@query("source_filter", "SELECT p_partkey FROM part WHERE p_name ILIKE '%1%' OR p_brand ILIKE '%3%' OR p_type ILIKE '%tin%'")
def _(spark, d):
    p = T.read(spark, d, "part")
    return S.matching_any(p, "1", ["p_name"]).select("p_partkey").union(S.matching_any(p, "3", ["p_brand"]).select("p_partkey")).union(S.matching_any(p, "tin", ["p_type"]).select("p_partkey")).distinct()


@query("entries_per_list", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    n = T.read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("m"))
    return T.read(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("m", F.lit(0)).alias("n"))


@query("visible_cards", "SELECT d.doc_id, d.source FROM documents d JOIN (SELECT text, min(doc_id) AS first FROM documents GROUP BY text) f ON f.first = d.doc_id")
def _(spark, d):
    docs = T.read(spark, d, "documents")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("first"))
    return docs.join(first.select("first"), F.col("doc_id") == F.col("first"), "left_semi").select("doc_id", "source")


@query("answers_topk", f"SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], ({_VEC})), 6)::DOUBLE AS distance FROM embeddings WHERE vec_id <> 7 ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], ({_VEC})), 9), vec_id LIMIT 8")
def _(spark, d):
    e = T.read(spark, d, "embeddings")
    q = e.where("vec_id = 7").select(F.col("vec_id").alias("id"), F.col("embedding").alias("q"))
    return N.nearest_to(e, q, 8, "vec_id").select("id", F.round("distance", 6).alias("distance"))


_PAIR = "SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"


@query("knn_topk_per_row", f"WITH p AS ({_PAIR}) SELECT a, b, rn::INTEGER AS rn, round(distance, 6)::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(distance, 9), b) AS rn FROM p) WHERE rn <= 8")
def _(spark, d):
    return N.top_k(T.read(spark, d, "embeddings"), 8, id_col="vec_id").select("a", "b", "rn", F.round("distance", 6).alias("distance"))


@query("knn_pairs", f"WITH p AS ({_PAIR}) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(distance, 9), b) AS rn FROM p) WHERE rn <= 8 AND distance < 0.6")
def _(spark, d):
    return N.top_k(T.read(spark, d, "embeddings"), 8, 0.6, "vec_id").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query("knn_lsh", None)
def _(spark, d):
    return N.lsh_pairs(T.read(spark, d, "embeddings"), 0.6, "vec_id")


_CONV = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations"


def _conv(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return T.read(spark, d, "conversations").withColumn("pos", F.row_number().over(w))


@query("islands_by_path", f"WITH c AS ({_CONV}), g AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY pos)) SELECT conv_id, pos::INTEGER AS pos, role, sum(ch) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g")
def _(spark, d):
    return L.islands(_conv(spark, d), "conv_id", "pos", "role").select("conv_id", "pos", "role", "island")


_PATHS = "SELECT conv_id, pos, CASE pos % 4 WHEN 1 THEN ['A', 'B'] WHEN 2 THEN ['A', 'B', 'C'] WHEN 3 THEN ['A'] ELSE ['A', 'D', 'E', 'F'] END AS path FROM c"


@query("path_lcp_headings", f"""WITH c AS ({_CONV}), p AS ({_PATHS}), l AS (SELECT *, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY pos), []) AS prev FROM p),
x AS (SELECT conv_id, pos, unnest(range(1, len(path) + 1)) AS i, path, prev FROM l)
SELECT conv_id, pos::INTEGER AS pos, least(i, 9)::INTEGER AS level, path[i] AS heading FROM x WHERE path[:i] IS DISTINCT FROM prev[:i]""")
def _(spark, d):
    a = lambda *x: F.array(*map(F.lit, x))
    k = F.col("pos") % 4
    rows = _conv(spark, d).withColumn("path", F.when(k == 1, a("A", "B")).when(k == 2, a("A", "B", "C")).when(k == 3, a("A")).otherwise(a("A", "D", "E", "F")))
    return L.new_headings(rows, "conv_id", "pos", "path")


@query("move_entry", f"""WITH c AS ({_CONV}), n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
t AS (SELECT *, CASE WHEN pos = 1 THEN least(3, n) ELSE pos - 1 + CASE WHEN pos - 1 >= least(3, n) THEN 1 ELSE 0 END END AS np FROM n)
SELECT conv_id, (conv_id * 1000 + pos)::BIGINT AS entry, np::BIGINT AS pos FROM t""")
def _(spark, d):
    rows = _conv(spark, d).withColumn("entry", F.col("conv_id") * 1000 + F.col("pos"))
    moves = rows.where("pos = 1").select(F.col("conv_id").alias("list"), F.col("entry").alias("entry_id"), F.lit(3).alias("target"))
    return L.move(rows, "conv_id", "entry", "pos", moves).select("conv_id", "entry", "pos")


@query("append_entry", f"WITH c AS ({_CONV}) SELECT conv_id, max(pos) + 1 AS pos, 'new' AS role FROM c GROUP BY conv_id UNION ALL SELECT 1000000 + c_custkey, 1, 'new' FROM customer WHERE c_custkey <= 5")
def _(spark, d):
    rows = _conv(spark, d)
    lists = rows.select("conv_id").distinct().union(T.read(spark, d, "customer").where("c_custkey <= 5").select(1000000 + F.col("c_custkey")))
    return L.append(rows, "conv_id", "pos", lists.withColumn("role", F.lit("new")), "role").select("conv_id", "pos", "role")
