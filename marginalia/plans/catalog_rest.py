"""Queries for the smaller operators: lookups, tallies, orders, accounts, files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import network, spans, text
from marginalia.operators import changes as C
from marginalia.operators import dedup as D
from marginalia.operators import lists as L
from marginalia.operators import providers as P
from marginalia.plans import tables as T
from marginalia.plans.catalog_changes import _L, _marked
from marginalia.plans.catalog_pages import _CONV, _TAGS, _conv, _topics
from marginalia.plans.catalog_text import _BODY, _CITE, _SCORE, _SPANS, _TAG, _WORDS
from marginalia.sources import docx
from marginalia.streaming import limiter, snapshots

CATALOG: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return keep


@query("candidates_by_tag", f"WITH {_TAGS}, {_L} SELECT card_id, label AS slug FROM l JOIN tags USING (tag_id) WHERE label = (SELECT min(n_name) FROM nation) AND card_id % 4 <> 0")
def _(spark, d):
    slug = T.read(spark, d, "nation").agg(F.min("n_name")).first()[0]
    tag = T.tags(spark, d).where(F.col("label") == slug)
    return T.card_links(spark, d).join(tag, "tag_id").where("card_id % 4 <> 0").select("card_id", F.lit(slug).alias("slug"))


@query("missing_embedding", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, d):
    return T.cards(spark, d).where("embedding is null").select("doc_id")


@query("raw_where", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type LIKE '%S%'")
def _(spark, d):
    return T.read(spark, d, "part").filter("p_size BETWEEN 10 AND 20 AND p_type LIKE '%S%'").select("p_partkey")


@query("point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def _(spark, d):
    return T.read(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("owned_lists", "SELECT o_orderkey FROM orders WHERE o_custkey = 5")
def _(spark, d):
    return T.read(spark, d, "orders").where("o_custkey = 5").select("o_orderkey")


@query("distinct_from", "SELECT c_custkey FROM customer WHERE (CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END) IS DISTINCT FROM (CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 5 END)")
def _(spark, d):
    a, b = F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")), F.when(F.col("c_custkey") % 6 != 0, F.lit(5))
    return T.read(spark, d, "customer").where(~a.eqNullSafe(b)).select("c_custkey")


@query("nickname_lookup", "SELECT c_custkey FROM customer WHERE lower(c_name) = lower(trim(' ' || (SELECT upper(min(c_name)) FROM customer) || ' '))")
def _(spark, d):
    c = T.read(spark, d, "customer")
    name = " " + c.agg(F.upper(F.min("c_name"))).first()[0] + " "
    return c.where(F.lower("c_name") == F.lower(F.trim(F.lit(name)))).select("c_custkey")


@query("exactly_one_target", "SELECT o_orderkey FROM orders WHERE (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0)")
def _(spark, d):
    a, b = F.when(F.col("o_orderkey") % 2 != 0, 1), F.when(F.col("o_orderkey") % 3 != 0, 1)
    return T.read(spark, d, "orders").where(L.exactly_one(a, b)).select("o_orderkey")


@query("eager_loads", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0 LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    c, n = T.read(spark, d, "customer").where("c_custkey % 2 = 0"), T.read(spark, d, "nation")
    out = T.read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("o_orderkey", "c_name", "n_name")


@query("alternates", "SELECT c_custkey AS card_id, 'alternate' AS relation FROM customer WHERE c_custkey // 2 = 10 AND c_custkey >= 4 UNION ALL SELECT 5, 'canonical'")
def _(spark, d):
    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("card_id"), F.when(F.col("c_custkey") >= 4, F.floor(F.col("c_custkey") / 2)).alias("canonical_card_id"))
    return D.alternates(c, 10).select("card_id", "relation")


@query("eligible_cards", "SELECT d.doc_id AS card_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % 5 <> 0 AND d.doc_id % 7 <> 0")
def _(spark, d):
    c = T.cards(spark, d).withColumn("canonical_card_id", F.when(F.col("doc_id") % 5 == 0, 1)).withColumn("dedup_excluded", F.when(F.col("doc_id") % 7 == 0, True))
    return D.eligible(c).select(F.col("doc_id").alias("card_id"))


@query("next_position", f"WITH c AS ({_CONV}) SELECT conv_id, max(pos)::BIGINT + 1 AS next FROM c GROUP BY conv_id")
def _(spark, d):
    return _conv(spark, d).groupBy("conv_id").agg((F.coalesce(F.max("pos"), F.lit(0)) + 1).cast("long").alias("next"))


@query("real_users", "SELECT count(*) AS n FROM customer WHERE c_custkey % 3 <> 0")
def _(spark, d):
    return T.read(spark, d, "customer").withColumn("pw_hash", F.when(F.col("c_custkey") % 3 != 0, "x")).agg(F.count("pw_hash").alias("n"))


@query("speech_total", f"""WITH x AS ({_SPANS}), b AS ({_BODY}), h AS (SELECT x.id, string_agg(substr(body, s + 1, e - s), ' ' ORDER BY s, line, e) AS t FROM x JOIN b USING (id) WHERE k = 'highlight' GROUP BY x.id),
w AS (SELECT id, {_WORDS.format("coalesce(t, '')")} AS words FROM h) SELECT o_custkey AS list, coalesce(sum(CASE WHEN words > 0 THEN greatest(1, round_even(words * 60 / 270.0, 0)) END), 0)::BIGINT AS seconds FROM orders LEFT JOIN w ON w.id = o_orderkey GROUP BY 1""")
def _(spark, d):
    body = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("list"), F.expr("repeat('word ' || o_orderstatus || ' & more <of> it ', 8)").alias("body"))
    rows = body.join(T.span_lists(spark, d), "id", "left").withColumn("seconds", spans.reading_seconds(spans.reading_words(F.col("body"), F.col("spans"))))
    return rows.groupBy("list").agg(F.sum("seconds").alias("seconds"))


@query("retag_tallies", "SELECT count(*) FILTER (c_custkey % 4 = 0) AS keep, count(*) FILTER (c_custkey % 4 = 1) AS retag, count(*) FILTER (c_custkey % 4 = 2) AS remove, count(*) FILTER (c_custkey % 4 = 3) AS error FROM customer")
def _(spark, d):
    k = F.col("c_custkey") % 4
    return T.read(spark, d, "customer").agg(*(F.count_if(k == i).alias(n) for i, n in enumerate(("keep", "retag", "remove", "error"))))


@query("tags_added", "SELECT DISTINCT (c_nationkey + 100)::BIGINT AS tag_id FROM customer WHERE c_custkey % 50 = 0")
def _(spark, d):
    return T.card_links(spark, d).where("card_id % 50 = 0 and tag_id >= 100").select("tag_id").distinct()


@query("topics_by_season", "SELECT r_regionkey AS id, r_name AS slug FROM region ORDER BY r_name DESC, id DESC")
def _(spark, d):
    return _topics(spark, d).select("id", "slug").orderBy(F.col("slug").desc(), F.col("id").desc())


@query("first_workspace", "SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1")
def _(spark, d):
    return T.read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))


@query("card_score", rf"""WITH t AS (SELECT doc_id, {_SCORE} AS ts FROM (SELECT doc_id, source, tag, {_WORDS.format('tag')} AS n FROM (SELECT doc_id, source, {_TAG} AS tag FROM documents)))
SELECT doc_id, round(ts * 0.55::DOUBLE + 0.8::DOUBLE * 0.35::DOUBLE + CASE WHEN doc_id % 2 = 0 THEN 0.05::DOUBLE ELSE 0 END + 0.05::DOUBLE, 4)::DOUBLE AS score FROM t""")
def _(spark, d):
    upload = F.when(F.col("doc_id") % 2 != 0, F.col("doc_id"))
    s = D.card_score(F.expr(_TAG), F.concat("source", F.lit(".docx")), F.lit("Smith 22"), F.lit(None).cast("int"), upload)
    return T.read(spark, d, "documents").select("doc_id", F.round(s, 4).alias("score"))


@query("client_ip", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.' || (event_id % 7)::VARCHAR || '.9' ELSE '8.8.8.8' END AS peer, CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN '1.2.3.' || (event_id % 200)::VARCHAR WHEN event_id % 3 = 0 THEN '10.0.' || (event_id % 7)::VARCHAR || '.9' ELSE '8.8.8.8' END AS ip FROM events")
def _(spark, d):
    k = F.col("event_id")
    peer = F.when(k % 3 == 0, F.concat(F.lit("10.0."), (k % 7).cast("string"), F.lit(".9"))).otherwise("8.8.8.8")
    head = F.when(k % 5 == 0, "not an address").otherwise(F.concat(F.lit(" 1.2.3."), (k % 200).cast("string"), F.lit(", 9.9.9.9")))
    return T.read(spark, d, "events").select("event_id", peer.alias("peer"), network.client_ip(peer, head, ["10.0.0.0/16", "nonsense"]).alias("ip"))


@query("limiter_keys", "SELECT event_id, CASE WHEN event_type = 'login' OR user_id % 4 = 0 THEN 'ip:1.1.1.' || (user_id % 9)::VARCHAR ELSE 'user:' || user_id::VARCHAR END AS key FROM events")
def _(spark, d):
    user = F.when(F.col("user_id") % 4 != 0, F.col("user_id"))
    return T.read(spark, d, "events").select("event_id", limiter.limiter_key(F.col("event_type"), user, F.concat(F.lit("1.1.1."), (F.col("user_id") % 9).cast("string"))).alias("key"))


@query("json_property", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(spark, d):
    return T.read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("trigrams", "SELECT p_partkey, list_sort(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))))::VARCHAR AS grams FROM (SELECT p_partkey, lower(p_type) AS t FROM part)")
def _(spark, d):
    t = F.lower("p_type")
    grams = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, 3))))
    return T.read(spark, d, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(grams, ", "), F.lit("]")).alias("grams"))


@query("exclude_from_dedup", "SELECT c_custkey AS card_id, c_custkey % 10 = 0 OR c_custkey % 15 = 0 AS dedup_excluded FROM customer")
def _(spark, d):
    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("card_id"), F.when(F.col("c_custkey") % 15 == 0, True).alias("dedup_excluded"))
    return C.exclude_from_dedup(c, c.where("card_id % 10 = 0"))


@query("rewrite_tags", "SELECT c_custkey AS card_id, CASE WHEN c_custkey % 10 = 0 THEN 'new ' || c_custkey::VARCHAR ELSE c_name END AS tag, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'm' END AS tag_markup FROM customer")
def _(spark, d):
    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("card_id"), F.col("c_name").alias("tag"), F.lit("m").alias("tag_markup"))
    return C.rewrite_tags(c, c.where("card_id % 10 = 0").select("card_id", F.concat(F.lit("new "), F.col("card_id").cast("string")).alias("new_tag")))


@query("edit_variant", "SELECT o_orderkey AS card_id, 0 AS start, 1 AS \"end\", 'underline' AS kind FROM orders WHERE o_orderkey % 4 = 3 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    cards = _marked(spark, d).where("markup is null and card_id % 4 = 3")
    none = spark.createDataFrame([], f"workspace_id long, card_id long, markup {spans.SPANS}")
    edit = lambda lo, hi: cards.select(F.col("card_id").alias("workspace_id"), "card_id", F.lit("add").alias("action"), F.lit(lo).alias("start"), F.lit(hi).alias("end"), F.lit("underline").alias("kind"))
    return C.edit_variant(C.edit_variant(none, edit(0, 1), cards), edit(3, 99), cards).select("card_id", F.inline("markup"))


@query("delete_entries", f"WITH c AS ({_CONV}) SELECT conv_id, pos::INTEGER AS pos FROM c WHERE (conv_id * 1000 + pos) % 3 <> 0")
def _(spark, d):
    rows = _conv(spark, d).withColumn("entry", F.col("conv_id") * 1000 + F.col("pos"))
    return L.remove(rows, rows.where("entry % 3 = 0"), "entry").select("conv_id", "pos")


@query("register_account", "SELECT c_custkey AS id, c_name AS nickname FROM customer WHERE c_custkey <= 3 UNION ALL SELECT (SELECT max(c_custkey) FROM customer WHERE c_custkey <= 3) + 1, 'newcomer'")
def _(spark, d):
    users = T.read(spark, d, "customer").where("c_custkey <= 3").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nickname"), F.lit("h").alias("pw_hash"))
    taken = users.agg(F.upper(F.min("nickname"))).first()[0]
    return C.register(C.register(users, " newcomer ", "h2"), taken, "h3").select("id", "nickname")


@query("tiebreak_candidates", "SELECT p_partkey AS cluster FROM part WHERE p_partkey % 3 = 0 AND p_size BETWEEN 50 AND 54")
def _(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("cluster"), (F.col("p_size") / 100).alias("winner_score"), F.when(F.col("p_partkey") % 3 == 0, "margin too tight").alias("skip_reason"))
    return P.needs_tiebreak(p).select("cluster")


@query("style_summary", "SELECT lang AS style, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return docx.style_summary(T.read(spark, d, "documents").withColumnRenamed("lang", "style"))


@query("new_files", "SELECT url FROM pages WHERE split_part(url, '/', -1) NOT IN (SELECT split_part(url, '/', -1) FROM pages WHERE page_id % 2 = 0)")
def _(spark, d):
    p = T.read(spark, d, "pages")
    known = p.where("page_id % 2 = 0").select(F.element_at(F.split("url", "/"), -1).alias("source_file"))
    return docx.new_files(p.withColumn("path", F.col("url")), known, known.limit(0)).select("url")


@query("reingest_file", "SELECT source, count(*) AS n, sum(CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 0 END)::BIGINT AS fresh FROM documents GROUP BY 1")
def _(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("source").alias("source_file"), F.lit(0).alias("fresh"))
    again = docs.where("source_file in ('src1', 'src2')")
    out = docx.reingest(docs, again, again.withColumn("fresh", F.lit(1)))
    return out.groupBy(F.col("source_file").alias("source")).agg(F.count("*").alias("n"), F.sum("fresh").alias("fresh"))


@query("snapshot_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE::VARCHAR ELSE '2020-01-01' END AS day FROM orders")
def _(spark, d):
    day = F.to_date("o_orderdate").cast("string")
    path = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/dump/weekly_"), day, F.lit("/x/a.docx"))).otherwise("/dump/a.docx")
    return T.read(spark, d, "orders").select("o_orderkey", snapshots.snapshot_date(path, F.to_date(F.lit("2020-01-01"))).cast("string").alias("day"))


@query("cleaned_nicknames", r"SELECT c_custkey, length(trim(n)) BETWEEN 1 AND 32 AND NOT regexp_matches(trim(n), '\s') AS ok FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' x' WHEN c_custkey % 4 = 1 THEN ' ' || c_name || ' ' WHEN c_custkey % 4 = 2 THEN repeat(c_name, 3) ELSE '' END AS n FROM customer)")
def _(spark, d):
    n = F.expr("CASE WHEN c_custkey % 4 = 0 THEN c_name || ' x' WHEN c_custkey % 4 = 1 THEN ' ' || c_name || ' ' WHEN c_custkey % 4 = 2 THEN repeat(c_name, 3) ELSE '' END")
    return T.read(spark, d, "customer").select("c_custkey", text.valid_nickname(n).alias("ok"))


@query("score_cite_words", rf"SELECT p_partkey, {_WORDS.format('coalesce(c, chr(32))')}::INTEGER AS n FROM (SELECT p_partkey, {_CITE.replace('STRING', 'VARCHAR')} AS c FROM part)")
def _(spark, d):
    return T.read(spark, d, "part").select("p_partkey", text.word_count(F.expr(_CITE)).alias("n"))
