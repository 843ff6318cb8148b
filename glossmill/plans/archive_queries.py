"""Queries of the web, mail, learning and relational operators, with SQL for those that it can state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.text import media_kind
from ..functions.urls import base_of, site_of
from ..operators import crawl, entities, mail, relational, tagging, text_stats, vectors, web
from ..scratch import shared_folder
from ..sources import backup
from ..sources.files import visible_text
from ..streaming.ingest import windowed_counts
from .registry import query
from .text_queries import _STOP, _terms

# --- pages

_LINKS = r"""regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)"""


@query(rf"SELECT page_id, CAST(len({_LINKS}) AS BIGINT) AS n_links, CAST(len(list_distinct({_LINKS})) AS BIGINT) AS n_targets FROM pages")
def link_counts(pages):
    found = web.link_targets(F.col("html"))
    return pages.select("page_id", F.size(found).cast("long").alias("n_links"), F.size(F.array_distinct(found)).cast("long").alias("n_targets"))


@query("SELECT regexp_extract(url, '^(?:https?://)?([^/:?#]*)', 1) AS site, count(*) AS n FROM pages GROUP BY 1")
def site_counts(pages):
    return pages.groupBy(site_of(F.col("url")).alias("site")).agg(F.count("*").alias("n"))


@query(
    r"""WITH b AS (SELECT page_id, regexp_replace(url, '^http://', '') AS u FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(u, '[/\\]$') THEN u WHEN regexp_matches(u, '\.[^./\\]{2,8}$') OR regexp_matches(u, '\?.*$')
        THEN regexp_replace(u, '[/\\][^/\\]*$', '') || '/' ELSE u || '/' END AS base FROM b"""
)
def page_bases(pages):
    return pages.select("page_id", base_of(F.col("url")).alias("base"))


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'),
        '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages"""
)
def page_visible_text(pages):
    return pages.select("page_id", visible_text(F.col("html")).alias("text"))


_HITS = r"regexp_extract_all(html, '(?i)(und|que|the)', 1)"


@query(f"SELECT page_id, round(coalesce(list_sum([CASE lower(h) WHEN 'und' THEN 1000 WHEN 'que' THEN 500 ELSE 250 END FOR h IN {_HITS}]), 0)::DOUBLE, 6) AS relevancy FROM pages")
def crawl_relevancy(pages):
    return pages.select("page_id", F.round(crawl.relevancy(F.col("html"), ["und", "que", "the"]), 6).alias("relevancy"))


@query(
    r"""WITH p AS (SELECT url, regexp_extract(url, '^(?:https?://)?([^/:?#]*)', 1) AS site, length(regexp_replace(url, '[^/]', '', 'g')) - 2 AS level FROM pages),
    s AS (SELECT site, count(*) AS n FROM p GROUP BY site)
    SELECT url, round(10 + CASE WHEN regexp_matches(site, '(?i)example') THEN 100 ELSE 0 END + 1000 / (level * 10 + 1) - n * 10
        + CASE WHEN regexp_matches(url, '(?i)de') THEN 1000 ELSE 0 END, 6) AS priority FROM p JOIN s USING (site)"""
)
def crawl_priority(pages):
    links = pages.select("url", F.lit(None).cast("string").alias("anchor"), (F.length(F.regexp_replace("url", "[^/]", "")) - 2).alias("level"))
    return crawl.priority(links, ["de"], "breadth", "example").select("url", F.round("priority", 6).alias("priority"))


@query(
    rf"""WITH l AS (SELECT page_id, url, regexp_replace(url, '^http://', '') AS u, unnest(list_distinct({_LINKS})) AS link FROM pages),
    x AS (SELECT *, lower(CASE WHEN regexp_matches(u, '[/\\]$') THEN u WHEN regexp_matches(u, '\.[^./\\]{{2,8}}$') OR regexp_matches(u, '\?.*$') THEN regexp_replace(u, '[/\\][^/\\]*$', '') || '/' ELSE u || '/' END) AS base,
        lower(regexp_extract(url, '^(?:https?://)?([^/:?#]*)', 1)) AS site, lower(regexp_extract(link, '^(?:https?://)?([^/:?#]*)', 1)) AS other FROM l)
    SELECT page_id, link, CASE WHEN NOT regexp_matches(link, '^[A-Za-z0-9_/]') OR regexp_matches(link, '(?i)\.(jpg|jpeg|gif|pdf|ps|doc|xls|ppt|mpg|mpeg|gz)$') OR regexp_matches(link, '(?i)doubleclick') THEN 0.0
        ELSE 10.0 + CASE WHEN regexp_matches(link, '(?i)the') THEN 1000.0 ELSE 0 END + CASE WHEN link[1] = '/' OR contains(lower(link), base) THEN 100.0 ELSE 0.0 END + CASE WHEN link[1] = '/' OR contains(site, other) THEN 10.0 ELSE 30.0 END END::DOUBLE AS value FROM x"""
)
def link_value(pages):
    links = pages.select("page_id", "url", F.explode(F.array_distinct(web.link_targets(F.col("html")))).alias("link"))
    return links.select("page_id", "link", crawl.link_value(F.col("link"), F.lit(None).cast("string"), F.col("url"), ["the"]).alias("value"))


@query()
def page_text(pages):
    return web.parse_pages(pages).select("page_id", "text", F.size("links").alias("n_links"), F.size("images").alias("n_images"), F.size("weighted").alias("n_weights"))


@query()
def page_links(pages):
    return web.page_links(web.parse_pages(pages))


@query()
def judged_pages(pages):
    return crawl.judged_pages(web.parse_pages(pages), ["und", "que"]).select("page_id", "digest", "relevancy", "status")


@query()
def crawled(pages):
    links = web.page_links(web.parse_pages(pages)).select(F.regexp_replace("page", "^http://", "").alias("page"), "url", "anchor")
    return crawl.crawl(links.select(F.col("page").alias("url")).distinct(), links, 2)


@query(
    r"""SELECT url, CASE WHEN regexp_matches(url, '(?i)\.(jpg|jpeg|gif|png)$') THEN 'image' WHEN regexp_matches(url, '(?i)\.(au|ra|mp3|wav|midi|mid)$') THEN 'audio' WHEN regexp_matches(url, '(?i)\.(ram)$') THEN 'video'
    WHEN regexp_matches(url, '(?i)\.(pdf|ps|doc|xls|ppt|htm|html|pl|pm)$') THEN 'doc' END AS kind FROM pages"""
)
def media_kinds(pages):
    return pages.select("url", media_kind(F.col("url")).alias("kind"))


# --- conversations as mail


@query(
    """WITH p AS (SELECT role AS source, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations)
    SELECT source, target, count(*) AS n FROM p WHERE target IS NOT NULL GROUP BY ALL"""
)
def correspondence_edges(conversations):
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = conversations.select(F.col("role").alias("source"), F.lead("role").over(order).alias("target")).filter("target is not null")
    return mail.network_edges(pairs, "source", "target")


@query(
    """WITH e AS (SELECT o_orderpriority AS target, CAST(o_custkey AS VARCHAR) AS source, count(*) AS n FROM orders GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, source) AS rank FROM e)
    SELECT target, source, n, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 3"""
)
def profile_top3(orders):
    edges = orders.groupBy(F.col("o_orderpriority").alias("target"), F.col("o_custkey").cast("string").alias("source")).agg(F.count("*").alias("n"))
    return mail.top_correspondents(edges).withColumn("rank", F.col("rank").cast("long"))


@query(
    rf"""WITH f AS (SELECT conv_id, text AS t, 1 AS k FROM conversations UNION ALL SELECT conv_id, role, 5 FROM conversations),
    w AS (SELECT conv_id, k, unnest(regexp_extract_all(lower(regexp_replace(t, '[^\x20-\x7a]', ' ', 'g')), '[a-z0-9]+')) AS term FROM f)
    SELECT conv_id AS doc_id, term, CAST(sum(k) AS BIGINT) AS tf FROM w
    WHERE length(term) >= 3 AND regexp_matches(term, '^[a-z]') AND term NOT IN ({_STOP}) AND term NOT IN ('address', 'book', 'spam', 'fyi', 'acknowledge') GROUP BY ALL"""
)
def field_weighted_vector(conversations):
    return mail.field_terms(conversations.withColumnRenamed("role", "sender"), "conv_id")


def _categories(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("category"))


_CENTRES = f"""WITH {_terms()}, g AS (SELECT doc_id, 'q' || quality || 't' || toxic AS category FROM labels),
    c AS (SELECT category, term, sum(tf) AS tf FROM tf JOIN g USING (doc_id) WHERE category IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY tf DESC, term) AS r FROM c),
    z AS (SELECT category, term, tf / sum(tf) OVER (PARTITION BY category) AS weight FROM k WHERE r <= 100)"""


@query(f"{_CENTRES} SELECT category, term, round(weight, 6) AS weight FROM z")
def category_centroids(documents, labels):
    return mail.centroids(vectors.term_frequencies(documents), _categories(labels)).select("category", "term", F.round("weight", 6).alias("weight"))


@query(
    f"""{_CENTRES}, u AS (SELECT category, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY category)) AS w FROM z),
    d AS (SELECT doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS w FROM tf),
    s AS (SELECT doc_id, category, sum(d.w * u.w) AS sim FROM d JOIN u USING (term) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 12) DESC, category) AS r FROM s)
    SELECT doc_id, CASE WHEN coalesce(sim, 0) >= 0.2 THEN category ELSE 'Miscellaneous' END AS category, round(coalesce(sim, 0), 6) AS sim
    FROM (SELECT DISTINCT doc_id FROM tf) LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (doc_id)"""
)
def nearest_centroid(documents, labels):
    tf = vectors.term_frequencies(documents)
    return mail.nearest_centroid(vectors.frequency_vectors(tf), mail.centroids(tf, _categories(labels))).withColumn("sim", F.round("sim", 6))


@query(
    """SELECT e.event_id, EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts BETWEEN e.ts AND e.ts + INTERVAL 1 HOUR) AS complete
    FROM events e WHERE e.event_type = 'error'"""
)
def interval_task_match(events):
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("at"))
    tasks = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    done = tasks.join(clicks, (tasks.user_id == clicks.user_id) & relational.between_closed(clicks.at, tasks.ts, tasks.ts + F.expr("interval 1 hour")), "left_semi").select("event_id")
    return tasks.select("event_id").join(done.withColumn("complete", F.lit(True)), "event_id", "left").select("event_id", F.coalesce("complete", F.lit(False)).alias("complete"))


# --- learning


@query(
    f"""WITH {_terms()}, j AS (SELECT tf.doc_id, term, 'q' || quality || 't' || toxic AS category FROM tf JOIN labels USING (doc_id)),
    n AS (SELECT category, count(DISTINCT doc_id) AS n FROM j WHERE category IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS t FROM n)
    SELECT category, term, round(log2(count(*) / n * n / t), 6) AS loglik FROM j JOIN n USING (category), t GROUP BY category, term, n, t"""
)
def feature_loglik(documents, labels):
    rows = vectors.term_frequencies(documents).join(_categories(labels).filter("category is not null"), "doc_id")
    known = rows.groupBy("doc_id", F.col("category").alias("type")).agg(F.collect_set("term").alias("features"))
    rules = entities.likelihood_rules(known)
    return rules.select(F.col("type").alias("category"), F.col("feature").alias("term"), F.round(F.log2("value"), 6).alias("loglik"))


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
    r AS (SELECT doc_id, i AS pos, w[i] AS word, w[i][-1] AS tag FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
    x AS (SELECT *, lead(tag) OVER o AS after, lag(tag) OVER o AS before FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    c AS (SELECT 'WB' AS kind, word, word AS part1, after AS part2, tag, count(*) AS n FROM x WHERE after IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'WF', word, before, word, tag, count(*) FROM x WHERE before IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY kind, word, part1, part2 ORDER BY n DESC, tag) AS r FROM c)
    SELECT kind, tag, part1, part2, round(n / sum(n) OVER (PARTITION BY kind, word), 6) AS frequency FROM k WHERE r = 1"""
)
def tag_rule_normalise(documents):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    tagged = documents.select("doc_id", F.posexplode(words).alias("pos", "word")).withColumn("tag", F.right("word", F.lit(1)))
    return tagging.tag_rules(tagged).withColumn("frequency", F.round("frequency", 6))


@query("SELECT toxic AS predicted, quality AS actual, count(*) AS n FROM labels GROUP BY ALL")
def label_confusion(labels):
    return text_stats.confusion(labels, "toxic", "quality")


@query(
    """WITH c AS (SELECT source AS cluster, lang, count(*) AS n FROM documents GROUP BY ALL)
    SELECT cluster, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS precision FROM c GROUP BY cluster"""
)
def source_precision(documents):
    return text_stats.cluster_precision(documents, "source", "lang").withColumn("precision", F.round("precision", 6))


# --- relational


@query(
    """WITH RECURSIVE e(p, c) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
    x(ancestor, node, depth) AS (SELECT v, v, 0 FROM (SELECT p AS v FROM e UNION SELECT c FROM e) UNION ALL SELECT ancestor, c, depth + 1 FROM x JOIN e ON node = p)
    SELECT ancestor, node, CAST(depth AS BIGINT) AS depth FROM x"""
)
def category_tree_closure(nation, customer):
    edges = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("p"), F.concat(F.lit("n"), "n_nationkey").alias("c"))
    edges = edges.union(customer.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))
    return relational.closure(edges, "c", "p").withColumn("depth", F.col("depth").cast("long"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(events):
    return relational.latest(events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    """SELECT c_custkey, c_name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'buyer' ELSE c_mktsegment END AS segment FROM customer"""
)
def upserted_segments(customer, orders):
    table = customer.select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"))
    changes = table.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").withColumn("segment", F.lit("buyer"))
    return relational.upsert(table, changes, ["c_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderpriority LIKE '%URGENT%'")
def orders_in_open_range(orders):
    return orders.filter(relational.between_open(F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("o_orderpriority").like(relational.like_pattern("URGENT", True))).select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, max(l_extendedprice) AS top_price FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' GROUP BY ALL")
def lineitem_totals(lineitem):
    rows = lineitem.filter(relational.between_closed(F.col("l_shipdate"), F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.max("l_extendedprice").alias("top_price"))


@query("SELECT s_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1 ORDER BY revenue DESC, s_suppkey LIMIT 10")
def top_suppliers(supplier, lineitem):
    sums = lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return sums.join(supplier.select("s_suppkey"), "s_suppkey", "left_semi").orderBy(F.desc("revenue"), "s_suppkey").limit(10)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS id FROM customer")
def numbered_customers(customer):
    rows = customer.select("c_custkey", (-F.col("c_acctbal")).alias("b"))
    return relational.numbered(rows, ["b", "c_custkey"]).select("c_custkey", F.col("id").cast("long").alias("id"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def order_shares(lineitem):
    return relational.share_of_total(lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", ["l_orderkey"]).select("l_orderkey", "l_linenumber", F.round("share", 6).alias("share"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 0 WHEN p_retailprice > 2000 THEN 15 ELSE least(15, CAST(floor((p_retailprice - 1000) * 16 / (1000 + 1e-10)) AS INT)) END::BIGINT AS step FROM part")
def price_steps(part):
    return part.select("p_partkey", scalars.colour_step(F.col("p_retailprice"), F.lit(1000.0), F.lit(2000.0), 16).cast("long").alias("step"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%b ') || day(o_orderdate) || CASE WHEN day(o_orderdate) IN (1, 21, 31) THEN 'st' WHEN day(o_orderdate) IN (2, 22) THEN 'nd'
        WHEN day(o_orderdate) IN (3, 23) THEN 'rd' ELSE 'th' END || ', ' || year(o_orderdate) AS written,
        CAST(day(last_day(o_orderdate)) AS BIGINT) AS month_days FROM orders"""
)
def order_dates(orders):
    return orders.select("o_orderkey", scalars.ordinal_date(F.col("o_orderdate")).alias("written"), scalars.days_in_month(F.col("o_orderdate")).cast("long").alias("month_days"))


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type AS key, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(events):
    return windowed_counts(events, "ts", "event_type")


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_sum([x::DOUBLE * x FOR x IN embedding]))), 4) AS norm FROM embeddings GROUP BY label")
def embedding_norms(embeddings):
    squares = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt(squares)), 4).alias("norm"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def restored_suppliers(spark, supplier, nation):
    """A backup of two tables, restored over suppliers whose names have changed and of whom some are missing."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/backup"
    backup.backup({"supplier": supplier.select("s_suppkey", "s_name", "s_nationkey", F.to_binary("s_name", F.lit("utf-8")).alias("raw")), "nation": nation}, path)
    changed = supplier.filter("s_nationkey > 4").select("s_suppkey", F.lower("s_name").alias("s_name"), "s_nationkey")
    return backup.restore(spark, path, ["supplier"], {"supplier": changed}, {"supplier": ["s_suppkey"]})["supplier"]


@query("SELECT name, len(columns) AS n_columns, n_rows FROM (VALUES ('region', ['a', 'b'], (SELECT count(*) FROM region)), ('orders', ['a', 'b', 'c'], (SELECT count(*) FROM orders))) AS t(name, columns, n_rows)")
def backup_manifest(spark, region, orders):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/backup"
    made = backup.backup({"region": region.select("r_regionkey", "r_name", F.lit(b"x").alias("raw")), "orders": orders.select("o_orderkey", "o_custkey", "o_orderstatus")}, path)
    return made.select("name", F.size("columns").cast("long").alias("n_columns"), "n_rows")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def customers_where(customer):
    return customer.filter(relational.where_all({"c_mktsegment": "BUILDING", "c_nationkey": 3})).select("c_custkey")


@query("SELECT DISTINCT url FROM pages WHERE starts_with(url, 'http') AND regexp_matches(url, '[02468](\\.html?)?$')")
def story_addresses(pages):
    return web.story_links(pages.select("url"), "http", r"[02468](\.html?)?$").select("url")
