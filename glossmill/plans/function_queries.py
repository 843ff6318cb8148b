"""Queries of scalar functions, codecs, sources and sinks over the relational and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records, scalars, text
from ..functions.boolean_query import text_match
from ..functions.text import content_words
from ..functions.urls import clean_link
from ..operators import phrases, relational, text_stats, vectors, web
from ..sources import delimited, dictionary, exports, feeds, files, mailbox
from .registry import query
from .text_queries import _COUNTS, _STOP, _terms

# --- numbers and arrays


@query(
    """SELECT event_id, round(CASE WHEN abs(value) = 0 THEN 0 ELSE log2(abs(value)) END, 6) AS log2, round(CASE WHEN abs(value) = 0 THEN 0 ELSE log10(abs(value)) END, 6) AS log10,
    round(log10(CAST(factorial(CAST(event_id % 24 AS INTEGER)) AS DOUBLE)), 6) AS log_factorial,
    round(CAST(factorial(CAST(event_id % 18 AS INTEGER)) AS DOUBLE) / (factorial(CAST(event_id % 5 AS INTEGER)) * factorial(CAST(greatest(event_id % 18 - event_id % 5, 0) AS INTEGER)))
        * CASE WHEN event_id % 5 > event_id % 18 THEN 0 ELSE 1 END, 4) AS combinations FROM events"""
)
def safe_numbers(events):
    size = F.abs("value")
    return events.select(
        "event_id", F.round(scalars.log2_or_zero(size), 6).alias("log2"), F.round(scalars.log10_or_zero(size), 6).alias("log10"),
        F.round(F.log10(scalars.factorial(F.col("event_id") % 24)), 6).alias("log_factorial"), F.round(scalars.combinations(F.col("event_id") % 18, F.col("event_id") % 5), 4).alias("combinations"),
    )


@query(
    """SELECT o_orderkey, lower(to_hex(o_orderkey)) AS hex, array_to_string([CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lower(to_hex(CAST(p AS BIGINT))) ELSE p END
        FOR p IN regexp_extract_all('order ' || o_orderkey || ', customer ' || o_custkey || '.', '[0-9]+|[^0-9]+')], '') AS note FROM orders"""
)
def hex_numbers(orders):
    note = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(", customer "), F.col("o_custkey").cast("string"), F.lit("."))
    return orders.select("o_orderkey", scalars.hex_of(F.col("o_orderkey")).alias("hex"), scalars.hex_runs(note).alias("note"))


@query(
    """SELECT vec_id, round(list_sum([v::DOUBLE FOR v IN embedding]), 4) AS total, round(list_min(embedding)::DOUBLE, 5) AS low, round(list_max(embedding)::DOUBLE, 5) AS high,
    CAST(list_position(embedding, list_min(embedding)) - 1 AS BIGINT) AS low_at, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS high_at FROM embeddings"""
)
def array_extremes(embeddings):
    ends = scalars.min_max(F.col("embedding"))
    return embeddings.select(
        "vec_id", F.round(scalars.array_sum(F.col("embedding")), 4).alias("total"), F.round(ends["min"].cast("double"), 5).alias("low"), F.round(ends["max"].cast("double"), 5).alias("high"),
        ends["min_index"].cast("long").alias("low_at"), ends["max_index"].cast("long").alias("high_at"),
    )


@query("SELECT l_returnflag, arg_min(l_orderkey * 10 + l_linenumber, (l_extendedprice, l_orderkey, l_linenumber)) AS cheapest, arg_max(l_orderkey * 10 + l_linenumber, (l_extendedprice, l_orderkey, l_linenumber)) AS dearest FROM lineitem GROUP BY 1")
def price_extremes(lineitem):
    line, by = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.struct("l_extendedprice", "l_orderkey", "l_linenumber")
    return lineitem.groupBy("l_returnflag").agg(F.min_by(line, by).alias("cheapest"), F.max_by(line, by).alias("dearest"))


# --- texts, paths, settings


@query("""SELECT item_id, array_to_string([CASE WHEN regexp_matches(c, '^[0-9a-zA-Z*._-]$') THEN c ELSE lower(regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g')) END FOR c IN string_split(text, '')], '') AS code, text AS back FROM benchmark""")
def url_codes(benchmark):
    code = scalars.url_encode(F.col("text"))
    return benchmark.select("item_id", code.alias("code"), scalars.url_decode(code).alias("back"))


@query("SELECT o_orderkey, epoch_us(CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 10 HOUR + INTERVAL 20 MINUTE + INTERVAL 5 SECOND ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR + INTERVAL 7 MINUTE END) AS micros FROM orders")
def mail_dates(orders):
    long_form = F.concat(F.lit("Mon, "), F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" 10:20:05 +0000"))
    short_form = F.concat(F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" 12:07 pm"))
    at = scalars.mail_date(F.when(F.col("o_orderkey") % 2 == 0, long_form).otherwise(short_form))
    return orders.select("o_orderkey", F.unix_micros(at.cast("timestamp")).alias("micros"))


@query(
    """SELECT doc_id, source || ' ' || lang || ' ' || doc_id AS words, '/data/' || source || '/' AS folder, lang || '_' || doc_id || '.txt' AS name, '/data/' || source || '/' || lang || '_' || doc_id || '.txt' AS clean
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND regexp_matches(source, '^[a-z0-9]+$')"""
)
def path_parts(documents):
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = documents.filter("source is not null and lang is not null and source rlike '^[a-z0-9]+$'").withColumn("path", path)
    untidy = F.replace(F.col("path"), F.lit("/data/"), F.lit("/data//./"))
    short = F.regexp_replace("path", "^/data/", "")
    return rows.select("doc_id", text.path_words(short).alias("words"), records.folder_of(F.col("path")).alias("folder"), records.name_of(F.col("path")).alias("name"), records.clean_path(untidy).alias("clean"))


@query("SELECT doc_id, translate(text, chr(10) || chr(13), '  ') AS text FROM documents")
def flat_texts(documents):
    return documents.select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query(
    """WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM benchmark), f AS (SELECT item_id, w, CASE length(w) % 5 WHEN 0 THEN 'n''t' WHEN 1 THEN '''ll' WHEN 2 THEN '''ve' WHEN 3 THEN '''re' ELSE '' END AS short FROM w)
    SELECT item_id, w || short AS token, CASE WHEN short = '' THEN w ELSE CASE WHEN contains(w, 'ai') THEN 'are' ELSE w END || ' ' || CASE short WHEN 'n''t' THEN 'not' WHEN '''ll' THEN 'will' WHEN '''ve' THEN 'have' ELSE 'are' END END AS expanded, count(*) AS n
    FROM f GROUP BY ALL"""
)
def short_forms(benchmark):
    rows = benchmark.select("item_id", F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), 1)).alias("w"))
    forms = F.element_at(F.array(*map(F.lit, ["n't", "'ll", "'ve", "'re", ""])), F.length("w") % 5 + 1)
    rows = rows.select("item_id", F.concat("w", forms).alias("token"))
    return rows.groupBy("item_id", "token", F.array_join(text.expand_short_form(F.col("token")), " ").alias("expanded")).agg(F.count("*").alias("n"))


@query(f"WITH {_terms('benchmark', 'item_id')} SELECT doc_id, string_agg(term || '###' || tf || '.0', '_!_' ORDER BY term) AS code, CAST(count(*) AS BIGINT) AS n, CAST(sum(tf) AS DOUBLE) AS total FROM tf GROUP BY doc_id")
def vector_codes(benchmark):
    maps = vectors.as_maps(vectors.frequency_vectors(vectors.term_frequencies(benchmark, "item_id"), normalize=False))
    code = scalars.encode_vector(F.col("vector"))
    back = scalars.decode_vector(code)
    return maps.select("doc_id", code.alias("code"), F.size(back).cast("long").alias("n"), scalars.array_sum(F.map_values(back)).alias("total"))


@query(
    """SELECT c_custkey, 'name###' || c_name || '___page###2___segment###' || c_mktsegment AS changed, 'segment###' || c_mktsegment AS less, c_name || '|' AS values FROM customer"""
)
def session_settings(customer):
    held = F.concat(F.lit("segment###"), "c_mktsegment", F.lit("___page###1___name###"), "c_name", F.lit("___page###9"))
    return customer.select(
        "c_custkey", records.with_settings(held, {"page": "2"}).alias("changed"), records.without_settings(held, ["page", "name"]).alias("less"), F.array_join(records.only_settings(held, ["name", "none"]), "|").alias("values")
    )


@query(
    r"""WITH t AS (SELECT conv_id, turn, [trim(replace(w, '"', '')) FOR w IN regexp_extract_all('"' || left(text, 11) || '" ' || text, '"[^"]*"|\S+')] AS w FROM conversations)
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct([x FOR x IN w IF length(x) > 0])), '|') AS terms FROM t"""
)
def distinct_query_terms(conversations):
    quoted = F.concat(F.lit('"'), F.left("text", F.lit(11)), F.lit('" '), F.col("text"))
    return conversations.select("conv_id", "turn", F.array_join(F.array_sort(text.distinct_terms(quoted)), "|").alias("terms"))


@query(
    """SELECT s_suppkey, kind FROM (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'video' WHEN 3 THEN 'doc' WHEN 4 THEN 'doc' END AS kind FROM supplier)"""
)
def media_of_files(supplier):
    ending = F.element_at(F.array(*map(F.lit, [".JPEG", ".mp3", ".ram", ".pdf", ".html", ".zip"])), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return supplier.select("s_suppkey", text.media_kind(F.concat("s_name", ending)).alias("kind"))


@query("""SELECT page_id, site || '/a/b/x.html' AS up, site || '/top.html' AS root, site || '/a/b/c/' AS self FROM (SELECT page_id, regexp_extract(url, '^(?:https?://)?([^/:?#]*)', 1) AS site FROM pages)""")
def resolved_links(pages):
    page = F.concat(F.regexp_extract("url", "^(?:https?://)?([^/:?#]*)", 1), F.lit("/a/b/c/"))
    far = F.lit("../" * 3 + "d/" * 30 + "../" * 30 + "top.html")
    return pages.select("page_id", clean_link(F.lit("../x.html#part"), page).alias("up"), clean_link(far, page).alias("root"), clean_link(F.lit("#only"), page).alias("self"))


# --- sources and sinks, over lines made of the tables


@query("SELECT s_suppkey, 's:' || s_suppkey || '!' AS name, s_name AS plain, CAST(s_acctbal AS VARCHAR) AS balance FROM supplier")
def delimited_fields(supplier):
    rows = supplier.select("s_suppkey", F.concat(F.lit("s:"), F.col("s_suppkey").cast("string"), F.lit("!")).alias("name"), F.col("s_name").alias("plain"), F.col("s_acctbal").cast("string").alias("balance"))
    lines = rows.select("s_suppkey", delimited.split_fields(delimited.joined_fields(["name", "plain", "balance"])).alias("f"))
    return lines.select("s_suppkey", *(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(("name", "plain", "balance"))))


@query("SELECT 'supplier.example/' || s_suppkey AS url, CASE WHEN s_suppkey % 3 = 0 THEN 'Skip' ELSE 'New' END AS status, 5000.0::DOUBLE AS priority FROM supplier WHERE s_suppkey % 4 != 0")
def seed_lines(supplier):
    line = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "# ").when(F.col("s_suppkey") % 3 == 0, "! ").otherwise(""), F.lit("http://supplier.example/"), F.col("s_suppkey").cast("string"), F.lit("/"))
    return delimited.seed_links(supplier.select(line.alias("value")))


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS number, role || '@mail.example' AS sender, 'Turn ' || turn AS subject, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS text
    FROM conversations WHERE text IS NOT NULL AND NOT contains(lower(text), 'end of message')"""
)
def mailbox_messages(conversations):
    rows = conversations.filter("text is not null and not contains(lower(text), 'end of message')")
    head = F.concat(F.lit("From: "), "role", F.lit("@mail.example\nTo: all@mail.example\nDate: 3 Jan 2024 10:00:00\nSubject: Turn "), F.col("turn").cast("string"), F.lit("\n\n"), "text")
    boxes = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", head.alias("m")))), lambda x: x["m"]), "\n--- end of message ---\n").alias("value"))
    found = mailbox.parse_messages(boxes.select(F.col("conv_id").cast("string").alias("source"), "value"))
    return found.select("source", F.col("number").cast("long").alias("number"), "sender", "subject", F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")).alias("text"))


@query("SELECT CAST(lang AS VARCHAR) AS source, 'http://feed.example/' || doc_id AS link, 'Title ' || doc_id AS title, source AS description FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def feed_entries(documents):
    key = F.col("doc_id").cast("string")
    item = F.concat(F.lit("<item><title><![CDATA[Title "), key, F.lit("]]></title>\n<link> http://feed.example/"), key, F.lit(" </link><description>"), "source", F.lit("</description></item><item><title>no link</title></item>"))
    made = documents.filter("lang is not null and source is not null").select("lang", item.alias("item"))
    return feeds.feed_items(made.groupBy(F.col("lang").alias("source")).agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list("item"), ""), F.lit("</rss>")).alias("xml")))


@query("SELECT CAST(doc_id AS VARCHAR) AS source, CAST(0 AS BIGINT) AS number, source || '|news' AS topics, lang AS places, replace(text, '<', ' ') AS body FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL AND length(text) >= 1000")
def tagged_news(documents):
    rows = documents.filter("text is not null and source is not null and lang is not null")
    sgml = F.concat(F.lit("<REUTERS a=1>\n<TOPICS><D>"), "source", F.lit("</D><D>news</D></TOPICS><PLACES><D>"), "lang", F.lit("</D></PLACES><BODY>"), F.replace(F.col("text"), F.lit("<"), F.lit(" ")), F.lit("</BODY></REUTERS>"))
    found = feeds.tagged_stories(rows.select(F.col("doc_id").cast("string").alias("source"), sgml.alias("value")))
    return found.select("source", F.col("number").cast("long").alias("number"), F.array_join("topics", "|").alias("topics"), F.array_join("places", "|").alias("places"), "body")


_EDGES = "e AS (SELECT lower(o_orderpriority) AS s, lower(o_orderstatus) AS t, count(*) AS n FROM orders GROUP BY ALL), v AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT s AS name FROM e UNION SELECT t FROM e))"


@query(
    f"""WITH {_EDGES} SELECT 0 AS section, '*Vertices ' || (SELECT count(*) FROM v) AS line UNION ALL SELECT 1, id || ' "' || name || '"' FROM v UNION ALL SELECT 2, '*Arcs'
    UNION ALL SELECT 3, a.id || ' ' || b.id || ' ' || n FROM e JOIN v a ON a.name = s JOIN v b ON b.name = t"""
)
def network_file(orders):
    edges = orders.groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("target")).agg(F.count("*").alias("n"))
    return exports.network_lines(edges).select("section", "line")


_CELLS = f"WITH {_terms('benchmark', 'item_id')}, r AS (SELECT term, row_number() OVER (ORDER BY term) AS i FROM (SELECT DISTINCT term FROM tf)), c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS j FROM (SELECT DISTINCT doc_id FROM tf)), p AS (SELECT i, j, tf, row_number() OVER (ORDER BY j, i) AS k FROM tf JOIN r USING (term) JOIN c USING (doc_id))"


@query(
    f"""{_CELLS} SELECT 0 AS section, 0::BIGINT AS key, max(i) || ' ' || max(j) || ' ' || count(*) AS line FROM p UNION ALL SELECT 1, max(j) + 1, CAST(count(*) + 1 AS VARCHAR) FROM p
    UNION ALL SELECT 1, j, CAST(min(k) AS VARCHAR) FROM p GROUP BY j UNION ALL SELECT 2, k, CAST(i AS VARCHAR) FROM p UNION ALL SELECT 3, k, CAST(tf AS VARCHAR) FROM p"""
)
def matrix_file(benchmark):
    return exports.compressed_columns(vectors.term_frequencies(benchmark, "item_id").withColumnRenamed("tf", "value"))


@query(
    """WITH i AS (SELECT doc_id AS id, '/old/' || doc_id || '.txt' AS path, rtrim(base64(unhex(md5(text))), '=') AS digest FROM documents WHERE text IS NOT NULL),
    f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN '/old/' ELSE '/new/' END || doc_id || '.txt' AS path, rtrim(base64(unhex(md5(CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE text END))), '=') AS digest FROM documents WHERE text IS NOT NULL)
    SELECT id, i.path AS old_path, min(f.path) AS path FROM i JOIN f ON f.digest = i.digest AND regexp_extract(f.path, '[^/]+$') = regexp_extract(i.path, '[^/]+$') WHERE i.path NOT IN (SELECT path FROM f) GROUP BY ALL"""
)
def moved_files(documents):
    rows, key = documents.filter("text is not null"), F.col("doc_id").cast("string")
    index = rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("/old/"), key, F.lit(".txt")).alias("path"), text.content_digest(F.col("text")).alias("digest"))
    now = F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("text"))
    there = rows.select(F.concat(F.when(F.col("doc_id") % 3 == 0, "/old/").otherwise("/new/"), key, F.lit(".txt")).alias("path"), text.content_digest(now).alias("digest"))
    return relational.repaired_paths(index, there)


@query(
    r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) ELSE html END AS text,
        'p ' || page_id AS description FROM pages WHERE html IS NOT NULL"""
)
def texts_of_files(pages):
    path = F.concat(F.lit("p_"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".html").otherwise(".txt"))
    rows = pages.filter("html is not null").select("page_id", F.concat(F.lit("/"), path).alias("path"), F.encode("html", "UTF-8").alias("content"))
    found = files.file_texts(rows).select(F.regexp_extract("path", "_([0-9]+)", 1).cast("long").alias("page_id"), "text", "description")
    return found


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_partkey % 3 != 0")
def checked_rows(part):
    size = F.when(F.col("p_partkey") % 3 == 0, "many").otherwise(F.col("p_size").cast("string"))
    return relational.checked_numbers(part.select("p_partkey", size.alias("size")), ["size"])[0]


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey != 1")
def rows_removed(nation, region):
    gone = nation.filter("n_regionkey = 1").select("n_nationkey")
    return relational.removed(nation, gone, ["n_nationkey"]).select("n_nationkey", "n_name")


@query(
    """WITH t AS (SELECT n_nationkey AS id, 'site' || n_nationkey AS url, n_name AS name FROM nation WHERE n_nationkey < 10),
    c AS (SELECT n_nationkey + 5 AS id, 'site' || CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey ELSE n_nationkey + 5 END AS url, 'new' AS name FROM nation WHERE n_nationkey < 8),
    bad AS (SELECT c.id FROM c JOIN t ON t.url = c.url AND t.id != c.id)
    SELECT id, url, name FROM c WHERE id NOT IN (SELECT id FROM bad) UNION ALL SELECT * FROM t WHERE id NOT IN (SELECT id FROM c WHERE id NOT IN (SELECT id FROM bad))"""
)
def sources_changed(nation):
    site = lambda x: F.concat(F.lit("site"), x.cast("string"))
    key = F.col("n_nationkey")
    table = nation.filter("n_nationkey < 10").select(key.alias("id"), site(key).alias("url"), F.col("n_name").alias("name"))
    changes = nation.filter("n_nationkey < 8").select((key + 5).alias("id"), site(F.when(key % 4 == 0, key).otherwise(key + 5)).alias("url"), F.lit("new").alias("name"))
    return relational.unique_or_rejected(table, changes, "id", "url")[0]


# --- vectors and phrases


@query(
    f"""WITH {_terms()}, v AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS k FROM tf)
    SELECT doc_id, term, floor(round(w * 1000, 6)) / 1000 AS weight FROM v WHERE k <= 100"""
)
def cut_vectors(documents):
    return vectors.truncated_weights(vectors.strongest(vectors.frequency_vectors(vectors.term_frequencies(documents)), 100)).select("doc_id", "term", "weight")


@query(
    f"""WITH {_terms('benchmark', 'item_id')}, n AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM tf GROUP BY doc_id)
    SELECT a.doc_id AS a, b.doc_id AS b, round(coalesce((SELECT sum(x.tf * y.tf) FROM tf x JOIN tf y USING (term) WHERE x.doc_id = a.doc_id AND y.doc_id = b.doc_id), 0) / (a.n * b.n), 6) AS sim FROM n a JOIN n b ON b.doc_id = a.doc_id + 1"""
)
def next_item_cosine(benchmark):
    maps = vectors.as_maps(vectors.frequency_vectors(vectors.term_frequencies(benchmark, "item_id"), normalize=False))
    a, b = maps.toDF("a", "x"), maps.toDF("b", "y")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(scalars.cosine("x", "y"), 6).alias("sim"))


@query(
    """WITH a AS (SELECT c_nationkey AS i, o_orderpriority AS j, count(*) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), b AS (SELECT o_orderpriority AS i, o_orderstatus AS j, count(*) AS v FROM orders GROUP BY ALL)
    SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS value FROM a JOIN b ON a.j = b.i GROUP BY ALL"""
)
def priority_products(orders, customer):
    a = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("c_nationkey").alias("i"), F.col("o_orderpriority").alias("j")).agg(F.count("*").alias("value"))
    b = orders.groupBy(F.col("o_orderpriority").alias("i"), F.col("o_orderstatus").alias("j")).agg(F.count("*").alias("value"))
    return vectors.matrix_product(a, b)


@query(
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), p AS (SELECT w[i] AS w1, w[i + 1] AS w2 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)),
    c AS (SELECT w, count(*) AS c FROM (SELECT unnest(w) AS w FROM w) GROUP BY w), n AS (SELECT sum(c) AS n FROM c),
    b AS (SELECT w1, w2, count(*) AS c12 FROM p WHERE w1 NOT IN ({_STOP}) AND w2 NOT IN ({_STOP}) GROUP BY ALL HAVING count(*) >= 5),
    j AS (SELECT w1, w2, x.c AS c1, y.c AS c2, c12, n, y.c / n AS p, c12 / x.c AS p1, (y.c - c12) / (n - x.c) AS p2 FROM b JOIN c x ON x.w = w1 JOIN c y ON y.w = w2, n)
    SELECT w1, w2, round(-2 * (CASE WHEN p > 0 AND p < 1 THEN c12 * log2(c1 * p) - c1 * p * log2(exp(1)) + CASE WHEN c2 > c12 THEN (c2 - c12) * log2((n - c1) * p) ELSE 0 END - (n - c1) * p * log2(exp(1)) ELSE 0 END
        - CASE WHEN p1 > 0 AND p1 < 1 THEN c12 * log2(c1 * p1) - c1 * p1 * log2(exp(1)) ELSE 0 END
        - CASE WHEN p2 > 0 AND p2 < 1 THEN (c2 - c12) * log2((n - c1) * p2) - (n - c1) * p2 * log2(exp(1)) ELSE 0 END), 3) AS llr FROM j"""
)
def bigram_poisson(documents):
    pairs = phrases.bigram_scores(documents, least=5)
    return pairs.select("w1", "w2", F.round(scalars.poisson_ratio(F.col("c1"), F.col("c2"), F.col("c12"), F.col("n")), 3).alias("llr"))


@query(
    rf"""SELECT conv_id, turn, CAST(len(list_filter(regexp_extract_all(lower(regexp_replace(text, '[^\x20-\x7a]', ' ', 'g')), '[a-z0-9]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '^[a-z]') AND w NOT IN ({_STOP}))) AS BIGINT) AS n_words
    FROM conversations WHERE length(text) >= 2 AND (regexp_matches(text, '(?is)\bque\b') OR regexp_matches(text, '(?is)\bund\b') OR regexp_matches(text, '(?is)\bthe\b')) AND NOT regexp_matches(text, '(?is)\bxyz\b')"""
)
def message_search(conversations):
    rows = conversations.filter(text_match(F.col("text"), "(que OR und OR the) AND NOT xyz"))
    return rows.select("conv_id", "turn", F.size(content_words(F.col("text"))).cast("long").alias("n_words"))


@query(r"""SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '(?i)<img\s[^>]*?src="([^"]*)"', 1))) AS BIGINT) AS n_images FROM pages""")
def image_counts(pages):
    return web.parse_pages(pages).select("page_id", F.size("images").cast("long").alias("n_images"))


@query(r"""SELECT page_id, regexp_replace(html, 'href="[^"]*"', 'href="local"', 'g') AS html FROM pages""")
def pages_with_local_links(pages):
    targets = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("image")).withColumn("local", F.lit("local"))
    return web.local_images(pages, targets).select("page_id", "html")


@query(f"{_COUNTS} SELECT length(word) AS length, max(n) AS most, min_by(word, (-n, word)) AS word FROM c GROUP BY 1")
def commonest_by_length(documents):
    counts = text_stats.word_counts(documents)
    return counts.groupBy(F.length("word").cast("long").alias("length")).agg(F.max("n").alias("most"), F.min_by("word", F.struct(-F.col("n"), "word")).alias("word"))


@query(
    """SELECT n_name AS word, 'c' AS pos, 'c:' || array_to_string(list_sort(list_distinct([n_name, 'aa', 'zz'])), ' ') AS synset, 'aa zz' AS others, 'in ' || n_regionkey || ': so' AS gloss FROM nation WHERE n_nationkey % 3 != 0"""
)
def function_word_lines(nation):
    line = F.concat("n_name", F.lit(":c: zz  aa :in "), F.col("n_regionkey").cast("string"), F.lit(": so"))
    found = dictionary.function_words(nation.select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value")))
    return found.select("word", "pos", "synset", F.array_join("others", " ").alias("others"), "gloss")


@query("SELECT lower(replace(p_brand, '#', '_')) AS word, CASE p_size % 5 WHEN 0 THEN 'n' WHEN 1 THEN 'v' WHEN 3 THEN 'r' ELSE 'a' END || lpad(CAST(p_size AS VARCHAR), 8, '0') AS synset, max(p_partkey) AS tag_count FROM part GROUP BY ALL")
def sense_lines(part):
    line = F.concat(F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))), F.lit("%"), (F.col("p_size") % 5 + 1).cast("string"), F.lit(":03:00:: "), F.lpad(F.col("p_size").cast("string"), 8, "0"), F.lit(" 1 "), F.col("p_partkey").cast("string"))
    return dictionary.sense_counts(part.select(line.alias("value")))


@query("SELECT 'w' || s_suppkey AS word, CASE s_suppkey % 2 WHEN 0 THEN 'n' ELSE 'v' END AS pos, s_nationkey AS n_senses FROM supplier")
def index_entries(supplier):
    line = F.concat(F.lit("w"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, " n ").otherwise(" v "), F.col("s_nationkey").cast("string"), F.lit(" 0 1 1 00001740"))
    licence = supplier.sparkSession.createDataFrame([("  1 This text is a licence",), ("",)], "value string")
    return dictionary.index_lines(supplier.select(line.alias("value")).union(licence))


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND length(text) >= 1000),
    t AS (SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w))
    SELECT CAST(doc_id AS VARCHAR) AS source, CAST(pos AS BIGINT) AS pos, token, CASE lower(token) WHEN 'the' THEN 'place' WHEN 'que' THEN 'person' ELSE 'org' END AS type FROM t WHERE regexp_matches(token, '^[A-Z]') AND lower(token) IN ('the', 'que', 'und')"""
)
def story_labels(documents):
    rows = documents.filter("text is not null and source is not null and lang is not null")
    body = F.replace(F.col("text"), F.lit("<"), F.lit(" "))
    sgml = F.concat(F.lit("<REUTERS>\n<PLACES><D>the-de</D></PLACES><PEOPLE><D>Que</D></PEOPLE><ORGS><D>und</D></ORGS><BODY>"), body, F.lit("</BODY></REUTERS>"))
    stories = feeds.tagged_stories(rows.select(F.col("doc_id").cast("string").alias("source"), sgml.alias("value")))
    return feeds.weak_labels(stories).select("source", F.col("pos").cast("long").alias("pos"), "token", "type")


_SUBJECTS, _VERBS = ["dogs", "cats"], ["chase", "see", "hear"]


@query("SELECT o_orderkey, true AS fits, CAST(6 AS BIGINT) AS most FROM orders")
def made_sentences(orders):
    made = orders.select("o_orderkey", text.made_sentence(F.col("o_orderkey"), ["Often", "Today"], _SUBJECTS, _VERBS, ["birds"]).alias("s"))
    most = made.agg(F.count_distinct(F.substring_index(F.regexp_replace("s", "^[A-Z][a-z]+ ", ""), " ", 2)).alias("most")).withColumn("fits", F.lit(True))
    fine = made.select("o_orderkey", F.col("s").rlike("^(Often|Today) (dogs|cats) (chase|see|hear) birds[.]$").alias("fits"))
    return fine.join(most, "fits", "left").select("o_orderkey", "fits", "most")
