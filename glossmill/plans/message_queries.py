"""Queries of the message, task, news, crawl, group and question operators, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import site_of
from ..operators import crawl, graphs, inverted_index, mail, news, questions, relational, summaries, vectors
from ..scratch import shared_folder
from ..sources.files import visible_text
from .registry import query
from .text_queries import _BENCH, _STOP, _bench_pairs, _terms, _tf

#: Conversations as messages, the same in Spark and SQL.
_MESSAGES = """m AS (SELECT conv_id * 1000 + turn AS id, TIMESTAMP '2024-01-01 00:00:00' + CAST((conv_id % 60) * 1440 + turn AS INTEGER) * INTERVAL 1 MINUTE AS sent, role || '@mail.example' AS sender,
    'team' || (conv_id % 4) || '@mail.example' AS recipient, 'Subject ' || role AS subject, text, CASE conv_id % 3 WHEN 0 THEN 'Received' WHEN 1 THEN 'Sent' ELSE 'Composed' END AS status,
    'c' || (conv_id % 5) AS category, conv_id % 7 = 0 AS deleted FROM conversations)"""


def _messages(conversations: DataFrame) -> DataFrame:
    conv = F.col("conv_id")
    minutes = ((conv % 60) * 1440 + F.col("turn")).cast("int")
    return conversations.select(
        (conv * 1000 + F.col("turn")).alias("id"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)).alias("at"), F.concat("role", F.lit("@mail.example")).alias("sender"),
        F.concat(F.lit("team"), (conv % 4).cast("string"), F.lit("@mail.example")).alias("recipient"), F.concat(F.lit("Subject "), "role").alias("subject"), "text",
        F.when(conv % 3 == 0, "Received").when(conv % 3 == 1, "Sent").otherwise("Composed").alias("status"), F.concat(F.lit("c"), (conv % 5).cast("string")).alias("category"), (conv % 7 == 0).alias("deleted"),
    )


# --- messages


@query(f"WITH {_MESSAGES} SELECT id FROM m WHERE NOT deleted AND status IN ('Received', 'Sent') AND category IN ('c1', 'c2') AND sent > TIMESTAMP '2024-01-03' AND sent < TIMESTAMP '2024-02-20'")
def filtered_messages(conversations):
    return _messages(conversations).filter(mail.message_filter(["received", "Sent"], ["c1", "c2"], "2024-01-03", "2024-02-20")).select("id")


@query(
    rf"""WITH {_MESSAGES}, t AS (SELECT id, unnest(regexp_extract_all(lower(regexp_replace(text, '[^\x20-\x7a]', ' ', 'g')), '[a-z0-9]+')) AS term FROM m),
    h AS (SELECT id, count(*) AS weight FROM t WHERE term IN ('sch', 'tion', 'die') AND length(term) >= 3 GROUP BY id),
    f AS (SELECT m.id, weight, row_number() OVER (ORDER BY sent DESC, m.id) AS position FROM m JOIN h USING (id) WHERE NOT deleted AND status = 'Received' AND regexp_matches(text, '(?is)\b(sch|tion|die)\b'))
    SELECT id, CAST(weight AS BIGINT) AS weight, CAST(position AS BIGINT) AS position FROM f WHERE position <= 10"""
)
def message_pages(spark, conversations):
    """A search over a stored index, with filters, the latest first."""
    messages = _messages(conversations)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/index"
    inverted_index.write_index(inverted_index.postings(messages, "id"), path)
    found = mail.search_messages(messages, spark.read.parquet(path), "sch OR tion OR die", mail.message_filter(["Received"]))
    return found.select("id", "weight", F.col("position").cast("long").alias("position"))


@query(f"WITH {_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY sender, sent, text ORDER BY id) AS k FROM m WHERE text IS NOT NULL) SELECT id, rtrim(base64(unhex(md5(text))), '=') AS digest FROM r WHERE k = 1 AND id NOT IN (SELECT id FROM m WHERE category = 'c4')")
def new_messages(conversations):
    rows = _messages(conversations).filter("text is not null")
    return mail.fresh_messages(rows, rows.filter("category = 'c4'")).select("id", "digest")


@query(
    f"""WITH {_MESSAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY sender, sent, text ORDER BY id) AS copy FROM m WHERE sender IS NOT NULL AND sent IS NOT NULL AND recipient IS NOT NULL), u AS (SELECT * FROM o WHERE copy = 1),
    f AS (SELECT id, text AS t, 1 AS k FROM u UNION ALL SELECT id, subject, 5 FROM u UNION ALL SELECT id, sender, 5 FROM u UNION ALL SELECT id, recipient, 1 FROM u),
    w AS (SELECT id, k, unnest(regexp_extract_all(lower(regexp_replace(t, '[^\\x20-\\x7a]', ' ', 'g')), '[a-z0-9]+')) AS term FROM f),
    tf AS (SELECT id AS doc_id, term, sum(k) AS tf FROM w WHERE length(term) >= 3 AND regexp_matches(term, '^[a-z]') AND term NOT IN ({_STOP}) AND term NOT IN ('address', 'book', 'spam', 'fyi', 'acknowledge') GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS k FROM tf), v AS (SELECT doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS w FROM r WHERE k <= 100),
    c(category, term, w) AS (VALUES ('a', 'subject', 0.6), ('a', 'user', 0.8), ('b', 'subject', 0.6), ('b', 'assistant', 0.8)),
    s AS (SELECT doc_id, category, sum(v.w * c.w) AS sim FROM v JOIN c USING (term) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 12) DESC, category) AS k FROM s)
    SELECT u.id, CASE WHEN round(sim, 12) >= 0.2 THEN b.category ELSE 'Miscellaneous' END AS category FROM u LEFT JOIN (SELECT * FROM b WHERE k = 1) b ON b.doc_id = u.id"""
)
def filed_messages(spark, conversations):
    centres = spark.createDataFrame([("a", "subject", 0.6), ("a", "user", 0.8), ("b", "subject", 0.6), ("b", "assistant", 0.8)], "category string, term string, weight double")
    return mail.archived(_messages(conversations), centres)["messages"].select("id", "category")


@query(f"WITH {_MESSAGES} SELECT sender AS source, recipient AS target, CAST(count(*) + max(CASE WHEN recipient LIKE 'team0%' THEN 10 ELSE 0 END) AS BIGINT) AS n FROM m GROUP BY sender, recipient UNION ALL SELECT 'nobody', 'team0@mail.example', 10")
def grown_network(conversations):
    rows = _messages(conversations)
    stored = rows.filter("recipient like 'team0%'").select(F.col("sender").alias("source"), F.col("recipient").alias("target")).distinct()
    stored = stored.union(conversations.sparkSession.createDataFrame([("nobody", "team0@mail.example")], "source string, target string")).withColumn("n", F.lit(10).cast("long"))
    return mail.added_edges(mail.network_edges(rows), stored)


@query(f"WITH {_MESSAGES} SELECT CAST(date_trunc('week', sent) AS DATE) AS week, count(*) FILTER (sender LIKE '%user@%') AS sent, count(*) FILTER (recipient LIKE '%user@%') AS received FROM m GROUP BY 1 HAVING count(*) FILTER (sender LIKE '%user@%') > 0 OR count(*) FILTER (recipient LIKE '%user@%') > 0")
def weekly_mail(conversations):
    found = mail.weekly_counts(_messages(conversations), "user@")
    return found.select(F.to_date("week").alias("week"), "sent", "received")


@query(
    """WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Nation' || c_nationkey WHEN 1 THEN ' NICK' || c_nationkey || ' ' ELSE 'plain' || c_custkey END AS name FROM customer)
    SELECT r.id, lower(x.c_name) || '@mail.example' AS address FROM r JOIN customer x ON r.name = 'Nation' || x.c_nationkey AND r.id % 3 = 0 UNION
    SELECT id, CASE WHEN id % 3 = 1 THEN 'own' || trim(lower(replace(name, 'NICK', ''))) || '@mail.example' ELSE lower(name) END FROM r WHERE id % 3 != 0"""
)
def expanded_addresses(customer, nation):
    key, own = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    asked = customer.select(key.alias("id"), F.when(key % 3 == 0, F.concat(F.lit("Nation"), own)).when(key % 3 == 1, F.concat(F.lit(" NICK"), own, F.lit(" "))).otherwise(F.concat(F.lit("plain"), key.cast("string"))).alias("name"))
    lists = customer.select(F.concat(F.lit("nation"), own).alias("list"), F.concat(F.lower("c_name"), F.lit("@mail.example")).alias("address"))
    nick = nation.select(F.concat(F.lit("nick"), F.col("n_nationkey").cast("string")).alias("nickname"), F.concat(F.lit("own"), F.col("n_nationkey").cast("string"), F.lit("@mail.example")).alias("address"))
    return mail.expanded_recipients(asked, nick, lists)


@query(f"WITH {_MESSAGES} SELECT (SELECT count(*) FROM m WHERE NOT deleted) AS n_messages, count(*) AS n_postings FROM (SELECT DISTINCT id, term FROM (SELECT id, unnest(regexp_extract_all(lower(regexp_replace(text, '[^\\x20-\\x7a]', ' ', 'g')), '[a-z0-9]+')) AS term FROM m WHERE NOT deleted) WHERE length(term) BETWEEN 3 AND 35 AND regexp_matches(term, '^[a-z]') AND term NOT IN ({_STOP}))")
def purged_archive(conversations):
    rows = _messages(conversations)
    kept, index = mail.purged(rows, inverted_index.postings(rows, "id"))
    return index.agg(F.count("*").alias("n_postings")).withColumn("n_messages", F.lit(kept.count()).cast("long"))


@query(
    f"""WITH kept AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' zzaddedzz' ELSE text END AS text FROM documents WHERE doc_id % 3 != 0), {_terms("kept")}
    SELECT doc_id, count(*) AS n, CAST(sum(tf) AS BIGINT) AS total FROM tf WHERE length(term) <= 35 GROUP BY doc_id"""
)
def maintained_index(documents):
    """An index after some documents went and others were indexed anew with a word more."""
    index = inverted_index.remove_documents(inverted_index.postings(documents), documents.filter("doc_id % 3 = 0").select("doc_id"))
    again = documents.filter("doc_id % 5 = 0 and doc_id % 3 != 0 and text is not null").withColumn("text", F.concat("text", F.lit(" zzaddedzz")))
    return inverted_index.add_documents(index, again).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tf").alias("total")).filter("n > 0")


@query(
    """WITH n AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation), m AS (SELECT 'n' || c_nationkey AS category FROM customer)
    SELECT category, CAST(sum(n) AS BIGINT) AS n FROM (SELECT category, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT p, count(*) FROM m JOIN n ON c = category GROUP BY 1
    UNION ALL SELECT c, 0 FROM n UNION ALL SELECT DISTINCT p, 0 FROM n) GROUP BY category"""
)
def category_totals(nation, customer):
    edges = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("p"), F.concat(F.lit("n"), "n_nationkey").alias("c"))
    return mail.category_counts(customer.select(F.concat(F.lit("n"), "c_nationkey").alias("category")), relational.closure(edges, "c", "p"))


@query("SELECT c_custkey, CASE WHEN n_regionkey = 2 THEN 'Miscellaneous' ELSE n_name END AS category FROM customer JOIN nation ON c_nationkey = n_nationkey")
def orphaned_rows(customer, nation):
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", F.col("n_name").alias("category"))
    return relational.orphans_to(rows, nation.filter("n_regionkey = 2").select(F.col("n_name").alias("category")), "category", "Miscellaneous")


_TF_ITEMS = f"{_terms('benchmark', 'item_id')}, v AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) AS w FROM tf)"


def _moved_sql(sign: str, weight: str) -> str:
    return f"""WITH {_TF_ITEMS}, x AS (SELECT doc_id AS id, term, w * (1 - {weight}) AS w FROM v UNION ALL SELECT doc_id - 1, term, {sign} w * {weight} FROM v WHERE doc_id - 1 IN (SELECT doc_id FROM v)),
    s AS (SELECT id, term, sum(w) AS w FROM x WHERE id + 1 IN (SELECT doc_id FROM v){" AND EXISTS (SELECT 1 FROM v o WHERE o.doc_id = x.id AND o.term = x.term)" if sign == "-" else ""} GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, term) AS k FROM s WHERE w >= 0.001), t AS (SELECT id, term, w / sum(w) OVER (PARTITION BY id) AS w FROM k WHERE k <= 100)
    SELECT id, CAST(count(*) AS BIGINT) AS n, round(max(w), 6) AS top, round(sum(w * w), 6) AS squares FROM t GROUP BY id"""


def _moved(benchmark: DataFrame, add: bool) -> DataFrame:
    maps = vectors.as_maps(vectors.frequency_vectors(vectors.term_frequencies(benchmark, "item_id")))
    a, b = maps.toDF("id", "centroid"), maps.toDF("other", "vector")
    found = a.join(b, F.col("other") == F.col("id") + 1).select("id", mail.moved_centroid(F.col("centroid"), F.lit(300.0), F.col("vector"), F.lit(60.0), add, 0.5).alias("c"))
    w = F.map_values("c")
    squares = F.aggregate(w, F.lit(0.0), lambda s, v: s + v * v)
    return found.select("id", F.size("c").cast("long").alias("n"), F.round(F.array_max(w), 6).alias("top"), F.round(squares, 6).alias("squares"))


@query(_moved_sql("", "(60 * 1.5 / 360)"))
def centroids_joined(benchmark):
    return _moved(benchmark, True)


@query(_moved_sql("-", "(60 * 1.5 / 240)"))
def centroids_left(benchmark):
    return _moved(benchmark, False)


@query(f"WITH {_TF_ITEMS}, g AS (SELECT doc_id, max(term) AS top FROM v GROUP BY doc_id) SELECT doc_id, term, round(CASE WHEN term = 'ment' THEN 0.3 ELSE w * 0.7 / (1 - coalesce((SELECT w FROM v o WHERE o.doc_id = v.doc_id AND o.term = 'ment'), 0)) END, 6) AS weight FROM v UNION ALL SELECT doc_id, 'ment', 0.3 FROM g WHERE doc_id NOT IN (SELECT doc_id FROM v WHERE term = 'ment')")
def reweighted_terms(benchmark):
    maps = vectors.as_maps(vectors.frequency_vectors(vectors.term_frequencies(benchmark, "item_id")))
    return maps.select("doc_id", F.explode(mail.reweighted(F.col("vector"), "ment", 0.3)).alias("term", "weight")).select("doc_id", "term", F.round("weight", 6).alias("weight"))


# --- tasks


@query(
    """WITH p AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Weekly' WHEN 'view' THEN 'Monthly' WHEN 'error' THEN 'Annual' ELSE 'Once' END AS period, CAST(ts AS DATE) AS d FROM events),
    x AS (SELECT *, DATE '2024-01-15' + CAST(((isodow(d) - isodow(DATE '2024-01-15') + 3) % 7 + 7) % 7 - 3 AS INTEGER) AS weekday, DATE '2024-01-01' + CAST(least(day(d), 31) - 1 AS INTEGER) AS monthday FROM p)
    SELECT event_id, CASE period WHEN 'Weekly' THEN weekday - 1 WHEN 'Monthly' THEN monthday - 7 WHEN 'Annual' THEN d - 30 ELSE d - 7 END AS from_date,
        CASE period WHEN 'Weekly' THEN weekday + 1 WHEN 'Monthly' THEN monthday + 7 WHEN 'Annual' THEN d + 30 ELSE d + 23 END AS to_date FROM x"""
)
def task_windows(events):
    kind = F.when(F.col("event_type") == "click", "Weekly").when(F.col("event_type") == "view", "Monthly").when(F.col("event_type") == "error", "Annual").otherwise("Once")
    tasks = events.select("event_id", F.to_date("ts").alias("date"), kind.alias("period"))
    return mail.task_windows(tasks, "2024-01-15").select("event_id", "from_date", "to_date")


@query(
    f"""WITH {_MESSAGES}, task AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'receive' ELSE 'send' END AS type, CASE WHEN item_id % 2 = 0 THEN 'user@mail.example' ELSE 'team' || (item_id % 4) || '@mail.example' END AS address,
        text AS description, DATE '2024-01-01' + CAST(item_id % 50 AS INTEGER) AS f, DATE '2024-01-15' + CAST(item_id % 50 AS INTEGER) AS e FROM benchmark),
    {_terms('benchmark', 'item_id')}, a AS (SELECT doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS w FROM tf WHERE term NOT IN ('address', 'book', 'spam', 'fyi', 'acknowledge')),
    fd AS (SELECT id, text AS t, 1 AS k FROM m UNION ALL SELECT id, subject, 5 FROM m UNION ALL SELECT id, sender, 5 FROM m UNION ALL SELECT id, recipient, 1 FROM m),
    w AS (SELECT id, k, unnest(regexp_extract_all(lower(regexp_replace(t, '[^\\x20-\\x7a]', ' ', 'g')), '[a-z0-9]+')) AS term FROM fd),
    mt AS (SELECT id, term, sum(k) AS tf FROM w WHERE length(term) >= 3 AND regexp_matches(term, '^[a-z]') AND term NOT IN ({_STOP}) AND term NOT IN ('address', 'book', 'spam', 'fyi', 'acknowledge') GROUP BY ALL),
    b AS (SELECT id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM mt),
    p AS (SELECT task.id AS task, m.id AS mail FROM task JOIN m ON CAST(sent AS DATE) BETWEEN f AND e AND ((type = 'receive' AND sender = address) OR (type = 'send' AND recipient = address))),
    s AS (SELECT task, mail, sum(a.w * b.w) AS sim FROM p JOIN a ON a.doc_id = task JOIN b ON b.id = mail AND b.term = a.term GROUP BY ALL)
    SELECT id, CASE WHEN id IN (SELECT task FROM s WHERE sim > 0.1) THEN 'Complete' ELSE 'Incomplete' END AS status FROM task"""
)
def task_states(benchmark, conversations):
    key = F.col("item_id")
    day = lambda d: F.date_add(F.lit(d).cast("date"), (key % 50).cast("int"))
    tasks = benchmark.select(
        key.alias("id"), F.when(key % 2 == 0, "Receive").otherwise("Send").alias("type"), F.when(key % 2 == 0, "User@mail.example").otherwise(F.concat(F.lit("team"), (key % 4).cast("string"), F.lit("@mail.example"))).alias("address"),
        F.col("text").alias("description"), day("2024-01-01").alias("from_date"), day("2024-01-15").alias("to_date"),
    )
    return mail.task_status(tasks, _messages(conversations))


@query(
    """WITH t AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Weekly' WHEN 'view' THEN 'Once' ELSE 'Annual' END AS period, CAST(ts AS DATE) AS d FROM events)
    SELECT event_id, period, CASE period WHEN 'Annual' THEN CAST(d + (2025 - year(d)) * INTERVAL 1 YEAR AS DATE) ELSE d END AS date FROM t WHERE NOT (period = 'Once' AND d < DATE '2024-04-20' - INTERVAL 3 MONTH)"""
)
def tasks_kept(events):
    kind = F.when(F.col("event_type") == "click", "Weekly").when(F.col("event_type") == "view", "Once").otherwise("Annual")
    tasks = events.select("event_id", kind.alias("period"), F.to_date("ts").alias("date"))
    once = mail.current_tasks(tasks.filter("period = 'Once'"), "2024-04-20")
    return once.unionByName(mail.current_tasks(tasks.filter("period != 'Once'"), "2025-04-20")).select("event_id", "period", "date")


# --- pages and crawls

_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""
_SCORE = "coalesce(list_sum([CASE WHEN regexp_matches(h, '(?i)que') THEN 500 ELSE 1000 END FOR h IN regexp_extract_all(text, '(?i)(und|que)', 1)]), 0)::DOUBLE"


@query(
    rf"""WITH p AS (SELECT page_id, {_TEXT} AS text FROM pages), d AS (SELECT *, rtrim(base64(unhex(md5(text))), '=') AS digest, {_SCORE} AS relevancy FROM p),
    f AS (SELECT digest, min(page_id) AS first_id FROM d GROUP BY digest)
    SELECT page_id, digest, relevancy, CASE WHEN length(text) < 50 THEN 'Reject' WHEN page_id > first_id THEN 'Duplicate' WHEN regexp_matches(text, '(?i)\b(has|have) moved\b') THEN 'Redirect' WHEN relevancy > 10 THEN 'Done' ELSE 'Reject' END AS status
    FROM d JOIN f USING (digest)"""
)
def page_verdicts(pages):
    return crawl.judged_pages(pages.select("page_id", visible_text(F.col("html")).alias("text")), ["und", "que"]).select("page_id", "digest", "relevancy", "status")


@query(
    r"""WITH l AS (SELECT url, regexp_extract(url, '^(?:https?://)?([^/:?#]*)', 1) AS site, page_id % 100 AS priority FROM pages WHERE page_id % 4 != 0), s AS (SELECT url, regexp_extract(url, '^(?:https?://)?([^/:?#]*)', 1) AS site FROM pages WHERE page_id % 4 = 0),
    h AS (SELECT site, count(*) AS held FROM s GROUP BY site), b AS (SELECT min(site) AS blocked FROM l),
    n AS (SELECT url, any_value(site) AS site, any_value(priority) AS priority FROM l, b WHERE url NOT IN (SELECT url FROM s) AND site != blocked AND length(regexp_replace(url, '[^/]', '', 'g')) <= 6 GROUP BY url HAVING count(*) >= 1),
    k AS (SELECT url, n.site, row_number() OVER (PARTITION BY n.site ORDER BY priority DESC, url) + coalesce(held, 0) AS k FROM n LEFT JOIN h USING (site)) SELECT url, site FROM k WHERE k <= 12"""
)
def links_allowed(pages):
    links = pages.filter("page_id % 4 != 0").select("url", (F.col("page_id") % 100).alias("priority"))
    blocked = links.agg(F.min(site_of(F.col("url")))).first()[0]  # one row
    found = crawl.allowed_links(links, pages.filter("page_id % 4 = 0").select("url"), site_quota=12, blocked=[blocked] if blocked else None, most_slashes=6)
    return found.select("url", "site")


@query(
    rf"""WITH l AS (SELECT url, page_id, CASE page_id % 3 WHEN 0 THEN 'New' WHEN 1 THEN 'Done' ELSE 'Reject' END AS status, length(regexp_replace(url, '[^/]', '', 'g')) - 2 AS level, {_TEXT} AS text FROM pages),
    s AS (SELECT regexp_extract(url, '^(?:https?://)?([^/:?#]*)', 1) AS site, count(*) AS n FROM l GROUP BY 1)
    SELECT page_id, round(CASE WHEN status = 'New' THEN 10 + 1000 / (level * 10 + 1) - n * 10 + CASE WHEN regexp_matches(url, '(?i)und') THEN 1000 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)que') THEN 500 ELSE 0 END ELSE 1 END, 6) AS priority,
        CASE WHEN status = 'Done' THEN {_SCORE} ELSE 0 END AS relevance FROM l LEFT JOIN s ON s.site = regexp_extract(url, '^(?:https?://)?([^/:?#]*)', 1)"""
)
def recomputed_links(pages):
    status = F.when(F.col("page_id") % 3 == 0, "New").when(F.col("page_id") % 3 == 1, "Done").otherwise("Reject")
    links = pages.select("page_id", "url", F.lit(None).cast("string").alias("anchor"), (F.length(F.regexp_replace("url", "[^/]", "")) - 2).alias("level"), status.alias("status"), F.lit(1.0).alias("priority"), F.lit(0.0).alias("relevance"))
    found = crawl.recomputed(links, pages.select("page_id", visible_text(F.col("html")).alias("text")), ["und", "que"], key="page_id")
    return found.select("page_id", F.round("priority", 6).alias("priority"), "relevance")


@query("SELECT user_id % 20 AS crawl, string_agg('S' || (event_id % 3) || ' ' || CAST(hour(ts) AS VARCHAR) || strftime(ts, ':%M:%S') || ' => ' || event_type, ' ### ' ORDER BY ts, event_id % 3, event_type) AS log FROM events GROUP BY 1")
def crawl_logs(events):
    return crawl.status_log(events.select((F.col("user_id") % 20).alias("crawl"), (F.col("event_id") % 3).alias("spider"), F.col("ts").alias("at"), F.col("event_type").alias("message")))


@query("WITH r AS (SELECT user_id % 20 AS crawl, event_id, ts, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, CAST(event_id AS VARCHAR)) AS k, min(ts) OVER (PARTITION BY user_id % 20) AS first FROM events) SELECT crawl, CAST(event_id AS VARCHAR) AS url FROM r WHERE k <= 30 AND epoch(ts) // 1 - epoch(first) // 1 <= 36000")
def visits_within_limits(events):
    visits = events.select((F.col("user_id") % 20).alias("crawl"), F.col("event_id").cast("string").alias("url"), F.col("ts").alias("at"))
    return crawl.within_limits(visits, most_urls=30, most_hours=10).select("crawl", "url")


# --- groups, news and related documents

_UNIT = "unit AS (SELECT doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS w FROM tf)"
_PAIRS = "pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS sim FROM unit a JOIN unit b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL)"


@query(
    f"""WITH {_terms()}, {_UNIT}, s AS (SELECT a.doc_id, b.doc_id AS other, sum(a.w * b.w) AS sim FROM unit a JOIN unit b ON a.term = b.term AND a.doc_id != b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, other) AS rank FROM s) SELECT doc_id, other, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 10"""
)
def related_documents_top10(documents):
    """Every fiftieth document against all documents."""
    tf = _tf(documents)
    found = vectors.related_to(documents.filter("doc_id % 50 = 0"), vectors.frequency_vectors(tf), vectors.vector_classes(tf))
    return found.select("doc_id", "other", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@query(
    f"""{_BENCH}, e AS (SELECT a, b FROM pairs WHERE sim >= 0.02 UNION ALL SELECT b, a FROM pairs WHERE sim >= 0.02), c AS (SELECT doc_id, (doc_id // 2) AS cluster FROM (SELECT DISTINCT doc_id FROM tf)),
    n AS (SELECT cluster, count(*) AS n FROM c GROUP BY cluster), l AS (SELECT x.doc_id, count(y.doc_id) AS links FROM c x LEFT JOIN (e JOIN c y ON y.doc_id = e.b) ON e.a = x.doc_id AND y.cluster = x.cluster GROUP BY x.doc_id),
    bad AS (SELECT DISTINCT cluster FROM c JOIN n USING (cluster) JOIN l USING (doc_id) WHERE links < n - 1)
    SELECT doc_id AS node, CASE WHEN n > 1 THEN cluster END AS cluster FROM c JOIN n USING (cluster) WHERE cluster NOT IN (SELECT cluster FROM bad)"""
)
def fully_linked_groups(benchmark):
    """Of pairs of neighbouring items, those that are linked."""
    pairs = _bench_pairs(benchmark).filter("sim >= 0.02")
    tf = vectors.term_frequencies(benchmark, "item_id").select(F.col("doc_id").alias("node")).distinct()
    begun = tf.withColumn("cluster", F.expr("node div 2"))
    found = graphs.dense_clusters(pairs, begun, 1.0)
    sizes = begun.groupBy("cluster").agg(F.count("*").alias("n"))
    whole = found.filter("cluster is not null").groupBy("cluster").agg(F.count("*").alias("m")).join(sizes, "cluster").filter("n = m").select("cluster")
    alone = sizes.filter("n = 1").select("cluster")
    kept = found.join(begun.withColumnRenamed("cluster", "own"), "node")
    return kept.join(whole.union(alone).withColumnRenamed("cluster", "own"), "own", "left_semi").select("node", "cluster")


@query(
    f"""WITH {_terms()}, t AS (SELECT term, sum(tf) AS total FROM tf GROUP BY term), i AS (SELECT source AS cluster, term, sum(tf) AS n FROM tf JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY ALL),
    r AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY n * n / total DESC, term) AS k FROM i JOIN t USING (term))
    SELECT cluster, (SELECT count(*) FROM documents d WHERE d.source = r.cluster) AS size, string_agg(term, '; ' ORDER BY k) AS title FROM r WHERE k <= 3 GROUP BY cluster"""
)
def cluster_titles(documents):
    return news.clusters(documents.select("doc_id", F.col("source").alias("cluster")), documents)


@query(
    r"""WITH w AS (SELECT item_id, [x FOR x IN regexp_extract_all(text, '[A-Za-z0-9]+| +|[^A-Za-z0-9 ]')] AS w FROM benchmark),
    p AS (SELECT a.item_id AS a, b.item_id AS b, a.w AS x, b.w AS y FROM w a JOIN w b ON b.item_id = a.item_id + 1),
    i AS (SELECT a, b, unnest(range(1, len(x) + 1)) AS i, x, y FROM p), m AS (SELECT a, b, i - j AS d, i FROM (SELECT a, b, i, x[i] AS t, y, unnest(range(1, len(y) + 1)) AS j FROM i) WHERE y[j] = t),
    g AS (SELECT a, b, d, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS run FROM m), r AS (SELECT a, b, count(*) AS n FROM g GROUP BY a, b, d, run)
    SELECT p.a, p.b, round(coalesce((SELECT max(n) FROM r WHERE r.a = p.a AND r.b = p.b), 0) / least(len(x), len(y)), 6) AS overlap FROM p WHERE len(x) > 0 AND len(y) > 0"""
)
def neighbour_overlap(benchmark):
    a, b = benchmark.select(F.col("item_id").alias("a"), F.col("text").alias("x")), benchmark.select(F.col("item_id").alias("b"), F.col("text").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(summaries.overlap("x", "y"), 6).alias("overlap"))


# --- questions

_IDF = "idf AS (SELECT term, log2((SELECT count(DISTINCT doc_id) FROM tf) / count(*)) + 1 AS idf FROM tf GROUP BY term)"


@query(
    f"""WITH {_terms()}, {_IDF}, wb AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), wd AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
    gb AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM wb), (VALUES (1), (2), (3)) AS z(size) WHERE i + size - 1 <= len(w)),
    gd AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM wd), (VALUES (1), (2), (3)) AS z(size) WHERE i + size - 1 <= len(w)),
    one AS (SELECT item_id, gram, idf * CASE WHEN gram IN ('ment', 'tion') THEN 2 ELSE 1 END AS mass FROM gb JOIN idf ON term = gram WHERE size = 1),
    more AS (SELECT item_id, gram, CASE size WHEN 2 THEN 1.5 ELSE 4.0 END::DOUBLE / count(*) OVER (PARTITION BY item_id, size) AS w FROM gb WHERE size > 1),
    noun AS (SELECT item_id, 'ing' AS gram, 16.0::DOUBLE * 2 / 3 AS w FROM benchmark UNION ALL SELECT item_id, 'que', 16.0::DOUBLE / 3 FROM benchmark),
    every AS (SELECT item_id, gram, mass / sum(mass) OVER (PARTITION BY item_id) AS w FROM one UNION ALL SELECT * FROM more UNION ALL SELECT * FROM noun),
    hit AS (SELECT item_id, doc_id, w FROM gd JOIN every USING (gram) UNION ALL SELECT item_id, doc_id, 8.0 FROM benchmark, documents WHERE item_id % 4 = 0 AND source = 'web'),
    s AS (SELECT item_id AS query_id, doc_id, sum(w) AS score FROM hit GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10"""
)
def answers_in_full(spark, documents, benchmark):
    tf = _tf(documents)
    n = tf.select("doc_id").distinct().count()
    idf = vectors.document_frequencies(tf).select("term", (F.log2(F.lit(float(max(n, 1))) / F.col("df")) + 1).alias("idf"))
    asked = benchmark.select(F.col("item_id").alias("query_id"), "text")
    nouns = asked.select("query_id", F.explode(F.array(F.struct(F.lit("ing").alias("word"), F.lit(2.0).alias("weight")), F.struct(F.lit("que").alias("word"), F.lit(1.0).alias("weight")))).alias("n")).select("query_id", "n.word", "n.weight")
    wanted = asked.filter("query_id % 4 = 0").select("query_id", F.lit("place").alias("type"))
    entities = documents.filter("source = 'web'").select("doc_id", F.lit("place").alias("type"))
    phrases_ = spark.createDataFrame([("ment tion",)], "phrase string")
    scores = questions.sentence_scores(documents, asked, idf, phrases_, wanted, entities, nouns)
    return questions.best_answers(scores).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_terms('benchmark', 'item_id')}, n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT doc_id, term, tf * (log2(n) - log2(df) + 1) AS w FROM tf JOIN d USING (term), n), l AS (SELECT doc_id, term, w / sum(w) OVER (PARTITION BY doc_id) AS w FROM w),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS k FROM l), c AS (SELECT doc_id, term, floor(round(w * 1000, 6)) / 1000 AS w FROM k WHERE k <= 250),
    unit AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM c), s AS (SELECT a.doc_id, b.doc_id AS other, sum(a.w * b.w) AS sim FROM unit a JOIN unit b ON a.term = b.term AND a.doc_id != b.doc_id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, other) AS rank FROM s) SELECT doc_id, other, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 10"""
)
def faq_related(benchmark):
    _, found = questions.faq_entries(benchmark.withColumnRenamed("item_id", "doc_id"))
    return found.select("doc_id", "other", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@query(
    r"""WITH q AS (SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM benchmark), qt AS (SELECT question_id, term, count(*) AS w FROM q GROUP BY ALL),
    g AS (SELECT item_id AS question_id, CASE WHEN regexp_matches(lower(text), '\bthe\b') THEN 'the' ELSE 'other' END AS category FROM benchmark), ok AS (SELECT category FROM g GROUP BY 1 HAVING count(*) >= 3),
    c AS (SELECT category, term, sum(w) AS n FROM qt JOIN g USING (question_id) JOIN ok USING (category) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, term) AS k FROM c),
    p AS (SELECT category, term, round(n / sum(n) OVER (PARTITION BY category), 5) AS w FROM r WHERE k <= 500), a AS (SELECT question_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY question_id)) AS w FROM qt), b AS (SELECT category, term, w / sqrt(sum(w * w) OVER (PARTITION BY category)) AS w FROM p),
    s AS (SELECT question_id, category, sum(a.w * b.w) AS s FROM a JOIN b USING (term) GROUP BY ALL)
    SELECT qq.question_id, oo.category, round(coalesce(s, 0), 6) AS s5, CAST(2 AS BIGINT) AS times FROM g qq JOIN ok oo ON oo.category = qq.category LEFT JOIN s ON s.question_id = qq.question_id AND s.category = oo.category"""
)
def training_patterns(benchmark):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)
    actual = benchmark.select(F.col("item_id").alias("question_id"), F.when(F.lower("text").rlike(r"\bthe\b"), "the").otherwise("other").alias("category"))
    rows = benchmark.select(F.col("item_id").alias("question_id"), F.lit("vector").alias("kind"), F.explode(words).alias("term"))
    profile = questions.category_profile(rows.join(actual, "question_id"), least=3)
    weighed = rows.groupBy("question_id", "kind", "term").agg(F.count("*").cast("double").alias("weight"))
    found = questions.training_patterns(weighed, profile, actual)
    return found.filter("label").groupBy("question_id", "category").agg(F.round(F.max("s5"), 6).alias("s5"), F.count("*").alias("times"))


@query(
    f"""WITH s AS (SELECT * FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id < d.doc_id)), {_terms("s")},
    w AS (SELECT doc_id, sum(tf) AS weight FROM tf WHERE term IN ('sch', 'tion') AND term NOT IN ('reuters', 'ap', 'iht', 'upi') GROUP BY doc_id),
    r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, doc_id) AS k FROM w) SELECT doc_id, CAST(weight AS BIGINT) AS weight FROM r WHERE k <= 10"""
)
def story_search(documents):
    return news.search_stories(inverted_index.postings(news.distinct_stories(documents), kinds="news"), "sch tion")
