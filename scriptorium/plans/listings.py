"""More registered queries: listings, chapters, links, feeds, replies and stored tables, each over whole tables with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import html as hx
from scriptorium.functions import text as tx
from scriptorium.operators import catalog, cleaning, library, news, segment
from scriptorium.operators import session as sess
from scriptorium.plans.catalogue import query
from scriptorium.session import load

LIST_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"


# ---------------------------------------------------------------- listings (SRT-01..03, FLT-06/10/11, AGG-13/14, SRT-07, PRJ-14)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS read_at, o_orderkey + 7 AS added FROM orders ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 7 ELSE o_custkey END DESC, o_orderkey LIMIT 50")
def last_read(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("read_at"), (F.col("o_orderkey") + 7).alias("added"))
    # Equal times are told apart by the key, so that the shelf of 50 is one and the same.
    shelf = library.by_last_read(o.withColumns({"read_at": F.col("read_at") * 10_000_000 - F.when(F.col("read_at") == 0, 0).otherwise(F.col("o_orderkey")), "added": F.col("added") * 10_000_000 - F.col("o_orderkey")})).limit(50)
    return shelf.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise((F.col("read_at") + F.col("o_orderkey")) / 10_000_000).cast("long").alias("read_at"), (F.col("o_orderkey") + 7).alias("added"))


@query("SELECT p_name AS name, p_size < 10 AS readable FROM part ORDER BY p_size >= 10, lower(p_name) LIMIT 40")
def readable_files(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (F.col("p_size") < 10).alias("readable"))
    return library.readable_first(p).limit(40)


@query("SELECT conv_id AS session_id, count(*) AS chapters, max(turn) AS last FROM conversations GROUP BY 1")
def session_list(spark, sf_dir):
    return library.sessions(load(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id"), at="turn")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'under') OR doc_id = 17 UNION ALL SELECT -doc_id FROM documents WHERE contains(lower(text), '17') OR doc_id = 17")
def chapter_search(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    by_word = d.where("doc_id <> 17").transform(lambda x: library.chapters_like(x, "UNDER", "doc_id", "text")).union(library.chapters_like(d, "17", "doc_id", "text").where("doc_id = 17"))
    return by_word.select("doc_id").union(library.chapters_like(d, "17", "doc_id", "text").select(-F.col("doc_id")))


@query("""WITH f AS (SELECT s_suppkey % 5 = 0 AS disabled, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name AS country, count(*) FILTER (NOT disabled) AS enabled, count(*) AS total FROM f WHERE n_name = (SELECT min(n_name) FROM nation) GROUP BY 1""")
def feed_search(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    s = load(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 5 == 0).alias("disabled"))
    country = n.agg(F.min("n_name")).first()[0]
    return library.feeds_like(s, country, "SUPPLIER")[1].select(F.lit(country).alias("country"), "enabled", "total").where("total > 0")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0")
def usable_feeds(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5 == 0).alias("disabled"), F.when(F.col("s_suppkey") % 14 == 0, None).when(F.col("s_suppkey") % 7 == 0, "").otherwise("http://x").alias("url"))
    return library.usable_feeds(s).select("s_suppkey")


@query("SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0 AND url IS NOT NULL)")
def next_page_rows(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    return library.next_page(p.where("page_id % 3 = 0"), p).select("page_id")


@query("SELECT event_id, ts FROM events ORDER BY (CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END) DESC NULLS LAST, event_id LIMIT 60")
def newest_events(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("published_at"))
    return news.newest_first(e, then="event_id").limit(60).select("event_id", "ts")


@query("SELECT count(*) FILTER (p_size % 2 = 0) AS selected, count(*) FILTER (p_size % 2 = 0 AND p_size >= 10) AS unreadable FROM part")
def selected_files(spark, sf_dir):
    return library.selection_counts(load(spark, sf_dir, "part").select((F.col("p_size") % 2 == 0).alias("selected"), (F.col("p_size") < 10).alias("readable")))


@query("""WITH a AS (SELECT o_custkey AS slug, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority || o_orderkey END AS name, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'c' || o_orderkey END AS cover FROM orders)
SELECT slug, min(pos) AS pos, arg_min(name, pos) FILTER (name <> '') AS name, coalesce(arg_min(cover, pos) FILTER (cover <> ''), '') AS cover FROM a GROUP BY slug HAVING count(*) FILTER (name <> '') > 0""")
def merged_slugs(spark, sf_dir):
    k = F.col("o_orderkey")
    a = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"), k.alias("pos"), F.when(k % 3 == 0, "").otherwise(F.concat("o_orderpriority", k.cast("string"))).alias("name"), F.when(k % 2 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("cover"))
    return library.merge_slugs(a)


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT day, sum(n)::BIGINT AS n, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_category FROM c GROUP BY day""")
def stored_days(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("category"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("by_category")), lambda r: F.concat(r["key"], F.lit("="), r["value"].cast("string"))), ",")
    return library.days(e).select("day", "n", text.alias("by_category"))


@query("""SELECT o_orderpriority AS book_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS cached, count(*) FILTER (o_orderstatus = 'P') AS failed,
round(100 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS percent FROM orders GROUP BY 1""")
def job_progress(spark, sf_dir):
    s = F.col("o_orderstatus")
    return library.progress(load(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "book_id"), "book_id", s == "F", s == "O", s == "P")


# ---------------------------------------------------------------- chapters (FLT-12/15/16/18, PRJ-13, AGG-11, JN-15, OPS-06/12, WIN-07/09)


@query("WITH c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, idx FROM c WHERE idx BETWEEN 3 AND least(n, 40)")
def chapter_range(spark, sf_dir):
    from pyspark.sql import Window

    d = load(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("idx"))
    return library.in_range(d, 3, 40, book="source")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN source || ' ' || doc_id ELSE 'Part ' || doc_id END AS title FROM documents")
def bare_titles(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("source"), F.lit(" - Part "), i)).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(": Part "), i)).otherwise(F.concat("source", F.lit(" "), i))
    return load(spark, sf_dir, "documents").select("doc_id", library.title_without_book(title, F.col("source")).alias("title"))


@query("SELECT doc_id, coalesce(length(text), 0) < 200 AS locked FROM documents")
def locked_bodies(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", library.locked(F.col("text")).alias("locked"))


@query("SELECT source AS book_id, count(DISTINCT doc_id) AS stored, max(doc_id) AS last FROM documents GROUP BY 1")
def stored_chapters(spark, sf_dir):
    return library.stored_counts(load(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("idx")))


@query("SELECT source AS book_id, doc_id AS idx FROM documents WHERE doc_id % 7 = 3")
def second_pass(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("idx"))
    return library.failed_again(d, d.where("idx % 7 = 3").union(d.where("idx % 14 = 3")))


@query("""WITH s AS (SELECT source, doc_id FROM documents WHERE doc_id % 2 = 0), l AS (SELECT source, max(doc_id) AS last FROM s GROUP BY 1)
SELECT source AS book_id, doc_id AS idx, 'fetch' AS what FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT source, last, 'drifted' FROM l WHERE last % 3 = 0""")
def book_refresh(spark, sf_dir):
    i = F.col("doc_id")
    listed = load(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), i.alias("idx"), F.concat(F.lit("Chapter  "), i.cast("string")).alias("title"))
    stored = listed.where("idx % 2 = 0").withColumn("title", F.when(F.col("idx") % 3 == 0, F.concat("title", F.lit(" old"))).otherwise(F.upper(F.regexp_replace("title", "  ", " "))))
    fetch, drifted = library.refresh(stored, listed)
    return fetch.select("book_id", "idx", F.lit("fetch").alias("what")).union(drifted.select("book_id", "last_idx", F.lit("drifted")))


@query(f"SELECT doc_id, len({LIST_LINES}) >= 3 OR coalesce(list_sum(list_transform({LIST_LINES}, lambda x: length(x))), 0) >= 120 AS kept FROM documents")
def kept_openings(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    return load(spark, sf_dir, "documents").select("doc_id", cleaning.worth_keeping(lines).alias("kept"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def title_lines_dropped(spark, sf_dir):
    """A title is put before each document, once or twice, and goes again."""
    title = F.concat(F.lit("§ "), F.col("doc_id").cast("string"))
    again = F.when(F.col("doc_id") % 2 == 0, F.concat(title, F.lit("\n"))).otherwise("")
    d = load(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.concat(title, F.lit(" \n"), again, "text").alias("text"))
    return cleaning.drop_title_lines(tx.lines_of(d, "text"), ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Work ' || doc_id END AS title, len({LIST_LINES}) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS items FROM documents")
def lifted_titles(spark, sf_dir):
    """Even documents have one heading above another, odd ones two of a level."""
    level = F.when(F.col("doc_id") % 2 == 0, "## part").otherwise("# part")
    text = F.concat(F.lit("# Work "), F.col("doc_id").cast("string"), F.lit("\n"), level, F.lit("\n"), "text")
    d = load(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    titles, items = segment.lift_title(segment.markdown_items(tx.lines_of(d, "text"), ["doc_id"]), ["doc_id"])
    return items.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("items")).join(titles, "doc_id", "left").select("doc_id", "title", "items")


@query("""WITH m AS (SELECT o_custkey AS book, row_number() OVER w AS idx, o_orderkey, lead(o_orderkey) OVER w AS nxt, max(o_orderkey) OVER (PARTITION BY o_custkey) AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT book, idx, 't' || o_orderkey AS title, o_orderkey AS first, coalesce(nxt, top + 5) AS last FROM m WHERE (SELECT count(*) FROM orders o WHERE o.o_custkey = m.book) >= 2""")
def bookmark_pages(spark, sf_dir):
    k = F.col("o_orderkey")
    marks = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), k.alias("pos"), F.lit(1).alias("level"), F.concat(F.lit("t"), k.cast("string")).alias("title"), (k + 1).alias("page"))
    pages = marks.groupBy("book").agg((F.max("pos") + 5).alias("n"))
    return segment.bookmark_ranges(marks, pages, ["book"]).withColumn("idx", F.col("idx").cast("long"))


# ---------------------------------------------------------------- links (JN-13/14, FLT-08/09, OPS-02, PRJ-11/18/20, SRC-21)


@query(r"SELECT DISTINCT url AS link, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, 'page=') THEN 'paged' ELSE 'any' END AS source FROM pages WHERE url IS NOT NULL AND url <> ''")
def first_source(spark, sf_dir):
    patterns = spark.createDataFrame([("off", ".", 0, True), ("english", "/en/", 1, False), ("paged", "page=\\d*", 2, False), ("any", ".", 3, False)], "source string, pattern string, ord int, disabled boolean")
    return library.first_match(load(spark, sf_dir, "pages").select(F.col("url").alias("link")), patterns)


@query(r"""WITH b AS (SELECT url, 'b' || page_id AS slug FROM pages WHERE page_id % 4 = 0), l AS (SELECT url AS link FROM pages UNION SELECT 'http://x/b' || page_id || '.html?q' FROM pages)
SELECT DISTINCT link FROM l WHERE link IN (SELECT url FROM b) OR regexp_extract(link, '^http://x/(b\d+)\.html', 1) IN (SELECT slug FROM b)""")
def owned_links(spark, sf_dir):
    p, slug = load(spark, sf_dir, "pages").select("page_id", "url"), F.concat(F.lit("b"), F.col("page_id").cast("string"))
    links = p.select(F.col("url").alias("link")).union(p.select(F.concat(F.lit("http://x/"), slug, F.lit(".html?q"))))
    return library.owned(links, p.where("page_id % 4 = 0").select("url", slug.alias("slug")))


@query("SELECT page_id, page_id % 3 = 0 OR regexp_matches(coalesce(url, ''), '/(download|tai-xuong|taixuong|file|files|attachment|upload|uploads|releases/download|media)(/|\\?|$)', 'i') AS document FROM pages")
def document_links(spark, sf_dir):
    label = F.when(F.col("page_id") % 3 == 0, F.when(F.col("page_id") % 2 == 0, "Tải xuống").otherwise("BẢN PDF")).otherwise("read on")
    return load(spark, sf_dir, "pages").select("page_id", tx.like_document(label, F.col("url")).alias("document"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+(.*)$', 1) AS path, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin FROM pages)
SELECT page_id FROM p WHERE NOT (starts_with(CASE WHEN path = '' THEN '/' ELSE path END, '/en/') AND NOT starts_with(path, '/en/1'))""")
def robots_pages(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    origins = p.select(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("origin")).distinct()
    rules = origins.select("origin", F.lit("/en/").alias("prefix"), F.lit(False).alias("allow")).union(origins.select("origin", F.lit("/en/1"), F.lit(True)))
    return catalog.robots_allow(p, rules).select("page_id")


@query("""WITH e AS (SELECT doc_id // 8 AS work, doc_id % 8 AS page FROM documents), w AS (SELECT work, max(page) AS n FROM e GROUP BY 1 HAVING min(page) = 0)
SELECT work, 'http://h/w' || work || '?page=' || (k + 1) AS url FROM w, LATERAL (SELECT unnest(generate_series(0, least(n + 1, 4))) AS k)""")
def page_walk(spark, sf_dir):
    """Works of eight pages, each leading to the next; five pages of a work at most."""
    work = F.expr("doc_id div 8")
    page = lambda n: F.concat(F.lit("http://h/w"), work.cast("string"), F.lit("?page="), n.cast("string"))
    d, k = load(spark, sf_dir, "documents"), F.col("doc_id") % 8
    edges = d.select(page(k + 1).alias("from_url"), F.explode(F.array(F.concat(page(k + 2), F.lit("#x")), page(k + 1), F.lit("http://h/about"))).alias("href"))
    return catalog.walk_pages(edges, d.where("doc_id % 8 = 0").select(work.alias("work"), page(F.lit(1)).alias("url")), limit=5)


@query(r"""WITH u AS (SELECT page_id, [url, 'http://l/list?page=' || (page_id % 600), url] AS urls FROM pages)
SELECT page_id, CASE WHEN regexp_matches(coalesce(urls[1], ''), 'trang[-=/]\d+|[?&]page=\d+|/page/\d+', 'i') THEN regexp_replace(urls[1], '(trang[-=/]|[?&]page=|/page/)\d+', '\1@', 'i') ELSE 'http://l/list?page=@' END AS template,
least(400, greatest(page_id % 600, coalesce(TRY_CAST(regexp_extract(urls[1], '(trang[-=/]|[?&]page=|/page/)(\d+)', 2, 'i') AS INT), 0)))::INT AS pages FROM u""")
def list_pages(spark, sf_dir):
    urls = F.array(F.coalesce("url", F.lit("")), F.concat(F.lit("http://l/list?page="), (F.col("page_id") % 600).cast("string")))
    return load(spark, sf_dir, "pages").select("page_id", hx.page_pattern(urls).alias("p")).select("page_id", F.replace("p.template", F.lit("\0"), F.lit("@")).alias("template"), "p.pages")


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'docx' WHEN 3 THEN 'zip' ELSE '' END AS kind, CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' ELSE 'jpg' END AS cover,
page_id % 6 NOT IN (0, 1, 2) AS embeds FROM pages""")
def header_rules(spark, sf_dir):
    def pick(n, *values):
        c = F.lit(values[-1])
        for i, v in enumerate(values[:-1]):
            c = F.when(F.col("page_id") % n == i, v).otherwise(c)
        return c

    mime = pick(5, "application/pdf; charset=x", " Application/EPUB+zip", "application/octet-stream", None, "text/css")
    named = pick(5, None, "attachment; filename=x.doc", 'attachment; filename="a%20b.DOCX"', "attachment; filename*=UTF-8''x.zip", "inline")
    cover = tx.cover_ext(pick(4, "http://h/c", "http://h/c.JPEG?x", "http://h/c.webp#x", None), pick(4, "image/png", "image/png", "image/gif", "x"))
    embeds = library.may_embed(pick(6, "DENY", "SameOrigin", None, None, None, "ALLOWALL"), pick(6, None, None, "frame-ancestors 'self'", "frame-ancestors *; x", "default-src 'self'", None))
    return load(spark, sf_dir, "pages").select("page_id", tx.header_kind(mime, named).alias("kind"), cover.alias("cover"), embeds.alias("embeds"))


# ---------------------------------------------------------------- texts (PRJ-02/15/19/25, SNK-07, SCL-03/16/17, FLT-17/19/20, SCL-19)


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS plain, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def page_texts(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(tx.strip_tags(F.col("html")), 256).alias("plain"), F.sha2(tx.escape_html(F.col("html")), 256).alias("escaped"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END) AS capped, regexp_matches(trim(text, chr(10) || ' '), '[.!?…\"”’』」*)\\]]$') AS finished, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS cjk, lang IS NULL OR lang <> 'fr' AS wanted, left(lower(coalesce(lang, '')), 2) = 'fr' AS same FROM documents")
def text_rules(spark, sf_dir):
    t, lang = F.col("text"), F.col("lang")
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.cap(t, 300), 256).alias("capped"), tx.ends_well(t).alias("finished"), tx.is_cjk(t).alias("cjk"), library.needs_translation(lang, "fr").alias("wanted"), library.same_language(lang, "fr").alias("same"))


@query("SELECT p_partkey, upper(left(string_split(p_name, ' ')[1], 1) || left(coalesce(string_split(p_name, ' ')[2], ''), 1)) AS initials FROM part")
def part_initials(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", tx.initials(F.concat(F.lit("  "), "p_name")).alias("initials"))


@query("""SELECT doc_id, doc_id % 4 <> 3 AS same_text, sha256(CASE WHEN doc_id % 3 = 0 THEN 'dich ' || text ELSE text END) AS shown, doc_id % 5 <> 0 AND doc_id % 5 <> 4 AND length(text) > 20 AS accepted FROM documents""")
def compared_texts(spark, sf_dir):
    i, t = F.col("doc_id"), F.col("text")
    other = F.when(i % 4 == 0, F.concat(F.lit(" - "), t)).when(i % 4 == 1, F.regexp_replace(t, "[ .,]", "*")).when(i % 4 == 2, F.concat(t, F.lit("!"))).otherwise(F.concat(t, F.lit("x")))
    own = F.when(i % 3 == 0, F.concat(F.lit("dich "), t)).when(i % 3 == 1, "")
    rewrite = F.when(i % 5 == 0, "").when(i % 5 == 4, F.concat(t, t)).otherwise(F.concat(t, F.lit("...")))
    d = load(spark, sf_dir, "documents")
    accepted = tx.rewrite_accepted(t, rewrite) & (F.length(t) > 20)
    return d.select("doc_id", tx.same_text(t, other).alias("same_text"), F.sha2(library.displayed(t, own, F.lit("vi"), "vi"), 256).alias("shown"), accepted.alias("accepted"))


@query("SELECT p_partkey, p_name AS old_name, 'p' || p_partkey AS new_name FROM part")
def name_maps(spark, sf_dir):
    text = F.concat(F.lit("no map\n = x\n "), "p_name", F.lit(" =  p"), F.col("p_partkey").cast("string"))
    d = load(spark, sf_dir, "part").select("p_partkey", F.explode(tx.name_map(text)).alias("old_name", "new_name"))
    return d


# ---------------------------------------------------------------- replies of models (SCL-11..15, SCL-21, OPS-10)


@query("SELECT conv_id, turn, sha256(trim(text, ' ' || chr(10))) AS body, turn > 0 AND turn % 4 = 0 AS summary FROM conversations")
def plain_replies(spark, sf_dir):
    """Thoughts around whole texts go again."""
    t = F.concat(F.lit("<think>first\n</think> "), "text", F.when(F.col("turn") % 2 == 0, "\n<THINK> and then").otherwise(""))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(tx.drop_thinking(t), 256).alias("body"), sess.needs_summary(F.col("turn")).alias("summary"))


@query("""SELECT conv_id, turn, sha256(trim(text, ' ' || chr(10))) AS body, CASE WHEN turn % 2 = 0 THEN '{"k": ' || turn || '}' END AS state FROM conversations""")
def split_replies(spark, sf_dir):
    state = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('\n=== TRANG THAI ===\nso: {"k": '), F.col("turn").cast("string"), F.lit("}."))).otherwise("")
    reply = F.concat(F.lit("=== DAN CANH ===\nplan\n=== CHUONG ===\n"), "text", state)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.split_reply(reply).alias("r")).select("conv_id", "turn", F.sha2("r.body", 256).alias("body"), "r.state")


@query("""WITH g AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source, (doc_id // 40) ORDER BY doc_id) AS k FROM documents)
SELECT source, doc_id, CASE WHEN k % 3 = 0 THEN 'o' || doc_id ELSE 't' || doc_id END AS line FROM g""")
def numbered_replies(spark, sf_dir):
    """Batches of chapters; each third is missing in the reply, and some numbers come twice."""
    d = load(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id div 40").alias("batch")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    part = F.transform("ids", lambda x, i: F.when((i + 1) % 3 != 0, F.concat((i + 1).cast("string"), F.lit(". t"), x.cast("string"), F.lit("\n"), (i + 1).cast("string"), F.lit(") again\n"))).otherwise("noise\n"))
    lines = tx.numbered_lines(F.array_join(part, ""), F.transform("ids", lambda x: F.concat(F.lit("o"), x.cast("string"))))
    return d.select("source", F.explode(F.arrays_zip(F.col("ids").alias("doc_id"), lines.alias("line"))).alias("r")).select("source", "r.*")


@query("""SELECT s_suppkey, s_suppkey::INT AS n, s_suppkey % 3 <> 0 AS yes, 'nm' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' — ' || s_nationkey ELSE s_name END AS item FROM supplier""")
def verdict_lines(spark, sf_dir):
    k, i = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    line = F.concat(F.lit(" "), i, F.lit("| "), F.when(k % 3 == 0, "no").when(k % 3 == 1, "CÓ").otherwise("Yes"), F.lit(" | nm"), i, F.lit(" "))
    item = F.when(k % 2 == 0, F.to_json(F.struct(F.col("s_name").alias("a"), F.lit(" ").alias("b"), F.col("s_nationkey").cast("string").alias("c")))).otherwise(F.concat(F.lit('"'), "s_name", F.lit('"')))
    return load(spark, sf_dir, "supplier").select("s_suppkey", tx.verdict_line(line).alias("v"), tx.list_item(item).alias("item")).select("s_suppkey", "v.*", "item")


@query("""SELECT conv_id, turn, sha256('Text:' || chr(10) || CASE WHEN length(text) > 50 THEN left(text, 50) || chr(10) || '[…]' ELSE text END || CASE WHEN role = 'user' THEN chr(10) || chr(10) || 'Role:' || chr(10) || role ELSE '' END) AS prompt FROM conversations WHERE text <> ''""")
def prompts(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where("text <> ''")
    prompt = sess.sections_prompt([("Text", F.col("text"), 50), ("None", F.lit(""), 9), ("Role", F.when(F.col("role") == "user", F.col("role")), 20)])
    return c.select("conv_id", "turn", F.sha2(prompt, 256).alias("prompt"))


# ---------------------------------------------------------------- feeds and stored tables (SRC-04, SRC-19, AGG-15, SNK-04, JN-07, OPS-07, SET-02, WIN-03)


FEEDS = "WITH f AS (SELECT s_suppkey AS id, s_nationkey AS country, s_suppkey % 6 AS n FROM supplier)"


def _feeds(spark, sf_dir):
    item = F.lit("<item><title>t</title><pubDate>Fri, 01 Mar 2024 10:30:00 +0000</pubDate></item>")
    k = F.col("s_suppkey")
    xml = F.concat(F.lit("<rss><channel>"), F.repeat(item, (k % 6).cast("int")), F.lit("</channel></rss>"))
    return load(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("country"), xml.alias("xml"))


@query(f"{FEEDS} SELECT id, country, n AS items, CASE WHEN n > 0 THEN 25.5 END AS age_hours, n >= 3 AS alive FROM f")
def feed_probe(spark, sf_dir):
    from scriptorium.sources.feeds import probe

    return probe(_feeds(spark, sf_dir), F.lit("2024-03-02 12:00:00").cast("timestamp")).withColumn("items", F.col("items").cast("long"))


@query(f"{FEEDS} SELECT country, count(*) FILTER (n >= 3) AS alive, count(*) FILTER (n < 3) AS dead FROM f GROUP BY country")
def feed_health(spark, sf_dir):
    from scriptorium.sources.feeds import health, probe

    return health(probe(_feeds(spark, sf_dir), F.lit("2024-03-02 12:00:00").cast("timestamp")))


@query("""WITH a AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS category, '* e' || event_id || CASE WHEN user_id % 2 = 0 THEN chr(10) || 'u' || user_id ELSE '' END AS b, event_id FROM events)
SELECT day, category, CASE WHEN category = 'click' THEN 'Clicks' ELSE category END AS name, sha256(CASE WHEN category = 'click' THEN 'Clicks' ELSE category END || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY event_id)) AS text FROM a GROUP BY day, category""")
def day_digests(spark, sf_dir):
    from scriptorium.sinks.writers import digests

    u = F.col("user_id")
    a = load(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("category"), "event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("title"), F.when(u % 2 == 0, F.concat(F.lit("u"), u.cast("string"))).otherwise("").alias("summary"), F.lit(None).cast("string").alias("link"))
    names = spark.createDataFrame([("click", "Clicks")], "category string, name string")
    return digests(a, names, [F.col("event_id")]).select("day", "category", "name", F.sha2("text", 256).alias("text"))


@query("""WITH b AS (SELECT o_custkey AS book_id, o_orderkey % 3 AS page, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) AS r FROM orders WHERE o_orderkey % 5 <> 0)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY r) AS idx, 'c' || o_orderkey AS title, 'u' || o_orderkey AS url, o_orderkey % 2 = 0 AS vip FROM b""")
def paged_chapters(spark, sf_dir):
    """Orders as chapters on three pages a book, each twice, some without an address."""
    from scriptorium.sources.registry import chapter_list

    k = F.col("o_orderkey")
    url = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("u"), k.cast("string")))
    entry = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("title"), url.alias("url"), F.when(k % 2 == 0, True).alias("vip"))
    pages = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("book_id"), (k % 3).alias("page")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), entry.alias("c")))).alias("l"))
    pages = pages.select("book_id", "page", F.to_json(F.concat(F.transform("l", lambda x: x["c"]), F.transform("l", lambda x: x["c"]))).alias("json"))
    return chapter_list(pages).withColumn("idx", F.col("idx").cast("long"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'new' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || o_orderkey ELSE o_orderpriority END AS priority FROM orders")
def written_back(spark, sf_dir):
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    stored = o.select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    values = o.where(k % 3 == 0).select(k.alias("k"), F.when(k % 2 == 0, "new").alias("status"), F.concat(F.lit("p"), k.cast("string")).alias("priority"))
    return catalog.write_back(stored, values.union(spark.createDataFrame([(-1, "x", "y")], values.schema)), "k")


@query("SELECT s_nationkey AS nation, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS seen FROM supplier GROUP BY 1")
def watch_registry(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.array(F.concat(F.lit("http://n"), F.col("s_nationkey").cast("string"))).alias("addresses"), F.array("s_name").alias("seen"))
    merged = catalog.upsert_watches(s, s.where(F.hash("seen") % 2 == 0))
    return merged.select(F.regexp_extract(F.col("addresses")[0], r"(\d+)", 1).cast("int").alias("nation"), F.array_join("seen", ",").alias("seen"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'A summary of page ' || page_id END AS summary FROM pages""")
def feed_summaries(spark, sf_dir):
    i = F.col("page_id")
    title = F.concat(F.lit("A summary of pâge "), i.cast("string"))
    text = F.when(i % 4 == 1, "short").when(i % 4 == 2, F.concat(F.lit("A summary - of PAGE "), i.cast("string"))).otherwise(F.concat(F.lit("A summary of page "), i.cast("string")))
    other = F.when(i % 4 == 2, title).otherwise("Some other title")
    return load(spark, sf_dir, "pages").select("page_id", news.summary(text, other).alias("summary"))


@query(r"""WITH l AS (SELECT source, doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g')) <> '')) AS n FROM documents)
SELECT doc_id || '.txt' AS name, CASE WHEN n > 450 THEN CAST(ceil(n / 300.0) AS BIGINT) WHEN n > 0 THEN 1 ELSE 0 END AS chapters, n::BIGINT AS n_lines FROM l""")
def txt_files(spark, sf_dir):
    """Documents as files in three encodings, read again."""
    from scriptorium.sources.readers import parse_files

    i = F.col("doc_id")
    content = F.when(i % 3 == 0, F.encode("text", "UTF-16")).when(i % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    works = parse_files(load(spark, sf_dir, "documents").select(F.concat(i.cast("string"), F.lit(".txt")).alias("name"), content.alias("content")))
    lines = F.aggregate("chapters", F.lit(0).cast("long"), lambda a, c: a + F.size(c["lines"]))
    return works.select("name", F.size("chapters").cast("long").alias("chapters"), lines.alias("n_lines"))


@query("""WITH c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE trim(text, ' ' || chr(10)) <> '')
SELECT source AS title, (i - 1) // 20 + 1 AS volume, count(*) AS chapters FROM c GROUP BY ALL""")
def epub_roundtrip(spark, sf_dir):
    """Books written as volumes of EPUB and read again; the information page of each is no chapter."""
    from scriptorium.sinks.writers import epub_files
    from scriptorium.sources.readers import parse_files

    d = load(spark, sf_dir, "documents").where("trim(BOTH ' \n' FROM text) <> ''")
    books = d.select(F.col("source").alias("book_id")).distinct().select("book_id", F.col("book_id").alias("title"))
    chapters = d.select(F.col("source").alias("book_id"), F.col("doc_id").alias("idx"), F.concat(F.lit("Chapter "), F.col("doc_id").cast("string")).alias("title"), F.split("text", "\n", -1).alias("lines"))
    files = epub_files(books, chapters, size=20).select(F.concat("book_id", F.lit("@"), F.col("volume").cast("string"), F.lit(".epub")).alias("name"), "content")
    found = parse_files(files).select("name", F.explode("chapters").alias("c")).where("c.title LIKE 'Chapter %'")
    book, volume = F.substring_index("name", "@", 1), F.regexp_extract("name", r"@(\d+)\.epub$", 1).cast("long")
    return found.groupBy(book.alias("title"), volume.alias("volume")).agg(F.count(F.lit(1)).alias("chapters"))
