"""Registered queries of stored works, dictionaries, limits and event-time streams, each over whole tables with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import catalog, library
from scriptorium.operators import session as sess
from scriptorium.plans.catalogue import query
from scriptorium.plans.services import _events, _streamed
from scriptorium.session import load, new_path

# ---------------------------------------------------------------- stored files (SNK-03/04/06/08/09, SRC-15)


@query("""WITH d AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT day::VARCHAR AS day, sum(n)::BIGINT AS n, count(*) AS categories, day = (SELECT max(day) FROM d) AS last FROM d WHERE day <> (SELECT min(day) FROM d) GROUP BY day""")
def day_archive(spark, sf_dir):
    """Events as an archive by day: the oldest day is deleted, and the index, a small file that is replaced whole, tells what is left."""
    from scriptorium.sinks.files import read_json, write_json
    from scriptorium.sinks.writers import drop_day, write_day

    at = new_path(spark, "days")
    write_day(load(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), f"{at}/archive")
    days = sorted(str(r["day"]) for r in load(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().collect())  # a number of days
    write_json(spark, f"{at}/index.json", {"days": days})
    drop_day(spark, f"{at}/archive", days[0])
    write_json(spark, f"{at}/index.json", {"days": days[1:], "last": days[-1]})
    index = read_json(spark, f"{at}/index.json")
    left = spark.read.parquet(f"{at}/archive").groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("categories"))
    return left.where(F.col("day").isin(index["days"])).withColumn("last", F.col("day") == index["last"])


@query("SELECT source AS book_id, doc_id AS idx, len(string_split(text, chr(10))) AS n_lines, md5(text) AS digest FROM documents")
def cached_chapters(spark, sf_dir):
    """Chapters written to the cache, one half of them a second time, and read back: a book's folder is replaced whole."""
    at = new_path(spark, "chapter-cache")
    chapters = load(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("idx"), F.split("text", "\n", -1).alias("lines"))
    library.write_cache(chapters, at)
    library.write_cache(chapters.where(F.col("book_id") > "src5"), at)
    back = spark.read.schema(chapters.schema).parquet(at)
    return back.select("book_id", "idx", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier)
SELECT s_suppkey, least(32, greatest(1, CASE WHEN s_nationkey > 20 THEN 6 ELSE s_nationkey * 3 - 4 END))::BIGINT AS threads, greatest(0, s_acctbal / 1000)::DOUBLE AS delay, 3000 + s_nationkey AS max_tokens, CASE WHEN s_acctbal < 0 THEN 'x' END AS url, 2 AS n_formats FROM s""")
def merged_settings(spark, sf_dir):
    """Stored settings of readers over the defaults."""
    s = load(spark, sf_dir, "supplier")
    ai = F.struct((F.col("s_nationkey") + 3000).alias("max_tokens"), F.when(F.col("s_acctbal") < 0, "x").alias("url"))
    stored = F.to_json(F.struct(F.when(F.col("s_nationkey") <= 20, F.col("s_nationkey") * 3 - 4).alias("threads"), (F.col("s_acctbal") / 1000).alias("delay"), ai.alias("ai")))
    m = s.select("s_suppkey", library.merged_settings(stored).alias("m"))
    get = lambda p, kind: F.get_json_object("m", p).cast(kind)
    return m.select("s_suppkey", get("$.threads", "long").alias("threads"), get("$.delay", "double").alias("delay"), get("$.ai.max_tokens", "int").alias("max_tokens"), get("$.ai.url", "string").alias("url"), F.size(F.from_json(F.get_json_object("m", "$.formats"), "array<string>")).alias("n_formats"))


@query(r"""WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM w),
tidy AS (SELECT doc_id, pos, trim(regexp_replace(line, '[ \t]+', ' ', 'g')) AS line FROM l),
held AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tidy WHERE line <> '' AND NOT regexp_matches(line, '^[^\p{L}\p{M}\p{N}\p{Pc}_]{0,40}$'))
SELECT doc_id::VARCHAR AS book_id, 1 AS idx, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM held WHERE before IS NULL OR before <> line GROUP BY doc_id""")
def imported_works(spark, sf_dir):
    """Every document as a work of one chapter, imported: lines cleaned, chapters without lines dropped."""
    d = load(spark, sf_dir, "documents")
    chapter = F.struct(F.lit("c").alias("title"), F.split("text", "\n", -1).alias("lines"))
    works = d.select(F.col("doc_id").cast("string").alias("name"), F.lit("t").alias("title"), F.lit("").alias("author"), F.array(chapter).alias("chapters"))
    _, chapters = library.import_works(works)
    return chapters.select("book_id", "idx", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


# ---------------------------------------------------------------- texts (SCL-18, SCL-24, SRT-05, OPS-08, OPS-11)

PARTS_SQL = """names AS (SELECT p_name AS term, min_by(p_brand, p_partkey) AS value FROM part GROUP BY p_name HAVING count(*) * 64 > (SELECT count(*) FROM part)),
words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part), dict AS (SELECT term, value FROM names UNION ALL SELECT term, upper(term) FROM words)"""


@query(f"""WITH RECURSIVE {PARTS_SQL}, texts AS (SELECT p_partkey, p_name || lower(p_type) || ' ' || p_name AS t FROM part), distinct_texts AS (SELECT DISTINCT t FROM texts),
walk AS (SELECT t, 1 AS i, '' AS out, 0 AS hits FROM distinct_texts UNION ALL
SELECT t, i + CASE WHEN m IS NULL THEN 1 ELSE length(m.term) END, out || CASE WHEN m IS NULL THEN t[i:i] ELSE m.value END, hits + CASE WHEN m IS NULL THEN 0 ELSE 1 END
FROM (SELECT w.*, (SELECT max_by(struct_pack(term := d.term, value := d.value), length(d.term)) FROM dict d WHERE starts_with(w.t[w.i:], d.term)) AS m FROM walk w WHERE i <= length(t)))
SELECT p_partkey, out AS draft, hits AS n_segments FROM texts JOIN walk USING (t) WHERE i = length(t) + 1""")
def dictionary_drafts(spark, sf_dir):
    """Names and kinds of parts drafted by a dictionary of their words, and of the names that are many parts': the longest entry wins."""
    from scriptorium.operators.dictionary import drafted

    p = load(spark, sf_dir, "part")
    many = p.groupBy(F.col("p_name").alias("term")).agg(F.min_by("p_brand", "p_partkey").alias("value"), F.count(F.lit(1)).alias("n")).join(p.agg(F.count(F.lit(1)).alias("all"))).where(F.col("n") * 64 > F.col("all")).select("term", "value")
    words = p.select(F.explode(F.split("p_name", " ")).alias("term")).distinct().select("term", F.upper("term").alias("value"))
    texts = p.select("p_partkey", F.concat("p_name", F.lower("p_type"), F.lit(" "), "p_name").alias("text"))
    return drafted(texts, many.union(words)).select("p_partkey", "draft", F.size("segments").alias("n_segments"))


@query("""SELECT source, doc_id, row_number() OVER w AS at FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id) QUALIFY row_number() OVER w <= 30""")
def limited_items(spark, sf_dir):
    """The 30 longest items of each source."""
    d = load(spark, sf_dir, "documents")
    return catalog.first_rows(d, ["source"], [F.desc("n_chars"), "doc_id"], 30, ["source", "doc_id", "n_chars"]).select("source", "doc_id", "at")


def _repair_sql() -> str:
    out = "text"
    for pattern, to in library.REPAIRS:
        pattern = pattern.replace("(?iu)", "(?i)").replace(r"[\s\S]", r"(?:.|\n)").replace("'", "''")
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    out = f"trim({out})"
    for _ in range(3):
        out = rf"regexp_replace({out}, '{library.JOINED_LETTERS[0]}', '\1\2', 'g')"
    return f"SELECT doc_id, md5({out}) AS digest FROM documents"


@query(_repair_sql())
def repaired_texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(library.repair(F.col("text"))).alias("digest"))


@query("SELECT conv_id AS book, md5(string_agg(left(text, 40), chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS n FROM conversations GROUP BY 1")
def merged_notes(spark, sf_dir):
    """Notes of each turn, merged group by group until a session has one; this model cuts, and this merger keeps what it gets."""

    @F.pandas_udf("string")
    def model(s: pd.Series) -> pd.Series:
        return s.str.slice(0, 40)

    @F.pandas_udf("string")
    def merge(s: pd.Series) -> pd.Series:
        return s

    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("batch"), "text")
    merged = sess.map_reduce(c, model, merge, budget=200)
    n = c.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    return merged.join(n, "book").select("book", F.md5("text").alias("digest"), "n")


@query("SELECT doc_id, left(text, 7200) = text AS whole, md5(left(text, 7200)) AS digest FROM documents")
def asked_answers(spark, sf_dir):
    """A model that stops at its budget, asked again with 300, 2600 and 7200: the longest answer counts."""
    from scriptorium.sources.client import ask

    @F.pandas_udf("string")
    def answers(s: pd.Series) -> pd.Series:
        return s.map(lambda t: ask(lambda budget: (t[:budget], "length" if len(t) > budget else "stop"), budget=300), na_action="ignore")

    d = load(spark, sf_dir, "documents").select("doc_id", "text", answers("text").alias("a"))
    return d.select("doc_id", (F.col("a") == F.col("text")).alias("whole"), F.md5("a").alias("digest"))


# ---------------------------------------------------------------- streams over event time


@query("""WITH s AS (SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '6 hours' AS start FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT start, event_type, count(*) AS n FROM s GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    from scriptorium.streaming.news import sliding_counts

    return _streamed(spark, sliding_counts(_events(spark, sf_dir), "event_type", size="1 day", step="6 hours", horizon="400 days"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '3 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '3 hours' AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    from scriptorium.streaming.news import sessions

    rows = _streamed(spark, sessions(_events(spark, sf_dir), "user_id", gap="3 hours", horizon="400 days"), "complete")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""SELECT ts::DATE AS day, user_id, max_by(event_id, (length(props) * 10000000000 - event_id)) AS event_id FROM events GROUP BY ALL""")
def stream_upserts(spark, sf_dir):
    """Events merged into an archive by day, of each user and day the one with the longest properties, in two streams of which the second repeats the first."""
    from scriptorium.streaming.news import upsert_days

    at = new_path(spark, "merged-days")
    day = F.to_date("ts").alias("day")
    rows = _events(spark, sf_dir).select(day, F.concat_ws("|", F.to_date("ts").cast("string"), "user_id").alias("key"), "user_id", "event_id", "props", F.lit("s").alias("source"))
    for i in range(2):
        upsert_days(rows, f"{at}/days", "key", "props", "event_id", "source", f"{at}/at-{i}").start().awaitTermination()
    return spark.read.parquet(f"{at}/days").select("day", "user_id", "event_id")


@query("""WITH t AS (SELECT conv_id, turn, left(text, 120) AS thread, lower(left(text, 40)) AS head FROM conversations),
kept AS (SELECT * FROM t WHERE trim(thread) <> '' AND NOT EXISTS (SELECT 1 FROM t e WHERE e.conv_id = t.conv_id AND e.turn < t.turn AND contains(lower(e.thread), t.head)))
SELECT c.conv_id AS session_id, count(*)::INTEGER AS turns, (SELECT least(25, count(*)) FROM kept k WHERE k.conv_id = c.conv_id)::INTEGER AS n_threads FROM conversations c GROUP BY c.conv_id""")
def stream_threads(spark, sf_dir):
    """Conversations as a stream of turns that each open a thread, in state by session."""
    from scriptorium.streaming.news import session_stream

    schema = load(spark, sf_dir, "conversations").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/conversations.parquet*").select(F.col("conv_id").cast("string").alias("session_id"), "turn", F.to_json(F.struct(F.array("text").alias("manh_moi_moi"))).alias("state"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = _streamed(spark, session_stream(turns), "update")
    finally:
        spark.conf.set(provider, before)
    return rows.select(F.col("session_id").cast("long").alias("session_id"), "turns", "n_threads")


# ---------------------------------------------------------------- markup that regular expressions can follow (PRJ-01/04/05/06, SRC-03, SRT-06, PRJ-08)

UNESCAPE = "replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
GONE = r"(?is)<style.*?</style>|<script.*?</script>|<!--.*?-->|<!DOCTYPE[^>]*>"


@query(rf"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '{GONE}|<nav.*?</nav>|<footer.*?(</footer>|$)|<div class="ad">.*?</div>', '', 'g'), '<br>|</?p>|</h1>|</li>|</div>', chr(10), 'g') AS t FROM pages),
l AS (SELECT page_id, unnest(string_split({UNESCAPE.format("regexp_replace(t, '<[^>]*>', '', 'g')")}, chr(10))) AS line, generate_subscripts(string_split(regexp_replace(t, '<[^>]*>', '', 'g'), chr(10)), 1) AS i FROM bare),
k AS (SELECT page_id, i, trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g')) AS line FROM l)
SELECT page_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM k WHERE line <> '' GROUP BY page_id""")
def page_lines(spark, sf_dir):
    """The lines of every page's tree."""
    from scriptorium.functions.html import lines_udf

    rows = load(spark, sf_dir, "pages").select("page_id", lines_udf("html").alias("lines")).where("size(lines) > 0")
    return rows.select("page_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query(rf"""WITH p AS (SELECT page_id, regexp_extract_all(replace(replace(regexp_replace(html, '{GONE}', '', 'g'), '<p>', '</p><p>'), '</article>', '</p></article>'), '(?s)<(?:p|li)>(.*?)(?:</p>|</li>)', 1) AS ps FROM pages),
l AS (SELECT page_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM p),
k AS (SELECT page_id, i, trim(regexp_replace({UNESCAPE.format("regexp_replace(x, '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) AS x FROM l),
m AS (SELECT *, lag(x) OVER (PARTITION BY page_id ORDER BY i) AS before FROM k WHERE length(x) >= 25)
SELECT page_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY i)) AS digest FROM m WHERE before IS NULL OR before <> x GROUP BY page_id""")
def page_paragraphs(spark, sf_dir):
    from scriptorium.functions.html import paragraphs_udf

    rows = load(spark, sf_dir, "pages").select("page_id", paragraphs_udf("html").alias("ps")).where("size(ps) > 0")
    return rows.select("page_id", F.size("ps").cast("long").alias("n"), F.md5(F.array_join("ps", "\n")).alias("digest"))


def _score_sql(breaks: int, depth: int, least: int) -> str:
    return rf"""WITH a AS (SELECT page_id, regexp_extract(regexp_replace(html, '{GONE}', '', 'g'), '(?s)<article>(.*?)(</article>|<footer|$)', 1) AS x FROM pages),
s AS (SELECT page_id, x, list_filter(list_transform(regexp_split_to_array(x, '<[^>]*>'), lambda t: trim({UNESCAPE.format("t")}, ' ' || chr(9) || chr(10) || chr(13))), lambda t: t <> '') AS ts FROM a),
n AS (SELECT page_id, length(array_to_string(ts, ' ')) AS chars, len(regexp_extract_all(x, '<p>|<br>')) AS breaks FROM s)
SELECT page_id, chars + {breaks} * breaks + {depth} AS score FROM n WHERE chars >= {least}"""


@query(_score_sql(14, 0, 250))
def news_scores(spark, sf_dir):
    """The score of every page's main block, which in these pages is the article."""
    from scriptorium.functions.html import main_content

    return main_content(load(spark, sf_dir, "pages"), "news").select("page_id", "score")


@query(_score_sql(12, 3 * 5, 300))
def book_scores(spark, sf_dir):
    from scriptorium.functions.html import main_content

    return main_content(load(spark, sf_dir, "pages"), "book").select("page_id", "score")


@query(rf"""WITH t AS (SELECT page_id, trim({UNESCAPE.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM pages)
SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(t, '^\s*\[[^\]]{{1,20}}\]\s*', ''), '\s*[-|–]\s*[^-|–]{{0,40}}$', ''), ' ' || chr(9) || chr(10) || chr(13)), ''), 'Truyen') AS title FROM t""")
def work_titles(spark, sf_dir):
    from scriptorium.functions.html import book_meta_udf

    return load(spark, sf_dir, "pages").select("page_id", book_meta_udf("html", "url").getField("title").alias("title"))


@query(rf"""WITH t AS (SELECT page_id, trim(regexp_replace({UNESCAPE.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CASE WHEN length(t) > 400 THEN regexp_replace(left(t, 400), ' [^ ]*$', '') || '…' ELSE t END AS summary FROM t""")
def cleaned_summaries(spark, sf_dir):
    from scriptorium.functions.html import summary_udf

    return load(spark, sf_dir, "pages").select("page_id", summary_udf("html").alias("summary"))


@query(rf"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) AS site, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages), l AS (SELECT page_id, site, {UNESCAPE.format("href")} AS href FROM a)
SELECT page_id, count(*) AS n, md5(string_agg(DISTINCT CASE WHEN contains(href, ']') THEN 'a[href=' || href || ']' ELSE 'a[href="' || replace(trim(href), '"', '\"') || '"]' END, ' ' ORDER BY CASE WHEN contains(href, ']') THEN 'a[href=' || href || ']' ELSE 'a[href="' || replace(trim(href), '"', '\"') || '"]' END)) AS selectors,
min(site || href) AS first FROM l GROUP BY page_id""")
def selector_repairs(spark, sf_dir):
    """Selectors with bare values for every link of the pages, quoted; and the links against their pages."""
    from scriptorium.sources.client import absolute_links, quoted_selectors

    href = F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))
    decoded = F.col("href")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(sign))
    rows = load(spark, sf_dir, "pages").select("page_id", "url", F.explode(href).alias("href")).withColumn("href", decoded)
    rows = rows.select("page_id", quoted_selectors(F.concat(F.lit("a[href="), "href", F.lit("]"))).alias("selector"), absolute_links("href", "url").alias("link"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.sort_array(F.collect_set("selector")), " ")).alias("selectors"), F.min("link").alias("first"))
