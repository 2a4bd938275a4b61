"""Libraries of works and lists of feeds: listings, ranges, retries, refreshes, imports and smaller rules."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import catalog, cleaning
from scriptorium.session import durable

# ---------------------------------------------------------------- listings


def by_last_read(books: DataFrame, read: str = "read_at", added: str = "added") -> DataFrame:
    """Last read first; what was never read counts from when it was added (SRT-03)."""
    return books.orderBy(F.desc(F.coalesce(F.nullif(read, F.lit(0)), added)))


def readable_first(files: DataFrame) -> DataFrame:
    """SRT-02."""
    return files.orderBy(~F.col("readable"), F.lower("name"))


def sessions(turns: DataFrame, by: str = "session_id", at: str = "at") -> DataFrame:
    """(session, chapters, last), the latest first (AGG-14)."""
    return turns.groupBy(by).agg(F.count(F.lit(1)).alias("chapters"), F.max(at).alias("last")).orderBy(F.desc("last"))


def chapters_like(chapters: DataFrame, q: str, idx: str = "idx", title: str = "title") -> DataFrame:
    """Titles that hold q in any case, or the chapter of that number (FLT-10)."""
    return chapters.where(F.contains(F.lower(title), F.lit(q.lower())) | (F.col(idx) == F.lit(q).try_cast("int")))


def feeds_like(feeds: DataFrame, country: str = "", q: str = "") -> tuple[DataFrame, DataFrame]:
    """(feeds of a country with q in the name, counts of enabled and all) (FLT-11)."""
    found = feeds.where((F.lit(country) == "") | (F.col("country") == country)).where(F.contains(F.lower("name"), F.lit(q.lower())))
    return found, found.agg(F.count_if(~F.col("disabled")).alias("enabled"), F.count(F.lit(1)).alias("total"))


def usable_feeds(feeds: DataFrame) -> DataFrame:
    """FLT-06."""
    return feeds.where(~F.col("disabled") & (F.coalesce("url", F.lit("")) != ""))


def next_page(shown: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """What a further page adds; nothing means the end (SRT-07)."""
    return fetched.join(shown.select(key), key, "left_anti")


def merge_slugs(anchors: DataFrame, slug: str = "slug", pos: str = "pos") -> DataFrame:
    """One row a slug in the order of first sight, with its first name and first cover that aren't empty; without a name it is left out (PRJ-23)."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col(pos)))
    return anchors.groupBy(slug).agg(F.min(pos).alias(pos), F.coalesce(first("name"), F.lit("")).alias("name"), F.coalesce(first("cover"), F.lit("")).alias("cover")).where("name <> ''").orderBy(pos)


def days(articles: DataFrame, day: str = "day") -> DataFrame:
    """Stored days, the newest first, with their numbers of articles and of each category (SRC-14, AGG-02)."""
    counts = articles.groupBy(day, "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(day).agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("by_category")).orderBy(F.desc(day))


def progress(rows: DataFrame, by: str, done: Column, cached: Column, failed: Column) -> DataFrame:
    """(by, total, done, cached, failed, percent to one decimal, 0 of nothing) of a job's chapters (AGG-09)."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"), F.count_if(cached).alias("cached"), F.count_if(failed).alias("failed"))
    return counts.withColumn("percent", F.when(F.col("total") > 0, F.round(100 * F.col("done") / F.col("total"), 1)).otherwise(0.0))


def selection_counts(files: DataFrame) -> DataFrame:
    """AGG-13."""
    return files.agg(F.count_if("selected").alias("selected"), F.count_if(F.col("selected") & ~F.col("readable")).alias("unreadable"))


# ---------------------------------------------------------------- chapters


def in_range(chapters: DataFrame, first: int | None, last: int | None, book: str = "book_id", idx: str = "idx") -> DataFrame:
    """Chapters first to last, clamped to what a book has (FLT-12)."""
    n = F.max(idx).over(Window.partitionBy(book))
    low, high = F.greatest(F.lit(1), F.lit(first or 1)), F.least(n, F.lit(last)) if last else n
    return chapters.withColumn("low_", low).withColumn("high_", high).where(F.col(idx).between(F.col("low_"), F.col("high_"))).drop("low_", "high_")


def title_without_book(title: Column, book: Column) -> Column:
    """A chapter's title without its book's title and a dash or colon before it, in any case (PRJ-13)."""
    rest = F.substring(title, F.length(book) + 1, F.length(title))
    prefixed = (book != "") & (F.lower(F.left(title, F.length(book))) == F.lower(book)) & rest.rlike(r"(?U)^\s*[-–—:]")
    return F.when(prefixed, F.regexp_replace(rest, r"(?U)^\s*[-–—:]\s*", "")).otherwise(title)


def locked(body: Column, least: int = 200) -> Column:
    """Bodies too short to be a chapter (FLT-15)."""
    return F.coalesce(F.length(body), F.lit(0)) < least


def stored_counts(chapters: DataFrame, book: str = "book_id", idx: str = "idx") -> DataFrame:
    """AGG-11."""
    return chapters.groupBy(book).agg(F.countDistinct(idx).alias("stored"), F.max(idx).alias("last"))


def failed_again(chapters: DataFrame, failures: DataFrame, by: tuple[str, ...] = ("book_id", "idx")) -> DataFrame:
    """The chapters of a second pass (JN-15, OPS-12)."""
    return chapters.join(failures.select(*by), list(by), "left_semi")


def refresh(stored: DataFrame, listed: DataFrame, book: str = "book_id") -> tuple[DataFrame, DataFrame]:
    """(chapters to fetch, books whose last stored chapter has another title now) (OPS-06)."""
    return catalog.missing(listed, stored, [book, "idx"]), catalog.drift(stored, listed, book).where("drifted")


def first_match(links: DataFrame, patterns: DataFrame) -> DataFrame:
    """(link, source) of the first enabled source whose pattern a link fits (JN-13). patterns (source, pattern, ord, disabled) is a short list."""
    hits = links.select("link").distinct().join(F.broadcast(patterns.where("NOT disabled")), F.expr("link rlike pattern"))
    return hits.groupBy("link").agg(F.min(F.struct("ord", "source")).alias("s")).select("link", F.col("s.source").alias("source"))


def owned(links: DataFrame, books: DataFrame) -> DataFrame:
    """Links of books that are there already: by URL, or by a slug that is one of the link's path parts (JN-14); two equi joins."""
    by_url = links.join(books.select(F.col("url").alias("link")), "link", "left_semi")
    parts = links.select("link", F.explode(F.array_distinct(F.split(F.regexp_replace("link", "^[a-z]+://|[?#].*$", ""), "[/._]"))).alias("slug")).where("slug <> ''")
    return by_url.select("link").union(parts.join(books.select("slug"), "slug", "left_semi").select("link")).distinct()


# ---------------------------------------------------------------- translations


def needs_translation(lang: Column, target: str) -> Column:
    """None yet, or in another language (FLT-17)."""
    return lang.isNull() | (lang != target)


def same_language(source: Column, target: str) -> Column:
    """SCL-19."""
    return F.left(F.lower(F.coalesce(source, F.lit(""))), F.lit(2)) == target


def displayed(original: Column, translated: Column, lang: Column, target: str) -> Column:
    """PRJ-15."""
    return F.coalesce(F.when(lang == target, F.nullif(translated, F.lit(""))), original)


def segment_translate(texts: DataFrame, dictionary: DataFrame, longest: int = 8, text: str = "text") -> DataFrame:
    """texts with `draft`: the longest entries of a dictionary (term, value) from left to right; what has none stays (SCL-18).

    Only the interface and the longest-match rule; dictionaries come from elsewhere. Candidates meet by an
    equi join on substrings, and each text's own matches are folded in order.
    """
    rows = texts.withColumn("id_", F.xxhash64(text))
    n = F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n_")
    cuts = rows.select("id_", text, F.posexplode(F.split(text, "")).alias("i_", "c_")).select("id_", text, "i_", n).select("id_", "i_", F.substring(F.col(text), F.col("i_") + 1, F.col("n_")).alias("term")).where("term <> ''").distinct()
    hits = cuts.join(dictionary.select("term", "value"), "term").groupBy("id_", "i_").agg(F.max(F.struct(F.length("term").alias("n"), "value")).alias("m"))
    folded = hits.groupBy("id_").agg(F.map_from_entries(F.collect_list(F.struct("i_", "m"))).alias("at_"))
    state = F.struct(F.lit(0).alias("skip"), F.lit("").alias("out"))
    draft = F.aggregate(
        F.sequence(F.lit(0), F.length(text) - 1),
        state,
        lambda s, i: F.when(s["skip"] > 0, F.struct((s["skip"] - 1).alias("skip"), s["out"].alias("out")))
        .when(F.element_at("at_", i).isNotNull(), F.struct((F.element_at("at_", i)["n"] - 1).alias("skip"), F.concat(s["out"], F.element_at("at_", i)["value"]).alias("out")))
        .otherwise(F.struct(F.lit(0).alias("skip"), F.concat(s["out"], F.substring(F.col(text), i + 1, F.lit(1))).alias("out"))),
        lambda s: s["out"],
    )
    joined = rows.join(folded, "id_", "left")
    return joined.withColumn("draft", F.when(F.col("at_").isNull() | (F.length(text) == 0), F.col(text)).otherwise(draft)).drop("id_", "at_")


# ---------------------------------------------------------------- pages and text


def may_embed(frame_options: Column, security_policy: Column) -> Column:
    """Whether headers let a page stand in a frame (PRJ-20)."""
    refused = F.lower(F.coalesce(frame_options, F.lit(""))).rlike("deny|sameorigin")
    ancestors = F.regexp_extract(F.lower(F.coalesce(security_policy, F.lit(""))), "(frame-ancestors[^;]*)", 1)
    return ~refused & ((ancestors == "") | F.contains(ancestors, F.lit("*")))


# Repairs of scraped chapters, in this order; (pattern, replacement).
REPAIRS = [
    (r"(?i)<style[^>]*>[\s\S]*?</style>", ""), (r"(?i)<a[^>]*>.*?</a>", ""), (r"(?i)</?(?:div|span)[^>]*>", ""), (r"&(?:nbsp|amp|quot|lt|gt);", ""), (r"(<br>\s*){2,}", "<br>"),
    (r"^(?:<br>\s*)+|(?:<br>\s*)+$", ""), (r"[\\]", ""), ("[“”\"]", '"'), (r">\s+<", "><"), (r"\s+", " "), (r"(?i)ch\*t", "chết"), (r"(?i)gi\*t", "giết"), (r"(?i)s\*t", "sát"),
    (r"(?i)v\*n", "vẫn"), (r"(?i)th\*", "thi"), (r"(?i)t\s*\*\s*nh\s*d\s*\*\s*c", "tình dục"), (r"(?iu)\*m\s*đ\**", "âm đạo"), ("/", ""), ("ƣ", "ư"),
]
JOINED_LETTERS = (r"([a-zà-ỹ])\s*\.\s*([a-zà-ỹ])", "$1$2")


def repair(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """An ordered chain of replacements, then letters parted by points joined three times (SCL-24)."""
    for pattern, text in REPAIRS if rules is None else rules:
        c = F.regexp_replace(c, pattern, text)
    c = F.trim(c)
    for _ in range(3):
        c = F.regexp_replace(c, *JOINED_LETTERS)
    return c


# ---------------------------------------------------------------- imports


def import_works(works: DataFrame, rules: cleaning.Rules | None = None, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(books, chapters) of parsed works: repeated lines found on the raw text, lines cleaned, empty chapters dropped and the rest renumbered (SNK-08).

    No file is written: the plan alone is a dry run; sinks.writers makes files of both. Repeated lines, and the books of four
    or more chapters that alone can have any, are intermediate tables, so that Spark knows how few they are.
    """
    from scriptorium.sources.readers import chapters_of

    lines = chapters_of(works).select("name", "idx", "title", F.posexplode("lines").alias("pos", "line"))
    many = durable(works.where(F.size("chapters") >= 4).select("name").distinct(), "long-books")
    junk = durable(cleaning.detect_boilerplate(lines.join(many, "name", "left_semi"), "name", "idx", threshold), "boilerplate")
    kept = cleaning.clean(lines, ["name", "idx"], rules, junk, book="name")
    chapters = kept.groupBy("name", "idx", "title").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]).alias("lines"))
    chapters = chapters.withColumn("idx", F.row_number().over(Window.partitionBy("name").orderBy("idx"))).withColumnRenamed("name", "book_id")
    ids = F.concat(F.lit("local:"), F.left(F.sha2(F.concat_ws("\n", "name", "title"), 256), F.lit(12)))
    return works.select(F.col("name").alias("book_id"), "title", "author", ids.alias("url")), chapters


def write_cache(chapters: DataFrame, path: str) -> None:
    """Chapters as a table partitioned by book (SNK-03)."""
    chapters.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


# A reader's settings where nothing else is set.
DEFAULTS: dict = {"threads": 6, "delay": 0.3, "split_every": 0, "formats": ["epub", "txt"], "ai": {"max_tokens": 3000}}


def settings(stored: dict | None, defaults: dict | None = None) -> dict:
    """Stored values over the defaults, `ai` merged one level deeper, threads from 1 to 32, no negative delay (SRC-15)."""
    base = DEFAULTS if defaults is None else defaults
    out = base | (stored or {})
    out["ai"] = base.get("ai", {}) | ((stored or {}).get("ai") or {})
    out["threads"], out["delay"] = min(32, max(1, int(out.get("threads", 1)))), max(0, out.get("delay", 0))
    return out


def merged_settings(stored: Column) -> Column:
    """The same over a column of stored settings as JSON; what is no JSON, and null, counts as nothing stored."""

    @F.pandas_udf("string")
    def merge(s: pd.Series) -> pd.Series:
        return s.map(_merged)

    return merge(F.coalesce(stored, F.lit("{}")))


def _merged(raw: str) -> str:
    try:
        found = json.loads(raw)
        out = settings(found if isinstance(found, dict) else {})
    except (TypeError, ValueError):  # no JSON, or values that are no numbers where some must be
        out = settings({})
    return json.dumps(out, ensure_ascii=False)
