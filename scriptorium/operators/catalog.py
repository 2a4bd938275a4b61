"""Registries and stored tables: overlays, routing, upserts, seen sets, drift, and bounded link traversal."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import READABLE, KNOWN_UNREADABLE, is_link, like_document, resolve, same_name, url_ext, url_host
from scriptorium.session import durable


# Fixed value: what a link to a page of a list looks like.
PAGE_LINK = r"(?i)(trang[-=/](\d+)|[?&]page=(\d+)|/page/(\d+))"


def overlay(base: DataFrame, added: DataFrame, overrides: DataFrame, key: str = "id") -> DataFrame:
    """Built-in and added rows with the non-null fields of their overrides, and flags for both (JN-01)."""
    rows = base.withColumn("is_added", F.lit(False)).unionByName(added.withColumn("is_added", F.lit(True)))
    o = overrides.alias("o")
    fields = [c for c in base.columns if c != key and c in overrides.columns]
    joined = rows.alias("r").join(o, F.col(f"r.{key}") == F.col(f"o.{key}"), "left")
    cols = [F.coalesce(F.col(f"o.{c}"), F.col(f"r.{c}")).alias(c) if c in fields else F.col(f"r.{c}") for c in base.columns]
    return joined.select(*cols, "r.is_added", F.col(f"o.{key}").isNotNull().alias("is_changed"))


def route(urls: DataFrame, sources: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, source): the first source by priority whose domain is the host or a suffix of it, else the first without domains (SRC-02, JN-12).

    sources are (source, domain, priority), a null domain taking any host. A host is taken apart into its
    suffixes, so this is an equi join and not a comparison of every URL with every domain.
    """
    host = F.regexp_replace(F.lower(url_host(F.col(url_col))), r"^www\.|:\d+$", "")
    hosts = urls.select(url_col).distinct().withColumn("host", host)
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain")
    named = hosts.select(url_col, suffix).join(sources.where("domain IS NOT NULL"), "domain").select(url_col, F.struct("priority", "source").alias("s"))
    generic = sources.where("domain IS NULL").agg(F.min(F.struct("priority", "source")).alias("g"))
    found = named.groupBy(url_col).agg(F.min("s").alias("s"))
    return hosts.select(url_col).join(found, url_col, "left").crossJoin(F.broadcast(generic)).select(url_col, F.coalesce("s.source", "g.source").alias("source"))


def carry(fresh: DataFrame, stored: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Fields of stored rows onto the fresh rows of the same key (JN-02)."""
    kept = stored.select(key, *[F.col(c).alias(f"old_{c}") for c in cols])
    joined = fresh.join(kept, key, "left")
    return joined.select(*[F.coalesce(f"old_{c}", c).alias(c) if c in cols else F.col(c) for c in fresh.columns], *[F.col(f"old_{c}").alias(c) for c in cols if c not in fresh.columns])


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows, and the stored ones without a fresh one (SNK-05)."""
    return fresh.unionByName(stored.join(fresh.select(key).distinct(), key, "left_anti"))


def write_back(stored: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Stored rows with the non-null fields of the values of their key (JN-07); values without a stored row are left out, the last of a key by its fields' order counts."""
    fields = [c for c in values.columns if c != key and c in stored.columns]
    last = values.groupBy(key).agg(F.max(F.struct(*fields)).alias("new_"))
    joined = stored.join(last, key, "left")
    return joined.select(*(F.coalesce(F.col(f"new_.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns))


#: Levels of a walk that are read as one table after that.
LEVELS_A_TABLE = 12


def walk_pages(edges: DataFrame, starts: DataFrame, limit: int = 300) -> DataFrame:
    """(work, url): the pages of a list that are reached from a work's first page by links to pages, `limit` for each work (OPS-02).

    edges are (from_url, href), starts (work, url). One round a level, with an anti join to what was seen; where a
    round would exceed a work's limit, the first by address stay.
    """
    links = durable(edges.where(F.col("href").rlike(PAGE_LINK)).select("from_url", F.substring_index("href", "#", 1).alias("to")).distinct(), "page-links")
    levels = [durable(starts.select("work", F.substring_index("url", "#", 1).alias("url")).distinct(), "pages")]
    while not levels[-1].isEmpty():
        # Each level is written once; what was seen is their union.
        seen = functools.reduce(DataFrame.union, levels)
        found = levels[-1].join(links, F.col("url") == F.col("from_url")).select("work", F.col("to").alias("url")).distinct().join(seen, ["work", "url"], "left_anti")
        held = seen.groupBy("work").agg(F.count(F.lit(1)).alias("held_"))
        place = F.row_number().over(Window.partitionBy("work").orderBy("url"))
        levels.append(durable(found.withColumn("place_", place).join(held, "work").where(F.col("place_") + F.col("held_") <= limit).select("work", "url"), "next-pages"))
        if len(levels) % LEVELS_A_TABLE == 0:  # neither a plan of hundreds of tables nor a table written again each level
            levels = [durable(functools.reduce(DataFrame.union, levels[:-1]), "pages"), levels[-1]]
    return functools.reduce(DataFrame.union, levels)


def unique_slugs(rows: DataFrame, slug: str, order: str, out: str = "slug") -> DataFrame:
    """rows with a slug that no other row has: the first row of each slug keeps it, the others get -2, -3, ... without those that are slugs of their own (SCL-07).

    A made-up slug can't meet one made from another: theirs would have one more number at the end, which is what is looked for.
    """
    bare = rows.withColumn("base_", F.col(slug))
    numbered = F.regexp_extract("base_", "^(.*)-([1-9][0-9]{0,8})$", 2).try_cast("int")
    taken = bare.select("base_").distinct().select(F.regexp_extract("base_", "^(.*)-([1-9][0-9]{0,8})$", 1).alias("t_"), numbered.alias("n_")).where("n_ >= 2").groupBy("t_").agg(F.sort_array(F.collect_set("n_")).alias("taken_"))
    placed = bare.withColumn("place_", F.row_number().over(Window.partitionBy("base_").orderBy(order))).join(taken, F.col("base_") == F.col("t_"), "left").drop("t_")
    number = F.aggregate(F.coalesce("taken_", F.array().cast("array<int>")), F.col("place_"), lambda at, n: at + (n <= at).cast("int"))
    unique = F.when(F.col("place_") == 1, F.col("base_")).otherwise(F.concat("base_", F.lit("-"), number.cast("string")))
    return placed.withColumn(out, unique).drop("base_", "place_", "taken_")


def first_rows(rows: DataFrame, by: list[str], order: list, limit: int, columns: list[str] | None = None) -> DataFrame:
    """The first rows of each group in an order (SRT-05): 30 items of a feed, 60 pages, 300 files or titles, 50 failures.

    Spark drops what is beyond the limit in each task before rows are shuffled, so a group's size doesn't matter. `at` has their place.
    """
    kept = rows.select(*columns) if columns else rows
    return kept.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("at") <= limit)


def memory_lookup(rows: DataFrame, memory: DataFrame, key: str = "key") -> DataFrame:
    """Rows with the remembered value, null for what still has to be translated (JN-06)."""
    return rows.join(memory.select(key, "value"), key, "left")


#: Pieces that a host's URLs are dealt out in: few hosts have most of them.
HOST_PIECES = 32


def belongs(urls: DataFrame, watches: DataFrame) -> DataFrame:
    """Distinct (watch_id, url): the host is one of the watch's, or the URL was harvested or seen before (JN-05).

    A URL has one host, so pairs by host are distinct as they are made, and known ones are those of other hosts: pairs, which may be
    many more than URLs and watches, aren't shuffled. Tasks are as many as the session says, since what they make tells nothing of what they read.
    """
    dealt = lambda rows: rows.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "host", "piece")
    hosts = watches.select("watch_id", F.explode("addresses").alias("a")).select("watch_id", url_host(F.col("a")).alias("host")).distinct()
    once = urls.select("url").distinct().withColumn("host", url_host(F.col("url")))
    piece = once.withColumn("piece", F.pmod(F.xxhash64("url"), F.lit(HOST_PIECES)))
    every = hosts.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOST_PIECES - 1).cast("long"))))
    by_host = dealt(piece).join(dealt(every).hint("merge"), ["host", "piece"]).select("watch_id", "url")
    both = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("harvested", "seen")))
    known = watches.select("watch_id", F.explode(both).alias("url")).distinct().join(once, "url")
    other = hosts.select(F.col("watch_id").alias("w"), F.col("host").alias("h"))
    return by_host.union(known.join(other, F.col("watch_id").eqNullSafe(F.col("w")) & (F.col("host") == F.col("h")), "left_anti").select("watch_id", "url"))


def new_files(found: DataFrame, harvested: DataFrame) -> DataFrame:
    """JN-04."""
    return found.join(harvested.select("watch_id", "url"), ["watch_id", "url"], "left_anti")


def missing(chapters: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """JN-16."""
    return chapters.join(stored.select(*by), by, "left_anti")


def drift(stored: DataFrame, listed: DataFrame, book: str, idx: str = "idx", title: str = "title") -> DataFrame:
    """(book, last_idx, drifted): whether the last stored chapter has another title in the source's list (JN-11, AGG-10)."""
    last = stored.groupBy(book).agg(F.max(F.struct(idx, title)).alias("last"))
    there = listed.select(book, F.col(idx).alias("last_idx"), F.col(title).alias("now_title"))
    joined = last.select(book, F.col(f"last.{idx}").alias("last_idx"), F.col(f"last.{title}").alias("last_title")).join(there, [book, "last_idx"], "left")
    return joined.select(book, "last_idx", F.coalesce(~same_name(F.col("last_title"), F.col("now_title")), F.lit(True)).alias("drifted"))


def watch_id(addresses: Column) -> Column:
    """A stable identifier of a list of addresses (OPS-07)."""
    return F.lower(F.hex(F.xxhash64(F.array_join(addresses, "\n"))))


def upsert_watches(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Watches by their address lists; what was seen is united and sorted (OPS-07, SET-02)."""
    rows = stored.unionByName(fresh).withColumn("watch_id", watch_id(F.col("addresses")))
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen"))))
    return rows.groupBy("watch_id").agg(F.first("addresses").alias("addresses"), seen.alias("seen"))


def crawl(edges: DataFrame, starts: DataFrame, depth: int = 1, max_pages: int | None = 60, max_files: int = 300, blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, files) of a breadth-first traversal (OPS-01).

    edges are (from_url, href, anchor, pos) of fetched pages, starts (url, ord). Pages are visited by depth,
    parent's order and place, each once, max_pages at most; blocked pages count but have no links. Links to
    documents are collected from any host, max_files at most, and never followed; others are followed on
    the same host. One round a level: a join with the frontier and an anti join with what was seen. With
    max_pages None all are visited, and their order within a level, which only the cap needs, is left open.
    """
    spark = edges.sparkSession
    links = edges.where(is_link(F.trim("href"))).withColumn("to", F.substring_index(resolve(F.col("from_url"), F.trim("href")), "#", 1))
    ext = url_ext(F.col("to"))
    links = links.withColumn("ext", ext).withColumn("is_file", ext.isin(READABLE + KNOWN_UNREADABLE))
    links = durable(links.withColumn("probe", ~F.col("is_file") & (F.col("ext") == "") & like_document(F.col("anchor"), F.col("to"))), "links")
    frontier = starts.select(F.substring_index(F.trim("url"), "#", 1).alias("url"), "ord").where("url LIKE 'http%'")
    frontier = frontier.groupBy("url").agg(F.min("ord").alias("ord"))
    if max_pages is not None:
        frontier = frontier.orderBy("ord", "url").limit(max_pages).withColumn("ord", F.row_number().over(Window.orderBy("ord", "url")))
    frontier = frontier.select("url", F.col("ord").cast("long").alias("ord"), F.lit(0).alias("depth"))
    seen = spark.createDataFrame([], frontier.schema)
    for level in range(depth + 1):
        # A level is at most what is left of the pages' cap, so its order fits one task.
        left = None if max_pages is None else max_pages - seen.count()
        if left is not None and left <= 0:
            break
        frontier = durable(frontier if left is None else frontier.orderBy("ord").limit(left), "frontier")
        seen = durable(seen.union(frontier), "seen")
        if level == depth or frontier.isEmpty():
            break
        open_pages = frontier if blocked is None else frontier.join(blocked.select("url"), "url", "left_anti")
        base = seen.agg(F.max("ord")).first()[0]
        nxt = open_pages.join(links.where("NOT is_file AND NOT probe"), F.col("url") == F.col("from_url")).where(url_host(F.col("to")) == url_host(F.col("url")))
        nxt = nxt.groupBy("to").agg(F.min(F.struct("ord", "pos")).alias("at")).join(seen.select(F.col("url").alias("to")), "to", "left_anti")
        place = F.lit(level + 1)
        if max_pages is not None:
            nxt, place = nxt.orderBy("at").limit(max_pages), F.lit(base) + F.row_number().over(Window.orderBy("at"))
        frontier = nxt.select(F.col("to").alias("url"), place.cast("long").alias("ord"), F.lit(level + 1).alias("depth"))
    readers = seen if blocked is None else seen.join(blocked.select("url"), "url", "left_anti")
    files = readers.join(links.where("is_file"), F.col("url") == F.col("from_url")).groupBy("to").agg(F.min(F.struct("ord", "pos", "from_url", "anchor", "ext")).alias("at"))
    files = files.orderBy("at.ord", "at.pos").limit(max_files)
    files = files.select(F.col("to").alias("url"), F.col("at.ext").alias("ext"), F.left("at.anchor", F.lit(120)).alias("label"), F.col("at.from_url").alias("from_url"), F.col("at.ext").isin(READABLE).alias("readable"))
    return seen, files


def robots_allow(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs that no rule of their origin forbids: the longest matching prefix decides, allow on ties; no rules, no limits (FLT-09).

    rules are (origin, prefix, allow).
    """
    origin = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/?#]+", ""), "^$", "/")
    rows = urls.withColumn("origin", origin).withColumn("path", path)
    hits = rows.join(rules, "origin").where(F.startswith("path", F.col("prefix"))).groupBy("url").agg(F.max(F.struct(F.length("prefix"), "allow")).alias("best"))
    return rows.join(hits, "url", "left").where(F.coalesce("best.allow", F.lit(True))).select(*urls.columns)
