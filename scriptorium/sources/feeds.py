"""Feeds of news: RSS 2.0, Atom and RDF as XML text, to articles.

A feed is one small document, so one Arrow pass takes each apart; cleaning of its fields is left to
expressions. The first 30 items of a feed count.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.html import clean_text_udf, sanitise_udf, summary_udf
from scriptorium.functions.text import parse_date
from scriptorium.functions.udf import vectorised
from scriptorium.operators.news import category, summary

ITEM = "array<struct<place:int,title:string,link:string,description:string,encoded:string,date:string,image:string,tags:array<string>>>"
ITEMS = 30


def _name(e) -> str:
    """Tag with the usual prefix of its namespace."""
    space, _, tag = e.tag.rpartition("}")
    prefix = "media" if "search.yahoo.com/mrss" in space else "content" if "purl.org/rss/1.0/modules/content" in space else "dc" if "purl.org/dc" in space else ""
    return f"{prefix}:{tag}" if prefix else tag


def _text(e) -> str:
    return "".join(e.itertext())


def parse_feed(xml: str | None, items: int = ITEMS) -> list[dict]:
    """Items with the first non-empty of each field's tags (SRC-05, PRJ-10); an unreadable feed has none."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return []
    found = []
    for place, item in enumerate([e for e in root.iter() if _name(e) in ("item", "entry")][:items]):
        below = [(_name(e), e) for e in item.iter() if e is not item]
        first = lambda *names: next(((n, e) for name in names for n, e in below if n == name and _text(e).strip()), (None, None))[1]
        link = next(((e.get("href") or _text(e)).strip() for n, e in below if n == "link"), "")
        guid = first("guid")
        if not link and guid is not None and _text(guid).strip().startswith("http"):
            link = _text(guid).strip()
        described, title = first("description", "summary", "content", "content:encoded"), first("title")
        bare = lambda s: len(re.sub(r"<[^>]+>", "", s))
        text = _text(described) if described is not None else ""
        whole = next((t for name in ("content:encoded", "content") for n, e in below if n == name and bare(t := _text(e)) > max(400, bare(text) + 200)), "")
        image = next((e.get("url", "") for n, e in below if n in ("enclosure", "media:content", "media:thumbnail") and (re.search(r"(?i)\.(jpe?g|png|webp)", e.get("url", "")) or "image" in e.get("type", ""))), "")
        date = first("pubDate", "published", "updated", "dc:date", "date")
        found.append({
            "place": place, "title": _text(title) if title is not None else "", "link": link, "description": text, "encoded": whole,
            "date": _text(date).strip() if date is not None else "", "image": image, "tags": [_text(e).strip() for n, e in below if n == "category"][:6],
        })
    return found


@vectorised(ITEM)
def items_udf(s: pd.Series) -> pd.Series:
    return s.map(parse_feed)


def articles(feeds: DataFrame, phrases=None) -> DataFrame:
    """Articles of feeds (id, name, country, lang, category, xml), in the feeds' order; items without a title are left out."""
    rows = feeds.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "country", "lang", F.col("category").alias("hint"), F.explode(items_udf("xml")).alias("i"))
    rows = rows.select("source_id", "source", "country", "lang", "hint", "i.*").withColumn("title", clean_text_udf("title")).where("title <> ''")
    rows = rows.withColumn("cleaned", summary_udf("description")).withColumn("body", F.when(F.col("encoded") != "", sanitise_udf("encoded", "link")).otherwise(""))
    return rows.select(
        "source_id", "source", "country", "lang", "place", "title", summary(F.col("cleaned"), F.col("title")).alias("summary"), "body", "link", "image",
        parse_date(F.col("date")).alias("published_at"), F.col("date").alias("published_raw"), "tags",
        category(F.col("title"), F.col("description"), F.col("link"), F.col("tags"), F.col("hint"), phrases).alias("category"),
    )


def probe(feeds: DataFrame, now: Column) -> DataFrame:
    """(id, country, items, age_hours, alive): three items or more make a feed alive; its age is that of the first date in it (SRC-19)."""
    is_feed = F.left("xml", F.lit(2000)).rlike(r"(?i)<(rss|feed|rdf)")
    date = F.regexp_extract("xml", r"(?is)<(?:pubDate|published|updated|dc:date)[^>]*>(.*?)</", 1)
    n = F.when(is_feed, F.regexp_count("xml", F.lit(r"(?i)<(?:item|entry)[\s>]"))).otherwise(0)
    age = F.round((now.cast("double") - parse_date(date).cast("double")) / 3600, 1)
    return feeds.select("id", "country", n.alias("items"), age.alias("age_hours"), (n >= 3).alias("alive"))


def health(probes: DataFrame) -> DataFrame:
    """AGG-15."""
    return probes.groupBy("country").agg(F.count_if("alive").alias("alive"), F.count_if(~F.col("alive")).alias("dead"))
