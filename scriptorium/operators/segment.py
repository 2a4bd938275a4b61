"""Lines to chapters: headings in plain text, levels of headings, fences, bookmarks and merged files.

All of it is running sums and neighbours over windows by document and position. A long document can be in pieces, named by a column
that never falls with the position: a window is one piece then, and what pieces leave to the next ones is told by a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import strip
from scriptorium.session import durable

OPENING = "Mở đầu"
# What a chapter's heading looks like.
HEAD = (
    r"(?iu)^\s*(?:quy[eêể]n\s+\d+\s*[-–—:.]*\s*)?(?:ch[uư][oơ]ng|chapter|h[oôồ]i|ph[aâầ]n|t[aâập]p|m[uụ]c)\s*(?:th[uứ]\s+)?\d+"
)
HEAD_CJK = r"^\s*第\s*[0-9〇零一二三四五六七八九十百千万]+\s*[章节回卷]"
DASHES = r"^\s*-{6,}\s*$"
PART_LINES = 300


def _worth(n: Column, chars: Column) -> Column:
    return (n >= 3) | (chars >= 120)


def _keyed(rows: DataFrame, by: list[str], piece: str | None) -> DataFrame:
    """Rows with the key of their piece. It is a struct, since nulls within one are equal in joins, as they are in windows. Where number_rows made it, rows lie by it already."""
    return rows if "key_" in rows.columns else rows.withColumn("key_", F.struct(*[F.col(c).alias(f"by{i}") for i, c in enumerate(by)], (F.col(piece) if piece else F.lit(0)).alias("piece")))


def _own(by: list[str]):
    """All pieces of a text, in order."""
    return Window.partitionBy(*[f"key_.by{i}" for i in range(len(by))]).orderBy("key_.piece")


def _before(by: list[str]):
    return _own(by).rowsBetween(Window.unboundedPreceding, -1)


def _all(by: list[str]):
    return _own(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _sum(c: Column, over) -> Column:
    return F.coalesce(F.sum(c).over(over), F.lit(0))


def _int(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def number_rows(rows: DataFrame, by: list[str], order: str | Column, piece: str, name: str) -> DataFrame:
    """Row numbers within `by` by `order`, which never falls from a piece to the next: pieces are numbered each for itself, and counted on. Their key stays."""
    rows = _keyed(rows, by, piece)
    counts = rows.groupBy("key_").agg(F.count(F.lit(1)).alias("n_")).select("key_", _sum(F.col("n_"), _before(by)).alias("before_"))
    local = rows.withColumn("at_", F.row_number().over(Window.partitionBy("key_").orderBy(order)))
    return local.join(counts, "key_").withColumn(name, F.col("before_") + F.col("at_")).drop("at_", "before_")


def split_chapters(lines: DataFrame, by: list[str], title: str | None = None, pos: str = "pos", piece: str | None = None) -> DataFrame:
    """(by, idx, title, n, line): each line of a chapter under its number, heading and place (WIN-04, WIN-05).

    Two headings make chapters, what stands before the first is an opening if it is worth it; else a text
    of up to 450 lines is one chapter under the document's title, and a longer one is cut every 300 lines.
    """
    name = F.col(title) if title else F.lit("")
    run = Window.partitionBy("key_").orderBy("pos_")
    flat = strip(F.regexp_replace("line", r"[ \t\r\f\x0b]{2,}|[\t\r\f\x0b]", " "))  # blanks collapsed, empty lines out
    tidy = F.explode(F.filter(F.array(flat), lambda x: x != "")).alias("line")  # made once, unlike a column that is filtered by
    rows = _keyed(lines, by, piece).select("key_", *by, F.col(pos).alias("pos_"), name.alias("name_"), tidy)
    short, rule = F.length("line") <= 100, F.col("line").rlike(DASHES)
    rows = rows.withColumn("at", F.row_number().over(run)).withColumn("rule", rule).withColumn("named", short & (F.col("line").rlike(HEAD) | F.col("line").rlike(HEAD_CJK)))
    # The line after a piece's last one is in the next piece: whether that is a rule, and the last line so a heading, is told below.
    rows = rows.withColumn("ruled", F.lead("rule").over(run))
    rows = rows.withColumn("head", F.col("named") | (short & F.coalesce("ruled", F.lit(False)) & ~F.col("rule"))).withColumn("may", F.col("ruled").isNull() & short & ~F.col("named") & ~F.col("rule"))
    this = F.when(F.col("head"), F.struct("at", F.col("line").alias("title"), _int(F.col("ruled")).alias("ruled")))
    rows = rows.withColumn("last", F.last(this, ignorenulls=True).over(run)).withColumn("former", F.lag("last").over(run))
    # A part is whole at the next heading; it has a body, if it is more than its heading and a rule right under that.
    whole = F.col("head") & (F.col("at") - F.col("former.at") >= 2 + F.col("former.ruled"))
    rows = rows.withColumn("whole", F.sum(_int(whole)).over(run))
    rows = durable(rows.select("key_", *by, "name_", "line", "at", "head", "may", "last", "whole", "rule"), "split-lines")

    early = F.col("last").isNull()
    p = rows.groupBy("key_").agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("rule", "at").alias("rule"), F.sum(_int(F.col("head"))).alias("heads"), F.max_by("last", "at").alias("last"), F.min("last.at").alias("first"), F.max("whole").alias("whole"),
        F.max(F.when(F.col("may"), F.col("line"))).alias("tail"), F.sum(_int(early)).alias("early"), F.coalesce(F.sum(F.when(early, F.length("line"))), F.lit(0)).alias("chars"),
    )
    p = p.withColumn("next", F.coalesce(F.lead("rule").over(_own(by)), F.lit(False))).withColumn("before", _sum(F.col("rows"), _before(by)))
    p = p.withColumn("turns", F.col("next") & F.col("tail").isNotNull())
    ruled = F.greatest(F.col("last.ruled"), _int((F.col("last.at") == F.col("rows")) & F.col("next")))
    p = p.withColumn("whole", F.col("whole") + _int(F.col("turns") & (F.col("rows") - F.col("last.at") >= 2 + F.col("last.ruled"))))
    p = p.withColumn("first", F.col("before") + F.coalesce("first", F.when(F.col("turns"), F.col("rows"))))
    alone = F.col("turns") & (F.col("heads") == 0)
    p = p.withColumn("early", F.col("early") - _int(alone)).withColumn("chars", F.col("chars") - F.when(alone, F.length("tail")).otherwise(0)).withColumn("heads", F.col("heads") + _int(F.col("turns")))
    made = lambda at, title, ruled: F.struct((F.col("before") + at).alias("at"), title.alias("title"), ruled.alias("ruled"))
    p = p.withColumn("end", F.when(F.col("turns"), made(F.col("rows"), F.col("tail"), F.lit(1))).when(F.col("last").isNotNull(), made(F.col("last.at"), F.col("last.title"), ruled)))
    p = p.withColumn("open", F.last("end", ignorenulls=True).over(_before(by))).withColumn("final", F.last("end", ignorenulls=True).over(_all(by)))
    p = p.withColumn("shut", _int(F.col("first") - F.col("open.at") >= 2 + F.col("open.ruled")))
    outside = F.col("open").isNull()
    p = p.withColumn("total", F.sum("rows").over(_all(by))).withColumn("n0", _sum(F.when(outside, F.col("early")), _all(by))).withColumn("chars0", _sum(F.when(outside, F.col("chars")), _all(by)))
    p = p.withColumn("opening", (F.col("n0") > 0) & _worth(F.col("n0"), F.col("chars0"))).withColumn("shut_before", _sum(F.col("whole") + F.col("shut"), _before(by)))
    bodies = F.col("opening") | (F.sum(F.col("whole") + F.col("shut")).over(_all(by)) > 0) | F.coalesce(F.col("total") - F.col("final.at") + 1 >= 2 + F.col("final.ruled"), F.lit(False))
    p = p.withColumn("by_heads", (F.sum("heads").over(_all(by)) >= 2) & bodies).select("key_", "rows", "before", "turns", "open", "shut", "shut_before", "total", "opening", "by_heads")

    rows = rows.join(p, "key_").withColumn("own", F.col("last").isNotNull()).withColumn("last", F.coalesce(F.when(F.col("own"), made(F.col("last.at"), F.col("last.title"), F.col("last.ruled"))), F.col("open")))
    rows = rows.withColumn("at_", F.col("before") + F.col("at")).withColumn("in_part", F.col("at_") - F.col("last.at") + 1)
    kept = ~(F.col("turns") & (F.col("at") == F.col("rows"))) & F.when(F.col("last").isNull(), F.col("opening")).otherwise(F.col("in_part") >= 2 + F.col("last.ruled"))
    rows = rows.where(~F.col("by_heads") | kept)
    long, block = F.col("total") > PART_LINES * 3 / 2, F.floor((F.col("at_") - 1) / PART_LINES)
    part = F.col("shut_before") + F.when(F.col("own"), F.col("shut") + F.col("whole")).otherwise(0) + 1 + _int(F.col("opening"))
    in_opening = F.col("last").isNull()
    idx = F.when(F.col("by_heads"), F.when(in_opening, 1).otherwise(part)).when(long, block + 1).otherwise(1)
    heading = F.when(F.col("by_heads"), F.when(in_opening, OPENING).otherwise(F.col("last.title"))).when(long, F.concat(F.lit("Phần "), (block + 1).cast("string"))).otherwise(F.col("name_"))
    n = F.when(F.col("by_heads"), F.when(in_opening, F.col("at_")).otherwise(F.col("in_part") - 1 - F.col("last.ruled"))).when(long, F.col("at_") - block * PART_LINES).otherwise(F.col("at_"))
    return rows.select(*by, idx.cast("int").alias("idx"), heading.alias("title"), n.cast("int").alias("n"), "line")


def chapter_level(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, chapter_level) where at least two headings share the commonest level; the deeper on ties (AGG-05)."""
    counts = items.where("level IS NOT NULL").groupBy(*by, "level").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("n", "level")).alias("best"), F.sum("n").alias("all"))
    return best.where("all >= 2 AND best.n >= 2").select(*by, F.col("best.level").alias("chapter_level"))


def assemble_levels(items: DataFrame, by: list[str], pos: str = "pos", piece: str | None = None) -> DataFrame:
    """(by, idx, title, n, line) from items (level or null, text): shallower headings prefix the chapters after them, deeper ones are body (WIN-06)."""
    items = _keyed(durable(items, "items"), by, piece)
    whole = [F.col(f"key_.by{i}") for i in range(len(by))]
    levels = chapter_level(items.select(F.struct(*whole).alias("text_"), "level"), ["text_"])
    levels = items.select("key_").distinct().withColumn("text_", F.struct(*whole)).join(levels, "text_").drop("text_")
    run = Window.partitionBy("key_").orderBy(pos)
    above, here = F.col("level") < F.col("chapter_level"), F.coalesce(F.col("level") == F.col("chapter_level"), F.lit(False))
    rows = items.join(levels, "key_").withColumn("at", F.row_number().over(run)).withColumn("here", here).withColumn("opens", F.coalesce(above, F.lit(False)) | here)
    rows = rows.withColumn("prefix", F.last(F.when(above, F.col("text")), ignorenulls=True).over(run))
    # A part starts at a heading of the chapters' level or above; lines after one above belong to no chapter.
    this = F.when(F.col("opens"), F.struct("at", F.col("here").alias("chapter"), F.col("text").alias("title"), "prefix"))
    rows = rows.withColumn("last", F.last(this, ignorenulls=True).over(run))
    rows = rows.withColumn("starts", F.sum(_int(~F.col("opens") & F.lag("here").over(run))).over(run)).withColumn("loose", F.sum(_int(~F.col("opens") & ~F.col("last.chapter"))).over(run))
    rows = durable(rows.select("key_", *by, "text", "at", "opens", "last", "prefix", "starts", "loose"), "levelled-items")

    early, loose = F.col("last").isNull(), ~F.col("opens") & ~F.col("last.chapter")
    chars = lambda which: F.coalesce(F.sum(F.when(which, F.length("text"))), F.lit(0))
    p = rows.groupBy("key_").agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("last", "at").alias("last"), F.max_by("prefix", "at").alias("prefix"), F.max("starts").alias("starts"), F.max("loose").alias("loose"), F.sum(_int(early)).alias("early"), chars(early).alias("early_chars"), chars(loose).alias("chars"),
    )
    p = p.withColumn("before", _sum(F.col("rows"), _before(by))).withColumn("prefix", F.last("prefix", ignorenulls=True).over(_before(by)))
    prefix = F.coalesce("last.prefix", "prefix")
    name = F.when(prefix.isNotNull(), F.concat(prefix, F.lit(" · "), "last.title")).otherwise(F.col("last.title"))
    made = F.when(F.col("last").isNotNull(), F.struct((F.col("before") + F.col("last.at")).alias("at"), F.col("last.chapter").alias("chapter"), name.alias("title")))
    p = p.withColumn("open", F.last(made, ignorenulls=True).over(_before(by))).withColumn("outside", ~F.coalesce("open.chapter", F.lit(False)))
    p = p.withColumn("start", _int((F.col("early") > 0) & F.lag(F.col("last.chapter") & (F.col("last.at") == F.col("rows"))).over(_own(by))))
    p = p.withColumn("early", F.when(F.col("outside"), F.col("early")).otherwise(0)).withColumn("chars", F.col("chars") + F.when(F.col("outside"), F.col("early_chars")).otherwise(0))
    p = p.withColumn("starts_before", _sum(F.col("starts") + F.col("start"), _before(by))).withColumn("loose_before", _sum(F.col("loose") + F.col("early"), _before(by)))
    # All that stands in no chapter is the opening.
    n0, chars0 = F.sum(F.col("loose") + F.col("early")).over(_all(by)), F.sum("chars").over(_all(by))
    p = p.withColumn("opening", (n0 > 0) & _worth(n0, chars0)).select("key_", "before", F.col("prefix").alias("prefix_"), "open", "start", "early", "starts_before", "loose_before", "opening")

    rows = rows.where("NOT opens").join(p, "key_").withColumn("prefix", F.col("prefix_")).withColumn("own", F.col("last").isNotNull()).withColumn("last", F.coalesce(made, F.col("open")))
    rows = rows.withColumn("chapter", F.coalesce("last.chapter", F.lit(False))).where("chapter OR opening")
    idx = F.when(F.col("chapter"), F.col("starts_before") + F.col("start") + F.col("starts") + _int(F.col("opening"))).otherwise(1)
    n = F.when(F.col("chapter"), F.col("before") + F.col("at") - F.col("last.at")).otherwise(F.col("loose_before") + F.when(F.col("own"), F.col("early") + F.col("loose")).otherwise(F.col("at")))
    return rows.select(*by, idx.cast("int").alias("idx"), F.when(F.col("chapter"), F.col("last.title")).otherwise(OPENING).alias("title"), n.cast("int").alias("n"), F.col("text").alias("line"))


def lift_title(items: DataFrame, by: list[str], pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(titles, other items): a first item that is the only heading at its level or above is the work's title (WIN-07)."""
    own = Window.partitionBy(*by)
    rows = items.withColumn("at_", F.row_number().over(own.orderBy(pos))).withColumn("first_", F.first("level").over(own.orderBy(pos)))
    rows = rows.withColumn("peers_", F.sum((F.col("level") <= F.col("first_")).cast("int")).over(own))
    lifted = F.coalesce((F.col("at_") == 1) & F.col("first_").isNotNull() & (F.col("peers_") == 1), F.lit(False))
    rows = rows.withColumn("lifted_", lifted)
    extra = ["at_", "first_", "peers_", "lifted_"]
    return rows.where("lifted_").select(*by, F.col("text").alias("title")), rows.where("NOT lifted_").drop(*extra)


MD_HEAD = r"^(#{1,4})\s+(.+?)\s*#*\s*$"


def markdown_text(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]+)\]\([^)]*\)", "$1"))


def markdown_items(lines: DataFrame, by: list[str], pos: str = "pos", piece: str | None = None) -> DataFrame:
    """(by, pos, level, text): headings and text; what is fenced is text (WIN-16, SRC-11). A piece's column is kept."""
    line = F.regexp_replace("line", r"(?U)\s+$", "")
    fence = F.ltrim(line).startswith("```")
    fences = F.sum(fence.cast("int")).over(Window.partitionBy(*(["key_"] if piece else by)).orderBy(pos))
    if piece:
        lines = _keyed(lines, by, piece)
        counts = lines.groupBy("key_").agg(F.sum(fence.cast("int")).alias("n_")).select("key_", _sum(F.col("n_"), _before(by)).alias("before_"))
        lines, fences = lines.join(counts, "key_"), fences + F.col("before_")
    rows = lines.withColumn("l", line).withColumn("fence", fence).withColumn("inside", fences % 2 == 1).where("NOT fence")
    head = ~F.col("inside") & F.col("l").rlike(MD_HEAD)
    text = F.when(F.col("inside"), strip(F.col("l"))).when(head, markdown_text(F.regexp_extract("l", MD_HEAD, 2))).otherwise(markdown_text(F.col("l")))
    level = F.when(head, F.length(F.regexp_extract("l", MD_HEAD, 1)))
    item = F.filter(F.array(F.struct(level.alias("level"), text.alias("text"))), lambda x: (x["text"] != "") | x["level"].isNotNull())
    return rows.select(*by, pos, *([piece] if piece else []), F.inline(item))


def bookmark_ranges(marks: DataFrame, pages: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """(by, title, first, last): page ranges of the bookmarks at the chapters' level, starts never falling (WIN-09, SRC-09).

    marks are (by, pos, level, title, page from 1), pages (by, n) how many there are; pages count from 0,
    the last excluded.
    """
    run = Window.partitionBy(*by).orderBy(pos)
    rows = marks.join(chapter_level(marks, by), by)
    rows = rows.withColumn("prefix", F.last(F.when(F.col("level") < F.col("chapter_level"), F.col("title")), ignorenulls=True).over(run))
    rows = rows.where("level = chapter_level").withColumn("start", F.greatest(F.lit(0), F.coalesce("page", F.lit(1)) - 1)).withColumn("first", F.max("start").over(run))
    rows = rows.join(pages, by)
    last = F.greatest(F.col("first") + 1, F.coalesce(F.lead("first").over(run), F.col("n")))
    name = F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit(" · "), "title")).otherwise(F.col("title"))
    return rows.select(*by, F.row_number().over(run).alias("idx"), name.alias("title"), "first", last.alias("last"))


def merge_files(chapters: DataFrame, work: str, file_no: str, file_title: str, idx: str = "idx", title: str = "title") -> DataFrame:
    """One work of many files: chapters numbered on in the files' order; a file of one chapter gives it its own title (WIN-15)."""
    single = F.count(F.lit(1)).over(Window.partitionBy(work, file_no)) == 1
    named = chapters.withColumn(title, F.when(single, F.col(file_title)).otherwise(F.col(title)))
    return named.withColumn("new_idx", F.row_number().over(Window.partitionBy(work).orderBy(file_no, idx)))
