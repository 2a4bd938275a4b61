"""Scalar text functions as Catalyst expressions; Python only where Spark has no such function (NFC, JSON in prose, URL joining).

Java's classes are ASCII unless (?U) is given, and trim() only knows the space; the helpers here take
Unicode white space, as the rules of this engine do.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.udf import vectorised

# ---------------------------------------------------------------- Unicode


@vectorised("string")
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@lru_cache(maxsize=1)
def _unsettled() -> str:
    """A pattern of the characters without which a text is in normal form C: marks, what is never in that form, and what can join the one before it."""
    joining = {d.split()[1] for d in (unicodedata.decomposition(chr(c)) for c in range(0xC0, 0x1F000)) if len(d.split()) == 2 and d[0] != "<"}
    found = [c for c in range(0x300, 0x30000) if unicodedata.combining(chr(c)) or f"{c:04X}" in joining or 0x1161 <= c <= 0x1175 or 0x11A8 <= c <= 0x11C2 or not unicodedata.is_normalized("NFC", chr(c))]
    ranges: list[list[int]] = []
    for c in found:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


#: Ranges of characters that always are in normal form C: to the spacing modifiers, Latin with several marks, dashes and quotes, CJK, Hangul syllables.
SETTLED = [(0x00, 0x2FF), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x3029), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]


def _odd() -> str:
    """A pattern of a character that is in none of the settled ranges. Nearly all are in the first, and are tested for that alone: a class of eight ranges takes many times as long."""
    first, *others = (rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in SETTLED)
    return f"[^{first}](?<![{''.join(others)}])"


def nfc(c: Column) -> Column:
    """Normal form C. Where a text can only be in it already, Python gets a null for it. The long pattern is for texts with characters out of the ordinary."""
    return F.coalesce(_nfc(F.when(c.rlike(_odd()), F.when(c.rlike(_unsettled()), c))), c)


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, str]:
    """(composed letters, their base letters, combining marks): built from Unicode's own decompositions of one base and marks."""
    src, dst, marks = [], [], []
    for c in map(chr, range(0x80, 0x3130)):
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c:
            src.append(c)
            dst.append(base[0].lower())
    for c in map(chr, range(0x1E00, 0x2000)):
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c and c not in src:
            src.append(c)
            dst.append(base[0].lower())
    return "".join(src), "".join(dst), "".join(marks)


def fold(c: Column, fold_d: bool = False) -> Column:
    """Diacritics off and lower case. The letter d with a stroke is no composed letter and stays, unless fold_d (SCL-01)."""
    src, dst, marks = _fold_table()
    out = F.lower(F.translate(c, src + marks, dst))
    return F.translate(out, "đ", "d") if fold_d else out


def py_fold(s: str | None) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", s or "") if unicodedata.category(x) != "Mn").lower()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


# ---------------------------------------------------------------- lines

DECOR_LINE = r"(?U)^[\s\W_]{0,40}$"


def is_decor(c: Column) -> Column:
    """At most 40 characters, none of them of a word (FLT-02)."""
    return c.rlike(DECOR_LINE)


def lines_of(df, text_col: str, line: str = "line", pos: str = "pos"):
    """A row for each line of a text, the others' columns kept."""
    return df.select(*[c for c in df.columns if c != text_col], F.posexplode(F.split(text_col, "\n", -1)).alias(pos, line))


def ends_well(c: Column) -> Column:
    """Whether a text seems finished: closing punctuation at its end (FLT-19)."""
    return strip(c).rlike("[.!?…\"”’』」*)\\]]$")


def is_cjk(c: Column) -> Column:
    return c.rlike("[\\u4e00-\\u9fff]")


# ---------------------------------------------------------------- keys


def dedup_key(link: Column, title: Column) -> Column:
    """The link without query, fragment and closing slashes in lower case; without a link, 80 characters of the folded title (SCL-02)."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(link, "[?#].*$", ""), "/+$", ""))
    return F.when(F.coalesce(F.length(link), F.lit(0)) > 0, bare).otherwise(F.left(fold(F.coalesce(title, F.lit(""))), F.lit(80)))


def same_title(a: Column, b: Column) -> Column:
    """Folded, word characters only, first 60; never for empty ones (SCL-03)."""
    cut = lambda c: F.left(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"(?U)\W+", ""), F.lit(60))
    return (cut(a) != "") & (cut(a) == cut(b))


def same_text(a: Column, b: Column) -> Column:
    cut = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\W+", ""))
    return cut(a) == cut(b)


def same_name(a: Column, b: Column) -> Column:
    return F.lower(collapse(a)) == F.lower(collapse(b))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def memory_key(lang: Column, text: Column) -> Column:
    """The key of a translation memory (SCL-08)."""
    return F.md5(F.concat(lang, F.lit("\0"), text))


# Words that carry no meaning of their own.
STOP_WORDS = (
    "và của cho với một các những này đó là có không đã sẽ bị được trong ngoài khi thì mà rằng chương về đến từ vào "
    "cũng rất nữa hay hoặc cùng đang vẫn còn lại ra nên để vì"
).split()


def keywords(c: Column) -> Column:
    """Distinct words of two letters or more, no numbers, no stop words (SCL-09)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 2) & ~w.rlike(r"(?U)^\d+$") & ~F.array_contains(stop, w)))


# ---------------------------------------------------------------- names and caps

# Device names that no file may have.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


def safe_name(c: Column, limit: int = 90) -> Column:
    """A name that any file system takes; the backslash goes, too (PRJ-16)."""
    name = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r'[<>:"/\\|?*\x00-\x1f]', "")
    name = F.regexp_replace(collapse(name), r"^[ .]+|[ .]+$", "")
    name = F.when(F.upper(F.substring_index(name, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), name)).otherwise(name)
    name = F.regexp_replace(F.left(name, F.lit(limit)), r"^[ .]+|[ .]+$", "")
    return F.when(name == "", "khong-ten").otherwise(name)


def cap(c: Column, n: int, marker: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(marker))).otherwise(c)


def initials(c: Column) -> Column:
    """Of the first two words (PRJ-25)."""
    return F.upper(F.array_join(F.transform(F.slice(F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != ""), 1, 2), lambda w: F.left(w, F.lit(1))), ""))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def progress_web(i: Column, n: Column) -> Column:
    return F.when(n > 0, F.least(F.lit(100), F.round(i * 100 / n))).otherwise(0).cast("int")


def progress_mobile(i: Column, n: Column) -> Column:
    return F.round((i - 1) / F.greatest(F.lit(1), n) * 100).cast("int")


def name_map(c: Column) -> Column:
    """`old = new` lines to a map (SCL-16)."""
    rows = F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(
        F.filter(F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_extract(x, "=(.*)$", 1)).alias("value"))), lambda e: e["key"] != "")
    )


# ---------------------------------------------------------------- tags


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def doc_title(html: Column, fallback: Column) -> Column:
    """The first h1 to h4, else the title tag, at most 200 characters, else the fallback (PRJ-03)."""
    head = F.regexp_extract(html, r"(?is)<h([1-4])[^>]*>(.*?)</h\1\s*>", 2)
    has_head = F.coalesce(html.rlike(r"(?is)<h([1-4])[^>]*>(.*?)</h\1\s*>"), F.lit(False))
    found = strip_tags(F.when(has_head, head).otherwise(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(found != "", F.left(found, F.lit(200))).otherwise(fallback)


def without_head(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)^(.*?)<head\b.*?</head\s*>", "$1")


# ---------------------------------------------------------------- URLs

# What can be read, and what is known but can't.
READABLE = ["pdf", "docx", "epub", "txt", "md", "markdown", "htm", "html", "xhtml"]
KNOWN_UNREADABLE = ["doc", "pptx", "ppt", "xlsx", "zip", "rar"]
MIME_KINDS = {
    "application/pdf": "pdf",
    "application/epub+zip": "epub",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/plain": "txt",
    "text/markdown": "md",
}


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def url_file(c: Column) -> Column:
    return F.try_url_decode(F.regexp_extract(F.regexp_replace(url_path(c), "/+$", ""), r"([^/]*)$", 1))


def url_ext(c: Column) -> Column:
    """The extension in lower case, empty without one; a leading dot makes none (PRJ-17)."""
    return F.lower(F.coalesce(F.regexp_extract(url_file(c), r"^.+\.([^.]+)$", 1), F.lit("")))


def file_name(url: Column, label: Column) -> Column:
    """The URL's file name, else one from the link's text."""
    own = F.coalesce(url_file(url), F.lit(""))
    text = F.left(strip(F.regexp_replace(F.when(F.coalesce(label, F.lit("")) == "", "tai-lieu").otherwise(label), r'[/:*?"<>|\\]+', " ")), F.lit(80))
    ext = F.when(url_ext(url) == "", "bin").otherwise(url_ext(url))
    return F.when((own != "") & F.contains(own, F.lit(".")), own).otherwise(F.concat(F.when(text == "", "tai-lieu").otherwise(text), F.lit("."), ext))


def header_kind(mime: Column, disposition: Column) -> Column:
    """A file's type by its headers (PRJ-18)."""
    kinds = F.create_map(*[F.lit(x) for kv in MIME_KINDS.items() for x in kv])
    by_mime = F.element_at(kinds, F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1))))
    named = F.regexp_extract(F.coalesce(disposition, F.lit("")), r"""filename\*?=(?:UTF-8'')?"?([^";]+)""", 1)
    found = F.coalesce(by_mime, F.lower(F.regexp_extract(F.try_url_decode(named), r"^.+\.([^.]+)$", 1)))
    return F.when(found.isin(READABLE + KNOWN_UNREADABLE), found).otherwise("")


def cover_ext(url: Column, mime: Column) -> Column:
    """SRC-21."""
    ext = F.lower(F.regexp_extract(url_path(F.coalesce(url, F.lit(""))), r"(?i)\.(jpe?g|png|webp|gif)$", 1))
    kind = F.lower(F.coalesce(mime, F.lit("")))
    by_type = F.when(F.contains(kind, F.lit("png")), "png").when(F.contains(kind, F.lit("webp")), "webp").when(F.contains(kind, F.lit("gif")), "gif").otherwise("jpg")
    return F.when(ext == "jpeg", "jpg").when(ext != "", ext).otherwise(by_type)


def is_link(href: Column) -> Column:
    """FLT-07."""
    return (F.coalesce(href, F.lit("")) != "") & ~href.rlike("^(#|javascript:|mailto:)")


# What the text or the address of a link to a document looks like.
DOWNLOAD_TEXT = r"(?iu)t[aả]i\s*(xu[oố]ng|v[eề])|download|t[aả]i\s*file|b[aả]n\s*pdf|xem\s*b[aả]n|attachment|pdf|docx?|epub|t[aà]i\s*li[eệ]u"
DOWNLOAD_PATH = r"(?i)/(download|tai-xuong|taixuong|file|files|attachment|uploads?|releases/download|media)(/|\?|$)"


def like_document(label: Column, url: Column) -> Column:
    """FLT-08."""
    return F.coalesce(label, F.lit("")).rlike(DOWNLOAD_TEXT) | F.coalesce(url, F.lit("")).rlike(DOWNLOAD_PATH)


@vectorised("string")
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link against its page (SCL-06); null where it is no URL."""

    def one(b, h):
        try:
            return urljoin(b or "", h or "")
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


# ---------------------------------------------------------------- dates

_ZONES = {"GMT": "+0000", "UT": "+0000", "UTC": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def parse_date(c: Column) -> Column:
    """RFC 2822, ISO and five more formats, the first that fits; without a zone UTC is meant; else null (SCL-04)."""
    s = strip(c)
    rfc = F.regexp_replace(s, r"^[A-Za-z]{3,9},\s*", "")
    for name, offset in _ZONES.items():
        rfc = F.regexp_replace(rfc, rf"\s{name}$", f" {offset}")
    iso = F.regexp_replace(s, r"^(\d{4}-\d\d-\d\d)[ ](\d\d)", "$1T$2")
    at = lambda x, f: F.try_to_timestamp(x, F.lit(f))
    is_rfc = rfc.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}")
    return F.coalesce(
        F.when(is_rfc, at(rfc, "d MMM yyyy HH:mm:ss Z")),
        F.when(is_rfc, at(rfc, "d MMM yyyy HH:mm:ss")),
        F.when(is_rfc, at(rfc, "d MMM yyyy HH:mm Z")),
        F.when(iso.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d"), iso.try_cast("timestamp")),
        at(F.left(s, F.lit(19)), "dd/MM/yyyy HH:mm:ss"),
        at(F.left(s, F.lit(16)), "dd/MM/yyyy HH:mm"),
        at(s, "M/d/yyyy h:mm:ss a"),
        at(F.left(s, F.lit(10)), "yyyy-MM-dd"),
    )


# ---------------------------------------------------------------- model replies


def first_json(text: str | None) -> str | None:
    """The first JSON in prose: a fenced block that parses, else the first balanced braces that do (SCL-10)."""
    if not text:
        return None
    if m := re.search(r"(?s)```(?:json)?\s*(.*?)```", text):
        try:
            return json.dumps(json.loads(m[1]), ensure_ascii=False)
        except ValueError:
            pass
    opened: list[int] = []
    spans: dict[int, int] = {}
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            spans[opened.pop()] = m.end()
    for start in sorted(spans):
        try:
            return json.dumps(json.loads(text[start : spans[start]]), ensure_ascii=False)
        except ValueError:
            continue
    return None


@vectorised("string")
def extract_json(s: pd.Series) -> pd.Series:
    return s.map(first_json, na_action="ignore")


def drop_thinking(c: Column) -> Column:
    """Thoughts of a model, closed ones and then one that never closes (SCL-11)."""
    return strip(F.regexp_replace(F.regexp_replace(c, "(?is)<think>.*?</think>", ""), "(?is)<think>.*$", ""))


def split_reply(c: Column) -> Column:
    """struct(body, state): the outline goes, the state comes as JSON (SCL-12)."""
    chapter, outline = r"={2,}\s*CH[UƯ][OƠ]NG\s*={2,}", r"={2,}\s*D[AÀ]N[_\s]*C[AẢ]NH\s*={2,}"
    text = F.when(c.rlike(rf"(?s){outline}.*?{chapter}"), F.regexp_replace(c, rf"(?s)^.*?{chapter}", "")).otherwise(c)
    parts = F.split(text, r"={2,}\s*TR[AẠ]NG[_\s]*TH[AÁ]I\s*={2,}", 2)
    body = F.regexp_replace(strip(parts[0]), r"^\s*(?:[#*]+\s*)?Chương\s+\d+[^\n]*\n+", "")
    return F.struct(body.alias("body"), extract_json(F.get(parts, F.lit(1))).alias("state"))


def numbered_lines(reply: Column, originals: Column) -> Column:
    """Numbered lines of a reply at their places; the first of a number wins, what is missing stays as it was (SCL-13)."""
    lines = F.filter(
        F.transform(F.split(reply, r"\r?\n"), lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d{1,3})\s*[.)\]:]\s*(.+)$", 1).try_cast("int").alias("n"), strip(F.regexp_extract(x, r"^\s*(\d{1,3})\s*[.)\]:]\s*(.+)$", 2)).alias("text"))),
        lambda r: r["n"].isNotNull() & (r["text"] != ""),
    )
    return F.transform(originals, lambda o, i: F.coalesce(F.get(F.filter(lines, lambda r: r["n"] == i + 1), F.lit(0))["text"], o))


def verdict_line(line: Column) -> Column:
    """struct(n, yes, name) of `n|yes/no|name` (SCL-14)."""
    part = lambda i: strip(F.regexp_extract(line, r"^\s*(\d+)\s*\|\s*([^|]*)\|?(.*)$", i))
    yes = F.lower(part(2)).rlike("^(có|co|yes|y|1|true)")
    return F.struct(part(1).try_cast("int").alias("n"), yes.alias("yes"), part(3).alias("name"))


def list_item(variant_json: Column, limit: int = 120) -> Column:
    """A list's item as text: an object's values joined, anything else as it is (SCL-15)."""
    values = F.map_values(F.from_json(variant_json, "map<string,string>"))
    joined = F.array_join(F.filter(F.transform(values, strip), lambda v: v != ""), " — ")
    return F.left(F.when(variant_json.rlike(r"^\s*\{"), joined).otherwise(F.regexp_replace(variant_json, '^"|"$', "")), F.lit(limit))


def rewrite_accepted(draft: Column, rewrite: Column) -> Column:
    """FLT-20."""
    return F.coalesce(F.length(rewrite).between(0.85 * F.length(draft), 1.8 * F.length(draft)) & (rewrite != ""), F.lit(False))
