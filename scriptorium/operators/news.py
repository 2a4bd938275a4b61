"""News: categories, days, horizons, and the merge of a fresh batch into a stored day."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import fold

DEFAULT = "thoi-su"
# Category by a link's path, in this order.
URL_RULES = [
    ("the-thao", "/(the-thao|sport|sports|esporte|deporte|football|bong-da|soccer|cricket|rugby|tennis|olympic|спорт|スポーツ|体育|足球)"),
    ("quan-su", "/(quan-su|military|defen[cs]e|defence|war|army|navy|air-force|weapon|vu-khi|chien-su|armee|militaire|guerre|военн|армия|军事|国防|軍事)"),
    ("chinh-tri", "/(chinh-tri|politic|politics|election|congress|parliament|senate|politique|politica|política|политик|выборы|政治|选举|政局)"),
    ("y-te", "/(y-te|suc-khoe|health|medical|medicine|disease|covid|sante|santé|saude|saúde|здоров|медицин|医療|健康|医学|健康)"),
    ("khoa-hoc", "/(khoa-hoc|cong-nghe|science|sciences|tech|technology|space|ai-|research|ciencia|ciência|tecnologia|наука|технолог|космос|科学|技術|科技|테크)"),
    ("kinh-te", "/(kinh-te|kinh-doanh|business|economy|economics|market|finance|money|economie|économie|economia|negocios|эконом|бизнес|финанс|经济|财经|商业|経済|ビジネス)"),
    ("moi-truong", "/(moi-truong|environment|climate|weather|nature|энерг|климат|environnement|clima|ambiente|環境|气候|环境)"),
    ("van-hoa", "/(van-hoa|giai-tri|culture|entertainment|arts|music|film|movie|celebrit|lifestyle|travel|du-lich|cultura|культур|文化|娱乐|芸能|エンタメ)"),
    ("thoi-su", "/(the-gioi|thoi-su|world|international|global|monde|mundo|мир|国際|世界|时事)"),
]
# Phrases of each category; Latin ones count as whole phrases, others wherever they stand.
PHRASES = {
    "the-thao": "the thao|bong da|cau thu|vo dich|giai dau|world cup|sea games|olympic|hlv|tran dau|ghi ban|v-league|ngoai hang anh|tuyen thu|dt viet nam|chung ket|sport|sports|football|soccer|match|goal|league|coach|striker|tournament|nba|nfl|mlb|tennis|golf|olympics|championship|athlete|fifa|premier league|futebol|jogador|campeonato|esporte|gol|спорт|футбол|матч|чемпионат|игрок|サッカー|野球|選手|試合|優勝|五輪|体育|足球|比赛|冠军",
    "quan-su": "quan su|quan doi|vu khi|ten lua|chien tranh|xung dot|khong kich|binh si|tau chien|may bay chien dau|phong khong|hat nhan|dan phao|quan nhan|bo quoc phong|tap tran|military|army|troops|missile|warfare|airstrike|weapon|drone strike|warship|nato|ceasefire|offensive|artillery|nuclear weapon|soldier|pentagon|defense ministry|guerre|militaire|armee|военн|армия|ракет|войск|оруж|軍事|自衛隊|ミサイル|导弹|军队|国防",
    "chinh-tri": "chinh tri|quoc hoi|thu tuong|chu tich nuoc|tong thong|bo truong|bau cu|nghi quyet|chinh phu|ngoai giao|nghi si|dai bieu|tong bi thu|president|parliament|congress|senate|election|minister|government|policy|diplomat|vote|campaign|white house|prime minister|lawmaker|ministre|elections|gouvernement|президент|парламент|выбор|министр|правительств|首相|国会|選挙|政府|总统|议会|选举",
    "kinh-te": "kinh te|kinh doanh|chung khoan|lam phat|gia vang|ty gia|doanh nghiep|xuat khau|nhap khau|ngan hang|thi truong|co phieu|bat dong san|mua sam|tieu dung|tieu thuong|suc mua|dau tu|thue quan|gia xang|economy|business|market|stocks|inflation|trade|tariff|bank|gdp|revenue|profit|investor|shares|startup|ipo|earnings|economie|marche|bourse|entreprise|economia|эконом|рынок|банк|акци|инфляц|бизнес|経済|市場|企業|经济|市场|股市|企业",
    "khoa-hoc": "khoa hoc|cong nghe|nghien cuu|vu tru|ve tinh|tri tue nhan tao|ban dan|may tinh|dien thoai|phan mem|nha khoa hoc|chip|robot|science|research|space|satellite|nasa|scientists|technology|semiconductor|software|quantum|rocket|telescope|artificial intelligence|recherche|espace|technologie|ciencia|tecnologia|наука|исследован|космос|спутник|технолог|科学|研究|宇宙|技術|科技|航天",
    "y-te": "y te|suc khoe|benh vien|benh nhan|dich benh|vaccine|bac si|ung thu|virus|sot xuat huyet|dinh duong|phau thuat|bo y te|thuoc|cum a|health|hospital|patient|disease|vaccine|doctor|cancer|flu|outbreak|medicine|clinical|covid|mental health|surgery|sante|hopital|maladie|vaccin|medecin|saude|здоров|больниц|врач|вакцин|лечен|医療|病院|患者|ワクチン|医疗|医院|疫苗",
    "moi-truong": "moi truong|khi hau|bao lu|lu lut|han han|dong dat|song than|o nhiem|rac thai|nang luong tai tao|thien tai|sat lo|climate|environment|flood|drought|earthquake|typhoon|hurricane|wildfire|pollution|emissions|renewable|heatwave|climat|environnement|inondation|seisme|климат|наводнен|землетрясен|эколог|気候|地震|台風|环境|气候",
    "van-hoa": "van hoa|giai tri|am nhac|dien anh|ca si|dien vien|le hoi|du lich|nghe thuat|trien lam|thoi trang|phim|hoa hau|sach|culture|entertainment|music|film|movie|actor|singer|festival|travel|art|fashion|celebrity|album|concert|box office|museum|cinema|musique|cultura|культур|кино|музык|фестивал|映画|音楽|文化|芸能|电影|音乐|娱乐",
}
# What feeds put at a summary's end.
_JUNK = r"read (the )?(full )?(article|more|story)|continue reading|記事を読む|続きを読む|xem chi tiet|xem them|详情|閱讀全文|the post .{0,80} appeared first on .{0,60}"
SUMMARY_TAIL = rf"(?iuU)[\s　…\.\-–—|]*(?:{_JUNK})[\s…\.]*$"
SUMMARY_JUNK = rf"(?iuU)^(?:{_JUNK}|\[…\]|\.\.\.)$"


def by_path(path: Column, rules=None) -> Column:
    """The first rule that a lower-case path fits, else null."""
    out = None
    for name, pattern in rules or URL_RULES:
        test = path.rlike(f"(?iu){pattern}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def phrase_hits(text: Column, phrases: str) -> Column:
    """Distinct Latin phrases in a folded text, as whole phrases and in one scan, and others that it holds (AGG-06, Q1, Q2)."""
    words = list(dict.fromkeys(p for p in phrases.split("|")))
    latin, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    n = F.lit(0)
    if latin:
        pattern = "(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in latin) + ")(?![a-z0-9])"
        n = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    if other:
        n = n + F.size(F.filter(F.array(*map(F.lit, other)), lambda w: F.contains(text, w)))
    return n


def category_scores(title: Column, summary: Column, phrases: dict[str, str] | None = None) -> Column:
    """array of struct(score, place, category): three times the title's hits and the summary's first 220 characters'; earlier categories win ties (AGG-07, Q24)."""
    t, s = fold(F.coalesce(title, F.lit(""))), fold(F.left(F.coalesce(summary, F.lit("")), F.lit(220)))
    return F.array(
        *(F.struct((3 * phrase_hits(t, p) + phrase_hits(s, p)).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("category")) for i, (name, p) in enumerate((phrases or PHRASES).items()))
    )


def category(title: Column, summary: Column, link: Column, tags: Column, hint: Column, phrases=None, url_rules=None) -> Column:
    """The feed's own category, else by path, by tags (only the first, or what follows a slash), by phrases, else news in general (SCL-05, Q20)."""
    tag_path = F.concat(F.lit("/"), F.replace(F.lower(F.array_join(F.coalesce(tags, F.array()), " ")), F.lit(" "), F.lit("-")))
    best = F.array_max(category_scores(title, summary, phrases))
    scored = F.when(best["score"] >= 2, best["category"])
    return F.coalesce(F.nullif(hint, F.lit("")), by_path(F.lower(F.coalesce(link, F.lit(""))), url_rules), by_path(tag_path, url_rules), scored, F.lit(DEFAULT))


def longest_first(rows: DataFrame, key: str, size: Column, arrival: str, source: str) -> DataFrame:
    """One row a key: the longest, the first of equals; the other sources of the key as also_carried_by (WIN-02, AGG-08, Q5)."""
    best = Window.partitionBy(key).orderBy(F.desc("size_"), arrival)
    others = Window.partitionBy(key)
    out = rows.withColumn("size_", size).withColumn("at_", F.row_number().over(best)).withColumn("all_", F.collect_set(source).over(others)).where("at_ = 1")
    return out.withColumn("also_carried_by", F.array_sort(F.array_except("all_", F.array(F.col(source))))).drop("size_", "at_", "all_")


def within_horizon(ts: Column, now: Column, hours: int = 48) -> Column:
    """Undated rows stay (FLT-05)."""
    return ts.isNull() | (ts >= now - F.make_interval(hours=F.lit(hours)))


def merge_day(fresh: DataFrame, stored: DataFrame, now: Column, key: str = "dedup_key", ts: str = "published_at", carry_cols: tuple[str, ...] = ("translation",), hours: int = 48) -> DataFrame:
    """Fresh rows within the horizon with the stored rows' carried fields, and stored rows whose key is not fresh at all (OPS-05, Q6, Q7)."""
    recent = fresh.where(within_horizon(F.col(ts), now, hours))
    old = stored.select(key, *[F.col(c).alias(f"old_{c}") for c in carry_cols])
    recent = recent.join(old, key, "left").select(
        *[F.coalesce(F.col(f"old_{c}"), F.col(c)).alias(c) if c in carry_cols else F.col(c) for c in fresh.columns]
    )
    return recent.unionByName(stored.join(fresh.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def day_page(rows: DataFrame, order: list, category: str = "", country: str = "", find: str = "", text: Column | None = None, offset: int = 0, limit: int = 60, body: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, total): a filtered, folded search by page, bodies replaced by has_body (FLT-04, SRT-04, PRJ-14)."""
    from scriptorium.functions.text import py_fold

    if category:
        rows = rows.where(F.col("category") == category)
    if country:
        rows = rows.where(F.col("country") == country)
    if find:
        rows = rows.where(F.contains(fold(text), F.lit(py_fold(find))))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    if body:
        rows = rows.withColumn("has_body", F.coalesce(F.length(body), F.lit(0)) > 0).drop(body)
    return rows.orderBy(*order).offset(offset).limit(limit), total


def newest_first(rows: DataFrame, ts: str = "published_at", then: str = "place") -> DataFrame:
    """The latest first, undated rows last, equal ones by arrival (SRT-01)."""
    return rows.orderBy(F.desc_nulls_last(ts), then)


def category_counts(rows: DataFrame, category: str = "category") -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def day_rollup(rows: DataFrame, day: str = "day", category: str = "category") -> DataFrame:
    """Counts by day and category, and by day (null category) (AGG-02)."""
    return rows.rollup(day, category).agg(F.count(F.lit(1)).alias("n")).where(F.col(day).isNotNull())


def summary(cleaned: Column, title: Column) -> Column:
    """A cleaned summary without a feed's closing words; blank if short, junk or the title again (PRJ-09)."""
    from scriptorium.functions.text import same_title, strip

    s = strip(F.regexp_replace(cleaned, SUMMARY_TAIL, ""))
    bare = F.regexp_replace(s, r"^[ .…]+|[ .…]+$", "")
    return F.when((F.length(s) < 15) | bare.rlike(SUMMARY_JUNK) | same_title(s, title), "").otherwise(s)
