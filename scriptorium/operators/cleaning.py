"""Line cleaning, repeated-line detection and samples of chapters.

A chapter's lines are rows (book, chapter, pos, line). Everything that needs a chapter's order shares one
partitioning by book and chapter; detection is a distinct count with map-side partial sums.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import is_decor, nfc, strip


def java_regex(pattern: str) -> str:
    """A rule in Python's syntax for Java: Unicode classes, any case, named groups as Java writes them."""
    return "(?iuU)" + re.sub(r"\(\?P<", "(?<", pattern)


def java_replacement(text: str) -> str:
    r"""\1 and \g<1> to $1, literal dollars kept (Q18)."""
    return re.sub(r"\\g<(\w+)>|\\(\d+)", lambda m: "$" + (m[1] or m[2]), text.replace("$", r"\$"))


@dataclass(frozen=True)
class Rules:
    """What a reader wants gone or renamed. Regular expressions that don't compile are left out (FLT-03)."""

    remove: list[str] = field(default_factory=list)
    drop_line: list[str] = field(default_factory=list)
    regex: list[tuple[str, str]] = field(default_factory=list)
    names: dict[str, str] = field(default_factory=dict)

    def usable(self) -> Rules:
        def good(p: str) -> bool:
            try:
                re.compile(p, re.I)
            except re.error:
                return False
            return True

        return Rules([x for x in self.remove if x], [p for p in self.drop_line if good(p)], [(p, r) for p, r in self.regex if good(p)], {k: v for k, v in self.names.items() if k})


def rewrite(line: Column, rules: Rules, normalise: bool = True) -> Column:
    """Literal removal, substitutions, names, then blanks, in this order."""
    line = nfc(line) if normalise else line
    for text in rules.remove:
        line = F.replace(line, F.lit(text))
    for pattern, text in rules.regex:
        line = F.regexp_replace(line, java_regex(pattern), java_replacement(text))
    for old, new in rules.names.items():
        line = F.replace(line, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(line, r"[ \t]+", " "))


def drop_repeats(lines: DataFrame, by: list[str], pos: str = "pos", line: str = "line") -> DataFrame:
    """Lines that equal the last one before them go (WIN-01)."""
    last = F.lag(line).over(Window.partitionBy(*by).orderBy(pos))
    return lines.withColumn("last_", last).where(F.col("last_").isNull() | (F.col("last_") != F.col(line))).drop("last_")


def clean(lines: DataFrame, by: list[str], rules: Rules | None = None, boilerplate: DataFrame | None = None, book: str | None = None, normalise: bool = True) -> DataFrame:
    """FLT-01: rewrite, drop blank and decoration lines, boilerplate (of the book), unwanted lines, then repeats of the last kept line."""
    rules = (rules or Rules()).usable()
    # A filter on a made column makes it again for each of its tests; an array's element is made once.
    out = lines.withColumn("line", nfc(F.col("line"))) if normalise else lines
    tidy = F.explode(F.filter(F.array(rewrite(F.col("line"), rules, normalise=False)), lambda x: (x != "") & ~is_decor(x)))
    out = out.select(*[tidy.alias(c) if c == "line" else F.col(c) for c in out.columns])
    if boilerplate is not None:
        out = out.join(boilerplate, [book, "line"] if book else ["line"], "left_anti")
    for pattern in rules.drop_line:
        out = out.where(~F.col("line").rlike(java_regex(pattern)))
    return drop_repeats(out, by)


def detect_boilerplate(lines: DataFrame, book: str, chapter: str, threshold: float = 0.6, longest: int = 160) -> DataFrame:
    """(book, line) of short lines in at least max(3, floor(share of chapters)) chapters of a book of four or more (AGG-03)."""
    chapters = lines.select(book, chapter).distinct().groupBy(book).agg(F.count(F.lit(1)).alias("n_")).where("n_ >= 4")
    short = lines.where(F.length("line") <= longest).select(book, chapter, "line").distinct()
    counts = short.groupBy(book, "line").agg(F.count(F.lit(1)).alias("c_"))
    need = F.greatest(F.lit(3), F.floor(F.col("n_") * threshold))
    return counts.join(chapters, book).where(F.col("c_") >= need).select(book, "line")


def systematic_sample(chapters: DataFrame, book: str, order: str, size: int = 15) -> DataFrame:
    """Every max(1, n // size)-th chapter of a book, `size` at most (OPS-03)."""
    w = Window.partitionBy(book)
    numbered = chapters.withColumn("at_", F.row_number().over(w.orderBy(order)) - 1).withColumn("n_", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("n_") / size))
    return numbered.where((F.col("at_") % step == 0) & (F.floor(F.col("at_") / step) < size)).drop("at_", "n_")


def sampled_boilerplate(lines: DataFrame, book: str, chapter: str, threshold: float = 0.6, longest: int = 160, size: int = 15) -> DataFrame:
    """The same over a sample of chapters, for reading at once (AGG-04)."""
    chosen = systematic_sample(lines.select(book, chapter).distinct(), book, chapter, size)
    enough = lines.select(book, chapter).distinct().groupBy(book).agg(F.count(F.lit(1)).alias("n_")).where("n_ >= 4").select(book)
    return detect_boilerplate(lines.join(chosen, [book, chapter], "left_semi").join(enough, book, "left_semi"), book, chapter, threshold, longest)


def drop_title_lines(lines: DataFrame, by: list[str], title: str = "title") -> DataFrame:
    """Lines at a chapter's start that repeat its title go (FLT-16)."""
    first = F.min(F.when(strip(F.col("line")) != F.col(title), F.col("pos"))).over(Window.partitionBy(*by))
    return lines.withColumn("first_", first).where("pos >= first_").drop("first_")


def worth_keeping(lines: Column) -> Column:
    """Whether an opening of some lines is a text: three lines, or 120 characters (FLT-18)."""
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    return (F.size(lines) >= 3) | (total >= 120)
