"""Text scalars: folds, predicates, rates and grades, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: quotes, dashes and ligatures with what they fold to
CURLY = ("\u2018\u2019\u201a\u201c\u201d\u201e\u2013\u2014\u2212", "'''\"\"\"---")
LIGATURES = (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"))
#: fixed values: letters with marks and the plain letters they fold to
MARKED = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
GRADES = ("ok", "low", "medium", "high")


def squeezed(c: Column) -> Column:
    """White space runs made one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\x0b\f]+", " "))


def typographic(c: Column) -> Column:
    """Quotes, dashes, ligatures and ellipses in their plain forms."""
    c = F.translate(c, *CURLY)
    for mark, plain in LIGATURES:
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return F.regexp_replace(F.replace(c, F.lit("\u2026"), F.lit("...")), r"\.{3,}", "...")


def folded(c: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(c), *MARKED)


def german(c: Column) -> Column:
    """Lower case with umlauts spelled out."""
    c = F.lower(c)
    for mark, plain in UMLAUTS:
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def loosely_matches(haystack: Column, query: Column) -> Column:
    """Every word of the query is part of the haystack under one of two folds; a blank query matches all."""
    under = lambda fold: F.forall(F.filter(F.split(fold(query), " "), lambda w: w != ""), lambda w: F.contains(fold(haystack), w))
    return under(folded) | under(german)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(folded(c), "[^a-z0-9]+", "-"), F.lit("-"))


def removed_count(c: Column, pattern: str) -> Column:
    """How many characters the pattern's matches have."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def graded(rate: Column, low: float, medium: float, high: float) -> Column:
    return F.when(rate >= high, "high").when(rate >= medium, "medium").when(rate >= low, "low").otherwise("ok")


def rank(grade: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, GRADES)), grade)


def verdict(grades: list[Column]) -> Column:
    """clean, suspect or unusable by the worst grade."""
    worst = F.greatest(*map(rank, grades))
    return F.when(worst >= 4, "unusable").when(worst >= 3, "suspect").otherwise("clean")


def clipped(c: Column, budget: int) -> Column:
    """Head and tail of a text that is longer than budget."""
    half = budget // 2
    return F.when(F.length(c) > budget, F.concat(F.substring(c, 1, half), F.lit(" … "), F.substring(c, -half, half))).otherwise(c)


def edit_share(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)
