"""Web pages as element trees: tags as events in their order, elements as intervals of it, and what is read from them.

Each tag and each piece of text has its place in the page. An element is the interval from its tag to the one that
ends it, so an ancestor is an interval around another, and the text of an element is a part of the page's text. All of
it is counting along the order of one page: windows over the page's rows, no tree in memory.

Ends that are left out: a paragraph ends before the next block, any other element without an end at the page's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: comments, elements that hold no markup, declarations, tags, text
TOKENS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<title\b.*?</title\s*>|<![^>]*>|</?[a-z][^>]*>|[^<]+|<"
NAME = "^</?([a-zA-Z][a-zA-Z0-9]*)"
RAW = "(?i)^<(script|style|noscript|title)[^a-z]"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: fixed values: elements whose text is read, those that only hold others, and those that are passed over
READ = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "figcaption", "td", "th")
HOLD = ("div", "article", "section", "main", "ul", "ol", "table", "tbody", "thead")
PASSED = ("nav", "aside", "figure", "iframe", "svg")
#: fixed value: attributes of elements that are passed over
PROMOTED = r"""(?i)data-testid\s*=\s*["']promo-box["']|class\s*=\s*["'][^"']*(newsletter|signup|social-share)|aria-label\s*=\s*["']Tags["']"""
#: what ends a paragraph whose end is left out
BLOCKS = (*READ, *HOLD, *PASSED, "body", "html", "header", "footer", "form", "pre", "dl", "dt", "dd", "tr", "tfoot", "caption", "hr", "address", "fieldset")
#: references that are written out, the ampersand last
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))


def plain(text: Column) -> Column:
    """References written out, white space made single spaces."""
    for name, sign in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, at, kind, name, token, before): open and close tags and texts; before: characters of the page's text before it."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TOKENS), F.lit(0))).alias("at", "token"))
    token = F.col("token")
    void = F.lower(F.regexp_extract(token, NAME, 1)).isin(*VOID) | token.rlike(r"/\s*>$")
    kind = F.when(token.rlike("^<!") | token.rlike(RAW), "none").when(token.rlike("(?i)^</[a-z]"), "close").when(token.rlike("(?i)^<[a-z]"), F.when(void, "void").otherwise("open")).otherwise("text")
    rows = rows.withColumn("kind", kind).filter("kind <> 'none'").withColumn("name", F.lower(F.regexp_extract("token", NAME, 1)))
    order = Window.partitionBy(key).orderBy("at")
    long = F.when(F.col("kind") == "text", F.length("token")).otherwise(0)
    return rows.withColumn("before", F.coalesce(F.sum(long).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def elements(found: DataFrame, key: str) -> DataFrame:
    """(key, name, tag, begin, end, first, last, blocks): elements of the events; first and last bound their text.

    blocks: elements of READ and HOLD inside.
    """
    order = Window.partitionBy(key).orderBy("at")
    # what follows is what stands before in the other order, which a window reads once
    onward = Window.partitionBy(key).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"
    block = F.col("name").isin(*BLOCKS) & F.col("kind").isin("open", "close", "void")
    counted = F.when(is_open & F.col("name").isin(*READ, *HOLD), 1).otherwise(0)
    rows = found.withColumn("_own", counted).withColumn("_blocks", F.coalesce(F.sum(counted).over(past), F.lit(0)))
    place = F.struct("at", "before", "_blocks", "_own")
    rows = rows.withColumn("_next", F.last(F.when(block, place), True).over(onward)).withColumn("_end", F.max(place).over(Window.partitionBy(key)))
    last = F.struct((F.col("_end.at") + 1).alias("at"), F.lit(1 << 30).cast("long").alias("before"), (F.col("_end._blocks") + F.col("_end._own")).alias("_blocks"), F.lit(0).alias("_own"))
    # an end meets the last open tag of its name: both stand at one level of the name's balance
    tags = rows.filter(is_open | is_close)
    step = F.when(is_open, 1).otherwise(-1)
    balance = F.sum(step).over(Window.partitionBy(key, "name").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tags = tags.withColumn("_level", F.when(is_open, balance).otherwise(balance + 1))
    level = Window.partitionBy(key, "name", "_level").orderBy("at")
    tags = tags.withColumn("_close", F.when(F.lead("kind").over(level) == "close", F.lead(place).over(level)))
    close = F.when(F.col("name") == "p", F.coalesce("_next", last)).otherwise(F.coalesce("_close", last))
    out = tags.filter(is_open).withColumn("_c", close)
    return out.select(key, "name", F.col("token").alias("tag"), F.col("at").alias("begin"), F.col("_c.at").alias("end"), F.col("before").alias("first"), F.col("_c.before").alias("last"), (F.col("_c._blocks") - F.col("_blocks") - F.col("_own")).alias("blocks"))


def inside(found: DataFrame, key: str, around: Column, name: str) -> DataFrame:
    """found with `name`, the number of other elements that satisfy `around` and hold this one."""
    rows = found.select(key, F.col("begin").alias("_at"), F.lit(1).alias("_step"), *found.columns[1:]).withColumn("_around", around)
    ends = rows.filter("_around").select(key, F.col("end").alias("_at"), F.lit(-1).alias("_step"), F.lit(True).alias("_around"))
    both = rows.unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at", "_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.sum(F.when(F.col("_around"), F.col("_step")).otherwise(0)).over(order)
    both = both.withColumn(name, held - F.when(F.col("_around") & (F.col("_step") == 1), 1).otherwise(0))
    return both.filter("_step = 1").select(*found.columns, name)


def with_texts(found: DataFrame, all_: DataFrame, key: str) -> DataFrame:
    """Rows (key, begin, ..., first, last) with `text`, their part of the page's text, which stays in one row."""
    texts = all_.filter("kind = 'text'").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), "").alias("_page"))
    lists = found.groupBy(key).agg(F.collect_list(F.struct(*[c for c in found.columns if c != key])).alias("_rows"))
    cut = F.transform("_rows", lambda e: F.struct(e.alias("e"), plain(F.substring(F.coalesce("_page", F.lit("")), e["first"] + 1, e["last"] - e["first"])).alias("text")))
    out = lists.join(texts, key, "left").select(key, F.explode(cut).alias("x"))
    return out.select(key, "x.e.*", "x.text")


def segments(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, category, text) of the structural elements of each page, in their order.

    Headings, quotes, captions, tables, list items and paragraphs; those inside a quote or a table are part of it. A
    page without paragraphs and of under 300 characters is a display page: its headings are titles.
    """
    all_ = events(pages, key, html)
    found = inside(elements(all_, key), key, F.col("name").isin("blockquote", "table"), "taken")
    name = F.col("name")
    found = found.filter((name.isin("p", "li") & (F.col("taken") == 0)) | name.rlike("^h[1-6]$") | name.isin("blockquote", "figcaption", "table"))
    rows = with_texts(found, all_, key).filter("text <> ''")
    note = F.col("tag").rlike(r"""(?i)(epub:type|class)\s*=\s*["'][^"']*(note|endnote|rearnote)""")
    kind = F.when(name == "h1", F.when(F.col("text").rlike(r"(?i)^(part|book)\b"), "title").otherwise("chapter")).when(name == "h2", "heading").when(name.rlike("^h[3-6]$"), "subheading")
    kind = kind.when(name == "blockquote", "quote").when(name == "figcaption", "caption").when(name == "table", "table").when(name == "li", "list").when(note, "footnote").otherwise("body")
    rows = rows.withColumn("kind", kind)
    page = Window.partitionBy(key)
    display = (F.sum(F.when(F.col("kind") == "body", 1).otherwise(0)).over(page) == 0) & (F.sum(F.length("text")).over(page) < 300)
    rows = rows.withColumn("category", F.when(display & F.col("kind").isin("chapter", "heading", "subheading"), "title").otherwise(F.col("kind")))
    return rows.select(key, F.row_number().over(page.orderBy("begin")).alias("place"), "category", "text")


def article(pages: DataFrame, key: str, html: str, dropped: Column | None = None) -> DataFrame:
    """(key, place, text): the paragraphs of each page that are read, each a block without blocks inside.

    Navigation, asides, pictures and promotions are passed over, and what `dropped`, a Column over `name` and `tag`, marks.
    """
    all_ = events(pages, key, html)
    skip = F.col("name").isin(*PASSED) | F.col("tag").rlike(PROMOTED)
    skip = skip | F.coalesce(dropped, F.lit(False)) if dropped is not None else skip
    found = inside(elements(all_, key).withColumn("skip", skip), key, F.col("skip"), "passed")
    leaf = F.col("name").isin(*READ) & (F.col("blocks") == 0) & ~F.col("skip") & (F.col("passed") == 0)
    rows = with_texts(found.filter(leaf), all_, key).filter("text <> ''")
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("begin")).alias("place"), "text")
