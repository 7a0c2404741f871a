"""Footnote markers, block groups, boxes, signals, cues, and texts aligned by line, word or character.

The test tables hold no footnotes, so queries number the ends of sentences and paragraphs first, some of them wrongly.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import alignment as A
from textloom.operators import markers as M

from .joining import _BOXES, boxes
from .registry import Tables, query

#: margins tried in turn around a box, and how near the centre must be beyond them
MARGINS, CENTRE = (0, 5, 10, 20, 30), 50


def numbered(t: Tables):
    """Texts whose sentences end in rising numbers, every thirteenth a wrong one."""
    parts = F.split("text", r"\. ")
    number = lambda i: F.when(i % 13 == 6, i * 7 % 900 + 100).otherwise(i % 999 + 1).cast("string")
    ended = F.transform("parts", lambda s, i: F.when(i == F.size("parts") - 1, s).otherwise(F.concat(s, F.lit("."), number(i), F.lit(" "))))
    return t.documents.filter("text is not null").select("doc_id", parts.alias("parts")).select("doc_id", F.array_join(ended, "").alias("text"))


NUMBERED = r"""p AS (SELECT doc_id, string_split(text, '. ') AS parts FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, array_to_string(list_transform(parts, lambda s, i: CASE WHEN i = len(parts) THEN s
ELSE s || '.' || CAST(CASE WHEN (i - 1) % 13 = 6 THEN (i - 1) * 7 % 900 + 100 ELSE (i - 1) % 999 + 1 END AS VARCHAR) || ' ' END), '') AS text FROM p)"""


@query(rf"""WITH {NUMBERED} SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '([\t\n\f\r ])', '\1\1', 'g'),
'[^0-9][.!?”’"''](?:  )?[0-9]{{1,3}}(?:[\t\n\f\r ]|$)')) AS n FROM n""")
def footnote_candidates(t: Tables):
    """Numbers after the ends of sentences in each text."""
    return numbered(t).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(M.CANDIDATE), F.lit(0))).cast("long").alias("n"))


@query()
def footnote_selection(t: Tables):
    """What goes of each text's candidates: the members of the longest rising chain, where that can be footnotes."""
    found = numbered(t).withColumn("s", M.selected(F.col("text"))).select("doc_id", "text", "s.values", "s.chain")
    sound = M.trusted(F.col("values"), F.col("chain"))
    left = F.when(sound, M.without_chain(F.col("text"), F.col("chain"))).otherwise(F.col("text"))
    n = F.when(sound, F.size("chain")).otherwise(0)
    return found.select("doc_id", sound.alias("applied"), n.alias("n_gone"), (F.size("values") - n).alias("n_spared"), F.sha2(left, 256).alias("text_sha256"))


@query()
def unique_markers(t: Tables):
    """Superscript markers of each page by where their context stands in its text; pages of even id hold it twice."""
    parts = F.split("html", "</p>")
    marked = F.array_join(F.transform(parts, lambda s, i: F.when(i == F.size(parts) - 1, s).otherwise(F.concat(s, F.lit("<sup>"), i + 1, F.lit("</sup></p>")))), "")
    bare = F.regexp_replace(F.regexp_replace("markup", "<[^>]+>", " "), "&nbsp;", " ")
    rows = t.pages.select("page_id", marked.alias("markup"))
    rows = rows.select("page_id", M.markers_of(F.col("markup")).alias("m"), F.when(F.col("page_id") % 2 == 0, F.concat(bare, F.lit(" "), bare)).otherwise(bare).alias("text"))
    rows = rows.select("page_id", M.placed(F.col("m"), F.col("text")).alias("at"))
    count = lambda f: F.size(F.filter("at", f)).alias
    return rows.select("page_id", F.size("at").alias("n"), count(lambda x: x == 1)("n_unique"), count(lambda x: x > 1)("n_ambiguous"), count(lambda x: x == 0)("n_lost"))


@query()
def block_groups(t: Tables):
    """Runs of blocks between headings, up to a number of blocks and characters, and whether each is long enough to send."""
    block = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</\1>"
    part = lambda k: F.regexp_extract_all("html", F.lit(block), F.lit(k))
    lengths = F.transform(part(2), lambda x: F.length(F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))))
    rows = t.pages.select("page_id", part(1).alias("tags"), lengths.alias("lengths"))
    rows = rows.select("page_id", F.explode(F.arrays_zip("lengths", M.block_groups(F.col("tags"), F.col("lengths")).alias("groups"))).alias("b"))
    rows = rows.select("page_id", F.col("b.lengths").alias("length"), F.col("b.groups").alias("group_no")).filter("group_no >= 0")
    out = rows.groupBy("page_id", "group_no").agg(F.count("*").alias("n_blocks"), F.sum("length").alias("chars"))
    return out.withColumn("sent", F.col("chars") >= M.LEAST_SENT)


@query(f"""WITH b AS ({_BOXES}), d AS (SELECT a.id AS box, b.id AS span,
greatest(b.x1 * 8 - a.x1 * 8 - (a.x2 - a.x1), a.x1 * 8 - b.x1 * 8 - (b.x2 - b.x1), b.y1 * 8 - a.y1 * 8 - (a.y2 - a.y1), a.y1 * 8 - b.y1 * 8 - (b.y2 - b.y1), 0) AS gap,
sqrt(power(CAST(a.x1 * 8 + (a.x2 - a.x1) / 2 - b.x1 * 8 - (b.x2 - b.x1) / 2 AS DOUBLE), 2) + power(CAST(a.y1 * 8 + (a.y2 - a.y1) / 2.0 - b.y1 * 8 - (b.y2 - b.y1) / 2.0 AS DOUBLE), 2)) AS far
FROM b a JOIN b b ON a.page = b.page AND a.side = 'A' AND b.side = 'R'),
m AS (SELECT *, min(gap) OVER (PARTITION BY box) AS least_gap, row_number() OVER (PARTITION BY box ORDER BY far, span) AS place FROM d),
k AS (SELECT *, CASE WHEN least_gap <= 0 THEN 0 WHEN least_gap <= 5 THEN 5 WHEN least_gap <= 10 THEN 10 WHEN least_gap <= 20 THEN 20 WHEN least_gap <= 30 THEN 30 ELSE -1 END AS margin FROM m)
SELECT box, span, margin FROM k WHERE gap <= margin OR margin = -1 AND place = 1 AND far < {CENTRE}""")
def nearest_boxes(t: Tables):
    """Boxes that each box meets at the least margin that meets any; beyond all margins the one of the nearest centre."""
    c = F.col
    scaled = boxes(t).select("page", "id", "side", (c("x1") * 8).alias("x"), (c("y1") * 8).alias("y"), (c("x2") - c("x1")).cast("double").alias("w"), (c("y2") - c("y1")).cast("double").alias("h"))
    side = lambda s, p: scaled.filter(c("side") == s).select("page", *[c(k).alias(p + k) for k in ("id", "x", "y", "w", "h")])
    pairs = side("A", "a_").join(side("R", "b_"), "page")
    gap = F.greatest(c("b_x") - c("a_x") - c("a_w"), c("a_x") - c("b_x") - c("b_w"), c("b_y") - c("a_y") - c("a_h"), c("a_y") - c("b_y") - c("b_h"), F.lit(0.0))
    off = lambda k, size: c(f"a_{k}") + c(f"a_{size}") / 2 - c(f"b_{k}") - c(f"b_{size}") / 2
    pairs = pairs.select(c("a_id").alias("box"), c("b_id").alias("span"), gap.alias("gap"), F.sqrt(F.pow(off("x", "w"), 2) + F.pow(off("y", "h"), 2)).alias("far"))
    own = Window.partitionBy("box")
    least = F.min("gap").over(own)
    margin = F.coalesce(*[F.when(c("least") <= m, m) for m in MARGINS], F.lit(-1))
    pairs = pairs.withColumn("least", least).withColumn("place", F.row_number().over(own.orderBy("far", "span"))).withColumn("margin", margin)
    return pairs.filter((c("gap") <= c("margin")) | (c("margin") == -1) & (c("place") == 1) & (c("far") < CENTRE)).select("box", "span", "margin")


@query("""WITH f AS (SELECT user_id, ts, event_id, 20 * log10(greatest(abs(value), 1e-12)) AS db FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, quantile_cont(db, 0.05) AS quiet FROM f GROUP BY user_id),
v AS (SELECT user_id, max((ts, event_id)) AS last FROM f JOIN g USING (user_id) WHERE db > quiet + 12 GROUP BY user_id)
SELECT f.user_id, count(*) AS frames, CASE WHEN count(*) < 3 THEN 0.0 ELSE round(count(*) FILTER (WHERE (ts, event_id) > last) * 0.01, 2) END AS tail
FROM f LEFT JOIN v USING (user_id) GROUP BY f.user_id""")
def tail_silence(t: Tables):
    """Seconds after the last frame 12 dB above the user's own noise floor, frames of 10 ms: aggregates, no ordered windows."""
    frames = t.events.filter("value is not null").select("user_id", F.struct("ts", "event_id").alias("at"), (20 * F.log10(F.greatest(F.abs("value"), F.lit(1e-12)))).alias("db"))
    quiet = frames.groupBy("user_id").agg(F.percentile("db", F.lit(0.05)).alias("quiet"))
    last = frames.join(quiet, "user_id").filter(F.col("db") > F.col("quiet") + 12).groupBy("user_id").agg(F.max("at").alias("last"))
    out = frames.join(last, "user_id", "left").groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.col("at") > F.col("last")).alias("after"))
    return out.select("user_id", "frames", F.when(F.col("frames") < 3, 0.0).otherwise(F.round(F.col("after") * 0.01, 2)).alias("tail"))


@query("""WITH s AS (SELECT user_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n,
round(sqrt(avg(value * value) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), 6) AS rms FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT user_id, pos // 2 AS k, rms FROM s WHERE pos % 2 = 0 AND pos + 4 <= n),
g AS (SELECT user_id, min(rms) AS low, arg_min(k, (rms, k)) AS place, quantile_cont(rms, 0.9) AS loud, max(k) AS last_k FROM f GROUP BY user_id),
b AS (SELECT user_id, max(k) FILTER (WHERE k < place AND rms > low * 1.5 + 1) AS lo, min(k) FILTER (WHERE k > place AND rms > low * 1.5 + 1) AS hi FROM f JOIN g USING (user_id) GROUP BY user_id)
SELECT user_id, (coalesce(lo + 1, 0) + coalesce(hi - 1, last_k)) // 2 * 2 + 2 AS middle, low AS trough, round(20 * log10((loud + 1) / (low + 1)), 6) AS drop_db FROM g JOIN b USING (user_id)""")
def frame_trough(t: Tables):
    """The middle of the quiet stretch around each user's least frame, of 4 values in steps of 2, and how far it lies below."""
    c, own = F.col, Window.partitionBy("user_id").orderBy("ts", "event_id")
    rms = F.round(F.sqrt(F.avg(c("value") * c("value")).over(own.rowsBetween(0, 3))), 6)
    frames = t.events.filter("value is not null").select("user_id", (F.row_number().over(own) - 1).alias("at"), F.count("*").over(Window.partitionBy("user_id")).alias("n"), rms.alias("rms"))
    frames = frames.filter((c("at") % 2 == 0) & (c("at") + 4 <= c("n"))).select("user_id", F.floor(c("at") / 2).alias("k"), "rms")
    least = frames.groupBy("user_id").agg(F.min(F.struct("rms", "k")).alias("m"), F.percentile("rms", F.lit(0.9)).alias("loud"), F.max("k").alias("last_k"))
    both, over = frames.join(least, "user_id"), c("rms") > c("m.rms") * 1.5 + 1
    ends = both.groupBy("user_id").agg(
        F.max(F.when(over & (c("k") < c("m.k")), c("k"))).alias("lo"), F.min(F.when(over & (c("k") > c("m.k")), c("k"))).alias("hi"),
        F.first("m").alias("m"), F.first("loud").alias("loud"), F.first("last_k").alias("last_k"),
    )
    middle = F.floor((F.coalesce(c("lo") + 1, F.lit(0)) + F.coalesce(c("hi") - 1, c("last_k"))) / 2) * 2 + 2
    return ends.select("user_id", middle.alias("middle"), c("m.rms").alias("trough"), F.round(20 * F.log10((c("loud") + 1) / (c("m.rms") + 1)), 6).alias("drop_db"))


@query(r"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS old FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, old[1 : len(old) // 2] || ['A new line.', 'And another.'] || old[len(old) // 2 + 2 :] AS new FROM a),
k AS (SELECT *, list_transform(old, lambda x: lower(regexp_replace(x, '[ \t\r]+', ' ', 'g'))) AS x, list_transform(new, lambda x: lower(regexp_replace(x, '[ \t\r]+', ' ', 'g'))) AS y, least(len(old), len(new)) AS n FROM b),
p AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, n + 1), lambda i: x[i] = y[i]), false), 0) - 1, n) AS before FROM k),
s AS (SELECT *, coalesce(nullif(list_position(list_transform(range(0, n - before), lambda i: x[len(x) - i] = y[len(y) - i]), false), 0) - 1, n - before) AS after FROM p)
SELECT doc_id, before AS n_before, after AS n_after, md5(array_to_string(old[before + 1 : len(old) - after], chr(10))) AS removed, md5(array_to_string(new[before + 1 : len(new) - after], chr(10))) AS added FROM s""")
def line_diff(t: Tables):
    """Lines that two texts share at either end, but for case and spacing, and what each has between; the middle line is changed."""
    old, half = F.split("text", "\n"), F.floor(F.size("old") / 2).cast("int")
    new = F.concat(F.slice("old", 1, half), F.array(F.lit("A new line."), F.lit("And another.")), F.slice("old", half + 2, F.size("old")))
    rows = t.documents.filter("text is not null").select("doc_id", old.alias("old")).withColumn("new", new)
    key = lambda c: F.transform(c, lambda x: F.lower(F.regexp_replace(x, "[ \t\r]+", " ")))
    rows = rows.select("*", key("old").alias("x"), key("new").alias("y")).withColumn("n_before", A.prefix_length(F.col("x"), F.col("y")))
    rest = lambda c: F.reverse(F.slice(c, F.col("n_before") + 1, F.size(c)))
    rows = rows.withColumn("n_after", A.prefix_length(rest("x"), rest("y")))
    between = lambda c: F.md5(F.array_join(F.slice(c, F.col("n_before") + 1, F.size(c) - F.col("n_before") - F.col("n_after")), "\n"))
    return rows.select("doc_id", F.col("n_before").cast("long").alias("n_before"), F.col("n_after").cast("long").alias("n_after"), between("old").alias("removed"), between("new").alias("added"))


@query()
def aligned_pairs(t: Tables):
    """Pairs of a damaged and a true turn, aligned by character; z stands where nothing is known."""
    pairs = A.by_row("array<struct<read string, gold string>>", A.aligned_pairs)
    found = pairs(F.translate("text", "eq", "c@"), F.translate("text", "xz", "@#"))
    return t.conversations.select("conv_id", "turn", F.posexplode(found).alias("at", "p")).select("conv_id", "turn", "at", "p.read", "p.gold")


@query()
def diagonal_matches(t: Tables):
    """Words of each turn that a damaged copy without every sixth word still holds near their places."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    damaged = F.transform(F.filter("words", lambda x, i: i % 6 != 5), lambda x: F.translate(x, "e", "c"))
    pairs = A.by_row("array<struct<a int, b int>>", lambda a, b: A.diagonal_pairs(list(a), list(b)))
    rows = t.conversations.select("conv_id", "turn", words.alias("words"))
    return rows.select("conv_id", "turn", F.size("words").alias("n_words"), pairs(F.col("words"), damaged).alias("p")).select("conv_id", "turn", "n_words", F.size("p").alias("n_pairs"), F.md5(F.to_json("p")).alias("digest"))


@query()
def sentence_cues(t: Tables):
    """Cues of the words of each turn: until a sentence or the most characters end; a word takes 0.4 seconds."""
    number = A.by_row("array<int>", lambda a: A.cue_numbers(list(a)))
    rows = t.conversations.filter("text is not null").select("conv_id", "turn", F.split(F.trim("text"), r"\s+").alias("words"))
    rows = rows.select("conv_id", "turn", F.posexplode(F.arrays_zip("words", number(F.col("words")).alias("cues"))).alias("at", "w"))
    out = rows.groupBy("conv_id", "turn", F.col("w.cues").alias("cue")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.array_sort(F.collect_list(F.struct("at", "w.words"))).alias("words"))
    return out.select("conv_id", "turn", "cue", F.round(F.col("lo") * 0.4, 1).alias("start"), F.round((F.col("hi") + 1) * 0.4, 1).alias("stop"), F.array_join("words.words", " ").alias("text"))


@query()
def edge_tokens_restored(t: Tables):
    """Turns cut by one word before and two behind, given back what the whole turn proves."""
    words = F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")
    cut = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 3, F.lit(0))), " ")
    rows = t.conversations.select("conv_id", "turn", F.array_join(words, " ").alias("read"), cut.alias("truth"))
    restored = A.by_row("string", A.edges_restored)(F.col("read"), F.col("truth"))
    return rows.select("conv_id", "turn", "read", restored.alias("restored")).select("conv_id", "turn", (F.col("read") == F.col("restored")).alias("whole"), F.md5("restored").alias("digest"))


@query()
def voiced_segments(t: Tables):
    """Each user's ten-minute runs of a day, 144 at most, packed to segments of 60 to 400 minutes."""
    minute = F.hour("ts") * 60 + F.floor(F.minute("ts") / 10) * 10
    days = t.events.select("user_id", F.to_date("ts").alias("day"), minute.cast("int").alias("lo")).groupBy("user_id", "day").agg(F.sort_array(F.collect_set("lo")).alias("lo"))
    packed = A.by_row("array<struct<lo int, hi int>>", lambda a: A.packed_runs([(int(x), int(x) + 10) for x in a], 60, 400))
    return days.select("user_id", "day", F.explode(packed(F.col("lo"))).alias("s")).select("user_id", "day", "s.lo", "s.hi")
