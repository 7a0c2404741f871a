"""Line repairs, edit lists and normal forms, as Column expressions."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: fixed values, in the order in which they are replaced: abbreviations that lose their full stops
ABBREVIATIONS = (
    "U.S. U.K. U.N. E.U. U.S.A. U.S.S.R. Dr. Mr. Mrs. Ms. Prof. Jr. Sr. Rev. Gen. Col. Lt. Sgt. Capt. Gov. Sen. Rep. "
    "Inc. Ltd. Corp. Co. Bros. LLC. vs. etc. e.g. i.e. a.m. p.m. A.M. P.M. no. No. vol. Vol. pp. pg. St. Ave. Blvd. Rd. Mt. Ft. "
    "approx. dept. Dept. est. Est."
).split()
EDGE_MARKS = ".,;:!?\"'()[]"


def bare_edges(c: Column) -> Column:
    """Without the punctuation at both ends."""
    return F.btrim(c, F.lit(EDGE_MARKS))


def undo_space_loss(ocr: Column, truth: Column) -> Column:
    """The line with more spaces, where the two differ in white space only; else the truth."""
    close = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return F.when((close(ocr) == close(truth)) & (F.length(truth) < F.length(ocr)), ocr).otherwise(truth)


def lie(ocr: Column, truth: Column) -> Column:
    """Why a difference teaches nothing: only case, only typography; null if it does."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return F.when(ocr == truth, F.lit(None).cast("string")).when(F.lower(ocr) == F.lower(truth), "case").when(plain(ocr) == plain(truth), "typography")


def joined_line(a: Column, b: Column) -> Column:
    """Two lines made one: a wrap hyphen closes the gap and stays, anything else is one space."""
    wrap = a.rlike("[a-z]-$") & b.rlike("^[a-z]")
    return F.when(wrap, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))


def without_edge_bar(c: Column) -> Column:
    """Without a trailing pipe, unless that is all there is."""
    cut = F.rtrim(F.regexp_replace(c, r"[ ]*\|[ ]*$", ""))
    return F.when(F.trim(cut) != "", cut).otherwise(c)


def without_stops(c: Column) -> Column:
    """Common abbreviations without their full stops, so that these end no sentence."""
    for name in ABBREVIATIONS:
        c = F.replace(c, F.lit(name), F.lit(name.replace(".", "")))
    return c


def letter_inside(c: Column) -> Column:
    """Whether an exclamation mark stands between two letters: a ligature that was read wrongly."""
    return c.rlike(r"\p{L}!\p{L}")


#: fixed values: marks that may end and begin a word, and hyphens
TRAILING, LEADING, HYPHENS = ".,!?;:'\"“”‘’)]}…", "'\"“”‘’([{—–", "-‐‑‒–—"


def spaced(c: Column) -> Column:
    """The words of a text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def with_last(words: Column, last: Column) -> Column:
    return F.concat(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.array(last))


def with_first(words: Column, first: Column) -> Column:
    return F.concat(F.array(first), F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1)))


def edge_marks_restored(ocr: Column, truth: Column) -> Column:
    """truth whose first and last word get back marks that only ocr has there, if the words are as long and close."""
    o, t = spaced(ocr), spaced(truth)
    o1, t1, o9, t9 = F.get(o, F.lit(0)), F.get(t, F.lit(0)), F.try_element_at(o, F.lit(-1)), F.try_element_at(t, F.lit(-1))
    close = lambda a, b: (F.length(a) == F.length(b)) & (F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(F.length(b) / 4)))
    ob, tb = F.rtrim(o9, F.lit(TRAILING)), F.rtrim(t9, F.lit(TRAILING))
    more = (F.length(o9) - F.length(ob) > F.length(t9) - F.length(tb)) & close(ob, tb)
    ends = F.when(more, with_last(t, F.concat(tb, F.substr(o9, F.length(ob) + 1)))).otherwise(t)
    oc, tc = F.ltrim(o1, F.lit(LEADING)), F.ltrim(F.get(ends, F.lit(0)), F.lit(LEADING))
    fewer = F.length(F.get(ends, F.lit(0))) - F.length(tc)
    front = (F.length(o1) - F.length(oc) > fewer) & close(oc, tc)
    both = F.when(front, with_first(ends, F.concat(F.left(o1, F.length(o1) - F.length(oc)), tc))).otherwise(ends)
    return F.when((F.size(o) == 0) | (F.size(t) == 0) | ~(more | front), truth).otherwise(F.array_join(both, " "))


def edges_clamped(ocr: Column, truth: Column) -> Column:
    """truth whose last and first word are ocr's where truth only goes on after them, or began before."""
    o, t = spaced(ocr), spaced(truth)
    o1, t1, o9, t9 = F.get(o, F.lit(0)), F.get(t, F.lit(0)), F.try_element_at(o, F.lit(-1)), F.try_element_at(t, F.lit(-1))
    longer = (F.length(t9) > F.length(o9)) & F.startswith(F.lower(t9), F.lower(o9))
    ends = F.when(longer, with_last(t, o9)).otherwise(t)
    first = F.get(ends, F.lit(0))
    earlier = (F.length(first) > F.length(o1)) & F.endswith(F.lower(first), F.lower(o1))
    both = F.when(earlier, with_first(ends, o1)).otherwise(ends)
    return F.when((F.size(o) == 0) | (F.size(t) == 0) | ~(longer | earlier), truth).otherwise(F.array_join(both, " "))


def hyphen_repaired(ocr: Column, truth: Column, ends: bool) -> Column:
    """truth with ocr's part of a word that a line break cut, if the whole word holds it at that end; null without evidence.

    ends: the line ends in the first part of the word; otherwise it begins with the second.
    """
    o, t = spaced(ocr), spaced(truth)
    edge = F.try_element_at(o, F.lit(-1)) if ends else F.get(o, F.lit(0))
    part = F.rtrim(edge, F.lit(HYPHENS)) if ends else edge
    word = F.try_element_at(t, F.lit(-1)) if ends else F.get(t, F.lit(0))
    shown = (F.startswith if ends else F.endswith)(F.lower(word), F.lower(part)) & (part != "")
    fixed = F.array_join(with_last(t, edge) if ends else with_first(t, edge), " ")
    return F.when((F.size(o) > 0) & (F.size(t) > 0) & (F.length(word) > F.length(part)) & shown, fixed)


def glyph_damaged(ocr: Column, truth: Column) -> Column:
    """Whether truth has a sign between two letters that ocr never has."""
    signs = F.regexp_extract_all(truth, F.lit(r"(?<=\p{L})([^\p{L}\p{N}_\s'’\-‐])(?=\p{L})"), F.lit(1))
    return F.exists(signs, lambda x: ~F.contains(ocr, x))


def separators(line: Column, following: Column) -> Column:
    """What joins two lines: the newline stays where a wrap hyphen cut a word, else one space."""
    return F.when(line.rlike(r"\p{L}[-‐]\s*$") & following.rlike(r"^\s*\p{Ll}"), "\n").otherwise(" ")


def humanized(c: Column) -> Column:
    """CamelCase as words."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[_#]+", " "))


def compared(c: Column) -> Column:
    """Lower case; letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


#: windows times 64-character stretches of their quotes that are looked at together
LANES = 1 << 16


def window_likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """The best likeness of each quote to as many neighbouring words of its text, two more or two less; 0 if there are none.

    A window's distances are those of its begin: one walk over the longest window from a word gives them for all sizes.
    Columns of the distance table are kept as bits, 64 rows a number, and all windows take a step together.
    """
    best, waiting, lanes = [0.0] * len(pairs), {}, {}
    for i, (quote, text) in enumerate(pairs):
        size = (len(quote) + 63) // 64
        waiting.setdefault(size, []).append(i)
        lanes[size] = lanes.get(size, 0) + size * (text.count(" ") + 1)
        if lanes[size] >= LANES:
            _likeness_together(waiting.pop(size), size, pairs, best)
            lanes[size] = 0
    for size, rows in waiting.items():
        _likeness_together(rows, size, pairs, best)
    return best


def _likeness_together(rows: list[int], size: int, pairs: list[tuple[str, str]], best: list[float]) -> None:
    """best of the rows, whose quotes all take `size` numbers of 64 bits."""
    points = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    quotes = [points(pairs[i][0]) for i in rows]
    letters = np.unique(np.concatenate(quotes))
    text = points("".join(pairs[i][1] for i in rows))
    at = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
    text = np.where(letters[at] == text, at, len(letters))
    equal = np.zeros((len(rows), len(letters) + 1, size), np.uint64)  # where a quote has a letter; the last letter is none of them
    for r, quote in enumerate(quotes):
        k = np.arange(len(quote))
        np.bitwise_or.at(equal, (r, np.searchsorted(letters, quote), k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
    owner, begin, longest, marks, base = [], [], [], [], 0
    for r, i in enumerate(rows):
        quote, whole = pairs[i]
        lengths = np.array([len(w) for w in whole.split(" ")])
        n, m = quote.count(" ") + 1, len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        sizes = np.arange(max(1, n - 2), min(n + 2, m) + 1)
        if len(sizes):
            firsts = np.arange(m - sizes[0] + 1)
            last = firsts[:, None] + sizes[None, :] - 1
            reach = np.where(last < m, ends[np.minimum(last, m - 1)] - starts[firsts][:, None], 0)
            owner.append(np.full(len(firsts), r))
            begin.append(base + starts[firsts])
            longest.append(reach.max(1))
            marks.append(np.pad(reach, ((0, 0), (0, 5 - len(sizes)))))
        base += len(whole)
    if not owner:
        return
    owner, begin, longest, marks = (np.concatenate(x) for x in (owner, begin, longest, marks))
    order = np.argsort(-longest, kind="stable")
    owner, begin, longest, marks = owner[order], begin[order], longest[order], marks[order]
    height = np.array([len(q) for q in quotes])
    found, score = np.zeros(len(rows)), height[owner]
    lane, _ = np.nonzero(marks)
    column = marks[marks > 0]
    by_column = np.argsort(column, kind="stable")
    lane, column = lane[by_column], column[by_column]
    cuts = np.searchsorted(column, np.arange(longest.max() + 2))
    going = np.searchsorted(-longest, -np.arange(longest.max() + 1), side="left")  # lanes longer than j
    one, top = np.uint64(1), ((height - 1) % 64).astype(np.uint64)[owner]
    up = [np.full(len(owner), ~np.uint64(0)) for _ in range(size)]
    down = [np.zeros(len(owner), np.uint64) for _ in range(size)]
    for j in range(longest.max()):
        n = going[j]
        letter, own = text[begin[:n] + j], owner[:n]
        plus, minus = one, np.uint64(0)
        for k in range(size):
            pv, mv = up[k][:n], down[k][:n]
            eq = equal[own, letter, k]
            xv = eq | mv
            eq = eq | minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            edge = top[:n] if k == size - 1 else np.uint64(63)
            more, less = (ph >> edge) & one, (mh >> edge) & one
            ph, mh = (ph << one) | plus, (mh << one) | minus
            up[k][:n], down[k][:n] = mh | ~(xv | ph), ph & xv
            plus, minus = more, less
        score[:n] += plus.astype(np.int64) - minus.astype(np.int64)
        here = lane[cuts[j + 1] : cuts[j + 2]]
        if len(here):
            np.maximum.at(found, owner[here], 1 - score[here] / np.maximum(height[owner[here]], j + 1))
    for r, i in enumerate(rows):
        best[i] = float(found[r])


def best_words(quote: Column, text: Column) -> Column:
    """window_likeness of a quote and a text; 0 for a null side."""

    @F.arrow_udf("double")
    def find(quotes: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [i for i in range(len(quotes)) if quotes[i].is_valid and texts[i].is_valid]
        out = np.zeros(len(quotes))
        out[rows] = window_likeness([(quotes[i].as_py(), texts[i].as_py()) for i in rows])
        return pa.array(out)

    return find(quote, text)


def quote_score(quote: Column, text: Column) -> Column:
    """1 if the text holds the quote, 0.96 and 0.92 if it holds its first 50 or 25 characters, else the best window of words."""
    q, t = compared(quote), compared(text)
    held = lambda width: (F.length(F.left(q, F.lit(width))) >= 15) & F.contains(t, F.left(q, F.lit(width)))
    short = (F.length(q) < 3) | (F.length(t) < 3)
    told = F.when(short, 0.0).when(F.contains(t, q), 1.0).when(held(50), 0.96).when(held(25), 0.92)
    # a Python function runs for every row: what is told already gives it nothing to look for
    return F.coalesce(told, best_words(F.when(told.isNull(), q), t))


#: fixed values: words that tell nothing about a quote, the score from which it is one, the likeness of two words that
#: are one, and the share of its telling words that must be in the text otherwise
COMMON_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as",
    "and", "but", "or", "not", "that", "this", "these", "those", "what", "which", "who", "i", "you", "he", "she", "it", "we", "they",
    "my", "your", "his", "our", "their", "about", "because", "can", "could", "would", "should", "have", "has", "had", "do", "does",
    "did", "will",
)
QUOTED, SAME_WORD, TELLING_SHARE = 0.65, 0.75, 0.4


def is_quoted(quote: Column, text: Column) -> Column:
    """Whether the text holds the quote, closely as a whole or by enough of its telling words; null for a null side.

    A telling word has over three characters and is not common; the text has it as it is or in a word of over three
    characters that is alike. Without telling words only the whole counts.
    """
    q, t = compared(quote), compared(text)
    telling = F.filter(F.split(q, " "), lambda w: (F.length(w) > 3) & ~w.isin(*COMMON_WORDS))
    words = F.array_distinct(F.split(t, " "))
    alike = lambda w, x: 1 - F.levenshtein(w, x) / F.greatest(F.length(w), F.length(x)) > SAME_WORD
    held = F.filter(telling, lambda w: F.array_contains(words, w) | F.exists(words, lambda x: (F.length(x) > 3) & alike(w, x)))
    enough = (F.size(telling) > 0) & (F.size(held) > TELLING_SHARE * F.size(telling))
    short = (F.length(q) < 3) | (F.length(t) < 3)
    return F.when(quote.isNotNull() & text.isNotNull(), F.when(short, False).otherwise((quote_score(quote, text) >= QUOTED) | enough))


#: fixed value: so many consonants in a row make no English word
CONSONANTS = "[bcdfghjklmnpqrstvwxz]{4}"


def vowel_share(words: Column) -> Column:
    """Share of words of three letters or more whose shape is pronounceable: a vowel, and no long run of consonants; 0 for none."""
    long = F.filter(words, lambda w: F.length(w) >= 3)
    fine = F.filter(long, lambda w: w.rlike("[aeiouy]") & ~w.rlike(CONSONANTS))
    return F.when(F.size(long) == 0, 0.0).otherwise(F.size(fine) / F.size(long))


def edit_lines(pairs: Column) -> Column:
    """before → after, one edit a line; none for no edits."""
    lines = F.transform(pairs, lambda p: F.concat(p["before"], F.lit(" → "), p["after"]))
    return F.when(F.size(pairs) == 0, "none").otherwise(F.array_join(lines, "\n"))


def parsed_edits(c: Column) -> Column:
    """The pairs that edit_lines wrote; lines of another shape are left out."""
    parts = F.filter(F.transform(F.split(c, "\n"), lambda x: F.split(x, " → ")), lambda p: F.size(p) == 2)
    return F.transform(parts, lambda p: F.struct(p[0].alias("before"), p[1].alias("after")))


def answers(c: Column) -> Column:
    """(n, paragraph) of a text marked <<<n>>>; of a repeated n the last counts."""
    parts = F.slice(F.split(c, "<<<"), F.lit(2), F.size(F.split(c, "<<<")))
    pairs = F.filter(F.transform(parts, lambda p: F.split(p, ">>>", 2)), lambda p: (F.size(p) == 2) & p[0].rlike("^[0-9]+$"))
    both = F.transform(pairs, lambda p, i: F.struct(p[0].cast("int").alias("n"), F.trim(p[1]).alias("paragraph"), i.alias("at")))
    last = F.filter(both, lambda x: ~F.exists(both, lambda y: (y["n"] == x["n"]) & (y["at"] > x["at"])))
    return F.array_sort(F.transform(last, lambda x: F.struct(x["n"].alias("n"), x["paragraph"].alias("paragraph"))))


def toc_entry(line: Column) -> Column:
    """(title, page) of a line of a table of contents: after leaders, after a wide gap, or at the end; page null if there is none."""
    line = F.trim(line)
    shapes = [r"^(.+?)\s*[.\u2026\u2014\u2013\-\t]{2,}\s*(\d+)\s*$", r"^(.+?)\s{3,}(\d+)\s*$", r"^(.{4,}?)\s+(\d+)\s*$"]
    out = F.struct(line.alias("title"), F.lit(None).cast("int").alias("page"))
    for shape in reversed(shapes):
        found = F.struct(F.trim(F.regexp_extract(line, shape, 1)).alias("title"), F.regexp_extract(line, shape, 2).cast("int").alias("page"))
        out = F.when(line.rlike(shape), found).otherwise(out)
    return F.when(F.length(line) >= 2, out)
