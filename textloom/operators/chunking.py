"""Sentences, chunks and embedded JSON: cutting texts at the best places, in Arrow-fed functions over single texts."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: fixed values: abbreviations that end in a full stop and end no sentence
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof st rev hon sr jr vs etc ca cf ed eds vol no pp op cit ibid al inc ltd co jan feb mar apr jun jul aug sep sept oct nov dec hrsg bd vgl bzw nr".split()
)
#: fixed value: a stop, closing marks, and a reference of up to three digits
STOP = r"[.!?…](?:['\"’”»)\]]*)(?:[0-9]{1,3}|[¹²³⁰⁴-⁹]{1,3})?"
AT_END, INSIDE = re.compile(STOP + "$"), re.compile(STOP + r"(?=\s)")
WRAP_HYPHENS = "-‐‑\u00ad"
#: fixed values: a shorter last piece joins the one before; characters searched back for a break, and for a chapter
SHORT_PIECE, BREAK_WINDOW, CHAPTER_WINDOW = 25, 1000, 500


def ends_sentence(text: str) -> bool:
    """Whether a text ends a sentence: not after an abbreviation, a lone initial or inside a decimal number."""
    text = text.rstrip()
    stop = AT_END.search(text)
    if stop is None:
        return False
    head, tail = text[: stop.start()], stop[0]
    if tail[-1] not in ".!?…" and (tail[-1].isdigit() or tail[-1] in "¹²³") and head[-1:].isascii() and head[-1:].isdigit():
        return False
    word = re.search(r"[A-Za-zÀ-ɏ]+$", head) if tail[0] == "." else None
    return word is None or (len(word[0]) > 1 and word[0].lower() not in ABBREVIATIONS)


def sentences(text: str) -> list[str]:
    """The sentences of a paragraph, trimmed, blank ones left out."""
    cuts = [0]
    for stop in INSIDE.finditer(text):
        if ends_sentence(text[cuts[-1] : stop.end()]):
            cuts.append(stop.end())
    pieces = (text[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True))
    return [p for p in pieces if p]


def joined_lines(lines: Iterable[str]) -> str:
    """Lines as one text: a wrap hyphen stays and closes the gap, any other break is a space."""
    out = ""
    for line in lines:
        line = line.strip()
        out += line if not out or not line or out[-1] in WRAP_HYPHENS else " " + line
    return out


def line_units(lines: list[str], cap: int) -> list[tuple[int, int]]:
    """(first, end) runs of lines of up to cap characters, cut at the last sentence end that fits, never after a wrap hyphen."""
    whole = [not line.rstrip()[-1:] or line.rstrip()[-1] not in WRAP_HYPHENS for line in lines]
    units, first = [], 0
    while first < len(lines):
        best, rank, text = None, 0, ""
        for end in range(first + 1, len(lines) + 1):
            text = joined_lines([text, lines[end - 1]])
            if len(text) > cap:
                break
            kind = whole[end - 1] + (whole[end - 1] and ends_sentence(lines[end - 1]))
            if kind and kind >= rank:
                best, rank = end, kind
        if best is None:  # nothing fits: up to the first line that may end a unit
            best = next((k + 1 for k in range(first, len(lines)) if whole[k]), len(lines))
        units.append((first, best))
        first = best
    return units


def greedy(pieces: Iterable[str], cap: int) -> list[str]:
    """Pieces joined by spaces while they fit."""
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + 1 + len(p) <= cap:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def sentence_units(parts: list[str], cap: int) -> list[str]:
    """Sentences packed to cap; a longer one is cut between words, and its last piece packs on."""
    out: list[str] = []
    fresh = True  # whether the next sentence must begin a unit
    for s in parts:
        if len(s) > cap:
            out += greedy(s.split(" "), cap)
            fresh = False
        elif out and not fresh and len(out[-1]) + 1 + len(s) <= cap:
            out[-1] += " " + s
        else:
            out.append(s)
            fresh = False
    return out


def capped(sentence: str, cap: int) -> list[str]:
    """A long sentence in pieces of up to cap: by clauses, then words; a short last scrap joins its neighbour."""
    clauses = re.split(r"(?<=[,;:—–])\s+", sentence)
    out = greedy((p for c in clauses for p in ([c] if len(c) <= cap else greedy(c.split(), cap))), cap)
    for i in range(len(out) - 1, 0, -1):
        if len(out[i]) < SHORT_PIECE:
            out[i - 1 : i + 1] = [out[i - 1] + " " + out[i]]
    return out


def last_end(pattern: str, text: str, group: int = 0) -> int:
    """End of the last match, 0 if there is none."""
    return max((m.end(group) for m in re.finditer(pattern, text)), default=0)


def break_point(text: str, target: int, least: int) -> int:
    """Where a chunk that should end at target ends: blank line, sentence, line, space, or target."""
    if target >= len(text):
        return len(text)
    first = max(target - BREAK_WINDOW, least)
    part = text[first:target]
    blank = last_end(r"\r?\n\s*\r?\n", part)
    sentence = max((m.start() + 1 for m in re.finditer(r"[.!?](?=[ \n\r\"'“”‘’])", part)), default=0)
    line = max((m.end() for m in re.finditer(r"\r\n|\n|\r", part) if m.start() > 0), default=0)
    space = part.rfind(" ") + 1 if part.rfind(" ") > 0 else 0
    return first + (blank or sentence or line or space or len(part))


#: fixed values: how a chapter begins, in order of preference
CHAPTERS = (r"\n\n\n\n", r"(?i)\nChapter\s+\d+", r"(?i)\nKapitel\s+\d+", r"(?i)\nChapitre\s+\d+", r"(?i)\nCapítulo\s+\d+")
#: fixed values: how a sentence ends before the next
SENTENCE_BREAKS = (". ", "! ", "? ", '." ', '!" ', '?" ')


def chapter_break(text: str, target: int) -> int:
    """Where a chunk to translate ends: before a chapter, after a paragraph, a sentence or a word, else at target."""
    if target >= len(text):
        return len(text)
    first = max(0, target - CHAPTER_WINDOW)
    part = text[first:target]
    for pattern in CHAPTERS:
        if starts := [m.start() for m in re.finditer(pattern, part)]:
            return first + starts[-1]
    for ends, width in ((["\n\n"], 2), (SENTENCE_BREAKS, 2), ([" "], 1)):
        at = max(part.rfind(e) for e in ends)
        if at > 0:
            return first + at + width
    return target


def cut_text(text: str, size: int, where: Callable[[str, int, int], int]) -> list[str]:
    """Chunks of up to size characters that together are the text."""
    out, at = [], 0
    while at < len(text):
        end = max(at + 1, where(text, at + size, at))
        out.append(text[at:end])
        at = end
    return out


def balanced(text: str, brackets: str) -> str | None:
    """The first part of a text from an opening bracket to the one that closes it; brackets in strings don't count."""
    first = text.find(brackets[0])
    if first < 0:
        return None
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*"?|[' + re.escape(brackets) + "]", re.S).finditer(text, first):
        depth += {brackets[0]: 1, brackets[1]: -1}.get(m[0], 0)
        if depth == 0 and m[0] == brackets[1]:
            return text[first : m.end()]
    return None


def unfenced(reply: str) -> str:
    """A model's reply without its thoughts and outside of a code fence."""
    text = re.sub(r"(?is)<think>.*?</think>", "", reply).strip()
    fence = re.search(r"(?is)```(?:json)?\s*(.*?)```", text)
    return fence[1].strip() if fence else text


def of_text(kind: str, f: Callable[[str], object]) -> Callable[[Column], Column]:
    """f over a column of texts, as an Arrow function that holds one text at a time as an object; null gives null."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((f(t.as_py()) if t.is_valid else None for t in texts), arrow)

    return run
