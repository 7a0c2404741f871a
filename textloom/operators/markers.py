"""Footnote markers, block groups and cues: the steps that go through one text in order, as Arrow-fed helpers."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import longest_rising

#: fixed value: a number of up to three digits after the end of a sentence, at most one space between
CANDIDATE = r"""(?<=[^0-9][.!?”’"'])[ ]?[0-9]{1,3}(?![A-Za-z0-9])(?=[\t\n\f\r ]|\z)"""
#: a group of blocks holds this many blocks and characters at most, and is sent from this many characters on
MOST_BLOCKS, MOST_CHARS, LEAST_SENT = 8, 4000, 120
#: plain characters kept before a marker, and the fewest that can place it
CONTEXT, LEAST_CONTEXT = 34, 12

SUP = re.compile(r"<sup\b[^>]*>(.*?)</sup>", re.I | re.S)
NUMBERS = re.compile(r"[\d,;–—\s-]*\d[\d,;–—\s-]*")


def selected(text: Column) -> Column:
    """struct(values, chain): the values of all candidates in a text and the places of the chain they rise in."""
    values = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda x: F.trim(x).cast("int"))
    return F.struct(values.alias("values"), longest_rising(values, earliest=True).alias("chain"))


#: fixed values: members that a chain needs, its greatest first member, and values outside it, as a number and a share
LEAST_CHAIN, GREATEST_FIRST, OUTSIDE, OUTSIDE_SHARE = 3, 3, 2, 0.2


def trusted(values: Column, chain: Column, restarts: bool = True) -> Column:
    """Whether a chain is one of footnotes: three members or more, few values outside it, begun by 3 if chapters restart."""
    outside = F.size(values) - F.size(chain)
    allowed = F.greatest(F.lit(OUTSIDE), F.ceil(F.size(values) * OUTSIDE_SHARE))
    sound = (F.size(chain) >= LEAST_CHAIN) & (outside <= allowed)
    return sound & (F.get(values, F.get(chain, F.lit(0))) <= GREATEST_FIRST) if restarts else sound


def without_chain(text: Column, chain: Column) -> Column:
    """The text without the candidates at the places of chain; the others stay."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    gone = F.map_from_arrays(chain, F.transform(chain, lambda _: F.lit("")))
    kept = F.transform(found, lambda x, i: F.coalesce(gone[i], x))
    return F.array_join(F.zip_with(F.split(text, CANDIDATE, -1), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def plain(markup: str) -> str:
    """Text without tags and soft hyphens, references resolved, white space made single spaces."""
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", markup)).replace("­", ""))


def structural_markers(markup: str | None) -> list[dict]:
    """Superscript numbers with the plain text before each; what stands before is carried on, not read again."""
    out, before, at = [], "", 0
    for m in SUP.finditer(markup or ""):
        before = re.sub(r"\s+", " ", before + plain(markup[at : m.start()]))[-4 * CONTEXT :]
        at = m.start()
        value, context = plain(m[1]).strip(), before.rstrip()
        if NUMBERS.fullmatch(value) and len(context) >= LEAST_CONTEXT:
            out.append({"value": re.sub(r"\s+", "", value), "context": context[-CONTEXT:]})
    return out


def placements(markers: list[dict], text: str | None) -> list[int]:
    """How often each marker's context stands in a text with its value after it, in one pass over the text."""
    text = re.sub(r"\s+", " ", text or "")
    wanted: dict[str, list[int]] = {}
    for i, m in enumerate(markers):
        wanted.setdefault(m["context"], []).append(i)
    lengths, count = sorted({len(c) for c in wanted}), [0] * len(markers)
    for found in re.finditer(r"[\d,;–—-]", text):
        start = found.start()
        for end in {start, start - (text[start - 1 : start] == " ")}:
            for length in lengths:
                for i in wanted.get(text[end - length : end], ()) if end >= length else ():
                    value = markers[i]["value"]
                    after = text[start + len(value) : start + len(value) + 1]
                    count[i] += text.startswith(value, start) and not ("0" <= after <= "9" and after != "")
    return count


def group_numbers(tags: list[str], lengths: list[int]) -> list[int]:
    """The group of each block, -1 for headings, which end a group and belong to none."""
    out, group, blocks, chars = [], 0, 0, 0
    for tag, length in zip(tags, lengths, strict=True):
        heading = re.fullmatch("h[1-6]", tag.lower()) is not None
        if blocks and (heading or blocks >= MOST_BLOCKS or chars + length > MOST_CHARS):
            group, blocks, chars = group + 1, 0, 0
        if not heading:
            blocks, chars = blocks + 1, chars + length
        out.append(-1 if heading else group)
    return out


def block_groups(tags: Column, lengths: Column) -> Column:
    """array<int> of group numbers for arrays of tags and text lengths."""

    def numbers(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([group_numbers(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(numbers, "array<int>")(tags, lengths)


def markers_of(markup: Column) -> Column:
    """array<struct<value string, context string>>: the superscript markers of a page."""

    def found(a: pd.Series) -> pd.Series:
        return pd.Series([structural_markers(x) for x in a])

    return F.pandas_udf(found, "array<struct<value string, context string>>")(markup)


def placed(markers: Column, text: Column) -> Column:
    """array<int>: places of each marker in the text; a marker with exactly one can be removed."""

    def places(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([placements(list(m), x) for m, x in zip(a, b, strict=True)])

    return F.pandas_udf(places, "array<int>")(markers, text)
