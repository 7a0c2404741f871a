"""Pairs of aligned texts and runs: small helpers that go through one row in order, fed by Arrow."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: a cue ends with a sentence or at this many characters; an aligned pair with a sentence from MOST_PAIR on
MOST_CUE, LEAST_PAIR, MOST_PAIR = 240, 3, 60
SENTENCE_END = re.compile(r"""[.!?…]["”’')\]]*$""")
#: words of two runs can match this far off the diagonal, and are alike from this share on
BAND, ALIKE = 4, 0.75


def aligned_pairs(read: str, gold: str) -> list[tuple[str, str]]:
    """Pairs of two texts aligned by character: # in gold ends a pair, @ pads either, ends of sentences end long ones."""
    out = []
    for run in re.finditer("[^#]+", gold[: len(read)]):
        old, new = [], []
        for r, g in zip(read[run.start() : run.end()], run[0], strict=True):
            old += [r] * (r != "@")
            new += [g] * (g != "@")
            if len(old) >= MOST_PAIR and new and new[-1] in ".!?":
                out.append((old, new))
                old, new = [], []
        out.append((old, new))
    pairs = [("".join(a).strip(), "".join(b).strip()) for a, b in out]
    return [(a, b) for a, b in pairs if min(len(a), len(b)) >= LEAST_PAIR]


def likeness(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 0.0


def diagonal_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Each word of a in turn with the likest free word of b near its place; the first of several."""
    taken, out = set(), []
    for i, word in enumerate(a):
        near = [(likeness(word, b[j]), -j) for j in range(max(0, i - BAND), min(len(b), i + BAND + 1)) if j not in taken]
        score, j = max(near, default=(0.0, 0))
        if score >= ALIKE:
            taken.add(-j)
            out.append((i, -j))
    return out


def cue_numbers(words: list[str]) -> list[int]:
    """The cue of each word."""
    out, cue, chars = [], 0, 0
    for word in words:
        out.append(cue)
        chars += len(word) + 1
        if SENTENCE_END.search(word) or chars >= MOST_CUE:
            cue, chars = cue + 1, 0
    return out


def edges_restored(read: str, truth: str, most: int = 2) -> str:
    """The truth with up to `most` words at either edge that only the reading has, where the rest aligns."""
    old, new = read.split(), truth.split()
    steps = difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if old and new else []
    gone = [(i, j) for tag, i, j, _, _ in steps if tag == "delete" and j - i <= most]
    head = [w for i, j in gone if i == 0 for w in old[:j]]
    tail = [w for i, j in gone if j == len(old) for w in old[i:]]
    return " ".join(head + new + tail) if head or tail else truth


def packed_runs(runs: list[tuple[int, int]], least: int, most: int) -> list[tuple[int, int]]:
    """Runs in order made segments of up to `most`, closed between runs once they have `least`; a short end joins the last."""
    out: list[tuple[int, int]] = []
    for lo, hi in ((p, min(p + most, end)) for start, end in runs for p in range(start, end, most)):
        if out and (hi - out[-1][0] <= most or out[-1][1] - out[-1][0] < least):
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        _, end = out.pop()
        out[-1] = (out[-1][0], end)
    return out


def by_row(kind: str, f: Callable) -> Callable[..., Column]:
    """A function of Columns that applies f to each row; null where the first argument is."""

    def rows(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if r[0] is None else f(*r) for r in zip(*columns, strict=True)])

    return lambda *columns: F.pandas_udf(_series(rows, len(columns)), kind)(*columns)


def _series(rows: Callable, n: int) -> Callable:
    """rows with n parameters of a declared type, which Spark reads."""
    if n == 1:

        def one(a: pd.Series) -> pd.Series:
            return rows(a)

        return one

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return rows(a, b)

    return two


def prefix_length(a: Column, b: Column) -> Column:
    """How many items two arrays share from their start."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, shorter).cast("int")
