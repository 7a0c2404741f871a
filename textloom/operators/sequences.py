"""Sequential algorithms over one bounded group at a time, in Arrow-fed pandas functions.

Spark groups and deals the rows; each function below sees one document or conversation. Documents are the unit
because the semantics are sequential inside one; no function sees a group that grows with the corpus.
"""

from __future__ import annotations

import bisect
import difflib
import sys
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# functions go to the executors by value: a cluster needs no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rising_lengths(values: list[int]) -> list[int]:
    """For each place, the length of the longest strictly rising subsequence that ends there."""
    least_end: list[int] = []  # of each length, the least value that such a subsequence can end in
    out = []
    for v in values:
        length = bisect.bisect_left(least_end, v)
        least_end[length : length + 1] = [v]
        out.append(length + 1)
    return out


def rising_indices(values: list[int], earliest: bool = False) -> list[int]:
    """Indices of a longest strictly rising subsequence; of several, the one whose indices are latest, or earliest.

    What a place can still be followed by (or has been led up to by) is known from the lengths; one pass then takes
    the first place that fits.
    """
    if earliest:
        after = rising_lengths([-v for v in reversed(values)])[::-1]
        order, lengths, before = range(len(values)), after, lambda last, v: last < v
    else:
        order, lengths, before = range(len(values) - 1, -1, -1), rising_lengths(values), lambda last, v: v < last
    want, out = max(lengths, default=0), []
    for i in order:
        if lengths[i] == want and (not out or before(values[out[-1]], values[i])):
            out.append(i)
            want -= 1
    return out if earliest else out[::-1]


def longest_rising(column: Column, earliest: bool = False) -> Column:
    """array<int> of the indices, from 0, of a longest strictly rising subsequence of an array column."""

    @F.pandas_udf("array<int>")
    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else rising_indices(list(v), earliest))

    return find(column)


def pack(lengths: list[int], cap: int, gap: int = 1) -> list[int]:
    """Chunk number of each piece: a piece joins the chunk while it fits, an oversize one stands alone."""
    out, used, chunk = [], 0, 0
    for n in lengths:
        if used and used + gap + n > cap:
            chunk, used = chunk + 1, 0
        used += n + (gap if used else 0)
        out.append(chunk)
    return out


def packed(column: Column, cap: int) -> Column:
    """Chunk numbers of the pieces of an array<string> column, packed greedily up to cap characters.

    Only the lengths go to Python, a row's at a time.
    """

    @F.arrow_udf("array<int>")
    def find(lengths: pa.Array) -> pa.Array:
        out, ends, valid = array("i"), array("i", [0]), []
        for row in lengths:
            if row.is_valid:
                out.extend(pack(row.as_py(), cap))
            ends.append(len(out))
            valid.append(row.is_valid)
        offsets = pa.array([e if v else None for e, v in zip(ends, [*valid, True], strict=True)], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(memoryview(out), pa.int32()))

    return find(F.transform(column, lambda x: F.length(x)))


def word_changes(old: list[str], new: list[str]) -> list[dict]:
    """Compact changes over the new words: place, length, what was added and what was removed."""
    ops = difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
    return [{"pos": j0, "len": j1 - j0, "add": " ".join(new[j0:j1]), "rem": " ".join(old[i0:i1])} for tag, i0, i1, j0, j1 in ops if tag != "equal"]


CHANGES = "array<struct<pos:int,len:int,add:string,rem:string>>"


def changes(old: Column, new: Column) -> Column:
    """Word changes from old to new, whole texts of any length; the time may grow with the product of the word counts."""

    @F.pandas_udf(CHANGES)
    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([word_changes((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)])

    return find(old, new)


def hydrated(new: Column, found: Column) -> Column:
    """The old words, from the new ones and their changes, by native higher-order functions."""
    words = F.filter(F.split(F.coalesce(new, F.lit("")), r"[ \t\n\r\x0b\f]+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        kept = F.slice(words, acc["at"] + 1, c["pos"] - acc["at"])
        gone = F.filter(F.split(c["rem"], " "), lambda w: w != "")
        return F.struct((c["pos"] + c["len"]).alias("at"), F.concat(acc["out"], kept, gone).alias("out"))

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.slice(words, acc["at"] + 1, F.greatest(F.lit(0), F.size(words) - acc["at"]))))


def kept_cues(rows: DataFrame, key: str) -> DataFrame:
    """Drops a cue (lo, hi) that begins inside one already kept; each group in order of lo, hi."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, reached = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r[0] != group:
                    group, reached = r[0], None
                if reached is None or r.lo >= reached:
                    out.append(r)
                    reached = r.hi
            yield pd.DataFrame(out, columns=pdf.columns)

    bare = rows.select(key, "id", "lo", "hi")
    return bare.repartition(key).sortWithinPartitions(key, "lo", "hi", "id").mapInPandas(keep, bare.schema)
