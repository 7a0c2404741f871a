"""Edit lists: differences of two texts word by word, the edits that carry one into the other, guarded repairs.

Texts are split at single spaces, so joining the words gives them back. The k-th occurrence of a word in the old text
meets its k-th in the new one; a pair that no other pair crosses is a fixed point. Between fixed points next to each
other lie the runs that differ. A text pair is one row, and its words never leave it: words are compared by their codes,
thousands of pairs at a time, and what is made of the runs are functions of the row. Pairs are dealt by their keys once,
where they are dealt at all.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: fixed values: characters an anchor may have, equal characters that part two edits, the share and the number of
#: characters that a list of edits may touch, and edits of one word that a guard accepts
LONGEST_ANCHOR, GAP, SHARE, ALWAYS, WORD_EDITS = 80, 6, 0.25, 12, 2
#: words that an anchor may gain on each side: any more are over LONGEST_ANCHOR characters
WIDEST = LONGEST_ANCHOR // 2
#: bytes of text whose words are compared together, which bounds a task's memory
BYTES_AT_ONCE = 1 << 22
#: fixed values: marks that are the same in another font
SAME_MARK = ("‘’‚‛′“”„‟″‐‑‒–—−", "'''''\"\"\"\"\"------")


def dealt(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Texts or pairs by their keys, so that all tasks have some whatever the files are.

    The count of partitions is given, as a small exchange of texts would be merged for what is much work.
    """
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _met(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two lists of (text, word): the k-th of a word in a text with the k-th of that word in that text."""

    def groups(texts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        kind = texts * codes + words
        order = np.argsort(kind, kind="stable")
        return order, *np.unique(kind[order], return_index=True, return_counts=True)

    a, kinds_a, first_a, many_a = groups(*old)
    b, kinds_b, first_b, many_b = groups(*new)
    _, x, y = np.intersect1d(kinds_a, kinds_b, assume_unique=True, return_indices=True)
    many = np.minimum(many_a[x], many_b[y])
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    i, j = a[np.repeat(first_a[x], many) + nth], b[np.repeat(first_b[y], many) + nth]
    order = np.argsort(i)
    return i[order], j[order]


def found_runs(ow: pa.ListArray, nw: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(pair, i0, i1, j0, j1) of all runs of pairs of word lists, in order."""
    many, pairs = [pc.list_value_length(w).to_numpy().astype(np.int64) for w in (ow, nw)], np.arange(len(ow))
    own = [np.repeat(pairs, n) for n in many]
    words = pc.dictionary_encode(pa.concat_arrays([ow.flatten(), nw.flatten()]))
    codes = words.indices.to_numpy().astype(np.int64)
    i, j = _met((own[0], codes[: len(own[0])]), (own[1], codes[len(own[0]) :]), max(1, len(words.dictionary)))
    # a place more at the end of each text: the ends stand for each other
    end_i, end_j = (np.cumsum(n + 1) - 1 for n in many)
    i, j = i + own[0][i], j + own[0][i]
    # pairs follow each other on both sides, so only words of one pair can cross
    before = np.concatenate([[-1], np.maximum.accumulate(j)[:-1]])[: len(j)]
    after = np.concatenate([np.minimum.accumulate(j[::-1])[::-1][1:], [1 << 62]])[: len(j)]
    kept = (j > before) & (j < after)
    i, j = np.concatenate([i[kept], end_i]), np.concatenate([j[kept], end_j])
    order = np.argsort(i)
    i, j = i[order], j[order]
    i0, j0 = (np.concatenate([[0], x[:-1] + 1])[: len(x)] for x in (i, j))
    apart = (i0 < i) | (j0 < j)
    pair = np.searchsorted(end_i, i[apart])
    low_i, low_j = (end_i - many[0])[pair], (end_j - many[1])[pair]
    return pair, i0[apart] - low_i, i[apart] - low_i, j0[apart] - low_j, j[apart] - low_j


def found_edits(ow: pa.ListArray, nw: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(pair, i0, i1, j0, j1, left, right): runs with at most GAP equal characters between them made one, and how many
    equal words stand on either side of each."""
    pair, i0, i1, j0, j1 = found_runs(ow, nw)
    many = pc.list_value_length(ow).to_numpy().astype(np.int64)
    low = np.cumsum(many) - many
    upto = np.concatenate([[0], np.cumsum(pc.utf8_length(ow.flatten()).to_numpy().astype(np.int64))])
    # characters of the first words of a text, joined
    joined = lambda i: upto[low[pair] + i] - upto[low[pair]] + np.maximum(i - 1, 0)
    first = np.ones(len(pair), bool)
    first[1:] = (pair[1:] != pair[:-1]) | (joined(i0)[1:] - joined(i1)[:-1] > GAP)
    last = np.append(first[1:], True)[: len(first)]
    pair, i0, i1, j0, j1 = pair[first], i0[first], i1[last], j0[first], j1[last]
    same = pair[1:] == pair[:-1]
    left, right = i0.copy(), many[pair] - i1
    between = i0[1:] - i1[:-1]
    left[1:][same], right[:-1][same] = between[same], between[same]
    return pair, i0, i1, j0, j1, left, right


def _listed(find: Callable[..., tuple[np.ndarray, ...]], names: list[str], old: Column, new: Column) -> Column:
    """What find makes of the words of each row's two texts, array<struct<names: int>>; null where a text is null."""

    def parts(old: pa.Array, new: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
        upto = np.cumsum(pc.binary_length(old).to_numpy().astype(np.int64) + pc.binary_length(new).to_numpy())
        at = 0
        while at < len(old):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
            yield old.slice(at, to - at), new.slice(at, to - at)
            at = to

    @F.arrow_udf(f"array<struct<{','.join(f'{x}:int' for x in names)}>>")
    def run(old: pa.Array, new: pa.Array) -> pa.Array:
        valid = pc.and_(old.is_valid(), new.is_valid())
        old, new = (pc.if_else(valid, x, pa.scalar("", x.type)) for x in (old, new))
        many, columns = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] for _ in names]
        for a, b in parts(old, new):
            pair, *values = find(pc.split_pattern(a, " "), pc.split_pattern(b, " "))
            many.append(np.bincount(pair, minlength=len(a)))
            for column, v in zip(columns, values, strict=True):
                column.append(v)
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(np.int32)) for c in columns], names)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(many))]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, rows, mask=pc.invert(valid))

    return run(old, new)


def _of_pairs(find: Callable[..., tuple[np.ndarray, ...]], names: list[str], keys: list[str]) -> Column:
    """find for `old` and `new`; a pair with a null key has none."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return _listed(find, names, F.when(known, F.col("old")), F.col("new"))


RUN = ["i0", "i1", "j0", "j1"]


def runs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i0, i1, j0, j1): stretches of words that differ, one row for each; a pair of equal texts has none.

    pairs stay where they are.
    """
    listed = pairs.select(*keys, _of_pairs(found_runs, RUN, keys).alias("_runs"))
    # the outer form, as Spark puts a filter below the other one that would find all runs a second time
    return listed.select(*keys, F.inline_outer("_runs")).filter("i0 is not null")


def tag(i0: Column, i1: Column, j0: Column, j1: Column) -> Column:
    return F.when(i0 == i1, "insert").when(j0 == j1, "delete").otherwise("replace")


def _span(words: str, first, end) -> Column:
    """Words from first up to end, joined."""
    return F.array_join(F.slice(words, first + 1, end - first), " ")


def derived(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """`with_edits` of the pairs dealt by their keys."""
    return with_edits(dealt(pairs, keys), keys)


def with_edits(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with `edits`, array<struct<before, after>>, that carry old into new; null where there is no safe list.

    Runs with at most GAP equal characters between them are one edit. An edit takes in equal words on both sides, one
    at a time, until its text stands once in the old text. Edits that overlap, that are too long, hold a line break or
    an arrow (the mark of a written edit), or together touch too much, make the whole list unsafe. pairs stay where
    they are.
    """
    kind = "struct<before:string,after:string>"
    rows = pairs.withColumn("_bounds", _of_pairs(found_edits, [*RUN, "left", "right"], keys))
    rows = rows.withColumns({"_ow": F.split("old", " ", -1), "_nw": F.split("new", " ", -1)})

    def widened(b: Column, k: Column) -> Column:
        left, right = F.least(k, b["left"]), F.least(k, b["right"])
        before, after = _span("_ow", b["i0"] - left, b["i1"] + right), _span("_nw", b["j0"] - left, b["j1"] + right)
        return F.struct(before.alias("before"), after.alias("after"))

    once = lambda e: (F.position(e["before"], F.col("old")) > 0) & (F.position(e["before"], F.col("old"), F.position(e["before"], F.col("old")) + 1) == 0)
    safe = lambda e: (e["before"] != "") & (F.length(e["before"]) <= LONGEST_ANCHOR) & once(e) & ~F.concat(e["before"], e["after"]).rlike("[\r\n→]|->")
    # a text that is too long stays so when it takes in more
    tried = lambda e: F.struct(F.when(safe(e), e).alias("e"), (F.length(e["before"]) > LONGEST_ANCHOR).alias("over"))

    def first_safe(b: Column) -> Column:
        # the array of one names a text that stands several times in what follows, so that it is worked out once
        step = lambda acc, k: F.when(acc["e"].isNotNull() | acc["over"], acc).otherwise(F.get(F.transform(F.array(widened(b, k)), tried), F.lit(0)))
        return F.aggregate(F.sequence(F.lit(0), F.lit(WIDEST)), F.struct(F.lit(None).cast(kind).alias("e"), F.lit(False).alias("over")), step)["e"]

    rows = rows.withColumn("_list", F.transform("_bounds", first_safe))
    touched = F.aggregate("_list", F.lit(0), lambda n, e: n + F.greatest(F.length(e["before"]), F.length(e["after"])))
    # a list that touches too much is not made
    sound = ~F.exists("_list", lambda e: e.isNull()) & ((touched <= ALWAYS) | (touched <= F.length("old") * SHARE))
    edits = F.when(F.col("old") == F.col("new"), F.array().cast(f"array<{kind}>")).when(sound, F.col("_list"))
    done = applied(rows.withColumn("edits", edits).drop("_bounds", "_ow", "_nw", "_list"), "old", "edits")
    held = (F.col("done.text") == F.col("new")) & (F.size("done.rejected") == 0)
    return done.withColumn("edits", F.when(held, F.col("edits"))).drop("done")


def applied(rows: DataFrame, text: str, edits: str) -> DataFrame:
    """rows with `done`, struct (text, applied, rejected): text after the edits, how many were made, and why others were not.

    An edit is made at the one place where its text stands. Of edits that overlap, the first in the text is made. If
    those that could be made touch too much of the text, none is. A null text is empty, null edits are none.
    """
    old = F.col("_text")

    def claim(e: Column) -> Column:
        before = F.coalesce(e["before"], F.lit(""))
        at = F.when(before != "", F.position(before, old)).otherwise(0)
        why = F.when(before == "", "empty").when(F.length(before) > LONGEST_ANCHOR, "long").when(at == 0, "missing").when(F.position(before, old, at + 1) > 0, "ambiguous")
        return F.struct(at.alias("at"), before.alias("before"), F.coalesce(e["after"], F.lit("")).alias("after"), why.alias("why"))

    def take(acc: Column, c: Column) -> Column:
        fits = c["at"] >= acc["end"]
        return F.struct(F.when(fits, F.array_append(acc["kept"], c)).otherwise(acc["kept"]).alias("kept"), F.when(fits, c["at"] + F.length(c["before"])).otherwise(acc["end"]).alias("end"))

    def put(acc: Column, c: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substring(old, acc["at"], c["at"] - acc["at"]), c["after"]).alias("out"), (c["at"] + F.length(c["before"])).alias("at"))

    # a column for each step: an expression that stands several times would be worked out as often
    steps = rows.withColumns({"_text": F.coalesce(text, F.lit("")), "_edits": F.coalesce(edits, F.array().cast("array<struct<before:string,after:string>>"))})
    steps = steps.withColumn("_claims", F.transform("_edits", claim))
    steps = steps.withColumn("_sound", F.array_sort(F.filter("_claims", lambda c: c["why"].isNull())))
    none = F.struct(F.filter("_claims", lambda c: F.lit(False)).alias("kept"), F.lit(0).alias("end"))
    steps = steps.withColumn("_kept", F.aggregate("_sound", none, take)["kept"])
    touched = F.aggregate("_kept", F.lit(0), lambda n, c: n + F.greatest(F.length(c["before"]), F.length(c["after"])))
    steps = steps.withColumn("_touched", touched).withColumn("_much", (F.col("_touched") > ALWAYS) & (F.col("_touched") > F.length(old) * SHARE))
    made = F.aggregate("_kept", F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda acc: F.concat(acc["out"], F.substring(old, acc["at"], F.length(old))))
    refused = F.transform(F.filter("_claims", lambda c: c["why"].isNotNull()), lambda c: c["why"])
    overlaps = F.array_repeat(F.lit("overlap"), F.size("_sound") - F.size("_kept"))
    over = F.array_repeat(F.lit("budget"), F.when(F.col("_much"), F.size("_kept")).otherwise(0))
    done = F.struct(F.when(F.col("_much"), old).otherwise(made).alias("text"), F.when(F.col("_much"), 0).otherwise(F.size("_kept")).alias("applied"), F.concat(refused, overlaps, over).alias("rejected"))
    return steps.withColumn("done", done).drop("_text", "_edits", "_claims", "_sound", "_kept", "_touched", "_much")


def plausible(gone: Column, new: Column, most: int = WORD_EDITS) -> Column:
    """Whether a changed run of words is a likely repair: a moved space, or as many words that differ by a few letters each.

    Words that differ in the font of a mark alone are not repaired.
    """
    worded = F.forall(F.concat(gone, new), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    moved = (F.array_join(gone, "") == F.array_join(new, "")) & worded
    same = lambda words: F.transform(words, lambda w: F.replace(F.translate(w, *SAME_MARK), F.lit("…"), F.lit("...")))
    near = F.forall(F.zip_with(gone, new, lambda a, b: F.levenshtein(a, b, most) >= 0), lambda x: x)
    return moved | ((F.size(gone) == F.size(new)) & (same(gone) != same(new)) & near)


def guarded(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """`with_guard` of the pairs dealt by their keys."""
    return with_guard(dealt(pairs, keys), keys)


def with_guard(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs of two texts with accepted, rejected and per_run: changed runs by whether they are plausible, and old with those that are.

    pairs stay where they are.
    """
    rows = pairs.filter("old is not null and new is not null").withColumn("_runs", _of_pairs(found_runs, RUN, keys))
    rows = rows.withColumns({"_ow": F.split("old", " ", -1), "_nw": F.split("new", " ", -1)})
    part = lambda words, a, b: F.slice(words, a + 1, b - a)
    changed = F.transform("_runs", lambda r: F.struct(r["i0"], r["i1"], part("_ow", r["i0"], r["i1"]).alias("gone"), part("_nw", r["j0"], r["j1"]).alias("new")))
    judged = F.transform("_changed", lambda c: F.struct(c["i0"], c["i1"], plausible(c["gone"], c["new"]).alias("fine"), c["gone"], c["new"]))
    rows = rows.withColumn("_changed", F.coalesce(changed, F.array())).withColumn("_judged", judged)
    past = lambda k: F.coalesce(F.get("_judged", k - 1)["i1"], F.lit(0))
    put = F.transform("_judged", lambda c, k: F.concat(part("_ow", past(k), c["i0"]), F.when(c["fine"], c["new"]).otherwise(c["gone"])))
    end = past(F.size("_judged"))
    text = F.array_join(F.concat(F.flatten(put), part("_ow", end, F.size("_ow"))), " ")
    fine, not_fine = (F.size(F.filter("_judged", lambda c: c["fine"] == x)).cast("long") for x in (True, False))  # noqa: B023
    return rows.select(*pairs.columns, fine.alias("accepted"), not_fine.alias("rejected"), text.alias("per_run"))
