"""Where the blocks of a text stand in a stream of words: votes, the main flow, proof, and a search between neighbours.

A text and its blocks are one row, dealt by Spark: what is looked up are the text's own words, so no word leaves its
row. The work of a text is that of its grams, and of the tries of blocks without a place between their neighbours.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.staging import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: fixed values: words of a gram and places that one may have, words from which a block needs two votes, the share of
#: words to find on and off the flow and between neighbours, words before and after a block's place, and of a search
GRAM, MOST_PLACES, LONG_BLOCK, ON_FLOW, OFF_FLOW, RESCUED, BEFORE, AFTER, MARGIN, BLIND = 4, 2, 12, 0.55, 0.7, 0.6, 3, 5, 40, 600


def rising_chain(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order): a longest chain of rows whose values strictly rise in the order; of equal ones that of the least end."""
    kinds = dict(rows.select(key, order, value).dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, parent {kinds[order]}, length int"

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends, tails = object(), [], []
        for batch in batches:
            parents, lengths = [], []
            for k, o, v in zip(*(batch[c].to_pylist() for c in (key, order, value)), strict=True):
                if k != at:
                    at, ends, tails = k, [], []
                place = bisect_left(ends, v)
                parents.append(tails[place - 1] if place else None)
                lengths.append(place + 1)
                ends[place : place + 1], tails[place : place + 1] = [v], [o]
            yield pa.RecordBatch.from_arrays([batch[key], batch[order], pa.array(parents, batch[order].type), pa.array(lengths, pa.int32())], [key, order, "parent", "length"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wanted, found = object(), None, False
        for batch in batches:
            keep = []
            for k, o, parent, length, most in zip(*(batch[c].to_pylist() for c in (key, order, "parent", "length", "most")), strict=True):
                if k != at:
                    at, wanted, found = k, None, False
                on = o == wanted if found else length == most
                if on:
                    wanted, found = parent, True
                keep.append(on)
            yield pa.RecordBatch.from_arrays([batch[key], batch[order]], [key, order]).filter(pa.array(keep, pa.bool_()))

    placed = rows.filter(F.col(value).isNotNull()).select(key, order, value).repartition(key).sortWithinPartitions(key, order).mapInArrow(grow, schema)
    placed = staged(placed)
    most = placed.groupBy(key).agg(F.max("length").alias("most"))
    back = placed.join(most, key).repartition(key).sortWithinPartitions(F.asc(key), F.desc(order))
    return back.mapInArrow(follow, f"{key} {kinds[key]}, {order} {kinds[order]}")


def in_order(words: list[str], places: dict[str, list[int]], start: int, end: int, least: float = 0.0) -> float:
    """Share of words that a stream holds in order from start up to end: each is looked for after the last one found.

    Words that are not there are passed; a share that can't reach `least` any more is 0.
    """
    at, hit, spare = max(0, start), 0, len(words)
    for word in words:
        where = places.get(word, ())
        k = bisect_left(where, at)
        if k < len(where) and where[k] < end:
            at, hit = where[k] + 1, hit + 1
        else:
            spare -= 1
            if spare / len(words) < least:
                return 0.0
    return hit / len(words) if words else 0.0


def anchored(blocks: list[tuple[int, list[str]]], stream: list[str]) -> dict[int, int]:
    """The place that most rare grams of a block vote for, the first of equal ones."""
    wanted = {tuple(words[i : i + GRAM]) for _, words in blocks for i in range(len(words) - GRAM + 1)}
    index: dict[tuple, list[int]] = {}
    for i in range(len(stream) - GRAM + 1):
        gram = tuple(stream[i : i + GRAM])
        if gram in wanted:
            index.setdefault(gram, []).append(i)
    found = {}
    for block, words in blocks:
        votes: dict[int, int] = {}
        for i in range(len(words) - GRAM + 1):
            at = index.get(tuple(words[i : i + GRAM]), ())
            for pos in at if len(at) <= MOST_PLACES else ():
                votes[pos - i] = votes.get(pos - i, 0) + 1
        place, most = min(votes.items(), key=lambda v: (-v[1], v[0]), default=(0, 0))
        if most >= (2 if len(words) >= LONG_BLOCK else 1):
            found[block] = place
    return found


def main_flow(found: dict[int, int]) -> set[int]:
    """Blocks of a longest chain whose places strictly rise; of equal ones that of the least end."""
    ends, tails, parent = [], [], {}
    for block, place in sorted(found.items()):
        k = bisect_left(ends, place)
        parent[block] = tails[k - 1] if k else None
        ends[k : k + 1], tails[k : k + 1] = [place], [block]
    flow, at = set(), tails[-1] if tails else None
    while at is not None:
        flow.add(at)
        at = parent[at]
    return flow


def places_in(blocks: list[tuple[int, list[str]]], stream: list[str]) -> list[tuple[int, int, float, bool | None]]:
    """(block, pos, ratio, flow) of one text: votes, the flow, proof, then a search between the neighbours on the flow."""
    places: dict[str, list[int]] = {}
    for pos, word in enumerate(stream):
        places.setdefault(word, []).append(pos)
    blocks = sorted(blocks)
    found = anchored(blocks, stream)
    flow, matched = main_flow(found), {}
    for block, words in blocks:
        if block in found:
            at = found[block]
            ratio = in_order(words, places, at - BEFORE, at + len(words) + AFTER)
            if ratio >= (ON_FLOW if block in flow else OFF_FLOW):
                matched[block] = (block, at, ratio, block in flow)
    out, following, last = list(matched.values()), {}, None
    for block, _ in reversed(blocks):
        following[block] = last
        if block in matched and block in flow:
            last = matched[block][1]
    last = None
    for block, words in blocks:
        if block in matched:
            last = matched[block][1] + len(words) if block in flow else last
            continue
        after, n = following[block], len(words)
        if not n or (last is None and after is None):
            continue
        lo = max(0, (last if last is not None else after - BLIND) - MARGIN)
        hi = min(len(stream), (after if after is not None else last + BLIND) + MARGIN)
        tries = [(in_order(words, places, at, at + n + AFTER, RESCUED), -at) for at in range(lo, hi - n + 1, max(1, n // 2))]
        best = max(tries, default=(0.0, 0))
        if best[0] >= RESCUED:
            out.append((block, -best[1], best[0], None))
    return out


def placed_in_texts(texts: DataFrame, key: str) -> DataFrame:
    """(key, block, pos, ratio, flow) of texts (key, words, blocks), a row a text with its words and its (block, words)."""
    kind = dict(texts.select(key).dtypes)[key]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a text at a time: a batch may hold thousands
                own = [(b["block"], b["words"] or []) for b in batch["blocks"][i].as_py() or []]
                rows = places_in(own, batch["words"][i].as_py() or [])
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch[key][i], len(rows)), *columns], [key, "block", "pos", "ratio", "flow"])

    return texts.select(key, "words", "blocks").mapInArrow(place, f"{key} {kind}, block long, pos long, ratio double, flow boolean")


def placed_blocks(blocks: DataFrame, stream: DataFrame, key: str) -> DataFrame:
    """(key, block, pos, ratio, flow) of the blocks (key, block, words) that are found in the stream (key, pos, word).

    flow: on the main flow; null for blocks found between the neighbours. Blocks off the flow need stronger proof. A
    text's positions count from 0 without gaps; its words and its blocks are brought together once.
    """
    own = blocks.groupBy(key).agg(F.collect_list(F.struct(F.col("block").cast("long").alias("block"), "words")).alias("blocks"))
    words = stream.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    return placed_in_texts(own.join(words, key), key)
