"""Quotes and components by plain rules."""

import re

from pyspark.sql import functions as F

from textloom.operators import graphs as G
from textloom.operators import repairs as R


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    return 1 - distance(a, b) / max(len(a), len(b))


def quoted(quote, text):
    if quote is None or text is None:
        return None
    q, t = (re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", x.lower())).strip() for x in (quote, text))
    if len(q) < 3 or len(t) < 3:
        return False
    if q in t or any(len(q[:k]) >= 15 and q[:k] in t for k in (50, 25)):
        return True
    words, n = t.split(" "), len(q.split(" "))
    windows = [" ".join(words[i : i + k]) for k in range(max(1, n - 2), n + 3) for i in range(len(words) - k + 1)]
    if any(alike(q, w) >= 0.65 for w in windows):
        return True
    telling = [w for w in q.split(" ") if len(w) > 3 and w not in R.COMMON_WORDS]
    held = [w for w in telling if any(w == x or len(x) > 3 and alike(w, x) > 0.75 for x in words)]
    return bool(telling) and len(held) > 0.4 * len(telling)


def test_is_quoted(spark):
    text = "The Größe of the old harbour wall, they said, was measured twice: once in spring and once before the storm."
    quotes = ["harbour wall", "the HARBOUR wall they said", "hrbour wal thay said wos", "storms, harbours; measures and lanterns", "lanterns beyond mountains",
              "that this those", "größe", "ab", "", None, "once in spring and once before the flood came over us all", "wall of spring, zebra crossing yellow river"]
    rows = [(q, t) for q in quotes for t in (text, "", None, "ab", "storm")]
    found = spark.createDataFrame(rows, "q string, t string").select("q", "t", R.is_quoted(F.col("q"), F.col("t")).alias("hit")).collect()
    assert {(r["q"], r["t"]): r["hit"] for r in found} == {(q, t): quoted(q, t) for q, t in rows}
    assert {quoted(q, text) for q in quotes} == {True, False, None}


def test_kinds(spark):
    rows = [(1, "a", 1), (2, "r", 1), (3, "a", 2), (4, "r", 2), (5, "r", 2), (6, "a", 3), (7, "a", 3), (8, "r", 3), (9, "a", 4), (10, "r", 5), (11, "a", 6), (12, "a", 6), (13, "r", 6), (14, "r", 6)]
    found = G.kinds(spark.createDataFrame(rows, "id int, side string, component int"), "component", F.col("side") == "a").collect()
    assert {r["component"]: r["kind"] for r in found} == {1: "one_to_one", 2: "merged", 3: "split", 4: "spurious", 5: "missed", 6: "tangled"}
